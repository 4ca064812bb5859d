"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the driver tables through ``sources.tables`` adapters and
runs one operator (or one job) of the package over the whole tables. Result
columns are flat (structs split into ``_ko``/``_en``, arrays joined) so that
the SQL restatement in ``plans/oracle.py`` yields the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroll.functions import dates as D
from pressroll.functions import documents as V
from pressroll.functions import strings as S
from pressroll.operators import articles as A
from pressroll.operators import bitmaps as Bm
from pressroll.operators import events as Ev
from pressroll.operators import index as I
from pressroll.operators import integrity as G
from pressroll.operators import postings as P
from pressroll.operators import repair as R
from pressroll.operators import schedule as Sc
from pressroll.operators import sketches as Sk
from pressroll.operators import validate as Vd
from pressroll.operators.maintain import Summaries
from pressroll.operators.model import answered, organize_stub
from pressroll.operators.model import apply_model as _apply_model
from pressroll.plans.ingest import ingest as _ingest
from pressroll.plans.replay import replay
from pressroll.session import configure, materialize, work_dir
from pressroll.sources import files as Fs
from pressroll.sources import json_store as Js
from pressroll.sources import tables as T
from pressroll.streaming import days as Sd
from pressroll.streaming import events as Se
from pressroll.streaming import holds as Sh
from pressroll.streaming import ingest as Si

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    name = fn.__name__

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return fn(spark, sf_dir)

    run.__name__ = name
    run.__doc__ = fn.__doc__
    QUERIES[name] = run
    return run


def bi_cols(col: str, prefix: str | None = None):
    p = prefix or col
    return [F.col(col)["ko"].alias(f"{p}_ko"), F.col(col)["en"].alias(f"{p}_en")]


def index_out(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, "date", *bi_cols("dateLabel", "label"), *bi_cols("headline"),
                     F.col("storyCount").cast("long").alias("storyCount"),
                     F.col("moveCount").cast("long").alias("moveCount"),
                     F.array_join("tags", ",").alias("tags"))


def saved_index(spark, d) -> DataFrame:
    """The archive's stored index (derived from the day store once, then read
    as a table written to the shared folder)."""
    t = T.SAVED_THROUGH
    return materialize(I.index_entries(T.stories(spark, d, t), T.moves(spark, d, t), T.days(spark, d, t)), "saved-index")


def full_index(spark, d) -> DataFrame:
    """Index of every day of the store, stored once as a table."""
    return materialize(I.index_entries(T.stories(spark, d), T.moves(spark, d), T.days(spark, d)), "index")


# --- flagship ---------------------------------------------------------------------

@query
def incremental_index(spark, d):
    """Feed replay against the saved archive: parse dates, keep articles newer
    than the saved mark, group by date, derive flat index rows, upsert."""
    saved = saved_index(spark, d)
    fresh = A.incremental(T.articles(spark, d), saved)
    return index_out(I.upsert(saved, I.flat_entries(fresh)))


# --- dates and the feed -------------------------------------------------------------

@query
def parse_us_date(spark, d):
    a = T.articles(spark, d)
    return a.select("ordinal", "publishedRaw", D.parse_us_date(F.col("publishedRaw")).alias("date"))


@query
def high_water_mark(spark, d):
    return A.high_water_mark(full_index(spark, d))


@query
def newer_than(spark, d):
    a = A.with_date(T.articles(spark, d))
    return A.newer_flags(a, saved_index(spark, d)).select("ordinal", "date", "is_newer")


@query
def incremental_articles(spark, d):
    return A.incremental(T.articles(spark, d), saved_index(spark, d)).select(
        "ordinal", "title", "url", "date")


@query
def group_by_date(spark, d):
    dated = A.with_date(T.articles(spark, d)).where(F.col("date").isNotNull())
    return A.group_by_date(dated.select("ordinal", "title", "date")).select(
        "date", "first_ordinal", "pos", "ordinal", "title")


@query
def date_label(spark, d):
    days = T.days(spark, d)
    return days.select("date", *bi_cols("dateLabel", "label"))


@query
def date_label_plain(spark, d):
    days = T.days(spark, d)
    return days.select("date", D.date_label_plain(F.col("date")).alias("l")).select("date", *bi_cols("l", "label"))


@query
def weekday_name(spark, d):
    days = T.days(spark, d)
    return days.select("date", D.weekday_index(F.col("date")).cast("long").alias("dow"),
                       D.weekday_name(F.col("date"), "en").alias("name_en"),
                       D.weekday_name(F.col("date"), "ko").alias("name_ko"))


# --- index ----------------------------------------------------------------------------

@query
def index_entry(spark, d):
    return index_out(full_index(spark, d))


# --- text functions -----------------------------------------------------------------

def _stripped_pages(spark, d):
    return T.read(spark, d, "pages").select("page_id", S.strip_html(F.col("html")).alias("text"))


@query
def strip_html(spark, d):
    p = _stripped_pages(spark, d)
    return p.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


@query
def truncate_text(spark, d):
    p = T.read(spark, d, "pages").select("page_id", "html", S.strip_html(F.col("html")).alias("text"))
    return p.select("page_id",
                    S.truncate(F.col("text"), S.LIST_PAGE_BUDGET).alias("list_text"),
                    S.truncate(F.col("text"), S.ARTICLE_BUDGET).alias("body_text"),
                    S.truncate(F.col("html"), S.ERROR_EXCERPT).alias("excerpt"))


def _bodies(spark, d):
    return A.article_bodies(T.feed_pages(spark, d), T.read(spark, d, "pages"))


@query
def article_bodies(spark, d):
    return _bodies(spark, d).select("ordinal", "date", "url", "text")


@query
def day_text(spark, d):
    return A.day_text(_bodies(spark, d)).select("date", "part", "n_rows", "text")


@query
def organize_prompt(spark, d):
    parts = A.day_text(_bodies(spark, d))
    return parts.select("date", "part", S.organize_prompt(F.col("date"), F.col("text")).alias("prompt"))


@query
def extract_prompt(spark, d):
    p = _stripped_pages(spark, d)
    return p.select("page_id", S.extract_prompt(F.col("text")).alias("prompt"))


@query
def base64_roundtrip(spark, d):
    docs = T.read(spark, d, "documents").select("doc_id", "text")
    enc = docs.select("doc_id", "text", S.b64encode(F.col("text")).alias("b64"))
    return enc.select("doc_id", "b64", (S.b64decode(F.col("b64")) == F.col("text")).alias("same"))


@query
def put_record(spark, d):
    docs = T.read(spark, d, "documents").select("doc_id", "text")
    i = F.col("doc_id")
    sha = F.when(i % 3 == 0, F.lit(None).cast("string")).when(i % 3 == 1, F.lit("")).otherwise(
        F.sha1(F.col("text")))
    body = S.put_record(F.col("text"), F.concat(F.lit("briefing "), i.cast("string")), sha)
    return docs.select("doc_id", body.alias("body")).select(
        "doc_id",
        F.get_json_object("body", "$.message").alias("message"),
        F.get_json_object("body", "$.content").alias("content"),
        F.get_json_object("body", "$.sha").alias("sha"),
        F.array_join(F.json_object_keys("body"), ",").alias("keys"))


@query
def parse_fenced_json(spark, d):
    p = Vd.parse_days(T.raw_days(spark, d))
    return p.select("doc_id", F.col("doc").isNotNull().alias("ok"),
                    F.col("raw").startswith("```").alias("fenced"),
                    F.col("parse_error").alias("error"))


@query
def concat_text_blocks(spark, d):
    """A response is one row with the array of its blocks, as the model returns it."""
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("turn", "type", "text"))),
                         lambda b: F.struct(b["type"].alias("type"), b["text"].alias("text")))
    answers = T.responses(spark, d).groupBy("conv_id").agg(blocks.alias("content"))
    return answers.select("conv_id", S.concat_text_blocks(F.col("content")).alias("text"))


TEXT_FIX = [("ment ", "ment\u00a0"), ("the", "THE"), ("ción", "cion"), (" und ", " & ")]


@query
def literal_replace(spark, d):
    docs = T.read(spark, d, "documents").select("doc_id", "text")
    out = S.literal_replace(F.col("text"), TEXT_FIX)
    return docs.select("doc_id", out.alias("text"), (out != F.col("text")).alias("changed"))


DAY_FIX = (('"status":"NEW"', '"status":"UPDATE"'), ('"en":"en"', '"en":" "'), ("해설", "설명"))


@query
def replace_validated(spark, d):
    """Literals replaced in raw day documents, each edited one judged again:
    what the edit breaks (and what was broken before) is refused."""
    out = R.replace_validated(T.raw_days(spark, d), "raw", DAY_FIX)
    return out.select("doc_id", "outcome", F.size("errors").cast("long").alias("n_errors"), F.sha2("raw", 256).alias("raw_sha256"))


@query
def delete_nested(spark, d):
    """Stories deleted inside whole day documents, and the index row of what is left."""
    bi = "struct<ko:string,en:string>"
    valid = Vd.valid_only(_parsed(spark, d))
    days = valid.select("doc_id", F.try_variant_get("doc", "$.stories", f"array<struct<title:{bi},tags:array<string>>>").alias("stories"),
                        F.try_variant_get("doc", "$.moves", f"array<struct<text:{bi}>>").alias("moves"))
    out = R.delete_validated(days, {"stories": ["title", "ko"], "moves": ["text", "ko"]}, "메모")
    tags = F.array_distinct(F.flatten(F.transform("stories", lambda s: s["tags"])))
    return out.select("doc_id", "outcome", F.col("n_deleted").cast("long").alias("n_deleted"), F.size("stories").cast("long").alias("storyCount"),
                      F.size("moves").cast("long").alias("moveCount"), F.array_join(tags, ",").alias("tags"))


# --- document rules ---------------------------------------------------------------------

def _parsed(spark, d):
    return Vd.parsed_only(T.raw_days(spark, d))


def _all_days(spark, d):
    return Vd.all_days(T.raw_days(spark, d))


@query
def is_nonempty(spark, d):
    p = _all_days(spark, d)
    doc = V.J(F.col("doc"))
    return p.select("doc_id",
                    V.is_nonempty(doc["date"]).alias("date_ok"),
                    V.is_nonempty(doc["headline"]["en"]).alias("headline_en_ok"),
                    V.is_string(doc["headline"]).alias("headline_is_text"))


@query
def is_bilingual(spark, d):
    p = _all_days(spark, d)
    doc = V.J(F.col("doc"))
    return p.select("doc_id",
                    V.is_bilingual(doc["headline"]).alias("headline_ok"),
                    V.is_bilingual(doc["dateLabel"]).alias("label_ok"))


@query
def is_bilingual_list(spark, d):
    p = _all_days(spark, d)
    first = V.J(F.col("doc"))["stories"].at(0)["facts"]
    return p.select("doc_id", V.is_bilingual_list(first).alias("facts_ok"))


@query
def validate_days(spark, d):
    return _day_report(Vd.checked_days(_all_days(spark, d)))


def _day_report(checked):
    return checked.select("doc_id", F.size("errors").cast("long").alias("n_errors"),
                          F.array_join("errors", " | ").alias("errors"))


@query
def quarantine_days(spark, d):
    """Days held back: those that do not parse or break a rule, with the errors."""
    _, held = Vd.split_valid(Vd.checked_days(_all_days(spark, d)))
    return _day_report(held)


@query
def validate_stories(spark, d):
    r = Vd.story_reports(_parsed(spark, d))
    return r.select("doc_id", F.col("story_pos").cast("long").alias("story_pos"),
                    F.array_join("errors", " | ").alias("errors"))


@query
def validate_rows(spark, d):
    r = Vd.row_reports(_parsed(spark, d))
    return r.select("doc_id", "kind", F.col("pos").cast("long").alias("pos"),
                    F.array_join("errors", " | ").alias("errors"))


@query
def valid_days(spark, d):
    valid = Vd.valid_only(_parsed(spark, d))
    return valid.select("doc_id", F.variant_get("doc", "$.date", "string").alias("date"))


# --- store integrity, upserts --------------------------------------------------------


def _store_and_index(spark, d):
    """The day-store summary and the stored index JSON, from one derivation."""
    full = full_index(spark, d)
    return full.select("date", "storyCount", "moveCount"), T.index_json(full)


@query
def integrity_check(spark, d):
    store, stored = _store_and_index(spark, d)
    return G.check(stored, store)


@query
def integrity_summary(spark, d):
    store, stored = _store_and_index(spark, d)
    return G.summary(G.check(stored, store), stored).select("rule", F.col("n").cast("long").alias("n"))


@query
def index_detail_join(spark, d):
    store, stored = _store_and_index(spark, d)
    e = G.parse_index(stored).where("has_date").select("date", F.col("storyCount").cast("long").alias("index_stories"))
    s = store.select("date", F.col("storyCount").alias("day_stories"), F.col("moveCount").alias("day_moves"))
    return G.index_detail_join(e, s)


@query
def orphan_days(spark, d):
    store, stored = _store_and_index(spark, d)
    return G.orphan_days(store.select("date"), G.parse_index(stored).where("has_date"))


@query
def dangling_index(spark, d):
    store, stored = _store_and_index(spark, d)
    return G.dangling_index(G.parse_index(stored).where("has_date").select("date"), store)


def _revised(index, mark: str = " (rev)"):
    """Every index row with its headline marked, as an update carries it."""
    h = F.col("headline")
    return index.withColumn("headline", F.struct(F.concat(h["ko"], F.lit(mark)).alias("ko"), F.concat(h["en"], F.lit(mark)).alias("en")))


def _saved_and_updates(spark, d):
    """The archive saved up to a day, and an update of every day of the store."""
    full = full_index(spark, d)
    return full.where(F.col("date") <= T.SAVED_THROUGH), _revised(full)


@query
def index_upsert(spark, d):
    return index_out(I.upsert(*_saved_and_updates(spark, d)))


@query
def index_insert_absent(spark, d):
    return index_out(I.insert_absent(*_saved_and_updates(spark, d)))


@query
def index_replace(spark, d):
    result, missing = I.replace_existing(*_saved_and_updates(spark, d))
    return (index_out(result).withColumn("outcome", F.lit("index"))
            .unionByName(index_out(missing).withColumn("outcome", F.lit("missing"))))


def index_fields():
    return [F.col("date"), F.col("dateLabel.ko"), F.col("dateLabel.en"), F.col("headline.ko"),
            F.col("headline.en"), F.col("storyCount"), F.col("moveCount"), F.array_join("tags", ",")]


@query
def versioned_upsert(spark, d):
    """Every day updated by one writer, every third by a second one as well:
    one of two holders of a valid token wins, stale tokens are rejected."""
    saved, first = _saved_and_updates(spark, d)
    tokens = saved.select("date", I.row_hash(index_fields()).alias("_tok"))
    e = T.epoch_day(F.col("date"))
    second = _revised(full_index(spark, d), " (rev 2)").where(e % 3 == 0)
    upd = (first.unionByName(second).join(tokens, "date", "left")
           .withColumn("base_sha", F.when(F.col("_tok").isNull(), F.lit(None).cast("string"))
                                    .when(e % 2 == 0, F.col("_tok")).otherwise(F.lit("stale")))
           .drop("_tok"))
    result, accepted, rejected = I.versioned_upsert(saved, upd, index_fields(), priority=[F.col("headline.en")])
    return (index_out(result).withColumn("outcome", F.lit("index"))
            .unionByName(index_out(rejected.drop("base_sha")).withColumn("outcome", F.lit("rejected"))))


# --- archive queries -------------------------------------------------------------------

def _story_keys(df):
    return df.select("date", *[F.col(f"story_ord.{c}").alias(c)
                               for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])


@query
def archive_by_tags(spark, d):
    return I.by_tags(T.archive(spark, d), ["DE", "SRC3"]).select("doc_id", "date")


@query
def archive_by_all_tags(spark, d):
    return I.by_tags(T.archive(spark, d), ["EN", "SRC1"], mode="all").select("doc_id", "date")


@query
def archive_search(spark, d):
    return I.search(T.archive(spark, d), "Ment").select("doc_id", "date")


SEARCHES = ("Ment", "EN", "ünd", "the ", "SRC1", "no such text", "ción", "e", "\n", "zzz")


@query
def archive_search_indexed(spark, d):
    """Searches by postings of trigrams: keywords of any case, short, frequent, rare and absent."""
    archive = T.archive(spark, d)
    found = P.build(archive, P.haystack(), work_dir(spark, "postings"))
    return found.search_each(archive, P.haystack(), SEARCHES).select("keyword", "doc_id", "date")


def _selected(spark, d):
    """Any and all of every pair of a language and a source tag that occur
    together, of a language tag with itself and with an unknown tag."""
    archive = T.archive(spark, d)
    together = archive.select(F.col("tags")[0].alias("a"), F.col("tags")[1].alias("b")).distinct()
    own = together.select("a", F.explode(F.array("a", F.lit("NONE"))).alias("b")).distinct()
    named = together.unionByName(own)
    modes = named.select("a", "b", F.explode(F.array(F.lit("any"), F.lit("all"))).alias("mode"))
    selections = modes.select(F.concat_ws(" ", "mode", "a", "b").alias("selection"), "mode", F.array("a", "b").alias("tags"))
    return Bm.select_each(Bm.tag_bitmaps(archive), selections)


@query
def archive_tags_bitmap(spark, d):
    """All selections' entries in one pass over the bitmaps of their tags."""
    return Bm.ids(_selected(spark, d))


@query
def archive_tag_counts(spark, d):
    """How many entries each selection has, counted on the bitmaps."""
    return Bm.counts(_selected(spark, d))


@query
def usage_sketches(spark, d):
    """Users per week and month from stored daily sketches, beside the exact count."""
    events = T.interactions(spark, d)
    days = materialize(Sk.daily(events), "usage-sketches")
    spans = {"week": F.date_trunc("week", F.col("day")), "month": F.date_trunc("month", F.col("day"))}
    out = None
    for kind, span in spans.items():
        exact = events.groupBy(F.date_trunc(kind, F.to_date("ts")).alias("span"), "name").agg(F.count_distinct("user").alias("n_users"))
        part = Sk.measured(Sk.merged(days, span), exact).select(
            F.lit(kind).alias("kind"), F.date_format("span", "yyyy-MM-dd").alias("start"), "name", "n_events", "n_users", "in_bound")
        out = part if out is None else out.unionByName(part)
    return out


@query
def archive_by_month(spark, d):
    return I.by_month(full_index(spark, d))


def _maintained(spark, d) -> Summaries:
    """Summaries after three changes: the archive saved so far; the days after it;
    the stories with FLAG_R taken out of every 15th and every 31st taken out whole."""
    s = Summaries(spark, work_dir(spark, "summaries"))
    s.create()
    stories, moves, days = (materialize(t, "store") for t in (T.stories(spark, d), T.moves(spark, d), T.days(spark, d)))
    later, dom = F.col("date") > T.SAVED_THROUGH, F.substring("date", 9, 2)
    left = ~dom.isin("15", "31") | ((dom == "15") & ~F.array_contains("tags", "FLAG_R"))
    for some, keep in ((~later, F.lit(True)), (later, F.lit(True)), (dom.isin("15", "31"), left)):
        rows = [t.where(some) for t in (stories, moves, days)]
        s.apply(rows[2].select("date"), rows[0].where(keep), *[t.where((dom != "31") | ~some if keep is left else F.lit(True)) for t in rows[1:]])
    return s


@query
def maintained_index(spark, d):
    """Index entries kept up to date change by change."""
    return index_out(_maintained(spark, d).entries.rows())


@query
def maintained_summaries(spark, d):
    """Month and tag summaries kept up to date by the same changes."""
    s = _maintained(spark, d)
    tags = s.tags.rows().select(F.lit("tag").alias("kind"), F.col("tag").alias("name"), F.lit(None).cast("long").alias("n_days"),
                                F.col("n").alias("n_stories"), F.lit(None).cast("string").alias("first_date"), F.lit(None).cast("string").alias("last_date"))
    return s.months.rows().select(F.lit("month").alias("kind"), F.col("month").alias("name"), "n_days", "n_stories", "first_date", "last_date").unionByName(tags)


@query
def tag_vocabulary(spark, d):
    return I.tag_vocabulary(T.stories(spark, d)).select("tag", F.col("n").cast("long").alias("n"))


@query
def stories_by_tag(spark, d):
    return _story_keys(I.stories_by_tag(T.stories(spark, d), "FLAG_R"))


@query
def stories_by_tag_substring(spark, d):
    return _story_keys(I.stories_by_tag(T.stories(spark, d), "K,FLAG_R", mode="substring"))


@query
def day_lookup(spark, d):
    """The date is bounded on the source column too, so it reaches the scan."""
    day = "1997-05-28"
    return _story_keys(I.day_lookup(T.stories(spark, d, day=day), day))


@query
def day_lookup_store(spark, d):
    """One date out of the date-partitioned store: only its folder is read."""
    root = work_dir(spark, "stories")
    Fs.write_days(T.stories(spark, d), root)
    return _story_keys(I.day_lookup(Fs.read_days(spark, root), "1997-05-28"))


@query
def linked_stories(spark, d):
    return (I.linked(T.stories(spark, d)).groupBy("date")
             .agg(F.count(F.lit(1)).cast("long").alias("n_linked")))


@query
def first_seen(spark, d):
    f = I.first_seen_tags(I.tag_lists(T.stories(spark, d), "ordinal"))
    return f.select("date", "tag", F.floor(F.col("first.order") / 8).cast("long").alias("l_orderkey"),
                    (F.col("first.order") % 8).cast("long").alias("l_linenumber"),
                    F.col("first.tag_pos").cast("long").alias("tag_pos"))


@query
def delete_stories(spark, d):
    st = R.delete_matching(T.stories(spark, d), F.col("title.ko"), "부품 1")
    mv = R.delete_matching(T.moves(spark, d), F.col("text.ko"), "주문 2")
    edited = I.index_entries(st, mv, T.days(spark, d))
    checked = R.refuse_emptied(full_index(spark, d), edited)
    return index_out(checked, "outcome")


# --- schedule ------------------------------------------------------------------------


@query
def scan_games(spark, d):
    g = T.games(spark, d)
    return g.select("team", "pos", "phase", "week", "opponent", "home", "dateKST", "etLabel", "bcast",
                    F.col("final.ko").alias("final_ko"), F.col("final.en").alias("final_en"),
                    "rivalry", "bye", "tbd")


@query
def convert_kickoff(spark, d):
    g = T.games(spark, d)
    return g.select("team", "pos", "dateKST")


@query
def format_wall_clock(spark, d):
    g = T.games(spark, d)
    return g.select("team", "pos", D.format_wall_clock(F.col("dateKST"), "ko").alias("ko"),
                    D.format_wall_clock(F.col("dateKST"), "en").alias("en"))


@query
def pick_language(spark, d):
    g = T.games(spark, d)
    return g.select("team", "pos", Sc.pick(F.col("final"), "ko").alias("ko"), Sc.pick(F.col("final"), "en").alias("en"))


@query
def schedule_team(spark, d):
    return Sc.team_view(T.games(spark, d), "GB", "en")


@query
def schedule_team_ko(spark, d):
    return Sc.team_view(T.games(spark, d), "MIN", "ko")


@query
def schedule_union(spark, d):
    return Sc.union_view(T.games(spark, d), "en")


@query
def schedule_union_ko(spark, d):
    return Sc.union_view(T.games(spark, d), "ko")


@query
def schedule_union_ordered(spark, d):
    """Merged view with each row's display position (the sort and merge)."""
    return Sc.ordered_union(T.games(spark, d), "en")


@query
def matchup_check(spark, d):
    return Sc.matchup_check(T.games(spark, d), ("phase", "week", "dateKST", "pos"))


# --- interaction events ---------------------------------------------------------------


# the driver's events are minutes apart; debounce gap and hold delay scale with them
SEARCH_GAP = "30 minutes"
HOLD_DELAY = "10 minutes"


@query
def event_usage(spark, d):
    u = Ev.usage(T.interactions(spark, d))
    return u.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "name",
                    F.col("n_events").cast("long").alias("n_events"), F.col("n_users").cast("long").alias("n_users"))


@query
def event_contract(spark, d):
    return Ev.contract_violations(T.interactions(spark, d))


@query
def debounce_search(spark, d):
    ev = T.interactions(spark, d).where(F.col("name") == "archive_search")
    out = Ev.debounce(ev, SEARCH_GAP)
    return out.select("user", "seq", "chars", F.date_format("fire_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("fire_ts"))


@query
def hold_detect(spark, d):
    out = Ev.hold(T.interactions(spark, d), HOLD_DELAY)
    return out.select("user", "seq", "kind", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


# --- sources and sinks ------------------------------------------------------------------


@query
def scan_day_documents(spark, d):
    """Raw day documents stored by date, scanned back, parsed and validated."""
    root = work_dir(spark, "raw")
    Fs.write_raw_days(T.raw_days(spark, d), root)
    p = Vd.with_errors(Vd.parse_days(Fs.scan_raw_days(spark, root)))
    return p.select("doc_id", "date", F.col("doc").isNotNull().alias("ok"),
                    F.when(F.col("doc").isNotNull(), F.size("errors")).cast("long").alias("n_errors"))


@query
def write_days(spark, d):
    """Day store written by date, then the first-of-month days rewritten after
    an edit: only those partitions change. A day the edit leaves without any
    story is not rewritten (an empty day is invalid), so it keeps its rows."""
    root = work_dir(spark, "stories")
    Fs.write_days(T.stories(spark, d), root)
    edited = R.delete_matching(T.stories(spark, d), F.col("title.ko"), "부품 1")
    Fs.write_days(edited.where(F.substring("date", 9, 2) == "01"), root)
    back = Fs.read_days(spark, root)
    return back.groupBy("date").agg(F.count(F.lit(1)).cast("long").alias("n_stories"))


@query
def list_day_files(spark, d):
    root = work_dir(spark, "stories")
    Fs.write_days(T.stories(spark, d).select("date", "story_ord"), root)
    return Fs.list_day_files(spark, root)


@query
def index_roundtrip(spark, d):
    """Index written as JSON lines (newest first) and scanned back."""
    root = work_dir(spark, "index")
    Fs.write_index(full_index(spark, d), root)
    return index_out(Fs.scan_index(spark, root))


@query
def index_array_roundtrip(spark, d):
    """Index written as JSON array files and scanned back."""
    root = work_dir(spark, "index-array")
    Fs.write_index_array(full_index(spark, d), root)
    return index_out(Fs.scan_index_array(spark, root))


def _json_store(spark, d) -> str:
    """The flat folder of day files, its index in a folder beside them."""
    root = work_dir(spark, "json-store")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    Js.write(T.store_files(spark, d).repartition(n, "stem"), root)
    Fs.write_entries_array(T.store_index(spark, d), f"{root}/index")
    return root


@query
def scan_json_store(spark, d):
    """Day files written one by one into a flat folder and scanned back."""
    files = Js.scan(spark, _json_store(spark, d))
    doc = F.try_parse_json("text")
    return files.select("file", "stem", "size", doc.isNotNull().alias("parses"),
                        F.try_variant_get(doc, "$.dateLabel.en", "string").alias("label_en"), "error")


@query
def list_json_store(spark, d):
    """Names and sizes of the same folder, no file opened."""
    return Js.listing(spark, _json_store(spark, d))


@query
def integrity_report(spark, d):
    """One report of all faults of that folder and its index."""
    root = _json_store(spark, d)
    return G.report(Fs.scan_index_raw(spark, f"{root}/index"), Js.scan(spark, root))


@query
def scan_season(spark, d):
    """Games written as season documents (a season per customer) and read back."""
    root = work_dir(spark, "season")
    docs = Fs.season_documents(T.games(spark, d))
    Fs.write_season(docs, root)
    g = Fs.scan_season(spark, root, schema=docs.schema)
    return g.select("team", "season", F.col("i").cast("long").alias("i"), "phase", "week", "opponent", "home",
                    "dateKST", "bcast", F.col("final.en").alias("final_en"), "rivalry", "bye", "tbd")


@query
def commit_log(spark, d):
    """Daily totals after two writers' interleaved commits: no order is lost."""
    return replay(T.read(spark, d, "orders"), work_dir(spark, "totals"))[0].rows()


@query
def commit_history(spark, d):
    """The commits of the same replay: version, attempts, and whether it was moved up."""
    return replay(T.read(spark, d, "orders"), work_dir(spark, "totals"))[1]


# --- model step and ingest job -----------------------------------------------------------


def _prompts(spark, d):
    parts = A.day_text(_bodies(spark, d))
    return parts.select("date", "part", S.organize_prompt(F.col("date"), F.col("text")).alias("prompt"))


@query
def apply_model(spark, d):
    """Organise prompts of the pages feed through the (stub) model."""
    # the cost of a call has nothing to do with its bytes: one share of the prompts per task
    spread = _prompts(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "date", "part")
    out = materialize(_apply_model(spread, "prompt", organize_stub), "model-out")
    return out.select("date", "part", F.length("response").cast("long").alias("response_chars"), "model_error")


@query
def model_resumed(spark, d):
    """The same prompts in two runs over one store of answers: the first run has
    the even days only, the second one asks what is still missing."""
    store = work_dir(spark, "answers")
    prompts = materialize(_prompts(spark, d), "prompts")
    even = F.substring("date", 10, 1).cast("int") % 2 == 0
    materialize(answered(prompts.where(even), "prompt", organize_stub, store), "model-first")
    out = answered(prompts, "prompt", organize_stub, store)
    return out.select("date", "part", F.length("response").cast("long").alias("response_chars"), "model_error",
                      F.col("attempt").cast("long").alias("attempt"))


def _run_ingest(spark, d):
    return _ingest(T.feed_pages(spark, d), T.read(spark, d, "pages"), saved_index(spark, d), organize_stub,
                   store=work_dir(spark, "days"))


@query
def run_report(spark, d):
    return _run_ingest(spark, d).report


@query
def ingest_errors(spark, d):
    """The messages of the report, one row each."""
    return _run_ingest(spark, d).errors


def _story_columns(s):
    return s.select("date", "ordinal", "icon", "status", F.array_join("tags", ",").alias("tags"), F.col("title.en").alias("title_en"),
                    F.array_join("facts.en", ",").alias("facts_en"), F.col("interp.ko").alias("interp_ko"), "url")


@query
def ingest_days(spark, d):
    """The stories of the added days as read back from the day store."""
    return _story_columns(_run_ingest(spark, d).stories)


@query
def ingest_index(spark, d):
    return index_out(_run_ingest(spark, d).index)


# --- streaming forms --------------------------------------------------------------------


def _run_to_table(stream_df, out_dir, ckpt):
    """Append mode, a folder per epoch: a replayed batch overwrites its own."""
    def write(batch, epoch_id):
        batch.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch_id}")

    q = (stream_df.writeStream.outputMode("append").foreachBatch(write)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()


def _event_stream(spark, d):
    """The events table as a file stream, and a closing event ten days after its
    last one (an empty search box, a cancel without a press)."""
    events = T.read(spark, d, "events")
    end = events.agg(F.max("ts").alias("ts"))
    values = {"event_id": F.lit(1), "event_type": F.lit("click"), "value": F.lit(0), "ts": F.col("ts") + F.expr("INTERVAL 10 DAYS")}
    closing = end.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields])
    root = work_dir(spark, "closing")
    closing.write.parquet(root)
    reader = spark.readStream.schema(events.schema)
    if Fs.is_file(spark, f"{d.rstrip('/')}/events.parquet"):
        stream = reader.option("pathGlobFilter", "events.parquet").parquet(d)
    else:
        stream = reader.parquet(f"{d.rstrip('/')}/events.parquet")
    return T.interactions_from(stream.union(spark.readStream.schema(events.schema).parquet(root)))


@query
def stream_ingest(spark, d):
    """The flagship as a stream: article files -> foreachBatch upserts of
    versioned index folders; the last version is the result."""
    src, root, ckpt = work_dir(spark, "articles-src"), work_dir(spark, "index"), work_dir(spark, "ckpt")
    T.articles(spark, d).write.parquet(src)
    Si.seed_index(saved_index(spark, d), root)
    q = Si.start(spark, src, spark.read.parquet(src).schema, root, ckpt)
    q.awaitTermination()
    return index_out(Si.read_index_version(spark, root))


def _run_days_stream(spark, d) -> Sd.Folders:
    """The pages feed as article files that arrive two at a time; dates close
    when the feed does, since its articles come in no order of dates."""
    folders, src = Sd.Folders(work_dir(spark, "feed")), work_dir(spark, "feed-src")
    feed = T.feed_pages(spark, d).drop("date")
    feed.repartition(6, "ordinal").write.parquet(src)
    Sd.seed_index(saved_index(spark, d), folders)
    reader = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 2)
    Sd.start_arrivals(reader.parquet(src), folders).awaitTermination()
    Sd.close_feed(spark, folders)
    schema = "ordinal long, title string, url string, publishedRaw string, date string"
    Sd.start_closing(spark, T.read(spark, d, "pages"), folders, organize_stub, schema, lateness="31 days", max_files=1).awaitTermination()
    return folders


@query
def stream_ingest_days(spark, d):
    """The whole ingest as a stream: the stories in the day store at its end."""
    folders = _run_days_stream(spark, d)
    return _story_columns(Sd.stored_stories(spark, folders))


@query
def stream_ingest_index(spark, d):
    """The index versions' last state after the same stream."""
    return index_out(Sd.index_table(spark, _run_days_stream(spark, d)).rows())


@query
def stream_debounce(spark, d):
    out, ckpt = work_dir(spark, "debounce"), work_dir(spark, "ckpt")
    ev = _event_stream(spark, d).where(F.col("name") == "archive_search")
    _run_to_table(Se.debounce_stream(ev, SEARCH_GAP), out, ckpt)
    return spark.read.parquet(out).select(
        "user", "seq", "chars", F.date_format("fire_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("fire_ts"))


@query
def stream_usage(spark, d):
    out, ckpt = work_dir(spark, "usage"), work_dir(spark, "ckpt")
    _run_to_table(Se.usage_stream(_event_stream(spark, d)), out, ckpt)
    return spark.read.parquet(out).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "name",
        F.col("n_events").cast("long").alias("n_events"), F.col("n_users").cast("long").alias("n_users"))


@query
def stream_hold(spark, d):
    """Hold detection as a stream over time slices, a user's slices spread over
    the tasks; the closing event and slice let the last slices and timers pass."""
    folder = work_dir(spark, "hold")
    Sh.start_slices(_event_stream(spark, d), folder, HOLD_DELAY, width="6 hours").awaitTermination()
    Sh.close_feed(spark, folder)
    Sh.start_edges(spark, folder, HOLD_DELAY).awaitTermination()
    return Sh.detected(spark, folder).select("user", "seq", "kind", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


@query
def detail_checks(spark, d):
    """Stored day documents checked against the file (date partition) they sit in."""
    root = work_dir(spark, "raw")
    Fs.write_raw_days(T.raw_days(spark, d), root)
    return G.detail_checks(Vd.parse_days(Fs.scan_raw_days(spark, root)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
