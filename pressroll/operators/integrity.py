"""Referential integrity between the summary index and the day store.

Index rows arrive as raw JSON (key presence matters); the day store side is
the per-date summary of the flat story / move tables. Every rule yields rows
``(rule, date, detail)``; an empty result is a clean store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroll.functions import documents as V

RULES = ("missing_key", "missing_detail", "story_count", "move_count", "orphan",
         "detail_parse", "detail_missing_key", "detail_date")


def truthy(j: V.J) -> Column:
    """JavaScript truthiness of a JSON value (absent / null / '' / 0 / false are falsy)."""
    t = V.vtype(j)
    return F.coalesce(
        F.when(t == "STRING", F.length(j.text()) > 0)
         .when(t == "BOOLEAN", F.variant_get(j.base, j.path, "boolean"))
         .when(t.isin("VOID"), F.lit(False))
         .when(t.startswith("OBJECT") | t.startswith("ARRAY"), F.lit(True))
         .otherwise(F.try_variant_get(j.base, j.path, "double") != 0),
        F.lit(False))


def parse_index(index_json: DataFrame, col: str = "entry") -> DataFrame:
    """Index entries as (entry variant, date text, counts when numeric)."""
    e = index_json.select(F.parse_json(F.col(col)).alias("e"))
    j = V.J(F.col("e"))
    return e.select(
        "e",
        j["date"].text().alias("date"),
        truthy(j["date"]).alias("has_date"),
        F.when(V.is_number(j["storyCount"]), F.variant_get("e", "$.storyCount", "double")).alias("storyCount"),
        F.when(V.is_number(j["moveCount"]), F.variant_get("e", "$.moveCount", "double")).alias("moveCount"),
    )


def check(index_json: DataFrame, store: DataFrame) -> DataFrame:
    """All integrity findings of an index against a day-store summary
    ``store(date, storyCount, moveCount)``."""
    entries = parse_index(index_json)
    missing_key = entries.select(
        F.lit("missing_key").alias("rule"), "date",
        F.explode(V.missing_keys(F.col("e"), V.INDEX_KEYS)).alias("detail"))
    referenced = entries.where("has_date")
    s = store.select("date", F.col("storyCount").alias("s_story"), F.col("moveCount").alias("s_move"),
                     F.lit(True).alias("_found"))
    joined = referenced.join(s, "date", "left")
    missing_detail = joined.where(F.col("_found").isNull()).select(
        F.lit("missing_detail").alias("rule"), "date", F.lit("").alias("detail"))

    def count_rule(name: str, mine: str, theirs: str) -> DataFrame:
        bad = F.col("_found") & F.col(mine).isNotNull() & (F.col(mine) != F.col(theirs))
        return joined.where(bad).select(
            F.lit(name).alias("rule"), "date",
            F.concat(F.lit("index "), F.col(mine).cast("long").cast("string"),
                     F.lit(" vs day "), F.col(theirs).cast("string")).alias("detail"))

    orphans = (store.select("date").join(referenced.select("date"), "date", "left_anti")
                    .select(F.lit("orphan").alias("rule"), "date", F.lit("").alias("detail")))
    return (missing_key.unionByName(missing_detail)
                       .unionByName(count_rule("story_count", "storyCount", "s_story"))
                       .unionByName(count_rule("move_count", "moveCount", "s_move"))
                       .unionByName(orphans))


def summary(findings: DataFrame, index_json: DataFrame) -> DataFrame:
    """Problems per rule, the total, and the number of briefings (index rows)."""
    per_rule = findings.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    total = findings.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("rule"), "n")
    briefings = index_json.agg(F.count(F.lit(1)).alias("n")).select(F.lit("briefings").alias("rule"), "n")
    return per_rule.unionByName(total).unionByName(briefings)


def index_detail_join(index: DataFrame, store: DataFrame) -> DataFrame:
    """Each index row with its day (left outer): day columns NULL when missing."""
    return index.join(store, "date", "left")


def orphan_days(store: DataFrame, index: DataFrame) -> DataFrame:
    """Days no index row points at."""
    return store.join(index.select("date"), "date", "left_anti")


def dangling_index(index: DataFrame, store: DataFrame) -> DataFrame:
    """Index rows without a day."""
    return index.join(store.select("date"), "date", "left_anti")


def detail_checks(parsed_days: DataFrame, file_date: str = "date") -> DataFrame:
    """Rules on the stored day documents themselves: the document does not
    parse, lacks one of the seven day keys, or names another date than the
    file it is stored under (``file_date``, the partition value). A document
    holding JSON null passes silently, as it did before."""
    d = V.J(F.col("doc"))
    parse = parsed_days.where(F.col("doc").isNull()).select(
        F.lit("detail_parse").alias("rule"), F.col(file_date).alias("date"), F.lit("").alias("detail"))
    present = parsed_days.where(F.col("doc").isNotNull() & (V.vtype(d) != "VOID"))
    missing = present.select(F.lit("detail_missing_key").alias("rule"), F.col(file_date).alias("date"),
                             F.explode(V.missing_keys(F.col("doc"), V.DAY_KEYS)).alias("detail"))
    doc_date = d["date"]
    differs = truthy(doc_date) & F.coalesce(doc_date.text() != F.col(file_date), F.lit(True))
    date_rule = present.where(differs).select(F.lit("detail_date").alias("rule"), F.col(file_date).alias("date"),
                                              F.lit("").alias("detail"))
    return parse.unionByName(missing).unionByName(date_rule)


# --- one report over index, documents and file names -------------------------------

#: Rules in the order the checker tells them; (a), an index that cannot be read, stops the job.
REPORT_RULES = {"missing_key": "b", "missing_detail": "c", "unreadable": "c", "detail_parse": "d", "detail_missing_key": "e",
                "detail_date": "f", "story_count": "g", "move_count": "h", "orphan": "i"}


def _entry_facts(entries: DataFrame) -> DataFrame:
    """What the rules need of raw entries (``e``, a variant); equal entries are
    one row with their number, so that a date listed often is a few rows."""
    j = V.J(F.col("e"))

    def number(name: str) -> Column:
        return F.when(V.is_number(j[name]), F.variant_get("e", f"$.{name}", "double"))

    facts = entries.select(
        F.when(truthy(j["date"]), j["date"].text()).alias("date"), j["date"].text().alias("shown"),
        V.missing_keys(F.col("e"), V.INDEX_KEYS).alias("entry_lacks"), number("storyCount").alias("storyCount"),
        number("moveCount").alias("moveCount"))
    return facts.groupBy(*facts.columns).agg(F.count(F.lit(1)).alias("n"))


def _document_facts(files: DataFrame) -> DataFrame:
    """What the rules need of documents (``stem``, ``text``, ``error``): a row per file, without the text."""
    parsed = files.select("stem", "error", F.try_parse_json("text").alias("doc"))
    d = V.J(F.col("doc"))

    def length(name: str) -> Column:
        return F.size(F.try_variant_get("doc", f"$.{name}", "array<variant>"))

    judged = F.col("doc").isNotNull() & (V.vtype(d) != "VOID")  # JSON null passes, as it always did
    return parsed.select(
        "stem", "error", (F.col("error").isNull() & F.col("doc").isNull()).alias("unparsed"),
        F.when(judged, V.missing_keys(F.col("doc"), V.DAY_KEYS)).alias("lacks"),
        F.when(judged & truthy(d["date"]), F.when(V.is_string(d["date"]), d["date"].text()).otherwise(F.lit(""))).alias("inside"),
        F.when(judged & V.is_array(d["stories"]), length("stories")).alias("n_stories"),
        F.when(judged & V.is_array(d["moves"]), length("moves")).alias("n_moves"))


def report(entries: DataFrame, files: DataFrame) -> DataFrame:
    """All faults of a store in one pass: raw index entries (``e``) joined in
    full with the documents (``stem``, ``text``, ``error``).

    Returns (rule, date, detail, n): ``n`` index entries (or the one file, for
    orphans) have the fault. An entry without a date is judged by its keys
    alone; a document no entry refers to is an orphan and not judged.
    """
    both = _entry_facts(entries).join(_document_facts(files), F.col("date") == F.col("stem"), "full")
    is_entry, refers, there = F.col("n").isNotNull(), F.col("date").isNotNull(), F.col("stem").isNotNull()

    def fault(rule: str, when: Column, detail: Column = F.lit("")) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.array(F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))))

    def each(rule: str, when: Column, details: str) -> Column:
        return F.when(F.coalesce(when, F.lit(False)),
                      F.transform(details, lambda k: F.struct(F.lit(rule).alias("rule"), k.alias("detail"))))

    def counts(mine: str, theirs: str) -> Column:
        return F.concat(F.lit("index "), F.col(mine).cast("long").cast("string"), F.lit(" vs day "), F.col(theirs).cast("string"))

    none = F.array().cast("array<struct<rule:string,detail:string>>")
    joined = refers & there
    faults = [
        each("missing_key", is_entry, "entry_lacks"),
        fault("missing_detail", refers & ~there),
        fault("unreadable", joined & F.col("error").isNotNull()),
        fault("detail_parse", joined & F.col("unparsed")),
        each("detail_missing_key", joined & F.col("lacks").isNotNull(), "lacks"),
        fault("detail_date", joined & (F.col("inside") != F.col("date")), F.col("inside")),
        fault("story_count", joined & (F.col("storyCount") != F.col("n_stories")), counts("storyCount", "n_stories")),
        fault("move_count", joined & (F.col("moveCount") != F.col("n_moves")), counts("moveCount", "n_moves")),
        fault("orphan", ~is_entry),
    ]
    found = both.select(F.coalesce("shown", "stem").alias("date"), F.coalesce("n", F.lit(1)).alias("n"),
                        F.explode(F.flatten(F.array(*[F.coalesce(f, none) for f in faults]))).alias("f"))
    return found.groupBy("f.rule", "date", "f.detail").agg(F.sum("n").alias("n"))
