"""Adapters: the driver's parquet tables seen as this domain's tables.

Each adapter is a deterministic projection/join of the given tables (so its
work grows with them); ``plans/oracle.py`` restates every mapping in SQL.

| adapter         | from                 | rows                                   |
|-----------------|----------------------|----------------------------------------|
| articles        | orders               | one list row per order                 |
| stories         | lineitem x orders    | one story per line item, date = order day |
| moves           | orders (status F)    | one roster move per finished order     |
| days            | orders               | one day header per order date          |
| feed_pages      | pages                | article rows pointing at pages (every 9th link of every fourth day broken) |
| raw_days        | documents            | one JSON day document per document, with planned defects |
| archive         | documents            | one archive entry per document         |
| games           | orders x customer    | season schedule rows of two teams      |
| interactions    | events               | interaction events (user, seq, ts, name, data) |
| responses       | conversations        | model response blocks                  |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroll.functions.dates import MONTH_ABBR, date_label, iso_date

FULL_MONTHS = ["January", "February", "March", "April", "May", "June", "July",
               "August", "September", "October", "November", "December"]

# Archive already published up to this day when the feed is replayed.
SAVED_THROUGH = "1998-12-31"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c) -> Column:
    return (c if isinstance(c, Column) else F.col(c)).cast("string")


# --- articles ----------------------------------------------------------------

def published_raw(key: Column, ts: Column) -> Column:
    """Four printed spellings of the order day, and a non-date every 50th key."""
    mo = F.month(ts)
    day = _s(F.dayofmonth(ts))
    year = _s(F.year(ts))
    full = F.element_at(F.array(*[F.lit(m) for m in FULL_MONTHS]), mo)
    abbr = F.element_at(F.array(*[F.lit(m) for m in MONTH_ABBR]), mo)
    abbr_or_sept = F.when(mo == 9, F.lit("Sept")).otherwise(abbr)
    return (F.when(key % 50 == 0, F.concat(F.lit("Updated "), year))
             .when(key % 4 == 0, F.concat(full, F.lit(" "), day, F.lit(", "), year))
             .when(key % 4 == 1, F.concat(abbr, F.lit(" "), day, F.lit(", "), year))
             .when(key % 4 == 2, F.concat(abbr_or_sept, F.lit(". "), F.lpad(day, 2, "0"), F.lit(" "), year))
             .otherwise(F.concat(F.lit("\u00a0 "), F.lower(full), F.lit(" "), day, F.lit(","), year, F.lit("\n"))))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("ordinal"),
        F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("/o/"), _s(k)).alias("url"),
        published_raw(k, F.col("o_orderdate")).alias("publishedRaw"),
    )


# --- day store (flat, one row per story / move / day) ------------------------

def _orders_until(spark, sf_dir, through: str | None):
    o = read(spark, sf_dir, "orders")
    if through is not None:
        # on the source column, so the bound reaches the parquet scan
        o = o.where(F.col("o_orderdate") < F.date_add(F.to_date(F.lit(through)), 1))
    return o


def stories(spark: SparkSession, sf_dir: str, through: str | None = None, day: str | None = None) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag",
        "l_linestatus", "l_shipdate")
    o = _orders_until(spark, sf_dir, through).select("o_orderkey", "o_orderdate")
    if day is not None:
        o = o.where((F.col("o_orderdate") >= F.to_date(F.lit(day))) & (F.col("o_orderdate") < F.date_add(F.to_date(F.lit(day)), 1)))
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    # (order, line) repeats in the driver table; the full tuple orders stories
    ordv = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    spin = F.col("l_orderkey") + F.col("l_linenumber") + F.col("l_partkey")
    qty = _s(F.col("l_quantity").cast("long"))
    size = (F.when(F.col("l_quantity") >= 40, F.lit("BULK"))
             .when(F.col("l_quantity") >= 10, F.lit("CASE")).otherwise(F.lit("UNIT")))
    return j.select(
        iso_date(F.col("o_orderdate")).alias("date"),
        ordv.alias("story_ord"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("ordinal"),
        F.when(F.col("l_returnflag") == "R", F.lit("↩️"))
         .when(F.col("l_returnflag") == "A", F.lit("✅")).otherwise(F.lit("📦")).alias("icon"),
        F.when(F.col("l_linestatus") == "O", F.lit("NEW")).otherwise(F.lit("CONFIRMED")).alias("status"),
        F.array(size, F.concat(F.lit("FLAG_"), F.col("l_returnflag")),
                F.concat(F.lit("LINE_"), F.col("l_linestatus"))).alias("tags"),
        F.struct(F.concat(F.lit("부품 "), _s("l_partkey")).alias("ko"),
                 F.concat(F.lit("Part "), _s("l_partkey")).alias("en")).alias("title"),
        F.struct(F.array(F.concat(F.lit("수량 "), qty)).alias("ko"),
                 F.array(F.concat(F.lit("Quantity "), qty)).alias("en")).alias("facts"),
        F.struct(F.concat(F.lit("주문 "), _s("l_orderkey"), F.lit("의 품목")).alias("ko"),
                 F.concat(F.lit("Item of order "), _s("l_orderkey")).alias("en")).alias("interp"),
        F.when(spin % 8 == 0, F.lit(""))
         .when(spin % 4 == 0, F.concat(F.lit("/o/"), _s("l_orderkey"), F.lit("/"), _s("l_linenumber")))
         .alias("url"),
    )


def moves(spark: SparkSession, sf_dir: str, through: str | None = None) -> DataFrame:
    o = _orders_until(spark, sf_dir, through).where(F.col("o_orderstatus") == "F")
    k = _s("o_orderkey")
    return o.select(
        iso_date(F.col("o_orderdate")).alias("date"),
        F.col("o_orderkey").alias("move_ord"),
        F.date_format("o_orderdate", "MM-dd").alias("move_date"),
        F.struct(F.concat(F.lit("주문 "), k, F.lit(" 완료")).alias("ko"),
                 F.concat(F.lit("Order "), k, F.lit(" finished")).alias("en")).alias("text"),
    )


def days(spark: SparkSession, sf_dir: str, through: str | None = None) -> DataFrame:
    o = _orders_until(spark, sf_dir, through).select("o_orderkey", "o_orderdate")
    first = (o.groupBy(iso_date(F.col("o_orderdate")).alias("date"))
              .agg(F.min("o_orderkey").alias("first_key")))
    k = _s("first_key")
    return first.select(
        "date",
        date_label(F.col("date")).alias("dateLabel"),
        F.struct(F.concat(F.lit("주문 "), k, F.lit(" 외")).alias("ko"),
                 F.concat(F.lit("Order "), k, F.lit(" and more")).alias("en")).alias("headline"),
    )


# --- pages / feed --------------------------------------------------------------

def feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article rows whose links point at ``pages``; every 9th link of every
    fourth day is broken."""
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    pid = F.col("page_id")
    return p.select(
        pid.alias("ordinal"),
        F.concat(F.lit("Page "), _s(pid)).alias("title"),
        F.when((pid % 9 == 0) & (pid % 28 % 4 == 0), F.concat(F.col("url"), F.lit("#gone"))).otherwise(F.col("url")).alias("url"),
        F.concat(F.lit("2026-08-"), F.lpad(_s(pid % 28 + 1), 2, "0")).alias("date"),
        F.concat(F.lit("Aug "), _s(pid % 28 + 1), F.lit(", 2026")).alias("publishedRaw"),
    )


# --- raw day documents (JSON text with planned defects) ----------------------

def json_str(c: Column) -> Column:
    """A JSON string literal for a text column: the value of ``{"v": c}``,
    cut out by position (the wrapper is always ``{"v":`` ... ``}``)."""
    def cut(w):
        return F.substring(w, F.lit(6), F.length(w) - 6)
    return F.transform(F.array(F.to_json(F.struct(c.alias("v")))), cut)[0]


def _obj(*fields: tuple[str, Column | None]) -> Column:
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in fields if v is not None]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _bi(ko: Column, en: Column) -> Column:
    return _obj(("ko", ko), ("en", en))


def _lit(s: str) -> Column:
    import json
    return F.lit(json.dumps(s, ensure_ascii=False))


def _let(value: Column, fn) -> Column:
    return F.transform(F.array(value), fn)[0]


def raw_day_json(doc_id: Column, text: Column, lang: Column, source: Column) -> Column:
    """The day document JSON for one ``documents`` row (defects keyed by doc_id)."""
    i = doc_id
    lg, src = json_str(lang), json_str(source)
    date = F.concat(F.lit("2026-"), F.lpad(_s(i % 12 + 1), 2, "0"), F.lit("-"), F.lpad(_s(i % 28 + 1), 2, "0"))
    date_j = F.when(i % 19 == 6, F.concat(F.lit('"'), date, F.lit('\\n"'))).otherwise(
        F.concat(F.lit('"'), date, F.lit('"')))
    label = _bi(F.concat(F.lit('"'), date, F.lit(' (현지)"')), F.concat(F.lit('"'), date, F.lit('"')))
    facts_en = F.when(i % 11 == 3, F.concat(F.lit("["), lg, F.lit(',"extra"]'))).otherwise(
        F.concat(F.lit("["), lg, F.lit("]")))
    url = (F.when(i % 7 == 2, F.lit("null"))
            .when(i % 29 == 8, F.lit("12345"))
            .otherwise(F.concat(F.lit('"/d/'), _s(i), F.lit('"'))))
    story2 = (F.when(i % 43 == 12, F.lit('"oops"'))
               .when(i % 47 == 13, F.lit("[]"))
               .otherwise(F.lit('{"icon":"🏈","status":"RUMOR","tags":["NOTE"],'
                                '"title":{"ko":"메모","en":"Note"},"facts":{"ko":["가"],"en":["a"]},'
                                '"interp":{"ko":"나","en":"b"}}')))
    watch = F.when(i % 17 == 5, F.lit('"yes"')).otherwise(F.lit("true"))
    injuries_j = F.concat(
        F.lit('[{"player":{"ko":"선수","en":"Player"},"issue":{"ko":"무릎","en":"Knee"},'
              '"status":{"ko":"주의","en":"Questionable"},"watch":'), watch, F.lit("}]"))
    move_date = F.when(i % 53 == 14, F.lit('""')).otherwise(F.lit('"08-15"'))
    moves_j = F.when(i % 3 == 1, F.concat(F.lit('[{"date":'), move_date,
                                          F.lit(',"text":{"ko":"이동","en":"Move"}}]'))).otherwise(F.lit("[]"))
    schedule_j = F.lit('[{"date":{"ko":"8월 15일\\n","en":"Aug 15\\n"},"text":{"ko":"경기","en":"Game"}}]')

    def with_text(t):
        headline = F.when(i % 13 == 4, t).otherwise(_bi(lg, t))
        story1 = F.concat(
            F.lit("{"),
            F.when(i % 5 == 1, F.lit("")).otherwise(F.lit('"icon":"📰",')),
            F.lit('"status":"NEW","tags":['), lg, F.lit(","), src, F.lit('],"title":'), _bi(src, src),
            F.lit(',"facts":{"ko":['), lg, F.lit('],"en":'), facts_en, F.lit('},"interp":'),
            _bi(_lit("해설"), t), F.lit(',"url":'), url, F.lit("}"))
        stories_j = F.when(i % 23 == 7, F.lit("[]")).otherwise(
            F.concat(F.lit("["), story1, F.lit(","), story2, F.lit("]")))
        return _obj(
            ("date", date_j), ("dateLabel", label), ("headline", headline), ("stories", stories_j),
            ("injuries", F.when(i % 31 == 9, F.lit(None).cast("string")).otherwise(injuries_j)),
            ("moves", moves_j), ("schedule", schedule_j),
        )

    def finish(body):
        truncated = F.when(i % 37 == 10, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
        return F.when(i % 3 == 0, F.concat(F.lit("```json\n"), truncated, F.lit("\n```"))).otherwise(truncated)

    return _let(_let(json_str(text), with_text), finish)


def raw_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    i = F.col("doc_id")
    return d.select(
        "doc_id",
        F.concat(F.lit("2026-"), F.lpad(_s(i % 12 + 1), 2, "0"), F.lit("-"), F.lpad(_s(i % 28 + 1), 2, "0")).alias("date"),
        raw_day_json(F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source")).alias("raw"),
    )


# --- archive -------------------------------------------------------------------

def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    i = F.col("doc_id")
    date = F.date_format(F.date_add(F.to_date(F.lit("2024-01-01")), (i % 1000).cast("int")), "yyyy-MM-dd")
    return d.select(
        i.alias("doc_id"),
        date.alias("date"),
        F.col("text").alias("headline"),
        F.array(F.upper(F.col("lang")), F.upper(F.col("source"))).alias("tags"),
    )


# --- games -----------------------------------------------------------------------

def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season rows of two teams from orders (team by customer parity).

    A rivalry game (priority 1-URGENT, regular phase) is listed by both teams,
    home flags opposite; a bye row carries only phase, week and ``bye``; a TBD
    row has no kickoff, broadcaster or result.
    """
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    g = o.join(c, o.o_custkey == c.c_custkey, "left")
    k = F.col("o_orderkey")
    team = F.when(F.col("o_custkey") % 2 == 0, F.lit("GB")).otherwise(F.lit("MIN"))
    phase = F.when(k % 7 == 0, F.lit("pre")).otherwise(F.lit("reg"))
    week = F.when(k % 7 == 0, k % 3 + 1).otherwise(k % 18 + 1).cast("int")
    bye = (phase == "reg") & (F.col("o_orderpriority") == "5-LOW") & (k % 5 == 0)
    tbd = (phase == "reg") & ~bye & (F.col("o_orderpriority") == "4-NOT SPECIFIED") & (k % 5 == 1)
    rivalry = (phase == "reg") & ~bye & ~tbd & (F.col("o_orderpriority") == "1-URGENT")
    et = F.make_timestamp_ntz(F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"),
                              (k % 10 + 12).cast("int"),
                              F.element_at(F.array(F.lit(0), F.lit(15), F.lit(25)), (k % 3 + 1).cast("int")),
                              F.lit(0))
    playable = ~bye & ~tbd
    from pressroll.functions.dates import convert_kickoff
    base = g.select(
        team.alias("team"), k.alias("pos"), phase.alias("phase"), week.alias("week"),
        F.when(~bye, F.col("c_name")).alias("opponent"),
        F.when(~bye, F.col("o_orderstatus") == "O").alias("home"),
        F.when(playable, convert_kickoff(et)).alias("dateKST"),
        F.when(playable, F.concat(F.date_format(et, "M/d (EEE) h:mm a"), F.lit(" ET"))).alias("etLabel"),
        F.when(playable, F.when(k % 4 == 0, F.lit("FOX")).when(k % 4 == 1, F.lit("CBS"))
                          .when(k % 4 == 2, F.lit(""))).alias("bcast"),
        F.when(playable & (F.col("o_orderstatus") == "F"),
               F.struct(F.concat(F.lit("종료 "), _s(k % 40), F.lit("-"), _s(k % 31)).alias("ko"),
                        F.concat(F.lit("Final: "), _s(k % 40), F.lit("-"), _s(k % 31)).alias("en"))).alias("final"),
        F.when(rivalry, F.lit(True)).alias("rivalry"),
        F.when(bye, F.lit(True)).alias("bye"),
        F.when(tbd, F.lit(True)).alias("tbd"),
        F.col("o_custkey").alias("season"),
    )
    # a rivalry game is listed by both teams: one scan, the second copy made
    # by exploding [own, other] and flipping team and home for the other
    other = F.when(F.col("team") == "GB", F.lit("MIN")).otherwise(F.lit("GB"))
    copies = F.when(F.coalesce(F.col("rivalry"), F.lit(False)), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = base.select("*", F.explode(copies).alias("_copy"))
    return (out.withColumn("team", F.when(F.col("_copy") == 1, other).otherwise(F.col("team")))
               .withColumn("home", F.when(F.col("_copy") == 1, ~F.col("home")).otherwise(F.col("home")))
               .drop("_copy"))


# --- interaction events --------------------------------------------------------------

# event type of the driver table -> interaction name of the catalogue
EVENT_NAMES = {"view": "nav_tab", "click": "archive_search", "signup": "lang_toggle",
               "purchase": "schedule_team_tab"}


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions_from(read(spark, sf_dir, "events"))


def interactions_from(events: DataFrame) -> DataFrame:
    """Interaction rows from ``events`` rows (batch or streaming)."""
    e = events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    name = F.coalesce(F.try_element_at(F.create_map(*[x for kv in EVENT_NAMES.items() for x in map(F.lit, kv)]),
                                       F.col("event_type")), F.col("event_type"))
    k = F.get_json_object("props", "$.k")
    key = (F.when(name == "nav_tab", F.lit("page")).when(name == "archive_search", F.lit("chars"))
            .when(name == "lang_toggle", F.lit("lang")).when(name == "schedule_team_tab", F.lit("team"))
            .otherwise(F.lit("k")))
    eid = F.col("event_id")
    data = (F.when(eid % 20 == 0, F.lit(None).cast("map<string,string>"))
             .when(eid % 20 == 1, F.create_map(key, k, F.lit("x"), F.lit("1"), F.lit("y"), F.lit("2")))
             .otherwise(F.create_map(key, k)))
    return e.select(
        _s("user_id").alias("user"),
        eid.alias("seq"),
        # stored without zone; read as UTC instants (event time needs TIMESTAMP)
        F.col("ts").cast("timestamp").alias("ts"),
        name.alias("name"),
        data.alias("data"),
        # search box length after the input (0 = emptied box)
        (F.col("value").cast("long") % 20).alias("chars"),
        # press stream: even ids press, odd ids release
        (eid % 2 == 1).alias("is_cancel"),
    )


# --- model responses ---------------------------------------------------------------

def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a response: assistant turns are text blocks, others tool blocks."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return c.select(
        "conv_id", "turn",
        F.when(F.col("role") == "assistant", F.lit("text")).otherwise(F.lit("tool_use")).alias("type"),
        "text",
    )


# --- saved index as stored JSON rows (with planned defects) --------------------

def epoch_day(date: Column) -> Column:
    return F.datediff(F.to_date(date), F.to_date(F.lit("1970-01-01")))


def index_json(entries: DataFrame) -> DataFrame:
    """The index as stored JSON text, one row per entry, from derived entries.

    Keyed by the day number e of the date: e%7==0 rows are missing (orphan
    days), e%5==0 story counts are off by one, e%13==0 move counts are text,
    e%17==0 rows lack ``headline``, e%19==0 rows have an empty date, and e%11==0
    rows get a twin dated 100 years later (no such day).
    """
    e = epoch_day(F.col("date"))
    date = F.when(e % 19 == 0, F.lit("")).otherwise(F.col("date"))
    story = (F.col("storyCount") + F.when(e % 5 == 0, 1).otherwise(0)).cast("string")
    move = F.when(e % 13 == 0, json_str(F.col("moveCount").cast("string"))).otherwise(
        F.col("moveCount").cast("string"))
    entry = _obj(
        ("date", json_str(date)),
        ("dateLabel", F.to_json("dateLabel")),
        ("headline", F.when(e % 17 != 0, F.to_json("headline"))),
        ("storyCount", story),
        ("moveCount", move),
        ("tags", F.to_json("tags")),
    )
    kept = entries.where(e % 7 != 0)
    base = kept.select(F.col("date").alias("source_date"), entry.alias("entry"))
    twin_date = F.date_format(F.date_add(F.to_date("date"), 36500), "yyyy-MM-dd")
    twins = kept.where(e % 11 == 0).select(
        F.col("date").alias("source_date"),
        _obj(("date", json_str(twin_date)), ("dateLabel", F.to_json("dateLabel")),
             ("headline", F.to_json("headline")), ("storyCount", F.col("storyCount").cast("string")),
             ("moveCount", F.col("moveCount").cast("string")), ("tags", F.to_json("tags"))).alias("entry"))
    return base.unionByName(twins)


# --- a flat store of JSON files with its index (with planned defects) ------------

def _store_date(doc_id: Column) -> Column:
    return F.date_format(F.date_add(F.to_date(F.lit("1970-01-01")), doc_id.cast("int")), "yyyy-MM-dd")


def store_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day files (``stem`` = date, ``content``), one per document.

    Keyed by doc_id i: i%41==11 has no file, i%19==6 another date inside,
    i%23==7 stories that are no list, i%31==9 no injuries, i%37==10 is cut off,
    i%53==17 holds JSON null; i%4 stories and i%3 moves.
    """
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    i = F.col("doc_id")
    date = json_str(F.when(i % 19 == 6, _store_date(i + 1)).otherwise(_store_date(i)))
    stories = F.when(i % 23 == 7, F.lit('"none"')).otherwise(
        F.concat(F.lit("["), F.substring(F.lit("{},{},{}"), F.lit(1), (3 * (i % 4) - 1).cast("int")), F.lit("]")))
    moves = F.concat(F.lit("["), F.substring(F.lit("0,0"), F.lit(1), (2 * (i % 3) - 1).cast("int")), F.lit("]"))
    body = _obj(("date", date), ("dateLabel", _bi(date, date)), ("headline", _bi(json_str(F.col("lang")), json_str(F.col("text")))),
                ("stories", stories), ("injuries", F.when(i % 31 != 9, F.lit("[]"))), ("moves", moves), ("schedule", F.lit("[]")))
    content = F.when(i % 53 == 17, F.lit("null")).otherwise(
        _let(body, lambda b: F.when(i % 37 == 10, F.substring(b, F.lit(1), F.length(b) - 1)).otherwise(b)))
    return d.where(i % 41 != 11).select("doc_id", _store_date(i).alias("stem"), content.alias("content"))


def store_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index entries as JSON text (``date`` = their day's, for splitting).

    i%43==12 has no entry, i%17==3 no headline, i%47==13 an empty date and
    i%61==14 none, i%5==0 one story too many, i%29==4 one move too many, i%13==0
    its moves as text; i%71==15 is listed twice.
    """
    d = read(spark, sf_dir, "documents").select("doc_id")
    i = F.col("doc_id")
    date = json_str(_store_date(i))
    moves = (i % 3 + F.when(i % 29 == 4, 1).otherwise(0)).cast("string")
    entry = _obj(("date", F.when(i % 61 != 14, F.when(i % 47 == 13, F.lit('""')).otherwise(date))), ("dateLabel", _bi(date, date)),
                 ("headline", F.when(i % 17 != 3, _bi(date, date))), ("storyCount", (i % 4 + F.when(i % 5 == 0, 1).otherwise(0)).cast("string")),
                 ("moveCount", F.when(i % 13 == 0, json_str(moves)).otherwise(moves)), ("tags", F.lit("[]")))
    copies = F.when(i % 71 == 15, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    listed = d.where(i % 43 != 12).select(_store_date(i).alias("date"), entry.alias("entry"), copies.alias("copies"))
    # exploded on its own: beside a generator the fields of a struct lose their names
    return listed.select("date", "entry", F.explode("copies")).drop("col")
