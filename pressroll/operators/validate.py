"""Day-document validation over raw JSON text (bronze -> checked rows).

All narrow transformations (no shuffle): parse, validate, split into valid
rows and a quarantine, explode child rows for per-element reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroll.functions import documents as V
from pressroll.functions.strings import parse_fenced_json
from pressroll.session import where_computed


def parse_days(raw: DataFrame, text_col: str = "raw") -> DataFrame:
    """Adds ``doc`` (variant, NULL on failure) and ``parse_error``."""
    p = parse_fenced_json(F.col(text_col))
    return raw.withColumn("_p", p).select(
        "*", F.col("_p.value").alias("doc"), F.col("_p.error").alias("parse_error")).drop("_p")


def parsed_only(raw: DataFrame, text_col: str = "raw") -> DataFrame:
    """Documents that parse, with ``doc`` (parsed once per row)."""
    p = parse_fenced_json(F.col(text_col))
    return where_computed(raw, {"doc": p["value"]}, lambda s: s["doc"].isNotNull())


def all_days(raw: DataFrame, text_col: str = "raw") -> DataFrame:
    """Every document: ``doc`` (NULL where the text does not parse) and
    ``parse_error``, parsed once per row."""
    p = parse_fenced_json(F.col(text_col))
    return where_computed(raw, {"doc": p["value"], "parse_error": p["error"]}, lambda s: F.lit(True))


def checked_days(days: DataFrame) -> DataFrame:
    """Adds ``errors``: the parse error of a document that does not parse, else
    the day rules it breaks (empty = valid), evaluated once per row."""
    errors = F.when(F.col("doc").isNull(), F.array("parse_error")).otherwise(V.day_errors_of("doc"))
    return where_computed(days, {"errors": errors}, lambda s: F.lit(True))


def valid_only(parsed: DataFrame, doc_col: str = "doc") -> DataFrame:
    """Parsed documents without any error (rules evaluated once per row)."""
    return where_computed(parsed, {"errors": V.day_errors_of(doc_col)}, lambda s: F.size(s["errors"]) == 0)


def with_errors(parsed: DataFrame, doc_col: str = "doc") -> DataFrame:
    """Adds ``errors`` (array<string>, empty = valid) to parsed documents."""
    return parsed.withColumn("errors", V.day_errors_of(doc_col))


def split_valid(validated: DataFrame):
    """(valid, quarantine): a day with any error is held back, the others go on."""
    ok = F.size("errors") == 0
    return validated.where(ok), validated.where(~ok)


def story_reports(parsed: DataFrame, doc_col: str = "doc", key: str = "doc_id") -> DataFrame:
    """One row per story element: (key, story_pos, errors)."""
    arr = V.as_array(V.J(F.col(doc_col))["stories"])
    return (parsed.select(key, F.posexplode(arr).alias("story_pos", "story"))
                  .select(key, "story_pos", V.story_errors(F.col("story")).alias("errors")))


def row_reports(parsed: DataFrame, doc_col: str = "doc", key: str = "doc_id") -> DataFrame:
    """One row per injury / move / schedule element: (key, kind, pos, errors).

    One pass: the three lists are exploded together, each element checked
    with the rules of its kind."""
    doc = V.J(F.col(doc_col))
    kinds = ("injuries", "moves", "schedule")
    lists = F.array(*[F.struct(F.lit(k).alias("kind"), V.as_array(doc[k]).alias("items")) for k in kinds])
    per_kind = parsed.select(key, F.explode(lists).alias("l"))
    rows = per_kind.select(key, F.col("l.kind").alias("kind"), F.posexplode("l.items").alias("pos", "row"))
    errors = F.when(F.col("kind") == kinds[0], V.ROW_RULES[kinds[0]](F.col("row")))
    for k in kinds[1:]:
        errors = errors.when(F.col("kind") == k, V.ROW_RULES[k](F.col("row")))
    return rows.select(key, "kind", "pos", errors.alias("errors"))
