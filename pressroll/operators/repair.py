"""One-off repair edits, expressed as table transformations.

An edit is judged before it counts: a document that an edit would make invalid,
or a day it would leave without stories, is refused and stays as it was. Index
entries are recomputed from the edited store, never patched by hand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroll.functions import documents as V
from pressroll.functions.strings import literal_replace, parse_fenced_json
from pressroll.session import where_computed


def delete_matching(rows: DataFrame, text: Column, literal: str) -> DataFrame:
    """Drop rows whose text contains a literal; missing text counts as ''."""
    return rows.where(~F.contains(F.coalesce(text, F.lit("")), F.lit(literal)))


def delete_nested(items: Column, field_path: Sequence[str], literal: str) -> Column:
    """Same edit inside a nested array column (one day row holding its stories)."""
    def text_of(x):
        for f in field_path:
            x = x[f]
        return F.coalesce(x, F.lit(""))
    return F.filter(items, lambda x: ~F.contains(text_of(x), F.lit(literal)))


def refuse_emptied(old: DataFrame, edited: DataFrame, key: str = "date") -> DataFrame:
    """Index rows after an edit, with ``outcome``: a day the edit left without
    stories is invalid and refused, its old row stays; the others are edited."""
    names = [c for c in old.columns if c != key]
    both = old.select(key, F.struct(*names).alias("_old")).join(edited.select(key, F.struct(*names).alias("_new")), key, "left")
    ok = F.coalesce(F.col("_new.storyCount") > 0, F.lit(False))
    row = F.when(ok, F.col("_new")).otherwise(F.col("_old")).alias("_row")
    outcome = F.when(ok, F.lit("edited")).otherwise(F.lit("refused")).alias("outcome")
    return both.select(key, row, outcome).select(key, "_row.*", "outcome")


def replace_in_documents(docs: DataFrame, text_col: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Literal replacement over whole document texts plus a ``changed`` flag
    (untouched documents are reported as such, not rewritten)."""
    new = literal_replace(F.col(text_col), pairs)
    return docs.withColumn("changed", new != F.col(text_col)).withColumn(text_col, new)


def replace_validated(docs: DataFrame, text_col: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Literal replacement over day documents with its outcome: ``unchanged``
    (no literal occurs; not judged again), ``edited``, or ``refused`` where the
    edited text does not parse or breaks a rule: then the old text stays and
    ``errors`` says why."""
    old, new = F.col(text_col), F.col("_new")
    replaced = docs.withColumn("_new", literal_replace(old, pairs))
    parsed = where_computed(replaced, {"_p": F.when(new != old, parse_fenced_json(new))}, lambda s: F.lit(True))
    wrong = F.when(F.col("_p.value").isNull(), F.array("_p.error")).otherwise(V.day_errors_of("_p.value"))
    judged = where_computed(parsed, {"_e": F.when(F.col("_p").isNotNull(), wrong)}, lambda s: F.lit(True))
    outcome = (F.when(F.coalesce(new == old, F.lit(True)), F.lit("unchanged")).when(F.size("_e") == 0, F.lit("edited"))
                .otherwise(F.lit("refused")))
    done = judged.withColumn("outcome", outcome).withColumn("errors", F.coalesce("_e", F.array().cast("array<string>")))
    return done.withColumn(text_col, F.when(F.col("outcome") == "edited", new).otherwise(old)).drop("_new", "_p", "_e")


def delete_validated(days: DataFrame, lists: dict[str, Sequence[str]], literal: str) -> DataFrame:
    """Nested delete in day rows: elements of each list whose text at the path
    contains the literal go. Adds ``n_deleted`` and ``outcome``: ``unchanged``,
    ``edited``, or ``refused`` where no story would be left (the day stays)."""
    cut = {name: delete_nested(F.col(name), path, literal) for name, path in lists.items()}
    sizes = lambda side: sum((F.coalesce(F.size(side(n)), F.lit(0)) for n in lists), F.lit(0))
    tried = where_computed(days, {f"_{n}": c for n, c in cut.items()}, lambda s: F.lit(True))
    lost = sizes(lambda n: F.col(n)) - sizes(lambda n: F.col(f"_{n}"))
    outcome = (F.when(lost == 0, F.lit("unchanged"))
                .when(F.size("_stories" if "stories" in lists else "stories") == 0, F.lit("refused")).otherwise(F.lit("edited")))
    done = tried.withColumn("n_deleted", lost).withColumn("outcome", outcome)
    for name in lists:
        done = done.withColumn(name, F.when(F.col("outcome") == "edited", F.col(f"_{name}")).otherwise(F.col(name)))
    return done.drop(*[f"_{n}" for n in lists])
