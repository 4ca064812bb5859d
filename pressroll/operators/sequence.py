"""Order-within-a-key operators that stay exact when one key is huge.

A window ``partitionBy(key)`` sends every row of a key to one task; with one
key holding a third of all rows that task is the job. Here rows are first
range-partitioned on ``(key, order)`` (a hot key is cut across many
partitions), the partition id is frozen by writing the rows once to the
shared folder (so every later use sees the same ids), the work is
done per ``(partition, key)`` chunk (bounded by the partition size), and the
chunks of one key are stitched together through a per-chunk summary table
(at most one row per partition for any key).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroll.session import checkpoint_dir, materialize

PID = "_pid"


def _names(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str],
           num_partitions: int | None = None) -> DataFrame:
    """Range-partition on keys + order and tag rows with a frozen partition id."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) for c in list(keys) + list(order)]
    return materialize(df.repartitionByRange(n, *cols).withColumn(PID, F.spark_partition_id()), "ranged")


def position_in_group(df: DataFrame, keys, order, pos_col: str = "pos",
                      num_partitions: int | None = None, first_col: str | None = None) -> DataFrame:
    """Adds the 0-based dense position of each row within its key, in ``order``
    (and, as ``first_col``, the smallest ``order`` value of the key).

    ``order`` must be unique within a key (it is the row's ordinal).
    """
    keys, order = _names(keys), _names(order)
    r = ranged(df, keys, order, num_partitions)
    local = r.withColumn(
        "_lpos",
        F.row_number().over(Window.partitionBy(PID, *keys).orderBy(*order)) - 1,
    )
    before = Window.partitionBy(*keys).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    chunks = r.groupBy(PID, *keys).agg(F.count(F.lit(1)).alias("_n"), F.min(order[0]).alias("_min"))
    offsets = chunks.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if first_col:
        offsets = offsets.withColumn(first_col, F.min("_min").over(Window.partitionBy(*keys)))
    offsets = offsets.drop("_n", "_min")
    return (local.join(offsets, [PID, *keys])
                 .withColumn(pos_col, (F.col("_off") + F.col("_lpos")).cast("long"))
                 .drop(PID, "_lpos", "_off"))


def next_matches(df: DataFrame, keys, order, payload: Sequence[str] = (),
                 conditions: dict[str, Column | None] | None = None,
                 num_partitions: int | None = None) -> DataFrame:
    """For each named condition, adds ``<name>`` = struct(order..., payload...)
    of the first later row of the same key (strictly after in ``order``) for
    which the condition holds (``None`` = any row); NULL when there is none.

    All conditions share one range partitioning and one window pass.
    """
    keys, order, payload = _names(keys), _names(order), list(payload)
    conditions = conditions or {"next": None}
    marks = {name: f"_m{i}" for i, name in enumerate(conditions)}
    marked = df
    for name, cond in conditions.items():
        marked = marked.withColumn(marks[name], F.lit(True) if cond is None else F.coalesce(cond, F.lit(False)))
    r = ranged(marked, keys, order, num_partitions)
    row = F.struct(*[F.col(c) for c in order + payload])
    # later rows, seen in reverse order: the latest match among "preceding" ones
    rev = (Window.partitionBy(PID, *keys)
                 .orderBy(*[F.col(c).desc() for c in order])
                 .rowsBetween(Window.unboundedPreceding, -1))
    local = r
    for name, m in marks.items():
        local = local.withColumn(f"_local_{m}", F.last(F.when(F.col(m), row), ignorenulls=True).over(rev))
    later = (Window.partitionBy(*keys).orderBy(F.col(PID).desc())
                   .rowsBetween(Window.unboundedPreceding, -1))
    chunks = r.groupBy(PID, *keys).agg(*[F.min(F.when(F.col(m), row)).alias(f"_first_{m}") for m in marks.values()])
    for m in marks.values():
        chunks = chunks.withColumn(f"_later_{m}", F.last(f"_first_{m}", ignorenulls=True).over(later))
    chunks = chunks.select(PID, *keys, *[f"_later_{m}" for m in marks.values()])
    out = local.join(chunks, [PID, *keys])
    for name, m in marks.items():
        out = out.withColumn(name, F.coalesce(f"_local_{m}", f"_later_{m}"))
    return out.drop(PID, *marks.values(), *[f"_local_{m}" for m in marks.values()],
                    *[f"_later_{m}" for m in marks.values()])


def next_match(df: DataFrame, keys, order, payload: Sequence[str] = (),
               when: Column | None = None, name: str = "next",
               num_partitions: int | None = None) -> DataFrame:
    """Adds ``<name>`` = struct(order..., payload...) of the first later row of
    the same key (strictly after in ``order``) for which ``when`` holds (any
    row when ``when`` is None); NULL when there is none."""
    return next_matches(df, keys, order, payload, {name: when}, num_partitions)


def assemble_parts(df: DataFrame, keys, order, text: str, sep: str,
                   rows_per_part: int, num_partitions: int | None = None) -> DataFrame:
    """Concatenate ``text`` per key in ``order`` as consecutive bounded parts.

    Part ``p`` holds the rows at positions ``[p*rows_per_part, (p+1)*rows_per_part)``;
    joining the parts of a key with ``sep`` in part order gives the whole text.
    No part ever holds more than ``rows_per_part`` rows.
    """
    keys, order = _names(keys), _names(order)
    # positions need key and order only; the text is shuffled once, by part
    narrow = position_in_group(df.select(*keys, *order), keys, order, "_pos", num_partitions)
    pos = df.select(*keys, *order, text).join(narrow, [*keys, *order])
    return (pos.withColumn("part", F.floor(F.col("_pos") / rows_per_part).cast("long"))
               .groupBy(*keys, "part")
               .agg(F.array_join(
                        F.transform(F.array_sort(F.collect_list(F.struct("_pos", text))),
                                    lambda x: x[text]), sep).alias(text),
                    F.count(F.lit(1)).alias("n_rows")))


def global_rank(df: DataFrame, order, rank_col: str = "row_no",
                num_partitions: int | None = None) -> DataFrame:
    """0-based rank of every row in a total order (``order`` unique), computed
    from range partitions and per-partition counts — no single-task window."""
    keyed = df.withColumn("_all", F.lit(0))
    return position_in_group(keyed, ["_all"], _names(order), rank_col, num_partitions).drop("_all")
