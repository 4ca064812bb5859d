"""Connected components of a link table by alternating large-star and
small-star steps; every step is a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroll.llm.common import materialize


def _hubs(edges: DataFrame) -> DataFrame | None:
    """Nodes of more than a thousandth of all ends of links, a thousand at most."""
    ends = edges.select("a").unionAll(edges.select("b"))
    counted = ends.groupBy("a").agg(F.count("*").alias("n"))
    total = 2 * edges.count()
    hubs = counted.where(F.col("n") * 1000 > total).select("a").collect()
    return edges.sparkSession.createDataFrame(hubs, ends.schema) if hubs else None


def _with_least(both: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """``both(a, b)`` with ``m``, the smaller of a and its smallest b; the rows
    of hubs stay where they are."""
    def joined(rows: DataFrame, hint) -> DataFrame:
        low = rows.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return rows.join(hint(low), "a")

    if hubs is None:
        return joined(both, lambda low: low)
    some, rest = (both.join(F.broadcast(hubs), "a", how) for how in ("left_semi", "left_anti"))
    return joined(some, F.broadcast).unionByName(joined(rest, lambda low: low))


def _star(edges: DataFrame, hubs: DataFrame | None, large: bool) -> DataFrame:
    """Join the larger (``large``) or smaller neighbours of each node to the
    smallest node of its neighbourhood."""
    if large:
        joined = _with_least(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), hubs)
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        joined = _with_least(edges, hubs)
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
    return materialize(moved.where("a <> b").distinct(), "edges")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(id, component)``: for every node of a link the
    smallest node it is joined to (nodes without links are not returned).
    Runs until no edge changes; each step is a written table. A step gives no
    node more links than it had, so the hubs of a round hold for both steps."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialize(edges, "edges")
    state = None
    while True:
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state:
            break
        state = found
        hubs = _hubs(edges)
        edges = _star(_star(edges, hubs, True), hubs, False)
    stars = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return stars.union(edges.select("b", F.col("b").alias("component")).distinct())
