"""Two writers that add orders to one table of daily totals, interleaved.

Both start each step from the same version, so the second one to commit is
either moved up (the steps touch other months) or refused and run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressroll.session import materialize
from pressroll.sources.commits import Conflict, Transaction, VersionedTable

SCHEMA = T.StructType([T.StructField("date", T.StringType()), T.StructField("n_orders", T.LongType()), T.StructField("total_cents", T.LongType())])
HISTORY = "version long, writer string, step long, attempts long, moved_up boolean, n_dates long"
WRITERS = ("A", "B")
STEPS = 3


def increments(orders: DataFrame) -> DataFrame:
    """Daily counts and totals each writer adds in each step. In step 1 writer A
    has odd months only and B even ones; what that leaves out comes in step 2."""
    month = F.month("o_orderdate")
    writer = F.when(F.col("o_custkey") % 2 == 1, F.lit("A")).otherwise(F.lit("B"))
    mine = (month % 2 == 1) == (writer == "A")
    step = F.when(F.col("o_orderkey") % 3 == 0, 0).when((F.col("o_orderkey") % 3 == 1) & mine, 1).otherwise(2)
    dated = orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), writer.alias("writer"), step.alias("step"),
                          F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return dated.groupBy("writer", "step", "date").agg(F.count("*").alias("n_orders"), F.sum("cents").alias("total_cents"))


def _add(change: DataFrame):
    def apply(transaction: Transaction) -> None:
        old = transaction.read_for(change)
        both = old.unionByName(change.select(*old.columns)).join(change.select("date"), "date", "left_semi")
        transaction.upsert(both.groupBy("date").agg(F.sum("n_orders").alias("n_orders"), F.sum("total_cents").alias("total_cents")))

    return apply


def replay(orders: DataFrame, root: str) -> tuple[VersionedTable, DataFrame]:
    """The table after all steps, and a row per commit."""
    spark = orders.sparkSession
    table = VersionedTable(spark, root, part="substring(date, 6, 2)")
    table.create(SCHEMA)
    changes = materialize(increments(orders), "increments")
    done = []
    for step in range(STEPS):
        mine = {w: changes.where((F.col("writer") == w) & (F.col("step") == step)) for w in WRITERS}
        started = {w: table.begin() for w in WRITERS}
        for writer, transaction in started.items():
            _add(mine[writer])(transaction)
            attempts = 1
            try:
                version = transaction.commit(writer=writer, step=step)
            except Conflict:
                version, more = table.run(_add(mine[writer]), writer=writer, step=step)
                attempts += more
            moved_up = attempts == 1 and version != transaction.base + 1
            done.append((version, writer, step, attempts, moved_up, mine[writer].count()))
    return table, spark.createDataFrame(done, HISTORY)
