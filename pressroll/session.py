"""Session settings every job in this package relies on.

Operators never create a session; jobs and tests call :func:`configure` on the
session they were given (the settings below are all runtime SQL confs).
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4MB")

# Runtime SQL settings the operators depend on.
SESSION_CONF = {
    # Dates are kept as ISO strings; timestamps are compared in UTC.
    "spark.sql.session.timeZone": "UTC",
    # A JSON object with a repeated key keeps the last value (as JSON.parse does).
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Partition folders ``date=YYYY-MM-DD`` keep the string type of the column.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    # Runtime re-planning: broadcast a join side only once its shuffle output
    # is measured small, split skewed shuffle partitions, merge tiny ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    # A Python task gets its rows by bytes, not by 10,000 of whatever size: what
    # it holds at a time does not grow with its share of the table.
    BATCH_BYTES[0]: BATCH_BYTES[1],
    # Session windows of a key are merged inside each task before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SESSION_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    checkpoint_dir(spark)
    return spark


def bound_batches(spark: SparkSession) -> None:
    """Only the setting that bounds the rows a Python task gets at a time (for
    operators that leave the session's other settings as they are)."""
    if spark.conf.get(BATCH_BYTES[0], None) != BATCH_BYTES[1]:
        spark.conf.set(*BATCH_BYTES)


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Taken from the cluster setting ``spark.checkpoint.dir``. Only a local
    session (tests) without that setting gets a private folder under /tmp.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not conf_dir:
        if not _is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder"
            )
        conf_dir = tempfile.mkdtemp(prefix="pressroll-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark)
    import uuid

    return f"{base.rstrip('/')}/pressroll/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str):
    """Write ``df`` once as a parquet table in the shared folder and read it
    back: cuts lineage (a lost executor re-reads the table instead of
    recomputing it), computes the plan exactly once, and gives later scans
    column pruning and filter pushdown."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def where_computed(df, computed: dict, keep):
    """Add costly columns and keep the rows where ``keep(struct)`` holds, with
    each column computed once per row.

    A plain ``withColumn(...).where(...)`` lets the optimizer push the filter
    below the projection, pasting the costly expression into the filter (it
    then runs twice). Filtering inside a generator's input is a barrier:
    ``explode(filter(array(struct(cols)), keep))`` yields the row or nothing.
    """
    from pyspark.sql import functions as F

    packed = F.struct(*[c.alias(n) for n, c in computed.items()])
    kept = F.explode(F.filter(F.array(packed), keep)).alias("_kept")
    return df.select("*", kept).select(*df.columns, *[F.col(f"_kept.{n}").alias(n) for n in computed])


def local_path(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path
