"""Incremental ingest as a stream: new article files -> index versions.

The mark is fixed once per run: it is that of the index version the run starts
from, so articles of one date may arrive in any number of triggers. Each
micro-batch stores its articles newer than the mark in its own folder, derives
the entries from all of the run's folders up to its own, and writes the
upserted index as the next version folder ``v=<epoch + 1>``. Replaying a batch
after a failure rewrites the same two folders, so the sink is idempotent; a run
that was broken off is taken up by passing its ``base`` again. The mark is the
late-data rule: an article for a date at or before the mark is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pressroll.operators import articles as A
from pressroll.operators import index as I
from pressroll.sources import files as Fs


def _versions(spark: SparkSession, root: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v="):
            if fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                out.append(int(name[2:]))
    return sorted(out)


def version_path(root: str, v: int) -> str:
    return f"{root.rstrip('/')}/v={v:012d}"


def read_index_version(spark: SparkSession, root: str, at_most: int | None = None) -> DataFrame:
    """The latest complete index version (``<= at_most`` when given); empty if none."""
    vs = [v for v in _versions(spark, root) if at_most is None or v <= at_most]
    if not vs:
        return spark.createDataFrame([], Fs.INDEX_SCHEMA)
    return Fs.scan_index(spark, version_path(root, vs[-1]))


def seed_index(index: DataFrame, root: str) -> None:
    """Write version 0 (the saved index before the stream starts)."""
    Fs.write_index(index, version_path(root, 0))


def start(spark: SparkSession, source_dir: str, schema, index_root: str, checkpoint: str,
          available_now: bool = True, max_files_per_trigger: int | None = None, base: int | None = None) -> StreamingQuery:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    articles = reader.parquet(source_dir)

    start_version = base if base is not None else max(_versions(spark, index_root), default=-1)
    run_root = f"{index_root.rstrip('/')}/fresh/base={start_version + 1}"

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        s = batch.sparkSession
        index = read_index_version(s, index_root, at_most=start_version)
        fresh = A.incremental(batch, index)
        fresh.write.mode("overwrite").parquet(f"{run_root}/epoch={epoch_id}")
        seen = s.read.schema(fresh.schema).option("basePath", run_root).parquet(run_root)
        seen = seen.where(F.col("epoch").cast("long") <= epoch_id).select(*fresh.columns)
        Fs.write_index(I.upsert(index, I.flat_entries(seen)), version_path(index_root, epoch_id + 1))

    w = articles.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
