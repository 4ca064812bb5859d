"""Readers and writers of the store: raw day documents, the day store, the
index, season documents, and the listing of day files.

Layout (all under one shared root, e.g. the cluster's checkpoint folder or a
table location):

    raw/date=YYYY-MM-DD/part-*.parquet     raw day JSON text (bronze)
    stories/date=YYYY-MM-DD/part-*.parquet flat story rows (silver)
    index/part-*.json                      index entries, JSON lines

A day is a partition, so reading one date is a partition filter, and
rewriting a day replaces only its partition (dynamic partition overwrite).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("dateLabel", T.StructType([T.StructField("ko", T.StringType()),
                                             T.StructField("en", T.StringType())])),
    T.StructField("headline", T.StructType([T.StructField("ko", T.StringType()),
                                            T.StructField("en", T.StringType())])),
    T.StructField("storyCount", T.LongType()),
    T.StructField("moveCount", T.LongType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])


def _by_date(df: DataFrame, date_col: str) -> DataFrame:
    """Rows grouped by date for a partitioned write, a hot date spread over
    several tasks (range on date, then a row hash): each date folder gets few
    files, and no single task writes a day holding a large share of rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, F.col(date_col), F.xxhash64(*[F.col(c) for c in df.columns]))


def _status(spark: SparkSession, path: str):
    """File status of a path on whatever file system it names, or None."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(p) if fs.exists(p) else None


def _exists(spark: SparkSession, path: str) -> bool:
    return _status(spark, path) is not None


def folder_exists(spark: SparkSession, path: str) -> bool:
    return _exists(spark, path)


def is_file(spark: SparkSession, path: str) -> bool:
    status = _status(spark, path)
    return status is not None and status.isFile()


# --- raw day documents -------------------------------------------------------------

def write_raw_days(raw: DataFrame, root: str, date_col: str = "date") -> None:
    """Store raw day documents partitioned by date; only the dates present in
    ``raw`` are replaced."""
    (_by_date(raw, date_col).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(date_col).parquet(root))


def scan_raw_days(spark: SparkSession, root: str) -> DataFrame:
    """Raw day documents with their date (from the partition) and file name."""
    return (spark.read.parquet(root)
                 .withColumn("file_name", F.col("_metadata.file_name")))


def scan_json_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per ``*.json`` file of a flat folder (sub-folders are not
    visited): (file, stem, text). The index file is left out."""
    df = (spark.read.option("pathGlobFilter", "*.json")
               .option("recursiveFileLookup", False).text(folder, wholetext=True))
    name = F.col("_metadata.file_name")
    return (df.select(name.alias("file"), F.regexp_replace(name, r"\.json$", "").alias("stem"),
                      F.col("value").alias("text"))
              .where(F.col("file") != "index.json"))


def list_day_files(spark: SparkSession, root: str, date_col: str = "date") -> DataFrame:
    """Dates that have a day in a date-partitioned store (one row per date)."""
    return spark.read.parquet(root).select(date_col).distinct()


# --- day store ----------------------------------------------------------------------

def write_days(rows: DataFrame, root: str, date_col: str = "date") -> None:
    """Write flat day rows; every date present is replaced as a whole, the
    other dates stay (dynamic partition overwrite)."""
    (_by_date(rows, date_col).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic")
         .partitionBy(date_col).parquet(root))


def read_days(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


# --- index ----------------------------------------------------------------------------

def write_index(index: DataFrame, root: str, newest_first: bool = True) -> None:
    """Rewrite the index as JSON lines, sorted by date (presentation order)."""
    order = F.col("date").desc() if newest_first else F.col("date").asc()
    index.select(*[f.name for f in INDEX_SCHEMA.fields]).orderBy(order).write.mode("overwrite").json(root)


def scan_index(spark: SparkSession, root: str, missing: str = "empty") -> DataFrame:
    """Index entries; an absent index is empty (``missing="empty"``, as the
    ingest job treats it) or an error (``missing="error"``, as the checker)."""
    if not _exists(spark, root):
        if missing == "error":
            raise FileNotFoundError(root)
        return spark.createDataFrame([], INDEX_SCHEMA)
    return spark.read.schema(INDEX_SCHEMA).json(root)


def scan_index_array(spark: SparkSession, path: str) -> DataFrame:
    """Index stored as JSON array files (the site's own format): one row per
    entry, in no order. A missing folder, a file that does not parse and a file
    that is no array are errors, as they are for the checker."""
    kind = INDEX_SCHEMA.simpleString()
    return scan_index_raw(spark, path).select(F.variant_get("e", "$", kind).alias("r")).select("r.*")


def scan_index_raw(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an index of JSON array files as they are (``e``, a variant). A
    missing index, a file that does not parse and one that is no array stop the
    job: without the index there is nothing to check."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("v"))
    return files.select(F.explode(_checked_array()).alias("e"))


def _checked_array():
    entries = F.try_variant_get("v", "$", "array<variant>")
    fault = F.when(F.col("v").isNull(), F.lit(" does not parse")).otherwise(F.lit(" is not an array"))
    return F.when(entries.isNull(), F.raise_error(F.concat(F.lit("index file "), F.col("file"), fault))
                  .cast("array<variant>")).otherwise(entries)


def write_entries_array(entries: DataFrame, root: str, date_col: str = "date", entry_col: str = "entry") -> None:
    """Index entries given as JSON text, as JSON array files, one per month."""
    months = entries.groupBy(F.substring(date_col, 1, 7).alias("month")).agg(F.sort_array(F.collect_list(entry_col)).alias("rows"))
    (months.select("month", F.concat(F.lit("["), F.array_join("rows", ","), F.lit("]")).alias("value"))
           .write.mode("overwrite").partitionBy("month").text(root))


def write_index_array(index: DataFrame, root: str) -> None:
    """The index as JSON array files, one array per month of dates, so that no
    task holds the whole archive."""
    row = F.struct(*[f.name for f in INDEX_SCHEMA.fields])
    months = index.groupBy(F.substring("date", 1, 7).alias("month")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    (months.select("month", F.to_json("rows", {"ignoreNullFields": "false"}).alias("value"))
           .write.mode("overwrite").partitionBy("month").text(root))


# --- season documents ------------------------------------------------------------------

GAME_FIELDS = ["phase", "week", "opponent", "home", "dateKST", "etLabel", "bcast", "final",
               "rivalry", "bye", "tbd"]


def season_documents(games: DataFrame, teams=("GB", "MIN")) -> DataFrame:
    """Season documents ``{season, <team>: [games...], ...}``, one per value of
    ``season`` (list order = ``pos``; a season's games bound the document)."""
    g = games
    aggs = []
    for t in teams:
        rows = F.when(F.col("team") == t, F.struct("pos", *GAME_FIELDS))
        aggs.append(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x.dropFields("pos"))
                    .alias(t.lower()))
    return g.groupBy("season").agg(*aggs)


def write_season(docs: DataFrame, root: str) -> None:
    docs.write.mode("overwrite").json(root)


def scan_season(spark: SparkSession, root: str, teams=("GB", "MIN"), schema=None, multi_line: bool = False) -> DataFrame:
    """Season documents -> one row per game: (team, season, i = place in the
    team's list of that document, game fields). ``multi_line`` reads files that
    hold one printed document each, as the site keeps them."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    docs = reader.option("multiLine", multi_line).json(root)
    parts = []
    for t in teams:
        parts.append(docs.select("season", F.posexplode(t.lower()).alias("i", "g"))
                         .select(F.lit(t).alias("team"), "season", "i", "g.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
