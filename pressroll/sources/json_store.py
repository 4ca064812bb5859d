"""The site's own store as a Spark data source: a flat folder with one JSON
document per file.

    spark.dataSource.register(JsonStore)
    spark.read.format("json_store").option("path", folder).load()

The folder is listed once, without opening any file; sub-folders, other
extensions and the index file are left out. Files are dealt to input
partitions by bytes and number, so tens of thousands of small files are read by
a few tasks and a large one has a task of its own. A file that cannot be opened
is a row with ``error``; bytes that are no UTF-8 are replaced, as the checker
reads them. With ``content`` set to ``false`` only names and sizes are returned.

The folder is read and written with ``pyarrow.fs`` (local or mounted folders,
hdfs, s3, gs).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pressroll.session import materialize

COLUMNS = "file string, stem string, size long, text string, error string"
_SCHEMA = pa.schema([("file", pa.string()), ("stem", pa.string()), ("size", pa.int64()), ("text", pa.string()), ("error", pa.string())])
INDEX_FILE = "index.json"
#: Bytes and files of an input partition, and bytes of an Arrow batch.
PARTITION_BYTES, PARTITION_FILES, BATCH_BYTES = 32 << 20, 2000, 4 << 20


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path.rstrip("/"))
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        super().__init__(len(files))
        self.files = files


def grouped(files: list[tuple[str, int]], max_bytes: int, max_files: int) -> list[list[tuple[str, int]]]:
    """Neighbouring files in groups of at most so many bytes and files (a larger file alone)."""
    groups: list[list[tuple[str, int]]] = []
    total = 0
    for name, size in files:
        if not groups or total + size > max_bytes or len(groups[-1]) >= max_files:
            groups.append([])
            total = 0
        groups[-1].append((name, size))
        total += size
    return groups


class JsonStoreReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.content = options.get("content", "true").lower() != "false"
        self.max_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.max_files = int(options.get("partitionfiles", PARTITION_FILES))

    def partitions(self) -> list[Files]:
        store, root = open_store(self.path)
        found = store.get_file_info(pafs.FileSelector(root, recursive=False))
        files = sorted((i.base_name, max(i.size or 0, 0)) for i in found
                       if i.type != pafs.FileType.Directory and i.base_name.endswith(".json") and i.base_name != INDEX_FILE)
        return [Files(g) for g in grouped(files, self.max_bytes, self.max_files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, root = open_store(self.path)
        rows, held = [], 0
        for name, size in partition.files:
            text = error = None
            if self.content:
                try:
                    with store.open_input_stream(f"{root}/{name}") as f:
                        text = f.read().decode("utf-8", "replace")
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"[:200]
            rows.append({"file": name, "stem": name[:-5], "size": size, "text": text, "error": error})
            held += size
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


class JsonStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_store"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> JsonStoreReader:
        return JsonStoreReader(self.options)


def scan(spark: SparkSession, folder: str, content: bool = True, **options) -> DataFrame:
    """The documents of a folder (columns of ``COLUMNS``)."""
    spark.dataSource.register(JsonStore)
    reader = spark.read.format("json_store").option("path", folder).option("content", str(content).lower())
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Names and sizes of the documents of a folder; no file is opened."""
    return scan(spark, folder, content=False).select("file", "stem", "size")


def write(docs: DataFrame, folder: str, name_col: str = "stem", content_col: str = "content") -> DataFrame:
    """Write each row as ``<name>.json``, returning (file, size). A file appears
    whole, under its name, or not at all; a repeated task writes it again. Of
    rows that repeat a name one is kept, so names should be unique."""
    rows = docs.select(docs[name_col].cast("string").alias("name"), docs[content_col].cast("binary").alias("content"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            names, sizes = [], []
            for name, content in zip(batch.column("name"), batch.column("content")):
                file, data = f"{name.as_py()}.json", content.as_py() or b""
                draft = f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(data)
                store.move(draft, f"{root}/{file}")
                names.append(file)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["file", "size"])

    return materialize(rows.mapInArrow(put, "file string, size long"), "json-files")
