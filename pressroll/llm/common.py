"""Helpers shared by the training-data operators: table access, written
intermediate tables and vectorised text hashing inside Python tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroll.session import bound_batches, materialize

__all__ = ["INVERSE", "ROLL", "SPACE", "U64", "WORD", "Words", "flag_repeats", "identified", "join_ids", "materialize", "mix", "powers",
           "prefix_sums", "rolling", "shingle_hashes", "table", "text_chunks", "words_of"]

#: Bytes of text a Python task hashes at a time (at least one whole text).
CHUNK_BYTES = 1 << 19

#: What separates words: the space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identified(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that no other column of the input can clash
    with one an operator adds."""
    return docs.select(*[docs[c] for c in columns])


#: Ids that repeat are broadcast up to this number (8 MB of integers).
BROADCAST_IDS = 1 << 20


def flag_repeats(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Adds ``again``: whether another row has the same id (nulls have none).
    The usual table has no such ids and is not joined at all; counted few are
    broadcast, more are joined by Spark's own choice."""
    seen = rows.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n"))
    twice = materialize(seen.where("n > 1").select(id_col, F.lit(True).alias("again")), "repeated-ids")
    n = twice.count()
    if not n:
        return rows.withColumn("again", F.lit(False))
    joined = rows.join(F.broadcast(twice) if n <= BROADCAST_IDS else twice, id_col, "left")
    return joined.withColumn("again", F.coalesce("again", F.lit(False)))


# ---------------------------------------------------------------- hashing

U64 = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


#: A random 64-bit value for each byte, and the base of the polynomial hash.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
ROLL = 0x9E3779B97F4A7C15 | 5
INVERSE = pow(ROLL, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """At least ``n`` powers of ``base`` modulo 2**64, from the zeroth on."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, U64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base]


def prefix_sums(data: np.ndarray, lower: bool) -> np.ndarray:
    """Prefix sums of value(byte) * ROLL**position, one longer than the data."""
    value = BYTE_VALUE
    if lower:
        value = value.copy()
        value[65:91] = value[97:123]
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(value[data] * powers(ROLL, len(data) + 1)[: len(data)], out=out[1:])
    return out


class Words:
    """Words of a run of texts: ``start`` and ``end`` byte of each word in
    ``data``, its text's number ``doc`` and 64-bit ``hash``; ``first`` has the
    first word of each text and one closing entry."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, between: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        n = len(data)
        space = between[data]
        inside = ~space
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= space[:-1]
        ends[:-1] &= space[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        begins[edges] |= inside[edges]
        ends[edges - 1] |= inside[edges - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self._sums, self._scale = prefix_sums(data, lower), powers(INVERSE, n + 1)
        self.hash = self._hash(self.end)

    def _hash(self, end: np.ndarray) -> np.ndarray:
        length = (end - self.start).astype(U64)
        raw = (self._sums[end] - self._sums[self.start]) * self._scale[self.start]
        return mix(raw + length * U64(0xD6E8FEB86659FD93))

    def prefix(self, size: int) -> np.ndarray:
        """Hash of the first ``size`` bytes of each word (fewer if it has fewer)."""
        return self._hash(np.minimum(self.end, self.start + size))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


#: Bytes between words: the space and the control characters 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False, between: np.ndarray = SPACE) -> Words:
    return Words(data, offsets, lower, between)


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every shingle of ``size`` words, in text order; a
    text with fewer words is one shingle, a text without words has none."""
    n, count = len(words.hash), words.counts()
    factors = mix(np.arange(11, 11 + size, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)
    whole = max(0, n - size + 1)
    sums = np.zeros(whole, U64)
    for i in range(size):
        sums += words.hash[i : i + whole] * factors[i]
    at = np.arange(whole)
    ok = words.doc[at] == words.doc[at + size - 1] if whole else np.zeros(0, bool)
    hashes, docs = mix(sums[ok]), words.doc[at[ok]]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.zeros(len(short), U64)
        for i in range(size - 1):
            has = count[short] > i
            extra[has] += words.hash[words.first[short[has]] + i] * factors[i]
        extra = mix(extra + count[short].astype(U64))
        hashes, docs = np.concatenate([hashes, extra]), np.concatenate([docs, short])
        order = np.argsort(docs, kind="stable")
        hashes, docs = hashes[order], docs[order]
    return hashes, docs


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit identifier of the ``size`` bytes from each position on, built by
    doubling: the identifier of 2L bytes joins those of L bytes at a position
    and L further on; the last step overlaps where ``size`` is no power of two."""
    ids, length = BYTE_VALUE[data], 1
    while length < size:
        step = min(length, size - length)
        ids = join_ids(ids[:-step], ids[step:]) if len(ids) > step else ids[:0]
        length += step
    return ids


def join_ids(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * U64(0x9FB21C651E98DF25) + right
    out ^= out >> U64(32)
    out *= U64(0xC2B2AE3D27D4EB4F)
    out ^= out >> U64(29)
    return out


# ------------------------------------------------------------- Arrow access

def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first row, row after the
    last, the bytes of the run and the offsets of its texts in them (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
