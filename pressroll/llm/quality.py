"""Quality rules with cross-document line frequency.

Base figures of every text (words are ``[^\\x20\\x09-\\x0D]+``) and a base rule
on them; then lines are normalised (words lower-cased in A-Z, joined by one
space), hashed, and counted in distinct documents of each host. Lines in more
than ``max_documents`` documents of their host are removed; a document whose
remaining words are fewer than ``min_words`` or less than ``min_left`` of all is
depleted and rejected.

Edge cases: null or empty text has no words, fails the base rule and is
rejected; a null host is a host of its own; rows that repeat an id are one
document where lines are counted and are each judged, rows without an id are
documents of their own; an empty table gives an empty result; other columns are
ignored. Hot lines cost little: each task counts its own lines before the
shuffle, and the line table has one row per distinct line and document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroll.llm.common import INVERSE, U64, Words, flag_repeats, identified, materialize, mix, powers, prefix_sums, text_chunks, words_of

#: Lines in more documents of one host than this are boilerplate.
MAX_DOCUMENTS = 10
MIN_WORDS = 50
MIN_LEFT = 0.5
MAX_REPEAT_PERCENT = 50
#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"

_LINE = 0x8CB92BA72F3D8DD7 | 1
_LINE_INVERSE = pow(_LINE, -1, 1 << 64)


def _inclusive(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _first_seen(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry whether an equal one precedes it, and whether it has an equal at all."""
    order = np.lexsort((value, group))  # stable: equal entries stay in text order
    same = np.zeros(len(order) + 1, bool)
    g, v = group[order], value[order]
    same[1:-1] = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    later, any_ = np.zeros(len(order), bool), np.zeros(len(order), bool)
    later[order] = same[:-1]
    any_[order] = same[:-1] | same[1:]
    return later, any_


def _repeat_words(words: Words) -> np.ndarray:
    """Words of each text that lie in a three-word window found twice or more."""
    n = len(words.hash)
    marked = np.zeros(n, bool)
    at = np.arange(max(0, n - 2))
    at = at[words.doc[at] == words.doc[at + 2]] if len(at) else at
    if len(at):
        f = mix(np.arange(3, dtype=U64) + U64(991)) | U64(1)
        window = mix(words.hash[at] * f[0] + words.hash[at + 1] * f[1] + words.hash[at + 2] * f[2])
        again = at[_first_seen(words.doc[at], window)[1]]
        for i in range(3):
            marked[again + i] = True
    return np.diff(_inclusive(marked)[words.first])


def _figures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    words = words_of(data, offsets)
    low = words_of(data, offsets, lower=True).hash
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    chars = _inclusive(inside & ((data & 0xC0) != 0x80))
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    symbols = _inclusive(symbol[data])
    # Lines: from each text's start or the byte after a \n, to the next \n or the text's end.
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    line_doc = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(data)), offsets[line_doc + 1]) if len(starts) else starts
    ends = ends - ((ends > starts) & (data[ends - 1] == 10)) if len(starts) else ends
    w0, w1 = np.searchsorted(words.start, starts), np.searchsorted(words.start, ends)
    ordinal = np.arange(len(starts)) - np.searchsorted(line_doc, line_doc)
    full = w1 > w0
    starts, ends, line_doc, w0, w1, ordinal = (x[full] for x in (starts, ends, line_doc, w0, w1, ordinal))
    sums = prefix_sums(data, False)
    inverse = powers(INVERSE, len(data) + 1)
    raw = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))
    dup = _first_seen(line_doc, raw)[0]
    line = np.zeros(len(low) + 1, U64)
    np.cumsum(low * powers(_LINE, len(low) + 1)[: len(low)], out=line[1:])
    normal = mix((line[w1] - line[w0]) * powers(_LINE_INVERSE, len(low) + 1)[w0] + (w1 - w0).astype(U64))
    n_docs = len(offsets) - 1
    return {"n_words": words.counts(), "word_chars": np.diff(chars[offsets]), "n_symbols": np.diff(symbols[offsets]),
            "n_dup_lines": np.bincount(line_doc[dup], minlength=n_docs), "n_repeat_words": _repeat_words(words),
            "line_first": np.searchsorted(line_doc, np.arange(n_docs + 1)), "line": normal, "line_words": w1 - w0, "ordinal": ordinal}


NUMBERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in text_chunks(batch.column(2)):
            f = _figures(data, offsets)
            lists = [pa.ListArray.from_arrays(pa.array(f["line_first"], pa.int32()), pa.array(v))
                     for v in (f["line"].view(np.int64), f["line_words"].astype(np.int64), f["ordinal"].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                 *[pa.array(f[c], pa.int64()) for c in NUMBERS], *lists],
                ["id", "host", *NUMBERS, "line", "line_words", "ordinal"])


def line_frequency(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text",
                   max_documents: int = MAX_DOCUMENTS, min_words: int = MIN_WORDS, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per document: id, the base figures, ``base_failed``, ``kept``,
    ``removed_words`` and ``removed_lines`` (numbers of its lines, from 0)."""
    rows = identified(docs, id_col, host_col, text_col).toDF("id", "host", "text")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = (f"id {types['id']}, host {types['host']}, " + ", ".join(f"{c} long" for c in NUMBERS)
              + ", line array<long>, line_words array<long>, ordinal array<long>")
    figures = materialize(rows.mapInArrow(_analyse, schema).withColumn("row", F.monotonically_increasing_id()), "figures")
    lines = figures.select("row", F.xxhash64(F.col("host").isNull(), "host").alias("host"),
                           F.explode(F.arrays_zip("line", "line_words", "ordinal")).alias("l"))
    lines = lines.select("row", F.xxhash64("host", "l.line").alias("line"), "l.line_words", "l.ordinal")
    # Distinct lines within a row, so that counting rows counts documents; rows
    # that repeat an id give each of their lines once.
    distinct = flag_repeats(figures).select(F.xxhash64(F.col("host").isNull(), "host").alias("host"), "again", "id",
                                            F.explode(F.array_distinct("line")).alias("l"))
    distinct = distinct.select(F.xxhash64("host", "l").alias("line"), "again", "id")
    seen = distinct.where("not again").select("line").unionAll(distinct.where("again").select("line", "id").distinct().select("line"))
    frequent = seen.groupBy("line").agg(F.count("*").alias("documents")).where(F.col("documents") > max_documents).select("line")
    removed = (lines.join(frequent, "line", "left_semi").groupBy("row")
               .agg(F.sum("line_words").alias("removed_words"), F.sort_array(F.collect_list("ordinal")).alias("removed_lines")))
    out = figures.select("row", "id", *NUMBERS).join(removed, "row", "left").withColumns({
        "removed_words": F.coalesce("removed_words", F.lit(0)),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)})
    left = F.col("n_words") - F.col("removed_words")
    depleted = (left < min_words) | (left < F.col("n_words") * min_left)
    return out.select(F.col("id").alias(id_col), *NUMBERS, "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"),
                      "removed_words", F.coalesce("removed_lines", F.array().cast("array<long>")).alias("removed_lines"))


def without_lines(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept documents, their text without the removed lines. Ids must be unique."""
    marks = verdicts.where("kept").select(F.col(id_col).alias("id"), "removed_lines")
    packed = docs.select(F.struct(*docs.columns).alias("doc"), docs[id_col].alias("id"), F.split(docs[text_col], "\n").alias("lines"))
    joined = packed.join(marks, "id")
    left = F.filter("lines", lambda x, i: ~F.array_contains(F.col("removed_lines"), i.cast("long")))
    text = F.when(F.size("removed_lines") == 0, F.col(f"doc.{text_col}")).otherwise(F.array_join(left, "\n"))
    return joined.select(F.col("doc").withField(text_col, text).alias("doc")).select("doc.*")
