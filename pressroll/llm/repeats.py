"""Exact removal of repeated byte strings by bucket-pointer refinement.

Removed is every byte covered by a string of ``LENGTH`` (50) bytes that also
starts in a document with a smaller id. Strings (windows) are sorted into
buckets as in suffix sorting by bucket-pointer refinement: the bucket identifier of a
string at a position is refined with the identifier at a later offset to one of
the longer string, from 1 to 2, 4, 8, 16, 25 and 50 bytes, each step reusing the
identifiers of the one before. A bucket that cannot hold a repeat is not refined
further. To spare most positions:

1. Initial q-gram buckets. Of the 26 q-grams (q = 25) in a window only the one
   with the smallest identifier, its anchor, stands for it, so equal windows
   have equal anchors. Neighbouring windows share an anchor; such a run is one
   row, refined at once by the identifiers of its first and last window (which
   cover all of it): equal runs hold equal windows.
2. Rows meet by anchor. In a class of equal runs all but those of the smallest
   document are repeats. An anchor bucket whose classes have one smallest
   document is finished.
3. The runs left over in other buckets are refined to single windows, which
   meet by anchor and window identifier.

Each task sends one document's rows per class: whatever is repeated inside its
own input is settled there, so a string found in a third of all documents costs
one row a task. A task sends at most ``CLASSES`` classes of an anchor; further
ones skip step 2. Identifiers are 40 bits of the anchor and 56 of the run or
window together.

Edge cases: null or empty text has no bytes; texts under 50 bytes keep all; a
null id is compared with nothing and keeps all; rows that repeat an id are not
smaller than each other and each judged (64 bits of the text tell them apart);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroll.llm.common import U64, flag_repeats, identified, join_ids, materialize, mix, rolling, text_chunks
from pressroll.session import bound_batches

LENGTH, GRAM = 50, 25
GRAMS = LENGTH - GRAM + 1
#: Most classes of one anchor that a task sends to its bucket; of more it sends a mark.
CLASSES = 64
#: Bytes of text hashed at a time, rows whose repeats a task settles at a time,
#: and buckets of runs per partition.
CHUNK, ROWS, BUCKETS = 1 << 18, 1 << 18, 16
#: Windows of a longer text whose runs are found at a time; places have 26 bits.
PIECE = 1 << 24

SPAN = "doc long, mark long, start long, n int, anchor long, open boolean"
#: A row: anchor, class, document, mark of its text (0 where no other row has its id), first window, number of
#: windows (0: a mark), and a byte for what stands left and right of the anchor (0: nothing).
FIELDS = ("anchor", "unit", "doc", "mark", "start", "n", "left", "right")
WIDTH = {"anchor": 5, "unit": 7, "doc": 8, "mark": 8, "start": 5, "n": 4, "left": 1, "right": 1}
#: A window holds so many bytes on one side of its anchor at least.
SIDE = (LENGTH - GRAM + 1) // 2
Rows = dict[str, np.ndarray]


def _pack(rows: Rows) -> bytes:
    """Numbers as byte planes, which the shuffle's compression shrinks well; the
    upper planes of a field that hold nothing are left out."""
    n = len(rows["doc"])
    head, out = [n], []
    for name in FIELDS:
        planes = np.ascontiguousarray(rows[name].astype(np.int64)).view(np.uint8).reshape(n, 8).T
        used = WIDTH[name]
        while used and not planes[used - 1].any():
            used -= 1
        head.append(used)
        out.append(np.ascontiguousarray(planes[:used]).tobytes())
    return np.array(head, np.int64).tobytes() + b"".join(out)


def _unpack(blobs: list[bytes]) -> Rows:
    parts: dict[str, list[np.ndarray]] = {name: [np.zeros(0, np.int64)] for name in FIELDS}
    for blob in blobs:
        n, *used = np.frombuffer(blob, np.int64, 1 + len(FIELDS)).tolist()
        at = 8 * (1 + len(FIELDS))
        for name, width in zip(FIELDS, used, strict=True):
            planes = np.zeros((n, 8), np.uint8)
            planes[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
            parts[name].append(planes.view(np.int64).reshape(n))
            at += n * width
    return {name: np.concatenate(p) for name, p in parts.items()}


def _take(rows: Rows, which: np.ndarray) -> Rows:
    return {name: v[which] for name, v in rows.items()}


def _whole(held: list[Rows]) -> Rows:
    """The rows as one, a field at a time: what was held is given up on the way."""
    return {name: np.concatenate([rows.pop(name) for rows in held]) for name in FIELDS}


def _classes(rows: Rows) -> tuple[Rows, np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by anchor, class and document; whether a row starts an anchor
    or a class; the smallest document of each row's class."""
    rows = _take(rows, np.lexsort((rows["doc"], rows["unit"], rows["anchor"])))
    anchor = np.ones(len(rows["doc"]), bool)
    anchor[1:] = rows["anchor"][1:] != rows["anchor"][:-1]
    unit = anchor.copy()
    unit[1:] |= rows["unit"][1:] != rows["unit"][:-1]
    least = rows["doc"][np.flatnonzero(unit)][np.cumsum(unit) - 1] if len(unit) else rows["doc"]
    return rows, anchor, unit, least


def _spans(rows: Rows, unsure: bool) -> Iterator[pa.RecordBatch]:
    n = len(rows["doc"])
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["doc"]), pa.array(rows["mark"]), pa.array(rows["start"]), pa.array(rows["n"].astype(np.int32)),
             pa.array(rows["anchor"]), pa.array(np.full(n, unsure))], ["doc", "mark", "start", "n", "anchor", "open"])


def _send(rows: Rows, buckets: int, refine: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a run of texts to their buckets, what is settled here as kind 1
    (repeats) or 2 (to be refined to windows)."""
    rows, anchor, unit, least = _classes(rows)
    again = rows["doc"] > least
    many, marks = np.zeros(len(again), bool), np.zeros(0, np.int64)
    if refine and len(again):
        first = np.flatnonzero(anchor)
        over = np.add.reduceat(unit, first, dtype=np.int64) > CLASSES
        many, marks = over[np.cumsum(anchor) - 1], first[over]
    marked = _take(rows, marks) | {"n": np.zeros(len(marks), np.int64)}
    out: list[tuple[int, int, bytes]] = []
    for kind, which in ((1, again), (2, many & ~again)):
        if which.any():
            some = _take(rows, np.flatnonzero(which))
            some = _take(some, np.lexsort((some["start"], some["doc"])))
            out.append((int(some["doc"][0]) % buckets, kind, _pack(_joined(some) if kind == 1 else some)))
    left = np.flatnonzero(~again & ~many)
    rows = {name: np.concatenate([rows.pop(name)[left], marked[name]]) for name in FIELDS}
    # Equal windows share their own identifier, runs to be compared only the anchor.
    key = rows["anchor"] if refine else rows["unit"] >> 16
    bucket = (key.astype(U64) * U64(buckets) >> U64(40)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = _take(rows, order), bucket[order]
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.unique(bucket).tolist():
        out.append((b, 0, _pack({name: v[edges[b] : edges[b + 1]] for name, v in rows.items()})))
    del rows, again, least, anchor, unit, many, marked, left, key, bucket, order  # the task goes on while these are sent
    if out:
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for b, _, _ in out], pa.int32()), pa.array([k for _, k, _ in out], pa.int32()),
             pa.array([x for _, _, x in out], pa.binary())], ["bucket", "kind", "rows"])


def _joined(rows: Rows) -> Rows:
    """Repeats in order of document and place: runs that continue each other as one."""
    new = np.ones(len(rows["doc"]), bool)
    new[1:] = ((rows["doc"][1:] != rows["doc"][:-1]) | (rows["mark"][1:] != rows["mark"][:-1])
               | (rows["start"][1:] != (rows["start"] + rows["n"])[:-1]))
    first = np.flatnonzero(new)
    out = _take(rows, first)
    out["n"] = np.add.reduceat(rows["n"], first) if len(first) else rows["n"]
    return out


def _several(rows: Rows, side: str, least: np.ndarray) -> np.ndarray:
    """Whether classes of another smallest document have the same anchor and side."""
    order = np.lexsort((rows[side], rows["anchor"]))
    key = rows["anchor"][order] * 256 + rows[side][order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    low, high = np.minimum.reduceat(least[order], first), np.maximum.reduceat(least[order], first)
    out = np.zeros(len(key), bool)
    out[order] = (low < high)[np.cumsum(new) - 1]
    return out & (rows[side] > 0)


def _parts(blobs: list[bytes], key: str) -> Iterator[Rows]:
    """A bucket's rows; of many rows, those of a part of the keys at a time."""
    parts = 1 + sum(int(np.frombuffer(blob, np.int64, 1)[0]) for blob in blobs) // ROWS
    for part in range(parts):
        if parts == 1:
            yield _unpack(blobs)
            continue
        yield _whole([_take(rows, np.flatnonzero(rows[key] % parts == part)) for rows in (_unpack([blob]) for blob in blobs)])


def _meet(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Settle one bucket after the other of a partition sorted by bucket."""
    held: list[bytes] = []
    current = None

    def settle(rows: Rows) -> Iterator[pa.RecordBatch]:
        marked = np.unique(rows["anchor"][rows["n"] == 0])
        rows, _, _, least = _classes(_take(rows, np.flatnonzero(rows["n"])))
        if len(least):
            again = rows["doc"] > least
            several = _several(rows, "left", least) | _several(rows, "right", least) | np.isin(rows["anchor"], marked)
            yield from _spans(_take(rows, np.flatnonzero(again)), False)
            yield from _spans(_take(rows, np.flatnonzero(several & ~again)), True)

    for batch in batches:
        for bucket, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind:
                yield from _spans(_unpack([blob]), kind == 2)
                continue
            if bucket != current:
                for rows in _parts(held, key):
                    yield from settle(rows)
                held, current = [], bucket
            held.append(blob)
    for rows in _parts(held, key):
        yield from settle(rows)


def _window(short: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bucket identifier of the 50 bytes at ``at``, from that of the 25 bytes
    there refined by that of the 25 bytes after them."""
    return join_ids(short[at], short[at + (LENGTH - GRAM)])


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each ``size`` consecutive values."""
    length = 1
    while length < size:
        step = min(length, size - length)
        values = np.minimum(values[:-step], values[step:])
        length += step
    return values


def _runs(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, marks: np.ndarray) -> Rows:
    """The runs of windows with one anchor of a sequence of texts."""
    counts = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    if not counts.sum():
        return {name: np.zeros(0, np.int64) for name in FIELDS}
    eight = rolling(data, 8)
    sixteen = join_ids(eight[:-8], eight[8:])
    short = join_ids(sixteen[: 16 - GRAM], sixteen[GRAM - 16 :])
    # Order of the q-grams: 38 bits of the identifier, then the place (a piece has fewer bytes).
    places = np.arange(len(short), dtype=U64)
    anchors = _least((mix(short) >> U64(26) << U64(26)) | places, GRAMS) & U64((1 << 26) - 1)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[text]
    mine = anchors[at].astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (mine[1:] != mine[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    start, end = at[first], at[last]
    unit = mix(join_ids(_window(short, start), _window(short, end)) + (end - start).astype(U64))
    middle = mine[first]
    side = lambda p: join_ids(eight[p], eight[p + (SIDE - 8)]) % U64(255) + U64(1)
    left, right = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    has = start <= middle - SIDE
    left[has] = side(middle[has] - SIDE)
    has = end > middle - SIDE
    right[has] = side(middle[has] + GRAM)
    return {"left": left, "right": right, "anchor": (mix(short[middle] + U64(3)) >> U64(24)).astype(np.int64), "unit": (unit >> U64(8)).astype(np.int64),
            "doc": docs[text[first]], "mark": marks[text[first]], "start": start - offsets[text[first]], "n": end - start + 1}


def _sent(parts: Iterator[Rows], buckets: int, refine: bool) -> Iterator[pa.RecordBatch]:
    """Send rows as soon as there are ``ROWS`` of them, and the rest."""
    held: list[Rows] = []
    for part in parts:
        held.append(part)
        if sum(len(p["doc"]) for p in held) >= ROWS:
            yield from _send(_whole(held), buckets, refine)
            held = []
    if held:
        yield from _send(_whole(held), buckets, refine)


def _find_runs(buckets: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
        for batch in batches:
            docs, marks = batch.column("doc").to_numpy(), batch.column("mark").to_numpy().astype(np.int64)
            for lo, hi, data, offsets in text_chunks(batch.column("text"), CHUNK):
                if len(data) <= PIECE:
                    yield _runs(data, offsets, docs[lo:hi], marks[lo:hi])
                    continue
                # One long text: pieces that share no window; runs cut at their edges still share their windows' sides.
                for at in range(0, len(data) - LENGTH + 1, PIECE):
                    piece = data[at : at + PIECE + LENGTH - 1]
                    part = _runs(piece, np.array([0, len(piece)]), docs[lo:hi], marks[lo:hi])
                    yield part | {"start": part["start"] + at}

    return lambda batches: _sent(runs(batches), buckets, True)


def _find_windows(buckets: int):
    """Single windows of the runs that are still open."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
        for batch in batches:
            docs, marks = batch.column("doc").to_numpy(), batch.column("mark").to_numpy().astype(np.int64)
            runs = batch.column("runs")
            for lo, hi, data, offsets in text_chunks(batch.column("text"), CHUNK):
                short = rolling(data, GRAM)
                part = runs.slice(lo, hi - lo)
                flat, sizes = part.flatten(), np.diff(part.offsets.to_numpy())
                row = np.repeat(np.arange(hi - lo), sizes)
                n = flat.field("n").to_numpy().astype(np.int64)
                start = np.repeat(flat.field("start").to_numpy(), n)
                start = start + np.arange(len(start)) - np.repeat(np.cumsum(n) - n, n)
                row, anchor = np.repeat(row, n), np.repeat(flat.field("anchor").to_numpy(), n)
                unit = (mix(_window(short, start + offsets[row])) >> U64(8)).astype(np.int64)
                none = np.zeros(len(row), np.int64)
                yield {"anchor": anchor, "unit": unit, "doc": docs[lo:hi][row], "mark": marks[lo:hi][row], "start": start,
                       "n": none + 1, "left": none, "right": none}

    return lambda batches: _sent(windows(batches), buckets, False)


def _settled(sent: DataFrame, partitions: int, key: str) -> DataFrame:
    spread = sent.withColumn("part", F.col("bucket") % partitions).repartition(partitions, "part")
    return spread.sortWithinPartitions("bucket").select("bucket", "kind", "rows").mapInArrow(lambda batches: _meet(batches, key), SPAN)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``text`` (as bytes) and ``spans``: the maximal
    runs of removed bytes as an array of (start, end)."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = flag_repeats(identified(docs, id_col, text_col).toDF("id", "text"))
    # Zero where the id is the row's own, but no constant: as one it would be
    # optimised away on one side, and the texts shuffled twice.
    doc = F.col("id").cast("long")
    mark = F.coalesce(F.when(F.col("again"), F.xxhash64("text")), doc.bitwiseAND(F.lit(0)), F.lit(0))
    texts = rows.select(
        F.col("id"), doc.alias("doc"), mark.alias("mark"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = partitions * BUCKETS
    sent = "bucket int, kind int, rows binary"
    known = texts.where("doc is not null")
    spans = materialize(_settled(known.select("doc", "mark", "text").mapInArrow(_find_runs(buckets), sent), partitions, "anchor"), "runs")

    # One shuffle of the texts serves the open runs and the result.
    placed = texts.repartition(partitions, "doc", "mark")
    open_ = spans.where("open").groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "n", "anchor")).alias("runs"))
    open_texts = placed.join(open_, ["doc", "mark"]).select("doc", "mark", "text", "runs")
    # Few windows of every task go to each bucket, so there is one a partition.
    windows = _settled(open_texts.mapInArrow(_find_windows(partitions), sent), partitions, "unit").where("not open")
    repeats = spans.where("not open").select("doc", "mark", "start", "n").union(windows.select("doc", "mark", "start", "n"))
    listed = repeats.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "n")).alias("windows"))
    both = placed.join(listed, ["doc", "mark"], "left")
    kind = texts.schema["id"].dataType.simpleString()
    return both.select("id", "text", "windows").mapInArrow(
        _cover, f"id {kind}, text binary, spans array<struct<start:long,end:long>>").withColumnRenamed("id", id_col)


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal runs of bytes covered by repeated windows."""
    for batch in batches:
        windows = batch.column("windows")
        sizes = np.diff(windows.offsets.to_numpy()) if batch.num_rows else np.zeros(0, np.int64)
        if windows.null_count:
            sizes = np.where(windows.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
        flat = windows.flatten()
        row = np.repeat(np.arange(batch.num_rows), sizes)
        start = flat.field("start").to_numpy()
        end = start + flat.field("n").to_numpy() - 1 + LENGTH
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], end[order]
        # Ends only grow within a row's part once the largest so far is carried on.
        far = np.maximum.accumulate(end + row * (1 << 40)) - row * (1 << 40) if len(row) else end
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] > far[:-1])
        first = np.flatnonzero(new)
        stop = far[np.append(first[1:], len(row)) - 1] if len(first) else far
        edges = np.searchsorted(row[first], np.arange(batch.num_rows + 1)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(start[first]), pa.array(stop)], ["start", "end"])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("text"), pa.ListArray.from_arrays(pa.array(edges), pairs)], ["id", "text", "spans"])


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return b"".join([*out, text[at:]])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            spans = [(s["start"], s["end"]) for s in spans]
            rows.append((len(text), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept_bytes(text, spans)).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
            ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def digests(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of :func:`repeated_spans` the sizes and a digest of what is kept."""
    kind = removed.schema[id_col].dataType.simpleString()
    return removed.select(id_col, "text", "spans").mapInArrow(
        _digest, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)
