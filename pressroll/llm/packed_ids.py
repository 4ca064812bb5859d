"""Token ids in Simple-8b words, written and read back by Spark.

Simple-8b: every 64-bit word starts (low bits) with a 4-bit selector that says
how many ids of how many bits fill the other 60. Ids are coded in blocks of
``BLOCK``; the last word of a block may be partly filled. A segment holds whole
documents; its payload is

    magic, number of ids, words and escapes    four 64-bit numbers
    word offset of each block                  32 bits each
    words                                      64 bits each
    escapes                                    64 bits each

so that all blocks are encoded and decoded side by side with numpy. An id of
2**60 or more is a word with selector 0, its value stands in the escapes, in order.

The file format is Parquet with one row per segment (``shard``, ``segment``,
ids ``before`` it in the shard, ids and lengths of its documents, ``payload``); shards and segments are in
ascending order of document ids, null ids last, ties by text.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pressroll.llm.common import identified, text_chunks
from pressroll.session import bound_batches, work_dir

BLOCK = 128
#: Ids a segment holds at least before it is closed (whole documents only).
SEGMENT_IDS = 1 << 18
TEXT_BYTES = 4 << 20
MAGIC = 0x31_42_38_53
#: Selector k (from 1 on): so many ids of so many bits.
FIXED = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([1] + [n for n, _ in FIXED], np.int64)
U64 = np.uint64

#: How a byte-level tokenizer writes a space, and every byte, as a character (UTF-32).
SPACED = "\u0120"
_shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = np.zeros(256, "<u4")
BYTE_CHARS[_shown] = _shown
BYTE_CHARS[BYTE_CHARS == 0] = 256 + np.arange(256 - len(_shown))
#: Kinds of bytes: above ASCII, space, ASCII letter, other visible ASCII, line feed, other ASCII.
HIGH, BLANK, LETTER, MARK, LINE, CONTROL = range(6)
BYTE_KIND = np.full(256, HIGH, np.uint8)
BYTE_KIND[:128], BYTE_KIND[33:127], BYTE_KIND[10], BYTE_KIND[32] = CONTROL, MARK, LINE, BLANK
BYTE_KIND[65:91] = BYTE_KIND[97:123] = LETTER
WORD = "^ [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"


def encode_ids(ids: np.ndarray) -> bytes:
    """The payload of one segment."""
    ids = np.ascontiguousarray(ids, U64)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    padded = np.zeros(blocks * BLOCK + 60, U64)
    padded[:n] = ids
    width = np.frexp(padded[: blocks * BLOCK].astype(np.float64))[1].astype(np.uint8)
    width[padded[: blocks * BLOCK] >= U64(1 << 60)] = 64
    wide = np.zeros((blocks, BLOCK + 60), np.uint8)  # beyond a block's end anything fits
    wide[:, :BLOCK] = width.reshape(blocks, BLOCK)
    most = {1: wide}  # widest of the next 1, 2, 4, ... ids
    for k in (1, 2, 4, 8, 16):
        m = most[k].copy()
        m[:, :-k] = np.maximum(most[k][:, :-k], most[k][:, k:])
        most[2 * k] = m
    choice = np.zeros((blocks, BLOCK), np.uint8)
    for selector in range(len(FIXED), 0, -1):
        count, bits = FIXED[selector - 1]
        k = 1 << (count.bit_length() - 1)
        widest = np.maximum(most[k][:, :BLOCK], most[k][:, count - k : count - k + BLOCK])
        choice[widest <= bits] = selector
    # All blocks advance by one word at a time.
    length = np.full(blocks, BLOCK, np.int64)
    if blocks:
        length[-1] = n - (blocks - 1) * BLOCK
    live, at, used = np.arange(blocks), np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)
    steps = []
    while len(live):
        selector = choice[live, at[live]]
        steps.append((live, at[live].copy(), selector, used[live].copy()))
        used[live] += 1
        at[live] += COUNTS[selector]
        live = live[at[live] < length[live]]
    offset = np.zeros(blocks + 1, np.int64)
    np.cumsum(used, out=offset[1:])
    words, place = np.zeros(offset[-1], U64), np.zeros(offset[-1], np.int64)
    if steps:
        slot = np.concatenate([offset[b] + u for b, _, _, u in steps])
        place[slot] = np.concatenate([b * BLOCK + a for b, a, _, _ in steps])
        words[slot] = np.concatenate([s for _, _, s, _ in steps])
    selectors = words.astype(np.uint8)
    apart = np.zeros((blocks, BLOCK + 60), U64)  # zeros after each block's ids
    apart[:, :BLOCK] = padded[: blocks * BLOCK].reshape(blocks, BLOCK)
    apart, source = apart.reshape(-1), place + place // BLOCK * 60
    for selector, (count, bits) in enumerate(FIXED, 1):
        some = np.flatnonzero(selectors == selector)
        at, word = source[some], np.full(len(some), selector, U64)
        for j in range(count if len(some) else 0):
            word |= apart[at + j] << U64(4 + bits * j)
        words[some] = word
    escapes = padded[place[selectors == 0]]
    head = np.array([MAGIC, n, len(words), len(escapes)], U64)
    return head.tobytes() + offset[:-1].astype(np.uint32).tobytes() + words.tobytes() + escapes.tobytes()


def decode_ids(payload: bytes) -> np.ndarray:
    """The ids of a segment, all words at once."""
    magic, n, n_words, n_escapes = (int(x) for x in np.frombuffer(payload, U64, 4))
    if magic != MAGIC:
        raise ValueError("not a segment of packed ids")
    blocks = -(-n // BLOCK)
    offset = np.frombuffer(payload, np.uint32, blocks, 32).astype(np.int64)
    words = np.frombuffer(payload, U64, n_words, 32 + 4 * blocks)
    escapes = np.frombuffer(payload, U64, n_escapes, 32 + 4 * blocks + 8 * n_words)
    out = np.zeros(blocks * BLOCK + 60, U64)
    selectors = (words & U64(15)).astype(np.int64)
    counts = COUNTS[selectors]
    before = np.cumsum(counts) - counts
    used = np.diff(np.append(offset, n_words))
    block = np.repeat(np.arange(blocks), used)
    place = before - before[offset][block] + block * BLOCK if blocks else before
    # Ascending place: what a block's last word has beyond the block is written over by the next block.
    for selector, (count, bits) in enumerate(FIXED, 1):
        some = np.flatnonzero(selectors == selector)
        mask = U64((1 << bits) - 1)
        for j in range(count if len(some) else 0):
            target = place[some] + j
            inside = target < (block[some] + 1) * BLOCK
            out[target[inside]] = (words[some[inside]] >> U64(4 + bits * j)) & mask
    out[place[selectors == 0]] = escapes
    return out[:n]


class Encoder:
    """Ids of texts by a public byte-level tokenizer.

    A piece of the tokenizer's pattern starts at every space that is followed by
    anything but white space, so the stretches between such spaces can be
    encoded apart from each other. The usual pattern (``ByteLevel``) also ends a
    piece between a letter and an ASCII character that is none, and after a
    single line feed before a letter: a word is one unit whatever mark follows
    it. Units begin with their space. Their places are found in the bytes of a
    batch, Arrow numbers the distinct ones, so Python sees each of these once;
    ``limit`` of them are remembered. A text with white space after a space is
    cut by a pattern, and one that holds an added token of the tokenizer
    (``<|endoftext|>``) goes through the library as a whole (noted as a tuple)."""

    def __init__(self, path: str, end_id: int, limit: int = 500_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self.whole, self.tokenizer = path, None, Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.encode_special_tokens = True  # stretches hold none; joined ones shall not make one
        size = self.tokenizer.get_vocab_size()
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith(SPACED) for i in range(size)])
        self.end_id, self.limit = end_id, limit
        parts = json.loads(self.tokenizer.to_str())
        self.fine = parts["normalizer"] is None and parts["pre_tokenizer"] is not None and {
            k: parts["pre_tokenizer"].get(k) for k in ("type", "add_prefix_space", "use_regex")} == {
            "type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.letters = None
        if self.fine:  # words of letters alone are pieces already: no pattern is needed
            self.letters = Tokenizer.from_str(json.dumps(parts))
            self.letters.encode_special_tokens = True
            self.letters.pre_tokenizer = pre_tokenizers.Split(SPACED, "merged_with_next")
        self._clear()

    def _clear(self) -> None:
        self.known: dict = {}
        self.ids, self.n_ids = np.zeros(1 << 12, np.uint32), 0
        self.first = np.zeros(1 << 10, np.int64)

    def _encode_each(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of each unit."""
        got = [x.ids for x in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)

    def _learn(self, column: pa.Array) -> np.ndarray:
        """Encode and note units that are not known yet; their numbers."""
        plain = pc.match_substring_regex(column, WORD).to_numpy(zero_copy_only=False) if self.fine else np.zeros(len(column), bool)
        spaced = pc.match_substring_regex(column, "^ [^ ]+$").to_numpy(zero_copy_only=False) & ~plain
        number = np.empty(len(column), np.int64)
        for which, tokenizer in ((plain, self.letters), (spaced, self.tokenizer), (~plain & ~spaced, None)):
            units = _strings(column.filter(pa.array(which)))
            if not units:
                continue
            number[which] = len(self.known) + np.arange(len(units))
            if tokenizer is not None:
                # Each holds one space, its first byte: a token that starts with a space begins the next.
                text = "".join(units)
                if tokenizer is self.letters:
                    text = BYTE_CHARS[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")
                ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                begins = np.flatnonzero(self.spaced[ids])
                if len(begins) == len(units):
                    self._note(units, ids, np.diff(np.append(begins, len(ids))))
                    continue
            self._note(units, *self._encode_each(units))
        return number

    def _note(self, units: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.known)
        self.known.update(zip(units, range(n, n + len(units)), strict=True))
        self.ids = _room(self.ids, self.n_ids + len(ids))
        self.first = _room(self.first, n + len(units) + 1)
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.first[n + 1 : n + len(units) + 1] = np.cumsum(lengths) + self.n_ids
        self.n_ids += len(ids)

    def _numbers(self, column: pa.Array) -> np.ndarray:
        """Numbers of distinct units, of those not known yet after they are learned."""
        units = _strings(column)
        found = np.fromiter(map(self.known.get, units, itertools.repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            found[missing] = self._learn(column.take(pa.array(missing)))
        return found

    def _forget(self, used: np.ndarray) -> None:
        """Keep only the units with these numbers."""
        keep = np.zeros(len(self.known), bool)
        keep[used] = True
        units = list(itertools.compress(self.known, keep.tolist()))
        first, length = self.first[:-1][: len(keep)][keep], np.diff(self.first[: len(keep) + 1])[keep]
        before = np.cumsum(length) - length
        ids = self.ids[np.arange(length.sum()) + np.repeat(first - before, length)]
        self._clear()
        self._note(units, ids, length)

    def _cut_by_arrow(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of every unit of texts that split at single spaces, and how many each has."""
        ((_, _, data, offsets),) = text_chunks(column, 1 << 31) if len(column) else ((0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64)),)
        kind = BYTE_KIND[data]
        cut = kind == BLANK
        if self.fine and len(data) > 2:
            letter = kind == LETTER
            # A letter of two bytes: U+00C0 to U+00FF without the two signs among them.
            after = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            ends = letter.copy()
            ends[1:] |= after
            cut[1:] |= ends[:-1] & (kind[1:] >= MARK)
            cut[2:] |= ((kind[:-2] == LETTER) | (kind[:-2] == MARK)) & (kind[1:-1] == LINE) & letter[2:]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(cut)
        places = np.append(start, len(data)).astype(np.int32)
        units = pa.StringArray.from_buffers(len(start), pa.py_buffer(places), pa.py_buffer(data)).dictionary_encode()
        number = self._numbers(units.dictionary)
        return number[units.indices.to_numpy()], np.diff(np.searchsorted(start, offsets))

    def _cut_by_pattern(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces = [[x for x in SPLIT.split(text) if x] for text in _strings(column)]
        units = pa.array([x for p in pieces for x in p], pa.string()).dictionary_encode()
        return self._numbers(units.dictionary)[units.indices.to_numpy()], np.array([len(p) for p in pieces], np.int64)

    def _take_whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        texts = _strings(column)
        for t in [t for t in dict.fromkeys(texts) if (t,) not in self.known]:
            ids = np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32)
            self._note([(t,)], ids, np.array([len(ids)]))
        return np.array([self.known[(t,)] for t in texts], np.int64), np.ones(len(texts), np.int64)

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), each closed by the end id, and where each begins."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        way = pc.match_substring_regex(column, UNEVEN).to_numpy(zero_copy_only=False).astype(np.int8)
        for token in self.added:
            way[pc.match_substring(column, token).to_numpy(zero_copy_only=False)] = 2
        found, count, text = [], np.zeros(len(column), np.int64), []
        for k, cut in enumerate((self._cut_by_arrow, self._cut_by_pattern, self._take_whole)):
            rows = np.flatnonzero(way == k)
            if len(rows):
                some = column if len(rows) == len(column) else column.take(pa.array(rows))
                numbers, count[rows] = cut(some)
                found.append(numbers)
                text.append(rows)
        units = np.concatenate(found) if found else np.zeros(0, np.int64)
        if len(found) > 1:
            owner = np.concatenate([np.repeat(rows, count[rows]) for rows in text])
            units = units[np.argsort(owner, kind="stable")]
        length = self.first[units + 1] - self.first[units]
        before = np.zeros(len(units) + 1, np.int64)
        np.cumsum(length, out=before[1:])
        last = before[np.cumsum(count)]
        # One id more for each text: what comes after it moves on by one.
        source = np.arange(before[-1]) + np.repeat(self.first[units] - before[:-1], length)
        ids = np.empty(before[-1] + len(count), np.uint32)
        ends = last + np.arange(len(count))
        inside = np.ones(len(ids), bool)
        inside[ends] = False
        ids[inside] = self.ids[source]
        ids[ends] = self.end_id
        if len(self.known) > self.limit:  # what this batch holds is likely in the next
            self._forget(units)
        return ids, np.append(0, ends + 1)


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _room(held: np.ndarray, size: int) -> np.ndarray:
    """The same values with room for ``size`` of them at least."""
    if size <= len(held):
        return held
    grown = np.zeros(max(size, 2 * len(held)), held.dtype)
    grown[: len(held)] = held
    return grown


_encoders: dict[tuple, Encoder] = {}


def _encoder(tokenizer: str, end_id: int) -> Encoder:
    """One encoder per Python worker: what it remembers serves later tasks too."""
    if (tokenizer, end_id) not in _encoders:
        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer)
        _encoders[tokenizer, end_id] = Encoder(path, end_id)
    return _encoders[tokenizer, end_id]


#: A space before white space or the end (of any kind the tokenizer's pattern may know).
UNEVEN = r" ([\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]|\z)"
SPLIT = re.compile(r"(?= \S)")


def _packer(tokenizer: str, end_id: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, end_id)
        shard, number, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def segment() -> pa.RecordBatch:
            docs = pa.concat_arrays([d for d, _, _ in held])
            lengths = np.concatenate([n for _, n, _ in held])
            payload = encode_ids(np.concatenate([i for _, _, i in held]))
            edges = pa.array([0, len(docs)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number]), pa.array([before]), pa.array([int(lengths.sum())]), pa.ListArray.from_arrays(edges, docs),
                 pa.ListArray.from_arrays(edges, pa.array(lengths, pa.int64())), pa.array([payload], pa.binary())],
                ["shard", "segment", "before", "n_ids", "doc_ids", "lengths", "payload"])

        for batch in batches:
            texts = batch.column("text")
            size = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)))
            row = 0
            while row < len(texts):
                end = max(row + 1, int(np.searchsorted(size, size[row] + TEXT_BYTES)))
                end = min(end, len(texts))
                ids, first = encoder.encode(texts.slice(row, end - row))
                # Close a segment at the document that fills it.
                done = row
                while done < end:
                    room = SEGMENT_IDS - sum(len(i) for _, _, i in held)
                    stop = int(np.searchsorted(first, first[done - row] + max(1, room)))
                    stop = min(end, row + max(stop, done - row + 1))
                    lo, hi = done - row, stop - row
                    held.append((batch.column("id").slice(done, stop - done), np.diff(first[lo : hi + 1]), ids[first[lo] : first[hi]]))
                    done = stop
                    if sum(len(i) for _, _, i in held) >= SEGMENT_IDS:
                        yield segment()
                        before += sum(len(i) for _, _, i in held)
                        held, number = [], number + 1
                row = end
        if held:
            yield segment()

    return pack


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
              tokenizer: str = "byte_bpe_50k.json", end_id: int = 2) -> None:
    """Encode every text (null: empty), close it with ``end_id`` and write the
    segments to ``path`` in ascending order of ids."""
    bound_batches(docs.sparkSession)
    rows = identified(docs, id_col, text_col).toDF("id", "text")
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["id"].dataType.simpleString()
    ordered = rows.repartitionByRange(shards, F.col("id").asc_nulls_last()).sortWithinPartitions(
        F.col("id").asc_nulls_last(), F.col("text").asc_nulls_first())
    ordered.mapInArrow(_packer(tokenizer, end_id), f"shard int, segment long, before long, n_ids long, doc_ids array<{kind}>, "
                       "lengths array<long>, payload binary").write.option("compression", "zstd").parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = decode_ids(batch.column("payload")[i].as_py()).astype("<u4")
            docs, lengths = batch.column("doc_ids")[i].values, batch.column("lengths")[i].values.to_numpy()
            first = np.zeros(len(lengths) + 1, np.int64)
            np.cumsum(lengths, out=first[1:])
            crc = [zlib.crc32(ids[a:b].data) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [docs, pa.array(first[:-1] + batch.column("start")[i].as_py()), pa.array(lengths), pa.array(crc, pa.int64())],
                ["id", "start", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per written document: id, ``start`` (ids before it), ``n_tokens``,
    ``ids_crc32`` (of its ids as little-endian 32-bit integers)."""
    segments = spark.read.parquet(path)
    # One row per shard, that is per task that wrote: broadcast, so the payloads stay where they are.
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    starts = totals.select("shard", (F.sum("ids").over(W.orderBy("shard")) - F.col("ids")).alias("shard_start"))
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    placed = segments.join(F.broadcast(starts), "shard").select(
        (F.col("shard_start") + F.col("before")).alias("start"), "doc_ids", "lengths", "payload")
    return placed.mapInArrow(_reader, f"id {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write the texts' ids to a fresh folder of the shared folder and read them back."""
    path = work_dir(docs.sparkSession, "packed-ids")
    write_ids(docs, path, id_col, text_col, **options)
    return read_ids(docs.sparkSession, path, id_col)
