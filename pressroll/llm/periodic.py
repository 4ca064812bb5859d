"""Runs (maximal periodic stretches) of the words of each text.

A suffix automaton reads the words one by one. Its suffix-link tree is kept as
a link-cut forest whose preferred paths have one last end each: the states on
the path from a new prefix up to the root are exactly the suffixes of what was
read, and accessing that path recolours it segment by segment. A segment whose
last end was ``c``, with longest suffix of ``m`` words, says that these m words
ended at c before they ended at e: with d = e - c <= m the stretch of the m + d
words up to e has period d, and no smaller one, since c is the latest end. It is
as long to the left as that period goes; the last e that reports the same start
and period is where the run ends.

Before that, numpy finds the stretches where a run can be. A run of smallest
period q and at least ``max(min_length, min_periods * q)`` words holds each of
its k-word windows twice (k = 9 for the defaults), so only maximal stretches of
windows that repeat inside the stretch are read by the automaton; what is cut
away holds no run, and words there are compared by 64-bit hashes that can only
add stretches, never lose one. The automaton compares the bytes of words.

Edge cases: a null text has no words; a text is one unit of work whatever its
length, with about 40 bytes of state a word of a periodic stretch besides the
branching states; ids are passed through, null and repeated ones included;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroll.llm.common import U64, WORD, identified, mix, text_chunks, words_of

MIN_LENGTH, MIN_PERIODS = 24, 3
#: Times the stretches are narrowed to windows that repeat inside them.
ROUNDS = 4

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class LastEnds:
    """Suffix automaton with link-cut access to the last ends of its states.

    ``append`` reads a word and returns the (previous end, longest suffix) of
    every segment recoloured. The first transition of a state stands in arrays;
    states with more have a dictionary of the others.
    """

    def __init__(self) -> None:
        self.word, self.to, self.more = array("q", [-1]), array("q", [-1]), {}
        self.length, self.link = array("q", [0]), array("q", [-1])
        # Splay trees of the preferred paths, by length; ``up`` of a tree's root is the
        # state above the path, and its ``end`` the last end of all states of the path.
        self.left, self.right, self.up, self.end = array("q", [-1]), array("q", [-1]), array("q", [-1]), array("q", [-1])
        self.last, self.n = 0, 0

    def _state(self, length: int, above: int) -> int:
        for column, value in ((self.word, -1), (self.to, -1), (self.length, length), (self.link, above), (self.left, -1),
                              (self.right, -1), (self.up, above), (self.end, -1)):
            column.append(value)
        return len(self.length) - 1

    def _next(self, state: int, word: int) -> int:
        if self.word[state] == word:
            return self.to[state]
        others = self.more.get(state)
        return -1 if others is None else others.get(word, -1)

    def _lead(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _splay(self, x: int) -> None:
        left, right, up, end = self.left, self.right, self.up, self.end
        while True:
            p = up[x]
            if p < 0 or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                end[x] = end[g]  # what counts is the end at the root
                self._turn(p if (left[g] == p) == (left[p] == x) else x)
            else:
                end[x] = end[p]
            self._turn(x)

    def _turn(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner >= 0:
            up[inner] = p
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        up[p], up[x] = x, g

    def append(self, word: int) -> list[tuple[int, int]]:
        cur = self._state(self.n + 1, -1)
        p = self.last
        while p >= 0 and self._next(p, word) < 0:
            self._lead(p, word, cur)
            p = self.link[p]
        above = 0
        if p >= 0:
            q = above = self._next(p, word)
            if self.length[q] != self.length[p] + 1:
                above = self._split(p, q, word)
        self.link[cur] = self.up[cur] = above
        self.last = cur
        self.n += 1
        return self._access(cur)

    def _split(self, p: int, q: int, word: int) -> int:
        """A state for the shorter suffixes of ``q``, put above it into its path."""
        clone = self._state(self.length[p] + 1, self.link[q])
        self.word[clone], self.to[clone] = self.word[q], self.to[q]
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        self.link[q] = clone
        while p >= 0 and self._next(p, word) == q:
            self._lead(p, word, clone)
            p = self.link[p]
        self._splay(q)
        higher = self.left[clone] = self.left[q]
        if higher >= 0:
            self.up[higher] = clone
        self.left[q], self.up[clone] = clone, q
        return clone

    def _access(self, cur: int) -> list[tuple[int, int]]:
        right, up, end = self.right, self.up, self.end
        found = []
        below, x = cur, up[cur]
        while x >= 0:
            self._splay(x)
            found.append((end[x], self.length[x]))
            lower = right[x]
            if lower >= 0:
                end[lower] = end[x]
            right[x] = below
            below, x = x, up[x]
        end[below] = self.n - 1
        return found


def runs_of(words: list[int], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start, then period."""
    ends: dict[tuple[int, int], int] = {}
    automaton = LastEnds()
    for e, word in enumerate(words):
        for c, longest in automaton.append(word):
            if c >= 0 and longest >= (min_periods - 1) * (e - c):
                ends[e - longest - (e - c) + 1, e - c] = e
    return sorted((s, e - s + 1, q) for (s, q), e in ends.items() if e - s + 1 >= min_length)


def window_size(min_length: int, min_periods: int) -> int:
    """Words of the longest window that every run holds twice at its period's distance."""
    return min(max(min_length, min_periods * q) - 2 * q + 1 for q in range(1, min_length + 1))


def stretches(hashes: np.ndarray, text: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the maximal stretches of ``size``-word windows each
    of which repeats inside the stretch, of ``least`` words or more."""
    n = max(0, len(hashes) - size + 1)
    at = np.arange(n)
    at = at[text[at] == text[at + size - 1]]
    factors = mix(np.arange(11, 11 + size, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)
    window = np.zeros(n, U64)
    for i in range(size):
        window += hashes[i : i + n] * factors[i]
    window, group = window[at], text[at]
    for _ in range(ROUNDS):
        key = mix(window + group.astype(U64) * U64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        twin = key[order][1:] == key[order][:-1]
        repeats = np.zeros(len(key), bool)
        repeats[order[1:][twin]] = True
        repeats[order[:-1][twin]] = True
        at, window, group = at[repeats], window[repeats], group[repeats]
        # Neighbouring windows of one text are one stretch.
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (group[1:] != group[:-1])
        group = np.cumsum(new) - 1
        long = np.bincount(group, minlength=1)[group] >= least - size + 1 if len(at) else new
        done = bool(repeats.all() and long.all())
        at, window, group = at[long], window[long], group[long]
        if done:
            break
    if not len(at):
        return at, at
    edge = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    return at[edge], at[np.append(edge[1:], len(at)) - 1] + size


def _texts_runs(data: np.ndarray, offsets: np.ndarray, min_length: int, min_periods: int):
    """Runs of each text of a chunk, and its collapsed bytes."""
    words = words_of(data, offsets)
    n_texts = len(offsets) - 1
    found: dict[int, set[tuple[int, int, int]]] = {}
    size = window_size(min_length, min_periods)
    raw = data.tobytes()
    for a, b in zip(*stretches(words.hash, words.doc, size, min_length)):
        numbers: dict[bytes, int] = {}
        seen = [numbers.setdefault(raw[s:e], len(numbers)) for s, e in zip(words.start[a:b].tolist(), words.end[a:b].tolist())]
        text = int(words.doc[a])
        for start, length, period in runs_of(seen, min_length, min_periods):
            found.setdefault(text, set()).add((int(a - words.first[text]) + start, length, period))
    return words, [sorted(found.get(i, ()), key=lambda r: (r[0], r[2])) for i in range(n_texts)]


def _collapsed(words, runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    """Kept words of each text joined by one space, built in one buffer."""
    keep = np.ones(len(words.start), bool)
    for i, of_text in enumerate(runs):
        for start, length, period in of_text:
            first = words.first[i] + start
            keep[first + period : first + length] = False
    start, length, doc = words.start[keep], (words.end - words.start)[keep], words.doc[keep]
    place = np.cumsum(length + 1) - length - 1
    total = int((length + 1).sum())
    source = np.arange(total) - np.repeat(place - start, length + 1)
    joined = np.append(words.data, np.uint8(32))[np.minimum(source, len(words.data))]
    joined[place + length] = 32
    # No space after the last word of a text.
    n = np.bincount(doc, minlength=len(runs))
    ends = np.append(place, total)[np.cumsum(n)]
    last = ends[n > 0] - 1
    joined = np.delete(joined, last)
    offsets = np.append(0, ends - np.cumsum(n > 0))
    return pa.LargeStringArray.from_buffers(len(runs), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(joined))


def _task(min_length: int, min_periods: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column("text")):
                words, runs = _texts_runs(data, offsets, min_length, min_periods)
                listed = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], kind)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array(words.counts().astype(np.int64)), listed,
                     _collapsed(words, runs).cast(pa.string())],
                    ["id", "n_words", "runs", "collapsed"])

    return find


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
              min_periods: int = MIN_PERIODS) -> DataFrame:
    """One row per document: id, ``n_words``, ``runs`` (start, length and period
    in words, by start, then period) and ``collapsed``: the words no run holds
    after its first period, joined by one space."""
    if min_periods < 2 or min_length < 2:
        raise ValueError("a run has two periods and two words at least")
    rows = identified(docs, id_col, text_col).toDF("id", "text")
    out = rows.mapInArrow(_task(min_length, min_periods),
                          f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, runs {RUNS}, collapsed string")
    return out.withColumnRenamed("id", id_col)


def with_periodic_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``text`` of all documents; where the unsigned crc32 h of the
    decimal id is divisible by 10, the words from a on repeat the p words there
    (a, p of h // 10), joined by one space."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(ws: Column) -> Column:
        n = F.size(ws)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, (a + (i - a) % p).cast("int")))), " ")

    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"({WORD})"), F.lit(1))
    planted = F.get(F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, tail(ws)).otherwise(F.lit(""))), F.lit(0))
    return docs.select(F.col(id_col), F.when(h % 10 == 0, planted).otherwise(F.col(text_col)).alias(text_col))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the run of greatest exponent, and hashes of runs and kept words."""
    def better(a: Column, b: Column) -> Column:
        return ((a["length"] * b["period"] > b["length"] * a["period"])
                | ((a["length"] * b["period"] == b["length"] * a["period"])
                   & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"])))))

    best = F.aggregate("runs", F.get(F.col("runs"), F.lit(0)), lambda a, b: F.when(better(b, a), b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"),
                                                   F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(id_col, "n_runs", "best.start", "best.length", "best.period",
             F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
