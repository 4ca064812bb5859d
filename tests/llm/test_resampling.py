"""Importance resampling: hashes, table, weights and draws against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from pressroll.llm import resampling

import messy


def _strings(texts):
    data = np.frombuffer(b"".join(texts), np.uint8) if texts else np.zeros(0, np.uint8)
    length = np.array([len(t) for t in texts], np.int64)
    return resampling.Strings(data, np.cumsum(length) - length, length)


def _random_strings(seed, n=400):
    rng = random.Random(seed)
    return [bytes(rng.randrange(3) for _ in range(rng.choice([0, 1, 3, 4, 7, 8, 9, 15, 31, 32, 33, 63, 64, 65, 200, 1023, 1024, 1500])))
            for _ in range(n)]


def test_hashes_equal_the_library():
    texts = _random_strings(1)
    assert _strings(texts).xxhash64().tolist() == [xxhash.xxh64_intdigest(t) for t in texts]


@pytest.mark.parametrize("collide", [False, True])
def test_table_interns_every_string(monkeypatch, collide):
    """Also where all keys are equal, so that the bytes alone tell strings apart."""
    if collide:
        monkeypatch.setattr(resampling.Strings, "xxhash64", lambda self: np.full(len(self.start), 7, np.uint64))
    texts = _random_strings(2, 300) + _random_strings(2, 100)
    table = resampling.GramTable(_strings(texts), 97)
    number = {}
    assert all(number.setdefault(t, s) == s for t, s in zip(texts, table.slots.tolist()))
    assert len(set(number.values())) == len(number) == len(table.used)
    counts = Counter(texts)
    for t, s in number.items():
        assert (table.count[s], table.bucket[s]) == (counts[t], zlib.crc32(t) % 97)


def _brute(texts, target, sizes, buckets, percent, least):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))

    def grams(w):
        return [" ".join(w[i : i + n]) for n in range(sizes[0], sizes[1] + 1) for i in range(len(w) - n + 1)]

    def bucket(g):
        return zlib.crc32(g.encode()) % buckets

    s, t = (Counter(bucket(g) for x in c for g in grams(words(x))) for c in ([x for _, x in texts], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    out = []
    for i, x in texts:
        gains = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in map(bucket, grams(words(x)))]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words(x)), len(gains), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    drawn = len(long) * percent // 100
    ranked = [(*r, k + 1 if k < drawn else None) for k, r in enumerate(long)] + [(*r, None) for r in out if r[1] < least]
    return sorted(ranked, key=str)


@pytest.mark.parametrize("sizes", [(1, 1), (1, 3), (2, 2)])
def test_scores_and_draws_match_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(resampling, "BATCH_BYTES", 5000)
    docs = messy.documents(spark)
    target = ["w1 w2 w3 w4, w5", None, "", "Two words! café " * 3, "same line here"]
    found = resampling.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), sizes=sizes, buckets=50, percent=40)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted([tuple(r) for r in found.collect()], key=str) == _brute(messy.texts(), target, sizes, 50, 40, 20)


def test_ties_go_to_smaller_ids(spark):
    """Equal texts and equal noise: the ids alone decide."""
    docs = spark.createDataFrame([(i, "word " * 30) for i in range(50)] * 2, "doc_id long, text string")
    found = resampling.resample(docs, docs.limit(0)).orderBy("rank").where("rank IS NOT NULL").collect()
    assert [r["rank"] for r in found] == list(range(1, 11))
    assert [(-r["score"], r["doc_id"]) for r in found] == sorted((-r["score"], r["doc_id"]) for r in found)


def test_drawn_documents_keep_their_columns(spark):
    docs = messy.documents(spark)
    ids = {r["doc_id"] for r in resampling.resample(docs, docs, percent=50).where("rank IS NOT NULL").collect()}
    kept = resampling.drawn(docs, docs, percent=50)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == ids and ids


def test_nothing_to_draw(spark):
    docs = messy.documents(spark)
    assert resampling.resample(messy.empty(docs), docs).count() == 0
    assert resampling.resample(docs, messy.empty(docs)).where("rank IS NOT NULL").count() > 0
