"""Runs of words against brute force."""

import hashlib
import random
import re
import zlib

import pytest

from pressroll.llm import periodic

import messy

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(words, least, times):
    found, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i : i + length]
            if j > i and length >= max(least, times * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _sequence(rng):
    n, kinds = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 5])
    words = [rng.randrange(kinds) for _ in range(n)]
    if n > 8 and rng.random() < 0.5:
        p, a = rng.randint(1, 6), rng.randrange(n)
        for i in range(a, n):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("least, times", [(24, 3), (9, 3), (6, 2), (2, 2)])
def test_runs_match_brute_force(least, times):
    rng = random.Random(least)
    for _ in range(600):
        words = _sequence(rng)
        assert periodic.runs_of(words, least, times) == _brute(words, least, times)


def test_runs_inside_runs():
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    assert periodic.runs_of(b, 4, 2) == _brute(b, 4, 2)
    assert periodic.runs_of([1] * 5000) == [(0, 5000, 1)]


def test_a_window_repeats_in_every_run():
    """The size the stretches are cut with loses no run, whatever its period."""
    for least, times in ((24, 3), (9, 3), (6, 2), (2, 2)):
        size = periodic.window_size(least, times)
        assert all(max(least, times * q) - size + 1 >= 2 * q for q in range(1, 200))
    assert periodic.window_size(24, 3) == 9


def _planted(rng):
    words = [f"w{rng.randrange(rng.choice([2, 30, 1000]))}" for _ in range(rng.randint(0, 250))]
    for _ in range(rng.randint(0, 3)):
        if len(words) > 20:
            a, p = rng.randrange(len(words)), rng.randint(1, 15)
            for i in range(a, min(len(words), a + rng.randint(0, 100))):
                words[i] = words[a + (i - a) % p]
    return "".join(w + rng.choice([" ", "\n", "\t ", " "]) for w in words)


def _check(found, texts):
    for r in found:
        words = WORD.findall(texts[r["doc_id"]] or "")
        runs = _brute(words, 24, 3)
        keep = [True] * len(words)
        for s, n, q in runs:
            keep[s + q : s + n] = [False] * (n - q)
        assert r["n_words"] == len(words)
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == runs
        assert r["collapsed"] == " ".join(w for w, k in zip(words, keep) if k)


def test_runs_of_texts(spark, monkeypatch):
    rng = random.Random(5)
    texts = {i: _planted(rng) for i in range(300)}
    texts |= {1000: None, 1001: "", 1002: " \n ", 1003: "ü\U0001f600 " * 50, 1004: ("a b c " * 9).strip(), 1005: "x " * 23, 1006: "x " * 24}
    found = periodic.find_runs(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(found) == len(texts)
    _check(found, texts)
    assert sum(len(r["runs"]) for r in found) > 100


def test_awkward_rows(spark):
    docs = messy.documents(spark)
    found = periodic.find_runs(docs)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"] and found.count() == docs.count()
    none = periodic.digests(periodic.find_runs(periodic.with_periodic_tails(messy.empty(docs))))
    assert none.count() == 0
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert [tuple(x.asDict().values()) for x in by_id[14]["runs"]] == [(0, 120, 3)] and by_id[14]["collapsed"] == "same line here x | y # z"
    assert by_id[4]["n_words"] == 0 and by_id[4]["runs"] == [] and by_id[4]["collapsed"] == ""


def test_digests(spark):
    rng = random.Random(8)
    texts = {i: _planted(rng) for i in range(120)} | {200: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in periodic.digests(periodic.find_runs(periodic.with_periodic_tails(docs))).collect():
        words, h = WORD.findall(texts[r["doc_id"]] or ""), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = _brute(words, 24, 3)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
