"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positive sample, documents drawn without
regard to any label are the unlabelled one, and the class prior is the share of
toxic rows among all labelled training rows. A linear classifier over hashed
word features is trained in numpy on the risk

    prior * E_p[loss(f)] + max(0, E_u[loss(-f)] - prior * E_p[loss(-f)])

(logistic loss); while the second term is negative, a share of its gradient is
reversed, so that the estimate cannot fall below zero by overfitting.

Features of a text: its distinct words (runs of letters, A-Z lower-cased) and
their first 3, 4, 5 and 7 bytes, hashed into 2**20 weights; those kept are
more frequent in the positive sample than chance explains. No label, language,
source or id is a feature. Only the training sample is bounded
(``max_positive`` and ``max_unlabelled`` rows, drawn by a hash of the id);
counts and scores cover all documents, whole texts.

Edge cases: null or empty text scores by the intercept alone; a null id is
never held out and never trains; rows that repeat an id are each scored; with
no positive or no unlabelled rows every score is the prior (0 without labels);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroll.llm.common import identified, text_chunks, words_of

BITS = 20
PREFIXES = (3, 4, 5, 7)
MAX_POSITIVE = 4_000
MAX_UNLABELLED = 12_000
THRESHOLD = 0.3
#: Log-likelihood ratio a feature needs; training steps, rate and ridge penalty;
#: share of the reversed gradient while the corrected risk is negative.
MIN_RATIO, STEPS, RATE, RIDGE, REVERSE = 20, 400, 0.05, 1e-4, 0.3

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the distinct words of each text, text by text, and
    where each text's begin."""
    words = words_of(data, offsets, lower=True, between=_BETWEEN)
    order = np.lexsort((words.hash, words.doc))
    h, d = words.hash[order], words.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    order, h, d = order[new], h[new], d[new]
    each = np.stack([h, *[words.prefix(k)[order] + np.uint64(k << 40) for k in PREFIXES]], axis=1)
    first = np.searchsorted(d, np.arange(len(offsets))) * each.shape[1]
    return (each.reshape(-1) >> np.uint64(64 - BITS)).astype(np.int32), first


def _sums(weights: np.ndarray, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(features) + 1)
    np.cumsum(weights[features], out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in text_chunks(batch.column(1)):
            features, first = _features(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(features))],
                ["positive", "features"])


def _document_counts(rows: list[np.ndarray]) -> np.ndarray:
    counts = np.zeros(1 << BITS)
    for r in rows:
        counts[np.unique(r)] += 1
    return counts


def _telling(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Features more frequent in the positive sample than chance explains, by
    the log-likelihood ratio of the two document counts."""
    n = len(positive), len(unlabelled)
    seen = _document_counts(positive), _document_counts(unlabelled)
    both, ratio = seen[0] + seen[1], 0.0
    for k in range(2):
        mean = both * n[k] / sum(n)
        for observed, expected in ((seen[k], mean), (n[k] - seen[k], n[k] - mean)):
            some = observed > 0
            ratio = ratio + 2 * np.where(some, observed * np.log(np.where(some, observed, 1) / np.where(some, expected, 1)), 0)
    return (ratio >= MIN_RATIO) & (seen[0] > both * n[0] / sum(n))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative risk over the whole
    sample (Adam on the telling features, ridge penalty)."""
    chosen = _telling(positive, unlabelled)
    number, k = np.cumsum(chosen) - 1, int(chosen.sum())
    rows = [number[r[chosen[r]]] for r in (*positive, *unlabelled)]
    n_p, n_u, n = len(positive), len(unlabelled), len(rows)
    flat, row = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
    w = np.append(np.zeros(k), np.log(prior / (1 - prior)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, STEPS + 1):
        f = np.clip(np.bincount(row, w[flat], n) + w[-1], -30, 30)
        p = 1 / (1 + np.exp(-f))  # derivative of loss(-f); that of loss(f) is p - 1
        rest = np.logaddexp(0, f[n_p:]).mean() - prior * np.logaddexp(0, f[:n_p]).mean()
        sign = 1 if rest >= 0 else -REVERSE
        g = np.concatenate([prior * ((p[:n_p] - 1) - sign * p[:n_p]) / n_p, sign * p[n_p:] / n_u])
        grad = np.append(np.bincount(flat, g[row], k) + RIDGE * w[:-1], g.sum())
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen] = w[:-1]
    return weights, float(w[-1])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _drawn(id_col: Column, share: float) -> Column:
    return F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))


def _train_task(prior: float):
    """Weights of the sample's rows as (feature, weight), the intercept as feature -1."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: tuple[list[np.ndarray], list[np.ndarray]] = [], []
        for batch in batches:
            first, flat = batch.column("features").offsets.to_numpy(), batch.column("features").values.to_numpy()
            for i, kind in enumerate(batch.column("positive").to_pylist()):
                rows[kind].append(flat[first[i] : first[i + 1]])
        if rows[0] and rows[1]:
            unlabelled, positive = (sorted(r, key=lambda x: (len(x), zlib.crc32(x.tobytes()))) for r in rows)
            weights, intercept = train(positive, unlabelled, prior)
            used = np.flatnonzero(weights)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(weights[used], intercept).astype(np.float64))],
                                             ["feature", "weight"])

    return learn


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> tuple[np.ndarray | None, float]:
    """Weights and intercept; without positives or unlabelled rows no weights and the prior."""
    rows = identified(docs, id_col, text_col).toDF("id", "text")
    marks = identified(labels, id_col, label_col).toDF("id", "label").where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
    n_labels, n_toxic = marks.agg(F.count("*"), F.count_if(F.col("label") == 1)).first()
    trainable = rows.where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    n_rows = trainable.select("id").count()
    prior = n_toxic / n_labels if n_labels else 0.0
    if n_rows and 0 < prior < 1:
        # At most about max_positive ids, so the broadcast is bounded.
        toxic = marks.where("label = 1").where(_drawn(F.col("id"), min(1, max_positive / n_toxic))).select("id").distinct()
        picked = (trainable.where(_drawn(F.col("id"), min(1, max_unlabelled / n_rows))).select(F.lit(0).alias("positive"), "text")
                  .union(trainable.join(F.broadcast(toxic), "id", "left_semi").select(F.lit(1).alias("positive"), "text")))
        # The bounded sample meets in one task, which returns the telling features' weights only.
        sample = picked.mapInArrow(_sample_rows, "positive int, features array<int>").repartition(1)
        learned = sample.mapInArrow(_train_task(prior), "feature int, weight double").toArrow()
        if learned.num_rows:
            features, values = learned["feature"].to_numpy(), learned["weight"].to_numpy()
            weights = np.zeros(1 << BITS, np.float32)
            weights[features[features >= 0]] = values[features >= 0]
            return weights, float(values[features < 0][0])
    return None, prior


def _scores(column: pa.Array, weights: np.ndarray | None, intercept: float) -> np.ndarray:
    if weights is None:
        return np.full(len(column), intercept)
    parts = [np.zeros(0)]
    for _, _, data, offsets in text_chunks(column):
        f = np.clip(_sums(weights, *_features(data, offsets)) + intercept, -30, 30)
        parts.append(1 / (1 + np.exp(-f)))
    return np.concatenate(parts)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row per document: id, ``held_out``, ``score``, ``predicted``."""
    weights, intercept = fit(docs, labels, id_col, text_col, **options)
    rows = identified(docs, id_col, text_col).toDF("id", "text")
    model = docs.sparkSession.sparkContext.broadcast(weights)  # 2**20 numbers whatever the input

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(batch.column("text"), model.value, intercept)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores)], ["id", "score"])

    scored = rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns."""
    weights, intercept = fit(docs, labels, id_col, text_col, **options)
    model = docs.sparkSession.sparkContext.broadcast(weights)
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(place), model.value, intercept) < threshold))

    return docs.mapInArrow(keep, docs.schema)
