"""The pipeline stage by stage, and every registered query with SQL."""

from collections import Counter

import pytest

import corpus_pipeline
from pressroll.llm import minhash, packed_ids, toxicity
from pressroll.llm.queries import QUERIES, SQL
from pressroll.plans.compare import compare, duck

import messy
from conftest import SF_SMALL
from test_operators import rows, shingles


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    r = compare(spark, name, SF_SMALL, con)
    assert r["status"] == ("match" if name in SQL else "rows-only"), r


def test_run_matches_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    scores = {r["doc_id"]: r["score"] for r in rows(toxicity.score_toxicity(docs, labels))}
    texts = {r["doc_id"]: r["text"] for r in rows(docs) if scores[r["doc_id"]] < 0.3}
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    own = [shingles(r["text"].lower()) for r in rows(items)]
    lower = {i: shingles(texts[i].lower()) for i in ids if root(i) == i}
    kept = {i for i, s in lower.items() if not any(100 * len(s & o) >= 75 * len(o) for o in own if o)}
    out = rows(corpus_pipeline.run(spark, SF_SMALL))
    counts = Counter(r["doc_id"] for r in out)
    assert set(counts) <= kept and max(counts.values()) <= 2
    words = {i: len((texts[i] or "").split()) for i in kept}
    total = sum(words.values())
    assert sum(words[i] * n for i, n in counts.items()) == pytest.approx(1.5 * total, rel=0.1)
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in out)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    alone = {r["doc_id"]: r["ids_crc32"] for r in rows(packed_ids.token_ids(docs))}
    assert all(r["ids_crc32"] == alone[r["doc_id"]] for r in out)


def awkward_tables(spark, folder, empty):
    docs = messy.documents(spark)
    labels = spark.createDataFrame([(0, 1), (None, 1), (3, None), *[(k, 0) for k in range(1, 40)]], "doc_id long, toxic int")
    items = spark.createDataFrame([(0, " ".join(messy.words(3, 120)[5:40])), (1, None)], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
        (df.where("false") if empty else df).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_awkward_tables(spark, tmp_path, empty):
    folder = awkward_tables(spark, tmp_path, empty)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{folder}/stage-{k}")
        docs = spark.read.parquet(f"{folder}/stage-{k}")
    assert (docs.count() == 0) == empty
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_one_of_each_group_stays(spark):
    left = minhash.without_near_duplicates(messy.documents(spark))
    ids = [r["doc_id"] for r in rows(left) if r["doc_id"] is not None]
    assert len(ids) == len(set(ids))
