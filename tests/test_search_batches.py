"""Batch search: scan BM25 against brute force and its beyond-the-bound path,
dense search under any batch size, repeated query ids, packing of null tokens."""

import hashlib

import numpy as np
import pytest

from lexiforge.operators import corpus, fuzzy, retrieval
from tests.test_corpus_retrieval import DOCS, QUERIES, brute_bm25

DOC_SCHEMA = "id long, content string, lang string"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in DOCS], DOC_SCHEMA).repartition(3)


def found(df):
    return {(r.query_id, r.rank, r.id): r.score for r in df.collect()}


def test_scan_bm25_matches_brute_force(spark, docs, monkeypatch):
    q = spark.createDataFrame(QUERIES, "query_id long, text string")
    got = found(retrieval.bm25_scan_search(docs, q, k=10))
    assert {(a, c): s for (a, _, c), s in got.items()} == pytest.approx(brute_bm25(DOCS, QUERIES))
    monkeypatch.setattr(retrieval, "TILE_SCORES", 1)            # one document per tile
    assert found(retrieval.bm25_scan_search(docs, q, k=10)) == got
    one = found(retrieval.bm25_scan_search(docs, q, k=1))
    assert one == {key: s for key, s in got.items() if key[1] == 1}
    monkeypatch.setattr(retrieval, "MAX_BATCH_CHARS", 1)        # a batch over the bound
    assert found(retrieval.bm25_scan_search(docs, q, k=10)) == pytest.approx(got)


def test_scan_bm25_filter_keeps_statistics(spark, docs):
    q = spark.createDataFrame(QUERIES, "query_id long, text string")
    want = {(a, d): s for (a, d), s in brute_bm25(DOCS, QUERIES).items() if d % 2}
    got = found(retrieval.bm25_scan_search(docs, q, k=10, filters={"lang": "en"}))
    assert {(a, c): s for (a, _, c), s in got.items()} == pytest.approx(want)


def test_scan_bm25_edge_rows(spark):
    docs = spark.createDataFrame([("a", "fire"), ("b", None), (None, "fire"), ("c", "water"), ("d", "fire")],
                                 "id string, content string")
    q = spark.createDataFrame([(1, "fire"), (2, None), (3, ""), (None, "fire")], "query_id long, text string")
    rows = [(r.query_id, r.rank, r.id) for r in retrieval.bm25_scan_search(docs, q, k=5).collect()]
    assert sorted(rows) == [(1, 1, "a"), (1, 2, "d")]           # equal scores go by id
    none = q.where("query_id > 9")
    assert retrieval.bm25_scan_search(docs, none, k=5).count() == 0
    assert retrieval.bm25_scan_search(docs.limit(0), q, k=5).count() == 0


def test_dense_same_under_any_batch_size(spark, monkeypatch):
    rng = np.random.default_rng(3)
    mat = rng.integers(-2, 3, (60, 4)).astype(float)            # many ties
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(mat)], "id long, embedding array<float>")
    qv = rng.integers(-2, 3, (5, 4)).astype(float)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qv)], "query_id long, embedding array<float>")
    want = {}
    for i, v in enumerate(qv):
        for r, d in enumerate(sorted(range(60), key=lambda j: (-(mat[j] @ v), j))[:7], 1):
            want[(i, r, d)] = mat[d] @ v
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "100", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert found(retrieval.dense_search(vecs, q, 7)) == want
        monkeypatch.setattr(retrieval, "TILE_SCORES", 1)        # one query per tile
        assert found(retrieval.dense_search(vecs, q, 7)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_slices_end_when_one_id_repeats(spark, monkeypatch):
    vecs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [float(i), 1.0]) for i in range(5)] * 2, "query_id long, embedding array<float>")
    whole = found(retrieval.dense_search(vecs, q, 3))
    assert found(retrieval.dense_search(vecs, q, 3, max_queries=2)) == whole
    names = spark.createDataFrame([(1, "Bolt"), (2, "Helix")], "uuid long, name string")
    qs = spark.createDataFrame([(1, "Bolt")] * 5 + [(1, "Helx")], "query_id long, text string")
    whole = {tuple(r) for r in fuzzy.fuzzy_best_match(names, qs).collect()}
    monkeypatch.setattr(fuzzy, "MAX_QUERIES", 1)
    assert {tuple(r) for r in fuzzy.fuzzy_best_match(names, qs).collect()} == whole


def test_pack_null_and_long_documents(spark):
    rows = [(1, None), (2, [f"a{i}" for i in range(21)]), (3, []), (4, ["b"])]
    docs = spark.createDataFrame(rows, "doc_id long, toks array<string>")
    blocks = corpus.pack_blocks(docs, "toks", "doc_id", 5, parts=1).orderBy("block").collect()
    flat = [t for b in blocks for t in b.tokens]
    end = "<|eot_id|>"
    order = sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest())
    assert flat == [t for _, ts in order for t in [*(ts or []), end]]
    assert [b.block for b in blocks] == list(range(len(blocks))) and {len(b.tokens) for b in blocks[:-1]} == {5}
