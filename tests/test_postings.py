"""The stored lexical index: equal to a scan, grown in steps, filters, pruning, versions."""

import glob
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from lexiforge import versions
from lexiforge.operators import postings, retrieval
from lexiforge.plans import analogs as A
from tests.conftest import SF


def corpus(spark, n=900, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        k = rng.choice([0, 1, 5, 30, 80])
        text = " ".join(rng.choice(words[:rng.choice([3, 40, 300])]) for _ in range(k)) if i % 50 else None
        rows.append((i, text, "ab"[i % 2], i % 7))
    return spark.createDataFrame(rows, "id long, content string, kind string, n int")


def asked(spark):
    return spark.createDataFrame([(1, "w1 w2 w250"), (2, "w299 w299 w0"), (3, "none here"), (4, ""), (5, None), (6, "W7, w8; w9 w10 w11 w12")],
                                 "query_id long, text string")


def rows(df):
    return sorted(map(tuple, df.select("query_id", "rank", "id", "score").collect()))


@pytest.mark.parametrize("k", [3, 10])
def test_index_equals_scan(spark, tmp_dir, k):
    docs, q = corpus(spark).repartition(3), asked(spark)
    postings.add_documents(spark, f"{tmp_dir}/ix", docs, shard_docs=100, block=8)
    index = postings.load_text_index(spark, f"{tmp_dir}/ix")
    want = rows(retrieval.bm25_scan_search(docs, q, k))
    assert rows(postings.search_index(index, q, k)) == want and len(want) == 3 * k
    assert rows(postings.search_index(index, q, k, max_batch_chars=20)) == want       # slices
    flt = {"kind": "a", "n": {"$lte": 3}}
    fields = ["kind", "n"]
    assert rows(postings.search_index(index, q, k, flt, fields)) == rows(retrieval.bm25_scan_search(docs, q, k, flt, fields))


def test_index_grown_in_steps_equals_one_built_at_once(spark, tmp_dir):
    docs, q = corpus(spark), asked(spark)
    postings.add_documents(spark, f"{tmp_dir}/one", docs)
    for i in range(3):
        v = postings.add_documents(spark, f"{tmp_dir}/steps", docs.where(f"id % 3 = {i}"), shard_docs=64)
        assert v == i + 1
    one, steps = (postings.load_text_index(spark, f"{tmp_dir}/{p}") for p in ("one", "steps"))
    assert (one.n_docs, round(one.avg_len, 9)) == (steps.n_docs, round(steps.avg_len, 9)) == (900, round(one.avg_len, 9))
    assert rows(postings.search_index(steps, q)) == rows(postings.search_index(one, q))
    first = postings.load_text_index(spark, f"{tmp_dir}/steps", 1)      # earlier versions stay
    assert first.n_docs == 300 and rows(postings.search_index(first, q)) == rows(
        retrieval.bm25_scan_search(docs.where("id % 3 = 0"), q))
    with pytest.raises(FileNotFoundError):
        postings.load_text_index(spark, f"{tmp_dir}/none")


def test_row_groups_are_sorted_and_the_filter_reaches_the_scan(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(postings, "ROW_GROUP_BYTES", 4096)
    docs = corpus(spark, 3000).coalesce(1)
    postings.add_documents(spark, f"{tmp_dir}/ix", docs, block=16)
    groups = [g for f in glob.glob(f"{tmp_dir}/ix/segment-*/lists/*.parquet") for m in [pq.ParquetFile(f).metadata]
              for g in (m.row_group(i).column(1).statistics for i in range(m.num_row_groups))]
    assert len(groups) > 3 and sum(g.min <= "w250" <= g.max for g in groups) < len(groups) / 2
    index = postings.load_text_index(spark, f"{tmp_dir}/ix")
    plan = index.lists.where(index.lists.token.isin(["", "w250"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(token" in plan
    found = postings.search_index(index, asked(spark))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in found and "hashpartitioning(seq" not in found


def test_blocks_are_skipped_and_nothing_is_lost():
    """A rare word and a very common one: most blocks of the common word stay unread."""
    rng = np.random.default_rng(3)
    n = 20_000
    lens = rng.integers(20, 200, n)
    rare, common = np.sort(rng.choice(n, 40, replace=False)), np.arange(n)
    shard = postings.Shard(np.arange(n), lens, None, 100.0)
    for token, docs in (("rare", rare), ("common", common)):
        tf = rng.integers(1, 4, len(docs)).astype("<i4")
        for a in range(0, len(docs), 64):
            d, t = docs[a:a + 64].astype("<i4"), tf[a:a + 64]
            shard.add(token, int(d[0]), int(d[-1]), int(t.max()), int(lens[d].min()), d.tobytes(), t.tobytes())
    shard.finish()
    query = [("common", 0.1), ("rare", 6.0)]
    ids, scores = shard.search(query, 10, -np.inf)
    assert shard.skipped > 0.8 * (shard.read + shard.skipped)
    whole = np.zeros(n)
    for token, w in query:
        for _, _, _, _, d, t in shard.blocks[token]:
            d = np.frombuffer(d, "<i4")
            whole[d] += w * postings._part(np.frombuffer(t, "<i4"), lens[d], 100.0)
    order = np.lexsort((np.arange(n), -np.round(whole, 6)))[:10]
    best = np.lexsort((ids, -scores))[:10]
    assert ids[best].tolist() == order.tolist() and np.allclose(scores[best], whole[order], atol=1e-6)


def test_search_results_carry_the_document(spark, tmp_dir):
    docs = A.doc_table(spark, SF)
    postings.add_documents(spark, f"{tmp_dir}/ix", docs)
    index = postings.load_text_index(spark, f"{tmp_dir}/ix")
    q = A.query_table(spark, SF).select("query_id", "text")
    out = postings.search_results(index, q, 4)
    assert out.columns == ["query_id", "rank", "id", "score", "name", "content", "meta", "formatted"]
    got = out.collect()
    text = {r.id: r.content for r in docs.collect()}
    assert got and all(r["name"] == f"doc {r['id']}" and r["content"] == text[r["id"]] and r["formatted"].startswith("Relevancy Score: ")
                       for r in got)


def test_empty_index(spark, tmp_dir):
    docs, q = corpus(spark, 20), asked(spark)
    postings.add_documents(spark, f"{tmp_dir}/ix", docs.limit(0))
    assert postings.search_index(postings.load_text_index(spark, f"{tmp_dir}/ix"), q).count() == 0
    postings.add_documents(spark, f"{tmp_dir}/ix", docs)
    assert rows(postings.search_index(postings.load_text_index(spark, f"{tmp_dir}/ix"), q)) == rows(retrieval.bm25_scan_search(docs, q))


def test_manifests_are_published_whole_or_not_at_all(spark, tmp_dir):
    root = f"{tmp_dir}/set"
    assert versions.read_manifest(spark, root) is None and versions.versions(spark, root) == []
    assert versions.publish(spark, root, {"a": [1, "é"]}) == 1
    assert versions.publish(spark, root, {"a": 2}) == 2
    assert versions.read_manifest(spark, root) == (2, {"a": 2}) and versions.read_manifest(spark, root, 1) == (1, {"a": [1, "é"]})
    with pytest.raises(versions.VersionConflict):       # a writer that saw version 1 comes too late
        versions.publish(spark, root, {"a": 3}, after=1)
    assert versions.read_manifest(spark, root) == (2, {"a": 2})
