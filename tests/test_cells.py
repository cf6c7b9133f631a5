"""The stored vector index: equal to brute force, skips cells, grows, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.operators import cells, retrieval


def found(df):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 6)) for r in df.select("query_id", "rank", "id", "score").collect())


def table(spark, mat, name, first=0):
    return spark.createDataFrame([(i + first, v.tolist()) for i, v in enumerate(mat)], f"{name} long, embedding array<double>")


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16)) * 4
    x = np.concatenate([c + 0.2 * rng.normal(size=(150, 16)) for c in centres])
    x[:900] = x[0]                                  # a third of all rows are copies
    return rng.permutation(x), centres[:6] + 0.1


def test_search_skips_and_equals_brute_force(spark, tmp_dir, groups):
    x, q = groups
    vecs, qs = table(spark, x, "id"), table(spark, q, "query_id")
    cells.add_vectors(spark, tmp_dir + "/v", vecs, cells=64, block_rows=32)
    got, seen = cells.search_vectors(cells.load_vector_index(spark, tmp_dir + "/v"), qs, 7, report=True)
    want = found(retrieval.dense_search(vecs, qs, 7))
    assert found(got) == want and len(want) == 42
    assert seen["pairs"] == len(x) * len(q)
    assert seen["pairs_scored"] < 0.2 * seen["pairs"] and seen["cells_read"] < 0.5 * seen["cells"]


def test_blocks_hold_every_vector_once(spark, tmp_dir, groups):
    x, _ = groups
    cells.add_vectors(spark, tmp_dir + "/v", table(spark, x, "id"), cells=8, block_rows=50)
    b = cells.load_vector_index(spark, tmp_dir + "/v").blocks
    assert b.agg(F.max("n")).first()[0] <= 50
    assert sorted(r.id for r in b.select(F.explode("ids").alias("id")).collect()) == list(range(len(x)))


def test_grown_index_and_slices(spark, tmp_dir, groups, monkeypatch):
    x, q = groups
    whole, qs = table(spark, x, "id"), table(spark, np.concatenate([q, q[:2], -q]), "query_id")
    want = found(retrieval.dense_search(whole, qs, 5))
    for at in range(0, 3000, 1000):
        v = cells.add_vectors(spark, tmp_dir + "/v", table(spark, x[at:at + 1000], "id", at), cells=32)
    assert v == 3
    index = cells.load_vector_index(spark, tmp_dir + "/v")
    assert found(cells.search_vectors(index, qs, 5)) == want
    monkeypatch.setattr(cells, "BATCH_BYTES", 300)          # slices of a few queries
    assert found(cells.search_vectors(index, qs, 5)) == want
    old = cells.load_vector_index(spark, tmp_dir + "/v", 1)
    assert found(cells.search_vectors(old, qs, 5)) == found(retrieval.dense_search(whole.where("id < 1000"), qs, 5))


def test_random_directions(spark, tmp_dir):
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (400, 5)).astype(float)         # many ties
    vecs, qs = table(spark, x, "id"), table(spark, rng.integers(-3, 4, (30, 5)).astype(float), "query_id")
    cells.add_vectors(spark, tmp_dir + "/v", vecs, cells=20, block_rows=16)
    index = cells.load_vector_index(spark, tmp_dir + "/v")
    for k in (1, 9, 500):
        assert found(cells.search_vectors(index, qs, k)) == found(retrieval.dense_search(vecs, qs, k))


def test_odd_rows(spark, tmp_dir):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", None), ("c", [nan, 1.0]), ("d", [inf, 1.0]), ("e", [None, 1.0]),
            (None, [1.0, 1.0]), ("f", [0.0, 0.0]), ("g", [])]
    vecs = spark.createDataFrame(rows, "id string, embedding array<float>").withColumn("cell", F.lit("x"))
    qs = spark.createDataFrame([(1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, None), (None, [1.0, 0.0]), (3, [0.0, 0.0])],
                               "query_id long, embedding array<float>").withColumn("row", F.lit(1))
    cells.add_vectors(spark, tmp_dir + "/v", vecs)
    got = found(cells.search_vectors(cells.load_vector_index(spark, tmp_dir + "/v"), qs, 3))
    assert got == [(1, 1, "a", 2.0), (1, 2, "a", 2.0), (1, 3, "f", 0.0), (3, 1, "a", 0.0), (3, 2, "a", 0.0), (3, 3, "f", 0.0)]
    with pytest.raises(FileNotFoundError):
        cells.load_vector_index(spark, tmp_dir + "/none")


def test_empty_tables(spark, tmp_dir):
    none = spark.createDataFrame([], "id long, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0])], "id long, embedding array<float>")
    q = one.withColumnRenamed("id", "query_id")
    cells.add_vectors(spark, tmp_dir + "/v", none)
    assert found(cells.search_vectors(cells.load_vector_index(spark, tmp_dir + "/v"), q, 3)) == []
    cells.add_vectors(spark, tmp_dir + "/v", one)
    index = cells.load_vector_index(spark, tmp_dir + "/v")
    assert found(cells.search_vectors(index, q, 3)) == [(1, 1, 1, 1.0)]
    assert found(cells.search_vectors(index, q.where("false"), 3)) == []
    with pytest.raises(Exception, match="components"):
        cells.search_vectors(index, spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<float>"), 3)
