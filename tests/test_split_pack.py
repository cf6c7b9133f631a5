"""Exact split by histogram passes; packing by two prefix sums."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import corpus, retrieval


def split_by_hand(keys, fraction):
    h = lambda k: hashlib.md5(b"n" if k is None else b"k" + str(k).encode()).hexdigest()
    target, n, test = math.ceil(fraction * len(keys) - 1e-9), 0, set()
    for k in sorted(set(keys), key=h):
        if n >= target:
            break
        test.add(k)
        n += keys.count(k)
    return test


@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.2, 0.37, 1.0])
def test_exact_split(spark, fraction):
    rng = random.Random(4)
    for keys in ([*range(97)], [rng.randrange(30) for _ in range(200)] + [None] * 20 + [7] * 100, [5], [None]):
        df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key long, i long")
        got = [{(r.key, r.i, r.split) for r in corpus.exact_split(df.repartition(n), "key", fraction).collect()} for n in (1, 9)]
        assert got[0] == got[1] and len(got[0]) == len(keys)
        test = split_by_hand(keys, fraction)
        assert got[0] == {(k, i, "test" if k in test else "train") for i, k in enumerate(keys)}
        if len(set(keys)) == len(keys):
            assert sum(s == "test" for _, _, s in got[0]) == math.ceil(fraction * len(keys) - 1e-9)
    empty = spark.createDataFrame([], "key long, split string")
    assert corpus.exact_split(empty, "key", out="side").columns == ["key", "split", "side"]


def test_pack_offsets_are_one_order_for_any_partitioning(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None, "c" * 50, str(i)]), rng.choice([None, 0, 1, 5, 900]), i % 3) for i in range(300)]
    rows += [("hot", 3, 1)] * 400                       # one key holds more than half of all rows
    df = spark.createDataFrame(rows, "key string, n int, offset_ int")
    got = []
    for parts, n in ((1, 1), (7, 3), (40, 11)):
        r = corpus.pack_offsets(df.repartition(n), "n", "key", 64, parts)
        got.append(sorted(map(str, r.collect())))
        held = sorted((x.offset, x.n, x.first_block, x.last_block) for x in r.collect())
        at = 0
        for o, length, first, last in sorted(held, key=lambda x: (x[0], x[1])):
            assert o == at and first == o // 64 and last == max(o, o + length - 1) // 64
            at += length
        assert at == sum(x[1] or 0 for x in rows)
    assert got[0] == got[1] == got[2]
    assert corpus.pack_offsets(df.drop("offset_"), "n", "key", 64).count() == len(rows)
    assert corpus.pack_offsets(df.where("false"), "n", "key", 64).count() == 0
    with pytest.raises(ValueError):
        corpus.pack_offsets(df.withColumnRenamed("offset_", "_part"), "n", "key", 64)


def test_pack_blocks_do_not_depend_on_the_ranges(spark):
    rows = [(i % 50, [f"t{i}_{j}" for j in range(i % 7)]) for i in range(200)] + [(1, None)]
    df = spark.createDataFrame(rows, "id long, toks array<string>")
    got = [{r.block: tuple(r.tokens) for r in corpus.pack_blocks(df, "toks", "id", 16, p).collect()} for p in (1, 5, 23)]
    assert got[0] == got[1] == got[2]
    assert sum(map(len, got[0].values())) == sum(len(t or []) + 1 for _, t in rows)


def test_corpus_statistics_in_one_pass(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, None), (3, ""), (4, "blue sky over red sea")], "id long, content string")
    n, avg, freq = retrieval.corpus_statistics(docs)
    assert (n, avg) == retrieval.corpus_stats(docs)
    assert {tuple(r) for r in freq.collect()} == {tuple(r) for r in retrieval.document_frequencies(docs).collect()}
    n, avg, freq = retrieval.corpus_statistics(docs.where("false"))
    assert (n, avg, freq.count()) == (0, 0.0, 0)
    assert freq.where(F.col("token").isNull()).count() == 0
