"""Tokenizer hook and padded batches against plain loops."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import batches


def ids_of(text, most):
    return [1 + int(hashlib.md5(w.encode()).hexdigest()[:4], 16) for w in (text or "").split()][:most]


ROWS = [(i, " ".join(f"w{i % 7}x{j}" for j in range(i % 13))) for i in range(60)] + [
    (None, "null key"), (None, None), (5, ""), (7, "same same"), (7, "same same"), (8, "Ünï çode 中文")]


def brute(rows, size, most):
    own = sorted(((len(x), k is not None, k or 0, x) for k, x in ((k, ids_of(t, most)) for k, t in rows)))
    out = []
    for b in range(0, len(own), size):
        part = own[b:b + size]
        width = part[-1][0]
        for slot, (n, known, k, x) in enumerate(part):
            out.append((b // size, width, slot, k if known else None, n, x + [0] * (width - n), [1] * n + [0] * (width - n)))
    return out


@pytest.mark.parametrize("parts,size,most", [(1, 4, 9), (7, 4, 9), (3, 1, 100), (5, 1000, 6)])
def test_batches_depend_on_rows_alone(spark, parts, size, most):
    df = spark.createDataFrame(ROWS, "k long, t string").withColumn("ids", F.lit("clash")).repartition(parts)
    coded = batches.encode_texts(df, "k", "t", batches.hashed_words, "hashed-words", most, rows=3)
    out = batches.padded_batches(coded, "k", size)
    got = [tuple(r) for r in out.select("batch", "width", F.inline("rows")).orderBy("batch", "slot").collect()]
    assert got == brute(ROWS, size, most)


def test_empty_table_and_one_length(spark):
    df = spark.createDataFrame(ROWS, "k long, t string")
    none = batches.encode_texts(df.limit(0), "k", "t", batches.hashed_words, "hashed-words")
    assert batches.padded_batches(none, "k", 4).count() == 0
    same = spark.range(1000).select(F.col("id").alias("k"), F.lit("one two").alias("t"))
    out = batches.padded_batches(batches.encode_texts(same, "k", "t", batches.hashed_words, "hashed-words"), "k", 24)
    rows = out.orderBy("batch").collect()
    assert [r["batch"] for r in rows] == list(range(42)) and all(r["width"] == 2 for r in rows)
    assert [x["key"] for r in rows for x in r["rows"]] == list(range(1000))


def test_a_tokenizer_is_loaded_once():
    calls = []

    def load():
        calls.append(1)
        return lambda texts: [[len(t)] for t in texts]

    assert [batches.loaded("counted", load)(["abc"]) for _ in range(3)] == [[[3]]] * 3 and len(calls) == 1
