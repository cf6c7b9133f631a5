"""Tokenizer hook and padded batches (M-2).

``encode_texts`` runs any tokenizer over Arrow batches; its loader is called once per
Python worker, not per row or task. ``padded_batches`` sorts examples by length, numbers
them over all tasks and deals them into batches of ``batch_size``, each padded to its
own longest example, so little is padded and the batches depend on the rows alone, not
on how they are partitioned. The number of a row is the count of rows in the sorted
ranges before its own plus its place there: no window over all rows, and a length that
a third of the rows share (say, all that were cut) is spread like any other.

Defined results: a null text has no tokens; equal lengths go by key (nulls first), then
by tokens; repeated rows each take a place; the last batch may hold fewer rows; an empty
table gives no batch; batches are numbered from 0, shortest examples first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.session import materialize

Encode = Callable[[list[str]], list[list[int]]]
PAD_ID = 0

_LOADED: dict[str, Encode] = {}


def loaded(name: str, load: Callable[[], Encode]) -> Encode:
    """The tokenizer ``name``, loaded at its first use in this worker."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def hashed_words() -> Encode:
    """A tokenizer without a vocabulary: each word between ASCII white space becomes
    1 + the first 16 bits of its md5."""
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def encode(texts: list[str]) -> list[list[int]]:
        return [[1 + int.from_bytes(hashlib.md5(w.encode()).digest()[:2], "big") for w in word.findall(t)] for t in texts]

    return encode


def encode_texts(df: DataFrame, key: str, text: str, load: Callable[[], Encode], name: str,
                 max_len: int | None = None, rows: int = 256) -> DataFrame:
    """(key, input_ids, n_tokens): the token ids of every text, at most ``max_len`` of
    them, and their number. ``load`` returns the encoder and ``name`` tells tokenizers
    apart within a worker; ``rows`` texts at a time go to the encoder."""
    given = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = loaded(name, load)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                ids = [x[:max_len] for x in encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int32())],
                    ["key", "input_ids", "n_tokens"])

    kind = given.schema["key"].dataType.simpleString()
    return given.mapInArrow(run, f"key {kind}, input_ids array<int>, n_tokens int").withColumnRenamed("key", key)


def numbered(df: DataFrame, order: list[str], name: str, out: str = "pos") -> DataFrame:
    """``df`` with each row's number from 0 in ``order`` over all rows; written once. Only
    one count per range of rows is broadcast."""
    keys = [F.col(c) for c in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = materialize(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                         .withColumn("_seq", F.monotonically_increasing_id()), name)
    part = F.shiftright("_seq", 33)
    sizes = sorted((r["part"], r["n"]) for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for p, n in sizes:                       # one row per partition
        before.append((p, total))
        total += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_part long, _before long"))
    place = F.col("_seq") - F.shiftleft(part, 33) + F.col("_before")
    return ranged.join(offsets, part == F.col("_part")).select(*[F.col(f"`{c}`") for c in df.columns], place.alias(out))


def padded_batches(examples: DataFrame, key: str, batch_size: int, ids: str = "input_ids",
                   pad_id: int = PAD_ID) -> DataFrame:
    """(batch, width, rows): ``rows`` are (slot, key, n_tokens, input_ids, attention_mask) in
    order, padded on the right with ``pad_id`` to ``width``, the longest of the batch."""
    given = examples.select(F.size(ids).alias("n_tokens"), F.col(f"`{key}`").alias("key"),
                            F.col(f"`{ids}`").alias("ids"))
    dealt = numbered(given, ["n_tokens", "key", "ids"], "padded-batches")
    slot = (F.col("pos") % batch_size).cast("int")
    batch = dealt.groupBy(F.floor(F.col("pos") / batch_size).alias("batch")).agg(
        F.max("n_tokens").alias("width"),
        F.array_sort(F.collect_list(F.struct(slot.alias("slot"), "key", "n_tokens", "ids"))).alias("own"))   # batch_size rows

    def filled(row: Column) -> Column:
        missing = F.col("width") - row["n_tokens"]
        return F.struct(
            row["slot"].alias("slot"), row["key"].alias("key"), row["n_tokens"].alias("n_tokens"),
            F.concat(row["ids"], F.array_repeat(F.lit(pad_id), missing)).alias("input_ids"),
            F.concat(F.array_repeat(F.lit(1), row["n_tokens"]), F.array_repeat(F.lit(0), missing)).alias("attention_mask"))

    return batch.select("batch", "width", F.transform("own", filled).alias("rows"))
