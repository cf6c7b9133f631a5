"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.operators.broadcast import bounded_broadcast
from lexiforge.session import materialize

#: Words of every word-based operator here: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (a null id counts as empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose texts hold about ``max_bytes``
    (at least one row), so a worker's working memory is bounded by that or by
    its longest text, not by the batch's row count. Freed memory goes back to the
    system after each batch, as workers live on beyond a task."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = text_offsets(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
        del batch, offsets
        release_memory()


def release_memory() -> None:
    """Give freed memory of Arrow's pool and of malloc back to the system."""
    import ctypes
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):      # another C library
        pass


def text_offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets (rows + 1) of a string column into its value buffer."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=kind)[
        column.offset:column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and its offsets from 0."""
    offsets = text_offsets(column)
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer over uint64 values: one fixed pseudo-random order per seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & (2 ** 64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the row it is in. Rows are kept
    apart: a word never runs over the end of its text."""
    if not len(buf):
        e = np.zeros(0, np.int64)
        return e, e, e
    inside = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(buf))]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial over mixed byte values,
    taken from running sums (so the cost does not depend on span lengths)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        table = mix64(np.arange(1, 257, dtype=np.uint64), 7)
        base, inverse = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 2 ** 64))
        powers = np.empty(len(buf), np.uint64)
        powers[0] = 1
        powers[1:] = base
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(table[buf] * powers, out=sums[1:])
        back = np.empty(len(buf), np.uint64)
        back[0] = 1
        back[1:] = inverse
        np.multiply.accumulate(back, out=back)
        return mix64((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64), 3)


def place(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with their number ``pos`` within the group, in ``order``, and the
    group's count ``n``; written once. Sorted by ranges over all tasks."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = [F.col(group), *[F.col(c) for c in order]]
    ranged = materialize(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn(
        "seq", F.monotonically_increasing_id()), name)
    part = F.shiftright("seq", 33)
    counts = ranged.groupBy(F.col(group).alias("g"), part.alias("part")).agg(
        F.count("*").alias("rows"), F.min("seq").alias("first"))
    by_group = Window.partitionBy("g")
    offsets = counts.select(
        "g", "part", "first",
        (F.sum("rows").over(by_group.orderBy("part")) - F.col("rows")).alias("before"), F.sum("rows").over(by_group).alias("n"))
    small, _ = bounded_broadcast(materialize(offsets, name + "-offsets"))
    return ranged.join(small, F.col(group).eqNullSafe(F.col("g")) & (part == F.col("part"))).select(
        *rows.columns, (F.col("before") + F.col("seq") - F.col("first")).alias("pos"), "n")
