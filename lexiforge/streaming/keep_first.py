"""Keep-first-row maintenance on a stream (W-1 over arriving printings).

The canonical table (one row per (name, side), lowest key wins) is stored by hash
buckets of (name, side), under a manifest that names the folder of each bucket
(``versions``). Each micro-batch:

1. tags its rows with their bucket and finds the touched buckets (at most the
   bucket count, so collecting their ids is bounded);
2. reads only those buckets of the current version, unions the new rows and keeps
   the top-1 per (name, side) -- a partial ``WindowGroupLimit`` as in the batch operator;
3. writes the touched buckets to a new folder, then publishes the next version.

Nothing that a version names is ever changed or deleted: a stop before the publish
leaves the last version whole, and the replayed batch (top-1 of a union is
idempotent) gives what it would have given. The checkpointed stream is therefore
exactly-once in effect, wherever it stops. Readers use :func:`read_canonical`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lexiforge.functions.text import md5_bucket
from lexiforge.versions import new_folder, publish, read_manifest


def _bucket(name: str, side: str, buckets: int):
    return md5_bucket(F.concat_ws("\u0001", F.col(name), F.coalesce(F.col(side), F.lit("\u0000"))),
                      buckets)


def merge_batch(batch: DataFrame, target: str, buckets: int = 64, key: str = "uuid",
                name: str = "name", side: str = "side") -> None:
    spark = batch.sparkSession
    rows = batch.withColumn("bucket", _bucket(name, side, buckets))
    touched = [r[0] for r in rows.select("bucket").distinct().collect()]
    if not touched:
        return
    now = read_manifest(spark, target)
    stored = dict(now[1]["buckets"]) if now else {}
    current = _read(spark, stored, touched)
    if current is not None:
        rows = current.unionByName(rows, allowMissingColumns=True)
    w = Window.partitionBy(name, side).orderBy(F.col(key).asc())
    top = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    folder = new_folder(target, "buckets")
    top.write.partitionBy("bucket").parquet(folder)
    stored.update({str(b): folder for b in touched})
    publish(spark, target, {"buckets": stored}, now[0] if now else 0)


def _read(spark: SparkSession, stored: dict[str, str], buckets: list[int] | None = None) -> DataFrame | None:
    """The rows of the named buckets (all if None), each from its folder; None if none is stored."""
    by_folder: dict[str, list[int]] = {}
    for b, folder in stored.items():
        if buckets is None or int(b) in buckets:
            by_folder.setdefault(folder, []).append(int(b))
    out = None
    for folder, own in sorted(by_folder.items()):
        part = spark.read.parquet(folder).where(F.col("bucket").isin(own))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_canonical(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """The canonical rows of a version (the last if None); FileNotFoundError without one."""
    found = read_manifest(spark, target, version)
    rows = _read(spark, found[1]["buckets"]) if found else None
    if rows is None:
        raise FileNotFoundError(f"no canonical table at {target}")
    return rows.drop("bucket")


def maintain_canonical(spark: SparkSession, source_dir: str, schema: T.StructType, target: str,
                       checkpoint_dir: str, buckets: int = 64, fmt: str = "parquet",
                       available_now: bool = True) -> StreamingQuery:
    """Stream printings from ``source_dir`` into the keep-first table at
    ``target``. Rows are expected already filtered to the wanted legality."""
    src = spark.readStream.schema(schema).format(fmt).load(source_dir)
    w = (src.writeStream.foreachBatch(lambda df, _epoch: merge_batch(df, target, buckets))
         .option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
