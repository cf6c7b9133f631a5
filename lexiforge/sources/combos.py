"""The combo document (S-2): one JSON object holding a ``variants`` array.

A single multi-line JSON file is one unsplittable task, so it is read once
with the explicit schema and landed as Parquet; every later job (shred,
nest, QA) reads the landed copy in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.operators.nest import ComboTables, shred_variants
from lexiforge.schemas import VARIANT, VARIANTS_DOC


def _documents(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType(VARIANTS_DOC.fields + [T.StructField("_corrupt_record", T.StringType())])
    return (spark.read.schema(schema).option("multiLine", True)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
            .json(path))


def broken_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, corrupt_record, n_variants) of the documents that do not parse;
    n_variants: what could be read of them (Spark does not read the corrupt
    record alone, hence also the second condition)."""
    return (_documents(spark, path).withColumn("path", F.input_file_name())
            .where(F.col("_corrupt_record").isNotNull() & (F.coalesce(F.size("variants"), F.lit(0)) >= 0))
            .select("path", F.col("_corrupt_record").alias("corrupt_record"),
                    F.coalesce(F.size("variants"), F.lit(0)).alias("n_variants")))


def read_variants_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per variant of the file or folder ``path``. A document that does
    not parse fails the read; ``broken_documents`` lists such documents."""
    doc = _documents(spark, path)
    whole = F.when(F.col("_corrupt_record").isNull(), F.col("variants")).otherwise(
        F.raise_error(F.concat(F.lit("broken combo document: "), F.substring("_corrupt_record", 1, 80))))
    return doc.select(F.explode(whole).alias("v")).select("v.*")


def land_variants(spark: SparkSession, json_path: str, parquet_path: str,
                  mode: str = "ignore") -> DataFrame:
    """Read the JSON once and write it as Parquet (skipped if present), dealt
    over the shuffle partitions so that later jobs read it in parallel."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    read_variants_json(spark, json_path).repartition(parts).write.mode(mode).parquet(parquet_path)
    return spark.read.schema(VARIANT).parquet(parquet_path)


def load_combos(spark: SparkSession, json_path: str, parquet_path: str) -> ComboTables:
    """S-2 end to end: land, then shred into the four keyed tables."""
    return shred_variants(land_variants(spark, json_path, parquet_path))
