"""Card tables in and out (S-1, S-3, S-4, S-8).

Every reader passes an explicit schema; nothing is inferred. The source
system keeps its printings in a SQLite file; here the three tables are read
from exported Parquet/CSV/JSON (or over JDBC when a driver jar is supplied),
and the filtered card relation is written as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.operators.canonical import canonical_rows, typed_cards
from lexiforge.schemas import LEGALITIES, PRINTINGS, RULINGS, STATIC_QA


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
          **options) -> DataFrame:
    if fmt == "csv":
        # CSV maps a schema by position; map by header name instead: read the
        # columns as text (no inference) and cast each schema field by name.
        raw = spark.read.option("header", True).options(**options).csv(path)
        return raw.select(*[(F.col(f.name) if f.name in raw.columns else F.lit(None))
                            .cast(f.dataType).alias(f.name) for f in schema.fields])
    return spark.read.schema(schema).options(**options).format(fmt).load(path)


def read_printings(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """S-1: the printings table (all source columns, numbers-as-text kept)."""
    return _read(spark, path, PRINTINGS, fmt, **options)


def read_legalities(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return _read(spark, path, LEGALITIES, fmt, **options)


def read_rulings(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return _read(spark, path, RULINGS, fmt, **options)


def read_jdbc_table(spark: SparkSession, url: str, table: str, schema: T.StructType,
                    **options) -> DataFrame:
    """S-1 over JDBC (needs the driver jar on the classpath). Only the schema's
    columns are selected, so the database sends nothing else."""
    cols = ", ".join(f'"{f.name}"' for f in schema.fields)
    df = (spark.read.format("jdbc").option("url", url)
          .option("query", f"SELECT {cols} FROM {table}").options(**options).load())
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def build_filtered_cards(spark: SparkSession, printings_path: str, legalities_path: str,
                         rulings_path: str, out_path: str, fmt: str = "parquet",
                         legal_format: str = "modern", mode: str = "ignore") -> None:
    """S-1 -> canonical rows -> S-3. ``mode="ignore"`` skips the build when the
    output already exists (the source system's file-exists check)."""
    rows = canonical_rows(read_printings(spark, printings_path, fmt),
                          read_legalities(spark, legalities_path, fmt),
                          read_rulings(spark, rulings_path, fmt), fmt=legal_format)
    rows.write.mode(mode).parquet(out_path)


def read_cards(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """S-4: the filtered cards, typed and normalised. Lazy; persist only when
    a job reads it more than once."""
    return typed_cards(spark.read.parquet(path), compat=compat)


def read_static_qa(spark: SparkSession, path: str, fmt: str = "json", **options) -> DataFrame:
    """S-8: a user-supplied (question, answer) table."""
    if fmt == "json":
        options.setdefault("multiLine", True)
    return _read(spark, path, STATIC_QA, fmt, **options)
