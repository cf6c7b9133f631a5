"""Streaming forms of the narrow operators (section 2.14).

Every card builder, chat render of a stored pair, and tokeniser is a narrow
projection, so the batch functions apply unchanged to a streaming DataFrame.
``stream_pairs`` runs the QA fan-out over a file source to a Parquet sink;
``trigger(availableNow=True)`` processes what is there and stops, so a
scheduled job gets exactly-once output through the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lexiforge.operators.canonical import typed_cards
from lexiforge.operators.qa import QaTemplate, card_templates, fanout


def card_pair_stream(spark: SparkSession, source_dir: str, schema: T.StructType,
                     templates: list[QaTemplate] | None = None, fmt: str = "parquet",
                     keep: list[str] | None = None) -> DataFrame:
    """Streaming DataFrame of (keep..., builder, question, answer) from card
    rows arriving as files in ``source_dir``."""
    rows = spark.readStream.schema(schema).format(fmt).load(source_dir)
    return fanout(typed_cards(rows), templates or card_templates(), keep or ["uuid"])


def stream_pairs(spark: SparkSession, source_dir: str, schema: T.StructType, sink_dir: str,
                 checkpoint_dir: str, templates: list[QaTemplate] | None = None,
                 available_now: bool = True) -> StreamingQuery:
    df = card_pair_stream(spark, source_dir, schema, templates)
    w = (df.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
