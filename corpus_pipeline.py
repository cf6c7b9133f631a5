"""The corpus pipeline: filter, deduplicate, decontaminate and encode documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``.

Defined results: null and empty texts break the base rule and go at the first stage;
repeated rows are one group of copies, of which one stays (a null id after all others);
without labels the network scores 0.5 and keeps all; an empty benchmark removes nothing; an
empty table gives an empty result; other columns travel with their rows whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexiforge.llm import bpe, decontamination, ngram_join, quality_cnn, quality_rules
from lexiforge.llm.common import fold, table
from lexiforge.session import materialize


def quality_rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go."""
    return quality_rules.keep_good(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.3 go. The network learns from labelled rows of the
    whole table (the rules have already taken most bad examples out of ``docs``)."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    net = quality_cnn.learn(table(spark, sf_dir, "documents"), labels)
    return quality_cnn.keep_good(docs, net)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by n-gram similarity, the least id stays."""
    return ngram_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rule_stage),
    ("quality_classifier", classifier_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("bpe", encoding_stage),
]

#: A network and a tokenizer are not SQL; tests compare with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
