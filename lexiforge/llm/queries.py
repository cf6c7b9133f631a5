"""The registered queries of this subpackage: each applies one operator with
production parameters to the whole of its table and derives the contract's
digest columns from the operator's own output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import (bpe, chat_format, decontamination, hard_negatives, langid, merkle, ngram_join, pii,
                           quality_cnn, quality_rules, toxicity, url_filters, warc)
from lexiforge.llm.common import fold, table

VOCABULARY = "byte_bpe_50k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = quality_cnn.learn(docs, labels.where(fold("doc_id", 5) != 0))
    out = quality_cnn.score_quality(docs, net)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages")).select(
        "page_id", "host", "path", "rule", "verdict")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = f"{chat_format.END}{chat_format.START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    out = chat_format.format_conversations(rows.unionByName(extra), public_tokenizers.path(VOCABULARY))
    return chat_format.digest_formatted(out)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.captures(table(spark, sf_dir, "pages"))
    fields = F.col("metadata.fields")
    refers = F.regexp_extract("main.refers_to", r"main:([^:>]*)", 1)
    return out.select(
        F.expr("try_cast(metadata.fields['key'] AS bigint)").alias("page_id"),
        F.coalesce(F.col("main.payload_bytes"), fields["payloadLength"].cast("long")).alias("payload_bytes"),
        F.col("main.payload_digest").alias("payload_digest"), "record_type",
        F.when(F.col("record_type") == "revisit", refers.cast("long")).alias("refers_to"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = langid.learn(docs.where(fold("doc_id", 3) != 1))
    out = langid.identify(docs, filters)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels.where(fold("doc_id", 3) != 1))
    out = toxicity.score_toxicity(docs, lexicon)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score",
                      (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = merkle.document_leaves(
        table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "source", "text",
        fold("doc_id", 5) == 0)
    manifest = merkle.build(leaves, "doc_id", "leaf", "source")
    return merkle.verify(manifest, "doc_id", "leaf", "source", "claimed").select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = pii.train(pii.labelled_examples(spark))
    return pii.digest_spans(pii.find_pii(table(spark, sf_dir, "documents"), field))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_bpe, op2_quality_classifier, op3_quality_rules, op4_decontamination,
        op5_url_filters, op6_chat_formatting,
        op7_ngram_join, op8_warc, op9_language_id, op10_toxicity, op11_merkle_manifest, op12_pii, op13_hard_negatives)}
