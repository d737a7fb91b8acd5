"""Queries of the numbered operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.llm import (bbit_minhash, byte_bpe, chat_format, conversation_repair, line_set_dedup, log_bilinear, order_minhash, patience_license,
                           preference_quality, rans_store, secret_scan, source_divergence, suffix_decontamination)
from convolake.llm.common import hex_sha256, table


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit_minhash.duplicate_components(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return preference_quality.score_documents(docs, preference_quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patience_license.scan_licenses(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans_store.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.secret_report(docs, words=secret_scan.frequent_words(docs))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_set_dedup.dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_removed", hex_sha256(F.coalesce("text", F.lit("")).cast("binary")).alias("text_sha256"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.score(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit_sources(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.with_example(table(spark, sf_dir, "conversations"))
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return chat_format.read_digests(chat_format.format_conversations(rows, *vocabulary), *vocabulary)


QUERIES = {f.__name__: f for f in (op1_order_minhash, op2_minhash_dedup, op3_quality, op4_license_scan, op5_byte_bpe, op6_token_files, op7_decontamination, op8_secret_scan, op9_line_dedup, op10_lm_scores,
                                   op11_source_divergence, op12_conversation_repair, op13_chat_format)}
ORACLES: dict[str, str] = {"op11_source_divergence": source_divergence.ORACLE_SQL}
