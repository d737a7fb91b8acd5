"""From raw documents to token ids, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``.

1. quality: documents that the pairwise classifier rejects go.
2. lines: lines that repeat earlier ones go; ``n_chars`` follows the text; a
   document that loses lines and is left without any word goes too.
3. near duplicates: one document of each group stays.
4. benchmark: documents with a benchmark passage go.
5. tokens: byte-level BPE ids, decoded again for a checksum.

An empty table passes through all stages; null texts are kept as they are
(they have no lines, shingles or windows) and have no tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.llm import bbit_minhash, byte_bpe, line_set_dedup, preference_quality, suffix_decontamination
from convolake.llm.common import discard, staged, table
from convolake.session import small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return preference_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_set_dedup.dedup_lines(docs, lines_col="__n_lines", removed_col="__n_removed")
    kept = kept.where((F.col("__n_removed") == 0) | F.col("text").rlike(r"\S")).drop("__n_lines", "__n_removed")
    if "n_chars" in docs.columns:
        counted = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text"))
        kept = kept.withColumn("n_chars", counted.cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with small_batches(spark):
        return bbit_minhash.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with small_batches(spark):
        return suffix_decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    # written in between: a task that encodes and decodes at once holds two Python workers, which outlive the stage
    with small_batches(spark):
        encoded = staged(byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN), "pipeline-ids")
        decoded = byte_bpe.decode_documents(encoded, path)
        out = staged(decoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256")), "pipeline-tokens")
    discard(encoded)
    return out


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("tokens", tokens)]

#: a classifier, connected components and BPE are beyond SQL; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
