"""From raw documents to packed training sequences, stage by stage; each stage's result is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontaminate, packing, parity_join, quality_rules, repeats, token_counts
from tracewell.llm.support import shared_dir


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines above the limit; `n_chars` is counted again."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = quality_rules.quality_rules(docs, keep=others, clean="text").where("kept")
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities of 0.8 or more on five-word shingles link."""
    return parity_join.keep_one(docs, percent=80, n_words=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that documents of smaller doc_id have."""
    return repeats.without_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten consecutive words of a benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in the training sequences, in tokens of the 50k vocabulary and their ends."""
    import public_tokenizers

    counts = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(counts, packing.tokens_and_end())


STAGES = [
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark passages", benchmark_passages),
    ("sequences", sequences),
]

ORACLE_SQL = None  # the repeats are judged on bytes and the sequences depend on their order; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
