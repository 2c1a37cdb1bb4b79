"""From raw documents to packed sequences, a written table between any two stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskflow.llm.decontamination import without_leaks
from riskflow.llm.exact_dedup import without_exact_duplicates
from riskflow.llm.ngram_join import without_near_duplicates
from riskflow.llm.packing import pack_documents
from riskflow.llm.quality_resampling import without_rejected
from riskflow.llm.queries import TOKENIZER
from riskflow.llm.stored import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance weights reject go."""
    return without_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the smallest id stays."""
    return without_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the smallest id stays."""
    return without_near_duplicates(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark go."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, with their sequence and place."""
    return pack_documents(docs, TOKENIZER, with_ids=False)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_leaks),
    ("best_fit_packing", packing),
]

#: Weights, components and token ids have no form in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
