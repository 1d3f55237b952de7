"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import stages
from tessera.llm.common import stored

STAGES = [
    ("quality", stages.quality_rules),
    ("line_dedup", stages.line_dedup),
    ("near_duplicates", stages.near_duplicates),
    ("mixing", stages.mixing),
    ("tokens", stages.tokens),
]
#: Robust covariances, min-hash links and tokenizers have no SQL form; tests cover repeated rows and parts of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's result written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
