"""The stages of the corpus pipeline: each takes and returns documents; rows without a doc_id go in the first.

A stage keeps all columns of its documents under whatever names they have. An empty table gives one; null and empty texts are documents without words; rows of one doc_id
are judged by their id together, and those of them that stay do so with all their columns, but for near duplicates, where one row of an id stays (ties in :func:`one_row`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import bpe, lines, minhash, quality
from tessera.llm import mixing as mix_of
from tessera.llm.common import Apart, repeated_ids
from tessera.llm.queries import vocabulary


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id ``ids`` has."""
    apart = Apart(docs)
    kept = apart.docs.join(ids.select(F.col("doc_id").alias("__id")), F.col("doc_id") == F.col("__id"), "left_semi")
    return apart.restored(kept)


def one_row(docs: DataFrame) -> DataFrame:
    """One row of each doc_id: that with the longest text, of these the first by text, lang, source and the other columns as JSON."""
    apart, many = Apart(docs), repeated_ids(docs)
    rows, same = apart.docs, F.col("doc_id") == F.col("__many")
    last = F.to_json("rest") if apart.others else F.lit(0)
    order = Window.partitionBy("doc_id").orderBy(F.desc_nulls_last(F.length("text")), *[c for c in ("text", "lang", "source") if c in rows.columns], last)
    first = rows.join(many, same, "left_semi").withColumn("__at", F.row_number().over(order)).where("__at = 1").drop("__at")
    return apart.restored(rows.join(many, same, "left_anti").unionByName(first))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return _only(docs, quality.verdicts(docs).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that come earlier somewhere."""
    return lines.without_lines(docs.where("doc_id is not null"), lines.dropped_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates; one row of a repeated doc_id."""
    docs = one_row(docs)
    return _only(docs, minhash.near_duplicates(docs).where("kept"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mix_of.repeated(docs, mix_of.mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row."""
    path = vocabulary("word_bpe_49k.json")
    return bpe.digests(bpe.encode_blocks(docs, path), path)
