"""Combinatorial paths: which split tests each block of sessions in which path, what a path earns, and how paths differ."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def path_count(groups: int, tests: int) -> int:
    return math.comb(groups, tests) * tests // groups if 0 < tests < groups else 0


def splits(spark: SparkSession, groups: int, tests: int) -> DataFrame:
    """``split, group``: the blocks that each split tests. Splits are the numbers of ``groups`` bits with ``tests`` set, in the order of their blocks.

    The numbers are a range that is filtered by Spark; of ``groups`` bits, so 30 at most.
    """
    if not 0 < tests < groups <= 30:
        raise ValueError("tests must be in (0, groups) and groups at most 30")
    chosen = spark.range(1 << groups).where(F.bit_count("id") == tests).select((F.row_number().over(Window.orderBy(F.desc("id"))) - 1).alias("split"), "id")
    each = chosen.select("split", "id", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    return each.where(F.expr(f"(id >> ({groups - 1} - group)) & 1 = 1")).select("split", "group")


def paths(tested: DataFrame) -> DataFrame:
    """``path, group, split``: the path's predictions for each block come from this split.

    A block's k-th split by number serves path k, so a path has each block once and each tested block of a split is used once.
    """
    at = F.row_number().over(Window.partitionBy("group").orderBy("split")) - 1
    whole = tested.select(F.countDistinct("group").alias("groups"))
    rows = tested.select(at.alias("path"), "group", "split")
    complete = rows.groupBy("path").agg(F.count("*").alias("m")).join(F.broadcast(whole)).where("m = groups").select("path")  # a split that was dropped leaves no half path
    return rows.join(F.broadcast(complete), "path")


def blocks(sessions: DataFrame, groups: int) -> DataFrame:
    """``ts, i, group``: sessions in equal blocks. The table of sessions alone is numbered as a whole."""
    rows = sessions.select("ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("ts")) - 1)
    rows = rows.join(F.broadcast(rows.agg(F.count("*").alias("n"))))
    group = F.floor(((F.col("i") + 1) * groups - 1) / F.col("n"))
    return rows.select("ts", "i", group.cast("int").alias("group"))


def dispersion(rows: DataFrame, value: str) -> DataFrame:
    """``paths, mean, std, least, most, share_positive`` of the paths whose value is a number."""
    v = F.when(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    return rows.agg(
        F.count(v).alias("paths"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.coalesce(F.min(v), F.lit(0.0)).alias("least"),
        F.coalesce(F.max(v), F.lit(0.0)).alias("most"), F.avg((v > 0).cast("double")).alias("share_positive"),
    )
