"""What became of votes: entries as of their day, labels once the window is full, the too old dropped, each vote resolved once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ["model_id", "symbol", "at"]


def drop_days(horizon: int) -> int:
    """Calendar days after which a vote is given up: three horizons of sessions."""
    return math.ceil(3 * horizon * 365.25 / 252)


def entries(votes: DataFrame, bars: DataFrame) -> DataFrame:
    """``votes`` with ``entry``, the number ``n`` of the last bar of ``symbol, ts, n`` whose date is not after the vote's; null if there is none.

    Votes and bars meet as a union in one exchange by symbol.
    """
    marks = bars.select("symbol", F.to_date("ts").alias("day"), F.lit(0).alias("o"), F.col("n").cast("long").alias("entry"))
    asked = votes.select("symbol", F.to_date("at").alias("day"), F.lit(1).alias("o"), F.struct(*[F.col(f"`{c}`") for c in votes.columns]).alias("vote"))
    w = Window.partitionBy("symbol").orderBy("day", "o").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(marks, allowMissingColumns=True).withColumn("entry", F.last("entry", True).over(w))
    return both.where("o = 1").select("vote.*", "entry")


def outcomes(votes: DataFrame, bars: DataFrame, labels: DataFrame, now: Column, horizon: int = 63, sigma_window: int = 20) -> DataFrame:
    """KEYS, ``signal, status, label, signed_return, correct`` of the votes ``model_id, symbol, at, signal`` up to ``now``.

    ``bars`` are ``symbol, ts, n, c`` and ``labels`` ``symbol, n, touch, label`` of bars known by now. ``resolved``: the entry has a label;
    the return from the entry to the touch is what the position paid, its sign turned for a SELL, and the vote is correct if the label agrees. ``dropped``: older than
    :func:`drop_days` without a usable entry (``sigma_window`` bars before it) or label. Others are ``pending``.
    """
    asked = entries(votes.where(F.col("at") <= now).select(*KEYS, "signal"), bars)
    usable = F.when(F.col("entry") > sigma_window, F.col("entry"))
    asked = asked.withColumn("n", usable)
    known = labels.where("label is not null").select("symbol", F.col("n").cast("long").alias("n"), F.col("touch").cast("long").alias("touch"), "label")
    close = bars.select("symbol", F.col("n").cast("long").alias("n"), "c")
    rows = asked.join(known, ["symbol", "n"], "left").join(close.withColumnRenamed("c", "paid"), ["symbol", "n"], "left")
    rows = rows.join(close.select("symbol", F.col("n").alias("touch"), F.col("c").alias("got")), ["symbol", "touch"], "left")
    done, old = F.col("label").isNotNull() & F.col("got").isNotNull(), F.col("at") < now - F.expr(f"INTERVAL {drop_days(horizon)} DAYS")
    raw = F.try_divide(F.col("got"), F.col("paid")) - 1
    return rows.select(
        *KEYS, "signal", F.when(done, "resolved").when(old, "dropped").otherwise("pending").alias("status"), F.when(done, F.col("label")).alias("label"),
        F.when(done, F.when(F.col("signal") == "BUY", raw).otherwise(-raw)).alias("signed_return"), F.when(done, (F.col("label") == 1) == (F.col("signal") == "BUY")).alias("correct"),
    )


def resolve(spark: SparkSession, store: str, run: str, votes: DataFrame, bars: DataFrame, labels: DataFrame, now: Column, horizon: int = 63, sigma_window: int = 20) -> DataFrame:
    """Appends to ``store`` what ``run`` resolves or drops of the votes that no other run has; returns that. A run's folder is written anew, so a replay adds nothing."""
    votes = votes.dropDuplicates(KEYS)
    try:
        before = spark.read.parquet(store).where(F.col("run") != F.lit(run)).select(*KEYS)
        votes = votes.join(before, KEYS, "left_anti")
    except Exception as missing:  # noqa: BLE001 - the first run has no store
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
    out = outcomes(votes, bars, labels, now, horizon, sigma_window).where("status <> 'pending'")
    out.write.mode("overwrite").parquet(f"{store}/run={run}")
    return spark.read.parquet(f"{store}/run={run}")


def measured(outcomes: DataFrame, now: Column, days: int = 30, horizon: int = 63, least: int = 10) -> DataFrame:
    """``model_id, n, accuracy, sharpe`` at one moment: of the resolved votes of the last ``days`` days; null for fewer than ``least``."""
    rows = outcomes.where((F.col("status") == "resolved") & (F.col("at") <= now) & (F.col("at") >= now - F.expr(f"INTERVAL {int(days)} DAYS")))
    out = rows.groupBy("model_id").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("hit"), F.coalesce(F.try_divide(F.avg("signed_return"), F.stddev_samp("signed_return")) * math.sqrt(252.0 / horizon), F.lit(0.0)).alias("ratio"))
    enough = F.col("n") >= least
    return out.select("model_id", "n", F.when(enough, F.col("hit")).alias("accuracy"), F.when(enough, F.col("ratio")).alias("sharpe"))
