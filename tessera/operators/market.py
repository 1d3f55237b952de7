"""Bars from trades, trailing features, cross-sectional ranks and selections, drawdowns, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def bars(lineitem: DataFrame, part: DataFrame, unit: str = "day") -> DataFrame:
    """``symbol, ts, open, high, low, close, volume, adj_close``: one partial aggregate, one exchange. A quantity of 0 gives no price.

    Quantities and discounts are added up as whole millionths, so that the order in which rows arrive leaves no trace in the bars.
    """
    rows = lineitem.join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol")), "l_partkey")
    px = F.try_divide("l_extendedprice", "l_quantity")
    key = F.struct(*ORDER)
    whole = lambda c: F.round(F.col(c) * 1000000).cast("long")
    rows = rows.select("symbol", F.date_trunc(unit, "l_shipdate").alias("ts"), px.alias("px"), key.alias("k"), "l_quantity", "l_discount")
    out = rows.groupBy("symbol", "ts").agg(
        F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"),
        (F.sum(whole("l_quantity")) / 1e6).alias("volume"), (F.sum(whole("l_discount")) / 1e6 / F.count("l_discount")).alias("d"),
    )
    return out.withColumn("adj_close", F.col("close") * (1 - F.col("d"))).drop("d")


def trailing(n: int) -> Window:
    return Window.partitionBy("symbol").orderBy("ts").rowsBetween(-(n - 1), 0)


def features(b: DataFrame) -> DataFrame:
    """Returns, averages, volatility and channel of the adjusted close; null where history is too short or a denominator is 0. One sort."""
    w = Window.partitionBy("symbol").orderBy("ts")
    c = F.coalesce("adj_close", "close")
    rows = b.select("symbol", "ts", c.alias("c"), "volume", F.row_number().over(w).alias("n"))
    rows = rows.withColumn("r", F.try_divide(F.col("c"), F.lag("c").over(w)) - 1)
    full = lambda n, x: F.when(F.col("n") >= n, x)
    return rows.select(
        "symbol", "ts", "c", F.col("r").alias("return_1d"),
        (F.try_divide(F.col("c"), F.lag("c", 5).over(w)) - 1).alias("return_5d"), (F.try_divide(F.col("c"), F.lag("c", 20).over(w)) - 1).alias("return_20d"),
        (F.try_divide(F.col("c"), F.lag("c", 20).over(w)) - 1).alias("momentum_20"),
        full(10, F.avg("c").over(trailing(10))).alias("sma_10"), full(20, F.avg("c").over(trailing(20))).alias("sma_20"), full(50, F.avg("c").over(trailing(50))).alias("sma_50"),
        full(21, F.stddev_samp("r").over(trailing(20)) * F.sqrt(F.lit(252.0))).alias("realized_vol_20"),
        full(20, F.try_divide(F.col("volume"), F.avg("volume").over(trailing(20)))).alias("volume_ratio"),
        full(21, F.max("r").over(trailing(20))).alias("max_ret_1m"),
    )


def percentile_rank(value: str, *by: str) -> Column:
    """Rank in [0, 1] within the cross-section, a session unless ``by`` says more: ties averaged, nulls left out, a single value is 0.5."""
    keys = by or ("ts",)
    group = Window.partitionBy(*keys, F.col(value).isNull())
    n, ties = F.count(value).over(group), F.count("*").over(Window.partitionBy(*keys, value))
    at = F.rank().over(group.orderBy(value)) - 1 + (ties - 1) / 2
    return F.when(F.col(value).isNull(), None).when(n == 1, 0.5).otherwise(at / (n - 1))


def top_quantile(rows: DataFrame, score: str, share: float = 0.2, by: str = "ts") -> DataFrame:
    """The best ``share`` of each session, one row at least; ties go to the smaller symbol."""
    group = Window.partitionBy(by)
    rows = rows.where(F.col(score).isNotNull())
    rows = rows.withColumn("__at", F.row_number().over(group.orderBy(F.desc(score), "symbol"))).withColumn("__n", F.count("*").over(group))
    return rows.where(F.col("__at") <= F.greatest(F.lit(1), F.ceil(F.col("__n") * share))).drop("__at", "__n")


def drawdowns(b: DataFrame) -> DataFrame:
    """``symbol, max_drawdown`` of the adjusted close from its running peak."""
    peak = F.max("adj_close").over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return b.select("symbol", (1 - F.try_divide(F.col("adj_close"), peak)).alias("dd")).groupBy("symbol").agg(F.max("dd").alias("max_drawdown"))


def coverage(b: DataFrame) -> DataFrame:
    """``symbol, first_ts, last_ts, sessions, stale``: stale if more than five days older than the newest bar."""
    last = b.agg(F.max("ts").alias("newest"))
    out = b.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("sessions"))
    return out.join(F.broadcast(last)).withColumn("stale", F.datediff("newest", "last_ts") > 5).drop("newest")  # one row


def positions(b: DataFrame) -> DataFrame:
    """Long or flat by ``sma_10`` against ``sma_50``, and the return of yesterday's position."""
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = features(b).withColumn("pos", F.when(F.col("sma_10") > F.col("sma_50"), 1).otherwise(0))
    return rows.select("symbol", "ts", "pos", (F.coalesce(F.lag("pos").over(w), F.lit(0)) * F.coalesce("return_1d", F.lit(0.0))).alias("ret"))
