"""Universes by liquidity, ingestion plans, trading costs and capacity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.market import trailing

#: Fixed values of the cost model: least and largest half spread, coefficient and largest share of volume, least bars.
LEAST_BPS, MOST_BPS, IMPACT, MOST_SHARE, LEAST_BARS = 1.0, 100.0, 1.0, 0.10, 21


def rebalances(bars: DataFrame, every: int = 63) -> DataFrame:
    """``ts``: the first session and each ``every``-th after it. The table of sessions alone is numbered as a whole."""
    sessions = bars.select("ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("ts")) - 1)
    return sessions.where(F.col("i") % every == 0).select("ts")


def members(bars: DataFrame, top: int, every: int = 63, window: int = 63, least_history: int = 63) -> DataFrame:
    """``ts, symbol, liquidity, place``: the ``top`` symbols of each rebalance by trailing median of close times volume, ties to the smaller symbol."""
    w = Window.partitionBy("symbol").orderBy("ts")
    liquidity = F.when(F.count("dv").over(trailing(window)) > window // 2, F.percentile("dv", F.lit(0.5)).over(trailing(window)))
    rows = bars.select("symbol", "ts", (F.col("close") * F.col("volume")).alias("dv"), F.row_number().over(w).alias("n")).select("symbol", "ts", "n", liquidity.alias("liquidity"))
    rows = rows.where((F.col("n") >= least_history) & F.col("liquidity").isNotNull()).join(F.broadcast(rebalances(bars, every)), "ts")  # sessions / every rows
    place = F.row_number().over(Window.partitionBy("ts").orderBy(F.desc("liquidity"), "symbol"))
    return rows.select("ts", "symbol", "liquidity", place.alias("place")).where(F.col("place") <= top)


def churn(members: DataFrame) -> DataFrame:
    """``ts, size, turnover``: symmetric difference over union with the rebalance before; null at the first."""
    dates = members.select("ts").distinct().select("ts", F.lead("ts").over(Window.orderBy("ts")).alias("next"))
    now = members.select("ts", "symbol", F.lit(1).alias("a"), F.lit(0).alias("b"))
    was = members.join(F.broadcast(dates), "ts").where("next is not null").select(F.col("next").alias("ts"), "symbol", F.lit(0).alias("a"), F.lit(1).alias("b"))
    each = now.unionByName(was).groupBy("ts", "symbol").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.groupBy("ts").agg(F.sum("a").alias("size"), F.when(F.sum("b") > 0, F.count_if(F.col("a") != F.col("b")) / F.count("*")).alias("turnover"))


def members_on(sessions: DataFrame, members: DataFrame) -> DataFrame:
    """``symbol, ts`` of the sessions whose symbol belongs to the last rebalance up to them; none before the first."""
    dates = members.select(F.col("ts").alias("of")).distinct()
    marks = sessions.select("ts").distinct().select("ts", F.lit(None).cast("timestamp").alias("of")).unionByName(dates.select(F.col("of").alias("ts"), "of"))
    last = marks.withColumn("of", F.last("of", True).over(Window.orderBy("ts").rangeBetween(Window.unboundedPreceding, 0))).distinct()  # a row for each session
    return sessions.select("symbol", "ts").join(F.broadcast(last), "ts").join(members.select("symbol", F.col("ts").alias("of")), ["symbol", "of"], "left_semi").select("symbol", "ts")


def survivorship(bars: DataFrame, days: int = 90) -> DataFrame:
    """``symbols, late_starters, early_enders``: names whose bars begin or end more than ``days`` inside the panel."""
    each = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    whole = each.agg(F.min("a").alias("lo"), F.max("b").alias("hi"))
    return each.join(F.broadcast(whole)).agg(F.count("*").alias("symbols"), F.count_if(F.datediff("a", "lo") > days).alias("late_starters"), F.count_if(F.datediff("hi", "b") > days).alias("early_enders"))


def fetch_plan(symbols: DataFrame, coverage: DataFrame, now: Column, depth_days: int, overlap_days: int) -> DataFrame:
    """``symbol, mode, start, repair_start``: all history for a new symbol, else from some days before its last bar; a repair reaches its earliest bar."""
    rows = symbols.select("symbol").distinct().join(coverage.select("symbol", "first_ts", "last_ts"), "symbol", "left")
    full, resume = F.date_sub(now, depth_days), F.when(F.col("last_ts").isNotNull(), F.least(F.date_sub(F.col("last_ts"), overlap_days), F.to_date(now)))  # least skips nulls
    return rows.select(
        "symbol", F.when(F.col("last_ts").isNull(), "full").otherwise("incremental").alias("mode"), F.coalesce(resume, full).alias("start"),
        F.least(full, F.to_date("first_ts")).alias("repair_start"), F.datediff(now, "last_ts").alias("age_days"),
    )


def weekdays(rows: DataFrame, at: str = "ts") -> DataFrame:
    return rows.where(~F.dayofweek(at).isin(1, 7))


def spreads(bars: DataFrame, window: int = 252) -> DataFrame:
    """``symbol, half_spread``: Corwin and Schultz' estimate in basis points over the last ``window`` bars, gaps overnight removed.

    Sums of squared ranges are averaged before they are transformed; a negative estimate means none is identified. Fewer than three bars or a
    price that is not positive give 0.
    """
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    rows = bars.withColumn("k", F.row_number().over(w)).where(F.col("k") <= window)
    w = Window.partitionBy("symbol").orderBy("ts")
    before = F.lag("close").over(w)
    shift = F.coalesce(F.greatest(before - F.col("high"), F.lit(0.0)) - F.greatest(F.col("low") - before, F.lit(0.0)), F.lit(0.0))
    rows = rows.select("symbol", "ts", F.least("high", "low", "close").alias("least"), (F.col("high") + shift).alias("h"), (F.col("low") + shift).alias("l"))
    good = (F.col("h") > 0) & (F.col("l") > 0)
    own = F.pow(F.log(F.when(good, F.col("h")) / F.when(good, F.col("l"))), 2)
    two = F.greatest("h", F.lag("h").over(w)) / F.when(good, F.least("l", F.lag("l").over(w)))
    pair = F.lag("h").over(w).isNotNull()
    rows = rows.select("symbol", "least", F.least("h", "l").alias("moved"), F.when(pair, own + F.lag(own).over(w)).alias("beta"), F.when(pair & (two > 0), F.pow(F.log(two), 2)).alias("gamma"))
    out = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.min(F.least("least", "moved")).alias("least"), F.avg("beta").alias("b"), F.avg("gamma").alias("g"))
    k = 3 - 2 * math.sqrt(2)
    alpha = (F.sqrt(2 * F.col("b")) - F.sqrt("b")) / k - F.sqrt(F.col("g") / k)
    half = F.least((F.exp(alpha) - 1) / (1 + F.exp(alpha)) * 1e4, F.lit(MOST_BPS))
    return out.select("symbol", F.when((F.col("n") >= 3) & (F.col("least") > 0) & (F.col("b") > 0), half).otherwise(0.0).alias("half_spread"))


def costs(bars: DataFrame, books: list[float], position: float = 0.05, window: int = 63) -> DataFrame:
    """``symbol, aum, half_spread, participation, impact, total_bps, tradeable``: one-way costs of a position of each book size."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    last = bars.withColumn("k", F.row_number().over(w)).where(F.col("k") <= window)
    c = F.coalesce("adj_close", "close")
    ret = F.try_divide(c, F.lag(c).over(Window.partitionBy("symbol").orderBy("ts"))) - 1
    each = last.select("symbol", (F.col("close") * F.col("volume")).alias("dv"), ret.alias("r")).groupBy("symbol")
    each = each.agg(F.count("*").alias("n"), F.percentile("dv", F.lit(0.5)).alias("dv"), F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("vol"))
    rows = each.join(spreads(bars, max(window, 252)), "symbol").withColumn("aum", F.explode(F.array(*[F.lit(float(a)) for a in books])))
    share = F.coalesce(F.try_divide(F.col("aum") * position, F.when(F.col("dv") > 0, F.col("dv"))), F.lit(0.0))
    few = F.col("n") < LEAST_BARS
    half = F.when(few, MOST_BPS).otherwise(F.greatest("half_spread", F.lit(LEAST_BPS)))
    rows = rows.select("symbol", "aum", "n", "vol", half.alias("half_spread"), F.when(few, 0.0).otherwise(share).alias("participation"), (~few & (F.col("dv") > 0) & (share <= MOST_SHARE)).alias("tradeable"))
    impact = IMPACT * F.when(F.col("participation") > 0, F.col("vol")).otherwise(0.0) * F.sqrt(F.least("participation", F.lit(MOST_SHARE))) * 1e4
    return rows.select("symbol", "aum", "half_spread", "participation", impact.alias("impact"), (F.col("half_spread") + impact).alias("total_bps"), "tradeable")


def capacity(costs: DataFrame) -> DataFrame:
    """``aum, names, median_bps, p90_bps, max_bps, untradeable``: the cost of a book by its size."""
    return costs.groupBy("aum").agg(
        F.count("*").alias("names"), F.percentile("total_bps", F.lit(0.5)).alias("median_bps"), F.percentile("total_bps", F.lit(0.9)).alias("p90_bps"),
        F.max("total_bps").alias("max_bps"), F.avg((~F.col("tradeable")).cast("double")).alias("untradeable"),
    )
