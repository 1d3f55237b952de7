"""Further trailing features of bars: momentum, bands, channels, oscillators, volume lines. One sort by symbol and time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.market import trailing

MONTH, HALF_YEAR, YEAR = 21, 126, 252


def adjusted(b: DataFrame) -> DataFrame:
    """``symbol, ts, close (raw), c, h, l (adjusted), v``; without an adjusted close the raw prices stand."""
    f = F.coalesce(F.try_divide("adj_close", "close"), F.lit(1.0))
    return b.select("symbol", "ts", "close", F.coalesce("adj_close", "close").alias("c"), (F.col("high") * f).alias("h"), (F.col("low") * f).alias("l"), F.col("volume").alias("v"))


def _over(positive: str | Column, x: Column) -> Column:
    return F.when((F.col(positive) if isinstance(positive, str) else positive) > 0, x)


def technical(b: DataFrame) -> DataFrame:
    """Features of each bar and the bars before it; null where history is too short or a denominator is not positive.

    All windows share one partitioning and order, so Spark exchanges and sorts the bars once. Frames are bounded;
    the two running volume lines enter only as slopes, which do not depend on where the lines start.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    run, prior = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(-20, -1)
    rows = adjusted(b).withColumn("n", F.row_number().over(w)).withColumn("tp", (F.col("h") + F.col("l") + F.col("c")) / 3)
    rows = rows.select(
        "*", (F.try_divide(F.col("c"), F.lag("c").over(w)) - 1).alias("r"), (F.col("close") * F.col("v")).alias("dv"),
        (F.signum(F.col("c") - F.lag("c").over(w)) * F.col("v")).alias("signed"), (F.col("tp") - F.lag("tp").over(w)).alias("dtp"),
        F.when(F.col("h") > F.col("l"), (2 * F.col("c") - F.col("l") - F.col("h")) / (F.col("h") - F.col("l")) * F.col("v")).otherwise(0.0).alias("ad"),
        F.max("h").over(trailing(14)).alias("hi14"), F.min("l").over(trailing(14)).alias("lo14"),
    )
    flow = F.col("tp") * F.col("v")
    k = F.when((F.col("n") >= 14) & (F.col("hi14") > F.col("lo14")), 100 * (F.col("c") - F.col("lo14")) / (F.col("hi14") - F.col("lo14")))
    rows = rows.select(
        "*", k.alias("k"), F.coalesce(F.sum("signed").over(run), F.lit(0.0)).alias("obv"), F.sum("ad").over(run).alias("adl"),
        F.avg("c").over(trailing(20)).alias("mid"), F.stddev_pop("c").over(trailing(20)).alias("sd"), F.avg("tp").over(trailing(20)).alias("mtp"),
        F.collect_list("tp").over(trailing(20)).alias("tps"), F.avg("v").over(trailing(20)).alias("av"), F.avg("dv").over(trailing(20)).alias("adv"),
        F.max("h").over(prior).alias("ch"), F.min("l").over(prior).alias("cl"),
        F.sum(F.when(F.col("dtp") > 0, flow).otherwise(0.0)).over(trailing(20)).alias("up"), F.sum(F.when(F.col("dtp") < 0, flow).otherwise(0.0)).over(trailing(20)).alias("down"),
        F.min_by("n", F.struct((-F.col("h")).alias("x"), "n")).over(trailing(26)).alias("at_high"), F.min_by("n", F.struct("l", "n")).over(trailing(26)).alias("at_low"),
    )
    full = lambda n, x: F.when(F.col("n") >= n, x)
    mad = F.aggregate("tps", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("mtp"))) / 20
    aroon = lambda at: 100.0 * (25 - (F.col("n") - F.col(at))) / 25
    impact = F.when(F.col("dv") > 0, F.abs("r") / F.col("dv"))
    return rows.select(
        "symbol", "ts",
        full(50, F.try_divide(F.col("c"), F.avg("c").over(trailing(50)))).alias("price_to_sma50"),
        full(21, F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), 2)).over(trailing(20))) * F.sqrt(F.lit(252.0))).alias("downside_vol_20"),
        full(21, _over("adv", F.col("adv"))).alias("dollar_volume_20"),
        full(21, F.avg(impact).over(trailing(20)) * 1e6).alias("amihud_20"),
        full(61, F.skewness("r").over(trailing(60)) * (59 / 60) ** 1.5).alias("skew_60"),
        full(HALF_YEAR + 1, F.try_divide(F.lag("c", MONTH).over(w), F.lag("c", HALF_YEAR).over(w)) - 1).alias("momentum_6_1"),
        full(YEAR + 1, F.try_divide(F.lag("c", MONTH).over(w), F.lag("c", YEAR).over(w)) - 1).alias("momentum_12_1"),
        full(YEAR, F.try_divide(F.col("c"), F.max("c").over(trailing(YEAR)))).alias("dist_52w_high"),
        full(20, F.col("mid") + 2 * F.col("sd")).alias("bb_upper"), full(20, F.col("mid") - 2 * F.col("sd")).alias("bb_lower"),
        full(20, _over("sd", (F.col("c") - F.col("mid") + 2 * F.col("sd")) / (4 * F.col("sd")))).alias("bb_pct_b"),
        full(20, _over("mid", 4 * F.col("sd") / F.col("mid"))).alias("bb_width"),
        full(21, F.col("ch")).alias("donchian_high_20"), full(21, F.col("cl")).alias("donchian_low_20"),
        full(21, _over(F.col("ch") - F.col("cl"), (F.col("c") - F.col("cl")) / (F.col("ch") - F.col("cl")))).alias("donchian_pos_20"),
        full(15, F.col("k")).alias("stoch_k_14"),
        full(16, F.when(F.count("k").over(trailing(3)) == 3, F.avg("k").over(trailing(3)))).alias("stoch_d_14"),
        full(20, _over(mad, (F.col("tp") - F.col("mtp")) / (0.015 * mad))).alias("cci_20"),
        full(20, _over("av", F.col("c") / (F.sum(flow).over(trailing(20)) / F.sum("v").over(trailing(20))))).alias("vwap_ratio_20"),
        full(20, _over("av", F.regr_slope("obv", "n").over(trailing(20)) / F.col("av"))).alias("obv_slope_20"),
        full(20, _over("av", F.regr_slope("adl", "n").over(trailing(20)) / F.col("av"))).alias("ad_slope_20"),
        full(21, F.when(F.col("down") > 0, 100 - 100 / (1 + F.col("up") / F.col("down"))).when(F.col("up") > 0, 100.0)).alias("mfi_14"),
        full(26, aroon("at_high")).alias("aroon_up_25"), full(26, aroon("at_low")).alias("aroon_down_25"),
        full(26, aroon("at_high") - aroon("at_low")).alias("aroon_osc_25"),
    )


def triple_barrier(b: DataFrame, horizon: int = 63, up: float = 1.0, down: float = 1.0, sigma_window: int = 20) -> DataFrame:
    """``symbol, ts, sigma, barrier, touch, label``: which barrier the next ``horizon`` bars touch first.

    Barriers lie ``sigma * sqrt(horizon)`` times their multiples from the close. A bar that touches both counts as
    lower. Without a touch the sign of the return decides; windows that history cuts short, and bars without a
    positive trailing sigma, have null labels. Each row carries at most ``horizon`` following bars.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = adjusted(b).withColumn("n", F.row_number().over(w)).withColumn("lr", F.log(F.try_divide(F.col("c"), F.lag("c").over(w))))
    sigma = F.when(F.col("n") > sigma_window, F.stddev_samp("lr").over(trailing(sigma_window)))
    rows = rows.withColumn("sigma", F.when(sigma > 0, sigma)).withColumn("width", F.col("sigma") * F.sqrt(F.lit(float(horizon))))
    rows = rows.withColumn("next", F.collect_list(F.struct("n", "h", "l", "c")).over(w.rowsBetween(1, horizon)))
    rows = rows.withColumn("hi", F.col("c") * (1 + up * F.col("width"))).withColumn("lo", F.col("c") * (1 - down * F.col("width")))
    rows = rows.withColumn("hit", F.get(F.filter("next", lambda x: (x["l"] <= F.col("lo")) | (x["h"] >= F.col("hi"))), F.lit(0)))
    end = F.get("next", F.lit(horizon - 1))
    barrier = F.when(F.col("sigma").isNotNull(), F.when(F.col("hit.l") <= F.col("lo"), "lower").when(F.col("hit.h") >= F.col("hi"), "upper").when(F.size("next") == horizon, "vertical"))
    label = F.when(F.col("barrier") == "lower", 0).when(F.col("barrier") == "upper", 1).when(F.col("barrier") == "vertical", (end["c"] > F.col("c")).cast("int"))
    touch = F.coalesce("hit.n", F.when(F.col("barrier") == "vertical", end["n"])) - F.col("n")
    return rows.withColumn("barrier", barrier).select("symbol", "ts", "sigma", "barrier", F.when(F.col("barrier").isNotNull(), touch).alias("touch"), label.alias("label"))


RECURSIVE = ("ema_12", "ema_26", "macd", "macd_signal", "macd_hist", "rsi_14", "atr_14", "atr_pct_14", "keltner_pos_20", "plus_di_14", "minus_di_14", "adx_14")


def _recursions(c: np.ndarray, h: np.ndarray, low: np.ndarray, lookback: int) -> dict[str, np.ndarray]:
    """The recursive features of every bar of one symbol, NaN where history is too short.

    All bars' windows advance side by side: step j takes the j-th bar of each window that has one. Averages start at the mean
    of their first values, so they are summed up to there.
    """
    n = len(c)
    begin, bars = np.maximum(0, np.arange(n) - lookback + 1), np.minimum(np.arange(n) + 1, lookback)
    e12, e26, signal, up, down, span, plus, minus, adx, known = (np.zeros(n) for _ in range(10))

    def step(e: np.ndarray, at: slice, k: int, x: np.ndarray, period: int, alpha: float) -> None:
        e[at] = e[at] + x / period if k < period else e[at] * (1 - alpha) + x * alpha

    for j in range(min(lookback, n)):
        at = slice(j, n)
        i = begin[at] + j
        step(e12, at, j, c[i], 12, 2 / 13)
        step(e26, at, j, c[i], 26, 2 / 27)
        if j >= 25:
            step(signal, at, j - 25, e12[at] - e26[at], 9, 0.2)
        if not j:
            continue
        move, rise, fall = c[i] - c[i - 1], h[i] - h[i - 1], low[i - 1] - low[i]
        step(up, at, j - 1, np.maximum(move, 0), 14, 1 / 14)
        step(down, at, j - 1, np.maximum(-move, 0), 14, 1 / 14)
        step(span, at, j - 1, np.maximum(h[i] - low[i], np.maximum(np.abs(h[i] - c[i - 1]), np.abs(low[i] - c[i - 1]))), 14, 1 / 14)
        step(plus, at, j - 1, np.where((rise > fall) & (rise > 0), rise, 0), 14, 1 / 14)
        step(minus, at, j - 1, np.where((fall > rise) & (fall > 0), fall, 0), 14, 1 / 14)
        if j >= 14:
            both = plus[at] + minus[at]
            dx = 100 * np.abs(plus[at] - minus[at]) / np.where(both > 0, both, 1)
            after = np.where(known[at] < 14, adx[at] + dx / 14, (adx[at] * 13 + dx) / 14)
            adx[at] = np.where(both > 0, after, adx[at])
            known[at] += both > 0
    gate = lambda ok, x: np.where(ok, x, np.nan)
    quot = lambda a, b: a / np.where(b > 0, b, np.nan)
    rsi = np.where(down > 0, 100 - 100 / (1 + quot(up, down)), np.where(up > 0, 100.0, 50.0))
    mid = np.full(n, np.nan)
    if n >= 20:
        mid[19:] = np.lib.stride_tricks.sliding_window_view(c, 20).mean(axis=1)
    trend = (bars >= 29) & (known >= 14)
    return {
        "ema_12": gate(bars >= 26, e12), "ema_26": gate(bars >= 26, e26), "macd": gate(bars >= 26, e12 - e26),
        "macd_signal": gate(bars >= 34, signal), "macd_hist": gate(bars >= 34, e12 - e26 - signal), "rsi_14": gate(bars >= 15, rsi),
        "atr_14": gate(bars >= 15, span), "atr_pct_14": gate(bars >= 15, quot(span, c)), "keltner_pos_20": gate(bars >= 20, quot(c - mid, 2 * span)),
        "plus_di_14": gate(trend, 100 * quot(plus, span)), "minus_di_14": gate(trend, 100 * quot(minus, span)), "adx_14": gate(trend, adx),
    }


def recursive(b: DataFrame, lookback: int = 300) -> DataFrame:
    """``symbol, ts`` and RECURSIVE: averages of 12 and 26 with their difference, its signal line and histogram, relative
    strength, true range, Keltner position and directional index.

    Each bar's recursions start anew inside its last ``lookback`` bars, so a result does not depend on how much
    history is stored. Symbols are dealt out; one symbol's bars, a row for each session, are handled as arrays.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        made = _recursions(*(rows[x].to_numpy(np.float64) for x in ("c", "h", "l")), lookback)
        return pd.DataFrame({"symbol": rows["symbol"].to_numpy(), "ts": rows["ts"].to_numpy(), **made})

    rows = adjusted(b).select("symbol", "ts", "c", "h", "l").where("c is not null and h is not null and l is not null")
    schema = "symbol string, ts timestamp, " + ", ".join(f"{name} double" for name in RECURSIVE)
    return rows.groupBy("symbol").applyInPandas(run, schema)
