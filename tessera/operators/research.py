"""What features foretell at which horizon and delay, barrier widths, evidence within sectors, and filters over a book's trades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import study
from tessera.operators.market import top_quantile
from tessera.operators.panel import average_rank, correlation

#: Shares of labels that touch a barrier which a good width gives.
BAND = (0.40, 0.70)


def forward_returns(bars: DataFrame, horizons: list[int], delays: list[int]) -> DataFrame:
    """``symbol, ts, horizon, delay, forward``: the return from the close ``delay`` bars on to that ``horizon`` bars later.

    Windows that history cuts short and entries at a close that is not positive are left out. One sort for the whole grid.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    at = {k: F.lead("c", k).over(w) if k else F.col("c") for k in {d + h for d in delays for h in (0, *horizons)}}
    grid = [
        F.struct(F.lit(h).alias("horizon"), F.lit(d).alias("delay"), (at[d + h] / F.when(at[d] > 0, at[d]) - 1).alias("forward"))
        for h in horizons for d in delays
    ]
    rows = bars.select("symbol", "ts", F.coalesce("adj_close", "close").alias("c")).select("symbol", "ts", F.array(*grid).alias("grid"))
    return rows.select("symbol", "ts", F.explode("grid").alias("g")).select("symbol", "ts", "g.*").where("forward is not null")


def evidence(ics: DataFrame, by: list[str], overlap: str | None, most: int) -> DataFrame:
    """``by, n, ic_mean, ic_t`` of ``by, ts, ic``; outcomes of ``overlap`` sessions (``most`` at most) share their windows, so that many less one
    autocovariances enter the error with Bartlett weights. No spread gives 0."""
    mean = F.avg("ic").over(Window.partitionBy(*by))
    w = Window.partitionBy(*by).orderBy("ts")
    rows = ics.select(*by, "ts", "ic", (F.col("ic") - mean).alias("e"))
    rows = rows.select(*by, "ic", "e", *[(F.col("e") * F.lag("e", k).over(w)).alias(f"e{k}") for k in range(1, most)])
    total = F.sum(F.col("e") * F.col("e"))
    for k in range(1, most):
        total = total + F.coalesce(F.sum(2 * F.greatest(F.lit(0.0), 1 - k / F.col(overlap)) * F.col(f"e{k}")), F.lit(0.0))
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("ic").alias("ic_mean"), total.alias("s"))
    se = F.when((F.col("n") >= 2) & (F.col("s") > 0), F.sqrt("s") / F.col("n"))
    return out.select(*by, "n", "ic_mean", F.coalesce(F.col("ic_mean") / se, F.lit(0.0)).alias("ic_t"))


def session_ics(rows: DataFrame, by: list[str], value: str, outcome: str, least: int = 3) -> DataFrame:
    """``by, ts, ic``: rank correlation of each session; those with fewer than ``least`` rows or without spread are left out."""
    keys = [*by, "ts"]
    rows = rows.where(F.col(value).isNotNull() & F.col(outcome).isNotNull())
    ranks = rows.select(*keys, average_rank(value, keys).alias("a"), average_rank(outcome, keys).alias("b"))
    out = ranks.groupBy(*keys).agg(F.count("*").alias("m"), correlation("a", "b").alias("ic"))
    return out.where((F.col("m") >= least) & F.col("ic").isNotNull() & ~F.isnan("ic")).drop("m")


def alpha_decay(vectors: DataFrame, bars: DataFrame, names: list[str], horizons: list[int], delays: list[int]) -> DataFrame:
    """``feature, horizon, delay, n, ic_mean, ic_t`` of the features ``names`` of ``symbol, ts, ...`` over the grid of forward returns."""
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("x")) for n in names])
    rows = vectors.join(forward_returns(bars, horizons, delays), ["symbol", "ts"])
    rows = rows.select("ts", "horizon", "delay", "forward", F.explode(cells).alias("f")).select("ts", "horizon", "delay", "forward", "f.*")
    by = ["feature", "horizon", "delay"]
    return evidence(session_ics(rows, by, "x", "forward"), by, "horizon", max(horizons))


def half_lives(points: DataFrame) -> DataFrame:
    """``feature, peak_horizon, peak_ic, half_life`` of the points without delay: where the mean falls to half its peak, between two horizons
    by a straight line; null if it never does. Equal peaks: the shortest."""
    a, w = F.abs("ic_mean"), Window.partitionBy("feature")
    along = w.orderBy("horizon")
    rows = points.where("delay = 0").select("feature", "horizon", "ic_mean", a.alias("a"), F.max(F.struct(a.alias("a"), (-F.col("horizon")).alias("h"))).over(w).alias("peak"))
    span, drop = F.col("horizon") - F.lag("horizon").over(along), F.lag("a").over(along) - F.col("a")
    crossed = F.when(drop <= 0, F.col("horizon")).otherwise(F.lag("horizon").over(along) + span * F.try_divide(F.lag("a").over(along) - F.col("peak.a") / 2, drop))
    rows = rows.withColumn("at", crossed.cast("double"))
    after = (F.col("horizon") > -F.col("peak.h")) & (F.col("peak.a") > 0) & (F.col("a") <= F.col("peak.a") / 2)
    return rows.groupBy("feature").agg(
        (-F.max("peak")["h"]).alias("peak_horizon"), F.max(F.when(F.col("horizon") == -F.col("peak.h"), F.col("ic_mean"))).alias("peak_ic"),
        F.min(F.when(after, F.struct("horizon", "at")))["at"].alias("half_life"),
    )


def calibration(rows: DataFrame, horizon: int, widths: list[float], sigma_window: int = 20) -> DataFrame:
    """``width, labels, lower_share, upper_share, vertical_share, positive_rate, recommended`` for barriers of each width on ``symbol, ts, c, market``.

    Recommended is the width whose share of touches lies nearest the middle of BAND, those inside it before the others, ties to the first.
    """
    each = [study.label_profile(study.excess_barrier(rows, horizon, sigma_window, m, m).withColumn("width", F.lit(float(m))), "width") for m in widths]
    out = reduce(DataFrame.unionByName, each)
    touched = F.col("lower_share") + F.col("upper_share")
    outside = (~touched.between(*BAND)).cast("int")
    place = F.row_number().over(Window.orderBy(outside, F.abs(touched - sum(BAND) / 2), "width"))  # one row a width
    return out.withColumn("recommended", place == 1)


def sector_composition(names: DataFrame, least: int = 4) -> DataFrame:
    """``sector, names, usable, share`` of ``symbol, sector``: sectors of at least ``least`` names stand by themselves, null is the unknown."""
    each = names.groupBy("sector").agg(F.count("*").alias("names"))
    usable = F.col("sector").isNotNull() & (F.col("names") >= least)
    return each.select("sector", "names", usable.alias("usable"), (F.col("names") / F.sum("names").over(Window.partitionBy(F.lit(1)))).alias("share"))  # one row a sector


def sector_gain(plain: DataFrame, neutral: DataFrame) -> DataFrame:
    """``feature, t_plain, t_neutral, t_gain, strong_plain, strong_neutral`` of two tables ``feature, ic_t``, features in both."""
    rows = plain.select("feature", F.col("ic_t").alias("t_plain")).join(neutral.select("feature", F.col("ic_t").alias("t_neutral")), "feature")
    gain = F.abs("t_neutral") - F.abs("t_plain")
    return rows.select("*", gain.alias("t_gain"), (F.abs("t_plain") >= 2).alias("strong_plain"), (F.abs("t_neutral") >= 2).alias("strong_neutral"))


def meta_labels(scored: DataFrame, score: str, forward: str, cost_bps: Column, share: float = 0.2) -> DataFrame:
    """The rows each session's book selects, with ``net`` (forward return less the cost) and ``y`` (whether it gained)."""
    rows = top_quantile(scored, score, share).withColumn("net", F.col(forward) - cost_bps / 1e4)
    return rows.withColumn("y", (F.col("net") > 0).cast("int"))


def meta_book(labels: DataFrame, keep: Column) -> DataFrame:
    """``ts, trades, kept, unfiltered, filtered, precision, kept_precision``: a session whose trades are all turned down earns 0."""
    rows = labels.withColumn("__keep", F.coalesce(keep, F.lit(False)))
    kept = lambda c: F.avg(F.when(F.col("__keep"), F.col(c)))
    return rows.groupBy("ts").agg(
        F.count("*").alias("trades"), F.count_if("__keep").alias("kept"), F.avg("net").alias("unfiltered"), F.coalesce(kept("net"), F.lit(0.0)).alias("filtered"),
        F.avg("y").alias("precision"), kept("y").alias("kept_precision"),
    )


def long_short(scored: DataFrame, score: str, outcome: str, share: float = 0.2) -> DataFrame:
    """``ts, long, short, spread``: mean outcome of the best and of the worst ``share`` of each session, one row at least."""
    w = Window.partitionBy("ts")
    rows = scored.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    rows = rows.select("ts", outcome, F.row_number().over(w.orderBy(F.desc(score), "symbol")).alias("i"), F.row_number().over(w.orderBy(F.asc(score), "symbol")).alias("j"), F.count("*").over(w).alias("n"))
    k = F.greatest(F.lit(1), F.ceil(F.col("n") * share))
    out = rows.groupBy("ts").agg(F.avg(F.when(F.col("i") <= k, F.col(outcome))).alias("long"), F.avg(F.when(F.col("j") <= k, F.col(outcome))).alias("short"))
    return out.withColumn("spread", F.col("long") - F.col("short"))
