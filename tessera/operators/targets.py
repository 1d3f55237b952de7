"""Candidate labels, by horizon and against a benchmark or not, judged by how well raw features rank them: nothing is fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.market import percentile_rank
from tessera.operators.panel import average_rank, correlation
from tessera.operators.research import BAND

CANDIDATE = ("excess", "horizon")


def barrier_paths(rows: DataFrame, most: int, sigma_window: int = 20) -> DataFrame:
    """``excess, symbol, ts, at, unit, next`` of ``symbol, ts, c, h, l, market``: where barriers start, the width that one session's deviation gives, and the next ``most`` sessions.

    Prices touch by their highs and lows, excess log returns by their closes. Rows without a positive trailing deviation are left out. One sort serves every horizon and width.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    back, ahead = w.rowsBetween(1 - sigma_window, 0), w.rowsBetween(1, most)
    x = F.when((F.col("c") > 0) & (F.col("market") > 0), F.log(F.col("c") / F.col("market")))
    rows = rows.select("symbol", "ts", "c", "h", "l", x.alias("x"), F.log(F.try_divide("c", F.lag("c").over(w))).alias("lr"))
    rows = rows.withColumn("d", F.col("x") - F.lag("x").over(w))
    deviation = lambda c: F.when(F.count(c).over(back) == sigma_window, F.stddev_samp(c).over(back))
    path = lambda low, high, end: F.collect_list(F.struct(F.col(low).alias("lo"), F.col(high).alias("hi"), F.col(end).alias("end"))).over(ahead)
    kind = lambda excess, at, unit, nxt: F.struct(F.lit(excess).alias("excess"), at.alias("at"), unit.alias("unit"), nxt.alias("next"))
    both = F.array(kind(False, F.col("c"), F.col("c") * deviation("lr"), path("l", "h", "c")), kind(True, F.col("x"), deviation("d"), path("x", "x", "x")))
    rows = rows.select("symbol", "ts", both.alias("both"))
    return rows.select("symbol", "ts", F.explode("both").alias("k")).select("symbol", "ts", "k.*").where("unit > 0")


def barrier_grid(paths: DataFrame, horizons: list[int], widths: list[float]) -> DataFrame:
    """``excess, symbol, ts, horizon, width, barrier, label`` of :func:`barrier_paths`, resolved ones only: the first barrier touched, a bar that touches both counts as lower; else the sign of the end."""
    cells = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(float(m)).alias("width")) for h in horizons for m in widths]))
    rows = paths.select("*", cells.alias("g")).select(*paths.columns, "g.*")
    gap = F.col("unit") * F.col("width") * F.sqrt(F.col("horizon").cast("double"))
    rows = rows.withColumns({"floor": F.col("at") - gap, "ceiling": F.col("at") + gap})
    touches = lambda y: y["end"].isNull() | (y["lo"] <= F.col("floor")) | (y["hi"] >= F.col("ceiling"))
    rows = rows.withColumn("hit", F.get(F.filter(F.slice("next", 1, F.col("horizon")), touches), F.lit(0))).withColumn("last", F.get("next", F.col("horizon") - 1))
    touched = F.when(F.col("hit.end").isNull(), None).when(F.col("hit.lo") <= F.col("floor"), "lower").otherwise("upper")
    rows = rows.withColumn("barrier", F.when(F.col("hit").isNotNull(), touched).when(F.col("last").isNotNull(), "vertical"))
    label = F.when(F.col("barrier") == "vertical", F.col("last.end") > F.col("at")).otherwise(F.col("barrier") == "upper").cast("int")
    return rows.where("barrier is not null").select("excess", "symbol", "ts", "horizon", "width", "barrier", label.alias("label"))


def recommended(grid: DataFrame) -> DataFrame:
    """``excess, horizon, width, touched``: the width of each candidate whose share of touches lies nearest the middle of the band, those inside first, ties to the narrower."""
    shares = grid.groupBy(*CANDIDATE, "width").agg(F.avg((F.col("barrier") != "vertical").cast("double")).alias("touched"))
    off = F.round(F.abs(F.col("touched") - sum(BAND) / 2), 12)
    place = F.row_number().over(Window.partitionBy(*CANDIDATE).orderBy((~F.col("touched").between(*BAND)).cast("int"), off, "width"))
    return shares.withColumn("k", place).where("k = 1").drop("k")


def target_scores(rows: DataFrame, vectors: DataFrame, names: list[str], horizons: list[int], widths: list[float], least_names: int = 20) -> DataFrame:
    """``excess, horizon, width, touched, samples, positive_rate, best_feature, best_ic, mean_abs_ic, place`` of each candidate label of ``rows``.

    For each candidate the width is calibrated, then every session of ``least_names`` labels or more gives a rank correlation of each of ``names``
    with the label, 0 without spread; an absent feature is neutral. The best feature has the largest mean in size, ties by name, and so has the
    best candidate, ties to the shorter horizon and to absolute labels. Without labels there is no row.
    """
    grid = barrier_grid(barrier_paths(rows, max(horizons)), horizons, widths)
    width = recommended(grid)  # a row for each candidate
    labels = grid.join(F.broadcast(width), [*CANDIDATE, "width"])
    wide = labels.join(vectors.select("symbol", "ts", *names), ["symbol", "ts"])
    long = wide.select(*CANDIDATE, "width", "touched", "ts", "label", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names])).alias("f"))
    keys = [*CANDIDATE, "ts", "feature"]
    long = long.select(*CANDIDATE, "width", "touched", "ts", "label", "f.*").repartition(*keys)  # a session's names meet once
    long = long.withColumn("m", F.count("*").over(Window.partitionBy(*keys))).where(F.col("m") >= least_names)
    long = long.withColumn("value", F.coalesce(percentile_rank("value", *keys), F.lit(0.5)))
    ranks = long.select(*keys, "width", "touched", "label", average_rank("value", keys).alias("a"), average_rank("label", keys).alias("b"))
    ic = F.coalesce(F.nanvl(correlation("a", "b"), F.lit(0.0)), F.lit(0.0))
    sessions = ranks.groupBy(*keys, "width", "touched").agg(ic.alias("ic"), F.count("*").alias("n"), F.sum("label").alias("up"))
    each = sessions.groupBy(*CANDIDATE, "width", "touched", "feature").agg(F.avg("ic").alias("ic"), F.sum("n").alias("n"), F.sum("up").alias("up"))
    size = F.round(F.abs("ic"), 12)
    best = F.min(F.struct((-size).alias("s"), F.col("feature"), F.col("ic")))
    out = each.groupBy(*CANDIDATE, "width", "touched").agg(F.max("n").alias("samples"), (F.max("up") / F.max("n")).alias("positive_rate"), best.alias("b"), F.avg(F.abs("ic")).alias("mean_abs_ic"))
    place = F.row_number().over(Window.orderBy(F.col("b.s"), "horizon", "excess"))  # a row for each candidate
    return out.select(*CANDIDATE, "width", "touched", "samples", "positive_rate", F.col("b.feature").alias("best_feature"), F.col("b.ic").alias("best_ic"), "mean_abs_ic", place.alias("place"))
