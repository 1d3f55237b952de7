"""The training table: features with filings, neutral within sectors, ranked within sessions, joined with labels, weights and regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.market import percentile_rank
from tessera.operators.panel import latest_filing, ratios, sector_neutral
from tessera.operators.strategy import EXPOSURE
from tessera.operators.study import uniqueness


def visible_filings(sessions: DataFrame, filings: DataFrame) -> DataFrame:
    """``symbol, ts, filing, prior``: the last filing before each session, and of those known by then the newest of an earlier period.

    What is known changes with filings only, so each filing finds its prior among those before it, a few for each year, and sessions
    carry one struct.
    """
    w = Window.partitionBy("symbol").orderBy("filed_at", "period_end").rowsBetween(Window.unboundedPreceding, 0)
    known = F.collect_list(F.struct("period_end", "total_assets")).over(w)
    dated = filings.where("filed_at is not null").withColumn("__known", known)
    prior = F.array_max(F.filter("__known", lambda k: k["period_end"] < F.col("period_end")))
    seen = latest_filing(sessions, dated.withColumn("__prior", prior).drop("__known"))
    return seen.select("symbol", "ts", "filing", F.col("filing.__prior").alias("prior"))


def neutral_ranks(rows: DataFrame, names: list[str], *keep: str) -> DataFrame:
    """``symbol, ts, keep, names``: each of ``names`` less its sector's median, then ranked within the session; an absent one is neutral, 0.5.

    Features become rows that meet once by session and feature: every window, of sectors, pools, ranks and ties, is inside such a group, which
    has a row for each symbol. ``keep`` are columns that have one value for each ``symbol, ts``.
    """
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("feature"), F.col(name).cast("double").alias("value")) for name in names]))
    long = rows.select("symbol", "ts", "sector", *keep, each.alias("x")).select("symbol", "ts", "sector", *keep, "x.*").repartition("ts", "feature")
    by = ("ts", "feature")
    long = sector_neutral(long, "value", by=by).withColumn("place", percentile_rank("value", *by))
    of = lambda name: F.coalesce(F.max(F.when(F.col("feature") == name, F.col("place"))), F.lit(0.5)).alias(name)
    return long.groupBy("symbol", "ts").agg(*[F.max(c).alias(c) for c in keep], *[of(name) for name in names])


def regime_on(sessions: DataFrame, regimes: DataFrame) -> DataFrame:
    """``ts, regime``: the regime ``day, regime`` of the last known day up to each session; one row for each session is ordered as a whole."""
    marks = sessions.select("ts").distinct().select("ts", F.lit(1).alias("o"), F.lit(None).cast("string").alias("regime"))
    known = regimes.where("regime is not null").select(F.col("day").cast("timestamp").alias("ts"), F.lit(0).alias("o"), "regime")
    w = Window.orderBy("ts", "o").rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(known).withColumn("regime", F.last("regime", True).over(w)).where("o = 1").select("ts", "regime")


def build(features: DataFrame, names: list[str], filings: DataFrame, labels: DataFrame, regimes: DataFrame, sector: str = "sector", least_names: int = 10) -> DataFrame:
    """``symbol, ts``, a rank in [0, 1] for each feature, ``has_filing``, one column for each regime, ``label, weight``.

    Filings join before ranking. Each feature is taken relative to its sector's median, then ranked within the session; an absent one is
    neutral, 0.5. Rows without a resolved label and sessions with fewer than ``least_names`` rows go; an unknown regime is 0 in all columns.
    """
    seen = visible_filings(features.select("symbol", "ts"), filings)
    growth = F.try_divide(F.col("filing.total_assets"), F.col("prior.total_assets")) - 1
    seen = seen.select("symbol", "ts", F.col("filing").isNotNull().alias("has_filing"), *ratios(), growth.alias("asset_growth"))
    every = [*names, "net_margin", "roa", "leverage", "gross_profitability", "asset_growth"]
    rows = features.select("symbol", "ts", F.col(sector).alias("sector"), *names).join(seen, ["symbol", "ts"])
    rows = neutral_ranks(rows, every, "has_filing")
    weighed = uniqueness(labels.where("label is not null"), "ts", "label").drop("n")
    rows = rows.join(weighed, ["symbol", "ts"])
    rows = rows.withColumn("__m", F.count("*").over(Window.partitionBy("ts"))).where(F.col("__m") >= least_names).drop("__m")
    rows = rows.join(F.broadcast(regime_on(features, regimes)), "ts", "left")  # a row for each session
    hot = {f"regime_{name}": F.col("regime").eqNullSafe(F.lit(name)).cast("double") for name in EXPOSURE}
    return rows.withColumns(hot).drop("regime")


def contract(table: DataFrame, names: list[str]) -> DataFrame:
    """One row: samples, sessions, median and least names a session, positive rate, effective rows, features that never vary, rows out of range.

    The table is read once: sessions are summed up first, and the row is made of them.
    """
    out = F.lit(False)
    for name in names:
        out = out | ~F.col(name).between(0, 1)
    ends = [x for name in names for x in (F.min(name).alias(f"__lo_{name}"), F.max(name).alias(f"__hi_{name}"))]
    sessions = table.groupBy("ts").agg(F.count("*").alias("m"), F.sum("label").alias("up"), F.count("label").alias("known"), F.sum("weight").alias("weight"), F.count_if(out).alias("out"), *ends)
    flat = F.array_compact(F.array(*[F.when(F.coalesce(F.min(f"__lo_{name}") == F.max(f"__hi_{name}"), F.lit(True)), F.lit(name)) for name in names]))
    return sessions.agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("samples"), F.try_divide(F.sum("up"), F.sum("known")).alias("positive_rate"), F.sum("weight").alias("effective_rows"), F.size(flat).alias("constant_features"),
        F.coalesce(F.sum("out"), F.lit(0)).alias("out_of_range"), F.count("*").alias("sessions"), F.percentile("m", F.lit(0.5)).alias("median_names"), F.min("m").alias("least_names"),
    )
