"""Session and fold metrics of a scored table, folds pooled by candidate, the promotion gate, attribute overlays, macro vintages without a date."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import market, panel, research, study

YEAR = 252
#: The least that a promoted model shows.
SHARPE, ACTIVE, IC_T, DEFLATED, RECENT, SESSIONS = 0.5, 0.0, 2.0, 0.90, 2, 20
#: What a rank correlation of exactly 0 may show after rounding.
DUST = 1e-12
#: Fixed value: the vintage of observations whose publication is not known.
UNDATED = dt.date(9999, 12, 31)


def session_metrics(scored: DataFrame, score: str, outcome: str, share: float = 0.2, cost_bps: float = 5.0) -> DataFrame:
    """``ts, ic, benchmark, gross, short, turnover, cost`` of each session of ``symbol, ts`` with two rows or more.

    The book is the best ``share``, the short side the worst; the benchmark is the mean of all. What is joined has one row a session.
    """
    rows = scored.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    rows = rows.withColumn("__n", F.count("*").over(Window.partitionBy("ts"))).where("__n >= 2").drop("__n")
    book = study.tranches(market.top_quantile(rows, score, share).select("ts", "symbol"), 1)
    held = study.book_returns(book, rows.select("ts", "symbol", F.col(outcome).alias("next_return"))).select("ts", "turnover")
    sides = research.long_short(rows, score, outcome, share).select("ts", F.col("long").alias("gross"), "short")
    level = rows.groupBy("ts").agg(F.avg(outcome).alias("benchmark"))
    out = panel.rank_ic(rows, score, outcome).select("ts", "ic").join(level, "ts").join(sides, "ts").join(held, "ts")
    return out.select("ts", "ic", "benchmark", "gross", "short", "turnover", (F.col("turnover") * cost_bps / 1e4).alias("cost"))


def _sharpe(x: Column) -> Column:
    return F.coalesce(F.try_divide(F.avg(x), F.stddev_samp(x)) * math.sqrt(YEAR), F.lit(0.0))


def relative_metrics(sessions: DataFrame, *by: str) -> DataFrame:
    """Rank information, the book against the mean of all names and against the short side, and what trading costs, of :func:`session_metrics` by ``by``."""
    net = F.col("gross") - F.col("cost")
    spread = F.coalesce(F.stddev_samp("ic"), F.lit(0.0))
    return sessions.groupBy(*by).agg(
        F.count("*").alias("sections"), F.avg("ic").alias("ic_mean"), spread.alias("ic_std"), F.coalesce(F.try_divide(F.avg("ic"), spread), F.lit(0.0)).alias("icir"),
        F.avg((F.col("ic") > DUST).cast("int")).alias("ic_positive"), _sharpe(F.col("benchmark")).alias("sharpe_benchmark"), _sharpe(net - F.col("benchmark")).alias("sharpe_active"),
        _sharpe(net - F.col("short")).alias("sharpe_long_short"), _sharpe(F.col("gross")).alias("sharpe_gross"), _sharpe(net).alias("sharpe_net"),
        (F.avg("cost") * YEAR).alias("cost_drag"), F.avg("turnover").alias("turnover"),
    )


def ic_t(mean: Column, spread: Column, n: Column) -> Column:
    """t of a mean rank correlation; 0 without spread or with fewer than two sections."""
    return F.when((spread > 0) & (n >= 2), mean / (spread / F.sqrt(n))).otherwise(F.lit(0.0))


def pooled(folds: DataFrame, *by: str) -> DataFrame:
    """``by, folds, sections, ic_mean, ic_t, sharpe`` of a candidate's folds: rank correlations weigh by their sections, so a short fold has no louder voice.

    Folds of fewer than two sections count among ``folds`` only and in the mean ratio.
    """
    n = F.when(F.col("sections") >= 2, F.col("sections"))
    total = F.coalesce(F.sum(n), F.lit(0))
    mean = F.coalesce(F.try_divide(F.sum(n * F.col("ic_mean")), total), F.lit(0.0))
    spread = F.coalesce(F.avg(F.when(n.isNotNull(), F.col("ic_std"))), F.lit(0.0))
    return folds.groupBy(*by).agg(F.count("*").alias("folds"), total.alias("sections"), mean.alias("ic_mean"), ic_t(mean, spread, total).alias("ic_t"), F.avg("sharpe_net").alias("sharpe"))


def gate(holdout: DataFrame, folds: DataFrame) -> DataFrame:
    """``model, condition, passed``: six conditions on each model's holdout, with its earlier ``model, fold, sharpe_active`` as the check of stability.

    ``holdout`` has one row a model: ``best_epoch`` (null: not fitted by epochs), ``pred_std, sessions, sections, ic_mean, ic_std, baseline_ic, sharpe, sharpe_active, lift, brier_delta,
    brier_se, auc, deflated``. A model without folds fails G0 and G3; a null figure fails its condition.
    """
    newest = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("fold")))
    seen = folds.withColumn("__at", newest).groupBy("model").agg(F.count("*").alias("folds"), F.count_if((F.col("__at") <= 3) & (F.col("sharpe_active") > ACTIVE)).alias("active_folds"))
    c = F.col
    enough = (c("pred_std") > 0) & (c("sessions") >= SESSIONS) & (F.coalesce("folds", F.lit(0)) >= RECENT) & (F.coalesce("best_epoch", F.lit(2)) > 1)
    conditions = {
        "G0": enough,
        "G1": (c("ic_mean") > 0) & (ic_t(c("ic_mean"), c("ic_std"), c("sections")) >= IC_T),
        "G2": F.coalesce("ic_mean", F.lit(0.0)) > F.coalesce("baseline_ic", F.lit(0.0)),
        "G3": (c("sharpe_active") > ACTIVE) & (c("sharpe") > SHARPE) & (c("lift") > 0) & (F.coalesce("active_folds", F.lit(0)) >= RECENT),
        "G4": (c("brier_delta") <= 2 * c("brier_se")) & (c("auc") > 0.5),
        "G5": c("deflated") >= DEFLATED,
    }
    rows = F.array(*[F.struct(F.lit(k).alias("condition"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in conditions.items()])
    return holdout.join(seen, "model", "left").select("model", F.explode(rows).alias("x")).select("model", "x.*")


def attributes(events: DataFrame, order: str = "ts") -> DataFrame:
    """``symbol, attributes map``: the last value of each name of ``symbol, name, value`` by ``order``, ties by the larger value; rows without a name or value say nothing."""
    rows = events.where("symbol is not null and name is not null and value is not null")
    last = rows.groupBy("symbol", "name").agg(F.max(F.struct(order, "value"))["value"].alias("value"))
    return last.groupBy("symbol").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("attributes"))  # names, which the schema bounds


def overlay(vectors: DataFrame, overlays: DataFrame, names: list[str]) -> DataFrame:
    """``vectors`` with the columns ``names``, new ones too, as the symbol's attributes have them; a name that they lack keeps the vector's value."""
    own = {n: F.col(n) if n in vectors.columns else F.lit(None).cast("double") for n in names}
    out = vectors.join(overlays.select("symbol", F.col("attributes").alias("__said")), "symbol", "left")
    return out.withColumns({n: F.coalesce(F.col("__said")[n], own[n]) for n in names}).drop("__said")


def save_vintages(stored: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """``series, observation_date, realtime_start, value`` after an upsert of ``batch`` by the first three; an unknown vintage is one far off, so no as-of read sees it."""
    keys = ("series", "observation_date", "realtime_start")
    dated = lambda df: df.withColumn("realtime_start", F.coalesce("realtime_start", F.lit(UNDATED)))
    return panel.upsert(dated(stored), dated(batch), keys, order)


def vintages(stored: DataFrame) -> DataFrame:
    """What :func:`save_vintages` keeps as it is read: an unknown vintage is null again."""
    return stored.withColumn("realtime_start", F.nullif("realtime_start", F.lit(UNDATED)))
