"""Positions and equity from fills, circuit breakers, idempotent orders, protective exits, alerts and learned source weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Drawdown that flattens for good, loss of a day that halts it, drawdown that warns.
FLATTEN, HALT, WARN = 0.15, 0.05, 0.08


def once_a_session(orders: DataFrame, order: tuple[str, ...] = ("ts", "order_id")) -> DataFrame:
    """The first order of each symbol, side and day."""
    w = Window.partitionBy("symbol", "side", F.to_date("ts")).orderBy(*order)
    return orders.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def positions(fills: DataFrame, order: tuple[str, ...] = ("ts", "order_id")) -> DataFrame:
    """``fills`` with ``filled`` and ``position``: a sale is clipped to what is held, the book is never short.

    The clipped running sum is the plain one less its running minimum where that is below 0.
    """
    w = Window.partitionBy("symbol").orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    rows = fills.withColumn("__s", F.sum(signed).over(run))
    rows = rows.withColumn("position", F.col("__s") - F.least(F.lit(0.0), F.min("__s").over(run)))
    filled = F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0)))
    return rows.withColumn("filled", filled).drop("__s")


def slipped(side: Column, price: Column, bps: float = 5.0) -> Column:
    return price * F.when(side == "BUY", 1 + bps / 1e4).otherwise(1 - bps / 1e4)


def equity_by_day(fills: DataFrame, cash: float = 1e6) -> DataFrame:
    """``day, cash, exposure, equity`` from clipped ``fills`` (``symbol, ts, side, filled, position, price``): positions at their last price.

    Each symbol's change of value and cash is summed by day, so only a table with one row a day is ordered as a whole.
    """
    w = Window.partitionBy("symbol", F.to_date("ts")).orderBy(F.desc("ts"), F.desc("order_id"))
    flow = F.when(F.col("side") == "BUY", -F.col("filled")).otherwise(F.col("filled")) * slipped(F.col("side"), F.col("price"))
    flows = fills.groupBy(F.to_date("ts").alias("day")).agg(F.sum(flow).alias("flow"))
    last = fills.withColumn("k", F.row_number().over(w)).where("k = 1").select("symbol", F.to_date("ts").alias("day"), (F.col("position") * F.col("price")).alias("worth"))
    change = F.col("worth") - F.coalesce(F.lag("worth").over(Window.partitionBy("symbol").orderBy("day")), F.lit(0.0))
    worth = last.select("day", change.alias("change")).groupBy("day").agg(F.sum("change").alias("change"))
    run = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    rows = flows.join(worth, "day").select("day", (cash + F.sum("flow").over(run)).alias("cash"), F.sum("change").over(run).alias("exposure"))
    return rows.withColumn("equity", F.col("cash") + F.col("exposure"))


def breaker(equity: DataFrame, by: str, start: float, at: str = "ts") -> DataFrame:
    """``equity`` (``by, at, equity``) with ``drawdown, daily_loss, level``: BLACK from the first drawdown of FLATTEN on, RED for the rest of a day
    that lost HALT, YELLOW at WARN, else NONE. Losses of a day count from its first value."""
    w = Window.partitionBy(by).orderBy(at)
    day = Window.partitionBy(by, F.to_date(at)).orderBy(at)
    run, today = w.rowsBetween(Window.unboundedPreceding, 0), day.rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.lit(start), F.max("equity").over(run))
    rows = equity.withColumn("drawdown", 1 - F.col("equity") / peak).withColumn("daily_loss", F.greatest(F.lit(0.0), 1 - F.try_divide("equity", F.first("equity").over(today))))
    level = (
        F.when(F.max(F.col("drawdown") >= FLATTEN).over(run), "BLACK").when(F.max(F.col("daily_loss") >= HALT).over(today), "RED").when(F.col("drawdown") >= WARN, "YELLOW").otherwise("NONE")
    )
    return rows.withColumn("level", level)


def exits(entries: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """``symbol, ts, exit_ts, exit_price, reason``: the first of the next ``horizon`` bars whose close is at the stop or the target of a long entry."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(1, horizon)
    path = bars.select("symbol", "ts", F.collect_list(F.struct("ts", "close")).over(w).alias("next"))
    rows = entries.join(path, ["symbol", "ts"])
    hit = F.get(F.filter("next", lambda x: (x["close"] <= F.col("stop")) | (x["close"] >= F.col("target"))), F.lit(0))
    rows = rows.withColumn("hit", hit).where("hit is not null")
    reason = F.when(F.col("hit.close") <= F.col("stop"), "stop").otherwise("target")
    return rows.select("symbol", "ts", F.col("hit.ts").alias("exit_ts"), F.col("hit.close").alias("exit_price"), reason.alias("reason"))


def source_weights(outcomes: DataFrame, newest: int = 60, sharpness: float = 2.0, least: float = 0.05, most: float = 0.60) -> DataFrame:
    """``source, outcomes, hit_rate, mean_return, ratio, weight`` from the last outcomes ``source, ts, event_id, outcome`` of each source.

    Weights are a softmax of the ratios of mean to deviation, clipped and normalised again; all equal if no source has two outcomes.
    """
    w = Window.partitionBy("source").orderBy(F.desc("ts"), F.desc("event_id"))
    last = outcomes.withColumn("k", F.row_number().over(w)).where(F.col("k") <= newest)
    finite = F.when(~F.isnan("outcome") & (F.abs("outcome") < float("inf")), F.col("outcome"))
    ratio = F.when(F.count(finite) >= 2, F.try_divide(F.avg(finite), F.stddev_samp(finite)))
    each = last.groupBy("source").agg(F.count("*").alias("outcomes"), F.avg((F.col("outcome") > 0).cast("double")).alias("hit_rate"), F.avg(finite).alias("mean_return"), F.coalesce(ratio, F.lit(0.0)).alias("ratio"))
    all_of = Window.partitionBy(F.lit(1))  # one row a source
    raw = each.withColumn("weight", F.exp(F.least(sharpness * F.col("ratio"), F.lit(500.0))))
    clipped = raw.withColumn("weight", F.greatest(F.lit(least), F.least(F.lit(most), F.col("weight") / F.sum("weight").over(all_of))))
    return clipped.withColumn("weight", F.when(F.max("outcomes").over(all_of) > 1, F.col("weight") / F.sum("weight").over(all_of)).otherwise(1.0 / F.count("*").over(all_of)))


def ks(samples: DataFrame) -> DataFrame:
    """``feature, n_ref, n_cur, ks, p_value`` of ``feature, side, value``: the largest gap of the two distributions and its asymptotic probability."""
    rows = samples.where("value is not null").groupBy("feature", "value").agg(F.count_if(F.col("side") == "ref").alias("r"), F.count_if(F.col("side") == "cur").alias("c"))
    w = Window.partitionBy("feature").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    all_of = Window.partitionBy("feature")
    gap = F.abs(F.try_divide(F.sum("r").over(w), F.sum("r").over(all_of)) - F.try_divide(F.sum("c").over(w), F.sum("c").over(all_of)))
    out = rows.select("feature", "r", "c", gap.alias("gap")).groupBy("feature").agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"), F.max("gap").alias("ks"))
    n = F.sqrt(F.col("n_ref") * F.col("n_cur") / (F.col("n_ref") + F.col("n_cur")))
    x = F.greatest(n * F.col("ks"), F.lit(0.2))
    p = F.aggregate(F.sequence(F.lit(1), F.lit(50)), F.lit(0.0), lambda s, k: s + 2 * F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * x * x))
    return out.withColumn("p_value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def drift_action(psi: Column, p_value: Column, sharpe: Column, base_sharpe: Column, accuracy: Column) -> Column:
    """auto_retrain if a feature drifted, the ratio decayed by more than 30 % of its base or accuracy is under 0.48; alert_and_monitor if predictions shifted; else no_action."""
    decay = F.coalesce(F.try_divide(sharpe - base_sharpe, F.abs(base_sharpe)), F.lit(0.0))
    return F.when((psi > 0.20) | (decay < -0.30) | (accuracy < 0.48), "auto_retrain").when(p_value < 0.01, "alert_and_monitor").otherwise("no_action")
