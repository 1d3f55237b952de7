"""Company styles and sectors, health of strategies, alerts, votes of models and live components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sector names and what else they are called.
SECTORS = {
    "Communication Services": ("communication services", "communications", "telecommunications", "telecom"),
    "Consumer Discretionary": ("consumer discretionary", "consumer cyclical", "consumer cyclicals"),
    "Consumer Staples": ("consumer staples", "consumer defensive", "consumer non-cyclical"),
    "Energy": ("energy",),
    "Financials": ("financials", "financial", "financial services", "finance"),
    "Health Care": ("health care", "healthcare", "health"),
    "Industrials": ("industrials", "industrial"),
    "Information Technology": ("information technology", "technology", "tech", "infotech", "it"),
    "Materials": ("materials", "basic materials"),
    "Real Estate": ("real estate", "realestate"),
    "Utilities": ("utilities", "utility"),
}
GROWTH = ("Information Technology", "Communication Services", "Consumer Discretionary", "Health Care")
VALUE = ("Financials", "Energy", "Utilities", "Consumer Staples", "Materials", "Real Estate")
#: Direction and confidence of a regime; others say nothing.
BIAS = {"expansion": ("BUY", 0.5), "recovery": ("BUY", 0.3), "contraction": ("SELL", 0.3), "crisis": ("SELL", 0.6)}
SEVERITIES = ("info", "warning", "critical")


def sector(raw: Column) -> Column:
    """The sector that a free text names, whatever its case and outer blanks; null if unknown."""
    pairs = [F.lit(x) for name, aliases in SECTORS.items() for a in aliases for x in (a, name)]
    return F.element_at(F.create_map(*pairs), F.lower(F.trim(raw)))


def cap_tier(cap: Column) -> Column:
    return F.when(cap.isNull(), "unknown").when(cap >= 200e9, "mega").when(cap >= 10e9, "large").when(cap >= 2e9, "mid").when(cap >= 300e6, "small").otherwise("micro")


def styles(rows: DataFrame) -> DataFrame:
    """Adds ``growth_score, value_score, style, basis, tier, model_stack, style_growth, style_value`` to ``sector, market_cap, pe_ratio, pb_ratio,
    revenue_growth, earnings_growth, dividend_yield``; unknown figures give no sign, no sign at all leaves the choice to the sector."""
    count = lambda *signs: sum((F.coalesce(s, F.lit(False)).cast("int") for s in signs), F.lit(0))
    pe, pb, paid = F.col("pe_ratio"), F.col("pb_ratio"), F.col("dividend_yield")
    growth = count(F.col("revenue_growth") >= 0.15, F.col("earnings_growth") >= 0.15, pe >= 25, paid < 0.01)
    value = count((pe > 0) & (pe <= 15), pb <= 1.5, paid >= 0.03)
    rows = rows.withColumns({"growth_score": growth, "value_score": value})
    g, v = F.col("growth_score"), F.col("value_score")
    none = (g == 0) & (v == 0)
    leans = F.when(F.col("sector").isin(*GROWTH), "growth").when(F.col("sector").isin(*VALUE), "value")
    style = F.when(none, F.coalesce(leans, F.lit("blend"))).when(g > v, "growth").when(v > g, "value").otherwise("blend")
    basis = F.when(~none, "metrics").when(leans.isNotNull(), "sector").otherwise("default")
    rows = rows.withColumns({"style": style, "basis": basis, "tier": cap_tier(F.col("market_cap"))})
    bucket = F.when(F.col("tier").isin("mega", "large"), "large").otherwise("small")
    grown = style_growth(F.col("style"))
    return rows.withColumns({"model_stack": F.concat("style", F.lit("_"), bucket, F.lit("cap_v1")), "style_growth": grown, "style_value": 1 - grown})


def style_growth(style: Column) -> Column:
    """1 for growth, 0 for value, a half for blend, null for any other; the value side is the rest to 1."""
    return F.when(style == "growth", 1.0).when(style == "value", 0.0).when(style == "blend", 0.5)


def health(sharpe: Column, profit_factor: Column, win_rate: Column, days: Column) -> Column:
    """``status, reason``: deactivated, active, or on probation with its reasons."""
    said = lambda status, reason: F.struct(F.lit(status).alias("status"), reason.alias("reason"))
    gone = F.when(sharpe < 0, "negative_sharpe").when(profit_factor < 0.8, "low_profit_factor").when(days > 30, "probation_timeout")
    low = F.concat_ws(",", F.when(sharpe < 0.5, "low_sharpe"), F.when(profit_factor < 1.2, "low_pf"), F.when(win_rate < 0.4, "low_win_rate"))
    return F.when(gone.isNotNull(), said("deactivated", gone)).when(low == "", said("active", F.lit("all_metrics_healthy"))).otherwise(said("probation", low))


def strategy_health(returns: DataFrame, window: int = 30) -> DataFrame:
    """``strategy, ts, sharpe, profit_factor, win_rate, days, status, reason`` of ``strategy, ts, ret``, over the last ``window`` returns.

    ``days`` counts from the first of the probations in a row, which ends after 30. A window without losses has a profit factor of 99, one
    without spread a ratio of 0; rows before the window is full are left out.
    """
    w = Window.partitionBy("strategy").orderBy("ts")
    back = w.rowsBetween(1 - window, 0)
    total = lambda x: F.sum(F.greatest(x, F.lit(0.0))).over(back)
    ratio = F.coalesce(F.try_divide(F.avg("ret").over(back), F.stddev_samp("ret").over(back)) * F.sqrt(F.lit(252.0)), F.lit(0.0))
    rows = returns.where("ret is not null").select(
        "strategy", "ts", F.row_number().over(w).alias("n"), F.round(ratio, 6).alias("sharpe"),
        F.round(F.coalesce(F.try_divide(total(F.col("ret")), total(-F.col("ret"))), F.lit(99.0)), 6).alias("profit_factor"),
        F.round(F.avg((F.col("ret") > 0).cast("double")).over(back), 6).alias("win_rate"),
    ).where(F.col("n") >= window)
    measures = [F.col(c) for c in ("sharpe", "profit_factor", "win_rate")]
    waits = health(*measures, F.lit(0))["status"] == "probation"
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("waits", waits)
    rows = rows.withColumn("since", F.max(F.when(~F.col("waits"), F.col("ts"))).over(run))  # the last row before the run
    rows = rows.withColumn("began", F.min(F.when(F.col("waits"), F.col("ts"))).over(Window.partitionBy("strategy", "since").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("days", F.when(F.col("waits"), F.datediff("ts", "began")).otherwise(0))
    return rows.withColumn("h", health(*measures, F.col("days"))).select("strategy", "ts", "sharpe", "profit_factor", "win_rate", "days", "h.status", "h.reason")


def revalidated(original: Column, current: Column, threshold: float = 0.4) -> Column:
    """``degradation, status`` of a ratio out of sample against the one at first; a negative first one degrades when it gets more negative."""
    lost = F.coalesce(F.try_divide(original - current, F.abs(original)), F.lit(0.0))
    return F.struct(lost.alias("degradation"), F.when(current < 0, "deactivate").when(lost >= threshold, "probation").otherwise("active").alias("status"))


def _alert(rows: DataFrame, severity: Column, title: Column, message: Column) -> DataFrame:
    return rows.select("ts", severity.alias("severity"), title.alias("title"), message.alias("message"))


def breaker_alerts(rows: DataFrame) -> DataFrame:
    """From ``ts, level, metric, value, threshold, action``."""
    said = F.format_string("%s=%.2f%% (threshold %.2f%%) → %s", "metric", F.col("value") * 100, F.col("threshold") * 100, "action")
    return _alert(rows, F.when(F.col("level") == "YELLOW", "warning").otherwise("critical"), F.concat(F.lit("Circuit breaker "), F.upper("level")), said)


def fill_alerts(rows: DataFrame) -> DataFrame:
    """From ``ts, symbol, quantity, price, order_id``."""
    quantity = F.regexp_replace(F.col("quantity").cast("string"), r"\.0$", "")
    said = F.concat(quantity, F.format_string(" @ %.2f (order %s)", F.col("price").cast("double"), F.col("order_id").cast("string")))
    return _alert(rows, F.lit("info"), F.concat(F.lit("Order filled: "), "symbol"), said)


def revalidation_alerts(rows: DataFrame) -> DataFrame:
    """From ``ts, strategy, original, current, degradation, status``."""
    said = F.format_string("OOS Sharpe %.2f vs %.2f (degradation %.0f%%)", "current", "original", F.col("degradation") * 100)
    return _alert(rows, F.when(F.col("status").isin("probation", "deactivate"), "warning").otherwise("info"), F.concat(F.lit("Strategy revalidated: "), "strategy", F.lit(" → "), "status"), said)


def status_alerts(rows: DataFrame) -> DataFrame:
    """From ``ts, strategy, old_status, new_status, reason, sharpe``."""
    ratio = F.when(F.col("sharpe").isNull(), "n/a").otherwise(F.format_string("%.2f", "sharpe"))
    said = F.concat(F.lit("reason: "), "reason", F.lit(" (sharpe_90d "), ratio, F.lit(")"))
    title = F.concat(F.lit("Strategy status: "), "strategy", F.lit(" "), "old_status", F.lit(" → "), "new_status")
    return _alert(rows, F.when(F.col("new_status").isin("probation", "deactivated"), "warning").otherwise("info"), title, said)


def drift_alerts(rows: DataFrame) -> DataFrame:
    """From ``ts, model_id, drift_type, severity, action``; a severity that is none of the known ones is a warning."""
    title = F.concat(F.lit("Model drift: "), "model_id", F.lit(" ("), "drift_type", F.lit(")"))
    return _alert(rows, F.when(F.col("severity").isin("warning", "critical"), F.col("severity")).otherwise("warning"), title, F.concat(F.lit("Recommended action: "), "action"))


def at_least(alerts: DataFrame, severity: str) -> DataFrame:
    return alerts.where(F.col("severity").isin(*SEVERITIES[SEVERITIES.index(severity) :]))


def vote(p: Column, features: list[Column], most_missing: float = 0.5) -> Column:
    """``signal, confidence`` of a probability: BUY from .55, SELL to .45; null where more than ``most_missing`` of the features are missing."""
    missing = sum((f.isNull().cast("int") for f in features), F.lit(0)) / max(1, len(features))
    signal = F.when(p >= 0.55, "BUY").when(p <= 0.45, "SELL").otherwise("HOLD")
    return F.when(p.isNotNull() & (missing <= most_missing), F.struct(signal.alias("signal"), F.least(F.lit(1.0), F.abs(p - 0.5) * 2).alias("confidence")))


def regime_component(regime: Column) -> Column:
    """``source, signal, confidence`` that a regime adds to a decision; null where it is neutral or unknown."""
    made = F.lit(None)
    for name, (signal, confidence) in BIAS.items():
        made = F.when(regime == name, F.struct(F.lit("macro").alias("source"), F.lit(signal).alias("signal"), F.lit(confidence).alias("confidence"))).otherwise(made)
    return made


def live_components(signals: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """The newest signal of each ``symbol, source`` of ``symbol, source, ts, signal, confidence``, if it is not older than ``hours``."""
    last = signals.where(F.col("ts") <= now).groupBy("symbol", "source").agg(F.max(F.struct("ts", "signal", "confidence")).alias("k"))
    return last.select("symbol", "source", "k.*").where(F.col("ts") >= now - F.expr(f"INTERVAL {int(hours)} HOURS"))


def best_levels(signals: DataFrame) -> DataFrame:
    """Of each symbol and direction the most confident signal, ties to the smaller source."""
    w = Window.partitionBy("symbol", "signal").orderBy(F.desc("confidence"), "source")
    return signals.where("signal <> 'HOLD'").withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def rolling_outcomes(outcomes: DataFrame, days: int = 30, horizon: int = 63, least: int = 10) -> DataFrame:
    """``model_id, ts, n, accuracy, sharpe``: outcomes, of ``horizon`` sessions each, of the last ``days`` days; fewer than ``least`` give null.

    Each outcome enters at its second and leaves after its last; running sums of both give every frame, so work doesn't grow with the
    frames. Sums are decimals of nine digits, so what has left leaves no trace.
    """
    x = F.col("outcome").cast("decimal(18,9)")
    facts = {"n": F.when(x.isNotNull(), 1).otherwise(0).cast("long"), "hit": F.when(F.col("outcome") > 0, 1).otherwise(0).cast("long"), "x": F.coalesce(x, F.lit(0).cast("decimal(18,9)")), "xx": F.coalesce((x * x).cast("decimal(28,18)"), F.lit(0).cast("decimal(28,18)"))}
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    enter = outcomes.select("model_id", "ts", second.alias("at"), *[c.alias(k) for k, c in facts.items()])
    leave = outcomes.select("model_id", F.lit(None).cast(outcomes.schema["ts"].dataType).alias("ts"), (second + days * 86400 + 1).alias("at"), *[(-c).alias(k) for k, c in facts.items()])
    w = Window.partitionBy("model_id").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    both = enter.unionByName(leave).withColumn("stays", F.col("ts").isNotNull())
    sums = both.select("model_id", "ts", "stays", *[F.sum(k).over(w).alias(k) for k in facts]).where("stays")
    n, mean, square = F.col("n"), F.col("x").cast("double") / F.col("n"), F.col("xx").cast("double")
    spread = square - F.col("n") * mean * mean
    deviation = F.when((n > 1) & (spread > square * 1e-12), F.sqrt(spread / (n - 1)))
    enough = n >= least
    ratio = F.coalesce(F.try_divide(mean, deviation) * F.sqrt(F.lit(252.0 / horizon)), F.lit(0.0))
    return sums.select("model_id", "ts", "n", F.when(enough, F.col("hit") / n).alias("accuracy"), F.when(enough, ratio).alias("sharpe"))


def thinned(curve: DataFrame, by: str, at: str, most: int) -> DataFrame:
    """At most ``most`` points of each curve: those that begin its equal parts, the last part's replaced by the last of all."""
    w = Window.partitionBy(by)
    rows = curve.withColumn("__i", F.row_number().over(w.orderBy(at)) - 1).withColumn("__n", F.count("*").over(w))
    i, n = F.col("__i"), F.col("__n")
    part = F.ceil(i * most / n)  # the first part that begins here or later
    begins = (F.floor(part * n / most) == i) & (part < most - 1)
    return rows.where((n <= most) | begins | (i == n - 1)).drop("__i", "__n")
