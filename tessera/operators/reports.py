"""What is reported of models, books, strategies and tables: drift, equity, attribution, correlations of holdings, breaches of the contract."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import gates, ledger, panel
from tessera.operators.market import percentile_rank

#: Limits of drift, and what a model without measured outcomes counts as.
PSI_LIMIT, P_LIMIT, DECAY_LIMIT, ACCURACY_LIMIT, NEUTRAL_ACCURACY = 0.20, 0.01, -0.30, 0.48, 0.5
#: Levels and duplicates that no model may read, and the least variance of a feature.
INADMISSIBLE = ("close", "sma_10", "sma_20", "sma_50", "momentum_20")
LEAST_VARIANCE = 1e-6


def drift_reports(samples: DataFrame, predictions: DataFrame, performance: DataFrame) -> DataFrame:
    """``model_id, drifted, worst_psi, prediction_shift, sharpe_decay, accuracy, performance_measured, needs_retrain, needs_investigation, action``.

    ``samples`` are ``model_id, feature, side ('ref' | 'cur'), value``, ``predictions`` the same without feature, ``performance`` one row a
    model: ``baseline_sharpe, sharpe, accuracy``, null where too few outcomes are known, which counts as the baseline and 0.5. ``drifted`` names
    features in their order, joined by commas. A model without samples has no drifted feature, one without predictions no shift.
    """
    key = F.struct("model_id", "feature").alias("feature")
    moved = panel.psi(samples.select(key, "side", "value"))
    name = F.when(F.col("psi") > PSI_LIMIT, F.col("feature.feature"))
    features = moved.groupBy(F.col("feature.model_id").alias("model_id")).agg(F.array_join(F.sort_array(F.collect_list(name)), ",").alias("drifted"), F.max("psi").alias("worst_psi"))  # names, which the schema bounds
    shift = ledger.ks(predictions.select(F.col("model_id").alias("feature"), "side", "value")).select(F.col("feature").alias("model_id"), "p_value")
    rows = performance.join(features, "model_id", "left").join(shift, "model_id", "left")
    base, measured = F.col("baseline_sharpe"), F.col("sharpe").isNotNull()
    decay = F.coalesce(F.try_divide(F.coalesce("sharpe", base) - base, F.abs(base)), F.lit(0.0))
    rows = rows.select(
        "model_id", F.coalesce("drifted", F.lit("")).alias("drifted"), "worst_psi", (1 - F.coalesce("p_value", F.lit(1.0))).alias("prediction_shift"), decay.alias("sharpe_decay"),
        F.coalesce("accuracy", F.lit(NEUTRAL_ACCURACY)).alias("accuracy"), measured.alias("performance_measured"),
    )
    retrain = (F.col("drifted") != "") | (F.col("sharpe_decay") < DECAY_LIMIT) | (F.col("accuracy") < ACCURACY_LIMIT)
    look = F.col("prediction_shift") > 1 - P_LIMIT
    action = F.when(retrain, "auto_retrain").when(look, "alert_and_monitor").otherwise("no_action")
    return rows.withColumns({"needs_retrain": retrain, "needs_investigation": look, "action": action})


def equity_paths(equity: DataFrame, by: str = "account", most: int = 2000) -> DataFrame:
    """``by, ts, equity, ret, drawdown`` of the newest ``most`` points of each curve ``by, ts, equity``; peaks and returns are those of the whole curve.

    A point without equity is none. ``ret`` is null at the first point and after a level that is not positive.
    """
    w = Window.partitionBy(by).orderBy("ts")
    level = F.col("equity")
    before = F.lag(level).over(w)
    peak = F.max(level).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = equity.where(level.isNotNull()).select(
        by, "ts", "equity", F.when(before > 0, level / before - 1).alias("ret"), F.when(peak > 0, 1 - level / peak).otherwise(0.0).alias("drawdown"),
        F.row_number().over(Window.partitionBy(by).orderBy(F.desc("ts"))).alias("__k"),
    )
    return rows.where(F.col("__k") <= most).drop("__k")


def book_sections(paths: DataFrame, by: str = "account", least: int = 20) -> DataFrame:
    """``by, sessions, pnl_abs, pnl_pct, sharpe, max_drawdown, returns, var_95, cvar_95`` of :func:`equity_paths`, one row a book.

    Gains need a positive first level, the ratio two returns with spread, the tail ``least`` returns; what is missing is null.
    """
    first, last = F.min_by("equity", "ts"), F.max_by("equity", "ts")
    spread = F.stddev_samp("ret")
    body = paths.groupBy(by).agg(
        F.count("*").alias("sessions"), F.when(first > 0, last - first).alias("pnl_abs"), F.when(first > 0, last / first - 1).alias("pnl_pct"),
        F.when(spread > 0, F.avg("ret") / spread * math.sqrt(252.0)).alias("sharpe"), F.max("drawdown").alias("max_drawdown"), F.count("ret").alias("returns"),
    )
    tail = panel.tail_risk(paths.select(F.col(by).alias("symbol"), "ret"), 0.95, least)
    return body.join(tail.select(F.col("symbol").alias(by), F.col("var").alias("var_95"), F.col("cvar").alias("cvar_95")), by, "left")


def attribution(statuses: DataFrame, weights: DataFrame, prefix: str = "strategy:") -> DataFrame:
    """``name, kind, status, weight``: each strategy's newest status of ``strategy, ts, status`` with its learned weight of ``source, weight``.

    Weights of strategies bear ``prefix``. A strategy that was never measured has a null weight, a source that is no strategy the kind ``other``
    and no status; a weight of a strategy without a status isn't reported.
    """
    last = statuses.groupBy(F.col("strategy").alias("name")).agg(F.max_by("status", "ts").alias("status"))
    own = weights.where(F.startswith("source", F.lit(prefix))).select(F.substring("source", len(prefix) + 1, 1 << 20).alias("name"), "weight")
    ours = last.join(own, "name", "left").select("name", F.lit("strategy").alias("kind"), "status", "weight")
    return ours.unionByName(weights.where(~F.startswith("source", F.lit(prefix))).select(F.col("source").alias("name"), F.lit("other").alias("kind"), F.lit(None).cast("string").alias("status"), "weight"))


def held_correlations(returns: DataFrame, held: DataFrame, lookback: int = 120, least: int = 20) -> DataFrame:
    """``a, b, n, corr, coverage`` of the held symbols ``a < b``: their last common ``n`` returns, counted from the newest of each.

    ``held`` is a book's list of names, so pairs are a book's, not the market's. Fewer than ``least`` returns or no spread give no correlation;
    ``coverage`` is the share of pairs that have one. Names without returns stay, with n = 0.
    """
    names = held.select("symbol").distinct()
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    last = returns.join(F.broadcast(names), "symbol", "left_semi").where("ret is not null").select("symbol", "ret", back.alias("k")).where(F.col("k") <= lookback)
    side = lambda s: last.select(F.col("symbol").alias(s), F.col("ret").alias(f"r{s}"), "k")
    both = side("a").join(side("b"), "k").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), panel.correlation("ra", "rb").alias("corr"))
    pairs = names.select(F.col("symbol").alias("a")).join(F.broadcast(names.select(F.col("symbol").alias("b"))), F.col("a") < F.col("b"))
    rows = pairs.join(both, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") >= least, F.col("corr")).alias("corr"))
    return rows.withColumn("coverage", F.count("corr").over(Window.partitionBy(F.lit(1))) / F.count("*").over(Window.partitionBy(F.lit(1))))  # a book's pairs


def feature_states(table: DataFrame, names: list[str], candidates: tuple[str, ...] = (), admit: bool = False) -> DataFrame:
    """``feature, variance, neutral_share, state`` of the columns ``names`` in one read: ``inadmissible``, ``candidate`` (unless ``admit``), ``constant``, else ``model``.

    A rank of exactly 0.5 is an absent one. An empty table has constant features only.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`v_{n}`").alias("variance"), F.col(f"`h_{n}`").alias("neutral_share")) for n in names]))
    sums = table.agg(*[x for n in names for x in (F.coalesce(F.var_pop(n), F.lit(0.0)).alias(f"v_{n}"), F.coalesce(F.avg((F.col(n) == 0.5).cast("double")), F.lit(1.0)).alias(f"h_{n}"))])
    rows = sums.select(each.alias("x")).select("x.*")
    state = F.when(F.col("feature").isin(*INADMISSIBLE), "inadmissible")
    if candidates and not admit:
        state = state.when(F.col("feature").isin(*candidates), "candidate")
    return rows.withColumn("state", state.when(F.col("variance") <= LEAST_VARIANCE, "constant").otherwise("model"))


def violations(report: DataFrame, states: DataFrame, least_sessions: int, least_samples: int, least_names: float, most_neutral: float, requested: int | None = None, tolerance: float = 0.05) -> DataFrame:
    """``rule, feature, figure, bound``: what a table of one-row ``report`` (sessions, samples, median_names) and ``states`` breaches, one row for each; none means that it passes."""
    c = lambda x: F.col(x).cast("double")
    rule = lambda name, figure, bound, low: F.struct(F.lit(name).alias("rule"), F.lit("").alias("feature"), figure.alias("figure"), F.lit(float(bound)).alias("bound"), (F.coalesce(figure, F.lit(0.0)) < bound if low else figure > bound).alias("breached"))
    rules = [rule("sessions", c("sessions"), least_sessions, True), rule("samples", c("samples"), least_samples, True), rule("median_names", c("median_names"), least_names, True)]
    if requested:
        rules.append(rule("short_of_requested", 1 - c("sessions") / requested, tolerance, False))
    whole = report.select(F.explode(F.array(*rules)).alias("x")).select("x.*")
    of = lambda name, figure, bound: states.select(F.lit(name).alias("rule"), "feature", F.col(figure).alias("figure"), F.lit(bound).alias("bound"), (F.col(figure) > bound if name == "neutral" else F.col(figure) <= bound).alias("breached"))
    rows = whole.unionByName(of("constant", "variance", LEAST_VARIANCE)).unionByName(of("neutral", "neutral_share", float(most_neutral)))
    return rows.where("breached").drop("breached")


def valuation(f: str = "filing", price: Column | None = None) -> list[Column]:
    """Accruals over assets, book to market and earnings yield at ``price``; signed, null for a missing input, no assets, no shares or no positive price."""
    col = lambda c: F.col(f"{f}.{c}")
    price = F.col("price") if price is None else price
    cap = F.when((price > 0) & (col("shares_outstanding") != 0), col("shares_outstanding") * price)
    return [
        ((col("net_income") - col("operating_cash_flow")) / F.when(col("total_assets") != 0, col("total_assets"))).alias("accruals"),
        ((col("total_assets") - col("total_liabilities")) / cap).alias("book_to_market"), (col("net_income") / cap).alias("earnings_yield"),
    ]


def served_ranks(vectors: DataFrame, overlays: DataFrame, names: list[str]) -> DataFrame:
    """``symbol, ts, names``: the newest vectors of one interval with their attributes on top, then ranked among each other; an absent value is neutral, 0.5."""
    long = gates.overlay(vectors, overlays, names).select("symbol", "ts", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names])).alias("x")).select("symbol", "ts", "x.*")
    placed = long.withColumn("place", percentile_rank("value", "feature"))  # a row for each symbol
    return placed.groupBy("symbol", "ts").agg(*[F.coalesce(F.max(F.when(F.col("feature") == n, F.col("place"))), F.lit(0.5)).alias(n) for n in names])


def needs_catchup(last_sync: Column, now: Column, close_hour: int = 23) -> Column:
    """Whether no finished pull covers the newest session that ``now`` can have: today's from ``close_hour`` on, before that yesterday's. Dates are compared, so a clock that slept says nothing; never synced is due."""
    covered = F.when(F.hour(now) >= close_hour, F.to_date(now)).otherwise(F.date_sub(F.to_date(now), 1))
    return F.coalesce(last_sync < covered, F.lit(True))
