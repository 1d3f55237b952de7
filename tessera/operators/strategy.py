"""Trading rules over feature vectors, protective levels, risk envelope, cost filter, sizing and regimes, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Defaults of the rules.
RULES: dict[str, dict[str, float]] = {
    "momentum_rank": {"buy_rank": 0.8, "sell_rank": 0.2, "overbought": 70.0, "oversold": 30.0, "stop_atr": 2.0, "reward": 2.0},
    "rsi_bollinger_reversion": {"oversold": 30.0, "overbought": 70.0, "lower": 0.05, "upper": 0.95, "full": 10.0, "stop_atr": 1.5, "reward": 1.5},
    "sma_ema_crossover": {"full": 0.03, "stop_atr": 2.0, "reward": 2.0},
    "macd_confirmation": {"full": 0.01, "stop_atr": 2.0, "reward": 2.0},
    "donchian_breakout": {"full": 0.10, "stop_atr": 2.5, "reward": 2.5},
}
#: The envelope's limits, the cost model in basis points of a leg, and tiers' multiples of it.
LIMITS = {"drawdown": 0.15, "daily_loss": 0.05, "confidence": 0.55, "exposure": 0.80, "sector": 3}
LEG_BPS = 5.0 + 5.0 + 2.0
TIERS = {"large": 1.0, "mid": 1.5, "small": 2.5, "micro": 5.0}
EDGE_MULTIPLE = 2.0
FALLBACK_STOP = 0.05
#: Largest share in equities by regime, and the sectors that are allowed where not all are.
EXPOSURE = {"expansion": 0.90, "recovery": 0.80, "slowdown": 0.60, "contraction": 0.35, "crisis": 0.15}
DEFENSIVE = ["Consumer Staples", "Utilities", "Health Care"]
ALLOWED = {"slowdown": [*DEFENSIVE, "Information Technology"], "contraction": DEFENSIVE, "crisis": DEFENSIVE}


def saturating(magnitude: Column, full: float) -> Column:
    return 0.5 + 0.5 * F.least(F.lit(1.0), F.abs(magnitude) / full)


def _momentum(p: Mapping[str, float]) -> tuple[Column, Column, Column, list[str]]:
    rank, rsi = F.col("momentum_rank"), F.col("rsi_14")
    return (rank >= p["buy_rank"]) & (rsi < p["overbought"]), (rank <= p["sell_rank"]) & (rsi > p["oversold"]), F.greatest(rank, 1 - rank), ["momentum_rank", "rsi_14"]


def _reversion(p: Mapping[str, float]) -> tuple[Column, Column, Column, list[str]]:
    rsi, band = F.col("rsi_14"), F.col("bb_pct_b")
    far = F.when(rsi <= p["oversold"], p["oversold"] - rsi).otherwise(rsi - p["overbought"])
    return (rsi <= p["oversold"]) & (band <= p["lower"]), (rsi >= p["overbought"]) & (band >= p["upper"]), saturating(far, p["full"]), ["rsi_14", "bb_pct_b"]


def _crossover(p: Mapping[str, float]) -> tuple[Column, Column, Column, list[str]]:
    fast, slow = (F.try_divide(F.col(a), F.when(F.col(b) > 0, F.col(b))) - 1 for a, b in (("ema_12", "ema_26"), ("sma_20", "sma_50")))
    return (fast > 0) & (slow > 0), (fast < 0) & (slow < 0), saturating(F.least(F.abs(fast), F.abs(slow)), p["full"]), ["ema_12", "ema_26", "sma_20", "sma_50"]


def _confirmation(p: Mapping[str, float]) -> tuple[Column, Column, Column, list[str]]:
    line = F.try_divide(F.col("macd_hist"), F.when(F.col("c") > 0, F.col("c")))
    ret = F.col("return_20d")
    return (line > 0) & (ret > 0), (line < 0) & (ret < 0), saturating(line, p["full"]), ["macd_hist", "c", "return_20d"]


def _breakout(p: Mapping[str, float]) -> tuple[Column, Column, Column, list[str]]:
    at = F.col("donchian_pos_20")
    return at > 1, at < 0, saturating(F.when(at > 1, at - 1).otherwise(-at), p["full"]), ["donchian_pos_20"]


_RULES = {"momentum_rank": _momentum, "rsi_bollinger_reversion": _reversion, "sma_ema_crossover": _crossover, "macd_confirmation": _confirmation, "donchian_breakout": _breakout}


def signals(vectors: DataFrame, overrides: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """``symbol, ts, rule, signal, confidence, stop, target`` for every feature vector and rule.

    A rule whose inputs are missing, or that has no opinion, holds with confidence 0.5 and no levels. Levels lie at
    ``atr_pct_14`` times the rule's multiple from the raw ``close``, FALLBACK_STOP of it where that is missing.
    """
    made = []
    for name, rule in _RULES.items():
        p = RULES[name] | dict((overrides or {}).get(name, {}))
        buy, sell, confidence, needs = rule(p)
        known = F.lit(True)
        for c in needs:
            known = known & F.col(c).isNotNull()
        signal = F.when(known & F.coalesce(buy, F.lit(False)), "BUY").when(known & F.coalesce(sell, F.lit(False)), "SELL").otherwise("HOLD")
        made.append(F.struct(F.lit(name).alias("rule"), signal.alias("signal"), confidence.alias("x"), F.lit(p["stop_atr"]).alias("stop_atr"), F.lit(p["reward"]).alias("reward")))
    rows = vectors.select("symbol", "ts", "close", "atr_pct_14", F.explode(F.array(*made)).alias("r")).select("symbol", "ts", "close", "atr_pct_14", "r.*")
    side = F.when(F.col("signal") == "BUY", 1.0).when(F.col("signal") == "SELL", -1.0)
    distance = F.col("close") * F.coalesce(F.when(F.col("atr_pct_14") > 0, F.col("atr_pct_14") * F.col("stop_atr")), F.lit(FALLBACK_STOP))
    return rows.select(
        "symbol", "ts", "rule", "signal", F.when(F.col("signal") == "HOLD", 0.5).otherwise(F.col("x")).alias("confidence"),
        (F.col("close") - side * distance).alias("stop"), (F.col("close") + side * distance * F.col("reward")).alias("target"),
    )


def held(signals: DataFrame) -> DataFrame:
    """``symbol, ts, position``: long from a BUY until the next SELL, flat before the first."""
    side = F.when(F.col("signal") == "BUY", 1).when(F.col("signal") == "SELL", 0)
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return signals.select("symbol", "ts", F.coalesce(F.last(side, True).over(w), F.lit(0)).alias("position"))


def envelope(limits: Mapping[str, float] = LIMITS) -> Column:
    """The reason of the first limit that ``drawdown, daily_loss, confidence, exposure, in_sector, signal, stop`` break, else ``approved``."""
    return (
        F.when(F.abs("drawdown") >= limits["drawdown"], "drawdown").when(F.abs("daily_loss") >= limits["daily_loss"], "daily_loss")
        .when(F.col("confidence") < limits["confidence"], "confidence").when(F.col("exposure") >= limits["exposure"], "exposure")
        .when(F.col("in_sector") >= limits["sector"], "sector").when((F.col("signal") != "HOLD") & F.col("stop").isNull(), "missing_stop").otherwise("approved")
    )


def required_edge_bps(tier: Column) -> Column:
    """Expected return that a round trip asks for; an unknown tier costs as a large one."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv]), tier), F.lit(1.0)) * (2 * LEG_BPS * EDGE_MULTIPLE)


def kelly_weight(p: Column, allowed: Column, fraction: float = 0.25, most: float = 0.05, least_edge: float = 0.02) -> Column:
    """Fractional Kelly weight of an even bet, at most ``most`` and what the sizer allows; never short."""
    edge = 2 * F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) - 1
    full = F.when(edge < least_edge, 0.0).otherwise(edge)
    return F.greatest(F.lit(0.0), F.least(full * fraction, F.lit(most), F.greatest(allowed, F.lit(0.0))))


def scaled_to_exposure(rows: DataFrame, weight: str, by: str = "ts", most: float = 0.80) -> DataFrame:
    """``weight`` without its negative part, scaled down in proportion where a session's sum exceeds ``most``."""
    w = F.greatest(F.col(weight), F.lit(0.0))
    total = F.sum(w).over(Window.partitionBy(by))
    return rows.withColumn(weight, w * F.least(F.lit(1.0), F.try_divide(F.lit(most), total)))


def risk_budget(drawdown: Column, base: float = 0.02, begin: float = 0.05, end: float = 0.15) -> Column:
    """Share of the book to risk on a trade: ``base``, falling to 0 between two drawdowns."""
    scale = 1 - (F.abs(drawdown) - begin) / (end - begin)
    return base * F.greatest(F.lit(0.0), F.least(F.lit(1.0), scale))


def order_shares(value: Column, entry: Column, stop: Column, drawdown: Column, most: float = 0.05) -> Column:
    """Shares that a trade may buy: the risk budget over the risk of a share, at most ``most`` of the book; 0 without a stop."""
    by_risk = F.floor(F.try_divide(value * risk_budget(drawdown), F.abs(entry - stop)))
    return F.coalesce(F.least(by_risk, F.floor(F.try_divide(value * most, entry))), F.lit(0)).cast("long")


def regime(curve: str = "curve", spread: str = "spread", pmi: str = "pmi") -> Column:
    """Crisis, contraction, slowdown, expansion or recovery from the curve, the credit spread and the purchasing index; null without any."""
    c, s, m = F.col(curve), F.col(spread), F.col(pmi)
    return (
        F.when((s >= 3.0) | ((c <= -0.5) & (m < 48.0)), "crisis").when((m < 48.0) | (c < 0), "contraction").when((m < 52.0) | (s >= 2.0), "slowdown")
        .when(m >= 55.0, "expansion").when(m.isNotNull(), "recovery").when(c > 0, "expansion").when(c.isNotNull(), "contraction")
    )


def sector_allowed(regime: Column, sector: Column) -> Column:
    """Whether a regime lets a sector be bought; a missing sector only where all are allowed."""
    out = F.lit(True)
    for name, sectors in ALLOWED.items():
        out = F.when(regime == name, F.coalesce(sector.isin(*sectors), F.lit(False))).otherwise(out)
    return out


def exposure_cap(regime: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in EXPOSURE.items() for x in kv]), regime), F.lit(0.60))


SCORES = ("income_positive", "cash_positive", "cash_above_income", "roa_up", "leverage_down", "liquidity_up", "no_dilution", "margin_up", "turnover_up")


def f_score(now: str = "", before: str = "prior") -> list[Column]:
    """Nine signs of financial strength, false where an input is missing, from a statement and the struct of the one before."""
    col = lambda c: F.col(f"{now}.{c}" if now else c)
    was = lambda c: F.col(f"{before}.{c}")
    quot = lambda f, a, b: F.try_divide(f(a), f(b))
    grew = lambda a, b: quot(col, a, b) > quot(was, a, b)
    tests = [
        col("net_income") > 0, col("operating_cash_flow") > 0, col("operating_cash_flow") > col("net_income"), grew("net_income", "total_assets"),
        quot(col, "total_liabilities", "total_assets") < quot(was, "total_liabilities", "total_assets"), grew("current_assets", "current_liabilities"),
        col("shares_outstanding") <= was("shares_outstanding"), grew("net_income", "revenue"), grew("revenue", "total_assets"),
    ]
    return [F.coalesce(t, F.lit(False)).alias(name) for t, name in zip(tests, SCORES, strict=True)]


def scored_history(statements: DataFrame) -> DataFrame:
    """Each statement of ``symbol, period_end, ...`` with the signs of :func:`f_score` against the period before and their number."""
    w = Window.partitionBy("symbol").orderBy("period_end")
    rows = statements.withColumn("prior", F.lag(F.struct(*[c for c in statements.columns if c != "symbol"])).over(w))
    rows = rows.select("*", *f_score())
    total = F.lit(0)
    for name in SCORES:
        total = total + F.col(name).cast("int")
    return rows.withColumn("f_score", total).drop("prior")
