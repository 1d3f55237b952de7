"""Panels over time: benchmark, neutralisation, point-in-time joins, evaluation, tail risk, drift, ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, k: int, keys: tuple[str, ...] = ("symbol",), at: str = "ts") -> DataFrame:
    """The newest ``k`` rows of every key; Spark limits groups before the exchange."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at))
    return rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")


def upsert(stored: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("symbol", "ts"), order: str = "seq") -> DataFrame:
    """``stored`` with the rows of ``batch``; of rows with one key the last of the batch by ``order`` wins."""
    both = stored.withColumn(order, F.lit(None).cast(batch.schema[order].dataType)).unionByName(batch)
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order))
    return both.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", order)


def restated(stored: DataFrame, fetched: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """``symbol, overlap, restated``: whether any overlapping bar's adjustment factor moved by more than ``tolerance``."""
    factor = lambda name: F.try_divide(F.coalesce("adj_close", "close"), F.col("close")).alias(name)
    both = stored.select("symbol", "ts", factor("f0")).join(fetched.select("symbol", "ts", factor("f1")), ["symbol", "ts"])
    moved = F.try_divide(F.abs(F.col("f1") - F.col("f0")), F.col("f0")) > tolerance
    return both.groupBy("symbol").agg(F.count("*").alias("overlap"), F.coalesce(F.bool_or(moved), F.lit(False)).alias("restated"))


def gaps(bars: DataFrame) -> DataFrame:
    """Read-back scan: ``symbol, sessions, max_gap_days, n_suspect, n_notable, adj_coverage``.

    A raw move is suspect at -45 % or below, or +80 % or above, else notable at -25 % or +50 %.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    move = F.try_divide(F.col("close"), F.lag("close").over(w)) - 1
    rows = bars.select("symbol", "adj_close", move.alias("move"), F.datediff("ts", F.lag("ts").over(w)).alias("gap"))
    suspect, notable = (F.col("move") <= -0.45) | (F.col("move") >= 0.8), (F.col("move") <= -0.25) | (F.col("move") >= 0.5)
    return rows.groupBy("symbol").agg(
        F.count("*").alias("sessions"), F.max("gap").alias("max_gap_days"), F.count_if(suspect).alias("n_suspect"),
        F.count_if(notable & ~suspect).alias("n_notable"), (F.count("adj_close") / F.count("*")).alias("adj_coverage"),
    )


def benchmark(bars: DataFrame, least: int = 3) -> DataFrame:
    """``ts, names, level``: cumulated median log return of the names with bars on this and the global previous session.

    A session with fewer than ``least`` such names carries the level. Only the table with one row a session is
    ordered as a whole.
    """
    rows = bars.select("symbol", "ts", F.coalesce("adj_close", "close").alias("c")).where("c > 0")
    calendar = rows.select("ts").distinct().select("ts", F.lag("ts").over(Window.orderBy("ts")).alias("before"))
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = rows.select("symbol", "ts", F.log(F.col("c") / F.lag("c").over(w)).alias("lr"), F.lag("ts").over(w).alias("own"))
    rows = rows.join(calendar, "ts").withColumn("lr", F.when(F.col("own") == F.col("before"), F.col("lr")))
    step = rows.groupBy("ts").agg(F.count("lr").alias("names"), F.percentile("lr", F.lit(0.5)).alias("m"))
    step = step.withColumn("m", F.when(F.col("names") >= least, F.col("m")).otherwise(0.0))
    return step.select("ts", "names", F.exp(F.sum("m").over(Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))).alias("level"))


def sector_neutral(rows: DataFrame, value: str, least: int = 4, by: tuple[str, ...] = ("ts",)) -> DataFrame:
    """``value`` less its sector's median in the session, or in each ``by``; small sectors are pooled, a pool that is small stays as it is."""
    n = F.count(value).over(Window.partitionBy(*by, "sector"))
    rows = rows.withColumn("__g", F.when(n >= least, F.col("sector")))
    group = Window.partitionBy(*by, "__g")
    middle = F.when(F.count(value).over(group) >= least, F.percentile(value, F.lit(0.5)).over(group))
    return rows.withColumn(value, F.col(value) - F.coalesce(middle, F.lit(0.0))).drop("__g")


def latest_filing(sessions: DataFrame, filings: DataFrame) -> DataFrame:
    """Each ``symbol, ts`` with the struct ``filing`` of the last ``symbol, filed_at, period_end, ...`` filed strictly before.

    Both sides meet in one exchange as a union; a running ``last`` carries the filing on. Filings without a date are
    never seen; of those filed at one time the newest period counts.
    """
    facts = filings.where("filed_at is not null")
    fact = F.struct(*[c for c in facts.columns if c != "symbol"])
    left = sessions.select("symbol", "ts", F.lit(0).alias("o"), F.lit(None).cast(facts.select(fact.alias("x")).schema["x"].dataType).alias("filing"))
    right = facts.select("symbol", F.col("filed_at").alias("ts"), F.lit(1).alias("o"), fact.alias("filing"))
    w = Window.partitionBy("symbol").orderBy("ts", "o", "filing.period_end").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("filing", F.last("filing", True).over(w))
    return both.where("o = 0").drop("o")


def ratios(f: str = "filing") -> list[Column]:
    """Net margin, return on assets, leverage, gross profitability; null for a missing input or a zero denominator."""
    col = lambda c: F.col(f"{f}.{c}")
    per = lambda a, b: a / F.when(b != 0, b)
    gross = F.coalesce(col("gross_profit"), col("revenue") - col("cost_of_revenue"))
    return [
        per(col("net_income"), col("revenue")).alias("net_margin"), per(col("net_income"), col("total_assets")).alias("roa"),
        per(col("total_liabilities"), col("total_assets")).alias("leverage"), per(gross, col("total_assets")).alias("gross_profitability"),
    ]


def visible_vintages(days: DataFrame, observations: DataFrame) -> DataFrame:
    """``series, day, observation_date, value`` as known on each ``series, day``: newest period, then newest vintage.

    An observation is visible from the later of its date and its vintage, that day included.
    """
    known = F.struct("observation_date", "realtime_start", "value")
    seen = observations.select("series", F.greatest("observation_date", "realtime_start").alias("day"), F.lit(0).alias("o"), known.alias("k"))
    asked = days.select("series", "day", F.lit(1).alias("o"), F.lit(None).cast(seen.schema["k"].dataType).alias("k"))
    w = Window.partitionBy("series").orderBy("day", "o").rowsBetween(Window.unboundedPreceding, 0)
    out = seen.unionByName(asked).withColumn("k", F.max("k").over(w)).where("o = 1")
    return out.select("series", "day", "k.observation_date", "k.value")


def average_rank(value: str, by: list[str]) -> Column:
    """1-based rank, ties averaged."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation of two columns without nulls; null without spread, where ``corr`` may raise."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def rank_ic(scored: DataFrame, score: str, outcome: str) -> DataFrame:
    """``ts, n, ic``: Spearman correlation in each session; 0 for fewer than three rows or no spread."""
    rows = scored.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    rows = rows.select("ts", average_rank(score, ["ts"]).alias("a"), average_rank(outcome, ["ts"]).alias("b"))
    ic = F.coalesce(F.nanvl(correlation("a", "b"), F.lit(0.0)), F.lit(0.0))
    return rows.groupBy("ts").agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, ic).otherwise(0.0).alias("ic"))


def auc(scored: DataFrame, score: str, label: str, by: str) -> DataFrame:
    """``by, n, auc``: Mann-Whitney with ties averaged; null where one class is missing.

    Rows are counted by distinct score first, so ranks are running sums over distinct scores.
    """
    counts = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(by, score).agg(F.count("*").alias("m"), F.sum(label).alias("pos"))
    before = F.sum("m").over(Window.partitionBy(by).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    sums = counts.withColumn("rank", before + (F.col("m") + 1) / 2).groupBy(by).agg(F.sum("m").alias("n"), F.sum("pos").alias("p"), F.sum(F.col("pos") * F.col("rank")).alias("s"))
    neg = F.col("n") - F.col("p")
    return sums.select(by, "n", F.when((F.col("p") > 0) & (neg > 0), (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg)).alias("auc"))


def tail_risk(returns: DataFrame, confidence: float = 0.95, least: int = 20) -> DataFrame:
    """``symbol, n, var, cvar`` from the worst ``max(ceil((1 - confidence) * n), 1)`` returns of ``symbol, ret``."""
    rows = returns.where("ret is not null")
    w = Window.partitionBy("symbol")
    rows = rows.withColumn("n", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy("ret")))
    tail = rows.where((F.col("n") >= least) & (F.col("k") <= F.greatest(F.ceil(F.round((1 - confidence) * F.col("n"), 9)), F.lit(1))))
    return tail.groupBy("symbol").agg(F.max("n").alias("n"), F.greatest(-F.max("ret"), F.lit(0.0)).alias("var"), F.greatest(-F.avg("ret"), F.lit(0.0)).alias("cvar"))


def psi(samples: DataFrame, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """``feature, psi`` of ``feature, side ('ref' | 'cur'), value``: equal-width bins of the reference, open at both ends.

    A constant reference fills a middle bin: what is below it falls into the first bin, what is above into the last.
    """
    ref = samples.where("side = 'ref'").groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    spread = F.floor(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")) * bins)
    flat = F.when(F.col("value") < F.col("lo"), 0).when(F.col("value") > F.col("hi"), bins - 1).otherwise(bins // 2)
    at = F.coalesce(spread, flat.cast("long"))
    binned = samples.join(ref, "feature")
    binned = binned.where("value is not null").select("feature", "side", F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).alias("bin"))
    counts = binned.groupBy("feature", "bin").agg(F.count_if(F.col("side") == "ref").alias("r"), F.count_if(F.col("side") == "cur").alias("c"))
    every = counts.select("feature").distinct().select("feature", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    counts = every.join(counts.withColumn("bin", F.col("bin").cast("long")), ["feature", "bin"], "left").na.fill(0, ["r", "c"])
    w = Window.partitionBy("feature")
    part = lambda c: (F.col(c) + eps) / (F.sum(c).over(w) + eps * bins)
    p, q = part("r"), part("c")
    return counts.select("feature", ((q - p) * F.log(q / p)).alias("x")).groupBy("feature").agg(F.sum("x").alias("psi"))


def changes(rows: DataFrame, value: str, key: str, order: list[str]) -> DataFrame:
    """The rows whose ``value`` differs from the key's row before; the first row of a key is a change."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("before", before).where(~F.col(value).eqNullSafe(F.col("before")))


def votes(signals: DataFrame, weights: DataFrame, threshold: float = 0.2) -> DataFrame:
    """``symbol, score, signal, confidence`` from the latest ``symbol, source, at, signal, confidence`` of every source.

    BUY counts its confidence, SELL the negative, HOLD nothing, times the ``source, weight``; unknown sources weigh 0.
    """
    sign = F.when(F.col("signal") == "BUY", 1.0).when(F.col("signal") == "SELL", -1.0).otherwise(0.0)
    last = signals.groupBy("symbol", "source").agg(F.max_by(sign * F.col("confidence"), F.struct("at", "signal", "confidence")).alias("x"))
    score = F.round(F.coalesce(F.sum(F.col("x") * F.coalesce("weight", F.lit(0.0))), F.lit(0.0)), 9)  # sums in any order meet the threshold alike
    out = last.join(weights, "source", "left").groupBy("symbol").agg(score.alias("score"))
    signal = F.when(F.col("score") >= threshold, "BUY").when(F.col("score") <= -threshold, "SELL").otherwise("HOLD")
    return out.select("symbol", "score", signal.alias("signal"), F.least(F.abs("score"), F.lit(1.0)).alias("confidence"))
