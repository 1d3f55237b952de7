"""Labels against a benchmark, their overlap, folds, books of selections and what they earn."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.panel import correlation

YEAR = 252.0


def on_benchmark(bars: DataFrame, levels: DataFrame) -> DataFrame:
    """``bars`` with ``market``: the benchmark's last known level, 1 before the first. Levels have one row a session."""
    rows = bars.join(F.broadcast(levels.select("ts", F.col("level").alias("market"))), "ts", "left")
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("market", F.coalesce(F.last("market", True).over(w), F.lit(1.0)))


def excess_barrier(rows: DataFrame, horizon: int = 63, sigma_window: int = 20, up: float = 1.0, down: float = 1.0) -> DataFrame:
    """``symbol, ts, n, touch, barrier, label`` of ``symbol, ts, c, market``: the first barrier that the excess log return closes beyond.

    Barriers lie at the trailing deviation of daily excess returns times ``sqrt(horizon)``. Without a touch the
    sign of the last excess decides; windows that history cuts short are unresolved. Levels that are not positive give no label.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    level = F.when((F.col("c") > 0) & (F.col("market") > 0), F.log(F.col("c") / F.col("market")))
    rows = rows.select("symbol", "ts", level.alias("x"), F.row_number().over(w).alias("n"))
    rows = rows.withColumn("d", F.col("x") - F.lag("x").over(w))
    back = w.rowsBetween(1 - sigma_window, 0)
    sigma = F.when(F.count("d").over(back) == sigma_window, F.stddev_samp("d").over(back))
    rows = rows.withColumn("width", F.when(sigma > 0, sigma) * math.sqrt(horizon))
    rows = rows.withColumn("next", F.collect_list(F.struct("n", (F.col("x")).alias("x"))).over(w.rowsBetween(1, horizon)))  # horizon entries at most
    beyond = lambda y: (y["x"] - F.col("x") <= -down * F.col("width")) | (y["x"] - F.col("x") >= up * F.col("width")) | y["x"].isNull()
    rows = rows.withColumn("hit", F.get(F.filter("next", beyond), F.lit(0))).withColumn("end", F.get("next", F.lit(horizon - 1)))
    gain = F.col("hit.x") - F.col("x")
    barrier = F.when(F.col("width").isNull(), None).when(F.col("hit").isNotNull(), F.when(gain.isNull(), None).when(gain < 0, "lower").otherwise("upper")).when(F.col("end").isNotNull(), "vertical")
    rows = rows.withColumn("barrier", barrier)
    label = F.when(F.col("barrier") == "vertical", (F.col("end.x") > F.col("x")).cast("int")).when(F.col("barrier").isNotNull(), (F.col("barrier") == "upper").cast("int"))
    return rows.select("symbol", "ts", "n", F.when(F.col("barrier").isNotNull(), F.coalesce("hit.n", "end.n")).alias("touch"), "barrier", label.alias("label"))


def uniqueness(spans: DataFrame, *keep: str) -> DataFrame:
    """``symbol, n, keep, weight`` of labels ``symbol, n, touch``, which ``symbol, n`` name: the mean of 1 over the labels open on each session that one spans.

    Each label is an opening and a closing. In the order of these the open labels are a running sum, and so is the inverse of their number
    over the sessions passed; a label's weight is what that sum gained between its two. Labels are read once and meet once, by symbol.
    """
    close = F.greatest("n", "touch") + 1
    marks = F.explode(F.array(*[F.struct(at.cast("long").alias("at"), F.lit(m).alias("m")) for at, m in ((F.col("n"), 1), (close, -1))]))
    rows = spans.select("symbol", "n", *keep, marks.alias("x")).select("symbol", "n", *keep, "x.*")
    w = Window.partitionBy("symbol").orderBy("at")
    upto = w.rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("open", F.sum("m").over(w.rangeBetween(Window.unboundedPreceding, -1))).withColumn("passed", F.col("at") - F.lag("at").over(w))
    rows = rows.withColumn("run", F.sum(F.coalesce(F.col("passed") / F.when(F.col("open") > 0, F.col("open")), F.lit(0.0))).over(upto))
    side = lambda c, m: F.max(F.when(F.col("m") == m, F.col(c)))
    return rows.groupBy("symbol", "n").agg(*[F.max(c).alias(c) for c in keep], ((side("run", -1) - side("run", 1)) / (side("at", -1) - side("at", 1))).alias("weight"))


def label_profile(labels: DataFrame, *by: str) -> DataFrame:
    """Shares of the barriers and of positive labels among the resolved ones."""
    known = labels.where("barrier is not null")
    return known.groupBy(*by).agg(
        F.count("*").alias("labels"), *[F.avg((F.col("barrier") == b).cast("double")).alias(f"{b}_share") for b in ("lower", "upper", "vertical")],
        F.avg(F.col("label").cast("double")).alias("positive_rate"),
    )


def walk_forward(sessions: DataFrame, train: int, test: int, horizon: int, embargo: int = 0, step: int | None = None) -> DataFrame:
    """``fold, ts, role`` (train or test) for ``ts``: each test block and the sessions before it less ``horizon + embargo`` of them.

    Only the table of sessions is numbered as a whole.
    """
    step = step or test
    if min(train, test) <= 0 or horizon + embargo >= train:
        raise ValueError("the training window must be longer than the purge and the embargo")
    rows = sessions.select("ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("ts")) - 1)
    last = rows.agg(F.count("*").alias("sessions"))
    folds = last.select(F.explode(F.when(F.col("sessions") >= train + test, F.sequence(F.lit(0), F.floor((F.col("sessions") - train - test) / step).cast("int")))).alias("fold"))
    begin = F.col("fold") * step
    role = F.when(F.col("i").between(begin, begin + train - horizon - embargo - 1), "train").when(F.col("i").between(begin + train, begin + train + test - 1), "test")
    return rows.join(F.broadcast(folds)).select("fold", "ts", role.alias("role")).where("role is not null")  # folds are fewer than sessions


def combinatorial(sessions: DataFrame, groups: int, tests: int, horizon: int, embargo: int = 0) -> DataFrame:
    """``split, ts, role`` for every choice of ``tests`` of the ``groups`` blocks of sessions; training keeps its distance on both sides of each."""
    rows = sessions.select("ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("ts")) - 1)
    rows = rows.join(F.broadcast(rows.agg(F.count("*").alias("sessions"))))
    bound = lambda g: F.floor(F.col("sessions") * g / groups)
    gap, made = horizon + embargo, []
    for k, chosen in enumerate(itertools.combinations(range(groups), tests)):
        inside, near = F.lit(False), F.lit(False)
        for g in chosen:
            inside = inside | ((F.col("i") >= bound(g)) & (F.col("i") < bound(g + 1)))
            near = near | ((F.col("i") >= bound(g) - gap) & (F.col("i") < bound(g + 1) + gap))
        made.append(F.struct(F.lit(k).alias("split"), F.when(inside, "test").when(~near, "train").alias("role")))
    return rows.select("ts", F.explode(F.array(*made)).alias("r")).select("r.split", "ts", "r.role").where("role is not null")


def tranches(selected: DataFrame, h: int) -> DataFrame:
    """``ts, symbol, weight`` of the book of the last ``h`` sessions' selections ``ts, symbol``, each sleeve an ``h``-th of it."""
    sessions = selected.select("ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("ts")))
    rows = selected.join(F.broadcast(sessions), "ts").withColumn("w", F.lit(1.0) / F.count("*").over(Window.partitionBy("ts")) / h)
    held = rows.select("symbol", "w", F.explode(F.sequence(F.col("i"), F.col("i") + (h - 1))).alias("i"))
    return held.groupBy("i", "symbol").agg(F.sum("w").alias("weight")).join(F.broadcast(sessions), "i").select("ts", "symbol", "weight")


def book_returns(book: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``ts, positions, turnover, gross``: what ``ts, symbol, weight`` earns by ``ts, symbol, next_return``; a missing return is 0.

    Turnover is half the change of weights since the session before.
    """
    earned = book.join(outcomes, ["ts", "symbol"], "left")
    sessions = book.select("ts").distinct().withColumn("next", F.lead("ts").over(Window.orderBy("ts")))
    now = earned.select("ts", "symbol", "weight", F.lit(0.0).alias("was"), (F.col("weight") * F.coalesce("next_return", F.lit(0.0))).alias("r"))
    then = book.join(F.broadcast(sessions), "ts").where("next is not null").select(F.col("next").alias("ts"), "symbol", F.lit(0.0).alias("weight"), F.col("weight").alias("was"), F.lit(0.0).alias("r"))
    both = now.unionByName(then).groupBy("ts", "symbol").agg(F.sum("weight").alias("weight"), F.sum("was").alias("was"), F.sum("r").alias("r"))
    return both.groupBy("ts").agg(F.count_if(F.col("weight") > 0).alias("positions"), (F.sum(F.abs(F.col("weight") - F.col("was"))) / 2).alias("turnover"), F.sum("r").alias("gross"))


def performance(returns: DataFrame, ret: str = "gross", by: tuple[str, ...] = ()) -> DataFrame:
    """Sessions, mean, annual Sharpe ratio, positions and turnover of a book; a ratio without spread is 0."""
    sd = F.stddev_samp(ret)
    return returns.groupBy(*by).agg(
        F.count("*").alias("sessions"), F.avg(ret).alias("mean_return"), F.coalesce(F.try_divide(F.avg(ret), sd) * math.sqrt(YEAR), F.lit(0.0)).alias("sharpe"),
        F.avg("positions").alias("avg_positions"), F.avg("turnover").alias("avg_turnover"),
    )


def selection_quality(scored: DataFrame, selected: str = "selected") -> DataFrame:
    """``base_rate, hit_rate, lift, brier, brier_delta`` and the spread of predictions of ``p, y`` (0 or 1), ``selected``."""
    base = scored.agg(F.avg("y").alias("base"))
    rows = scored.join(F.broadcast(base))
    delta = F.pow(F.col("p") - F.col("y"), 2) - F.pow(F.col("base") - F.col("y"), 2)
    hit = F.avg(F.when(F.col(selected), F.col("y")))
    return rows.agg(
        F.avg("y").alias("base_rate"), hit.alias("hit_rate"), F.try_divide(hit, F.avg("y")).alias("lift"), F.avg("p").alias("pred_mean"), F.stddev_pop("p").alias("pred_std"),
        F.percentile("p", F.lit(0.1)).alias("pred_p10"), F.percentile("p", F.lit(0.9)).alias("pred_p90"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"),
        F.avg(delta).alias("brier_delta"), (F.stddev_samp(delta) / F.sqrt(F.count("*"))).alias("brier_se"),
    )


def newey_west(rows: DataFrame, value: str, by: str, lags: int) -> DataFrame:
    """``by, n, mean, se, t`` of a series of each ``by`` ordered by ``ts``: Bartlett weights on ``lags`` autocovariances, none negative in sum."""
    mean = F.avg(value).over(Window.partitionBy(by))
    w = Window.partitionBy(by).orderBy("ts")
    rows = rows.where(F.col(value).isNotNull()).select(by, "ts", F.col(value).alias("v"), (F.col(value) - mean).alias("e"))
    rows = rows.select("*", *[(F.col("e") * F.lag("e", k).over(w)).alias(f"e{k}") for k in range(1, lags + 1)])
    total = F.sum(F.col("e") * F.col("e"))
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"e{k}"), F.lit(0.0))
    out = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), total.alias("s"))
    se = F.when((F.col("n") >= 2) & (F.col("s") > 0), F.sqrt(F.col("s")) / F.col("n")).otherwise(0.0)
    return out.select(by, "n", "mean", se.alias("se"), F.coalesce(F.try_divide(F.col("mean"), se), F.lit(0.0)).alias("t"))


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution by its series around 0 and, beyond 3, its continued fraction; 1e-10 near."""
    near = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("s"), x.alias("t")), lambda a, k: F.struct((a["s"] + a["t"] * x * x / (2 * k + 1)).alias("s"), (a["t"] * x * x / (2 * k + 1)).alias("t")))["s"]
    y = F.abs(x)
    far = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), y, lambda a, k: y + k / a)
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    return F.when(y < 3, 0.5 + near * density).when(x > 0, 1 - density / far).otherwise(density / far)


def expected_best(trials: int) -> float:
    """Expected largest of so many standard normal numbers, by the usual approximation."""
    from statistics import NormalDist

    if trials <= 1:
        return 0.0
    gamma, q = 0.5772156649015329, NormalDist().inv_cdf
    return (1 - gamma) * q(1 - 1 / trials) + gamma * q(1 - 1 / (trials * math.e))


def deflated_sharpe(returns: DataFrame, ret: str, by: str, trials: int = 1) -> DataFrame:
    """``by, n, sharpe, deflated``: probability that the true ratio exceeds what the best of ``trials`` would show by chance.

    0 for fewer than 8 returns or no spread. Moments are scaled by the sample deviation.
    """
    r, w = F.col(ret), Window.partitionBy(by)
    rows = returns.where(r.isNotNull()).select(by, r.alias("r"), F.avg(r).over(w).alias("m"), F.stddev_samp(r).over(w).alias("sd"))
    z = F.try_divide(F.col("r") - F.col("m"), F.col("sd"))
    out = rows.groupBy(by).agg(F.count("*").alias("n"), F.first(F.try_divide("m", "sd")).alias("sr"), F.avg(F.pow(z, 3)).alias("skew"), F.avg(F.pow(z, 4)).alias("kurt"))
    spread = 1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")
    score = (F.col("sr") - expected_best(trials) / F.sqrt(F.col("n") - 1)) * F.sqrt(F.col("n") - 1) / F.sqrt(F.when(spread > 0, spread))
    ok = (F.col("n") >= 8) & F.col("sr").isNotNull() & (spread > 0)
    return out.select(by, "n", F.coalesce("sr", F.lit(0.0)).alias("sharpe"), F.when(ok, normal_cdf(score)).otherwise(0.0).alias("deflated"))


def pair_correlations(rows: DataFrame, ret: str, least: int = 30) -> DataFrame:
    """``a, b, n, corr`` of the symbols ``a < b`` with more than ``least`` shared sessions. Sums by pair meet before a row of a pair leaves its session's task."""
    left, right = (rows.where(F.col(ret).isNotNull()).select("ts", F.col("symbol").alias(s), F.col(ret).alias(f"r{s}")) for s in "ab")
    both = left.join(right, "ts").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), correlation("ra", "rb").alias("corr"))
    return both.where(F.col("n") > least)


def effective_samples(rows: DataFrame, pairs: DataFrame, horizon: int) -> DataFrame:
    """How many independent rows a panel is worth: effective names by mean correlation, times sessions over the horizon."""
    size = rows.agg(F.count("*").alias("samples"), F.countDistinct("ts").alias("sessions"), F.countDistinct("symbol").alias("names"))
    rho = pairs.agg(F.coalesce(F.avg("corr"), F.lit(0.0)).alias("rho"))
    one = size.join(F.broadcast(rho))  # a row each
    names = F.col("names") / (1 + (F.col("names") - 1) * F.greatest(F.col("rho"), F.lit(0.0)))
    periods = F.col("sessions") / float(horizon)
    return one.select("samples", "sessions", "names", "rho", names.alias("effective_names"), periods.alias("periods"), (names * periods).alias("effective_samples"))
