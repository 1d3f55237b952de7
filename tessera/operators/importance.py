"""What a fixed predictor owes to each feature: values shuffled within sessions, nulls that noise sets, labels shuffled against real ones."""

from __future__ import annotations

from collections.abc import Mapping
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.panel import average_rank, correlation
from tessera.operators.research import evidence, forward_returns, session_ics

#: Families of features by concept, and by prefix of their names.
FAMILIES = {
    "momentum": ["return_1d", "return_5d", "return_20d", "momentum_6_1", "momentum_12_1"],
    "volatility": ["realized_vol_20", "downside_vol_20", "skew_60", "max_ret_1m", "atr_pct_14"],
    "liquidity": ["dollar_volume_20", "amihud_20", "volume_ratio", "obv_slope_20", "ad_slope_20"],
    "oscillators": ["rsi_14", "stoch_k_14", "stoch_d_14", "cci_20", "mfi_14", "bb_pct_b", "keltner_pos_20", "donchian_pos_20"],
    "trend": [
        "price_to_sma50", "dist_52w_high", "macd", "macd_signal", "macd_hist", "adx_14", "plus_di_14", "minus_di_14", "aroon_up_25", "aroon_down_25", "aroon_osc_25",
        "vwap_ratio_20",
    ],
}
PREFIXES = {"macro_": "macro_regime", "fund_": "fundamentals"}
#: Drops below this are none, and the error that the bar keeps over all features together.
LEAST_DROP, ALPHA = 1e-9, 0.05
#: Parts into which ranks cut values between one number and its double.
PARTS = 64


def families(names: list[str]) -> dict[str, list[str]]:
    """The families of FAMILIES and PREFIXES with two members or more among ``names``."""
    found = {group: [n for n in names if n in members] for group, members in FAMILIES.items()}
    for prefix, group in PREFIXES.items():
        found[group] = [n for n in names if n.startswith(prefix)]
    return {group: members for group, members in found.items() if len(members) > 1}


def sidak_bar(tests: int, alpha: float = ALPHA) -> float:
    """The two-sided \\|t\\| that the largest of so many independent tests exceeds with probability ``alpha``."""
    return NormalDist().inv_cdf(1 - (1 - (1 - alpha) ** (1 / max(1, tests))) / 2)


def lot(seed: int, *of: Column) -> Column:
    """A text that orders rows at random, the same in every run: an md5 digest of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in of]).cast("binary"))


def _session() -> Column:
    return F.unix_seconds(F.col("ts").cast("timestamp"))


def noise(rows: DataFrame, name: str, seed: int = 0) -> DataFrame:
    """Adds a column that carries nothing: each session's even grid over (0, 1) dealt out at random."""
    w = Window.partitionBy("ts")
    at = F.row_number().over(w.orderBy(lot(seed, F.lit(name), _session(), F.col("symbol")), "symbol"))
    return rows.withColumn(name, (at - 0.5) / F.count("*").over(w))


def shuffled(rows: DataFrame, blocks: Mapping[str, list[str]], repeats: int, seed: int = 7) -> DataFrame:
    """``rows`` once for each block of columns and repeat (``block, repeat``), the block's columns from another row of the session.

    One order a session, block and repeat moves all columns of the block together. Rows meet their partners by the place in two
    orders of their session, that of symbols and a random one: an equi-join keyed by session, block and repeat.
    """
    columns = sorted({c for members in blocks.values() for c in members})
    grid = [F.struct(F.lit(b).alias("block"), F.lit(r).alias("repeat")) for b in sorted(blocks) for r in range(1, repeats + 1)]
    placed = rows.withColumn("__i", F.row_number().over(Window.partitionBy("ts").orderBy("symbol")))
    each = placed.withColumn("__g", F.explode(F.array(*grid))).select("*", "__g.*").drop("__g")
    order = lot(seed, F.col("block"), F.col("repeat"), _session(), F.col("symbol"))
    j = F.row_number().over(Window.partitionBy("ts", "block", "repeat").orderBy(order, "symbol"))
    givers = each.select("ts", "block", "repeat", j.alias("__i"), *[F.col(c).alias(f"__{c}") for c in columns])
    met = each.join(givers, ["ts", "block", "repeat", "__i"])
    inside = {c: F.col("block").isin([b for b, members in blocks.items() if c in members]) for c in columns}
    return met.withColumns({c: F.when(inside[c], F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).drop("__i", *[f"__{c}" for c in columns])


def part_of(value: Column) -> Column:
    """A number that rises with ``value`` and takes PARTS values as it doubles: what it cuts a large group into before ranks are taken."""
    size = F.floor(PARTS * F.log2(F.abs(value)))
    return F.when(value > 0, size + 1_000_000).when(value < 0, -size - 1_000_000).otherwise(0).cast("long")


def aucs(scored: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """``by, auc`` with ties averaged; null where a class is missing.

    Rows are counted by distinct score, ranked within the parts of :func:`part_of`, and parts follow one another: no task orders a whole group.
    """
    counts = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, part_of(F.col(score)).alias("__part"), score).agg(F.count("*").alias("m"), F.sum(label).alias("pos"))
    before = F.sum("m").over(Window.partitionBy(*by, "__part").orderBy(score).rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    parts = counts.withColumn("rank", before + (F.col("m") + 1) / 2).groupBy(*by, "__part").agg(F.sum("m").alias("n"), F.sum("pos").alias("p"), F.sum(F.col("pos") * F.col("rank")).alias("s"))
    lower = F.sum("n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")  # a row for each part
    sums = parts.withColumn("s", F.col("s") + F.col("p") * lower).groupBy(*by).agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("s").alias("s"))
    neg = F.col("n") - F.col("p")
    return sums.select(*by, F.when((F.col("p") > 0) & (neg > 0), (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg)).alias("auc"))


def neighbours(rows: DataFrame, names: list[str], blocks: Mapping[str, list[str]]) -> DataFrame:
    """``block, max_abs_correlation, neighbour``: the feature outside each block with the largest rank correlation to one inside; 0 and null if none."""
    long = rows.select("ts", "symbol", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("x")) for n in names])).alias("f")).select("ts", "symbol", "f.*")
    long = long.withColumn("__part", part_of(F.col("x")))
    sizes = long.groupBy("feature", "__part").agg(F.count("*").alias("__n"))
    lower = sizes.select("feature", "__part", (F.sum("__n").over(Window.partitionBy("feature").orderBy("__part")) - F.col("__n")).alias("__lower"))
    ranks = long.join(F.broadcast(lower), ["feature", "__part"]).withColumn("rank", F.col("__lower") + average_rank("x", ["feature", "__part"]))  # a row for each part
    wide = ranks.groupBy("ts", "symbol").agg(*[F.max(F.when(F.col("feature") == n, F.col("rank"))).alias(n) for n in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    cell = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.nanvl(F.abs(correlation(a, b)), F.lit(0.0)), F.lit(0.0)).alias("c"))
    table = wide.agg(F.array(*[cell(a, b) for a, b in pairs]).alias("t")).select(F.explode("t").alias("t")).select("t.*")  # one row for each pair of features
    both = table.unionByName(table.select(F.col("b").alias("a"), F.col("a").alias("b"), "c"))
    inside = rows.sparkSession.createDataFrame([(b, m) for b, members in blocks.items() for m in members], "block string, a string")
    within = inside.select("block", F.col("a").alias("b"))
    outer = both.join(F.broadcast(inside), "a").join(F.broadcast(within), ["block", "b"], "left_anti").where("c > 0")
    best = outer.groupBy("block").agg(F.max("c").alias("max_abs_correlation"), F.max_by("b", F.struct(F.round("c", 12), F.col("b"))).alias("neighbour"))
    return inside.select("block").distinct().join(best, "block", "left").na.fill(0.0, ["max_abs_correlation"])


def importance(rows: DataFrame, names: list[str], score: Column, blocks: Mapping[str, list[str]], repeats: int = 3, seed: int = 7) -> DataFrame:
    """One row for each block: by how much the mean rank correlation of ``score`` with ``next_return``, and its AUC for ``y``, fall when the block is shuffled.

    ``rows`` are ``ts, symbol, next_return, y`` and the features ``names``, none null, of sessions that the score was not fitted to;
    sessions with fewer than three rows go, a session without spread counts as 0. All blocks and repeats are scored in one pass. Drops are paired: the mean,
    error and t are those of the differences session by session. ``bar`` is the \\|t\\| that the largest of all features exceeds by chance.
    """
    rows = rows.select("ts", "symbol", "next_return", "y", *names).withColumn("__m", F.count("*").over(Window.partitionBy("ts"))).where("__m >= 3").drop("__m")
    base = rows.withColumn("block", F.lit("")).withColumn("repeat", F.lit(0))
    every = base.unionByName(shuffled(rows, blocks, repeats, seed)).select("block", "repeat", "ts", "next_return", "y", score.alias("p"))
    keys = ["block", "repeat", "ts"]
    ranks = every.select(*keys, average_rank("p", keys).alias("a"), average_rank("next_return", keys).alias("b"))
    ic = F.coalesce(F.nanvl(correlation("a", "b"), F.lit(0.0)), F.lit(0.0))
    series = ranks.groupBy(*keys).agg(ic.alias("ic")).groupBy("block", "ts").agg(F.avg("ic").alias("ic"))
    of_base = F.max(F.when(F.col("block") == "", F.col("ic"))).over(Window.partitionBy("ts"))
    drop = series.withColumn("d", of_base - F.col("ic")).where("block <> ''")
    out = drop.groupBy("block").agg(F.count("*").alias("sessions"), F.avg("d").alias("mean"), F.coalesce(F.stddev_samp("d") / F.sqrt(F.count("*")), F.lit(0.0)).alias("se"))
    none = F.abs("mean") < LEAST_DROP
    out = out.select("block", "sessions", F.when(none, 0.0).otherwise(F.col("mean")).alias("ic_drop"), F.when(none, 0.0).otherwise(F.col("se")).alias("se"))
    out = out.withColumn("t", F.coalesce(F.try_divide("ic_drop", "se"), F.lit(0.0)))
    areas = aucs(every, ["block", "repeat"], "p", "y").groupBy("block").agg(F.avg("auc").alias("auc"))
    of_base = F.max(F.when(F.col("block") == "", F.col("auc"))).over(Window.partitionBy(F.lit(0)))  # a row for each block
    areas = areas.withColumn("auc_drop", of_base - F.col("auc")).where("block <> ''").drop("auc")
    tests = sum(len(members) == 1 for members in blocks.values())
    told = out.join(areas, "block").join(neighbours(rows, names, blocks), "block")
    return told.withColumn("bar", F.lit(sidak_bar(tests))).withColumn("above", F.col("t") > F.col("bar"))


def derangements(symbols: DataFrame, replicates: int, seed: int = 17) -> DataFrame:
    """``replicate, symbol, mapped``: in each replicate every symbol gets another one, all of them once; alone, it keeps itself.

    Symbols in a random order of the replicate get the next one, the last the first: never their own.
    """
    each = symbols.select("symbol").distinct().withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    w = Window.partitionBy("replicate").orderBy(lot(seed, F.col("replicate"), F.col("symbol")), "symbol")  # a row for each symbol
    first = F.first("symbol").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return each.select("replicate", "symbol", F.coalesce(F.lead("symbol").over(w), first).alias("mapped"))


def permutation_null(vectors: DataFrame, bars: DataFrame, names: list[str], horizons: list[int], replicates: int = 3, least: int = 30, seed: int = 17) -> DataFrame:
    """``feature, horizon, n, ic_mean, ic_t, null_t, clears``: the evidence of each feature, and the largest \\|t\\| that any gets with another name's features.

    A name keeps its returns and gets the features of the name that it is mapped to, on the same session; sessions which that one
    lacks are left out, replicates with fewer than ``least`` rows too. All replicates, features and horizons are one plan.
    """
    forward = forward_returns(bars, horizons, [0]).drop("delay")
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("x")) for n in names])

    def table(rows: DataFrame, by: list[str]) -> DataFrame:
        long = rows.join(forward, ["symbol", "ts"]).select(*by, "ts", "horizon", "forward", F.explode(cells).alias("f")).select(*by, "ts", "horizon", "forward", "f.*")
        keys = [*by, "feature", "horizon"]
        return evidence(session_ics(long, keys, "x", "forward"), keys, "horizon", max(horizons))

    vectors = vectors.select("symbol", "ts", *names)
    mapping = derangements(vectors, replicates, seed)
    moved = vectors.withColumnRenamed("symbol", "mapped").join(mapping, "mapped").drop("mapped")
    enough = moved.groupBy("replicate").agg(F.count("*").alias("rows")).where(F.col("rows") >= least).select("replicate")
    worst = table(moved.join(F.broadcast(enough), "replicate"), ["replicate"]).agg(F.coalesce(F.max(F.abs("ic_t")), F.lit(0.0)).alias("null_t"))
    return table(vectors, []).join(F.broadcast(worst)).withColumn("clears", F.abs("ic_t") > F.col("null_t"))  # one row


def label_shuffles(rows: DataFrame, real: int, controls: int, seed: int = 5) -> DataFrame:
    """``kind, run`` and ``rows`` once for each: ``real`` with their labels ``y``, ``control`` with those of another row of the session."""
    grid = [F.struct(F.lit("real").alias("kind"), F.lit(r).alias("run")) for r in range(1, real + 1)] + [F.struct(F.lit("control").alias("kind"), F.lit(r).alias("run")) for r in range(1, controls + 1)]
    placed = rows.withColumn("__i", F.row_number().over(Window.partitionBy("ts").orderBy("symbol")))
    each = placed.withColumn("__g", F.explode(F.array(*grid))).select("*", "__g.*").drop("__g")
    keys = ["ts", "kind", "run"]
    j = F.row_number().over(Window.partitionBy(*keys).orderBy(lot(seed, F.col("run"), _session(), F.col("symbol")), "symbol"))
    at = F.when(F.col("kind") == "real", F.col("__i")).otherwise(j)
    return each.drop("y").join(each.select(*keys, at.alias("__i"), "y"), [*keys, "__i"]).drop("__i")


def scorecards(runs: DataFrame, names: list[str], bins: int, left_out: float = 0.1, seed: int = 5) -> DataFrame:
    """``kind, run, auc``: how well a scorecard fits the labels that it was made from, in sample.

    A run leaves out a random share of the rows, takes the mean label of each of ``bins`` equal parts of each feature in [0, 1], and scores
    all rows by the sum, in whole billionths so that the order of adding leaves no trace. All runs are fitted by one aggregate and scored by one pass.
    """
    keys = ["kind", "run"]
    part = lambda n: F.least(F.lit(bins - 1), F.floor(F.col(n) * bins)).cast("int")
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), part(n).alias("bin")) for n in names])
    share = F.conv(F.substring(lot(seed, F.col("kind"), F.col("run"), _session(), F.col("symbol")), 1, 7), 16, 10).cast("long") / float(1 << 28)
    fitted = runs.where(share >= left_out).select(*keys, "y", F.explode(cells).alias("c")).groupBy(*keys, "c").agg(F.avg("y").alias("rate"))
    long = runs.select(*keys, "ts", "symbol", "y", F.explode(cells).alias("c"))
    known = long.join(F.broadcast(fitted), [*keys, "c"], "left")  # runs times features times bins
    scored = known.groupBy(*keys, "ts", "symbol").agg(F.sum(F.round(F.col("rate") * 1e9).cast("long")).alias("p"), F.max("y").alias("y"))
    return aucs(scored, keys, "p", "y")


def capacity(areas: DataFrame, gap: float = 0.05) -> DataFrame:
    """One row of ``kind, run, auc``: means of real and control runs, their gap, the margin of the worst real over the best control, and the verdict."""
    real, control = (F.when(F.col("kind") == k, F.col("auc")) for k in ("real", "control"))
    out = areas.agg(F.avg(real).alias("auc_real"), F.avg(control).alias("auc_control"), (F.min(real) - F.max(control)).alias("margin"))
    out = out.select("*", (F.col("auc_real") - F.col("auc_control")).alias("gap"), (F.col("margin") > 0).alias("separated"))
    return out.withColumn("verdict", F.when((F.col("gap") >= gap) & F.col("separated"), "structure").when(F.col("gap") >= gap, "inconclusive").otherwise("none"))
