"""Quality rules: text statistics and robust multivariate outliers, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, let, spread_join, stored, text_or_empty

WINDOW = 8
MIN_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
#: Share of a group's rows that the determinant is minimised over; concentration steps from every start, and at most
#: so many more from the best one, which end when no determinant falls by a thousandth.
SUBSET = 0.75
STEPS = 2
MORE_STEPS = 8
#: Rows a group needs for an estimate of its own; smaller groups are estimated together.
MIN_GROUP = 100
#: Outliers that are expected in a whole table of normal rows: the level of the test over all of its rows.
LEVEL = 0.01
#: The minimum covariance determinant needs more rows than twice the features; the median of chi-squared
#: with 5 degrees of freedom; what makes an absolute deviation a standard one.
LEAST_ROWS = 10
MEDIAN_CHI2_5 = 4.351
DEVIATION = 1.4826

FEATURES = ("f0", "f1", "f2", "f3", "f4")
#: Least standard deviation of each transformed statistic, added to the covariance as a ridge: most texts have no
#: symbol, no repeated line at all, and without it their determinant is 0.
FLOORS = (0.5, 0.06, 0.25, 0.5, 0.5)
EXACT = 10_000  # accuracy of percentiles


def _mixed(a: Column, step: int) -> Column:
    """Hash of each entry with the one ``step`` further on; the last ones meet null."""
    return F.zip_with(a, F.slice(a, step + 1, F.greatest(F.size(a), F.lit(1))), lambda x, y: F.xxhash64(x, y))


def _covered(h: Column) -> Column:
    """Positions that windows cover whose hash in ``h`` occurs twice or more."""

    def count(s: Column) -> Column:
        same = lambda k, e: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
        at = F.sort_array(F.filter(F.transform(s, lambda e, k: F.when(same(k - 1, e) | same(k + 1, e), e["i"])), lambda i: i.isNotNull()))
        gaps = lambda p: F.transform(p, lambda i, k: F.least(F.lit(WINDOW), i - F.coalesce(F.get(p, k - 1), F.lit(-WINDOW))))
        return F.aggregate(let(at, gaps), F.lit(0), lambda total, g: total + g)

    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(pairs, count))


def repeated_words(words: Column) -> Column:
    """Words inside 8-word windows that are found twice or more in the text; windows are compared by 64-bit hashes."""
    one = F.transform(words, lambda w: F.xxhash64(w))
    eight = let(let(let(one, lambda a: _mixed(a, 1)), lambda a: _mixed(a, 2)), lambda a: _mixed(a, 4))
    windows = let(eight, lambda a: F.slice(a, 1, F.size(a) - (WINDOW - 1)))
    return F.when(F.size(words) < WINDOW, 0).otherwise(let(windows, _covered)).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed``.

    A null text has no words. Lines are split at ``\\n`` and count if they hold a word.
    """
    rows = docs.select("doc_id", "lang", "source", text_or_empty().alias("text"))
    rows = rows.select(
        "doc_id", "lang", "source",
        F.array_remove(F.split("text", f"{SPACE}+"), "").alias("words"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    rows = rows.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def features() -> list[Column]:
    """Logarithms of length, mean word length, and of the shares of symbols, repeated lines and repeated words."""
    per = lambda n, of: n / F.greatest(F.col(of), F.lit(1))
    return [
        F.log1p("n_words").alias("f0"),
        F.log(per(F.greatest(F.col("word_chars"), F.lit(1)), "n_words")).alias("f1"),
        F.log1p(100 * per(F.col("n_symbols"), "word_chars")).alias("f2"),
        F.log1p(20 * per(F.col("n_dup_lines"), "n_lines")).alias("f3"),
        F.log1p(20 * per(F.col("n_repeat_words"), "n_words")).alias("f4"),
    ]


def _distance() -> Column:
    """Squared Mahalanobis distance from the centre ``m*``: forward substitution with the Cholesky factor ``l*``."""
    total, z = F.lit(0.0), []
    for i, f in enumerate(FEATURES):
        v = F.col(f) - F.col(f"m{i}")
        for k in range(i):
            v = v - F.col(f"l{i}{k}") * z[k]
        z.append(v / F.col(f"l{i}{i}"))
        total = total + z[i] * z[i]
    return total


def _factored(moments: DataFrame, keys: list[str]) -> DataFrame:
    """``m*``, the Cholesky factor ``l*`` of the covariance with its ridge, and the logarithm of its determinant from ``m*`` and ``c*``."""
    n = len(FEATURES)
    for i in range(n):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (F.lit(FLOORS[i] ** 2) if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            moments = moments.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    det = F.lit(0.0)
    for i in range(n):
        det = det + 2 * F.log(f"l{i}{i}")
    return moments.select(*keys, *[f"m{i}" for i in range(n)], *[f"l{i}{j}" for i in range(n) for j in range(i + 1)], det.alias("det"))


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]


def _starts(rows: DataFrame) -> DataFrame:
    """``group, start`` with three first estimates: medians with absolute deviations alone, with the correlations of
    squashed z-scores, and with those of spatial signs."""
    n = len(FEATURES)
    middle = rows.groupBy("group").agg(*[F.percentile_approx(f, 0.5, EXACT).alias(f"m{i}") for i, f in enumerate(FEATURES)])
    middle = stored(middle, "medians")
    off = spread_join(rows, middle, ["group"]).groupBy("group").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(n)],
        *[F.sqrt(F.pow(DEVIATION * F.percentile_approx(F.abs(F.col(f) - F.col(f"m{i}")), 0.5, EXACT), 2) + FLOORS[i] ** 2).alias(f"s{i}") for i, f in enumerate(FEATURES)],
    )
    off = stored(off, "deviations")
    z = [(F.col(f) - F.col(f"m{i}")) / F.col(f"s{i}") for i, f in enumerate(FEATURES)]
    length = F.lit(1e-12)
    for x in z:
        length = length + x * x
    squashed = [F.tanh(x).alias(f"t{i}") for i, x in enumerate(z)]
    signs = [(x / F.sqrt(length)).alias(f"u{i}") for i, x in enumerate(z)]
    made = spread_join(rows, off, ["group"]).select("group", *squashed, *signs)
    zero = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    made = made.groupBy("group").agg(
        *[zero(F.covar_pop(f"t{i}", f"t{j}")).alias(f"t{i}{j}") for i, j in _pairs()], *[F.avg(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"u{i}{j}") for i, j in _pairs()]
    )
    made = off.join(made, "group")
    moments = lambda c: F.struct(*[c(i, j).alias(f"c{i}{j}") for i, j in _pairs()])
    size = lambda i, j: F.col(f"s{i}") * F.col(f"s{j}")
    three = F.array(
        moments(lambda i, j: size(i, j) if i == j else F.lit(0.0)), moments(lambda i, j: size(i, j) * F.col(f"t{i}{j}")), moments(lambda i, j: size(i, j) * F.col(f"u{i}{j}"))
    )
    made = made.select("group", *[f"m{i}" for i in range(n)], F.posexplode(three).alias("start", "c"))
    return _factored(made.select("group", "start", *[f"m{i}" for i in range(n)], "c.*"), ["group", "start"])


def _concentrated(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One step: mean and covariance of the SUBSET of each group's rows that are nearest by the estimate before."""
    keys = ["group", "start"]
    at = spread_join(rows, found, keys).select(*keys, *FEATURES, _distance().alias("d"))
    cuts = stored(at.groupBy(*keys).agg(F.percentile_approx("d", SUBSET, EXACT).alias("cut")), "cuts")
    near = spread_join(at, cuts, keys).where(F.col("d") <= F.col("cut"))
    aggs = [F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)]
    aggs += [F.coalesce(F.covar_pop(FEATURES[i], FEATURES[j]), F.lit(0.0)).alias(f"c{i}{j}") for i, j in _pairs()]
    return stored(_factored(near.groupBy(*keys).agg(*aggs), keys), "mcd")


def covariances(rows: DataFrame) -> DataFrame:
    """``group`` with centre ``m*``, Cholesky factor ``l*`` and ``det`` of the least determinant found, for ``group, f*``.

    Deterministic minimum covariance determinant: STEPS concentration steps from each of three starts, the start with
    the smallest determinant in a group goes on until no group's determinant falls any more.
    """
    found = stored(_starts(rows), "starts")
    each = rows.withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    for _ in range(STEPS):
        found = _concentrated(each, found)
    best = found.groupBy("group").agg(F.min_by(F.struct(*[c for c in found.columns if c != "group"]), F.struct("det", "start")).alias("b"))
    found = stored(best.select("group", "b.*").withColumn("start", F.lit(0)), "best")
    one = rows.withColumn("start", F.lit(0))
    for _ in range(MORE_STEPS):
        after = _concentrated(one, found)
        both = found.select("group", F.col("det").alias("d0")).join(after.select("group", F.col("det").alias("d1")), "group")
        fell = both.agg(F.max(F.col("d0") - F.col("d1"))).first()[0]
        found = after
        if fell is None or fell < 1e-3:
            break
    return found.drop("start")


def chi2_5_above(chance: Column) -> Column:
    """What a chi-squared variable with 5 degrees of freedom exceeds with a small ``chance``: its tail's leading terms, inverted by iteration."""
    tail = lambda x: F.sqrt(2 * x / math.pi) * (1 + x / 3) + F.sqrt(2 / (math.pi * x))
    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.lit(30.0), lambda x, _: 2 * (F.log(tail(x)) - F.log(chance)))


def outliers(stats: DataFrame) -> DataFrame:
    """``doc_id, distance, cutoff`` of the rows of :func:`statistics` that pass the base rules.

    ``distance`` is the squared robust distance within language and source, by :func:`covariances`, scaled down to the
    median of chi-squared where it is above. ``cutoff`` is what chi-squared exceeds with probability LEVEL in any of the table's
    rows (Bonferroni), so it follows from the number of rows alone. Groups under MIN_GROUP rows are taken together; if
    these are too few as well, they are judged by the estimate over all rows. The determinant is not defined up to
    LEAST_ROWS rows in all: no row. Groups' parameters stay in tables, which rows meet by :func:`spread_join`; rows
    are never gathered.
    """
    rows = stats.where(~F.col("base_failed")).select("doc_id", F.to_json(F.struct("lang", "source")).alias("group"), *features())
    counts = rows.groupBy("group").agg(F.count("*").alias("n"))
    rare = F.col("n") < MIN_GROUP
    sizes = counts.agg(F.sum(F.when(rare, F.col("n"))).alias("m"), F.sum("n").alias("total"))
    into = lambda group, judged: F.struct(group.alias("group"), F.lit(judged).alias("judged"))
    own, pool, lent = into(F.col("group"), True), into(F.lit(""), True), into(F.lit(""), False)
    few = F.col("m") < MIN_GROUP  # null without rare groups
    to = F.when(rare, F.array(pool)).when(few, F.array(own, lent)).otherwise(F.array(own))
    counts = counts.join(F.broadcast(sizes)).where(F.col("total") > LEAST_ROWS)  # one row
    counts = stored(counts.select(F.col("group").alias("of"), to.alias("to"), chi2_5_above(LEVEL / F.col("total")).alias("cutoff")), "groups")
    rows = spread_join(rows.withColumnRenamed("group", "of"), counts, ["of"])
    rows = stored(rows.drop("of").withColumn("to", F.explode("to")).select("*", "to.*").drop("to"), "features")

    at = spread_join(rows, covariances(rows), ["group"]).select("doc_id", "group", "judged", "cutoff", _distance().alias("d"))
    at = stored(at, "distances")
    scale = stored(at.groupBy("group").agg((F.percentile_approx("d", 0.5, EXACT) / MEDIAN_CHI2_5).alias("scale")), "scales")
    return spread_join(at.where("judged"), scale, ["group"]).select("doc_id", (F.col("d") / F.greatest("scale", F.lit(1.0))).alias("distance"), "cutoff")


def verdicts(docs: DataFrame) -> DataFrame:
    """The statistics of every document with ``distance``, ``cutoff`` and ``kept``: base rules passed and not an outlier.

    Without documents, no rows. A repeated doc_id gives a row each; its rows share the distance that is furthest
    beyond its cutoff. A null doc_id is left out. Null language and source are values of their own.
    """
    stats = stored(statistics(docs.where(F.col("doc_id").isNotNull())), "statistics")
    far = outliers(stats).groupBy("doc_id").agg(F.max_by(F.struct("distance", "cutoff"), F.col("distance") / F.col("cutoff")).alias("x")).select("doc_id", "x.*")
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= F.col("cutoff"), F.lit(True))
    return stats.join(far, "doc_id", "left").withColumn("kept", kept)
