"""Fitting classifiers to folds: purged validation tails, seed ensembles, sweeps whose results are rows of a store."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import gates

#: Partitions that rows to fit are dealt to by session: the draws of a seed follow the rows' places, so these must not depend on the plan.
PARTITIONS = 16
#: Sessions that a window needs for fitting besides its validation tail and gap.
LEAST_FIT = 20
Model = Callable[[DataFrame], DataFrame]


def windows(folds: DataFrame, val_size: int, gap: int) -> DataFrame:
    """``fold, ts, role`` of ``fold, ts, role`` (train or test), where train becomes ``fit``, the last ``val_size`` sessions ``val``, and the ``gap`` between them goes.

    A fold whose training window leaves fewer than LEAST_FIT sessions to fit has no row at all. A fold has a row for each of its sessions.
    """
    w = Window.partitionBy("fold")
    rows = folds.withColumn("__k", F.row_number().over(Window.partitionBy("fold", "role").orderBy(F.desc("ts"))))
    rows = rows.withColumn("__m", F.count_if(F.col("role") == "train").over(w)).where(F.col("__m") >= val_size + gap + LEAST_FIT)
    role = F.when(F.col("role") == "test", "test").when(F.col("__k") <= val_size, "val").when(F.col("__k") > val_size + gap, "fit")
    return rows.withColumn("role", role).where("role is not null").drop("__k", "__m")


def described(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """``fold, role, sessions, rows, positive_rate, effective_rows, first, last`` of ``ts, y, weight``."""
    return rows.join(F.broadcast(windows), "ts").groupBy("fold", "role").agg(
        F.countDistinct("ts").alias("sessions"), F.count("*").alias("rows"), F.avg("y").alias("positive_rate"), F.sum("weight").alias("effective_rows"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )


def boosted(rows: DataFrame, names: list[str], seed: int, trees: int = 20, depth: int = 3, rate: float = 0.1) -> Model:
    """Trees fitted to the rows of role ``fit`` by ``weight``, stopped by those of role ``val``; gives a function that adds ``p``, the probability of 1."""
    assembled = VectorAssembler(inputCols=names, outputCol="__x")
    data = assembled.transform(rows.select("y", "weight", (F.col("role") == "val").alias("__val"), *names).withColumn("y", F.col("y").cast("double")))
    model = GBTClassifier(featuresCol="__x", labelCol="y", weightCol="weight", predictionCol="__said", validationIndicatorCol="__val", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, seed=seed)
    made = model.setProbabilityCol("__p").setRawPredictionCol("__raw").fit(data)
    return lambda df: made.transform(assembled.transform(df)).withColumn("p", vector_to_array("__p")[1]).drop("__x", "__p", "__raw", "__said")


def fit_fold(rows: DataFrame, windows: DataFrame, fold: int, names: list[str], seeds: int = 1, base_seed: int = 0, fit: Callable[..., Model] = boosted) -> list[Model] | None:
    """One model a seed, fitted to the ``fit`` and ``val`` rows of the fold alone; None where the fold has no window or its rows to fit have one class."""
    own = rows.join(F.broadcast(windows.where((F.col("fold") == fold) & F.col("role").isin("fit", "val")).select("ts", "role")), "ts")
    classes = own.groupBy("role").agg(F.countDistinct("y").alias("k")).collect()  # two rows
    known = {r["role"]: r["k"] for r in classes}
    if known.get("fit", 0) < 2 or not known.get("val"):
        return None
    own = own.repartition(PARTITIONS, "ts").sortWithinPartitions("ts", "symbol")
    return [fit(own, names, base_seed + i) for i in range(max(1, seeds))]


def ensemble(rows: DataFrame, models: list[Model], keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """``rows`` with ``p``, the mean of the models' probabilities, and ``disagreement``, their population deviation; each model adds a column, nothing moves."""
    out = rows
    for i, model in enumerate(models):
        out = model(out).withColumnRenamed("p", f"__p{i}")
    each = F.array(*[F.col(f"__p{i}") for i in range(len(models))])
    mean = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / len(models)
    out = out.withColumn("p", mean)
    spread = F.sqrt(F.aggregate(each, F.lit(0.0), lambda a, x: a + (x - F.col("p")) * (x - F.col("p"))) / len(models))
    return out.withColumn("disagreement", spread).drop(*[f"__p{i}" for i in range(len(models))])


def score_fold(rows: DataFrame, windows: DataFrame, fold: int, models: list[Model]) -> DataFrame:
    """The test rows of a fold with ``fold, p, disagreement``."""
    test = rows.join(F.broadcast(windows.where((F.col("fold") == fold) & (F.col("role") == "test")).select("ts")), "ts")
    return ensemble(test, models).withColumn("fold", F.lit(fold))


def done(spark: SparkSession, store: str) -> set[tuple[str, int]]:
    """The candidates and folds that ``store`` has whole; a row each."""
    try:
        return {(r["candidate"], r["fold"]) for r in spark.read.parquet(store).select("candidate", "fold").collect()}
    except Exception as missing:  # noqa: BLE001 - nothing is stored yet
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
            return set()
        raise


def sweep(spark: SparkSession, rows: DataFrame, windows: DataFrame, names: list[str], candidates: Mapping[str, Callable[..., Model]], store: str, newest: int = 4, at_once: int = 2, seeds: int = 1) -> DataFrame:
    """Fits and scores every candidate on the ``newest`` folds, ``at_once`` side by side, one row of metrics each in ``store``; those that are there are not fitted again.

    Gives the candidates pooled by sections (:func:`tessera.operators.gates.pooled`). A folder appears when its row is whole, so a sweep that was killed goes on.
    """
    folds = [r["fold"] for r in windows.select("fold").distinct().orderBy(F.desc("fold")).limit(newest).collect()]
    had = done(spark, store)
    todo = [(name, fold) for name in sorted(candidates) for fold in sorted(folds) if (name, fold) not in had]

    def one(job: tuple[str, int]) -> None:
        name, fold = job
        models = fit_fold(rows, windows, fold, names, seeds, fit=candidates[name])
        if models is None:
            return
        scored = score_fold(rows, windows, fold, models).select("symbol", "ts", "p", "next_return").persist()  # the metrics read it several times
        row = gates.relative_metrics(gates.session_metrics(scored, "p", "next_return")).select("sections", "ic_mean", "ic_std", "sharpe_net")
        row.coalesce(1).write.mode("overwrite").parquet(f"{store}/candidate={name}/fold={fold}")
        scored.unpersist()

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(one, todo))
    kept = spark.read.parquet(store).where(F.col("candidate").cast("string").isin(list(candidates)) & F.col("fold").isin(folds))
    return gates.pooled(kept, "candidate")


def winner(pooled: DataFrame) -> str | None:
    """The candidate with the largest t of its rank correlation, if that is positive; ties to the smaller name."""
    best = pooled.where("ic_t > 0").orderBy(F.desc("ic_t"), "candidate").limit(1).collect()
    return best[0]["candidate"] if best else None
