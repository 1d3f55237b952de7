"""Importance, nulls, folds, sweeps, paths, outcomes and syncs: what shuffling keeps, no leakage, resumed runs, replays."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import fitting, outcomes, paths, study, sync
from tessera.operators import importance as imp
from tessera.sources import payloads

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def panel(spark, sessions=30, names=12, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(sessions):
        for s in range(names):
            x, z = float(rng.random()), float(rng.random())
            gain = x - 0.5 + float(rng.normal(0, 0.2))
            rows.append((f"S{s:02d}", DAY + dt.timedelta(days=d), x, x * 0.9 + 0.1 * z, z, gain, int(gain > 0), 1.0))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, x double, twin double, z double, next_return double, y int, weight double")


def test_shuffling_moves_blocks_within_sessions(spark):
    rows = panel(spark, 5, 6)
    blocks = {"x": ["x"], "both": ["x", "twin"]}
    got = imp.shuffled(rows, blocks, 2).collect()
    of = {}
    for r in rows.collect():
        of.setdefault(r["ts"], {})[r["symbol"]] = r
    assert len(got) == 4 * rows.count()
    for block, repeat, ts in {(r["block"], r["repeat"], r["ts"]) for r in got}:
        mine = {r["symbol"]: r for r in got if (r["block"], r["repeat"], r["ts"]) == (block, repeat, ts)}
        assert sorted(r["x"] for r in mine.values()) == sorted(r["x"] for r in of[ts].values())
        pairs = {(r["x"], r["twin"]) for r in of[ts].values()}
        assert all((r["x"], r["twin"]) in pairs for r in mine.values()) == (block == "both") or block == "x"
        assert all(r["twin"] == of[ts][s]["twin"] for s, r in mine.items()) or block == "both"
        assert all((r["z"], r["next_return"]) == (of[ts][s]["z"], of[ts][s]["next_return"]) for s, r in mine.items())
    orders = {tuple(r["x"] for r in sorted((g for g in got if (g["block"], g["repeat"], g["ts"]) == k), key=lambda g: g["symbol"])) for k in {(g["block"], g["repeat"], g["ts"]) for g in got}}
    assert len(orders) > 15  # repeats and blocks have orders of their own


def test_importance_finds_what_the_score_uses(spark):
    rows = imp.noise(panel(spark, 40), "noise")
    blocks = {n: [n] for n in ("x", "z", "noise")} | {"pair": ["x", "twin"]}
    got = {r["block"]: r for r in imp.importance(rows, ["x", "twin", "z", "noise"], F.col("x") + 0.01 * F.col("noise"), blocks).collect()}
    assert got["x"]["above"] and got["x"]["ic_drop"] > 0.5 and got["x"]["auc_drop"] > 0.3 and got["x"]["neighbour"] == "twin" and got["x"]["max_abs_correlation"] > 0.9
    assert (got["z"]["ic_drop"], got["z"]["t"]) == (0.0, 0.0) and not got["noise"]["above"]
    assert got["pair"]["neighbour"] in ("z", "noise") and got["pair"]["max_abs_correlation"] < 0.3
    assert got["x"]["bar"] == pytest.approx(imp.sidak_bar(3)) and 2.3 < imp.sidak_bar(3) < 2.5


def test_aucs_meet_ties_signs_and_sizes(spark):
    rng = np.random.default_rng(3)
    rows = [("g" if i % 3 else "h", float(v), int(rng.random() < 0.4)) for i, v in enumerate([*rng.integers(-3, 4, 300), *(rng.normal(size=60) * 1e6), *(rng.normal(size=60) * 1e-6)])]
    got = {r["g"]: r["auc"] for r in imp.aucs(spark.createDataFrame(rows, "g string, p double, y int"), ["g"], "p", "y").collect()}
    for g in "gh":
        pos, neg = ([p for k, p, y in rows if k == g and y == c] for c in (1, 0))
        assert got[g] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)) / len(pos) / len(neg))


def test_no_symbol_keeps_its_own_features(spark):
    for n in (2, 3, 25):
        got = imp.derangements(spark.range(n).selectExpr("concat('S', id) as symbol"), 4).collect()
        for k in range(1, 5):
            mine = {r["symbol"]: r["mapped"] for r in got if r["replicate"] == k}
            assert len(mine) == n and set(mine.values()) == set(mine) and all(a != b for a, b in mine.items())
    assert [r["mapped"] for r in imp.derangements(spark.createDataFrame([("A",)], "symbol string"), 1).collect()] == ["A"]


def test_capacity_tells_structure_from_none(spark):
    real = panel(spark, 40)
    empty = real.withColumn("y", (F.xxhash64("symbol", "ts") % 2 == 0).cast("int"))
    got = [imp.capacity(imp.scorecards(imp.label_shuffles(r.select("symbol", "ts", "y", "x", "z"), 2, 3), ["x", "z"], 8)).first() for r in (real, empty)]
    assert got[0]["verdict"] == "structure" and got[0]["separated"] and got[1]["verdict"] != "structure"


def table(spark):
    rows = panel(spark, 120, 10, 5)
    return rows, fitting.windows(study.walk_forward(rows, 60, 20, 3, 1), 10, 4)


def test_a_model_sees_nothing_but_its_window(spark):
    rows, windows = table(spark)
    seen = {r["role"]: r for r in fitting.described(rows, windows.where("fold = 1")).collect()}
    assert seen["fit"]["last"] + dt.timedelta(days=5) == seen["val"]["first"] and seen["val"]["last"] + dt.timedelta(days=5) == seen["test"]["first"]
    scored = [r["p"] for r in fitting.score_fold(rows, windows, 1, fitting.fit_fold(rows, windows, 1, ["x", "z"], 1)).orderBy("ts", "symbol").collect()]
    own = windows.where("fold = 1 and role in ('fit', 'val')").select("ts", F.lit(True).alias("own"))
    other = rows.join(own, "ts", "left").withColumn("y", F.when(F.col("own"), F.col("y")).otherwise(1 - F.col("y"))).drop("own")
    again = [r["p"] for r in fitting.score_fold(other, windows, 1, fitting.fit_fold(other, windows, 1, ["x", "z"], 1)).orderBy("ts", "symbol").collect()]
    assert scored == again and len(scored) == 200


def test_seeds_are_averaged(spark):
    rows, windows = table(spark)
    models = fitting.fit_fold(rows, windows, 0, ["x", "z"], 3)
    got = fitting.score_fold(rows, windows, 0, models)
    one = got.orderBy("ts", "symbol").limit(5)
    each = [[r["p"] for r in m(one.drop("p")).orderBy("ts", "symbol").collect()] for m in models]
    for k, r in enumerate(one.collect()):
        ps = [e[k] for e in each]
        assert r["p"] == pytest.approx(np.mean(ps)) and r["disagreement"] == pytest.approx(np.std(ps))
    aucs = imp.aucs(got.withColumn("g", F.lit(0)), ["g"], "p", "y").first()["auc"]
    assert aucs > 0.7
    assert fitting.fit_fold(rows.withColumn("y", F.lit(1)), windows, 0, ["x", "z"]) is None


def test_a_killed_sweep_goes_on(spark, tmp_path):
    rows, windows = table(spark)
    calls = []

    def candidate(name, column, dies=False):
        def fit(own, names, seed):
            calls.append(name)
            if dies and calls.count(name) > 1:
                raise RuntimeError("killed")
            return lambda df: df.withColumn("p", F.col(column))

        return fit

    with pytest.raises(RuntimeError):
        fitting.sweep(spark, rows, windows, ["x", "z"], {"good": candidate("good", "x"), "poor": candidate("poor", "z", True)}, f"{tmp_path}/s", 2, 1)
    before = fitting.done(spark, f"{tmp_path}/s")
    assert len(before) == 3
    calls.clear()
    pooled = fitting.sweep(spark, rows, windows, ["x", "z"], {"good": candidate("good", "x"), "poor": candidate("poor", "z")}, f"{tmp_path}/s", 2, 2)
    assert calls == ["poor"] and {r["candidate"]: r["folds"] for r in pooled.collect()} == {"good": 2, "poor": 2}
    assert fitting.winner(pooled) == "good" and fitting.winner(pooled.withColumn("ic_t", -F.abs("ic_t"))) is None


@pytest.mark.parametrize("groups,tests", [(6, 2), (5, 3), (4, 1)])
def test_each_path_covers_each_block_once(spark, groups, tests):
    tested = paths.splits(spark, groups, tests)
    want = {(k, g) for k, chosen in enumerate(itertools.combinations(range(groups), tests)) for g in chosen}
    assert {(r["split"], r["group"]) for r in tested.collect()} == want
    got = [(r["path"], r["group"], r["split"]) for r in paths.paths(tested).collect()]
    assert len(got) == len(want) and {p for p, _, _ in got} == set(range(paths.path_count(groups, tests)))
    assert all(sorted(g for q, g, _ in got if q == p) == list(range(groups)) for p, _, _ in got) and {(s, g) for _, g, s in got} == want
    sessions = spark.range(37).selectExpr("timestamp_seconds(id * 86400) as ts")
    sizes = {r["group"]: (r["a"], r["b"]) for r in paths.blocks(sessions, groups).groupBy("group").agg(F.min("i").alias("a"), F.max("i").alias("b")).collect()}
    assert sizes == {g: (37 * g // groups, 37 * (g + 1) // groups - 1) for g in range(groups)}


def test_dispersion_leaves_out_what_is_no_number(spark):
    rows = spark.createDataFrame([(1.0,), (-1.0,), (3.0,), (None,), (float("nan"),), (float("inf"),)], "v double")
    got = paths.dispersion(rows, "v").first()
    assert (got["paths"], got["mean"], got["std"], got["least"], got["most"], got["share_positive"]) == (3, 1.0, 2.0, -1.0, 3.0, pytest.approx(2 / 3))
    assert paths.dispersion(rows.limit(0), "v").first()["paths"] == 0


def test_votes_resolve_once(spark, tmp_path):
    rng = np.random.default_rng(2)
    closes = np.exp(np.cumsum(rng.normal(0, 0.02, 80)))
    bars = spark.createDataFrame([("A", DAY + dt.timedelta(days=i), float(c), i + 1) for i, c in enumerate(closes)], "symbol string, ts timestamp, c double, n int")
    labels = study.excess_barrier(bars.withColumn("market", F.lit(1.0)), 5, 20)
    at = lambda d, h=15: DAY + dt.timedelta(days=d, hours=h)
    votes = spark.createDataFrame([("m", "A", at(30), "BUY"), ("m", "A", at(30), "BUY"), ("m", "A", at(31), "SELL"), ("m", "A", at(3), "BUY"), ("m", "A", at(78), "BUY"), ("m", "B", at(40), "BUY"), ("m", "B", at(78), "BUY")], "model_id string, symbol string, at timestamp, signal string")
    now = lambda d: F.lit(DAY + dt.timedelta(days=d)).cast("timestamp")
    args = (votes, bars, labels)
    got = {(r["symbol"], r["at"]): r for r in outcomes.outcomes(*args, now(79), 5).collect()}
    assert [got[k]["status"] for k in (("A", at(30)), ("A", at(31)), ("A", at(3)), ("A", at(78)), ("B", at(40)), ("B", at(78)))] == ["resolved", "resolved", "dropped", "pending", "dropped", "pending"]
    label = {r["n"]: r for r in labels.collect()}
    for day, sign in ((30, 1), (31, -1)):
        r, x = got[("A", at(day))], label[day + 1]
        assert r["signed_return"] == pytest.approx(sign * (closes[x["touch"] - 1] / closes[day] - 1)) and r["correct"] == ((x["label"] == 1) == (sign == 1))
    first = outcomes.resolve(spark, f"{tmp_path}/o", "a", *args, now(79), 5).count()
    stored = lambda: sorted(map(str, spark.read.parquet(f"{tmp_path}/o").collect()))
    before = stored()
    assert first == 4 and outcomes.resolve(spark, f"{tmp_path}/o", "a", *args, now(79), 5).count() == 4 and stored() == before  # a replay
    assert outcomes.resolve(spark, f"{tmp_path}/o", "b", *args, now(79), 5).count() == 0
    assert outcomes.resolve(spark, f"{tmp_path}/o", "c", *args, now(300), 5).count() == 2  # the rest has grown too old
    assert outcomes.drop_days(63) == math.ceil(3 * 63 * 365.25 / 252)


def test_one_broken_symbol_does_not_stop_the_others(spark):
    schema = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, adj_close double"
    bar = lambda s, d, c=10.0, f=1.0: (s, DAY + dt.timedelta(days=d), c, c, c, c, 5.0, c * f)
    stored = spark.createDataFrame([bar(s, d) for s in "ABCD" for d in range(20)], schema)
    landed = [(*bar("A", d), 1, 1) for d in range(30)] + [(*bar("A", d, 77.0), 2, 1) for d in range(40)]  # the second source is not asked
    landed += [(*bar("B", d, 10.0, 0.5), 2, 1) for d in range(25)] + [(*bar("C", d, -1.0), 1, 1) for d in range(30)] + [(*bar("N", d), 1, 1) for d in range(9)]
    landed = spark.createDataFrame(landed, schema + ", priority int, seq int")
    names, failures = spark.createDataFrame([(s,) for s in "ABCDNX"], "symbol string"), spark.createDataFrame([("D", "timeout")], "symbol string, error string")
    bars, summary = sync.sync(names, stored, landed, failures, F.lit(DAY + dt.timedelta(days=40)).cast("timestamp"), 365, 5)
    got = {r["symbol"]: (r["mode"], r["rows"], r["latest"] and (r["latest"] - DAY).days, r["error"]) for r in summary.collect()}
    assert got == {"A": ("incremental", 16, 29, None), "B": ("readjusted", 25, 24, None), "C": ("failed", 0, 19, "no valid bar"), "D": ("failed", 0, 19, "timeout"), "N": ("full", 9, 8, None), "X": ("full", 0, None, None)}
    made = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.min("adj_close").alias("a"), F.max("adj_close").alias("b")).collect()
    assert {r["symbol"]: (r["n"], r["a"], r["b"]) for r in made} == {"A": (30, 10.0, 10.0), "B": (25, 5.0, 5.0), "C": (20, 10.0, 10.0), "D": (20, 10.0, 10.0), "N": (9, 10.0, 10.0)}
    assert sync.rounded_up(summary).first().asDict() == {"symbols": 6, "synced": 4, "failed": 2, "rows": 50, "readjusted": 1}


def test_catchup_waits_for_the_close(spark):
    rows = [("2024-01-05", "2024-01-06 10:00:00", False), ("2024-01-04", "2024-01-06 10:00:00", True), ("2024-01-05", "2024-01-06 23:30:00", True), (None, "2024-01-06 00:00:00", True), ("2030-01-01", "2024-01-06 23:30:00", False)]
    df = spark.createDataFrame(rows, "last string, now string, want boolean")
    assert df.where(sync.needs_catchup(F.col("last").cast("date"), F.col("now").cast("timestamp")) != F.col("want")).count() == 0


def test_concepts_come_in_their_order_and_unit(spark):
    facts = [("1", tag, unit, dt.date(2020, 12, 31), v, filed) for tag, unit, v, filed in [
        ("SalesRevenueNet", "USD", 1.0, dt.date(2021, 1, 1)), ("RevenueFromContractWithCustomerIncludingAssessedTax", "USD", 2.0, dt.date(2021, 1, 2)), ("Revenues", "EUR", 3.0, dt.date(2021, 1, 3)),
        ("CostOfServices", "USD", 4.0, dt.date(2021, 2, 1)), ("ProfitLoss", "USD", 5.0, None), ("EarningsPerShareBasic", "USD/shares", 6.0, dt.date(2021, 1, 1)),
    ]]
    got = payloads.statements(spark.createDataFrame(facts, "cik string, tag string, unit string, period_end date, value double, filed date")).first()
    assert (got["revenue"], got["cost_of_revenue"], got["net_income"], got["eps"], got["filed_at"]) == (2.0, 4.0, None, 6.0, dt.date(2021, 2, 1))
    assert list(payloads.CONCEPTS["revenue"])[0][0] == "Revenues" and len(payloads.CONCEPTS) == 11
