"""Edge cases of the gate, pooling, overlays and vintages, by hand."""

import datetime as dt

import pytest
from pyspark.sql import SparkSession

from tessera.operators import gate_queries, gates
from tessera.operators.queries import bars

HOLDOUT = "model string, best_epoch int, pred_std double, sessions long, sections long, ic_mean double, ic_std double, baseline_ic double, sharpe double, sharpe_active double, lift double, brier_delta double, brier_se double, auc double, deflated double"
GOOD = {"model": "good", "best_epoch": 5, "pred_std": 0.1, "sessions": 60, "sections": 100, "ic_mean": 0.05, "ic_std": 0.1, "baseline_ic": 0.02, "sharpe": 1.0, "sharpe_active": 0.3, "lift": 0.02, "brier_delta": 0.001, "brier_se": 0.001, "auc": 0.55, "deflated": 0.95}


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def test_each_condition_fails_by_itself(spark):
    broken = {
        "G0": {"best_epoch": 1}, "G1": {"ic_std": 0.5}, "G2": {"baseline_ic": 0.06}, "G3": {"lift": 0.0}, "G4": {"auc": 0.5}, "G5": {"deflated": None},
    }
    rows = [GOOD, {**GOOD, "model": "alone"}] + [{**GOOD, "model": k, **v} for k, v in broken.items()]
    names = [c.split()[0] for c in HOLDOUT.split(", ")]
    holdout = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], HOLDOUT)
    # of the three newest folds two are above the benchmark; the oldest does not count
    folds = [(r["model"], f, a) for r in rows if r["model"] != "alone" for f, a in ((1, 0.9), (2, 0.1), (3, -0.1), (4, 0.1))]
    got = gates.gate(holdout, spark.createDataFrame(folds, "model string, fold int, sharpe_active double")).collect()
    failed = {m: {r["condition"] for r in got if r["model"] == m and not r["passed"]} for m in {r["model"] for r in got}}
    assert failed == {"good": set(), "alone": {"G0", "G3"}, **{k: {k} for k in broken}}


def test_folds_weigh_by_sections(spark):
    rows = [("a", 10, 0.1, 0.2, 1.0), ("a", 30, 0.3, 0.4, 2.0), ("a", 1, 9.0, 0.0, 3.0), ("b", 1, 0.5, 0.0, 1.0)]
    got = {r["c"]: r for r in gates.pooled(spark.createDataFrame(rows, "c string, sections long, ic_mean double, ic_std double, sharpe_net double"), "c").collect()}
    assert (got["a"]["folds"], got["a"]["sections"], got["a"]["sharpe"]) == (3, 40, 2.0)
    assert got["a"]["ic_mean"] == pytest.approx(0.25) and got["a"]["ic_t"] == pytest.approx(0.25 / (0.3 / 40**0.5))
    assert (got["b"]["sections"], got["b"]["ic_mean"], got["b"]["ic_t"]) == (0, 0.0, 0.0)


def test_sessions_of_one_name_and_empty_tables(spark):
    schema = "symbol string, ts timestamp, p double, r double"
    at = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = [("A", at[0], 0.9, 0.1), ("B", at[0], 0.1, -0.1), ("A", at[1], 0.9, 0.2), ("A", at[2], 0.1, 0.3), ("B", at[2], 0.9, 0.1), ("C", at[2], None, 0.5)]
    got = {r["ts"].day: r for r in gates.session_metrics(spark.createDataFrame(rows, schema), "p", "r").collect()}
    assert set(got) == {1, 3}
    assert (got[1]["gross"], got[1]["short"], got[1]["benchmark"], got[1]["ic"]) == (0.1, -0.1, 0.0, 0.0)
    assert got[3]["turnover"] == 1.0 and got[3]["gross"] == 0.1
    assert gates.session_metrics(spark.createDataFrame([], schema), "p", "r").count() == 0


def test_overlay_keeps_what_attributes_lack(spark):
    events = spark.createDataFrame([("A", "x", 1.0, 1), ("A", "x", 2.0, 2), ("A", "y", 3.0, 1), ("A", "x", None, 3), ("A", None, 9.0, 9), ("C", "x", 5.0, 1)], "symbol string, name string, value double, ts int")
    vectors = spark.createDataFrame([("A", 0.5, 7.0), ("B", 0.6, None)], "symbol string, x double, z double")
    got = {r["symbol"]: (r["x"], r["y"], r["z"]) for r in gates.overlay(vectors, gates.attributes(events), ["x", "y"]).collect()}
    assert got == {"A": (2.0, 3.0, 7.0), "B": (0.6, None, None)}


def test_undated_vintages_meet_again(spark):
    schema = "series string, observation_date date, realtime_start date, value double"
    day = dt.date(2024, 1, 1)
    kept = spark.createDataFrame([("s", day, None, 1.0), ("s", day, dt.date(2024, 2, 1), 2.0)], schema)
    batch = spark.createDataFrame([("s", day, None, 3.0, 1), ("s", day, None, 4.0, 2)], schema + ", seq int")
    got = gates.vintages(gates.save_vintages(kept, batch)).collect()
    assert sorted((str(r["realtime_start"]), r["value"]) for r in got) == [("2024-02-01", 2.0), ("None", 4.0)]
    assert gates.save_vintages(kept, batch).where("realtime_start = date'9999-12-31'").count() == 1


def test_trades_are_read_once_after_the_cache_is_cleared(spark):
    sf = "/root/testdata/sf0.001"
    before = sorted(gate_queries.gate(spark, sf).collect())
    spark.catalog.clearCache()
    again = gate_queries.gate(spark, sf)
    assert not [f for f in again.inputFiles() if "lineitem" in f or "part." in f]  # every branch starts at a stored table
    assert sorted(again.collect()) == before and len(before) == 5
    spark.catalog.clearCache()
    assert bars(spark, sf).storageLevel.useDisk and gate_queries._sessions(spark, sf).storageLevel.useDisk
