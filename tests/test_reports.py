"""Reports on small tables by hand, and the plan of the training table."""

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import dataset, reports, study, study_queries


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


SAMPLES, PREDICTIONS, PERFORMANCE = "model_id string, feature string, side string, value double", "model_id string, side string, value double", "model_id string, baseline_sharpe double, sharpe double, accuracy double"


def test_drift_without_outcomes_is_neutral_and_a_moved_feature_retrains(spark):
    same = [("m", f, s, float(i)) for f in "ab" for s in ("ref", "cur") for i in range(50)]
    moved = [("k", "a", "ref", float(i)) for i in range(50)] + [("k", "a", "cur", 100.0 + i) for i in range(50)]
    samples = spark.createDataFrame(same + moved, SAMPLES)
    predictions = spark.createDataFrame([("m", s, i / 50) for s in ("ref", "cur") for i in range(50)] + [("s", "ref", i / 500) for i in range(99)] + [("s", "cur", 0.9 + i / 1000) for i in range(99)], PREDICTIONS)
    performance = spark.createDataFrame([("m", 1.0, None, None), ("k", 1.0, 1.0, 0.6), ("s", 0.0, 1.0, 0.6), ("low", 1.0, 0.69, 0.6), ("bad", -1.0, -1.2, 0.47)], PERFORMANCE)
    got = {r["model_id"]: r for r in reports.drift_reports(samples, predictions, performance).collect()}
    assert [got[m]["action"] for m in ("m", "k", "s", "low", "bad")] == ["no_action", "auto_retrain", "alert_and_monitor", "auto_retrain", "auto_retrain"]
    assert not got["m"]["performance_measured"] and got["m"]["accuracy"] == 0.5 and got["m"]["sharpe_decay"] == 0 and got["m"]["drifted"] == ""
    assert got["k"]["drifted"] == "a" and got["s"]["sharpe_decay"] == 0 and got["s"]["needs_investigation"] and got["low"]["prediction_shift"] == 0


def test_books_that_are_young_flat_or_worthless(spark):
    rows = [("one", 1, 5.0), ("flat", 1, 2.0), ("flat", 2, 2.0), ("flat", 3, None), ("zero", 1, 0.0), ("zero", 2, 3.0), ("zero", 3, 6.0), ("fall", 1, 4.0), ("fall", 2, 8.0), ("fall", 3, 2.0)]
    paths = reports.equity_paths(spark.createDataFrame(rows, "account string, ts int, equity double"))
    got = {r["account"]: r for r in reports.book_sections(paths).collect()}
    assert got["one"]["pnl_pct"] == 0 and got["one"]["sharpe"] is None and got["one"]["var_95"] is None
    assert got["flat"]["sessions"] == 2 and got["flat"]["sharpe"] is None and got["flat"]["max_drawdown"] == 0
    assert got["zero"]["pnl_abs"] is None and got["zero"]["returns"] == 1
    assert got["fall"]["max_drawdown"] == 0.75 and got["fall"]["pnl_pct"] == -0.5
    assert reports.equity_paths(spark.createDataFrame(rows, "account string, ts int, equity double"), most=1).where("account = 'fall'").first()["drawdown"] == 0.75


def test_attribution_and_correlations_of_holdings(spark):
    statuses = spark.createDataFrame([("a", 1, "active"), ("a", 2, "probation"), ("b", 1, "active")], "strategy string, ts int, status string")
    weights = spark.createDataFrame([("strategy:a", 0.4), ("strategy:gone", 0.3), ("ml", 0.3)], "source string, weight double")
    assert sorted(map(tuple, reports.attribution(statuses, weights).collect()), key=str) == [("a", "strategy", "probation", 0.4), ("b", "strategy", "active", None), ("ml", "other", None, 0.3)]
    returns = spark.createDataFrame([(s, t, float((t * k) % 7)) for s, k, n in (("x", 1, 30), ("y", 1, 25), ("z", 3, 5)) for t in range(30 - n, 30)] + [("q", 1, 9.0)], "symbol string, ts int, ret double")
    held = spark.createDataFrame([(s,) for s in ("x", "y", "z", "none", "x")], "symbol string")
    got = {(r["a"], r["b"]): r for r in reports.held_correlations(returns, held).collect()}
    assert len(got) == 6 and got["x", "y"]["n"] == 25 and abs(got["x", "y"]["corr"] - 1) < 1e-12
    assert got["x", "z"]["n"] == 5 and got["x", "z"]["corr"] is None and got["none", "x"]["n"] == 0
    assert all(r["coverage"] == 1 / 6 for r in got.values())


def test_states_and_breaches(spark):
    table = spark.createDataFrame([(0.1, 0.5, 0.5, 0.2), (0.9, 0.5, 0.5, 0.4)], "good double, close double, still double, ta double")
    names = ["good", "close", "still", "ta"]
    got = {r["feature"]: r["state"] for r in reports.feature_states(table, names, ("ta",)).collect()}
    assert got == {"good": "model", "close": "inadmissible", "still": "constant", "ta": "candidate"}
    assert {r["state"] for r in reports.feature_states(table.limit(0), names, ("ta",), True).collect()} == {"inadmissible", "constant"}
    report = spark.createDataFrame([(5, 10, 2.0)], "sessions long, samples long, median_names double")
    states = reports.feature_states(table, ["good", "still"])
    assert reports.violations(report, states.where("feature = 'good'"), 5, 10, 2, 0.5, 5).count() == 0
    assert {(r["rule"], r["feature"]) for r in reports.violations(report, states, 6, 11, 3, 0.5, 8).collect()} == {("sessions", ""), ("samples", ""), ("median_names", ""), ("short_of_requested", ""), ("constant", "still"), ("neutral", "still")}


def test_catch_up_compares_dates(spark):
    rows = spark.createDataFrame([("2024-05-02", "2024-05-03 15:59:00"), ("2024-05-02", "2024-05-03 16:00:00"), ("2024-05-01", "2024-05-03 01:00:00"), (None, "2024-05-03 01:00:00")], "d string, t string")
    due = reports.needs_catchup(F.col("d").cast("date"), F.col("t").cast("timestamp"), 16)
    assert [r[0] for r in rows.select(due).collect()] == [False, True, True, True]


def test_uniqueness_carries_columns_and_ignores_the_order_of_rows(spark):
    spans = [("A", 1, 2, "p"), ("A", 2, 3, "q"), ("A", 7, 7, "r"), ("B", 1, 9, "s")]
    for rows in (spans, spans[::-1]):
        got = {(r["symbol"], r["n"]): (r["tag"], round(r["weight"], 12)) for r in study.uniqueness(spark.createDataFrame(rows, "symbol string, n int, touch int, tag string"), "tag").collect()}
        assert got == {("A", 1): ("p", 0.75), ("A", 2): ("q", 0.75), ("A", 7): ("r", 1.0), ("B", 1): ("s", 1.0)}


def test_priors_are_those_filed_before(spark):
    filings = spark.createDataFrame([("A", "2020", 1, 10.0), ("A", "2019", 3, 5.0), ("A", "2021", 5, 20.0), ("A", "2018", None, 1.0)], "symbol string, period_end string, filed_at int, total_assets double")
    sessions = spark.createDataFrame([("A", t) for t in (1, 2, 4, 6)], "symbol string, ts int")
    got = [(r["ts"], r["filing"] and r["filing"]["period_end"], r["prior"] and r["prior"]["period_end"]) for r in dataset.visible_filings(sessions, filings).orderBy("ts").collect()]
    assert got == [(1, None, None), (2, "2020", None), (4, "2019", None), (6, "2021", "2020")]


def test_the_training_table_exchanges_a_handful_of_times(spark):
    plan = study_queries.dataset(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 30  # those that build bars and labels included; 111 with one for each feature


def test_the_alert_feed_is_one_as_a_stream_over_restarts(spark, tmp_path):
    from tessera.streaming import alerts

    rows = [
        ("breaker", 1, '{"level": "BLACK", "metric": "drawdown", "value": 0.2, "threshold": 0.15, "action": "flatten"}'), ("fill", 2, '{"symbol": "A", "quantity": 3, "price": 2.5, "order_id": "7"}'),
        ("fill", 3, '{"symbol": "A", "quantity": "many"}'), ("status", 4, '{"strategy": "s", "old_status": "active", "new_status": "probation", "reason": "r"}'), ("status", 5, "{"),
        ("drift", 6, None), ("gossip", 7, "{}"), (None, 8, "{}"),
        ("revalidated", 9, '{"strategy": "s", "original": 1.0, "current": 0.5, "degradation": 0.5, "status": "probation", "more": 1}'),
    ]
    schema = "topic string, ts int, payload string"
    batch = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, alerts.feed(batch).collect()))
    assert [r[0] for r in want] == [1, 2, 4, 9] and sorted(r["ts"] for r in alerts.refused(batch).collect()) == [3, 5, 6, 7, 8]
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = alerts.feed(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == want


def test_targets_by_hand(spark):
    from tessera.operators import targets

    ups = [("A", t, 100.0 * 1.01 ** (t + (t % 2) / 10), 1.0) for t in range(40)]
    rows = spark.createDataFrame(ups, "symbol string, ts int, c double, market double").withColumns({"h": F.col("c"), "l": F.col("c")})
    grid = targets.barrier_grid(targets.barrier_paths(rows, 5, 5), [2, 5], [0.5, 1e6])
    got = {(r["excess"], r["horizon"], r["width"], r["barrier"], r["label"]) for r in grid.collect()}
    assert got == {(e, h, m, b, 1) for e in (False, True) for h in (2, 5) for m, b in ((0.5, "upper"), (1e6, "vertical"))}
    assert {(r["width"], r["touched"]) for r in targets.recommended(grid).collect()} == {(0.5, 1.0)}
    assert grid.where("horizon = 5 and ts > 34").count() == grid.where("horizon = 5 and ts > 34 and barrier = 'upper'").count()  # history cuts the others short
    vectors = rows.select("symbol", "ts", F.lit(None).cast("double").alias("f"))
    assert targets.target_scores(rows, vectors, ["f"], [2], [0.5], 2).count() == 0
    lone = targets.target_scores(rows, vectors, ["f"], [2], [0.5], 1).collect()
    assert [(r["excess"], r["best_ic"], r["place"]) for r in lone] == [(False, 0.0, 1), (True, 0.0, 2)]
