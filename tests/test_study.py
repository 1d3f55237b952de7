"""Operators without an SQL twin, and edge cases: zero volume, constant references, splits, exits, payloads, streams."""

import datetime as dt
import math
from statistics import NormalDist

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import ledger, market, monitor, panel, strategy, study
from tessera.operators import technical as tech
from tessera.sources import payloads
from tessera.streaming import streams


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def day(i, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=i, hours=hour)


def bars(spark, closes, volume=10.0, symbol="A"):
    rows = [(symbol, day(i), c, c + 1.0, c - 1.0, c, volume, c) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, adj_close double")


def test_zero_volume_and_zero_close_give_null(spark):
    rows = bars(spark, [100.0 + i for i in range(30)], volume=0.0).unionByName(bars(spark, [0.0] * 5 + [1.0] * 25, symbol="B"))
    got = {(r["symbol"], r["ts"]): r for r in market.features(rows).collect()}
    assert got["A", day(25)]["volume_ratio"] is None and got["A", day(25)]["return_1d"] is not None
    assert got["B", day(3)]["return_1d"] is None
    assert tech.technical(rows).count() == 60 and tech.recursive(rows).count() == 60


def test_constant_reference_keeps_its_feature(spark):
    rows = [("f", "ref", 1.0)] * 20 + [("f", "cur", 3.0)] * 20 + [("g", "ref", 1.0)] * 20 + [("g", "cur", 1.0)] * 20
    got = {r["feature"]: r["psi"] for r in panel.psi(spark.createDataFrame(rows, "feature string, side string, value double")).collect()}
    assert got["f"] > 5 and got["g"] == pytest.approx(0)


def test_normal_distribution(spark):
    xs = [-8.0, -3.5, -3.0, -1.0, -0.1, 0.0, 0.5, 2.9, 3.0, 4.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", study.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r["p"] - NormalDist().cdf(r["x"])) < 1e-9 for r in got)


def test_deflated_ratio(spark):
    values = [0.01 * math.sin(i * 1.7) + 0.004 for i in range(60)]
    rows = spark.createDataFrame([("a", v) for v in values] + [("short", 0.1)] * 3 + [("flat", 0.1)] * 20, "k string, r double")
    got = {r["k"]: r for r in study.deflated_sharpe(rows, "r", "k", 20).collect()}
    n, m = len(values), sum(values) / len(values)
    sd = math.sqrt(sum((v - m) ** 2 for v in values) / (n - 1))
    skew, kurt = (sum(((v - m) / sd) ** k for v in values) / n for k in (3, 4))
    sr = m / sd
    want = NormalDist().cdf((sr - study.expected_best(20) / math.sqrt(n - 1)) * math.sqrt(n - 1) / math.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr**2))
    assert got["a"]["deflated"] == pytest.approx(want, abs=1e-9) and got["short"]["deflated"] == 0 and got["flat"]["deflated"] == 0


def test_uniqueness_by_hand(spark):
    got = {r["n"]: r["weight"] for r in study.uniqueness(spark.createDataFrame([("A", 1, 2), ("A", 2, 3), ("A", 7, 7)], "symbol string, n int, touch int")).collect()}
    assert got == {1: pytest.approx(0.75), 2: pytest.approx(0.75), 7: pytest.approx(1.0)}


def test_envelope_names_the_first_broken_limit(spark):
    schema = "drawdown double, daily_loss double, confidence double, exposure double, in_sector int, signal string, stop double"
    rows = [(0.2, 0.9, 0.1, 1.0, 9, "BUY", None), (0.0, 0.05, 0.1, 1.0, 9, "BUY", None), (0.0, 0.0, 0.5, 1.0, 9, "BUY", None), (0.0, 0.0, 0.6, 0.8, 9, "BUY", None), (0.0, 0.0, 0.6, 0.1, 3, "BUY", None), (0.0, 0.0, 0.6, 0.1, 0, "SELL", None), (0.0, 0.0, 0.6, 0.1, 0, "HOLD", None)]
    got = [r["x"] for r in spark.createDataFrame(rows, schema).coalesce(1).select(strategy.envelope().alias("x")).collect()]
    assert got == ["drawdown", "daily_loss", "confidence", "exposure", "sector", "missing_stop", "approved"]


def test_sales_are_clipped_to_holdings(spark):
    rows = [("s", "SELL", 5, 1), ("s", "BUY", 3, 2), ("s", "SELL", 9, 3), ("s", "BUY", 2, 4)]
    fills = spark.createDataFrame([(s, side, q, float(i), day(0, i), i) for s, side, q, i in rows], "symbol string, side string, quantity long, price double, ts timestamp, order_id long")
    got = [(r["filled"], r["position"]) for r in ledger.positions(fills).orderBy("order_id").collect()]
    assert got == [(0, 0), (3, 3), (3, 0), (2, 2)]


def test_bad_payloads_give_no_rows(spark):
    good = '{"Time Series (Daily)": {"2024-01-02": {"1. open": "1", "2. high": "2", "3. low": "0.5", "4. close": "1.5", "6. volume": "3"}, "2024-01-03": {"1. open": "x"}, "bad": {"1. open": "1", "2. high": "2", "3. low": "0.5", "4. close": "1.5"}}}'
    rows = spark.createDataFrame([("A", good), ("B", "no json"), ("C", None), ("D", '{"Error Message": "x"}'), ("E", "{}")], "symbol string, payload string")
    got = payloads.daily_bars(rows).collect()
    assert [(r["symbol"], r["ts"], r["adj_close"], r["volume"]) for r in got] == [("A", dt.datetime(2024, 1, 2), None, 3.0)]


def run_stream(spark, tmp_path, name, rows, schema, build):
    for i, part in enumerate((rows[: len(rows) // 2], rows[len(rows) // 2 :])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        query = build(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    return spark.read.parquet(f"{tmp_path}/out")


def test_orders_once_over_restarts(spark, tmp_path):
    rows = [("A", "BUY", day(0, 1), 1), ("A", "BUY", day(0, 2), 2), ("A", "SELL", day(0, 3), 3), ("A", "BUY", day(0, 5), 4), ("A", "BUY", day(1, 5), 5), ("B", "BUY", day(1, 6), 6)]
    got = run_stream(spark, tmp_path, "orders", rows, "symbol string, side string, ts timestamp, order_id long", streams.orders_once)
    assert sorted((r["symbol"], r["side"], r["session"].day) for r in got.collect()) == [("A", "BUY", 1), ("A", "BUY", 2), ("A", "SELL", 1), ("B", "BUY", 2)]


def test_breaker_stream_equals_the_batch_form(spark, tmp_path):
    values = [100, 104, 103, 97, 98, 94, 99, 90, 86, 99, 120]
    rows = [("a", day(i // 3, i % 3), float(v)) for i, v in enumerate(values)]
    schema = "account string, ts timestamp, equity double"
    got = run_stream(spark, tmp_path, "breaker", rows, schema, lambda s: streams.breaker_changes(s, 100.0))
    batch = ledger.breaker(spark.createDataFrame(rows, schema), "account", 100.0)
    want = panel.changes(batch.select("account", "ts", "level"), "level", "account", ["ts"]).where("not (before is null and level = 'NONE')")
    assert sorted((r["ts"], r["level"]) for r in got.collect()) == sorted((r["ts"], r["level"]) for r in want.collect())


def test_alerts_of_five_kinds(spark):
    at = day(0)
    made = monitor.breaker_alerts(spark.createDataFrame([(at, "BLACK", "drawdown", 0.16, 0.15, "flatten")], "ts timestamp, level string, metric string, value double, threshold double, action string"))
    made = made.unionByName(monitor.fill_alerts(spark.createDataFrame([(at, "A", 10.0, 2.5, 7)], "ts timestamp, symbol string, quantity double, price double, order_id long")))
    made = made.unionByName(monitor.drift_alerts(spark.createDataFrame([(at, "m", "feature", "odd", "retrain")], "ts timestamp, model_id string, drift_type string, severity string, action string")))
    made = made.unionByName(monitor.status_alerts(spark.createDataFrame([(at, "s", "active", "probation", "low_pf", None)], "ts timestamp, strategy string, old_status string, new_status string, reason string, sharpe double")))
    made = made.unionByName(monitor.revalidation_alerts(spark.createDataFrame([(at, "s", 1.0, 0.9, 0.1, "active")], "ts timestamp, strategy string, original double, current double, degradation double, status string")))
    got = {(r["severity"], r["message"]) for r in made.collect()}
    assert got == {
        ("critical", "drawdown=16.00% (threshold 15.00%) → flatten"), ("info", "10 @ 2.50 (order 7)"), ("warning", "Recommended action: retrain"),
        ("warning", "reason: low_pf (sharpe_90d n/a)"), ("info", "OOS Sharpe 0.90 vs 1.00 (degradation 10%)"),
    }
    assert monitor.at_least(made, "critical").count() == 1


def test_regime_components(spark):
    rows = spark.createDataFrame([("crisis",), ("slowdown",), (None,), ("recovery",)], "regime string")
    got = [r["c"] for r in rows.select(monitor.regime_component(F.col("regime")).alias("c")).collect()]
    assert [c and (c["signal"], c["confidence"]) for c in got] == [("SELL", 0.6), None, None, ("BUY", 0.3)]


def test_protective_exits_over_restarts(spark, tmp_path):
    rows = [
        ("A", day(0), "open", None, 5.0, 90.0, 110.0), ("A", day(1), "mark", 95.0, None, None, None), ("B", day(0), "open", None, 2.0, None, 20.0), ("B", day(1), "mark", 1.0, None, None, None),
        ("C", day(1), "mark", 1.0, None, None, None), (None, day(1), "mark", 1.0, None, None, None),
        ("A", day(2), "mark", 90.0, None, None, None), ("A", day(3), "mark", 80.0, None, None, None), ("B", day(3), "mark", 25.0, None, None, None), ("A", day(4), "open", None, 1.0, 70.0, None), ("A", day(4), "mark", 60.0, None, None, None),
        ("C", day(5), "open", None, 0.0, 90.0, 110.0), ("C", day(6), "mark", 50.0, None, None, None),
    ]
    schema = "symbol string, ts timestamp, kind string, price double, quantity double, stop double, target double"
    got = run_stream(spark, tmp_path, "exits", rows, schema, streams.protective_exits)
    assert sorted((r["symbol"], r["ts"], r["quantity"], r["price"], r["reason"]) for r in got.collect()) == [
        ("A", day(2), 5.0, 90.0, "stop"), ("A", day(4), 1.0, 60.0, "stop"), ("B", day(3), 2.0, 25.0, "target"),
    ]


def test_black_sells_the_account(spark, tmp_path):
    rows = [("a", day(0), "RED"), ("a", day(1), "BLACK"), ("b", day(1), "YELLOW"), ("c", day(2), "BLACK")]
    held = spark.createDataFrame([("a", "X", 3.0, 10.0), ("a", "Y", 0.0, 10.0), ("a", "Z", 1.0, None), ("b", "X", 3.0, 10.0)], "account string, symbol string, quantity double, last_price double")
    got = run_stream(spark, tmp_path, "sales", rows, "account string, ts timestamp, level string", lambda s: streams.liquidations(s, held))
    assert [(r["account"], r["ts"], r["symbol"], r["side"], r["quantity"], r["price"]) for r in got.collect()] == [("a", day(1), "X", "SELL", 3.0, 10.0)]
