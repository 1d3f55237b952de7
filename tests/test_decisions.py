"""Coalesced decisions: windows, expiry, regimes, levels, and the stream against the batch over restarts."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import decisions
from tessera.streaming import decisions as stream

SCHEMA = "symbol string, ts timestamp, kind string, source string, signal string, confidence double, price double, stop double, target double"
DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    made = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return made


def at(seconds):
    return DAY + dt.timedelta(seconds=seconds)


def signal(symbol, s, source, said="BUY", confidence=0.8, price=10.0):
    return (symbol, at(s), "strategy", source, said, confidence, price, price * 0.9, price * 1.2)


def vote(symbol, s, said, confidence):
    return (symbol, at(s), "ml", "m", said, confidence, None, None, None)


def feed(spark, rows, regimes=()):
    parts = spark.createDataFrame(rows, SCHEMA)
    return decisions.fanned(parts, spark.createDataFrame(list(regimes), "ts timestamp, regime string"), parts)


def live(df):
    return sorted((r["symbol"], (r["decided_at"] - DAY).total_seconds(), [(c["source"], c["signal"], c["confidence"]) for c in r["live"]]) for r in df.collect())


def test_components_within_the_window_share_a_decision(spark):
    rows = [signal("A", 0, "x"), vote("A", 3, "SELL", 0.4), signal("A", 5, "y", "SELL"), signal("A", 5.5, "z"), vote("B", 1, "BUY", 0.9)]
    got = live(decisions.coalesced(feed(spark, rows)))
    assert [(s, t, [c[0] for c in v]) for s, t, v in got] == [("A", 5.0, ["strategy:x", "strategy:y", "ml"]), ("A", 10.5, ["strategy:x", "strategy:y", "strategy:z", "ml"])]  # a vote alone decides nothing


def test_entries_expire_one_by_one_and_a_regime_decides_all(spark):
    rows = [signal("A", 0, "x"), signal("A", 50_000, "y"), signal("B", 10, "x"), vote("C", 0, "BUY", 1.0)]
    regimes = [(at(60_000), "crisis"), (at(100_000), "slowdown"), (at(400_000), "expansion")]
    got = live(decisions.coalesced(feed(spark, rows, regimes)))
    macro = ("macro", "SELL", 0.6)
    assert [(s, t, [c[0] for c in v]) for s, t, v in got if s == "A"] == [("A", 5.0, ["strategy:x"]), ("A", 50_005.0, ["strategy:x", "strategy:y"]), ("A", 60_005.0, ["strategy:x", "strategy:y", "macro"]), ("A", 100_005.0, ["strategy:y"])]
    assert [(t, macro in v) for s, t, v in got if s == "B"] == [(15.0, False), (60_005.0, True)]
    assert not [s for s, _, _ in got if s == "C"]


def test_votes_costs_and_levels(spark):
    weights = spark.createDataFrame([("strategy:x", 0.5), ("strategy:y", 0.25), ("ml", 0.25)], "source string, weight double")
    rows = [signal("A", 0, "x", "BUY", 0.5, 10.0), signal("A", 1, "y", "BUY", 0.9, 20.0), signal("B", 0, "x", "BUY", 0.21), signal("C", 0, "x", "HOLD", 0.5), vote("C", 0, "SELL", 1.0), signal("D", 0, "new", "SELL", 1.0)]
    got = {r["symbol"]: r for r in decisions.decided(decisions.coalesced(feed(spark, rows)), weights).collect()}
    assert (got["A"]["signal"], got["A"]["strategy"], got["A"]["price"]) == ("BUY", "y", 20.0) and got["A"]["score"] == pytest.approx((0.5 * 0.5 + 0.25 * 0.9) / 0.75)
    assert (got["B"]["signal"], got["B"]["cost_filtered"]) == ("HOLD", True)  # 42 basis points don't pay 48
    assert (got["C"]["signal"], got["C"]["levels_missing"], got["C"]["sources"]) == ("SELL", True, "strategy:x,ml")
    assert (got["D"]["signal"], got["D"]["score"]) == ("SELL", -1.0)
    assert decisions.decided(decisions.coalesced(feed(spark, rows)).limit(0), weights).count() == 0


def run(spark, folder, source):
    q = stream.coalesced(spark.readStream.schema(source.schema).parquet(f"{folder}/in"), late="30 seconds").writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
    q.option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()


def test_stream_over_restarts_equals_the_batch(spark, tmp_path):
    """Rows arrive out of order, up to 20 seconds late, in batches cut anywhere; the query stops after each."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(240):
        s, t, said = "AB"[k % 2], float(np.round(k * 3 + rng.random() * 2, 3)), ["BUY", "SELL", "HOLD"][int(rng.integers(3))]
        rows.append(vote(s, t, said, 0.5) if k % 5 == 0 else signal(s, t, "xyz"[int(rng.integers(3))], said, float(rng.integers(1, 9)) / 10))
    regimes = [(at(200), "crisis"), (at(333.5), "recovery")]
    whole = feed(spark, rows, regimes)
    made = [tuple(r) for r in whole.collect()]
    order = sorted(range(len(made)), key=lambda i: made[i][1].timestamp() + 20 * rng.random())
    last = [("Z", at(9_000), "ml", "m", "BUY", 0.1, None, None, None, None)]  # moves the watermark past all
    cuts = [0, 40, 41, 130, len(order)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = spark.createDataFrame([made[i] for i in order[a:b]], whole.schema)
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(spark, tmp_path, whole)
    end = spark.createDataFrame(last, whole.schema).withColumn("at", F.unix_micros("ts"))
    end.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run(spark, tmp_path, whole)
    got = spark.read.schema("symbol string, decided_at timestamp, live " + decisions.LIVE).parquet(f"{tmp_path}/out")
    want = live(decisions.coalesced(whole))
    assert live(got) == want and len(want) > 60
