"""Bars to vectors and vectors to votes as streams: restarts, late bars, replayed batches; messages once."""

import datetime as dt
import pathlib

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.streaming import streams, vectors

SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, adj_close double"


@pytest.fixture(scope="session")
def spark():
    made = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return made


def bars(symbol, n, seed):
    rng = np.random.default_rng(seed)
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    out = []
    for i in range(n):
        o, c = float(close[i] * (1 + rng.normal(0, 0.005))), float(close[i])
        out.append((symbol, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), o, max(o, c) * 1.01, min(o, c) * 0.99, c, float(rng.integers(100, 900)), c * (0.5 if i < n // 2 else 1.0)))
    return out


def collected(df):
    return {(r["symbol"], r["ts"]): r.asDict() for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key, row in want.items():
        for c, x in row.items():
            y = got[key][c]
            assert x == y or (x is None) == (y is None) and (x is None or abs(x - y) <= 1e-6 * (1 + abs(x))), (key, c, x, y)


def test_vectors_equal_the_batch_over_restarts_and_late_bars(spark, tmp_path):
    a, b = bars("A", 380, 1), bars("B", 90, 2)
    wrong = (*a[300][:5], 999.0, *a[300][6:])
    steps = [a[:200] + b[:40], a[200:250] + [wrong] + a[251:300] + b[41:60], [*a[301:380], *b[60:], a[300], b[40], a[250]]]  # one bar wrong at first, two late
    for rows in steps:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        vectors.bars_to_vectors(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = collected(vectors.newest(spark, f"{tmp_path}/out"))
    want = collected(vectors.vectors(spark.createDataFrame(a + b, SCHEMA)))
    same(got, want)
    assert got[("A", a[-1][1])]["rsi_14"] is not None and len(got) == 470


def test_a_replayed_batch_changes_neither_sink(spark, tmp_path):
    schema = "symbol string, ts timestamp, x double, y double, z double"
    at = dt.datetime(2024, 1, 1)
    first = [("A", at, 0.9, 0.9, 0.9), ("B", at, 0.1, None, 0.1), ("C", at, None, None, 0.9), ("D", at, 0.5, 0.5, 0.5), (None, at, 0.9, 0.9, 0.9)]
    second = [("A", at + dt.timedelta(days=1), 0.2, 0.1, 0.3), ("E", at, 0.7, None, 0.8)]
    predict = lambda rows: rows.withColumn("p", (F.col("x") + F.col("y") + F.col("z")) / 3)

    def run():
        rows = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        vectors.serve(rows, predict, ["x", "y", "z"], "m@v1", f"{tmp_path}/log", f"{tmp_path}/votes", f"{tmp_path}/checkpoint").awaitTermination()
        return [sorted(map(str, spark.read.parquet(f"{tmp_path}/{s}").collect())) for s in ("log", "votes")]

    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        before = run()
    log, votes = (spark.read.parquet(f"{tmp_path}/{s}") for s in ("log", "votes"))
    assert sorted((r["symbol"], r["signal"]) for r in log.collect()) == [("A", "BUY"), ("A", "SELL"), ("B", "SELL"), ("D", "HOLD"), ("E", "BUY")]
    got = {(r["symbol"], r["ts"].day): (r["signal"], round(r["confidence"], 6)) for r in votes.collect()}
    assert got == {("A", 1): ("BUY", 0.8), ("A", 2): ("SELL", 0.6), ("B", 1): ("SELL", round(2 * (0.5 - 0.7 / 3), 6)), ("E", 1): ("BUY", round(2 * (2 / 3 - 0.5), 6))}
    last = max(pathlib.Path(f"{tmp_path}/checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    (last.parent / f".{last.name}.crc").unlink()
    last.unlink()  # as if the driver had died between the sinks and the commit
    assert run() == before


def test_messages_once_over_a_restart(spark, tmp_path):
    schema = "event_id string, ts timestamp"
    at = dt.datetime(2024, 1, 1)
    for k, ids in enumerate((["a", "b", "a"], ["b", "c"], ["c", "d"])):
        spark.createDataFrame([(i, at + dt.timedelta(minutes=k)) for i in ids], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = streams.once(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        rows.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c", "d"]
