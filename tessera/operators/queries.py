"""Registered market queries and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import market


_KEPT: dict[tuple, DataFrame] = {}


def _bars(spark: SparkSession, sf_dir: str, unit: str = "day") -> DataFrame:
    """The bars of a folder, built once a session: they are kept on the executors (on disk where memory ends) and built anew where one is lost."""
    key = (spark.sparkContext.applicationId, sf_dir, unit)
    if key not in _KEPT:
        read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        _KEPT[key] = market.bars(read("lineitem"), read("part"), unit)
    return _KEPT[key] if _KEPT[key].storageLevel.useDisk else _KEPT[key].persist()  # a caller may have cleared the cache


def bars(spark, sf_dir):
    return _bars(spark, sf_dir)


def features(spark, sf_dir):
    return market.features(_bars(spark, sf_dir))


def ranked(spark, sf_dir):
    return market.features(_bars(spark, sf_dir)).select("symbol", "ts", market.percentile_rank("return_5d").alias("rank_5d"))


def selection(spark, sf_dir):
    rows = market.features(_bars(spark, sf_dir)).withColumn("rank_5d", market.percentile_rank("return_5d"))
    return market.top_quantile(rows, "rank_5d").select("symbol", "ts", "rank_5d")


def drawdown(spark, sf_dir):
    return market.drawdowns(_bars(spark, sf_dir))


def coverage(spark, sf_dir):
    return market.coverage(_bars(spark, sf_dir))


def crossover(spark, sf_dir):
    rows = market.positions(_bars(spark, sf_dir))
    return rows.groupBy("symbol").agg(F.sum("ret").alias("total_ret"), F.sum("pos").alias("sessions_long"))


def queries():
    return {"bars": bars, "features": features, "ranked": ranked, "selection": selection, "drawdown": drawdown, "coverage": coverage, "crossover": crossover}


BARS = """WITH t AS (SELECT p_brand AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, l_extendedprice / l_quantity AS px,
    (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, l_quantity, l_discount
    FROM lineitem JOIN part ON l_partkey = p_partkey),
  b AS (SELECT symbol, ts, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close,
    sum(round(l_quantity * 1000000)::BIGINT)::DOUBLE / 1000000::DOUBLE AS volume,
    arg_max(px, k) * (1 - sum(round(l_discount * 1000000)::BIGINT)::DOUBLE / 1000000::DOUBLE / count(l_discount)) AS adj_close FROM t GROUP BY 1, 2)"""
FEATURES = BARS + """,
  r AS (SELECT symbol, ts, adj_close AS c, volume, row_number() OVER w AS n, adj_close / lag(adj_close) OVER w - 1 AS r
    FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  f AS (SELECT symbol, ts, c, r AS return_1d, c / lag(c, 5) OVER w - 1 AS return_5d, c / lag(c, 20) OVER w - 1 AS return_20d, c / lag(c, 20) OVER w - 1 AS momentum_20,
    CASE WHEN n >= 10 THEN avg(c) OVER (w ROWS 9 PRECEDING) END AS sma_10, CASE WHEN n >= 20 THEN avg(c) OVER (w ROWS 19 PRECEDING) END AS sma_20, CASE WHEN n >= 50 THEN avg(c) OVER (w ROWS 49 PRECEDING) END AS sma_50,
    CASE WHEN n >= 21 THEN stddev_samp(r) OVER (w ROWS 19 PRECEDING) * sqrt(252.0) END AS realized_vol_20,
    CASE WHEN n >= 20 THEN volume / avg(volume) OVER (w ROWS 19 PRECEDING) END AS volume_ratio,
    CASE WHEN n >= 21 THEN max(r) OVER (w ROWS 19 PRECEDING) END AS max_ret_1m
    FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""
RANKED = FEATURES + """,
  k AS (SELECT symbol, ts, CASE WHEN return_5d IS NULL THEN NULL WHEN count(return_5d) OVER (PARTITION BY ts) = 1 THEN 0.5
    ELSE (rank() OVER (PARTITION BY ts, return_5d IS NULL ORDER BY return_5d) - 1 + (count(*) OVER (PARTITION BY ts, return_5d) - 1) / 2.0)
      / (count(return_5d) OVER (PARTITION BY ts) - 1) END::DOUBLE AS rank_5d FROM f)"""


def oracle_sql():
    return {
        "bars": BARS + " SELECT * FROM b",
        "features": FEATURES + " SELECT * FROM f",
        "ranked": RANKED + " SELECT * FROM k",
        "selection": RANKED + """ SELECT symbol, ts, rank_5d FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY rank_5d DESC, symbol) AS i,
            count(*) OVER (PARTITION BY ts) AS n FROM k WHERE rank_5d IS NOT NULL) WHERE i <= greatest(1, ceil(n * 0.2))""",
        "drawdown": BARS + """ SELECT symbol, max(dd) AS max_drawdown FROM (SELECT symbol, 1 - adj_close / max(adj_close) OVER
            (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS dd FROM b) GROUP BY 1""",
        "coverage": BARS + """ SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS sessions,
            date_diff('day', max(ts), (SELECT max(ts) FROM b)) > 5 AS stale FROM b GROUP BY 1""",
        "crossover": FEATURES + """, p AS (SELECT *, CASE WHEN sma_10 > sma_50 THEN 1 ELSE 0 END AS pos FROM f),
            q AS (SELECT symbol, pos, coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY ts), 0) * coalesce(return_1d, 0.0) AS ret FROM p)
            SELECT symbol, sum(ret) AS total_ret, sum(pos)::BIGINT AS sessions_long FROM q GROUP BY 1""",
    }
