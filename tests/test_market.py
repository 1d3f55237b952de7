"""Every registered market query against its SQL in DuckDB."""

import duckdb
import pytest
from pyspark.sql import SparkSession

from tessera.operators import gate_queries, ledger_queries, model_queries, panel_queries, report_queries, research_queries, study_queries
from tessera.operators import queries as market_queries

TOLERANCE = 2e-6  # results are rounded to 6 digits
SF = "/root/testdata/sf0.01"
QUERIES = market_queries.queries() | panel_queries.queries() | study_queries.queries() | ledger_queries.queries() | research_queries.queries() | gate_queries.queries() | model_queries.queries() | report_queries.queries()
SQL = market_queries.oracle_sql() | panel_queries.oracle_sql() | study_queries.oracle_sql() | ledger_queries.oracle_sql() | research_queries.oracle_sql() | gate_queries.oracle_sql() | model_queries.oracle_sql() | report_queries.oracle_sql()


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders", "events", "supplier", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got)
    keys = [c for c in ("symbol", "account", "name", "ts", "user_id", "event_id", "series", "day", "feature", "rule", "n", "fold", "split", "role", "a", "b", "aum", "period_end", "order_id", "source", "cik", "strategy", "model_id", "horizon", "delay", "width", "sector", "event_type", "title", "signal", "candidate", "condition", "observation_date", "block", "path", "excess", "message", "at", "decided_at") if c in got.columns]
    got, want = (x.sort_values(keys).reset_index(drop=True)[sorted(x.columns)] for x in (got, want))
    assert len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f":
            assert (got[c].isna() == want[c].isna()).all() and ((got[c] - want[c]).abs().fillna(0) < TOLERANCE * (1 + want[c].abs().fillna(0))).all(), c
        else:
            text = [x[c].astype(str).replace({"NaT": "None", "nan": "None", "<NA>": "None"}) for x in (got, want)]  # nulls differ by type
            assert (text[0] == text[1]).all(), c
