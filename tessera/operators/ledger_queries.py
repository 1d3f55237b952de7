"""Registered queries of ledgers, breakers, drift tests, source weights and vendor payloads, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import ledger, panel
from tessera.operators.panel_queries import HORIZON, _read, rounded, unrounded
from tessera.operators.queries import BARS, _bars
from tessera.sources import payloads

CASH = 1e6


def _orders(spark, sf_dir) -> DataFrame:
    """Purchases and clicks as orders to buy and sell; some come twice."""
    e = _read(spark, sf_dir, "events").where("event_type in ('purchase', 'click')")
    rows = e.select(
        F.col("event_id").alias("order_id"), (F.col("user_id") % 50).cast("string").alias("symbol"), F.when(F.col("event_type") == "purchase", "BUY").otherwise("SELL").alias("side"),
        (F.col("event_id") % 9 + 1).alias("quantity"), F.col("value").alias("price"), "ts",
    )
    return rows.unionByName(rows.where("order_id % 10 = 0"))


def _fills(spark, sf_dir) -> DataFrame:
    return ledger.positions(ledger.once_a_session(_orders(spark, sf_dir)))


def orders_once(spark, sf_dir):
    return ledger.once_a_session(_orders(spark, sf_dir)).select("order_id", "symbol", "side")


def fills(spark, sf_dir):
    return _fills(spark, sf_dir).select("order_id", "symbol", "side", F.col("filled").cast("long").alias("filled"), F.col("position").cast("long").alias("position"))


def equity(spark, sf_dir):
    return rounded(ledger.equity_by_day(_fills(spark, sf_dir), CASH), 4)


def breaker(spark, sf_dir):
    rows = _bars(spark, sf_dir).select("symbol", "ts", F.col("adj_close").alias("equity"))
    return ledger.breaker(rows, "symbol", 0.0)


def protective_exits(spark, sf_dir):
    b = _bars(spark, sf_dir)
    entries = b.select("symbol", "ts", (F.col("close") * 0.95).alias("stop"), (F.col("close") * 1.1).alias("target"))
    return rounded(ledger.exits(entries, b, HORIZON))


def source_weights(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select(F.col("event_type").alias("source"), "ts", "event_id", (F.col("value") / 100 - 0.4).alias("outcome"))
    return rounded(ledger.source_weights(e))


def _samples(spark, sf_dir):
    side = F.when(F.dayofmonth("ts") <= 15, "ref").otherwise("cur")
    return _read(spark, sf_dir, "events").select(F.col("event_type").alias("feature"), side.alias("side"), "value")


def drift_test(spark, sf_dir):
    return rounded(ledger.ks(_samples(spark, sf_dir)))


def drift_report(spark, sf_dir):
    rows = _samples(spark, sf_dir)
    both = panel.psi(rows).join(ledger.ks(rows), "feature")
    return rounded(both.select("feature", "psi", "ks", ledger.drift_action(F.col("psi"), F.col("p_value"), F.lit(0.9), F.lit(1.0), F.lit(0.52)).alias("action")))


def payload_bars(spark, sf_dir):
    """Bars landed as a vendor's JSON by symbol, one in a hundred with a missing price, and one symbol's payload an error; parsed again."""
    b = _bars(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    close = F.when(F.dayofyear("ts") % 100 == 7, ".").otherwise(text("close"))
    fields = F.create_map(*[x for k, v in (("1. open", text("open")), ("2. high", text("high")), ("3. low", text("low")), ("4. close", close), ("5. adjusted close", text("adj_close")), ("6. volume", text("volume"))) for x in (F.lit(k), v)])
    each = b.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("k"), fields.alias("v")))).alias("m"))  # a symbol's sessions
    whole = F.to_json(F.struct(F.col("m").alias("Time Series (Daily)")))
    landed = each.select("symbol", F.when(F.col("symbol") == "Brand#11", '{"Note": "call frequency"}').otherwise(whole).alias("payload"))
    return payloads.daily_bars(landed)


def payload_statements(spark, sf_dir):
    """Company facts by customer nation: concepts of revenue in two currencies, amendments, quarterly reports and shares; assembled to yearly statements."""
    o = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    y = o.groupBy(F.col("c_nationkey").cast("string").alias("cik"), F.year("o_orderdate").alias("y")).agg(F.floor(F.sum("o_totalprice")).cast("double").alias("v"), F.count("*").cast("double").alias("n"))
    fact = lambda val, form, fp, filed: F.struct(F.concat(F.col("y").cast("string"), F.lit("-12-31")).alias("end"), val.alias("val"), F.lit(form).alias("form"), F.lit(fp).alias("fp"), filed.alias("filed"))
    at = lambda md: F.concat((F.col("y") + 1).cast("string"), F.lit(md))
    first = F.array(fact(F.col("v"), "10-K", "FY", at("-02-15")), fact(F.col("v") + 1, "10-K/A", "FY", at("-05-15")), fact(F.col("v") / 4, "10-Q", "Q1", at("-01-15")))
    some = lambda when, x: F.collect_list(F.when(when, x))
    rows = y.groupBy("cik").agg(
        F.flatten(some(F.col("y") % 3 != 1, first)).alias("a"), some(F.col("y") % 2 == 0, fact(F.col("v") * 2, "10-K", "FY", at("-03-01"))).alias("b"),
        F.collect_list(fact(F.col("n"), "10-K", "FY", F.when(F.col("y") % 3 != 0, at("-04-01")))).alias("c"), F.collect_list(fact(F.col("v") * 7, "10-K", "FY", at("-02-01"))).alias("e"),
        F.collect_list(fact(F.col("n") * 10, "10-K", "FY", at("-03-15"))).alias("s"),
    )
    units = lambda **by: F.struct(F.create_map(*[x for unit, c in by.items() for x in (F.lit(unit), F.col(c))]).alias("units"))
    tags = F.create_map(
        F.lit("Revenues"), units(EUR="e", USD="a"), F.lit("RevenueFromContractWithCustomerExcludingAssessedTax"), units(USD="b"), F.lit("Assets"), units(USD="c"),
        F.lit("CommonStockSharesOutstanding"), units(shares="s"), F.lit("ProfitLoss"), units(USD="e"),
    )
    landed = rows.select("cik", F.to_json(F.struct(F.struct(tags.alias("us-gaap")).alias("facts"))).alias("payload"))
    return payloads.statements(payloads.annual_facts(landed), newest=3)


def payload_macro(spark, sf_dir):
    """Macro vintages landed as JSON with dots for missing values and repeated rows; parsed and covered."""
    o = _read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.date_trunc("month", "o_orderdate").cast("date").alias("d")).agg(F.floor(F.avg("o_totalprice")).alias("v"))
    value = F.when(F.month("d") == 5, ".").otherwise(F.col("v").cast("string"))
    x = F.struct(F.col("d").cast("string").alias("date"), F.when(F.month("d") != 7, F.date_add("d", 40).cast("string")).alias("realtime_start"), value.alias("value"))
    landed = o.groupBy("series").agg(F.sort_array(F.collect_list(x)).alias("o")).select("series", F.to_json(F.struct(F.concat("o", "o").alias("observations"))).alias("payload"))
    return payloads.macro_coverage(payloads.macro_observations(landed))


def queries():
    made = [orders_once, fills, equity, breaker, protective_exits, source_weights, drift_test, drift_report, payload_bars, payload_statements, payload_macro]
    return {q.__name__: q for q in made}


ORDERS = """WITH o AS (SELECT event_id AS order_id, (user_id % 50)::VARCHAR AS symbol, CASE event_type WHEN 'purchase' THEN 'BUY' ELSE 'SELL' END AS side, event_id % 9 + 1 AS quantity, value AS price, ts FROM events WHERE event_type IN ('purchase', 'click')),
  u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY symbol, side, ts::DATE ORDER BY ts, order_id) = 1),
  r AS (SELECT *, sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END) OVER (PARTITION BY symbol ORDER BY ts, order_id ROWS UNBOUNDED PRECEDING) AS s FROM u),
  p AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY symbol ORDER BY ts, order_id ROWS UNBOUNDED PRECEDING)) AS position FROM r),
  f AS (SELECT *, abs(position - coalesce(lag(position) OVER (PARTITION BY symbol ORDER BY ts, order_id), 0)) AS filled FROM p)"""
KS = """WITH s AS (SELECT event_type AS feature, day(ts) <= 15 AS ref, value FROM events WHERE value IS NOT NULL), v AS (SELECT feature, value, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM s GROUP BY 1, 2),
  g AS (SELECT feature, r, c, abs(sum(r) OVER w / sum(r) OVER (PARTITION BY feature) - sum(c) OVER w / sum(c) OVER (PARTITION BY feature)) AS gap FROM v WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
  k AS (SELECT feature, sum(r)::BIGINT AS n_ref, sum(c)::BIGINT AS n_cur, max(gap) AS ks FROM g GROUP BY 1),
  t AS (SELECT *, greatest(0, least(1, list_sum(list_transform(range(1, 51), lambda i: CASE WHEN i % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0::DOUBLE * i * i * pow(greatest(sqrt(n_ref * n_cur / (n_ref + n_cur)) * ks, 0.2::DOUBLE), 2)))))) AS p_value FROM k)"""


def oracle_sql():
    return {
        "orders_once": ORDERS + " SELECT order_id, symbol, side FROM u",
        "fills": ORDERS + " SELECT order_id, symbol, side, filled::BIGINT AS filled, position::BIGINT AS position FROM f",
        "equity": ORDERS + f""", c AS (SELECT ts::DATE AS day, sum(CASE side WHEN 'BUY' THEN -filled * price * 1.0005::DOUBLE ELSE filled * price * 0.9995::DOUBLE END) AS flow FROM f GROUP BY 1),
            l AS (SELECT symbol, ts::DATE AS day, arg_max(position * price, (ts, order_id)) AS worth FROM f GROUP BY 1, 2),
            h AS (SELECT day, sum(ch) AS ch FROM (SELECT day, worth - coalesce(lag(worth) OVER (PARTITION BY symbol ORDER BY day), 0) AS ch FROM l) GROUP BY 1),
            e AS (SELECT day, {CASH} + sum(flow) OVER (ORDER BY day) AS cash, sum(ch) OVER (ORDER BY day) AS exposure FROM c JOIN h USING (day))
            SELECT day, round(cash, 4) AS cash, round(exposure, 4) AS exposure, round(cash + exposure, 4) AS equity FROM e""",
        "breaker": unrounded(BARS + """, x AS (SELECT symbol, ts, adj_close AS equity, 1 - adj_close / max(adj_close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS drawdown,
              greatest(0, 1 - adj_close / first(adj_close) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts)) AS daily_loss FROM b)
            SELECT symbol, ts, round(equity, 6) AS equity, round(drawdown, 6) AS drawdown, round(daily_loss, 6) AS daily_loss, CASE WHEN bool_or(drawdown >= 0.15::DOUBLE) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) THEN 'BLACK'
              WHEN daily_loss >= 0.05::DOUBLE THEN 'RED' WHEN drawdown >= 0.08::DOUBLE THEN 'YELLOW' ELSE 'NONE' END AS level FROM x"""),
        "protective_exits": BARS + f""", x AS (SELECT symbol, ts, close, list({{'t': ts, 'c': close}}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {HORIZON} FOLLOWING) AS nx FROM b),
            y AS (SELECT *, list_filter(nx, lambda z: z.c <= close * 0.95::DOUBLE OR z.c >= close * 1.1::DOUBLE)[1] AS hit FROM x)
            SELECT symbol, ts, hit.t AS exit_ts, round(hit.c, 6) AS exit_price, CASE WHEN hit.c <= close * 0.95::DOUBLE THEN 'stop' ELSE 'target' END AS reason FROM y WHERE hit.c IS NOT NULL""",
        "source_weights": """WITH l AS (SELECT event_type AS source, value / 100 - 0.4::DOUBLE AS o FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 60),
            e AS (SELECT source, count(*) AS outcomes, avg((o > 0)::INTEGER) AS hit_rate, avg(o) AS mean_return, coalesce(avg(o) / nullif(stddev_samp(o), 0), 0) AS ratio FROM l GROUP BY 1),
            r AS (SELECT *, exp(least(2 * ratio, 500)) / sum(exp(least(2 * ratio, 500))) OVER () AS w FROM e), c AS (SELECT *, greatest(0.05::DOUBLE, least(0.6::DOUBLE, w)) AS k FROM r)
            SELECT source, outcomes, round(hit_rate, 6) AS hit_rate, round(mean_return, 6) AS mean_return, round(ratio, 6) AS ratio, round(k / sum(k) OVER (), 6) AS weight FROM c""",
        "drift_test": KS + " SELECT feature, n_ref, n_cur, round(ks, 6) AS ks, round(p_value, 6) AS p_value FROM t",
        "drift_report": KS + """, rg AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM s WHERE ref GROUP BY 1), bn AS (SELECT feature, ref, greatest(0, least(9, floor((value - lo) / (hi - lo) * 10))) AS bin FROM s JOIN rg USING (feature)),
            gd AS (SELECT feature, i AS bin FROM rg, range(10) q(i)), ct AS (SELECT gd.feature, gd.bin, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM gd LEFT JOIN bn ON gd.feature = bn.feature AND gd.bin = bn.bin GROUP BY 1, 2),
            pq AS (SELECT feature, (r + 1e-6) / (sum(r) OVER w + 1e-5) AS p, (c + 1e-6) / (sum(c) OVER w + 1e-5) AS q FROM ct WINDOW w AS (PARTITION BY feature)), ps AS (SELECT feature, sum((q - p) * ln(q / p)) AS psi FROM pq GROUP BY 1)
            SELECT feature, round(psi, 6) AS psi, round(ks, 6) AS ks, CASE WHEN psi > 0.2::DOUBLE THEN 'auto_retrain' WHEN p_value < 0.01::DOUBLE THEN 'alert_and_monitor' ELSE 'no_action' END AS action FROM ps JOIN t USING (feature)""",
        "payload_bars": unrounded(BARS + """ SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(adj_close, 6) AS adj_close, volume FROM b
            WHERE symbol <> 'Brand#11' AND dayofyear(ts) % 100 <> 7"""),
        "payload_statements": """WITH y AS (SELECT c_nationkey::VARCHAR AS cik, year(o_orderdate) AS y, floor(sum(o_totalprice))::DOUBLE AS v, count(*)::DOUBLE AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
            SELECT cik, make_date(y, 12, 31) AS period_end, CASE WHEN y % 3 <> 1 THEN v WHEN y % 2 = 0 THEN v * 2 END AS revenue, NULL::DOUBLE AS gross_profit, NULL::DOUBLE AS cost_of_revenue, NULL::DOUBLE AS net_income, n AS total_assets,
              NULL::DOUBLE AS total_liabilities, NULL::DOUBLE AS current_assets, NULL::DOUBLE AS current_liabilities, n * 10 AS shares_outstanding, NULL::DOUBLE AS operating_cash_flow, NULL::DOUBLE AS eps, CASE WHEN y % 3 <> 0 THEN make_date(y + 1, 4, 1) END AS filed_at
            FROM y QUALIFY row_number() OVER (PARTITION BY cik ORDER BY y DESC) <= 3""",
        "payload_macro": """WITH o AS (SELECT DISTINCT o_orderpriority AS series, date_trunc('month', o_orderdate)::DATE AS d FROM orders) SELECT series, count(*) AS observations, count(*) FILTER (month(d) = 7) AS undated, min(d) AS first_date, max(d) AS last_date
            FROM o WHERE month(d) <> 5 GROUP BY 1""",
    }
