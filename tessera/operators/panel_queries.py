"""Registered queries of the technical and panel operators and their SQL for DuckDB; doubles are rounded in both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import market, panel
from tessera.operators import technical as tech
from tessera.operators.queries import BARS, _bars

HORIZON = 63  # daily bars in a quarter


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def unrounded(sql: str) -> str:
    """A twin whose doubles are as they are: each ``round(x, 6)`` becomes ``(x)``."""
    while (at := sql.find("round(")) >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[at + 6 : end - 1]
        sql = f"{sql[:at]}({inner.removesuffix(', 6')}){sql[end:]}" if inner.endswith(", 6") else f"{sql[:at]}ROUND({inner}){sql[end:]}"
    return sql


def technical(spark, sf_dir):
    return tech.technical(_bars(spark, sf_dir))


def recursive(spark, sf_dir):
    return rounded(tech.recursive(_bars(spark, sf_dir)).drop(*DIRECTIONAL))


DIRECTIONAL = ("macd_signal", "macd_hist", "plus_di_14", "minus_di_14", "adx_14")


def directional(spark, sf_dir):
    return rounded(tech.recursive(_bars(spark, sf_dir)).select("symbol", "ts", *DIRECTIONAL))


def triple_barrier(spark, sf_dir):
    return rounded(tech.triple_barrier(_bars(spark, sf_dir), HORIZON))


def latest_bars(spark, sf_dir):
    return panel.newest(_bars(spark, sf_dir), 10)


def _restated(spark, sf_dir):
    """A batch as a vendor would resend it: this year's bars, some with another adjustment, each twice."""
    b = _bars(spark, sf_dir).where("month(ts) <= 3")
    b = b.withColumn("adj_close", F.when(F.substring("symbol", -1, 1) == "1", F.col("adj_close") * 0.5).otherwise(F.col("adj_close")))
    return b.withColumn("seq", F.lit(1)).unionByName(b.withColumn("volume", F.col("volume") + 1).withColumn("seq", F.lit(2)))


def upsert(spark, sf_dir):
    return panel.upsert(_bars(spark, sf_dir), _restated(spark, sf_dir))


def restatements(spark, sf_dir):
    return panel.restated(_bars(spark, sf_dir), _restated(spark, sf_dir).where("seq = 2"))


def readback(spark, sf_dir):
    return rounded(panel.gaps(_bars(spark, sf_dir)))


def benchmark(spark, sf_dir):
    return rounded(panel.benchmark(_bars(spark, sf_dir)))


def neutral(spark, sf_dir):
    rows = market.features(_bars(spark, sf_dir)).select("symbol", "ts", "return_5d")
    rows = rows.withColumn("sector", F.regexp_extract("symbol", "[0-9]+", 0).cast("int") % 6)
    return rounded(panel.sector_neutral(rows, "return_5d"))


def _scored(spark, sf_dir):
    from pyspark.sql import Window

    nxt = F.lead("c").over(Window.partitionBy("symbol").orderBy("ts")) / F.col("c") - 1
    return market.features(_bars(spark, sf_dir)).select("symbol", "ts", "return_5d", nxt.alias("next_return"))


def rank_ic(spark, sf_dir):
    return rounded(panel.rank_ic(_scored(spark, sf_dir), "return_5d", "next_return"))


def auc(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("y", (F.col("next_return") > 0).cast("int"))
    return rounded(panel.auc(rows, "return_5d", "y", "symbol"))


def tail_risk(spark, sf_dir):
    return rounded(panel.tail_risk(market.features(_bars(spark, sf_dir)).select("symbol", F.col("return_1d").alias("ret"))))


def drift(spark, sf_dir):
    side = F.when(F.dayofmonth("ts") <= 15, "ref").otherwise("cur")
    return rounded(panel.psi(_read(spark, sf_dir, "events").select(F.col("event_type").alias("feature"), side.alias("side"), "value")))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statements by brand: sums of line items, filed some days after the quarter; some have no date."""
    rows = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    quarter = F.date_trunc("quarter", "l_shipdate")
    price = F.col("l_extendedprice")
    out = rows.groupBy(F.col("p_brand").alias("symbol"), F.add_months(quarter, 3).alias("period_end")).agg(
        F.sum(price).alias("revenue"), (F.sum(price * (1 - F.col("l_discount"))) * 0.6).alias("cost_of_revenue"),
        (F.sum(price * F.col("l_tax")) * 2).alias("net_income"), (F.sum("l_quantity") * 1000).alias("total_assets"), (F.sum(price * F.col("l_discount")) * 4).alias("total_liabilities"),
    )
    b = F.regexp_extract("symbol", "[0-9]+", 0).cast("int")
    filed = F.when(b % 11 != 0, F.date_add("period_end", 20 + b).cast("timestamp"))
    return out.select("*", F.lit(None).cast("double").alias("gross_profit"), filed.alias("filed_at"))


def fundamentals_asof(spark, sf_dir):
    sessions = _bars(spark, sf_dir).select("symbol", "ts")
    return rounded(panel.latest_filing(sessions, filings(spark, sf_dir)).select("symbol", "ts", "filing.period_end", *panel.ratios()))


def macro_asof(spark, sf_dir):
    """What was known of each order priority's monthly mean at the start of each month: first values, then revisions."""
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series"), F.date_trunc("month", "o_orderdate").cast("date").alias("observation_date"), "o_orderstatus", F.col("o_totalprice").alias("x"))
    both = rows.groupBy("series", "observation_date").agg(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("x"))).alias("first"), F.avg("x").alias("revised"))
    vintage = lambda c, days: both.select("series", "observation_date", F.date_add("observation_date", days).alias("realtime_start"), F.col(c).alias("value"))
    seen = vintage("first", 40).unionByName(vintage("revised", 100)).where("value is not null")
    days = both.select("series", F.add_months("observation_date", 2).alias("day"))
    return rounded(panel.visible_vintages(days, seen))


def status_changes(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return panel.changes(rows, "event_type", "user_id", ["ts", "event_id"]).drop("ts")


def signal_votes(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    signal = F.when(F.col("event_id") % 3 == 0, "BUY").when(F.col("event_id") % 3 == 1, "SELL").otherwise("HOLD")
    signals = e.select(F.col("user_id").alias("symbol"), F.col("event_type").alias("source"), F.struct("ts", "event_id").alias("at"), signal.alias("signal"), (F.col("event_id") % 100 / 100).alias("confidence"))
    weights = e.select(F.col("event_type").alias("source")).distinct().withColumn("weight", F.lit(0.2))
    return rounded(panel.votes(signals, weights))


def queries():
    made = [technical, recursive, directional, triple_barrier, latest_bars, upsert, restatements, readback, benchmark, neutral, rank_ic, auc, tail_risk, drift, fundamentals_asof, macro_asof, status_changes, signal_votes]
    return {q.__name__: q for q in made}


ADJUSTED = BARS + """,
  a AS (SELECT symbol, ts, close, adj_close AS c, high * (adj_close / close) AS h, low * (adj_close / close) AS l, volume AS v FROM b),
  n AS (SELECT *, (h + l + c) / 3 AS tp, row_number() OVER w AS n, c / lag(c) OVER w - 1 AS r, ln(c / lag(c) OVER w) AS lr, lag(ts) OVER w AS own
    FROM a WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""
SCORED = ADJUSTED + """,
  s AS (SELECT symbol, ts, r AS return_1d, c / lag(c, 5) OVER w - 1 AS return_5d, lead(c) OVER w / c - 1 AS next_return FROM n WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""
RESENT = BARS + """,
  q AS (SELECT * REPLACE (CASE WHEN right(symbol, 1) = '1' THEN adj_close * 0.5::DOUBLE ELSE adj_close END AS adj_close, volume + 1 AS volume) FROM b WHERE month(ts) <= 3)"""


def _technical_sql() -> str:
    w = "(w ROWS {} PRECEDING)"
    over = lambda f, k: f"{f} OVER {w.format(k - 1)}"
    twenty, gates = "20 PRECEDING AND 1 PRECEDING", []
    first = f"""{ADJUSTED}, m AS (SELECT *, close * v AS dv, sign(c - lag(c) OVER w) * v AS signed, tp - lag(tp) OVER w AS dtp, tp * v AS flow,
        CASE WHEN h > l THEN (2 * c - l - h) / (h - l) * v ELSE 0 END AS ad, {over('max(h)', 14)} AS hi14, {over('min(l)', 14)} AS lo14
        FROM n WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
      o AS (SELECT *, CASE WHEN n >= 14 AND hi14 > lo14 THEN 100 * (c - lo14) / (hi14 - lo14) END AS k,
        coalesce(sum(signed) OVER (w ROWS UNBOUNDED PRECEDING), 0) AS obv, sum(ad) OVER (w ROWS UNBOUNDED PRECEDING) AS adl,
        {over('avg(c)', 20)} AS mid, {over('stddev_pop(c)', 20)} AS sd, {over('avg(tp)', 20)} AS mtp, {over('list(tp)', 20)} AS tps,
        {over('avg(v)', 20)} AS av, {over('avg(dv)', 20)} AS adv, max(h) OVER (w ROWS BETWEEN {twenty}) AS ch, min(l) OVER (w ROWS BETWEEN {twenty}) AS cl,
        {over('sum(CASE WHEN dtp > 0 THEN flow ELSE 0 END)', 20)} AS up, {over('sum(CASE WHEN dtp < 0 THEN flow ELSE 0 END)', 20)} AS down,
        {over('list(h)', 26)} AS hs, {over('list(l)', 26)} AS ls FROM m WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
      p AS (SELECT *, list_avg(list_transform(tps, lambda x: abs(x - mtp))) AS mad FROM o)"""
    for name, least, x in [
        ("price_to_sma50", 50, f"c / {over('avg(c)', 50)}"),
        ("downside_vol_20", 21, f"sqrt({over('avg(pow(least(r, 0), 2))', 20)}) * sqrt(252)"),
        ("dollar_volume_20", 21, "CASE WHEN adv > 0 THEN adv END"),
        ("amihud_20", 21, f"{over('avg(CASE WHEN dv > 0 THEN abs(r) / dv END)', 20)} * 1e6"),
        ("skew_60", 61, f"{over('skewness(r)', 60)} * 58 / sqrt(60 * 59) * pow(59 / 60, 1.5)"),
        ("momentum_6_1", 127, "lag(c, 21) OVER w / lag(c, 126) OVER w - 1"),
        ("momentum_12_1", 253, "lag(c, 21) OVER w / lag(c, 252) OVER w - 1"),
        ("dist_52w_high", 252, f"c / {over('max(c)', 252)}"),
        ("bb_upper", 20, "mid + 2 * sd"), ("bb_lower", 20, "mid - 2 * sd"),
        ("bb_pct_b", 20, "CASE WHEN sd > 0 THEN (c - mid + 2 * sd) / (4 * sd) END"), ("bb_width", 20, "4 * sd / mid"),
        ("donchian_high_20", 21, "ch"), ("donchian_low_20", 21, "cl"), ("donchian_pos_20", 21, "CASE WHEN ch > cl THEN (c - cl) / (ch - cl) END"),
        ("stoch_k_14", 15, "k"), ("stoch_d_14", 16, f"CASE WHEN {over('count(k)', 3)} = 3 THEN {over('avg(k)', 3)} END"),
        ("cci_20", 20, "CASE WHEN mad > 0 THEN (tp - mtp) / (0.015::DOUBLE * mad) END"),
        ("vwap_ratio_20", 20, f"c / ({over('sum(flow)', 20)} / {over('sum(v)', 20)})"),
        ("obv_slope_20", 20, f"{over('regr_slope(obv, n)', 20)} / av"), ("ad_slope_20", 20, f"{over('regr_slope(adl, n)', 20)} / av"),
        ("mfi_14", 21, "CASE WHEN down > 0 THEN 100 - 100 / (1 + up / down) WHEN up > 0 THEN 100 END"),
        ("aroon_up_25", 26, "100.0::DOUBLE * (list_position(hs, list_max(hs)) - 1) / 25"), ("aroon_down_25", 26, "100.0::DOUBLE * (list_position(ls, list_min(ls)) - 1) / 25"), ("aroon_osc_25", 26, "100.0::DOUBLE * (list_position(hs, list_max(hs)) - list_position(ls, list_min(ls))) / 25"),
    ]:
        gates.append(f"round(CASE WHEN n >= {least} THEN {x} END, 6) AS {name}")
    return f"{first} SELECT symbol, ts, {', '.join(gates)} FROM p WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


def _recursive_sql() -> str:
    def smooth(xs: str, k: int, a: str) -> str:
        return f"CASE WHEN len({xs}) >= {k} THEN list_reduce({xs}[{k + 1}:], lambda e, x: e * (1 - {a}) + x * {a}, list_avg({xs}[1:{k}])) END"

    many = "OVER (w ROWS 298 PRECEDING)"
    return f"""{ADJUSTED}, d AS (SELECT *, lag(c) OVER w AS p FROM n WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
      g AS (SELECT symbol, ts, c, n, avg(c) OVER (w ROWS 19 PRECEDING) AS mid, list(c) OVER (w ROWS 299 PRECEDING) AS cs, list(greatest(c - p, 0)) FILTER (p IS NOT NULL) {many} AS ups,
        list(greatest(p - c, 0)) FILTER (p IS NOT NULL) {many} AS downs, list(greatest(h - l, abs(h - p), abs(l - p))) FILTER (p IS NOT NULL) {many} AS spans FROM d WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
      k AS (SELECT symbol, ts, c, n, mid, CASE WHEN n >= 26 THEN {smooth('cs', 12, '(2::DOUBLE / 13)')} END AS e12, {smooth('cs', 26, '(2::DOUBLE / 27)')} AS e26,
        {smooth('ups', 14, '(1::DOUBLE / 14)')} AS up, {smooth('downs', 14, '(1::DOUBLE / 14)')} AS down, {smooth('spans', 14, '(1::DOUBLE / 14)')} AS atr FROM g)
      SELECT symbol, ts, round(e12, 6) AS ema_12, round(e26, 6) AS ema_26, round(e12 - e26, 6) AS macd,
        round(CASE WHEN down > 0 THEN 100 - 100 / (1 + up / down) WHEN up > 0 THEN 100 WHEN up = 0 THEN 50 END, 6) AS rsi_14, round(atr, 6) AS atr_14, round(atr / c, 6) AS atr_pct_14,
        round(CASE WHEN n >= 20 AND atr > 0 THEN (c - mid) / (2 * atr) END, 6) AS keltner_pos_20 FROM k"""


def _directional_sql() -> str:
    wilder = lambda x: f"(CASE WHEN a.k < 14 THEN a.{x} + x.{x} ELSE a.{x} * 13 / 14 + x.{x} END)"
    smooth = lambda x, n: f"(CASE WHEN a.k < {n} THEN a.{x} + x.c / {n} ELSE a.{x} * (1 - 2::DOUBLE / {n + 1}) + x.c * 2 / {n + 1} END)"
    ps, ms = wilder("ps"), wilder("ms")
    known = f"(a.k >= 13 AND {ps} + {ms} > 0)"
    dx = f"100 * abs({ps} - {ms}) / ({ps} + {ms})"
    moves = f"""{{'k': a.k + 1, 'tr': {wilder('tr')}, 'ps': {ps}, 'ms': {ms}, 'dn': a.dn + CASE WHEN {known} THEN 1 ELSE 0 END,
        'adx': CASE WHEN {known} THEN CASE WHEN a.dn < 14 THEN a.adx + {dx} / 14 ELSE (a.adx * 13 + {dx}) / 14 END ELSE a.adx END}}"""
    m = f"({smooth('e', 12)} - {smooth('f', 26)})"
    lines = f"""{{'k': a.k + 1, 'c': x.c, 'e': {smooth('e', 12)}, 'f': {smooth('f', 26)}, 'm': {m},
        's': CASE WHEN a.k < 25 THEN 0 WHEN a.k < 34 THEN a.s + {m} / 9 ELSE a.s * 0.8::DOUBLE + {m} * 0.2::DOUBLE END}}"""
    return f"""{ADJUSTED}, d AS (SELECT *, lag(c) OVER w AS p, h - lag(h) OVER w AS upm, lag(l) OVER w - l AS dnm FROM n WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
      g AS (SELECT symbol, ts, n,
        list({{'k': 0, 'tr': greatest(h - l, abs(h - p), abs(l - p)), 'ps': CASE WHEN upm > dnm AND upm > 0 THEN upm ELSE 0::DOUBLE END,
          'ms': CASE WHEN dnm > upm AND dnm > 0 THEN dnm ELSE 0::DOUBLE END, 'dn': 0, 'adx': 0::DOUBLE}}) FILTER (p IS NOT NULL) OVER (w ROWS 298 PRECEDING) AS mv,
        list({{'k': 0, 'c': c, 'e': 0::DOUBLE, 'f': 0::DOUBLE, 'm': 0::DOUBLE, 's': 0::DOUBLE}}) OVER (w ROWS 299 PRECEDING) AS cs FROM d WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
      z AS (SELECT symbol, ts, n, list_reduce(mv, lambda a, x: {moves}, {{'k': 0, 'tr': 0::DOUBLE, 'ps': 0::DOUBLE, 'ms': 0::DOUBLE, 'dn': 0, 'adx': 0::DOUBLE}}) AS v,
        list_reduce(cs, lambda a, x: {lines}, {{'k': 0, 'c': 0::DOUBLE, 'e': 0::DOUBLE, 'f': 0::DOUBLE, 'm': 0::DOUBLE, 's': 0::DOUBLE}}) AS u FROM g)
      SELECT symbol, ts, round(CASE WHEN n >= 34 THEN u.s END, 6) AS macd_signal, round(CASE WHEN n >= 34 THEN u.m - u.s END, 6) AS macd_hist,
        round(CASE WHEN n >= 29 AND v.dn >= 14 THEN 100 * v.ps / v.tr END, 6) AS plus_di_14, round(CASE WHEN n >= 29 AND v.dn >= 14 THEN 100 * v.ms / v.tr END, 6) AS minus_di_14,
        round(CASE WHEN n >= 29 AND v.dn >= 14 THEN v.adx END, 6) AS adx_14 FROM z"""


def oracle_sql():
    return {
        "directional": _directional_sql(),
        "technical": unrounded(_technical_sql()),
        "recursive": _recursive_sql(),
        "triple_barrier": ADJUSTED + f""", g AS (SELECT *, CASE WHEN n > 20 THEN stddev_samp(lr) OVER (w ROWS 19 PRECEDING) END AS sigma,
              list({{'n': n, 'h': h, 'l': l, 'c': c}}) OVER (w ROWS BETWEEN 1 FOLLOWING AND {HORIZON} FOLLOWING) AS nx FROM n WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
            k AS (SELECT * REPLACE (CASE WHEN sigma > 0 THEN sigma END AS sigma), c * (1 + sigma * sqrt({HORIZON})) AS hi, c * (1 - sigma * sqrt({HORIZON})) AS lo FROM g),
            f AS (SELECT *, list_filter(nx, lambda x: x.l <= lo OR x.h >= hi)[1] AS hit, nx[{HORIZON}] AS fin FROM k),
            z AS (SELECT *, CASE WHEN sigma IS NULL THEN NULL WHEN hit.l <= lo THEN 'lower' WHEN hit.h >= hi THEN 'upper' WHEN len(nx) = {HORIZON} THEN 'vertical' END AS barrier FROM f)
            SELECT symbol, ts, round(sigma, 6) AS sigma, barrier, (CASE barrier WHEN 'vertical' THEN fin.n WHEN 'lower' THEN hit.n WHEN 'upper' THEN hit.n END - n)::INTEGER AS touch,
              (CASE barrier WHEN 'lower' THEN 0 WHEN 'upper' THEN 1 WHEN 'vertical' THEN (fin.c > c)::INTEGER END)::INTEGER AS label FROM z""",
        "latest_bars": BARS + " SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 10",
        "upsert": RESENT + """, u AS (SELECT * FROM q UNION ALL SELECT * FROM b ANTI JOIN q USING (symbol, ts))
            SELECT symbol, ts, open, high, low, close, volume, adj_close FROM u""",
        "restatements": RESENT + """ SELECT b.symbol, count(*) AS overlap, bool_or(abs(q.adj_close / q.close - b.adj_close / b.close) / (b.adj_close / b.close) > 1e-4) AS restated
            FROM b JOIN q USING (symbol, ts) GROUP BY 1""",
        "readback": BARS + """, m AS (SELECT symbol, adj_close, close / lag(close) OVER w - 1 AS move, date_diff('day', lag(ts) OVER w, ts) AS gap FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts))
            SELECT symbol, count(*) AS sessions, max(gap)::INTEGER AS max_gap_days, count(*) FILTER (move <= -0.45::DOUBLE OR move >= 0.8::DOUBLE) AS n_suspect,
              count(*) FILTER ((move <= -0.25::DOUBLE AND move > -0.45::DOUBLE) OR (move >= 0.5::DOUBLE AND move < 0.8::DOUBLE)) AS n_notable, round(count(adj_close) / count(*), 6) AS adj_coverage FROM m GROUP BY 1""",
        "benchmark": ADJUSTED + """, k AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS before FROM (SELECT DISTINCT ts FROM n)),
            s AS (SELECT ts, count(lr) FILTER (own = before) AS names, median(lr) FILTER (own = before) AS m FROM n JOIN k USING (ts) GROUP BY 1)
            SELECT ts, names, round(exp(sum(CASE WHEN names >= 3 THEN m ELSE 0 END) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)), 6) AS level FROM s""",
        "neutral": SCORED + """, g AS (SELECT symbol, ts, return_5d, regexp_extract(symbol, '[0-9]+')::INTEGER % 6 AS sector FROM s),
            k AS (SELECT *, CASE WHEN count(return_5d) OVER (PARTITION BY ts, sector) >= 4 THEN sector END AS grp FROM g)
            SELECT symbol, ts, round(return_5d - CASE WHEN count(return_5d) OVER w >= 4 THEN median(return_5d) OVER w ELSE 0 END, 6) AS return_5d, sector FROM k WINDOW w AS (PARTITION BY ts, grp)""",
        "rank_ic": SCORED + """, d AS (SELECT * FROM s WHERE return_5d IS NOT NULL AND next_return IS NOT NULL),
            k AS (SELECT ts, rank() OVER (PARTITION BY ts ORDER BY return_5d) + (count(*) OVER (PARTITION BY ts, return_5d) - 1) / 2 AS x,
              rank() OVER (PARTITION BY ts ORDER BY next_return) + (count(*) OVER (PARTITION BY ts, next_return) - 1) / 2 AS y FROM d)
            SELECT ts, count(*) AS n, round(CASE WHEN count(*) < 3 OR stddev_pop(x) = 0 OR stddev_pop(y) = 0 THEN 0 ELSE corr(x, y) END, 6) AS ic FROM k GROUP BY 1""",
        "auc": SCORED + """, d AS (SELECT symbol, return_5d, (next_return > 0)::INTEGER AS y FROM s WHERE return_5d IS NOT NULL AND next_return IS NOT NULL),
            k AS (SELECT symbol, y, rank() OVER (PARTITION BY symbol ORDER BY return_5d) + (count(*) OVER (PARTITION BY symbol, return_5d) - 1) / 2 AS rk FROM d)
            SELECT symbol, count(*) AS n, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auc FROM k GROUP BY 1""",
        "tail_risk": SCORED + """, d AS (SELECT symbol, return_1d AS ret, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY return_1d) AS k FROM s WHERE return_1d IS NOT NULL)
            SELECT symbol, max(n) AS n, round(greatest(-max(ret), 0), 6) AS var, round(greatest(-avg(ret), 0), 6) AS cvar FROM d
            WHERE n >= 20 AND k <= greatest(ceil(round(0.05::DOUBLE * n, 9)), 1) GROUP BY 1""",
        "drift": """WITH s AS (SELECT event_type AS feature, day(ts) <= 15 AS ref, value FROM events WHERE value IS NOT NULL),
            r AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM s WHERE ref GROUP BY 1),
            k AS (SELECT feature, ref, greatest(0, least(9, CASE WHEN hi > lo THEN floor((value - lo) / (hi - lo) * 10) WHEN value < lo THEN 0 WHEN value > hi THEN 9 ELSE 5 END)) AS bin FROM s JOIN r USING (feature)),
            g AS (SELECT feature, i AS bin FROM r, range(10) t(i)),
            c AS (SELECT g.feature, g.bin, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM g LEFT JOIN k ON g.feature = k.feature AND g.bin = k.bin GROUP BY 1, 2),
            p AS (SELECT feature, (r + 1e-6) / (sum(r) OVER w + 1e-5) AS p, (c + 1e-6) / (sum(c) OVER w + 1e-5) AS q FROM c WINDOW w AS (PARTITION BY feature))
            SELECT feature, round(sum((q - p) * ln(q / p)), 6) AS psi FROM p GROUP BY 1""",
        "fundamentals_asof": BARS + """, f AS (SELECT p_brand AS symbol, (date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH)::DATE AS period_end, sum(l_extendedprice) AS revenue,
              sum(l_extendedprice * (1 - l_discount)) * 0.6::DOUBLE AS cost, sum(l_extendedprice * l_tax) * 2 AS income, sum(l_quantity) * 1000 AS assets, sum(l_extendedprice * l_discount) * 4 AS debt
              FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
            d AS (SELECT *, (period_end + (20 + regexp_extract(symbol, '[0-9]+')::INTEGER))::TIMESTAMP AS filed_at FROM f WHERE regexp_extract(symbol, '[0-9]+')::INTEGER % 11 <> 0)
            SELECT b.symbol, b.ts, d.period_end, round(income / nullif(revenue, 0), 6) AS net_margin, round(income / nullif(assets, 0), 6) AS roa, round(debt / nullif(assets, 0), 6) AS leverage,
              round((revenue - cost) / nullif(assets, 0), 6) AS gross_profitability FROM b ASOF LEFT JOIN d ON b.symbol = d.symbol AND b.ts > d.filed_at""",
        "macro_asof": """WITH m AS (SELECT o_orderpriority AS series, date_trunc('month', o_orderdate)::DATE AS od, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS first, avg(o_totalprice) AS revised FROM orders GROUP BY 1, 2),
            v AS (SELECT series, od, od + 40 AS rs, first AS value FROM m WHERE first IS NOT NULL UNION ALL SELECT series, od, od + 100, revised FROM m WHERE revised IS NOT NULL),
            a AS (SELECT series, (od + INTERVAL 2 MONTH)::DATE AS day FROM m)
            SELECT a.series, a.day, max(od) AS observation_date, round(arg_max(value, (od, rs)), 6) AS value FROM a LEFT JOIN v ON a.series = v.series AND greatest(od, rs) <= day GROUP BY 1, 2""",
        "status_changes": """SELECT user_id, event_id, event_type, lag(event_type) OVER w AS before FROM events
            WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY event_type IS DISTINCT FROM before""",
        "signal_votes": """WITH s AS (SELECT user_id AS symbol, event_type, arg_max(CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END * ((event_id % 100)::DOUBLE / 100), (ts, event_id)) AS x FROM events GROUP BY 1, 2),
            v AS (SELECT symbol, round(sum(x * 0.2::DOUBLE), 9) AS score FROM s GROUP BY 1)
            SELECT symbol, round(score, 6) AS score, CASE WHEN score >= 0.2::DOUBLE THEN 'BUY' WHEN score <= -0.2::DOUBLE THEN 'SELL' ELSE 'HOLD' END AS signal, round(least(abs(score), 1), 6) AS confidence FROM v""",
    }
