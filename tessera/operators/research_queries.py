"""Registered queries of decay, calibration, sectors, trade filters, styles, health, alerts and votes, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import market, monitor, panel, research
from tessera.operators import technical as tech
from tessera.operators.panel_queries import HORIZON, _read, rounded
from tessera.operators.queries import FEATURES, _bars
from tessera.operators.study_queries import LABELS

NAMES, HORIZONS, DELAYS, WIDTHS, POINTS = ("return_5d", "realized_vol_20", "volume_ratio"), (1, 5, 10), (0, 1), (0.5, 1.0, 1.5), 200


def _decay(spark, sf_dir) -> DataFrame:
    b = _bars(spark, sf_dir)
    return research.alpha_decay(market.features(b), b, list(NAMES), list(HORIZONS), list(DELAYS))


def alpha_decay(spark, sf_dir):
    return rounded(_decay(spark, sf_dir))


def half_lives(spark, sf_dir):
    return rounded(research.half_lives(_decay(spark, sf_dir)))


def barrier_calibration(spark, sf_dir):
    from tessera.operators import study

    b = _bars(spark, sf_dir)
    return rounded(research.calibration(study.on_benchmark(tech.adjusted(b), panel.benchmark(b)), HORIZON, list(WIDTHS)))


def _brand():
    return F.regexp_extract("symbol", "[0-9]+", 0).cast("int")


def _with_next(spark, sf_dir) -> DataFrame:
    nxt = F.lead("c").over(Window.partitionBy("symbol").orderBy("ts")) / F.col("c") - 1
    return market.features(_bars(spark, sf_dir)).withColumn("next_return", nxt)


def sector_study(spark, sf_dir):
    """Evidence of each feature by itself and less its sector's median."""
    rows = _with_next(spark, sf_dir).withColumn("sector", _brand() % 6)

    def table(neutral: bool) -> DataFrame:
        parts = []
        for name in NAMES:
            one = rows.select("symbol", "ts", "sector", "next_return", name)
            one = panel.sector_neutral(one, name) if neutral else one
            parts.append(one.select("ts", "next_return", F.lit(name).alias("feature"), F.col(name).alias("x")))
        long = parts[0].unionByName(parts[1]).unionByName(parts[2])
        return research.evidence(research.session_ics(long, ["feature"], "x", "next_return"), ["feature"], None, 1)

    return rounded(research.sector_gain(table(False), table(True)))


def _scored(spark, sf_dir) -> DataFrame:
    rows = _with_next(spark, sf_dir).withColumn("p", market.percentile_rank("return_5d"))
    return rows.where("p is not null and next_return is not null")


def meta_book(spark, sf_dir):
    """The book of the best fifth, and what is left of it where volume is not below its average."""
    labels = research.meta_labels(_scored(spark, sf_dir), "p", "next_return", 5 + 5 * (_brand() % 3))
    return rounded(research.meta_book(labels, F.col("volume_ratio") >= 1))


def long_short(spark, sf_dir):
    return rounded(research.long_short(_scored(spark, sf_dir), "p", "next_return"))


def model_votes(spark, sf_dir):
    rows = market.features(_bars(spark, sf_dir)).withColumn("p", market.percentile_rank("return_5d"))
    said = monitor.vote(F.col("p"), [F.col(c) for c in ("return_20d", "sma_50", "realized_vol_20")])
    return rounded(rows.select("symbol", "ts", said.alias("v")).where("v is not null").select("symbol", "ts", "v.*"))


RAW = (" Tech ", "FINANCE", "energy", "Industrial", "Utility", "moonshots")


def _companies(spark, sf_dir) -> DataFrame:
    """Customers as companies: growth of their orders, figures from their balance, a sector written freely."""
    o = _read(spark, sf_dir, "orders")
    of = lambda y: F.sum(F.when(F.year("o_orderdate") == y, F.col("o_totalprice")))
    grown = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(of(1997) / of(1996) - 1, 6).alias("growth"))
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    told = lambda x: F.when(k % 7 != 0, x)
    raw = F.element_at(F.array(*[F.lit(r) for r in RAW]), (k % 6 + 1).cast("int"))
    return _read(spark, sf_dir, "customer").join(grown, "c_custkey", "left").select(
        F.col("c_name").alias("symbol"), monitor.sector(raw).alias("sector"), F.when(k % 11 != 0, bal * 1e5 * (k % 300)).alias("market_cap"), told(bal / 200).alias("pe_ratio"),
        told(bal / 4000).alias("pb_ratio"), told(F.col("growth")).alias("revenue_growth"), F.lit(None).cast("double").alias("earnings_growth"), told((k % 50) / 1000).alias("dividend_yield"),
    )


def styles(spark, sf_dir):
    return monitor.styles(_companies(spark, sf_dir)).select("symbol", "sector", "growth_score", "value_score", "style", "basis", "tier", "model_stack", "style_growth", "style_value")


def sector_composition(spark, sf_dir):
    return rounded(research.sector_composition(_companies(spark, sf_dir)))


def _health(spark, sf_dir) -> DataFrame:
    rows = market.features(_bars(spark, sf_dir)).select(F.col("symbol").alias("strategy"), "ts", F.col("return_1d").alias("ret"))
    return monitor.strategy_health(rows)


def strategy_health(spark, sf_dir):
    return _health(spark, sf_dir)


def alerts(spark, sf_dir):
    """Changes of status, and each year's last ratio against the first one of its strategy: warnings only."""
    rows = _health(spark, sf_dir)
    moved = panel.changes(rows, "status", "strategy", ["ts"]).where("before is not null")
    made = monitor.status_alerts(moved.select("ts", "strategy", F.col("before").alias("old_status"), F.col("status").alias("new_status"), "reason", "sharpe"))
    first = rows.groupBy("strategy").agg(F.min_by("sharpe", "ts").alias("original"))
    last = rows.groupBy("strategy", F.year("ts").alias("y")).agg(F.max("ts").alias("ts"), F.max_by("sharpe", "ts").alias("current"))
    again = last.join(first, "strategy").withColumn("r", monitor.revalidated(F.col("original"), F.col("current")))
    made = made.unionByName(monitor.revalidation_alerts(again.select("ts", "strategy", "original", "current", "r.*")))
    return monitor.at_least(made, "warning")


def _signals(spark, sf_dir) -> DataFrame:
    k = F.col("event_id") % 3
    signal = F.when(k == 0, "BUY").when(k == 1, "SELL").otherwise("HOLD")
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), F.col("event_type").alias("source"), "ts", signal.alias("signal"), (F.col("event_id") % 100 / 100).alias("confidence"))


def _live(spark, sf_dir) -> DataFrame:
    return monitor.live_components(_signals(spark, sf_dir), F.lit("2024-01-15 00:00:00").cast("timestamp"), 48)


def live_components(spark, sf_dir):
    return _live(spark, sf_dir)


def best_levels(spark, sf_dir):
    return monitor.best_levels(_live(spark, sf_dir)).select("symbol", "signal", "source", "confidence")


def rolling_outcomes(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model_id"), "ts", (F.col("value") - 20).alias("outcome"))
    return rounded(monitor.rolling_outcomes(rows, 3, 21))


def thinned(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return monitor.thinned(rows, "event_type", "event_id", POINTS)


def queries():
    made = [alpha_decay, half_lives, barrier_calibration, sector_study, meta_book, long_short, model_votes, styles, sector_composition, strategy_health, alerts, live_components, best_levels, rolling_outcomes, thinned]
    return {q.__name__: q for q in made}


def _decay_sql() -> str:
    grid = " UNION ALL ".join(
        f"SELECT symbol, ts, '{n}' AS feature, {n} AS x, {h} AS horizon, {d} AS delay, lead(c, {d + h}) OVER w / CASE WHEN lead(c, {d}) OVER w > 0 THEN lead(c, {d}) OVER w END - 1 AS fwd FROM f WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
        for n in NAMES for h in HORIZONS for d in DELAYS
    )
    key, most = "feature, horizon, delay", max(HORIZONS)
    lags = ", ".join(f"e * lag(e, {k}) OVER (PARTITION BY {key} ORDER BY ts) AS e{k}" for k in range(1, most))
    sums = " + ".join(f"coalesce(sum(2 * greatest(0, 1 - {k}::DOUBLE / horizon) * e{k}), 0)" for k in range(1, most))
    return FEATURES + f""", gd AS ({grid}), gk AS (SELECT * FROM gd WHERE x IS NOT NULL AND fwd IS NOT NULL),
      rk AS (SELECT {key}, ts, rank() OVER (PARTITION BY {key}, ts ORDER BY x) + (count(*) OVER (PARTITION BY {key}, ts, x) - 1) / 2 AS a,
        rank() OVER (PARTITION BY {key}, ts ORDER BY fwd) + (count(*) OVER (PARTITION BY {key}, ts, fwd) - 1) / 2 AS b FROM gk),
      ic AS (SELECT {key}, ts, corr(a, b) AS ic FROM rk GROUP BY ALL HAVING count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0),
      ce AS (SELECT *, ic - avg(ic) OVER (PARTITION BY {key}) AS e FROM ic), lz AS (SELECT *, {lags} FROM ce),
      sm AS (SELECT {key}, count(*) AS n, avg(ic) AS ic_mean, sum(e * e) + {sums} AS s FROM lz GROUP BY ALL),
      pt AS (SELECT {key}, n, ic_mean, CASE WHEN n >= 2 AND s > 0 THEN ic_mean / (sqrt(s) / n) ELSE 0 END AS ic_t FROM sm)"""


def _study_sql() -> str:
    def one(n: str, neutral: bool) -> str:
        if not neutral:
            return f"SELECT ts, '{n}' AS feature, false AS nt, {n} AS x, nr FROM nx"
        grouped = f"SELECT *, CASE WHEN count({n}) OVER (PARTITION BY ts, sector) >= 4 THEN sector END AS grp FROM nx"
        return f"SELECT ts, '{n}', true, {n} - CASE WHEN count({n}) OVER w >= 4 THEN median({n}) OVER w ELSE 0 END, nr FROM ({grouped}) WINDOW w AS (PARTITION BY ts, grp)"

    every = " UNION ALL ".join(one(n, neutral) for n in NAMES for neutral in (False, True))
    return FEATURES + f""", nx AS (SELECT *, lead(c) OVER (PARTITION BY symbol ORDER BY ts) / c - 1 AS nr, regexp_extract(symbol, '[0-9]+')::INTEGER % 6 AS sector FROM f),
      lg AS (SELECT * FROM ({every}) WHERE x IS NOT NULL AND nr IS NOT NULL),
      rk AS (SELECT feature, nt, ts, rank() OVER (PARTITION BY feature, nt, ts ORDER BY x) + (count(*) OVER (PARTITION BY feature, nt, ts, x) - 1) / 2 AS a,
        rank() OVER (PARTITION BY feature, nt, ts ORDER BY nr) + (count(*) OVER (PARTITION BY feature, nt, ts, nr) - 1) / 2 AS b FROM lg),
      ic AS (SELECT feature, nt, ts, corr(a, b) AS ic FROM rk GROUP BY ALL HAVING count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0),
      sm AS (SELECT feature, nt, avg(ic) / (stddev_pop(ic) / sqrt(count(*))) AS t FROM ic GROUP BY ALL)
      SELECT p.feature, round(p.t, 6) AS t_plain, round(q.t, 6) AS t_neutral, round(abs(q.t) - abs(p.t), 6) AS t_gain, abs(p.t) >= 2 AS strong_plain, abs(q.t) >= 2 AS strong_neutral
      FROM sm p JOIN sm q USING (feature) WHERE NOT p.nt AND q.nt"""


def _calibration_sql() -> str:
    shares = ", ".join(f"avg((barrier = '{b}')::INTEGER) AS {b}_share" for b in ("lower", "upper", "vertical"))
    each = " UNION ALL ".join(
        "SELECT * FROM (" + LABELS.replace(f"sqrt({HORIZON}) AS width", f"sqrt({HORIZON}) * {w}::DOUBLE AS width") + f" SELECT {w}::DOUBLE AS width, count(*) AS labels, {shares}, avg(label) AS positive_rate FROM lb WHERE barrier IS NOT NULL)"
        for w in WIDTHS
    )
    return f"""WITH q AS ({each}) SELECT width, labels, round(lower_share, 6) AS lower_share, round(upper_share, 6) AS upper_share, round(vertical_share, 6) AS vertical_share, round(positive_rate, 6) AS positive_rate,
      row_number() OVER (ORDER BY lower_share + upper_share NOT BETWEEN 0.4 AND 0.7, abs(lower_share + upper_share - 0.55), width) = 1 AS recommended FROM q"""


RATED = FEATURES + """, nx AS (SELECT *, lead(c) OVER (PARTITION BY symbol ORDER BY ts) / c - 1 AS nr FROM f),
  pr AS (SELECT *, CASE WHEN return_5d IS NULL THEN NULL WHEN count(return_5d) OVER (PARTITION BY ts) = 1 THEN 0.5
    ELSE (rank() OVER (PARTITION BY ts, return_5d IS NULL ORDER BY return_5d) - 1 + (count(*) OVER (PARTITION BY ts, return_5d) - 1) / 2.0) / (count(return_5d) OVER (PARTITION BY ts) - 1) END::DOUBLE AS p FROM nx),
  sc AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY p DESC, symbol) AS i, row_number() OVER (PARTITION BY ts ORDER BY p, symbol) AS j, greatest(1, ceil(count(*) OVER (PARTITION BY ts) * 0.2)) AS k
    FROM pr WHERE p IS NOT NULL AND nr IS NOT NULL)"""
COMPANIES = """WITH og AS (SELECT o_custkey, round(sum(o_totalprice) FILTER (year(o_orderdate) = 1997) / sum(o_totalprice) FILTER (year(o_orderdate) = 1996) - 1, 6) AS growth FROM orders GROUP BY 1),
  co AS (SELECT c_name AS symbol, CASE c_custkey % 6 WHEN 0 THEN 'Information Technology' WHEN 1 THEN 'Financials' WHEN 2 THEN 'Energy' WHEN 3 THEN 'Industrials' WHEN 4 THEN 'Utilities' END AS sector,
    CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal * 1e5::DOUBLE * (c_custkey % 300) END AS cap, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal / 200 END AS pe, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal / 4000 END AS pb,
    CASE WHEN c_custkey % 7 <> 0 THEN growth END AS g, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 50) / 1000::DOUBLE END AS paid FROM customer LEFT JOIN og ON o_custkey = c_custkey)"""
HEALTH = FEATURES + """, h1 AS (SELECT symbol AS strategy, ts, row_number() OVER w AS n, round(coalesce(avg(return_1d) OVER (w ROWS 29 PRECEDING) / nullif(stddev_samp(return_1d) OVER (w ROWS 29 PRECEDING), 0) * sqrt(252), 0), 6) AS sharpe,
    round(coalesce(sum(greatest(return_1d, 0)) OVER (w ROWS 29 PRECEDING) / nullif(sum(greatest(-return_1d, 0)) OVER (w ROWS 29 PRECEDING), 0), 99), 6) AS profit_factor, round(avg((return_1d > 0)::INTEGER) OVER (w ROWS 29 PRECEDING), 6) AS win_rate
    FROM f WHERE return_1d IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  h2 AS (SELECT *, NOT (sharpe < 0 OR profit_factor < 0.8 OR (sharpe >= 0.5 AND profit_factor >= 1.2 AND win_rate >= 0.4)) AS waits FROM h1 WHERE n >= 30),
  h3 AS (SELECT *, max(ts) FILTER (NOT waits) OVER (PARTITION BY strategy ORDER BY ts) AS since FROM h2),
  h4 AS (SELECT *, CASE WHEN waits THEN date_diff('day', min(ts) FILTER (waits) OVER (PARTITION BY strategy, since), ts) ELSE 0 END AS days FROM h3),
  hh AS (SELECT strategy, ts, sharpe, profit_factor, win_rate, days, CASE WHEN sharpe < 0 OR profit_factor < 0.8 OR days > 30 THEN 'deactivated' WHEN waits THEN 'probation' ELSE 'active' END AS status,
    CASE WHEN sharpe < 0 THEN 'negative_sharpe' WHEN profit_factor < 0.8 THEN 'low_profit_factor' WHEN days > 30 THEN 'probation_timeout' WHEN NOT waits THEN 'all_metrics_healthy'
      ELSE concat_ws(',', CASE WHEN sharpe < 0.5 THEN 'low_sharpe' END, CASE WHEN profit_factor < 1.2 THEN 'low_pf' END, CASE WHEN win_rate < 0.4 THEN 'low_win_rate' END) END AS reason FROM h4)"""
LIVE = """WITH sg AS (SELECT user_id AS symbol, event_type AS source, ts, CASE event_id % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' ELSE 'HOLD' END AS signal, (event_id % 100) / 100::DOUBLE AS confidence FROM events WHERE ts <= TIMESTAMP '2024-01-15'),
  lv AS (SELECT * FROM sg WHERE ts >= TIMESTAMP '2024-01-13' QUALIFY row_number() OVER (PARTITION BY symbol, source ORDER BY ts DESC, signal DESC, confidence DESC) = 1)"""


def oracle_sql():
    return {
        "alpha_decay": _decay_sql() + " SELECT feature, horizon, delay, n, round(ic_mean, 6) AS ic_mean, round(ic_t, 6) AS ic_t FROM pt",
        "half_lives": _decay_sql() + """, p0 AS (SELECT feature, horizon, ic_mean, abs(ic_mean) AS a, lag(abs(ic_mean)) OVER w AS pa, lag(horizon) OVER w AS ph FROM pt WHERE delay = 0 WINDOW w AS (PARTITION BY feature ORDER BY horizon)),
            pk AS (SELECT feature, arg_max(horizon, (a, -horizon)) AS h, arg_max(ic_mean, (a, -horizon)) AS m FROM p0 GROUP BY 1),
            cr AS (SELECT feature, arg_min(CASE WHEN pa - a <= 0 THEN horizon ELSE ph + (horizon - ph) * (pa - abs(m) / 2) / (pa - a) END, horizon) AS hl FROM p0 JOIN pk USING (feature) WHERE horizon > h AND a <= abs(m) / 2 GROUP BY 1)
            SELECT feature, h AS peak_horizon, round(m, 6) AS peak_ic, round(hl, 6) AS half_life FROM pk LEFT JOIN cr USING (feature)""",
        "barrier_calibration": _calibration_sql(),
        "sector_study": _study_sql(),
        "meta_book": RATED + """, mt AS (SELECT ts, nr - (5 + 5 * (regexp_extract(symbol, '[0-9]+')::INTEGER % 3)) / 1e4::DOUBLE AS net, coalesce(volume_ratio >= 1, false) AS kp FROM sc WHERE i <= k)
            SELECT ts, count(*) AS trades, count(*) FILTER (kp) AS kept, round(avg(net), 6) AS unfiltered, round(coalesce(avg(net) FILTER (kp), 0), 6) AS filtered, round(avg((net > 0)::INTEGER), 6) AS precision,
              round(avg((net > 0)::INTEGER) FILTER (kp), 6) AS kept_precision FROM mt GROUP BY 1""",
        "long_short": RATED + """, ls AS (SELECT ts, avg(nr) FILTER (i <= k) AS long, avg(nr) FILTER (j <= k) AS short FROM sc GROUP BY 1)
            SELECT ts, round(long, 6) AS long, round(short, 6) AS short, round(long - short, 6) AS spread FROM ls""",
        "model_votes": RATED + """ SELECT symbol, ts, CASE WHEN p >= 0.55 THEN 'BUY' WHEN p <= 0.45 THEN 'SELL' ELSE 'HOLD' END AS signal, round(least(1, abs(p - 0.5::DOUBLE) * 2), 6) AS confidence FROM pr
            WHERE p IS NOT NULL AND (return_20d IS NULL)::INTEGER + (sma_50 IS NULL)::INTEGER + (realized_vol_20 IS NULL)::INTEGER <= 1""",
        "styles": COMPANIES + """, z AS (SELECT *, (coalesce(g >= 0.15, false)::INTEGER + coalesce(pe >= 25, false)::INTEGER + coalesce(paid < 0.01, false)::INTEGER)::INTEGER AS growth_score,
              (coalesce(pe > 0 AND pe <= 15, false)::INTEGER + coalesce(pb <= 1.5, false)::INTEGER + coalesce(paid >= 0.03, false)::INTEGER)::INTEGER AS value_score,
              CASE WHEN sector = 'Information Technology' THEN 'growth' WHEN sector IN ('Financials', 'Energy', 'Utilities') THEN 'value' END AS leans,
              CASE WHEN cap IS NULL THEN 'unknown' WHEN cap >= 200e9 THEN 'mega' WHEN cap >= 10e9 THEN 'large' WHEN cap >= 2e9 THEN 'mid' WHEN cap >= 300e6 THEN 'small' ELSE 'micro' END AS tier FROM co),
            y AS (SELECT *, CASE WHEN growth_score + value_score = 0 THEN coalesce(leans, 'blend') WHEN growth_score > value_score THEN 'growth' WHEN value_score > growth_score THEN 'value' ELSE 'blend' END AS style,
              CASE WHEN growth_score + value_score > 0 THEN 'metrics' WHEN leans IS NOT NULL THEN 'sector' ELSE 'default' END AS basis FROM z)
            SELECT symbol, sector, growth_score, value_score, style, basis, tier, style || '_' || CASE WHEN tier IN ('mega', 'large') THEN 'large' ELSE 'small' END || 'cap_v1' AS model_stack,
              CASE style WHEN 'growth' THEN 1 WHEN 'value' THEN 0 ELSE 0.5 END::DOUBLE AS style_growth, CASE style WHEN 'growth' THEN 0 WHEN 'value' THEN 1 ELSE 0.5 END::DOUBLE AS style_value FROM y""",
        "sector_composition": COMPANIES + " SELECT sector, count(*) AS names, sector IS NOT NULL AND count(*) >= 4 AS usable, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM co GROUP BY 1",
        "strategy_health": HEALTH + " SELECT * REPLACE (days::INTEGER AS days) FROM hh",
        "alerts": HEALTH + """, ch AS (SELECT *, lag(status) OVER (PARTITION BY strategy ORDER BY ts) AS was FROM hh),
            fo AS (SELECT strategy, arg_min(sharpe, ts) AS o FROM hh GROUP BY 1), yr AS (SELECT strategy, year(ts) AS y, max(ts) AS ts, arg_max(sharpe, ts) AS c FROM hh GROUP BY 1, 2),
            rv AS (SELECT ts, strategy, o, c, coalesce((o - c) / nullif(abs(o), 0), 0) AS d FROM yr JOIN fo USING (strategy))
            SELECT ts, 'warning' AS severity, 'Strategy status: ' || strategy || ' ' || was || ' → ' || status AS title, 'reason: ' || reason || ' (sharpe_90d ' || printf('%.2f', sharpe) || ')' AS message FROM ch
              WHERE was <> status AND status IN ('probation', 'deactivated')
            UNION ALL SELECT ts, 'warning', 'Strategy revalidated: ' || strategy || ' → ' || CASE WHEN c < 0 THEN 'deactivate' ELSE 'probation' END, printf('OOS Sharpe %.2f vs %.2f (degradation %.0f%%)', c, o, d * 100) FROM rv WHERE c < 0 OR d >= 0.4""",
        "live_components": LIVE + " SELECT symbol, source, ts, signal, confidence FROM lv",
        "best_levels": LIVE + " SELECT symbol, signal, source, confidence FROM lv WHERE signal <> 'HOLD' QUALIFY row_number() OVER (PARTITION BY symbol, signal ORDER BY confidence DESC, source) = 1",
        "rolling_outcomes": """SELECT model_id, ts, n, round(CASE WHEN n >= 10 THEN hit END, 6) AS accuracy, round(CASE WHEN n >= 10 THEN coalesce(m / nullif(sd, 0), 0) * sqrt(12) END, 6) AS sharpe FROM (SELECT event_type AS model_id, ts,
            count(value) OVER w AS n, avg((value > 20)::INTEGER) OVER w AS hit, avg(value - 20) OVER w AS m, stddev_samp(value - 20) OVER w AS sd FROM events
            WINDOW w AS (PARTITION BY event_type ORDER BY floor(epoch(ts)) RANGE BETWEEN 259200 PRECEDING AND CURRENT ROW))""",
        "thinned": f"""SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) x
            WHERE n <= {POINTS} OR i = n - 1 OR EXISTS (SELECT 1 FROM range({POINTS} - 1) t(j) WHERE j * n // {POINTS} = i)""",
    }
