"""Registered queries of reports, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import dataset as training
from tessera.operators import gates, ledger, market, panel, reports, study, targets
from tessera.operators import technical as tech
from tessera.operators.gate_queries import OVERLAID
from tessera.operators.ledger_queries import KS
from tessera.operators.panel_queries import _read, filings
from tessera.operators.queries import BARS, FEATURES, _bars
from tessera.operators.research_queries import HEALTH, _health
from tessera.operators.study_queries import BENCH, RANKS, _dataset, _dataset_sql, _oracle_sql
from tessera.streaming import alerts as feeds

BASE, HELD, LOOKBACK = 0.1, 12, 120
#: Bounds of the training table that the query holds it to; some of them are breached.
CONTRACT = {"least_sessions": 250, "least_samples": 1 << 20, "least_names": 10, "most_neutral": 0.02, "requested": 4000}


def model_drift(spark, sf_dir):
    """Models are kinds of events: three features and predictions before and after the middle of the month, outcomes of the last days; one model has too few."""
    e = _read(spark, sf_dir, "events").withColumn("model_id", F.col("event_type")).withColumn("side", F.when(F.dayofmonth("ts") <= 15, "ref").otherwise("cur"))
    user = F.col("user_id") % 50 + F.when((F.col("model_id") == "error") & (F.col("side") == "cur"), 30).otherwise(0)
    cells = {"value": F.col("value"), "hour": F.hour("ts"), "user": user}
    samples = e.select("model_id", "side", F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), x.cast("double").alias("value")) for k, x in cells.items()])).alias("x")).select("model_id", "side", "x.*").where("value is not null")
    predictions = e.select("model_id", "side", (F.col("event_id") % 97 / 97).alias("value"))
    got = F.when((F.dayofmonth("ts") >= 20) & ((F.col("model_id") != "view") | (F.col("event_id") % 4000 == 0)), F.col("value") / 100 - 0.4)
    known = F.count(got) >= 10
    ratio = F.coalesce(F.try_divide(F.avg(got), F.stddev_samp(got)), F.lit(0.0))
    performance = e.groupBy("model_id").agg(F.lit(BASE).alias("baseline_sharpe"), F.when(known, ratio).alias("sharpe"), F.when(known, F.avg((got > 0).cast("double"))).alias("accuracy"))
    return reports.drift_reports(samples, predictions, performance)


def _curves(spark, sf_dir) -> DataFrame:
    return _bars(spark, sf_dir).where("symbol <> 'Brand#11' or ts >= '1998-11-01'").select(F.col("symbol").alias("account"), "ts", F.col("adj_close").alias("equity"))


def equity_paths(spark, sf_dir):
    return reports.equity_paths(_curves(spark, sf_dir), most=500).select("account", "ts", "equity", "drawdown")


def book_sections(spark, sf_dir):
    """Each brand as a book, one of them young."""
    return reports.book_sections(reports.equity_paths(_curves(spark, sf_dir)))


def strategy_attribution(spark, sf_dir):
    """Each strategy's newest status and its weight learned from its last returns; odd ones were never measured, and models learn beside them."""
    returns = market.features(_bars(spark, sf_dir)).where("return_1d is not null and cast(regexp_extract(symbol, '[0-9]+', 0) as int) % 2 = 0")
    own = returns.select(F.concat(F.lit("strategy:"), "symbol").alias("source"), "ts", F.lit(0).cast("long").alias("event_id"), F.col("return_1d").alias("outcome"))
    models = _read(spark, sf_dir, "events").where("event_type in ('click', 'view')").select(F.col("event_type").alias("source"), "ts", "event_id", (F.col("value") / 100 - 0.4).alias("outcome"))
    return reports.attribution(_health(spark, sf_dir), ledger.source_weights(own.unionByName(models)))


def held_correlations(spark, sf_dir):
    """The first brands as a book, and one name that never traded."""
    rows = market.features(_bars(spark, sf_dir)).select("symbol", "ts", F.col("return_1d").alias("ret"))
    names = rows.select("symbol").distinct().orderBy("symbol").limit(HELD)
    return reports.held_correlations(rows, names.unionByName(spark.createDataFrame([("none",)], "symbol string")), LOOKBACK)


def feature_states(spark, sf_dir):
    return reports.feature_states(_dataset(spark, sf_dir), RANKS, ("volume_ratio",))


def contract_violations(spark, sf_dir):
    """What the training table breaches; its two reports read it once each."""
    table = _dataset(spark, sf_dir)
    return reports.violations(training.contract(table, RANKS), reports.feature_states(table, RANKS), **CONTRACT)


def valuation_ratios(spark, sf_dir):
    """Statements with cash flows and shares, some without, at the session's close."""
    b = F.regexp_extract("symbol", "[0-9]+", 0).cast("int")
    facts = filings(spark, sf_dir).withColumn("operating_cash_flow", F.when(b % 3 != 0, F.col("net_income") * 1.5)).withColumn("shares_outstanding", F.when(b % 4 != 0, F.col("total_assets") / 100).otherwise(0.0))
    bars = _bars(spark, sf_dir)
    seen = panel.latest_filing(bars.select("symbol", "ts"), facts)
    return seen.join(bars.select("symbol", "ts", F.col("close").alias("price")), ["symbol", "ts"]).select("symbol", "ts", *reports.valuation())


def served_ranks(spark, sf_dir):
    newest = panel.newest(market.features(_bars(spark, sf_dir)), 1).select("symbol", "ts", "return_5d", "volume_ratio")
    e = _read(spark, sf_dir, "events").where("user_id % 5 <> 4")
    name = F.when(F.col("event_type") == "click", "return_5d").when(F.col("event_type") == "purchase", "style_growth").otherwise("style_value")
    said = e.select(F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("symbol"), name.alias("name"), "value", F.struct("ts", "event_id").alias("at"))
    return reports.served_ranks(newest, gates.attributes(said, "at"), [*OVERLAID, "volume_ratio"])


def catch_up(spark, sf_dir):
    """Each event as a moment, with the day of its user's event before as the last finished pull."""
    before = F.to_date(F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    rows = _read(spark, sf_dir, "events").select("event_id", "ts", before.alias("last_sync"))
    return rows.select("event_id", "last_sync", reports.needs_catchup(F.col("last_sync"), F.col("ts"), 16).alias("due"))


def messages(spark, sf_dir) -> DataFrame:
    """Events as messages of five topics; one in ten of drift has no action, one in nine of fills is no JSON, some topics are unknown."""
    e, k = _read(spark, sf_dir, "events"), F.col("event_id")
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))
    said = {
        "click": ("breaker", F.struct(pick("YELLOW", "RED", "BLACK").alias("level"), F.lit("drawdown").alias("metric"), (k % 1000 / 1000).alias("value"), F.lit(0.15).alias("threshold"), F.lit("halt").alias("action"))),
        "purchase": ("fill", F.struct(F.concat(F.lit("S"), F.col("user_id") % 50).alias("symbol"), (k % 9 + 1).alias("quantity"), F.col("value").alias("price"), k.cast("string").alias("order_id"))),
        "view": ("revalidated", F.struct(F.concat(F.lit("rule "), k % 5).alias("strategy"), (k % 7 / 4).alias("original"), (k % 5 / 4).alias("current"), (k % 90 / 100).alias("degradation"), pick("active", "probation", "deactivate").alias("status"))),
        "signup": ("status", F.struct(F.concat(F.lit("rule "), k % 5).alias("strategy"), F.lit("active").alias("old_status"), pick("probation", "active", "deactivated").alias("new_status"), F.lit("low_sharpe").alias("reason"), F.when(k % 4 != 0, k % 9 / 4).alias("sharpe"))),
        "error": ("drift", F.struct(F.concat(F.lit("m"), k % 3).alias("model_id"), F.lit("feature").alias("drift_type"), pick("info", "warning", "critical", "loud").alias("severity"), F.when(k % 10 != 0, "auto_retrain").alias("action"))),
    }
    topic, payload = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, (name, body) in said.items():
        topic, payload = F.when(F.col("event_type") == kind, name).otherwise(topic), F.when(F.col("event_type") == kind, F.to_json(body)).otherwise(payload)
    broken = (F.col("event_type") == "purchase") & (k % 9 == 0)
    return e.select(F.when(k % 50 == 7, "gossip").otherwise(topic).alias("topic"), "ts", F.when(broken, "{quantity").otherwise(payload).alias("payload"))


def alert_feed(spark, sf_dir):
    """Warnings and worse of all five topics."""
    return feeds.feed(messages(spark, sf_dir), "warning")


def refused_messages(spark, sf_dir):
    rows = feeds.refused(messages(spark, sf_dir))
    return rows.groupBy(F.coalesce("topic", F.lit("")).alias("name")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


RAW, HORIZONS, WIDTHS = ("return_5d", "return_20d", "realized_vol_20", "volume_ratio"), (5, 21), (0.5, 1.0, 1.5)


def target_scores(spark, sf_dir):
    """Absolute and excess labels of a week and a month, three widths each."""
    b = _bars(spark, sf_dir)
    rows = study.on_benchmark(tech.adjusted(b), panel.benchmark(b))
    return targets.target_scores(rows, market.features(b), list(RAW), list(HORIZONS), list(WIDTHS), 10)


def queries():
    made = [target_scores, alert_feed, refused_messages, model_drift, equity_paths, book_sections, strategy_attribution, held_correlations, feature_states, contract_violations, valuation_ratios, served_ranks, catch_up]
    return {q.__name__: q for q in made}


DRIFT = f"""WITH ev AS (SELECT event_type AS model_id, event_id, day(ts) <= 15 AS ref, day(ts) AS d, hour(ts) AS hr, value, user_id FROM events),
  s AS (SELECT model_id, 'value' AS feature, ref, value AS v FROM ev WHERE value IS NOT NULL UNION ALL SELECT model_id, 'hour', ref, hr::DOUBLE FROM ev
    UNION ALL SELECT model_id, 'user', ref, (user_id % 50 + CASE WHEN model_id = 'error' AND NOT ref THEN 30 ELSE 0 END)::DOUBLE FROM ev WHERE user_id IS NOT NULL),
  rg AS (SELECT model_id, feature, min(v) AS lo, max(v) AS hi FROM s WHERE ref GROUP BY 1, 2), bn AS (SELECT s.model_id, s.feature, ref, greatest(0, least(9, floor((v - lo) / (hi - lo) * 10))) AS bin FROM s JOIN rg ON s.model_id = rg.model_id AND s.feature = rg.feature),
  gd AS (SELECT model_id, feature, i AS bin FROM rg, range(10) q(i)), ct AS (SELECT gd.model_id, gd.feature, gd.bin, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM gd LEFT JOIN bn ON gd.model_id = bn.model_id AND gd.feature = bn.feature AND gd.bin = bn.bin GROUP BY 1, 2, 3),
  pq AS (SELECT model_id, feature, (r + 1e-6::DOUBLE) / (sum(r) OVER w + 1e-5::DOUBLE) AS p, (c + 1e-6::DOUBLE) / (sum(c) OVER w + 1e-5::DOUBLE) AS q FROM ct WINDOW w AS (PARTITION BY model_id, feature)),
  ps AS (SELECT model_id, feature, sum((q - p) * ln(q / p)) AS psi FROM pq GROUP BY 1, 2), fd AS (SELECT model_id, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (psi > 0.2::DOUBLE), '') AS drifted, max(psi) AS worst_psi FROM ps GROUP BY 1),
  pf AS (SELECT model_id, count(o) AS n, coalesce(avg(o) / nullif(stddev_samp(o), 0), 0) AS sharpe, avg((o > 0)::INTEGER) AS accuracy FROM (SELECT model_id, CASE WHEN d >= 20 AND (model_id <> 'view' OR event_id % 4000 = 0) THEN value / 100 - 0.4::DOUBLE END AS o FROM ev) GROUP BY 1),
  {KS.removeprefix("WITH s AS (SELECT event_type AS feature, day(ts) <= 15 AS ref, value FROM events WHERE value IS NOT NULL), ").replace("FROM s GROUP", "FROM kp GROUP").replace("v AS (", "kp AS (SELECT model_id AS feature, ref, event_id % 97 / 97::DOUBLE AS value FROM ev), v AS (", 1)},
  rp AS (SELECT model_id, drifted, worst_psi, 1 - p_value AS prediction_shift, CASE WHEN n >= 10 THEN (sharpe - {BASE}::DOUBLE) / {BASE}::DOUBLE ELSE 0 END AS sharpe_decay, CASE WHEN n >= 10 THEN accuracy ELSE 0.5 END::DOUBLE AS accuracy, n >= 10 AS performance_measured
    FROM pf JOIN fd USING (model_id) JOIN t ON t.feature = model_id)"""
CURVES = BARS + """, cu AS (SELECT symbol AS account, ts, adj_close AS equity FROM b WHERE symbol <> 'Brand#11' OR ts >= TIMESTAMP '1998-11-01'),
  ep AS (SELECT account, ts, equity, equity / lag(equity) OVER w - 1 AS ret, 1 - equity / max(equity) OVER (w ROWS UNBOUNDED PRECEDING) AS drawdown, row_number() OVER (PARTITION BY account ORDER BY ts DESC) AS k FROM cu WINDOW w AS (PARTITION BY account ORDER BY ts))"""


def _targets_sql() -> str:
    keys = "excess, horizon, ts, feature"
    long = " UNION ALL ".join(f"SELECT excess, horizon, width, touched, lb.ts, label, '{n}' AS feature, {n} AS v FROM lb JOIN fx USING (symbol, ts)" for n in RAW)
    rank = lambda c: f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0::DOUBLE"
    values = lambda xs: ", ".join(f"({x})" for x in xs)
    return BENCH + f""", r2 AS (SELECT symbol, ts, c, v AS volume, row_number() OVER w AS n, c / lag(c) OVER w - 1 AS r FROM a WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
      fx AS (SELECT symbol, ts, c / lag(c, 5) OVER w - 1 AS return_5d, c / lag(c, 20) OVER w - 1 AS return_20d, CASE WHEN n >= 21 THEN stddev_samp(r) OVER (w ROWS 19 PRECEDING) * sqrt(252.0) END AS realized_vol_20,
        CASE WHEN n >= 20 THEN volume / avg(volume) OVER (w ROWS 19 PRECEDING) END AS volume_ratio FROM r2 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
      pt AS (SELECT n.symbol, n.ts, c, x, CASE WHEN count(lr) OVER w20 = 20 THEN stddev_samp(lr) OVER w20 END AS sl, CASE WHEN count(d) OVER w20 = 20 THEN stddev_samp(d) OVER w20 END AS sx,
        list({{'h': h, 'l': l, 'c': c, 'x': x}}) OVER (PARTITION BY n.symbol ORDER BY n.ts ROWS BETWEEN 1 FOLLOWING AND {max(HORIZONS)} FOLLOWING) AS nx FROM n JOIN xd ON n.symbol = xd.symbol AND n.ts = xd.ts WINDOW w20 AS (PARTITION BY n.symbol ORDER BY n.ts ROWS 19 PRECEDING)),
      kd AS (SELECT symbol, ts, false AS excess, c AS lvl, c * sl AS unit, list_transform(nx, lambda y: {{'lo': y.l, 'hi': y.h, 'fin': y.c}}) AS nx FROM pt UNION ALL SELECT symbol, ts, true, x, sx, list_transform(nx, lambda y: {{'lo': y.x, 'hi': y.x, 'fin': y.x}}) FROM pt),
      gd AS (SELECT kd.*, horizon, width, lvl - unit * width * sqrt(horizon) AS flo, lvl + unit * width * sqrt(horizon) AS cei FROM kd, (VALUES {values(HORIZONS)}) hz(horizon), (VALUES {values(f"{m}::DOUBLE" for m in WIDTHS)}) wd(width) WHERE unit > 0),
      hz AS (SELECT *, list_filter(nx[1:horizon], lambda y: y.lo <= flo OR y.hi >= cei)[1] AS hit, nx[horizon] AS fin FROM gd),
      bz AS (SELECT *, CASE WHEN hit.lo <= flo THEN 'lower' WHEN hit.hi >= cei THEN 'upper' WHEN fin.fin IS NOT NULL THEN 'vertical' END AS barrier FROM hz),
      lz AS (SELECT excess, symbol, ts, horizon, width, barrier, CASE barrier WHEN 'vertical' THEN (fin.fin > lvl)::INTEGER WHEN 'upper' THEN 1 ELSE 0 END AS label FROM bz WHERE barrier IS NOT NULL),
      rc AS (SELECT excess, horizon, width, avg((barrier <> 'vertical')::INTEGER) AS touched FROM lz GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY excess, horizon ORDER BY touched NOT BETWEEN 0.4::DOUBLE AND 0.7::DOUBLE, round(abs(touched - 0.55::DOUBLE), 12), width) = 1),
      lb AS (SELECT lz.*, touched FROM lz JOIN rc USING (excess, horizon, width)), ln AS ({long}), lm AS (SELECT * FROM ln QUALIFY count(*) OVER (PARTITION BY {keys}) >= 10),
      lp AS (SELECT * REPLACE (coalesce(CASE WHEN v IS NULL THEN NULL WHEN count(v) OVER (PARTITION BY {keys}) = 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY {keys}, v IS NULL ORDER BY v) - 1 + (count(*) OVER (PARTITION BY {keys}, v) - 1) / 2.0::DOUBLE) / (count(v) OVER (PARTITION BY {keys}) - 1) END, 0.5)::DOUBLE AS v) FROM lm),
      lr2 AS (SELECT {keys}, width, touched, label, {rank("v")} AS ra, {rank("label")} AS rb FROM lp),
      li AS (SELECT {keys}, width, touched, CASE WHEN stddev_pop(ra) = 0 OR stddev_pop(rb) = 0 THEN 0 ELSE corr(ra, rb) END AS ic, count(*) AS n, sum(label) AS up FROM lr2 GROUP BY ALL),
      le AS (SELECT excess, horizon, width, touched, feature, avg(ic) AS ic, sum(n) AS n, sum(up) AS up FROM li GROUP BY ALL),
      lo AS (SELECT excess, horizon, width, touched, max(n)::BIGINT AS samples, max(up) / max(n)::DOUBLE AS positive_rate, arg_min(feature, (-round(abs(ic), 12), feature)) AS best_feature, arg_min(ic, (-round(abs(ic), 12), feature)) AS best_ic, avg(abs(ic)) AS mean_abs_ic FROM le GROUP BY ALL)
      SELECT *, row_number() OVER (ORDER BY -round(abs(best_ic), 12), horizon, excess)::INTEGER AS place FROM lo"""


def oracle_sql():
    made = _dataset_sql(_oracle_sql())
    states = " UNION ALL ".join(f"SELECT '{n}' AS feature, coalesce(var_pop({n}), 0) AS variance, coalesce(avg(({n} = 0.5)::INTEGER), 1)::DOUBLE AS neutral_share FROM ds" for n in RANKS)
    c = CONTRACT
    return {
        "alert_feed": """WITH e AS (SELECT * FROM events WHERE event_id % 50 <> 7)
            SELECT ts, CASE event_id % 3 WHEN 0 THEN 'warning' ELSE 'critical' END AS severity, 'Circuit breaker ' || ['YELLOW', 'RED', 'BLACK'][event_id % 3 + 1] AS title, printf('drawdown=%.2f%% (threshold 15.00%%) → halt', event_id % 1000 / 1000::DOUBLE * 100) AS message FROM e WHERE event_type = 'click'
            UNION ALL SELECT ts, 'warning', 'Strategy revalidated: rule ' || event_id % 5 || ' → ' || ['active', 'probation', 'deactivate'][event_id % 3 + 1], printf('OOS Sharpe %.2f vs %.2f (degradation %.0f%%)', event_id % 5 / 4::DOUBLE, event_id % 7 / 4::DOUBLE, event_id % 90 / 100::DOUBLE * 100) FROM e
              WHERE event_type = 'view' AND event_id % 3 <> 0
            UNION ALL SELECT ts, 'warning', 'Strategy status: rule ' || event_id % 5 || ' active → ' || ['probation', 'active', 'deactivated'][event_id % 3 + 1], 'reason: low_sharpe (sharpe_90d ' || CASE WHEN event_id % 4 = 0 THEN 'n/a' ELSE printf('%.2f', event_id % 9 / 4::DOUBLE) END || ')' FROM e
              WHERE event_type = 'signup' AND event_id % 3 <> 1
            UNION ALL SELECT ts, CASE event_id % 4 WHEN 2 THEN 'critical' ELSE 'warning' END, 'Model drift: m' || event_id % 3 || ' (feature)', 'Recommended action: auto_retrain' FROM e WHERE event_type = 'error' AND event_id % 10 <> 0""",
        "refused_messages": """WITH e AS (SELECT CASE WHEN event_id % 50 = 7 THEN 'gossip' WHEN event_type = 'purchase' AND event_id % 9 = 0 THEN 'fill' WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'drift' END AS name, ts FROM events)
            SELECT name, count(*) AS n, min(ts) AS first_ts FROM e WHERE name IS NOT NULL GROUP BY 1""",
        "target_scores": _targets_sql(),
        "model_drift": DRIFT + """ SELECT *, drifted <> '' OR sharpe_decay < -0.3::DOUBLE OR accuracy < 0.48::DOUBLE AS needs_retrain, prediction_shift > 0.99::DOUBLE AS needs_investigation,
            CASE WHEN drifted <> '' OR sharpe_decay < -0.3::DOUBLE OR accuracy < 0.48::DOUBLE THEN 'auto_retrain' WHEN prediction_shift > 0.99::DOUBLE THEN 'alert_and_monitor' ELSE 'no_action' END AS action FROM rp""",
        "equity_paths": CURVES + " SELECT account, ts, equity, drawdown FROM ep WHERE k <= 500",
        "book_sections": CURVES + """, bs AS (SELECT account, count(*) AS sessions, arg_max(equity, ts) - arg_min(equity, ts) AS pnl_abs, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS pnl_pct, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS sharpe, max(drawdown) AS max_drawdown, count(ret) AS returns
              FROM ep WHERE k <= 2000 GROUP BY 1), tl AS (SELECT account, ret FROM ep WHERE k <= 2000 AND ret IS NOT NULL QUALIFY count(*) OVER (PARTITION BY account) >= 20 AND row_number() OVER (PARTITION BY account ORDER BY ret) <= greatest(1, ceil(round(0.05::DOUBLE * count(*) OVER (PARTITION BY account), 9))))
            SELECT bs.*, var_95, cvar_95 FROM bs LEFT JOIN (SELECT account, greatest(0, -max(ret)) AS var_95, greatest(0, -avg(ret)) AS cvar_95 FROM tl GROUP BY 1) USING (account)""",
        "strategy_attribution": HEALTH + """, oc AS (SELECT 'strategy:' || symbol AS source, ts, 0 AS event_id, return_1d AS o FROM f WHERE return_1d IS NOT NULL AND regexp_extract(symbol, '[0-9]+')::INTEGER % 2 = 0
              UNION ALL SELECT event_type, ts, event_id, value / 100 - 0.4::DOUBLE FROM events WHERE event_type IN ('click', 'view')),
            e1 AS (SELECT source, coalesce(avg(o) / nullif(stddev_samp(o), 0), 0) AS ratio FROM (SELECT * FROM oc QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts DESC, event_id DESC) <= 60) GROUP BY 1),
            e2 AS (SELECT source, greatest(0.05::DOUBLE, least(0.6::DOUBLE, exp(least(2 * ratio, 500)) / sum(exp(least(2 * ratio, 500))) OVER ())) AS k FROM e1), e3 AS (SELECT source, k / sum(k) OVER () AS weight FROM e2)
            SELECT strategy AS name, 'strategy' AS kind, status, weight FROM (SELECT strategy, arg_max(status, ts) AS status FROM hh GROUP BY 1) LEFT JOIN e3 ON source = 'strategy:' || strategy
            UNION ALL SELECT source, 'other', NULL, weight FROM e3 WHERE NOT starts_with(source, 'strategy:')""",
        "held_correlations": FEATURES + f""", hd AS (SELECT DISTINCT symbol FROM f ORDER BY symbol LIMIT {HELD}), hn AS (SELECT symbol FROM hd UNION ALL SELECT 'none'),
            lr AS (SELECT symbol, return_1d AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM f WHERE return_1d IS NOT NULL QUALIFY k <= {LOOKBACK}),
            pc AS (SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, corr(x.r, y.r) AS corr FROM lr x JOIN lr y ON x.k = y.k AND x.symbol < y.symbol GROUP BY 1, 2),
            al AS (SELECT x.symbol AS a, y.symbol AS b, coalesce(n, 0) AS n, CASE WHEN n >= 20 THEN corr END AS corr FROM hn x JOIN hn y ON x.symbol < y.symbol LEFT JOIN pc ON pc.a = x.symbol AND pc.b = y.symbol)
            SELECT *, count(corr) OVER () / count(*) OVER ()::DOUBLE AS coverage FROM al""",
        "feature_states": f"{made}, st AS ({states}) SELECT *, CASE WHEN feature = 'volume_ratio' THEN 'candidate' WHEN variance <= 1e-6::DOUBLE THEN 'constant' ELSE 'model' END AS state FROM st",
        "contract_violations": f"""{made}, st AS ({states}), wd AS (SELECT ts, count(*) AS m FROM ds GROUP BY 1), rp AS (SELECT count(*)::DOUBLE AS sessions, sum(m)::DOUBLE AS samples, median(m)::DOUBLE AS median_names FROM wd)
            SELECT 'sessions' AS rule, '' AS feature, sessions AS figure, {c["least_sessions"]}::DOUBLE AS bound FROM rp WHERE sessions < {c["least_sessions"]} UNION ALL SELECT 'samples', '', samples, {c["least_samples"]} FROM rp WHERE samples < {c["least_samples"]}
            UNION ALL SELECT 'median_names', '', median_names, {c["least_names"]} FROM rp WHERE median_names < {c["least_names"]} UNION ALL SELECT 'short_of_requested', '', 1 - sessions / {c["requested"]}, 0.05::DOUBLE FROM rp WHERE 1 - sessions / {c["requested"]} > 0.05::DOUBLE
            UNION ALL SELECT 'constant', feature, variance, 1e-6::DOUBLE FROM st WHERE variance <= 1e-6::DOUBLE UNION ALL SELECT 'neutral', feature, neutral_share, {c["most_neutral"]}::DOUBLE FROM st WHERE neutral_share > {c["most_neutral"]}::DOUBLE""",
        "valuation_ratios": BARS + """, fi AS (SELECT p_brand AS symbol, regexp_extract(p_brand, '[0-9]+')::INTEGER AS br, (date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH)::DATE AS period_end, sum(l_extendedprice * l_tax) * 2 AS income,
              sum(l_quantity) * 1000 AS assets, sum(l_extendedprice * l_discount) * 4 AS debt FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
            fd AS (SELECT *, CASE WHEN br % 4 <> 0 THEN assets / 100 END AS shares, (period_end + (20 + br))::TIMESTAMP AS filed_at FROM fi WHERE br % 11 <> 0)
            SELECT b.symbol, b.ts, CASE WHEN br % 3 <> 0 THEN (income - income * 1.5::DOUBLE) / nullif(assets, 0) END AS accruals, (assets - debt) / (shares * close) AS book_to_market, income / (shares * close) AS earnings_yield
            FROM b ASOF LEFT JOIN fd ON b.symbol = fd.symbol AND b.ts > fd.filed_at""",
        "served_ranks": FEATURES + f""", lv AS (SELECT symbol, ts, return_5d, volume_ratio FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1),
            av AS (SELECT 'Brand#' || (user_id % 25 + 1)::VARCHAR AS symbol, CASE event_type WHEN 'click' THEN 'return_5d' WHEN 'purchase' THEN 'style_growth' ELSE 'style_value' END AS name, value, ts, event_id
              FROM events WHERE user_id % 5 <> 4 AND value IS NOT NULL),
            aw AS (SELECT symbol, arg_max(value, (ts, event_id)) FILTER (name = 'return_5d') AS a, arg_max(value, (ts, event_id)) FILTER (name = 'style_growth') AS g, arg_max(value, (ts, event_id)) FILTER (name = 'style_value') AS v FROM av GROUP BY 1),
            ov AS (SELECT symbol, ts, coalesce(a, return_5d) AS return_5d, g AS style_growth, v AS style_value, volume_ratio FROM lv LEFT JOIN aw USING (symbol))
            SELECT symbol, ts, {", ".join(f"coalesce(CASE WHEN {n} IS NULL THEN NULL WHEN count({n}) OVER () = 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY {n} IS NULL ORDER BY {n}) - 1 + (count(*) OVER (PARTITION BY {n}) - 1) / 2.0::DOUBLE) / (count({n}) OVER () - 1) END, 0.5)::DOUBLE AS {n}" for n in (*OVERLAID, "volume_ratio"))} FROM ov""",
        "catch_up": """WITH e AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)::DATE AS last_sync FROM events)
            SELECT event_id, last_sync, coalesce(last_sync < CASE WHEN hour(ts) >= 16 THEN ts::DATE ELSE ts::DATE - 1 END, true) AS due FROM e""",
    }
