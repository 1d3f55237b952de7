"""Registered queries of session and fold metrics, pooling, the gate, overlays and undated vintages, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import gates, market, panel
from tessera.operators.panel_queries import _read, rounded
from tessera.operators.queries import FEATURES, _bars
from tessera.operators.research_queries import RATED, _scored
from tessera.tables import stored

#: Features whose own rank correlation a model must beat, and those that attributes may overwrite or add.
BASELINE, OVERLAID = ("realized_vol_20", "volume_ratio"), ("return_5d", "style_growth", "style_value")


_KEPT: dict[tuple, DataFrame] = {}


def _kept(name: str, spark, sf_dir, make) -> DataFrame:
    """A table that several queries and parts of them read: built once a session, on disk where memory ends, built anew where an executor is lost."""
    key = (name, spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        _KEPT[key] = make(spark, sf_dir)
    return _KEPT[key] if _KEPT[key].storageLevel.useDisk else _KEPT[key].persist()  # a caller may have cleared the cache


def _rated(spark, sf_dir) -> DataFrame:
    return _kept("rated", spark, sf_dir, lambda *a: _scored(*a).select("symbol", "ts", "p", "next_return", *BASELINE))


def _sessions(spark, sf_dir) -> DataFrame:
    return _kept("sessions", spark, sf_dir, lambda *a: gates.session_metrics(_rated(*a), "p", "next_return"))


def _years(sessions: DataFrame) -> DataFrame:
    return gates.relative_metrics(sessions.withColumn("fold", F.year("ts")), "fold")


def _folds(spark, sf_dir) -> DataFrame:
    return _years(_sessions(spark, sf_dir))


def session_metrics(spark, sf_dir):
    return rounded(_sessions(spark, sf_dir))


def relative_metrics(spark, sf_dir):
    """The metrics of each year's sessions."""
    return rounded(_folds(spark, sf_dir))


def pooled_folds(spark, sf_dir):
    """Years as folds of two candidates: their parity."""
    return rounded(gates.pooled(_folds(spark, sf_dir).withColumn("candidate", F.when(F.col("fold") % 2 == 0, "even").otherwise("odd")), "candidate"))


def gate(spark, sf_dir):
    """The newest year as holdout, the years before as folds. The deflated ratio has no SQL, so its condition is left to a test.

    Tables that several branches read are stored, so that each is made once and plans end there.
    """
    rated = stored(_scored(spark, sf_dir).select("symbol", "ts", "p", "next_return", *BASELINE), "rated")
    folds = stored(_years(stored(gates.session_metrics(rated, "p", "next_return"), "sessions")), "folds")
    rows = rated.withColumn("fold", F.year("ts"))
    newest = folds.agg(F.max("fold").alias("fold"))  # one row
    rows = rows.join(F.broadcast(newest), "fold")
    best = market.top_quantile(rows, "p").select("symbol", "ts", F.lit(True).alias("selected"))
    y = rows.withColumn("y", (F.col("next_return") > 0).cast("double")).join(best, ["symbol", "ts"], "left").withColumn("base", F.avg("y").over(Window.partitionBy("fold")))
    y = stored(y, "holdout")
    delta = F.pow(F.col("p") - F.col("y"), 2) - F.pow(F.col("base") - F.col("y"), 2)
    fit = y.groupBy("fold").agg(
        F.stddev_pop("p").alias("pred_std"), (F.avg(F.when(F.col("selected"), F.col("y"))) - F.avg("y")).alias("lift"), F.avg(delta).alias("brier_delta"),
        (F.stddev_samp(delta) / F.sqrt(F.count("*"))).alias("brier_se"),
    )
    own = [panel.rank_ic(y, c, "next_return").agg(F.avg("ic").alias("ic")) for c in BASELINE]  # one row each
    baseline = own[0].unionByName(own[1]).agg(F.max("ic").alias("baseline_ic"))
    holdout = folds.join(F.broadcast(fit), "fold").join(panel.auc(y, "p", "y", "fold").select("fold", "auc"), "fold").join(F.broadcast(baseline))
    model = F.lit("return_5d").alias("model")
    holdout = holdout.select(model, F.lit(None).cast("int").alias("best_epoch"), F.col("sections").alias("sessions"), F.col("sharpe_net").alias("sharpe"), "*", F.lit(None).cast("double").alias("deflated"))
    earlier = folds.join(F.broadcast(newest.select(F.col("fold").alias("__newest")))).where("fold < __newest").select(model, "fold", "sharpe_active")
    return gates.gate(holdout, earlier).where("condition <> 'G5'")


def latest_vectors(spark, sf_dir):
    """Each symbol's newest vector with what events say of its attributes; some symbols have none."""
    newest = panel.newest(market.features(_bars(spark, sf_dir)), 1).select("symbol", "ts", "return_5d", "volume_ratio")
    e = _read(spark, sf_dir, "events").where("user_id % 5 <> 4")
    name = F.when(F.col("event_type") == "click", "return_5d").when(F.col("event_type") == "purchase", "style_growth").otherwise("style_value")
    symbol = F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string"))
    said = e.select(symbol.alias("symbol"), name.alias("name"), "value", F.struct("ts", "event_id").alias("at"))
    return rounded(gates.overlay(newest, gates.attributes(said, "at"), list(OVERLAID)))


def macro_vintages(spark, sf_dir):
    """Monthly means by order priority, every third month without a vintage; most are then saved twice more."""
    month = F.date_trunc("month", "o_orderdate").cast("date").alias("observation_date")
    m = _read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), month).agg(F.floor(F.avg("o_totalprice")).cast("double").alias("value"))
    at = F.month("observation_date")
    m = m.select("series", "observation_date", F.when(at % 3 != 0, F.date_add("observation_date", 40)).alias("realtime_start"), "value")
    again = m.where(at % 4 != 1).withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("value", F.col("value") + F.col("seq"))
    return gates.vintages(gates.save_vintages(m, again))


def queries():
    return {q.__name__: q for q in (session_metrics, relative_metrics, pooled_folds, gate, latest_vectors, macro_vintages)}


def _ic_sql(score: str, rows: str) -> str:
    rank = lambda c: f"rank() OVER (PARTITION BY ts ORDER BY {c}) + (count(*) OVER (PARTITION BY ts, {c}) - 1) / 2.0::DOUBLE"
    return f"""SELECT ts, CASE WHEN count(*) < 3 OR stddev_pop(ra) = 0 OR stddev_pop(rb) = 0 THEN 0 ELSE corr(ra, rb) END AS ic
      FROM (SELECT ts, {rank(score)} AS ra, {rank("nr")} AS rb FROM {rows} WHERE {score} IS NOT NULL) GROUP BY 1"""


SESSIONS = RATED + f""", s2 AS (SELECT *, count(*) OVER (PARTITION BY ts) AS m FROM sc QUALIFY m >= 2),
  bk AS (SELECT ts, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY ts) AS w FROM s2 WHERE i <= k), ss AS (SELECT ts, lead(ts) OVER (ORDER BY ts) AS nx FROM (SELECT DISTINCT ts FROM bk)),
  ch AS (SELECT ts, symbol, sum(w) AS w, sum(was) AS was FROM (SELECT ts, symbol, w, 0.0::DOUBLE AS was FROM bk UNION ALL SELECT nx, symbol, 0, w FROM bk JOIN ss USING (ts) WHERE nx IS NOT NULL) GROUP BY 1, 2),
  tn AS (SELECT ts, sum(abs(w - was)) / 2 AS turnover FROM ch GROUP BY 1), ics AS ({_ic_sql("p", "s2")}),
  sm AS (SELECT ts, any_value(ic) AS ic, avg(nr) AS benchmark, avg(nr) FILTER (i <= k) AS gross, avg(nr) FILTER (j <= k) AS short, any_value(turnover) AS turnover, any_value(turnover) * 5 / 1e4::DOUBLE AS cost
    FROM s2 JOIN ics USING (ts) JOIN tn USING (ts) GROUP BY 1)"""


def _sharpe_sql(x: str) -> str:
    return f"coalesce(avg({x}) / nullif(stddev_samp({x}), 0) * sqrt(252), 0)"


FOLDS = SESSIONS + f""", fm AS (SELECT year(ts)::INTEGER AS fold, count(*) AS sections, avg(ic) AS ic_mean, coalesce(stddev_samp(ic), 0) AS ic_std, coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0) AS icir,
    avg((ic > 1e-12)::INTEGER) AS ic_positive, {_sharpe_sql("benchmark")} AS sharpe_benchmark, {_sharpe_sql("gross - cost - benchmark")} AS sharpe_active, {_sharpe_sql("gross - cost - short")} AS sharpe_long_short,
    {_sharpe_sql("gross")} AS sharpe_gross, {_sharpe_sql("gross - cost")} AS sharpe_net, avg(cost) * 252 AS cost_drag, avg(turnover) AS turnover FROM sm GROUP BY 1)"""
SHOWN = ("ic_mean", "ic_std", "icir", "ic_positive", "sharpe_benchmark", "sharpe_active", "sharpe_long_short", "sharpe_gross", "sharpe_net", "cost_drag", "turnover")


def oracle_sql():
    show = lambda cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)
    return {
        "session_metrics": SESSIONS + f" SELECT ts, {show(('ic', 'benchmark', 'gross', 'short', 'turnover', 'cost'))} FROM sm",
        "relative_metrics": FOLDS + f" SELECT fold, sections, {show(SHOWN)} FROM fm",
        "pooled_folds": FOLDS + """, po AS (SELECT CASE WHEN fold % 2 = 0 THEN 'even' ELSE 'odd' END AS candidate, count(*) AS folds, coalesce(sum(sections) FILTER (sections >= 2), 0)::BIGINT AS sections,
            coalesce(sum(sections * ic_mean) FILTER (sections >= 2) / sum(sections) FILTER (sections >= 2), 0) AS ic_mean, coalesce(avg(ic_std) FILTER (sections >= 2), 0) AS sd, avg(sharpe_net) AS sharpe FROM fm GROUP BY 1)
            SELECT candidate, folds, sections, round(ic_mean, 6) AS ic_mean, round(CASE WHEN sd > 0 AND sections >= 2 THEN ic_mean / (sd / sqrt(sections)) ELSE 0 END, 6) AS ic_t, round(sharpe, 6) AS sharpe FROM po""",
        "gate": FOLDS + f""", ho AS (SELECT * FROM fm WHERE fold = (SELECT max(fold) FROM fm)), hr AS (SELECT *, (nr > 0)::INTEGER::DOUBLE AS y, avg((nr > 0)::INTEGER) OVER () AS base, count(*) OVER (PARTITION BY p) AS same,
              rank() OVER (ORDER BY p) AS r FROM sc WHERE year(ts) = (SELECT max(fold) FROM fm)),
            ft AS (SELECT stddev_pop(p) AS ps, avg(y) FILTER (i <= k) - avg(y) AS lift, avg(pow(p - y, 2) - pow(base - y, 2)) AS bd, stddev_samp(pow(p - y, 2) - pow(base - y, 2)) / sqrt(count(*)) AS bse,
              (sum(y * (r + (same - 1) / 2.0::DOUBLE)) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM hr),
            bl AS (SELECT max(ic) AS baseline FROM ({" UNION ALL ".join(f"SELECT avg(ic) AS ic FROM ({_ic_sql(c, 'hr')})" for c in BASELINE)})),
            fo AS (SELECT count(*) AS folds, count(*) FILTER (z <= 3 AND sharpe_active > 0) AS active FROM (SELECT *, row_number() OVER (ORDER BY fold DESC) AS z FROM fm WHERE fold < (SELECT max(fold) FROM fm)))
            SELECT 'return_5d' AS model, condition, passed FROM (SELECT unnest(['G0', 'G1', 'G2', 'G3', 'G4']) AS condition, unnest([ps > 0 AND sections >= 20 AND folds >= 2,
              ic_mean > 0 AND ic_mean / nullif(ic_std / sqrt(sections), 0) >= 2, ic_mean > baseline, sharpe_active > 0 AND sharpe_net > 0.5 AND lift > 0 AND active >= 2, bd <= 2 * bse AND auc > 0.5]) AS passed FROM ho, ft, bl, fo)""",
        "latest_vectors": FEATURES + """, lv AS (SELECT symbol, ts, return_5d, volume_ratio FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1),
            av AS (SELECT 'Brand#' || (user_id % 25 + 1)::VARCHAR AS symbol, CASE event_type WHEN 'click' THEN 'return_5d' WHEN 'purchase' THEN 'style_growth' ELSE 'style_value' END AS name, value, ts, event_id
              FROM events WHERE user_id % 5 <> 4 AND value IS NOT NULL),
            aw AS (SELECT symbol, arg_max(value, (ts, event_id)) FILTER (name = 'return_5d') AS a, arg_max(value, (ts, event_id)) FILTER (name = 'style_growth') AS g, arg_max(value, (ts, event_id)) FILTER (name = 'style_value') AS v FROM av GROUP BY 1)
            SELECT symbol, ts, round(coalesce(a, return_5d), 6) AS return_5d, round(volume_ratio, 6) AS volume_ratio, round(g, 6) AS style_growth, round(v, 6) AS style_value FROM lv LEFT JOIN aw USING (symbol)""",
        "macro_vintages": """WITH m AS (SELECT o_orderpriority AS series, date_trunc('month', o_orderdate)::DATE AS od, floor(avg(o_totalprice)) AS v FROM orders GROUP BY 1, 2)
            SELECT series, od AS observation_date, CASE WHEN month(od) % 3 <> 0 THEN od + 40 END AS realtime_start, v + CASE WHEN month(od) % 4 <> 1 THEN 2 ELSE 0 END AS value FROM m""",
    }
