"""Registered queries of rules, labels, folds, books, universes and costs, with their SQL for DuckDB."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import dataset as training
from tessera.operators import market, panel, strategy, study, universe
from tessera.operators import technical as tech
from tessera.operators.panel_queries import ADJUSTED, HORIZON, SCORED, _directional_sql, _read, _recursive_sql, _technical_sql, filings, rounded, unrounded
from tessera.operators.queries import BARS, FEATURES, _bars

LAGS, TRIALS, SLEEVES, BOOKS = 4, 20, 4, (1e4, 1e6)


def vectors(spark, sf_dir) -> DataFrame:
    """Every feature of every bar, and the rank of its month's momentum in its session."""
    b = _bars(spark, sf_dir)
    keys = ["symbol", "ts"]
    out = market.features(b).withColumn("momentum_rank", market.percentile_rank("momentum_20"))
    return out.join(tech.technical(b), keys).join(tech.recursive(b), keys).join(b.select(*keys, "close"), keys)


def rules(spark, sf_dir):
    return rounded(strategy.signals(vectors(spark, sf_dir)))


def gated(spark, sf_dir):
    """Signals that pass the envelope and the costs, with their Kelly weights and shares: the book's state follows from the row."""
    rows = strategy.signals(vectors(spark, sf_dir)).where("signal <> 'HOLD'")
    b = F.regexp_extract("symbol", "[0-9]+", 0).cast("int")
    rows = rows.withColumns({"drawdown": F.dayofmonth("ts") / 150.0, "daily_loss": F.month("ts") / 240.0, "exposure": b / 60.0, "in_sector": b % 4})
    rows = rows.withColumn("reason", strategy.envelope())
    tier = F.element_at(F.array(*[F.lit(t) for t in strategy.TIERS]), b % 4 + 1)
    entry = (F.col("stop") + F.col("target")) / 2
    kelly = strategy.kelly_weight(F.col("confidence"), F.lit(0.04))
    rows = rows.select(
        "symbol", "ts", "rule", "signal", "confidence", "reason", strategy.required_edge_bps(tier).alias("edge_bps"), kelly.alias("weight"),
        strategy.order_shares(F.lit(1e6), entry, F.col("stop"), F.col("drawdown")).alias("shares"),
    )
    return rounded(strategy.scaled_to_exposure(rows, "weight"))


def crossover_book(spark, sf_dir):
    """What holding by the crossover rule earns: yesterday's position less 10 basis points of every turn."""
    from pyspark.sql import Window

    v = vectors(spark, sf_dir)
    w = Window.partitionBy("symbol").orderBy("ts")
    pos = strategy.held(strategy.signals(v).where("rule = 'sma_ema_crossover'"))
    rows = pos.join(v.select("symbol", "ts", "return_1d"), ["symbol", "ts"]).select("symbol", "ts", F.lag("position").over(w).alias("p"), F.lag("position", 2, 0).over(w).alias("q"), "return_1d")
    rows = rows.where("p is not null and return_1d is not null").withColumn("turn", F.abs(F.col("p") - F.col("q")))
    rows = rows.withColumn("r", F.col("p") * F.col("return_1d") - F.col("turn") * 0.001)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    factor = 1 + F.col("r")  # a day may lose more than everything: the product keeps its sign
    sign = F.when(F.max(factor == 0).over(run), 0).when(F.sum((factor < 0).cast("int")).over(run) % 2 == 1, -1).otherwise(1)
    rows = rows.withColumn("equity", sign * F.exp(F.sum(F.when(factor != 0, F.log(F.abs(factor)))).over(run)))
    rows = rows.withColumn("peak", F.max("equity").over(run))
    return rows.groupBy("symbol").agg(
        F.max_by("equity", "ts").alias("growth"), F.coalesce(F.try_divide(F.avg("r"), F.stddev_samp("r")) * math.sqrt(252.0), F.lit(0.0)).alias("sharpe"),
        F.max(F.when(F.col("peak") > 0, 1 - F.col("equity") / F.col("peak"))).alias("max_drawdown"), F.count_if(F.col("turn") > 0).alias("trades"), F.count("*").alias("bars"),
    )


def _excess(spark, sf_dir):
    b = _bars(spark, sf_dir)
    rows = study.on_benchmark(tech.adjusted(b), panel.benchmark(b))
    return study.excess_barrier(rows, HORIZON)


def excess_barrier(spark, sf_dir):
    return _excess(spark, sf_dir)


def uniqueness(spark, sf_dir):
    return study.uniqueness(_excess(spark, sf_dir).where("touch is not null").select("symbol", "n", "touch"))


def label_profile(spark, sf_dir):
    return rounded(study.label_profile(_excess(spark, sf_dir), "symbol"))


def walk_forward(spark, sf_dir):
    return study.walk_forward(_bars(spark, sf_dir), 104, 26, HORIZON, 1).groupBy("fold", "role").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("sessions"))


def combinatorial(spark, sf_dir):
    return study.combinatorial(_bars(spark, sf_dir), 6, 2, HORIZON, 1).groupBy("split", "role").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("sessions"))


def _selected(spark, sf_dir):
    from pyspark.sql import Window

    nxt = F.lead("c").over(Window.partitionBy("symbol").orderBy("ts")) / F.col("c") - 1
    rows = market.features(_bars(spark, sf_dir)).withColumn("next_return", nxt).withColumn("p", market.percentile_rank("return_5d"))
    rows = rows.where("p is not null and next_return is not null")
    best = market.top_quantile(rows, "p").select("symbol", "ts")
    return rows.select("symbol", "ts", "p", "next_return"), best


def tranche_book(spark, sf_dir):
    rows, best = _selected(spark, sf_dir)
    return rounded(study.book_returns(study.tranches(best, SLEEVES), rows))


def book_performance(spark, sf_dir):
    rows, best = _selected(spark, sf_dir)
    return rounded(study.performance(study.book_returns(study.tranches(best, SLEEVES), rows)))


def selection_quality(spark, sf_dir):
    rows, best = _selected(spark, sf_dir)
    rows = rows.join(best.withColumn("selected", F.lit(True)), ["symbol", "ts"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    return rounded(study.selection_quality(rows.withColumn("y", (F.col("next_return") > 0).cast("double"))))


def feature_evidence(spark, sf_dir):
    """Mean rank correlation of each feature with the next return, its error corrected for overlap, strongest first."""
    rows = market.features(_bars(spark, sf_dir))
    from pyspark.sql import Window

    rows = rows.withColumn("next_return", F.lead("c").over(Window.partitionBy("symbol").orderBy("ts")) / F.col("c") - 1)
    names = ("return_1d", "return_5d", "return_20d", "realized_vol_20", "volume_ratio", "max_ret_1m")
    long = rows.select("ts", "next_return", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("x")) for n in names])).alias("f")).select("ts", "next_return", "f.*")
    long = long.where("x is not null and next_return is not null")
    by = ["ts", "feature"]
    ranks = long.select(*by, panel.average_rank("x", by).alias("a"), panel.average_rank("next_return", by).alias("b"))
    ic = ranks.groupBy(*by).agg(F.count("*").alias("m"), panel.correlation("a", "b").alias("ic")).where("m >= 3 and ic is not null and not isnan(ic)")
    return rounded(study.newey_west(ic, "ic", "feature", LAGS))


def deflated(spark, sf_dir):
    return rounded(study.deflated_sharpe(market.features(_bars(spark, sf_dir)), "return_1d", "symbol", TRIALS))


def pair_correlations(spark, sf_dir):
    return rounded(study.pair_correlations(market.features(_bars(spark, sf_dir)), "return_1d"))


def effective_samples(spark, sf_dir):
    rows = market.features(_bars(spark, sf_dir)).where("return_1d is not null")
    return rounded(study.effective_samples(rows, study.pair_correlations(rows, "return_1d"), HORIZON))


def universe_members(spark, sf_dir):
    return rounded(universe.members(_bars(spark, sf_dir), 10))


def universe_churn(spark, sf_dir):
    return rounded(universe.churn(universe.members(_bars(spark, sf_dir), 10)))


def universe_sessions(spark, sf_dir):
    b = _bars(spark, sf_dir)
    return universe.members_on(b, universe.members(b, 10)).groupBy("symbol").agg(F.count("*").alias("sessions"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def survivorship(spark, sf_dir):
    return universe.survivorship(_bars(spark, sf_dir), 0)


def fetch_plan(spark, sf_dir):
    symbols = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).unionByName(_read(spark, sf_dir, "supplier").select(F.col("s_name").alias("symbol")))
    return universe.fetch_plan(symbols, market.coverage(_bars(spark, sf_dir)), F.lit("2024-06-03").cast("date"), 7300, 10)


def trading_costs(spark, sf_dir):
    return rounded(universe.costs(_bars(spark, sf_dir), list(BOOKS)))


def capacity(spark, sf_dir):
    return rounded(universe.capacity(universe.costs(_bars(spark, sf_dir), list(BOOKS))))


def f_scores(spark, sf_dir):
    rows = filings(spark, sf_dir).select(
        "symbol", "period_end", "revenue", "net_income", "total_assets", "total_liabilities", (F.col("net_income") - F.col("cost_of_revenue") / 50 + 1000).alias("operating_cash_flow"),
        (F.col("total_assets") / 3).alias("current_assets"), (F.col("total_liabilities") / 7).alias("current_liabilities"), F.floor(F.col("total_assets") / 1000).alias("shares_outstanding"),
    )
    return strategy.scored_history(rows).select("symbol", "period_end", *strategy.SCORES, "f_score")


def _macro(spark, sf_dir):
    """Monthly means of five order priorities, brought to the scale of rates, a corporate yield and a purchasing index."""
    rows = _read(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("day")).pivot("o_orderpriority", PRIORITIES).agg(F.avg("o_totalprice") / 1e5)
    ten, two, baa, pmi = (F.col(f"`{p}`") for p in PRIORITIES[:4])
    return rows.select("day", (ten - two).alias("curve"), (baa * 2.2 - ten).alias("spread"), F.when(F.month("day") % 3 != 0, 33 * pmi).alias("pmi"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def regimes(spark, sf_dir):
    rows = _macro(spark, sf_dir).withColumn("regime", strategy.regime())
    return rounded(rows.select("*", strategy.exposure_cap(F.col("regime")).alias("exposure_cap"), strategy.sector_allowed(F.col("regime"), F.lit("Information Technology")).alias("tech_allowed")))


RAW = ["return_5d", "return_20d", "realized_vol_20", "volume_ratio"]
RANKS = [*RAW, "net_margin", "roa", "leverage", "gross_profitability", "asset_growth"]


def _dataset(spark, sf_dir):
    rows = market.features(_bars(spark, sf_dir)).withColumn("sector", F.regexp_extract("symbol", "[0-9]+", 0).cast("int") % 6)
    return training.build(rows, RAW, filings(spark, sf_dir), _excess(spark, sf_dir), _macro(spark, sf_dir).withColumn("regime", strategy.regime()))


def dataset(spark, sf_dir):
    return _dataset(spark, sf_dir)


def data_contract(spark, sf_dir):
    return rounded(training.contract(_dataset(spark, sf_dir), RANKS))


def queries():
    made = [dataset, data_contract, rules, gated, crossover_book, excess_barrier, uniqueness, label_profile, walk_forward, combinatorial, tranche_book, book_performance, selection_quality, feature_evidence, deflated, pair_correlations, effective_samples, universe_members, universe_churn, universe_sessions, survivorship, fetch_plan, trading_costs, capacity, f_scores, regimes]
    return {q.__name__: q for q in made}


VECTORS = f"""WITH ft AS ({FEATURES} SELECT * FROM f), th AS ({unrounded(_technical_sql())}), rc AS ({unrounded(_recursive_sql())}), dr AS ({unrounded(_directional_sql())}), rw AS ({BARS} SELECT symbol, ts, close FROM b),
  mr AS (SELECT *, CASE WHEN momentum_20 IS NULL THEN NULL WHEN count(momentum_20) OVER (PARTITION BY ts) = 1 THEN 0.5
    ELSE (rank() OVER (PARTITION BY ts, momentum_20 IS NULL ORDER BY momentum_20) - 1 + (count(*) OVER (PARTITION BY ts, momentum_20) - 1) / 2.0) / (count(momentum_20) OVER (PARTITION BY ts) - 1) END::DOUBLE AS mrank FROM ft),
  v AS (SELECT mr.*, bb_pct_b, donchian_pos_20, ema_12, ema_26, rsi_14, atr_pct_14, macd_hist, close
    FROM mr JOIN th USING (symbol, ts) JOIN rc USING (symbol, ts) JOIN dr USING (symbol, ts) JOIN rw USING (symbol, ts))"""
SIGNALS = VECTORS + """,
  e AS (SELECT *, ema_12 / CASE WHEN ema_26 > 0 THEN ema_26 END - 1 AS fast, sma_20 / CASE WHEN sma_50 > 0 THEN sma_50 END - 1 AS slow, macd_hist / CASE WHEN c > 0 THEN c END AS line FROM v),
  o AS (SELECT symbol, ts, close, atr_pct_14, 'momentum_rank' AS rule, CASE WHEN mrank >= 0.8 AND rsi_14 < 70 THEN 'BUY' WHEN mrank <= 0.2 AND rsi_14 > 30 THEN 'SELL' ELSE 'HOLD' END AS signal, greatest(mrank, 1 - mrank) AS x, 2.0::DOUBLE AS sm, 2.0::DOUBLE AS rr FROM e
    UNION ALL SELECT symbol, ts, close, atr_pct_14, 'rsi_bollinger_reversion', CASE WHEN rsi_14 <= 30 AND bb_pct_b <= 0.05 THEN 'BUY' WHEN rsi_14 >= 70 AND bb_pct_b >= 0.95 THEN 'SELL' ELSE 'HOLD' END,
      0.5 + 0.5 * least(1, abs(CASE WHEN rsi_14 <= 30 THEN 30 - rsi_14 ELSE rsi_14 - 70 END) / 10), 1.5, 1.5 FROM e
    UNION ALL SELECT symbol, ts, close, atr_pct_14, 'sma_ema_crossover', CASE WHEN fast > 0 AND slow > 0 THEN 'BUY' WHEN fast < 0 AND slow < 0 THEN 'SELL' ELSE 'HOLD' END, 0.5 + 0.5 * least(1, least(abs(fast), abs(slow)) / 0.03::DOUBLE), 2.0, 2.0 FROM e
    UNION ALL SELECT symbol, ts, close, atr_pct_14, 'macd_confirmation', CASE WHEN line > 0 AND return_20d > 0 THEN 'BUY' WHEN line < 0 AND return_20d < 0 THEN 'SELL' ELSE 'HOLD' END, 0.5 + 0.5 * least(1, abs(line) / 0.01::DOUBLE), 2.0, 2.0 FROM e
    UNION ALL SELECT symbol, ts, close, atr_pct_14, 'donchian_breakout', CASE WHEN donchian_pos_20 > 1 THEN 'BUY' WHEN donchian_pos_20 < 0 THEN 'SELL' ELSE 'HOLD' END,
      0.5 + 0.5 * least(1, CASE WHEN donchian_pos_20 > 1 THEN donchian_pos_20 - 1 ELSE -donchian_pos_20 END / 0.1::DOUBLE), 2.5, 2.5 FROM e),
  d AS (SELECT *, CASE signal WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 END * close * coalesce(CASE WHEN atr_pct_14 > 0 THEN atr_pct_14 * sm END, 0.05::DOUBLE) AS dist FROM o),
  sg AS (SELECT symbol, ts, rule, signal, CASE signal WHEN 'HOLD' THEN 0.5 ELSE x END::DOUBLE AS confidence, close - dist AS stop, close + dist * rr AS target FROM d)"""
BENCH = ADJUSTED + """, cal AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS before FROM (SELECT DISTINCT ts FROM n)),
  st AS (SELECT ts, count(lr) FILTER (own = before) AS names, median(lr) FILTER (own = before) AS m FROM n JOIN cal USING (ts) GROUP BY 1),
  bl AS (SELECT ts, exp(sum(CASE WHEN names >= 3 THEN m ELSE 0 END) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS market FROM st),
  xs AS (SELECT symbol, ts, n, ln(c / market) AS x FROM n JOIN bl USING (ts)),
  xd AS (SELECT *, x - lag(x) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM xs)"""
LABELS = BENCH + f""", xw AS (SELECT *, CASE WHEN count(d) OVER w20 = 20 THEN nullif(stddev_samp(d) OVER w20, 0) END * sqrt({HORIZON}) AS width,
    list({{'n': n, 'x': x}}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {HORIZON} FOLLOWING) AS nx FROM xd WINDOW w20 AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
  xh AS (SELECT *, list_filter(nx, lambda y: y.x - x <= -width OR y.x - x >= width)[1] AS hit, nx[{HORIZON}] AS fin FROM xw),
  xb AS (SELECT *, CASE WHEN width IS NULL THEN NULL WHEN hit.x - x < 0 THEN 'lower' WHEN hit.x - x > 0 THEN 'upper' WHEN fin.n IS NOT NULL THEN 'vertical' END AS barrier FROM xh),
  lb AS (SELECT symbol, ts, n::INTEGER AS n, CASE WHEN barrier IS NOT NULL THEN coalesce(hit.n, fin.n) END::INTEGER AS touch, barrier,
    CASE barrier WHEN 'vertical' THEN (fin.x > x)::INTEGER WHEN 'upper' THEN 1 WHEN 'lower' THEN 0 END::INTEGER AS label FROM xb)"""
PICKED = SCORED + """, pk AS (SELECT symbol, ts, next_return, CASE WHEN count(return_5d) OVER (PARTITION BY ts) = 1 THEN 0.5
    ELSE (rank() OVER (PARTITION BY ts ORDER BY return_5d) - 1 + (count(*) OVER (PARTITION BY ts, return_5d) - 1) / 2.0) / (count(*) OVER (PARTITION BY ts) - 1) END::DOUBLE AS p FROM s WHERE return_5d IS NOT NULL),
  pr AS (SELECT * FROM pk WHERE next_return IS NOT NULL),
  pb AS (SELECT symbol, ts FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY p DESC, symbol) AS i, count(*) OVER (PARTITION BY ts) AS m FROM pr) WHERE i <= greatest(1, ceil(m * 0.2)))"""
TRANCHES = PICKED + f""", ss AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM (SELECT DISTINCT ts FROM pb)),
  sl AS (SELECT symbol, i, 1.0::DOUBLE / count(*) OVER (PARTITION BY ts) / {SLEEVES} AS w FROM pb JOIN ss USING (ts)),
  bk AS (SELECT a.ts, a.i, symbol, sum(w) AS weight FROM ss a JOIN sl ON a.i BETWEEN sl.i AND sl.i + {SLEEVES - 1} GROUP BY 1, 2, 3),
  ch AS (SELECT coalesce(x.i, y.i + 1) AS i, coalesce(x.symbol, y.symbol) AS symbol, coalesce(x.weight, 0) AS weight, coalesce(y.weight, 0) AS was FROM bk x FULL JOIN bk y ON x.symbol = y.symbol AND x.i = y.i + 1),
  tb AS (SELECT ss.ts, count(*) FILTER (ch.weight > 0) AS positions, sum(abs(ch.weight - ch.was)) / 2 AS turnover, coalesce(sum(ch.weight * pr.next_return), 0) AS gross
    FROM ch JOIN ss ON ch.i = ss.i LEFT JOIN pr ON pr.ts = ss.ts AND pr.symbol = ch.symbol GROUP BY 1)"""
MEMBERS = BARS + """, lq AS (SELECT symbol, ts, row_number() OVER w AS n, CASE WHEN count(*) OVER w63 > 31 THEN median(close * volume) OVER w63 END AS liquidity FROM b
    WINDOW w AS (PARTITION BY symbol ORDER BY ts), w63 AS (PARTITION BY symbol ORDER BY ts ROWS 62 PRECEDING)),
  rb AS (SELECT ts FROM (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT DISTINCT ts FROM b)) WHERE i % 63 = 0),
  mm AS (SELECT ts, symbol, liquidity, row_number() OVER (PARTITION BY ts ORDER BY liquidity DESC, symbol) AS place FROM lq JOIN rb USING (ts) WHERE n >= 63 AND liquidity IS NOT NULL QUALIFY place <= 10)"""
COSTS = BARS + f""", k1 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM b),
  k2 AS (SELECT *, coalesce(greatest(lag(close) OVER w - high, 0) - greatest(low - lag(close) OVER w, 0), 0) AS shift FROM k1 WHERE k <= 252 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  k3 AS (SELECT symbol, ts, high + shift AS h, low + shift AS l FROM k2),
  k4 AS (SELECT symbol, pow(ln(h / l), 2) + pow(ln(lag(h) OVER w / lag(l) OVER w), 2) AS beta, pow(ln(greatest(h, lag(h) OVER w) / least(l, lag(l) OVER w)), 2) AS gamma, lag(h) OVER w AS ph FROM k3 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  k5 AS (SELECT symbol, avg(beta) FILTER (ph IS NOT NULL) AS b, avg(gamma) FILTER (ph IS NOT NULL) AS g FROM k4 GROUP BY 1),
  k6 AS (SELECT symbol, (sqrt(2 * b) - sqrt(b)) / (3 - 2 * sqrt(2)) - sqrt(g / (3 - 2 * sqrt(2))) AS a FROM k5),
  k7 AS (SELECT symbol, close * volume AS dv, adj_close / lag(adj_close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM k1 WHERE k <= 63),
  k8 AS (SELECT symbol, median(dv) AS dv, stddev_samp(r) AS vol FROM k7 GROUP BY 1),
  k9 AS (SELECT symbol, aum, greatest(least((exp(a) - 1) / (1 + exp(a)) * 1e4, 100), 1) AS half_spread, aum * 0.05::DOUBLE / dv AS participation, vol FROM k6 JOIN k8 USING (symbol), (VALUES ({BOOKS[0]:.1f}::DOUBLE), ({BOOKS[1]:.1f}::DOUBLE)) AS t(aum)),
  kc AS (SELECT symbol, aum, half_spread, participation, vol * sqrt(least(participation, 0.1::DOUBLE)) * 1e4 AS impact, half_spread + vol * sqrt(least(participation, 0.1::DOUBLE)) * 1e4 AS total_bps, participation <= 0.1::DOUBLE AS tradeable FROM k9)"""
PAIRS = SCORED + """, rt AS (SELECT symbol, ts, return_1d AS r FROM s WHERE return_1d IS NOT NULL),
  pc AS (SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, corr(x.r, y.r) AS corr FROM rt x JOIN rt y ON x.ts = y.ts AND x.symbol < y.symbol GROUP BY 1, 2 HAVING count(*) > 30)"""


def _evidence_sql() -> str:
    names = ("return_1d", "return_5d", "return_20d", "realized_vol_20", "volume_ratio", "max_ret_1m")
    each = " UNION ALL ".join(f"SELECT ts, '{n}' AS feature, {n} AS x, nr FROM nx WHERE {n} IS NOT NULL AND nr IS NOT NULL" for n in names)
    sums = " + ".join(f"2 * (1 - {k}::DOUBLE / {LAGS + 1}) * coalesce(sum(e{k}), 0)" for k in range(1, LAGS + 1))
    lags = ", ".join(f"e * lag(e, {k}) OVER (PARTITION BY feature ORDER BY ts) AS e{k}" for k in range(1, LAGS + 1))
    return FEATURES + f""", nx AS (SELECT *, lead(c) OVER (PARTITION BY symbol ORDER BY ts) / c - 1 AS nr FROM f), lg AS ({each}),
      rk AS (SELECT ts, feature, rank() OVER (PARTITION BY ts, feature ORDER BY x) + (count(*) OVER (PARTITION BY ts, feature, x) - 1) / 2 AS a, rank() OVER (PARTITION BY ts, feature ORDER BY nr) + (count(*) OVER (PARTITION BY ts, feature, nr) - 1) / 2 AS b FROM lg),
      ic AS (SELECT ts, feature, corr(a, b) AS ic FROM rk GROUP BY 1, 2 HAVING count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0),
      ce AS (SELECT *, ic - avg(ic) OVER (PARTITION BY feature) AS e FROM ic), lz AS (SELECT *, {lags} FROM ce),
      sm AS (SELECT feature, count(*) AS n, avg(ic) AS mean, sum(e * e) + {sums} AS s FROM lz GROUP BY 1)
      SELECT feature, n, round(mean, 6) AS mean, round(sqrt(s) / n, 6) AS se, round(mean / (sqrt(s) / n), 6) AS t FROM sm"""


def _dataset_sql(known: dict[str, str]) -> str:
    def neutral(name: str, k: int) -> str:
        return f"""n{k} AS (SELECT * REPLACE ({name} - CASE WHEN count({name}) OVER w >= 4 THEN median({name}) OVER w ELSE 0 END AS {name}) FROM (SELECT * REPLACE (CASE WHEN count({name}) OVER (PARTITION BY ts, sector) >= 4 THEN sector END AS grp) FROM n{k - 1}) WINDOW w AS (PARTITION BY ts, grp))"""

    def rank(name: str) -> str:
        return f"""coalesce(CASE WHEN {name} IS NULL THEN NULL WHEN count({name}) OVER (PARTITION BY ts) = 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY ts, {name} IS NULL ORDER BY {name}) - 1
          + (count(*) OVER (PARTITION BY ts, {name}) - 1) / 2.0) / (count({name}) OVER (PARTITION BY ts) - 1) END, 0.5)::DOUBLE AS {name}"""

    chain = ", ".join(neutral(name, k) for k, name in enumerate(RANKS, 1))
    hot = ", ".join(f"coalesce(regime = '{r}', false)::INTEGER::DOUBLE AS regime_{r}" for r in strategy.EXPOSURE)
    return f"""WITH ft AS ({FEATURES} SELECT * FROM f), lb AS ({known['excess_barrier']}), un AS ({known['uniqueness']}), rg AS ({known['regimes']}),
      fi AS (SELECT p_brand AS symbol, (date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH)::DATE AS period_end, sum(l_extendedprice) AS revenue, sum(l_extendedprice * (1 - l_discount)) * 0.6::DOUBLE AS cost, sum(l_extendedprice * l_tax) * 2 AS income,
        sum(l_quantity) * 1000 AS assets, sum(l_extendedprice * l_discount) * 4 AS debt FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
      fd AS (SELECT *, lag(assets) OVER (PARTITION BY symbol ORDER BY period_end) AS was, (period_end + (20 + regexp_extract(symbol, '[0-9]+')::INTEGER))::TIMESTAMP AS filed_at FROM fi WHERE regexp_extract(symbol, '[0-9]+')::INTEGER % 11 <> 0),
      n0 AS (SELECT ft.symbol, ft.ts, regexp_extract(ft.symbol, '[0-9]+')::INTEGER % 6 AS sector, NULL::INTEGER AS grp, fd.symbol IS NOT NULL AS has_filing, {', '.join(RAW)}, income / nullif(revenue, 0) AS net_margin, income / nullif(assets, 0) AS roa,
        debt / nullif(assets, 0) AS leverage, (revenue - cost) / nullif(assets, 0) AS gross_profitability, assets / nullif(was, 0) - 1 AS asset_growth FROM ft ASOF LEFT JOIN fd ON ft.symbol = fd.symbol AND ft.ts > fd.filed_at), {chain},
      rk AS (SELECT symbol, ts, has_filing, {', '.join(rank(name) for name in RANKS)} FROM n{len(RANKS)}),
      jn AS (SELECT rk.*, lb.label, un.weight FROM rk JOIN lb ON rk.symbol = lb.symbol AND rk.ts = lb.ts AND lb.label IS NOT NULL JOIN un ON un.symbol = lb.symbol AND un.n = lb.n QUALIFY count(*) OVER (PARTITION BY rk.ts) >= 10),
      ds AS (SELECT jn.*, {hot} FROM jn ASOF LEFT JOIN (SELECT day::TIMESTAMP AS day, regime FROM rg WHERE regime IS NOT NULL) m ON jn.ts >= m.day)"""


def oracle_sql():
    known = _oracle_sql()
    made = _dataset_sql(known)
    flat = " + ".join(f"(coalesce(var_pop({c}), 0) = 0)::INTEGER" for c in RANKS)
    return known | {
        "dataset": f"{made} SELECT * FROM ds",
        "data_contract": f"""{made}, wd AS (SELECT ts, count(*) AS m FROM ds GROUP BY 1) SELECT count(*) AS samples, round(avg(label), 6) AS positive_rate, round(sum(weight), 6) AS effective_rows, ({flat})::INTEGER AS constant_features,
            count(*) FILTER (NOT ({' AND '.join(f'{c} BETWEEN 0 AND 1' for c in RANKS)})) AS out_of_range, (SELECT count(*) FROM wd) AS sessions, (SELECT median(m) FROM wd) AS median_names, (SELECT min(m) FROM wd) AS least_names FROM ds""",
    }


def _oracle_sql():
    gates = """CASE WHEN day(ts) / 150.0::DOUBLE >= 0.15::DOUBLE THEN 'drawdown' WHEN month(ts) / 240.0::DOUBLE >= 0.05::DOUBLE THEN 'daily_loss' WHEN confidence < 0.55::DOUBLE THEN 'confidence'
        WHEN br / 60.0::DOUBLE >= 0.8::DOUBLE THEN 'exposure' WHEN br % 4 >= 3 THEN 'sector' WHEN stop IS NULL THEN 'missing_stop' ELSE 'approved' END"""
    return {
        "rules": SIGNALS + " SELECT symbol, ts, rule, signal, round(confidence, 6) AS confidence, round(stop, 6) AS stop, round(target, 6) AS target FROM sg",
        "gated": SIGNALS + f""", g1 AS (SELECT *, regexp_extract(symbol, '[0-9]+')::INTEGER AS br, (stop + target) / 2 AS entry, day(ts) / 150.0::DOUBLE AS dd FROM sg WHERE signal <> 'HOLD'),
            g2 AS (SELECT *, {gates} AS reason, greatest(0, least(CASE WHEN 2 * least(greatest(confidence, 0), 1) - 1 < 0.02::DOUBLE THEN 0 ELSE 2 * least(greatest(confidence, 0), 1) - 1 END * 0.25::DOUBLE, 0.05::DOUBLE, 0.04::DOUBLE)) AS w,
              0.02::DOUBLE * greatest(0, least(1, 1 - (dd - 0.05::DOUBLE) / 0.1::DOUBLE)) AS budget FROM g1)
            SELECT symbol, ts, rule, signal, round(confidence, 6) AS confidence, reason, 48.0::DOUBLE * CASE br % 4 WHEN 0 THEN 1 WHEN 1 THEN 1.5 WHEN 2 THEN 2.5 ELSE 5 END AS edge_bps,
              round(w * least(1, 0.8::DOUBLE / nullif(sum(w) OVER (PARTITION BY ts), 0)), 6) AS weight, coalesce(least(floor(1e6 * budget / nullif(abs(entry - stop), 0)), floor(1e6 * 0.05::DOUBLE / entry)), 0)::BIGINT AS shares FROM g2""",
        "crossover_book": SIGNALS + """, h1 AS (SELECT symbol, ts, coalesce(last_value(CASE signal WHEN 'BUY' THEN 1 WHEN 'SELL' THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS pos FROM sg WHERE rule = 'sma_ema_crossover'),
            h2 AS (SELECT h1.symbol, h1.ts, lag(pos) OVER w AS p, lag(pos, 2, 0) OVER w AS q, return_1d AS r1 FROM h1 JOIN v USING (symbol, ts) WINDOW w AS (PARTITION BY h1.symbol ORDER BY h1.ts)),
            h3 AS (SELECT symbol, ts, abs(p - q) AS turn, p * r1 - abs(p - q) * 0.001::DOUBLE AS r FROM h2 WHERE p IS NOT NULL AND r1 IS NOT NULL),
            h4 AS (SELECT *, CASE WHEN max((1 + r = 0)::INTEGER) OVER w = 1 THEN 0 WHEN sum((1 + r < 0)::INTEGER) OVER w % 2 = 1 THEN -1 ELSE 1 END * exp(sum(ln(nullif(abs(1 + r), 0))) OVER w) AS eq FROM h3
              WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
            h5 AS (SELECT *, max(eq) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM h4)
            SELECT symbol, arg_max(eq, ts) AS growth, coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0) AS sharpe, max(CASE WHEN peak > 0 THEN 1 - eq / peak END) AS max_drawdown, count(*) FILTER (turn > 0) AS trades, count(*) AS bars FROM h5 GROUP BY 1""",
        "excess_barrier": LABELS + " SELECT * FROM lb",
        "uniqueness": LABELS + """, sp AS (SELECT symbol, n, touch FROM lb WHERE touch IS NOT NULL), op AS (SELECT symbol, n AS s, unnest(range(n, touch + 1)) AS sess FROM sp),
            cc AS (SELECT symbol, sess, count(*) AS k FROM op GROUP BY 1, 2) SELECT symbol, s AS n, avg(1.0::DOUBLE / k) AS weight FROM op JOIN cc USING (symbol, sess) GROUP BY 1, 2""",
        "label_profile": LABELS + """ SELECT symbol, count(*) AS labels, round(avg((barrier = 'lower')::INTEGER), 6) AS lower_share, round(avg((barrier = 'upper')::INTEGER), 6) AS upper_share,
            round(avg((barrier = 'vertical')::INTEGER), 6) AS vertical_share, round(avg(label), 6) AS positive_rate FROM lb WHERE barrier IS NOT NULL GROUP BY 1""",
        "walk_forward": BARS + f""", x AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT ts FROM b)),
            y AS (SELECT k::INTEGER AS fold, ts, CASE WHEN i >= k * 26 AND i < k * 26 + 104 - {HORIZON + 1} THEN 'train' WHEN i >= k * 26 + 104 AND i < k * 26 + 130 THEN 'test' END AS role FROM x, range(0, 1000) t(k) WHERE k * 26 + 130 <= m)
            SELECT fold, role, min(ts) AS first, max(ts) AS last, count(*) AS sessions FROM y WHERE role IS NOT NULL GROUP BY 1, 2""",
        "combinatorial": BARS + f""", x AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT ts FROM b)),
            c AS (SELECT p, q, (row_number() OVER (ORDER BY p, q) - 1)::INTEGER AS split FROM range(6) t(p), range(6) u(q) WHERE p < q),
            y AS (SELECT split, ts, CASE WHEN (i >= m * p // 6 AND i < m * (p + 1) // 6) OR (i >= m * q // 6 AND i < m * (q + 1) // 6) THEN 'test'
              WHEN NOT ((i >= m * p // 6 - {HORIZON + 1} AND i < m * (p + 1) // 6 + {HORIZON + 1}) OR (i >= m * q // 6 - {HORIZON + 1} AND i < m * (q + 1) // 6 + {HORIZON + 1})) THEN 'train' END AS role FROM x, c)
            SELECT split, role, min(ts) AS first, max(ts) AS last, count(*) AS sessions FROM y WHERE role IS NOT NULL GROUP BY 1, 2""",
        "tranche_book": TRANCHES + " SELECT ts, positions, round(turnover, 6) AS turnover, round(gross, 6) AS gross FROM tb",
        "book_performance": TRANCHES + """ SELECT count(*) AS sessions, round(avg(gross), 6) AS mean_return, round(avg(gross) / stddev_samp(gross) * sqrt(252), 6) AS sharpe, round(avg(positions), 6) AS avg_positions, round(avg(turnover), 6) AS avg_turnover FROM tb""",
        "selection_quality": PICKED + """, y AS (SELECT p, (next_return > 0)::INTEGER::DOUBLE AS y, pb.symbol IS NOT NULL AS sel, avg((next_return > 0)::INTEGER) OVER () AS base FROM pr LEFT JOIN pb USING (symbol, ts))
            SELECT round(avg(y), 6) AS base_rate, round(avg(y) FILTER (sel), 6) AS hit_rate, round(avg(y) FILTER (sel) / avg(y), 6) AS lift, round(avg(p), 6) AS pred_mean, round(stddev_pop(p), 6) AS pred_std, round(quantile_cont(p, 0.1), 6) AS pred_p10,
              round(quantile_cont(p, 0.9), 6) AS pred_p90, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(pow(p - y, 2) - pow(base - y, 2)), 6) AS brier_delta, round(stddev_samp(pow(p - y, 2) - pow(base - y, 2)) / sqrt(count(*)), 6) AS brier_se FROM y""",
        "feature_evidence": _evidence_sql(),
        "pair_correlations": PAIRS + " SELECT a, b, n, round(corr, 6) AS corr FROM pc",
        "effective_samples": PAIRS + f""", z AS (SELECT count(*) AS samples, count(DISTINCT ts) AS sessions, count(DISTINCT symbol) AS names, (SELECT coalesce(avg(corr), 0) FROM pc) AS rho FROM rt)
            SELECT samples, sessions, names, round(rho, 6) AS rho, round(names / (1 + (names - 1) * greatest(rho, 0)), 6) AS effective_names, round(sessions / {HORIZON}.0::DOUBLE, 6) AS periods, round(names / (1 + (names - 1) * greatest(rho, 0)) * (sessions / {HORIZON}.0::DOUBLE), 6) AS effective_samples FROM z""",
        "universe_members": MEMBERS + " SELECT ts, symbol, round(liquidity, 6) AS liquidity, place::INTEGER AS place FROM mm",
        "universe_churn": MEMBERS + """, dt AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS prev FROM (SELECT DISTINCT ts FROM mm)), o AS (SELECT dt.ts, prev, len(list_intersect(a.l, b.l)) AS k, len(a.l) AS na, len(b.l) AS nb FROM dt
              JOIN (SELECT ts, list(symbol) AS l FROM mm GROUP BY 1) a ON a.ts = dt.ts LEFT JOIN (SELECT ts, list(symbol) AS l FROM mm GROUP BY 1) b ON b.ts = dt.prev)
            SELECT ts, na AS size, round(CASE WHEN nb > 0 THEN (na + nb - 2 * k)::DOUBLE / (na + nb - k) END, 6) AS turnover FROM o""",
        "universe_sessions": MEMBERS + """, a AS (SELECT b.symbol, b.ts, (SELECT max(r.ts) FROM (SELECT DISTINCT ts FROM mm) r WHERE r.ts <= b.ts) AS reb FROM b)
            SELECT a.symbol, count(*) AS sessions, min(a.ts) AS first, max(a.ts) AS last FROM a JOIN mm ON mm.ts = a.reb AND mm.symbol = a.symbol GROUP BY 1""",
        "survivorship": BARS + """, e AS (SELECT symbol, min(ts) AS a, max(ts) AS z FROM b GROUP BY 1) SELECT count(*) AS symbols, count(*) FILTER (date_diff('day', (SELECT min(ts) FROM b), a) > 0) AS late_starters,
            count(*) FILTER (date_diff('day', z, (SELECT max(ts) FROM b)) > 0) AS early_enders FROM e""",
        "fetch_plan": BARS + """, y AS (SELECT DISTINCT p_brand AS symbol FROM part UNION SELECT s_name FROM supplier), e AS (SELECT symbol, min(ts) AS a, max(ts) AS z FROM b GROUP BY 1)
            SELECT symbol, CASE WHEN z IS NULL THEN 'full' ELSE 'incremental' END AS mode, CASE WHEN z IS NULL THEN DATE '2024-06-03' - 7300 ELSE least(z::DATE - 10, DATE '2024-06-03') END AS start, least(DATE '2024-06-03' - 7300, a::DATE) AS repair_start,
              date_diff('day', z::DATE, DATE '2024-06-03')::INTEGER AS age_days FROM y LEFT JOIN e USING (symbol)""",
        "trading_costs": COSTS + " SELECT symbol, aum, round(half_spread, 6) AS half_spread, round(participation, 6) AS participation, round(impact, 6) AS impact, round(total_bps, 6) AS total_bps, tradeable FROM kc",
        "capacity": COSTS + """ SELECT aum, count(*) AS names, round(median(total_bps), 6) AS median_bps, round(quantile_cont(total_bps, 0.9), 6) AS p90_bps, round(max(total_bps), 6) AS max_bps, round(avg((NOT tradeable)::INTEGER), 6) AS untradeable FROM kc GROUP BY 1""",
        "f_scores": """WITH f AS (SELECT p_brand AS symbol, (date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH)::DATE AS period_end, sum(l_extendedprice) AS revenue, sum(l_extendedprice * (1 - l_discount)) * 0.6::DOUBLE AS cost, sum(l_extendedprice * l_tax) * 2 AS ni,
              sum(l_quantity) * 1000 AS ta, sum(l_extendedprice * l_discount) * 4 AS tl FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
            g AS (SELECT *, ni - cost / 50 + 1000 AS ocf, ta / 3 AS ca, tl / 7 AS cl, floor(ta / 1000) AS so FROM f),
            h AS (SELECT *, lag(ni / nullif(ta, 0)) OVER w AS roa0, lag(tl / nullif(ta, 0)) OVER w AS lev0, lag(ca / nullif(cl, 0)) OVER w AS cr0, lag(so) OVER w AS so0, lag(ni / nullif(revenue, 0)) OVER w AS m0, lag(revenue / nullif(ta, 0)) OVER w AS t0 FROM g WINDOW w AS (PARTITION BY symbol ORDER BY period_end)),
            s AS (SELECT symbol, period_end, coalesce(ni > 0, false) AS income_positive, coalesce(ocf > 0, false) AS cash_positive, coalesce(ocf > ni, false) AS cash_above_income, coalesce(ni / nullif(ta, 0) > roa0, false) AS roa_up, coalesce(tl / nullif(ta, 0) < lev0, false) AS leverage_down,
              coalesce(ca / nullif(cl, 0) > cr0, false) AS liquidity_up, coalesce(so <= so0, false) AS no_dilution, coalesce(ni / nullif(revenue, 0) > m0, false) AS margin_up, coalesce(revenue / nullif(ta, 0) > t0, false) AS turnover_up FROM h)
            SELECT *, (income_positive::INT + cash_positive::INT + cash_above_income::INT + roa_up::INT + leverage_down::INT + liquidity_up::INT + no_dilution::INT + margin_up::INT + turnover_up::INT)::INTEGER AS f_score FROM s""",
        "regimes": """WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS day, avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') / 1e5 AS ten, avg(o_totalprice) FILTER (o_orderpriority = '2-HIGH') / 1e5 AS two,
              avg(o_totalprice) FILTER (o_orderpriority = '3-MEDIUM') / 1e5 AS baa, avg(o_totalprice) FILTER (o_orderpriority = '4-NOT SPECIFIED') / 1e5 AS p FROM orders GROUP BY 1),
            x AS (SELECT day, ten - two AS curve, baa * 2.2::DOUBLE - ten AS spread, CASE WHEN month(day) % 3 <> 0 THEN 33 * p END AS pmi FROM m),
            r AS (SELECT *, CASE WHEN spread >= 3 OR (curve <= -0.5::DOUBLE AND pmi < 48) THEN 'crisis' WHEN pmi < 48 OR curve < 0 THEN 'contraction' WHEN pmi < 52 OR spread >= 2 THEN 'slowdown' WHEN pmi >= 55 THEN 'expansion'
              WHEN pmi IS NOT NULL THEN 'recovery' WHEN curve > 0 THEN 'expansion' WHEN curve IS NOT NULL THEN 'contraction' END AS regime FROM x)
            SELECT day, round(curve, 6) AS curve, round(spread, 6) AS spread, round(pmi, 6) AS pmi, regime, CASE regime WHEN 'expansion' THEN 0.9 WHEN 'recovery' THEN 0.8 WHEN 'slowdown' THEN 0.6 WHEN 'contraction' THEN 0.35 WHEN 'crisis' THEN 0.15 ELSE 0.6 END::DOUBLE AS exposure_cap,
              CASE WHEN regime IN ('contraction', 'crisis') THEN false ELSE true END AS tech_allowed FROM r""",
    }
