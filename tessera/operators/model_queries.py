"""Registered queries of importance, nulls, folds, paths, outcomes and syncs, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import decisions as desk
from tessera.operators import importance as imp
from tessera.operators import fitting, market, outcomes, panel, paths, strategy, study, sync
from tessera.operators import technical as tech
from tessera.operators.panel_queries import HORIZON, _read
from tessera.operators.queries import BARS, FEATURES, _bars
from tessera.operators.study_queries import LABELS

NAMES = ["return_5d", "return_20d", "realized_vol_20", "volume_ratio", "noise"]
WEIGHTS = [0.4, -0.3, 0.2, 0.1, 0.05]
BLOCKS = {n: [n] for n in NAMES} | {"momentum": ["return_5d", "return_20d"]}
REPEATS, REPLICATES, HORIZONS, RUNS, CELLS = 3, 3, [1, 5], (2, 3), 16


def _ranked(spark, sf_dir) -> DataFrame:
    """``symbol, ts, next_return, y``, ranks of four features in their session, absent ones neutral, and a column of noise."""
    nxt = F.lead("c").over(Window.partitionBy("symbol").orderBy("ts")) / F.col("c") - 1
    rows = market.features(_bars(spark, sf_dir)).withColumn("next_return", nxt)
    ranks = [F.coalesce(market.percentile_rank(n), F.lit(0.5)).alias(n) for n in NAMES[:-1]]
    rows = rows.select("symbol", "ts", "next_return", *ranks).where("next_return is not null")
    return imp.noise(rows.withColumn("y", (F.col("next_return") > 0).cast("int")), "noise")


def _score():
    return sum((w * F.col(n) for w, n in zip(WEIGHTS[1:], NAMES[1:], strict=True)), WEIGHTS[0] * F.col(NAMES[0]))


def permutation_importance(spark, sf_dir):
    return imp.importance(_ranked(spark, sf_dir), NAMES, _score(), BLOCKS, REPEATS)


def permutation_null(spark, sf_dir):
    b = _bars(spark, sf_dir)
    return imp.permutation_null(market.features(b), b, NAMES[:-1], HORIZONS, REPLICATES)


def capacity_probe(spark, sf_dir):
    """Scorecards of sixteen parts a feature, for real labels and for labels shuffled within sessions."""
    runs = imp.label_shuffles(_ranked(spark, sf_dir).select("symbol", "ts", "y", *NAMES), *RUNS)
    return imp.capacity(imp.scorecards(runs, NAMES, CELLS))


JOIN_HOURS, TTL_HOURS = 6, 48


def decision_feed(spark, sf_dir) -> DataFrame:
    """Events as components: purchases are model votes, errors now and then the regime, others three strategies' signals with their levels."""
    k, kind = F.col("event_id"), F.col("event_type")
    signal = F.when(k % 3 == 0, "BUY").when(k % 3 == 1, "SELL").otherwise("HOLD")
    rows = _read(spark, sf_dir, "events").select((F.col("user_id") % 100).cast("string").alias("symbol"), "event_id", "event_type", "ts", "value", signal.alias("signal"))
    level = lambda x: F.when(kind != "purchase", F.col("value") * x)
    parts = rows.where("event_type <> 'error' and symbol is not null").select("symbol", "ts", F.when(kind == "purchase", "ml").otherwise("strategy").alias("kind"), kind.alias("source"), "signal", (k % 100 / 100).alias("confidence"), level(1.0).alias("price"), level(0.9).alias("stop"), level(1.2).alias("target"))
    regimes = rows.where("event_type = 'error' and event_id % 25 = 0").select("ts", F.element_at(F.array(*[F.lit(r) for r in REGIMES]), (k / 25 % 6 + 1).cast("int")).alias("regime"))
    return desk.fanned(parts, regimes, parts)


REGIMES = ("expansion", "recovery", "slowdown", "contraction", "crisis", "unheard-of")
SOURCES = {"strategy:click": 0.3, "strategy:view": 0.2, "ml": 0.4}


def coalesced_decisions(spark, sf_dir):
    """One decision of a symbol six hours after its first component, from those of two days; sectors by name."""
    weights = spark.createDataFrame(list(SOURCES.items()), "source string, weight double")
    feed = decision_feed(spark, sf_dir)
    sectors = feed.select("symbol").distinct().where("symbol % 7 <> 0").select("symbol", F.concat(F.lit("sector "), F.col("symbol").cast("int") % 5).alias("sector"))
    return desk.decided(desk.coalesced(feed, JOIN_HOURS * 3600, TTL_HOURS * 3600), weights, sectors)


NOW = "1998-06-01 00:00:00"


def _outcomes(spark, sf_dir) -> DataFrame:
    """Votes of the strongest and weakest names by five-day return, told some days after their bar, as they stand at NOW."""
    now = F.lit(NOW).cast("timestamp")
    b = _bars(spark, sf_dir).where(F.col("ts") <= now)
    k = F.regexp_extract("symbol", "[0-9]+", 0).cast("int")
    p = market.features(b).withColumn("p", market.percentile_rank("return_5d")).where("p >= 0.7 or p <= 0.3")
    votes = p.select(F.lit("m@v1").alias("model_id"), "symbol", (F.col("ts") + F.make_dt_interval(k % 3, F.lit(15), F.lit(0), F.lit(0))).alias("at"), F.when(F.col("p") >= 0.7, "BUY").otherwise("SELL").alias("signal"))
    adjusted = tech.adjusted(b)
    bars = adjusted.select("symbol", "ts", "c", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")).alias("n"))
    labels = study.excess_barrier(study.on_benchmark(adjusted, panel.benchmark(b)), HORIZON)
    return outcomes.outcomes(votes, bars, labels, now, HORIZON)


def vote_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir)


def vote_metrics(spark, sf_dir):
    return outcomes.measured(_outcomes(spark, sf_dir), F.lit(NOW).cast("timestamp"), 365, HORIZON)


def sync_summary(spark, sf_dir):
    """A store that ends in March 1998, two vendors that have landed the rest: restated names, new ones, a broken and a failed one."""
    b = _bars(spark, sf_dir)
    k = F.regexp_extract("symbol", "[0-9]+", 0).cast("int")
    stored = b.where((F.col("ts") < "1998-03-01") & (k != 55))
    factor = F.when(k % 10 == 1, 0.5).otherwise(1.0)
    first = b.where(k % 2 == 1).withColumn("adj_close", F.col("adj_close") * factor).withColumn("close", F.when(k == 13, -1.0).otherwise(F.col("close"))).withColumn("priority", F.lit(1)).withColumn("seq", F.lit(1))
    second = b.where(k >= 20).withColumn("priority", F.lit(2)).withColumn("seq", F.lit(1))
    names = b.select("symbol").distinct()
    failures = names.where(k == 24).select("symbol", F.lit("timeout").alias("error"))
    every = names.unionByName(_read(spark, sf_dir, "supplier").select(F.col("s_name").alias("symbol")))
    return sync.sync(every, stored, first.unionByName(second), failures, F.lit("1998-08-01").cast("timestamp"), 365 * 2, 10)[1]


GROUPS, TESTS = 6, 2


def cpcv_paths(spark, sf_dir):
    """A rule fitted to the training sessions of each split (each feature weighs its mean rank correlation), tested along every path: what each path earns a session."""
    rows = _ranked(spark, sf_dir).select("symbol", "ts", "next_return", "return_5d", "realized_vol_20")
    tested = paths.splits(spark, GROUPS, TESTS)
    roles = study.combinatorial(rows, GROUPS, TESTS, 5, 1)
    long = rows.select("symbol", "ts", "next_return", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("x")) for n in ("return_5d", "realized_vol_20")])).alias("f")).select("symbol", "ts", "next_return", "f.*")
    keys = ["feature", "ts"]
    ranks = long.select(*keys, panel.average_rank("x", keys).alias("a"), panel.average_rank("next_return", keys).alias("b"))
    ics = ranks.groupBy(*keys).agg(panel.correlation("a", "b").alias("ic")).where("ic is not null and not isnan(ic)")
    train = roles.where("role = 'train'").select("split", "ts")
    fitted = ics.join(F.broadcast(train), "ts").groupBy("split", "feature").agg(F.avg("ic").alias("w"))
    wide = fitted.groupBy("split").agg(F.coalesce(F.max(F.when(F.col("feature") == "return_5d", F.col("w"))), F.lit(0.0)).alias("w1"), F.coalesce(F.max(F.when(F.col("feature") == "realized_vol_20", F.col("w"))), F.lit(0.0)).alias("w2"))
    of_path = paths.paths(tested).join(F.broadcast(wide), "split").join(F.broadcast(paths.blocks(rows, GROUPS).select("ts", "group")), "group")  # paths times sessions
    scored = rows.join(of_path, "ts").withColumn("p", F.col("w1") * F.col("return_5d") + F.col("w2") * F.col("realized_vol_20"))
    w = Window.partitionBy("path", "ts")
    best = scored.withColumn("k", F.row_number().over(w.orderBy(F.desc(F.round("p", 9)), "symbol"))).withColumn("m", F.count("*").over(w)).where(F.col("k") <= F.greatest(F.lit(1), F.ceil(F.col("m") * 0.2)))
    daily = best.groupBy("path", "ts").agg(F.avg("next_return").alias("r"))
    return daily.groupBy("path").agg(F.count("*").alias("sessions"), F.avg("r").alias("mean_return"), F.coalesce(F.try_divide(F.avg("r"), F.stddev_samp("r")) * F.sqrt(F.lit(252.0)), F.lit(0.0)).alias("sharpe"))


def path_dispersion(spark, sf_dir):
    return paths.dispersion(cpcv_paths(spark, sf_dir), "sharpe")


TRAIN, TEST, VAL, GAP = 252, 63, 63, 6


def fold_table(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Ranked rows with a weight, and the fit, validation and test sessions of purged walk-forward folds."""
    rows = _ranked(spark, sf_dir).withColumn("weight", 1.0 / (F.regexp_extract("symbol", "[0-9]+", 0).cast("int") % 3 + 1))
    return rows, fitting.windows(study.walk_forward(rows, TRAIN, TEST, GAP - 1, 1), VAL, GAP)


def fold_windows(spark, sf_dir):
    return fitting.described(*fold_table(spark, sf_dir))


def queries():
    made = [fold_windows, vote_outcomes, vote_metrics, sync_summary, cpcv_paths, path_dispersion, coalesced_decisions, permutation_importance, permutation_null, capacity_probe]
    return {q.__name__: q for q in made}


def _average_rank(x: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE"


def _percentile(name: str) -> str:
    return f"""coalesce(CASE WHEN {name} IS NULL THEN NULL WHEN count({name}) OVER (PARTITION BY ts) = 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY ts, {name} IS NULL ORDER BY {name}) - 1
      + (count(*) OVER (PARTITION BY ts, {name}) - 1) / 2.0) / (count({name}) OVER (PARTITION BY ts) - 1) END, 0.5)::DOUBLE AS {name}"""


RANKED = FEATURES + f""", nx AS (SELECT *, lead(c) OVER (PARTITION BY symbol ORDER BY ts) / c - 1 AS next_return FROM f),
  pr AS (SELECT symbol, ts, next_return, {', '.join(_percentile(n) for n in NAMES[:-1])} FROM nx),
  rk AS (SELECT *, (next_return > 0)::INTEGER AS y, epoch(ts)::BIGINT AS e, (row_number() OVER (PARTITION BY ts ORDER BY md5('0|noise|' || epoch(ts)::BIGINT || '|' || symbol), symbol) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY ts) AS noise
    FROM pr WHERE next_return IS NOT NULL)"""


def _auc_sql(source: str, by: str, score: str, label: str) -> str:
    return f"""(SELECT {by}, (sum(r) FILTER ({label} = 1) - sum({label}) * (sum({label}) + 1) / 2.0::DOUBLE) / (sum({label}) * (count(*) - sum({label}))) AS auc
      FROM (SELECT *, {_average_rank(score, by)} AS r FROM {source}) GROUP BY {by})"""


def _importance_sql() -> str:
    names = ", ".join(NAMES)
    grid = ", ".join(f"('{b}', {r})" for b in BLOCKS for r in range(1, REPEATS + 1))
    swapped = ", ".join(f"CASE WHEN block IN ({', '.join(repr(b) for b, m in BLOCKS.items() if n in m)}) THEN g.{n} ELSE x.{n} END AS {n}" for n in NAMES)
    score = " + ".join(f"{w}::DOUBLE * {n}" for w, n in zip(WEIGHTS, NAMES, strict=True))
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, coalesce(abs(corr({a}, {b})), 0) AS c FROM gr" for a in NAMES for b in NAMES if a != b)
    inside = ", ".join(f"('{b}', '{m}')" for b, members in BLOCKS.items() for m in members)
    return RANKED + f""", s3 AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY symbol) AS i FROM rk QUALIFY count(*) OVER (PARTITION BY ts) >= 3),
      ex AS (SELECT * FROM s3, (VALUES {grid}) t(block, rep)),
      gv AS (SELECT ts, block, rep, {names}, row_number() OVER (PARTITION BY ts, block, rep ORDER BY md5('7|' || block || '|' || rep || '|' || e || '|' || symbol), symbol) AS i FROM ex),
      sw AS (SELECT x.block, x.rep, x.ts, next_return, y, {swapped} FROM ex x JOIN gv g USING (ts, block, rep, i)),
      al AS (SELECT block, rep, ts, next_return, y, {score} AS p FROM sw UNION ALL SELECT '', 0, ts, next_return, y, {score} FROM s3),
      ra AS (SELECT block, rep, ts, {_average_rank('p', 'block, rep, ts')} AS a, {_average_rank('next_return', 'block, rep, ts')} AS b FROM al),
      ic AS (SELECT block, ts, avg(ic) AS ic FROM (SELECT block, rep, ts, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) ELSE 0 END AS ic FROM ra GROUP BY 1, 2, 3) GROUP BY 1, 2),
      dr AS (SELECT x.block, b.ic - x.ic AS d FROM ic x JOIN ic b ON b.block = '' AND b.ts = x.ts AND x.block <> ''),
      su AS (SELECT block, count(*) AS sessions, avg(d) AS m, coalesce(stddev_samp(d) / sqrt(count(*)), 0) AS s FROM dr GROUP BY 1),
      au AS (SELECT block, avg(auc) AS auc FROM {_auc_sql('al', 'block, rep', 'p', 'y')} GROUP BY 1),
      gr AS (SELECT {', '.join(f'rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2.0::DOUBLE AS {n}' for n in NAMES)} FROM s3),
      co AS ({pairs}), ib AS (SELECT * FROM (VALUES {inside}) t(block, a)),
      nb AS (SELECT block, max(c) AS c, arg_max(b, (round(c, 12), b)) AS b FROM co JOIN ib USING (a) WHERE c > 0 AND (block, b) NOT IN (FROM ib) GROUP BY 1)
      SELECT su.block, sessions, CASE WHEN abs(m) < 1e-9 THEN 0 ELSE m END AS ic_drop, CASE WHEN abs(m) < 1e-9 THEN 0 ELSE s END AS se, CASE WHEN abs(m) < 1e-9 OR s = 0 THEN 0 ELSE m / s END AS t,
        (SELECT auc FROM au WHERE block = '') - au.auc AS auc_drop, coalesce(nb.c, 0) AS max_abs_correlation, nb.b AS neighbour, {imp.sidak_bar(len(NAMES))!r}::DOUBLE AS bar,
        CASE WHEN abs(m) < 1e-9 OR s = 0 THEN 0 ELSE m / s END > {imp.sidak_bar(len(NAMES))!r}::DOUBLE AS above FROM su JOIN au USING (block) LEFT JOIN nb ON nb.block = su.block"""


def _null_sql() -> str:
    most = max(HORIZONS)

    def table(tag: str, source: str, by: str) -> str:
        each = " UNION ALL ".join(f"SELECT {by}ts, '{n}' AS feature, {h} AS horizon, {n} AS x, fw{h} AS y FROM {source} WHERE {n} IS NOT NULL AND fw{h} IS NOT NULL" for n in NAMES[:-1] for h in HORIZONS)
        keys = f"{by}feature, horizon"
        sums = "".join(f" + coalesce(sum(2 * greatest(0, 1 - {k}.0::DOUBLE / horizon) * e{k}), 0)" for k in range(1, most))
        lags = "".join(f", e * lag(e, {k}) OVER (PARTITION BY {keys} ORDER BY ts) AS e{k}" for k in range(1, most))
        return f"""{tag}1 AS ({each}), {tag}2 AS (SELECT {keys}, ts, {_average_rank('x', f'{keys}, ts')} AS a, {_average_rank('y', f'{keys}, ts')} AS b FROM {tag}1),
          {tag}3 AS (SELECT {keys}, ts, corr(a, b) AS ic FROM {tag}2 GROUP BY ALL HAVING count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0),
          {tag}4 AS (SELECT *, ic - avg(ic) OVER (PARTITION BY {keys}) AS e FROM {tag}3), {tag}5 AS (SELECT *{lags} FROM {tag}4),
          {tag}6 AS (SELECT {keys}, count(*) AS n, avg(ic) AS ic_mean, sum(e * e){sums} AS s FROM {tag}5 GROUP BY ALL),
          {tag} AS (SELECT {keys}, n, ic_mean, CASE WHEN n >= 2 AND s > 0 THEN ic_mean / (sqrt(s) / n) ELSE 0 END AS ic_t FROM {tag}6)"""

    ahead = ", ".join(f"lead(c, {h}) OVER (PARTITION BY symbol ORDER BY ts) / c - 1 AS fw{h}" for h in HORIZONS)
    return FEATURES + f""", fw AS (SELECT symbol, ts, {', '.join(NAMES[:-1])}, {ahead} FROM f),
      sy AS (SELECT symbol, r, row_number() OVER (PARTITION BY r ORDER BY md5('17|' || r || '|' || symbol), symbol) AS i, count(*) OVER (PARTITION BY r) AS m FROM (SELECT DISTINCT symbol FROM f), range(1, {REPLICATES + 1}) t(r)),
      mp AS (SELECT a.r, a.symbol, b.symbol AS mapped FROM sy a JOIN sy b ON a.r = b.r AND b.i = a.i % a.m + 1),
      mv AS (SELECT mp.r, o.ts, {', '.join(f'g.{n}' for n in NAMES[:-1])}, {', '.join(f'o.fw{h}' for h in HORIZONS)} FROM mp JOIN fw g ON g.symbol = mp.mapped JOIN fw o ON o.symbol = mp.symbol AND o.ts = g.ts),
      {table('tr', 'fw', '')}, {table('tn', 'mv', 'r, ')}, wo AS (SELECT max(abs(ic_t)) AS null_t FROM tn)
      SELECT feature, horizon, n, ic_mean, ic_t, null_t, abs(ic_t) > null_t AS clears FROM tr, wo"""


def _capacity_sql() -> str:
    grid = ", ".join([f"('real', {r})" for r in range(1, RUNS[0] + 1)] + [f"('control', {r})" for r in range(1, RUNS[1] + 1)])
    long = " UNION ALL ".join(f"SELECT kind, run, ts, symbol, e, y, '{n}' AS feature, least({CELLS - 1}, floor({n} * {CELLS}))::INTEGER AS bin FROM lb" for n in NAMES)
    share = "('0x' || substr(md5('5|' || kind || '|' || run || '|' || e || '|' || symbol), 1, 7))::BIGINT / 268435456.0::DOUBLE"
    return RANKED + f""", ex AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY symbol) AS i FROM rk), gx AS (SELECT * FROM ex, (VALUES {grid}) t(kind, run)),
      gy AS (SELECT ts, kind, run, y, CASE kind WHEN 'real' THEN i ELSE row_number() OVER (PARTITION BY ts, kind, run ORDER BY md5('5|' || run || '|' || e || '|' || symbol), symbol) END AS i FROM gx),
      lb AS (SELECT gx.* REPLACE (gy.y AS y) FROM gx JOIN gy USING (ts, kind, run, i)), lo AS ({long}),
      ft AS (SELECT kind, run, feature, bin, avg(y) AS rate FROM lo WHERE {share} >= 0.1::DOUBLE GROUP BY ALL),
      sc AS (SELECT kind, run, ts, symbol, sum(round(rate * 1e9)::BIGINT) AS p, max(y) AS y FROM lo LEFT JOIN ft USING (kind, run, feature, bin) GROUP BY ALL),
      ar AS {_auc_sql('sc', 'kind, run', 'p', 'y')},
      cp AS (SELECT avg(auc) FILTER (kind = 'real') AS auc_real, avg(auc) FILTER (kind = 'control') AS auc_control, min(auc) FILTER (kind = 'real') - max(auc) FILTER (kind = 'control') AS margin FROM ar)
      SELECT auc_real, auc_control, margin, auc_real - auc_control AS gap, margin > 0 AS separated,
        CASE WHEN auc_real - auc_control >= 0.05 AND margin > 0 THEN 'structure' WHEN auc_real - auc_control >= 0.05 THEN 'inconclusive' ELSE 'none' END AS verdict FROM cp"""


def _decisions_sql() -> str:
    bias = {"expansion": ("BUY", 0.5), "recovery": ("BUY", 0.3), "contraction": ("SELL", 0.3), "crisis": ("SELL", 0.6)}
    said = "CASE regime " + " ".join(f"WHEN '{r}' THEN '{s}'" for r, (s, _) in bias.items()) + " END"
    sure = "CASE regime " + " ".join(f"WHEN '{r}' THEN {c}::DOUBLE" for r, (_, c) in bias.items()) + " END"
    regime = "CASE (event_id // 25) % 6 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(REGIMES)) + " END"
    weight = "CASE source " + " ".join(f"WHEN '{s}' THEN {w}::DOUBLE" for s, w in SOURCES.items()) + f" ELSE 1.0::DOUBLE / {len(SOURCES)} END"
    return f"""WITH RECURSIVE ev AS (SELECT *, (user_id % 100)::VARCHAR AS symbol FROM events WHERE ts IS NOT NULL),
      pa AS (SELECT symbol, ts, CASE event_type WHEN 'purchase' THEN 'ml' ELSE 'strategy' END AS kind, event_type AS name, CASE event_id % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' ELSE 'HOLD' END AS signal, (event_id % 100) / 100.0::DOUBLE AS confidence,
        CASE WHEN event_type <> 'purchase' THEN value END AS price, CASE WHEN event_type <> 'purchase' THEN value * 0.9::DOUBLE END AS stop, CASE WHEN event_type <> 'purchase' THEN value * 1.2::DOUBLE END AS target
        FROM ev WHERE event_type <> 'error' AND symbol IS NOT NULL),
      rg AS (SELECT ts, {said} AS signal, {sure} AS confidence FROM (SELECT ts, {regime} AS regime FROM ev WHERE event_type = 'error' AND event_id % 25 = 0)),
      sy AS (SELECT DISTINCT symbol FROM pa),
      tr AS (SELECT DISTINCT symbol, ts FROM pa UNION SELECT DISTINCT sy.symbol, rg.ts FROM sy, rg WHERE EXISTS (SELECT 1 FROM pa WHERE pa.symbol = sy.symbol AND kind = 'strategy' AND pa.ts <= rg.ts AND pa.ts >= rg.ts - INTERVAL {TTL_HOURS} HOURS)),
      du AS (SELECT symbol, min(ts) + INTERVAL {JOIN_HOURS} HOURS AS due FROM tr GROUP BY 1
        UNION ALL SELECT du.symbol, min(tr.ts) + INTERVAL {JOIN_HOURS} HOURS FROM du JOIN tr ON tr.symbol = du.symbol AND tr.ts > du.due GROUP BY du.symbol, du.due),
      st AS (SELECT du.symbol, due, pa.name, arg_max((signal, confidence, price, stop, target), (pa.ts, signal, confidence, price, stop, target)) AS v FROM du JOIN pa ON pa.symbol = du.symbol AND kind = 'strategy' AND pa.ts <= due AND pa.ts >= due - INTERVAL {TTL_HOURS} HOURS GROUP BY 1, 2, 3),
      ml AS (SELECT du.symbol, due, arg_max((signal, confidence), (pa.ts, signal, confidence)) AS v FROM du JOIN pa ON pa.symbol = du.symbol AND kind = 'ml' AND pa.ts <= due AND pa.ts >= due - INTERVAL {TTL_HOURS} HOURS GROUP BY 1, 2),
      ma AS (SELECT symbol, due, signal, confidence FROM du ASOF JOIN rg ON rg.ts <= due WHERE signal IS NOT NULL),
      lv AS (SELECT symbol, due, 'strategy:' || name AS source, name AS strategy, 0 AS o, v[1] AS signal, v[2] AS confidence, v[3] AS price, v[4] AS stop, v[5] AS target FROM st
        UNION ALL SELECT symbol, due, 'ml', NULL, 1, v[1], v[2], NULL, NULL, NULL FROM ml SEMI JOIN st USING (symbol, due)
        UNION ALL SELECT symbol, due, 'macro', NULL, 2, signal, confidence, NULL, NULL, NULL FROM ma SEMI JOIN st USING (symbol, due)),
      wt AS (SELECT *, {weight} AS w, CASE signal WHEN 'BUY' THEN confidence WHEN 'SELL' THEN -confidence ELSE 0 END AS s FROM lv),
      sc AS (SELECT symbol, due, round(sum(w * s) / sum(w), 9) AS score, string_agg(source, ',' ORDER BY o, strategy) AS sources FROM wt GROUP BY 1, 2),
      vo AS (SELECT *, CASE WHEN score >= 0.2::DOUBLE THEN 'BUY' WHEN score <= -0.2::DOUBLE THEN 'SELL' ELSE 'HOLD' END AS v, least(abs(score), 1) AS c FROM sc),
      ct AS (SELECT *, v <> 'HOLD' AND c * {desk.EDGE_BPS} < {2 * strategy.LEG_BPS * strategy.EDGE_MULTIPLE} AS cf FROM vo),
      fs AS (SELECT *, CASE WHEN cf THEN 'HOLD' ELSE v END AS final FROM ct),
      be AS (SELECT fs.symbol, fs.due, arg_min((strategy, price, stop, target), (-confidence, strategy)) AS b FROM fs JOIN lv ON lv.symbol = fs.symbol AND lv.due = fs.due AND lv.strategy IS NOT NULL AND lv.signal = final AND final <> 'HOLD' GROUP BY 1, 2)
      SELECT fs.symbol, fs.due AS decided_at, final AS signal, c AS confidence, score, cf AS cost_filtered, sources, b[2] AS price, b[3] AS stop, b[4] AS target, b[1] AS strategy, final <> 'HOLD' AND b IS NULL AS levels_missing,
        CASE WHEN fs.symbol::INTEGER % 7 <> 0 THEN 'sector ' || fs.symbol::INTEGER % 5 END AS sector FROM fs LEFT JOIN be ON be.symbol = fs.symbol AND be.due = fs.due"""


def _outcomes_sql() -> str:
    known = LABELS.replace("ON l_partkey = p_partkey)", f"ON l_partkey = p_partkey WHERE l_shipdate::DATE <= TIMESTAMP '{NOW}')", 1)
    k = "regexp_extract(symbol, '[0-9]+')::INTEGER"
    return known + f""", vr AS (SELECT symbol, ts, c, n, c / lag(c, 5) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r5 FROM n),
      vp AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY ts) = 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY ts ORDER BY r5) - 1 + (count(*) OVER (PARTITION BY ts, r5) - 1) / 2.0) / (count(*) OVER (PARTITION BY ts) - 1) END::DOUBLE AS p FROM vr WHERE r5 IS NOT NULL),
      vo AS (SELECT symbol, ts + to_days({k} % 3) + INTERVAL 15 HOUR AS told, CASE WHEN p >= 0.7::DOUBLE THEN 'BUY' ELSE 'SELL' END AS signal FROM vp WHERE p >= 0.7::DOUBLE OR p <= 0.3::DOUBLE),
      ve AS (SELECT vo.symbol, told, signal, vr.n AS entry, vr.c AS paid FROM vo ASOF LEFT JOIN vr ON vr.symbol = vo.symbol AND vr.ts <= date_trunc('day', vo.told) WHERE told <= TIMESTAMP '{NOW}'),
      vl AS (SELECT ve.*, lb.label, lb.touch, vr.c AS got FROM ve LEFT JOIN lb ON lb.symbol = ve.symbol AND lb.n = entry AND entry > 20 AND lb.label IS NOT NULL LEFT JOIN vr ON vr.symbol = ve.symbol AND vr.n = lb.touch),
      vs AS (SELECT 'm@v1' AS model_id, symbol, told AS "at", signal, CASE WHEN label IS NOT NULL THEN 'resolved' WHEN told < TIMESTAMP '{NOW}' - to_days({outcomes.drop_days(HORIZON)}) THEN 'dropped' ELSE 'pending' END AS status, label,
        CASE WHEN label IS NOT NULL THEN CASE signal WHEN 'BUY' THEN got / paid - 1 ELSE 1 - got / paid END END AS signed_return, CASE WHEN label IS NOT NULL THEN (label = 1) = (signal = 'BUY') END AS correct FROM vl)"""


def _sync_sql() -> str:
    k = "regexp_extract(symbol, '[0-9]+')::INTEGER"
    return BARS + f""", sd AS (SELECT * FROM b WHERE ts < TIMESTAMP '1998-03-01' AND {k} <> 55),
      la AS (SELECT symbol, ts, CASE WHEN {k} = 13 THEN -1 ELSE close END AS close, adj_close * CASE WHEN {k} % 10 = 1 THEN 0.5::DOUBLE ELSE 1 END AS adj_close, 1 AS priority, {k} <> 13 AS ok FROM b WHERE {k} % 2 = 1
        UNION ALL SELECT symbol, ts, close, adj_close, 2, true FROM b WHERE {k} >= 20),
      pl AS (SELECT symbol, mx AS previous_latest, CASE WHEN mx IS NULL THEN 'full' ELSE 'incremental' END AS mode, CASE WHEN mx IS NULL THEN DATE '1998-08-01' - 730 ELSE least(mx::DATE - 10, DATE '1998-08-01') END AS start, least(DATE '1998-08-01' - 730, mn::DATE) AS repair
        FROM (SELECT DISTINCT symbol FROM b UNION SELECT s_name FROM supplier) LEFT JOIN (SELECT symbol, max(ts) AS mx, min(ts) AS mn FROM sd GROUP BY 1) USING (symbol)),
      sn AS (SELECT la.*, pl.* EXCLUDE (symbol) FROM la JOIN pl USING (symbol) WHERE {k} <> 24 AND ts <= TIMESTAMP '1998-08-01' QUALIFY priority = min(priority) OVER (PARTITION BY symbol)),
      mo AS (SELECT DISTINCT sn.symbol FROM sn JOIN sd ON sd.symbol = sn.symbol AND sd.ts = sn.ts WHERE ok AND mode = 'incremental' AND sn.ts::DATE >= start AND abs(sn.adj_close / sn.close - sd.adj_close / sd.close) / (sd.adj_close / sd.close) > 1e-4),
      ch AS (SELECT sn.symbol, count(DISTINCT ts) AS rows, max(ts) AS newest, any_value(CASE WHEN mo.symbol IS NULL THEN mode ELSE 'readjusted' END) AS done FROM sn LEFT JOIN mo USING (symbol) WHERE ok AND ts::DATE >= CASE WHEN mo.symbol IS NULL THEN start ELSE repair END GROUP BY 1),
      er AS (SELECT symbol, 'timeout' AS error FROM pl WHERE symbol LIKE 'Brand#%' AND {k.replace('symbol', 'symbol')} = 24 UNION ALL SELECT symbol, 'no valid bar' FROM sn GROUP BY 1 HAVING NOT bool_or(ok))
      SELECT symbol, CASE WHEN error IS NOT NULL THEN 'failed' ELSE coalesce(done, mode) END AS mode, CASE WHEN error IS NOT NULL THEN 0 ELSE coalesce(rows, 0) END AS rows, previous_latest,
        CASE WHEN error IS NOT NULL THEN previous_latest ELSE coalesce(newest, previous_latest) END AS latest, error FROM pl LEFT JOIN ch USING (symbol) LEFT JOIN er USING (symbol)"""


def _paths_sql() -> str:
    n = GROUPS
    return RANKED + f""", sq AS (SELECT id, row_number() OVER (ORDER BY id DESC) - 1 AS split FROM range(0, {1 << n}) t(id) WHERE bit_count(id) = {TESTS}),
      te AS (SELECT split, g AS grp, row_number() OVER (PARTITION BY g ORDER BY split) - 1 AS path FROM sq, range(0, {n}) u(g) WHERE (id >> ({n - 1} - g)) & 1 = 1),
      ss AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT ts FROM rk)),
      bd AS (SELECT g, floor(m * g / {n}.0)::BIGINT AS lo, floor(m * (g + 1) / {n}.0)::BIGINT AS hi FROM (SELECT any_value(m) AS m FROM ss), range(0, {n}) u(g)),
      sg AS (SELECT ts, i, g AS grp FROM ss JOIN bd ON i >= lo AND i < hi),
      tn AS (SELECT DISTINCT split, ts FROM sq, ss WHERE NOT EXISTS (SELECT 1 FROM te JOIN bd ON bd.g = te.grp WHERE te.split = sq.split AND ss.i >= lo - 6 AND ss.i < hi + 6)),
      lg AS (SELECT ts, 'a' AS f, return_5d AS x, next_return AS y FROM rk UNION ALL SELECT ts, 'b', realized_vol_20, next_return FROM rk),
      rr AS (SELECT ts, f, {_average_rank('x', 'ts, f')} AS a, {_average_rank('y', 'ts, f')} AS b FROM lg),
      ic AS (SELECT ts, f, corr(a, b) AS ic FROM rr GROUP BY 1, 2 HAVING stddev_pop(a) > 0 AND stddev_pop(b) > 0),
      fi AS (SELECT split, coalesce(avg(ic) FILTER (f = 'a'), 0) AS w1, coalesce(avg(ic) FILTER (f = 'b'), 0) AS w2 FROM ic JOIN tn USING (ts) GROUP BY 1),
      sc AS (SELECT path, rk.ts, symbol, next_return, w1 * return_5d + w2 * realized_vol_20 AS p FROM rk JOIN sg USING (ts) JOIN te USING (grp) JOIN fi USING (split)),
      be AS (SELECT path, ts, avg(next_return) AS r FROM (SELECT *, row_number() OVER (PARTITION BY path, ts ORDER BY round(p, 9) DESC, symbol) AS k, count(*) OVER (PARTITION BY path, ts) AS m FROM sc) WHERE k <= greatest(1, ceil(m * 0.2)) GROUP BY 1, 2),
      pt AS (SELECT path, count(*) AS sessions, avg(r) AS mean_return, coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0) AS sharpe FROM be GROUP BY 1)"""


def _windows_sql() -> str:
    most = 10_000
    return RANKED + f""", ss AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT ts FROM rk)),
      fo AS (SELECT k::INTEGER AS fold, ts, i - k * {TEST} AS j FROM ss, range(0, {most}) t(k) WHERE k * {TEST} + {TRAIN + TEST} <= m AND i >= k * {TEST} AND i < k * {TEST} + {TRAIN + TEST}),
      ro AS (SELECT fold, ts, CASE WHEN j >= {TRAIN} THEN 'test' WHEN j < {TRAIN - GAP} AND j >= {TRAIN - GAP - VAL} THEN 'val' WHEN j < {TRAIN - GAP - VAL - GAP} THEN 'fit' END AS role FROM fo)
      SELECT fold, role, count(DISTINCT ts) AS sessions, count(*) AS rows, avg(y) AS positive_rate, sum(1.0::DOUBLE / (regexp_extract(symbol, '[0-9]+')::INTEGER % 3 + 1)) AS effective_rows, min(ts) AS first, max(ts) AS last
      FROM rk JOIN ro USING (ts) WHERE role IS NOT NULL GROUP BY 1, 2"""


def oracle_sql():
    return {
        "fold_windows": _windows_sql(),
        "vote_outcomes": _outcomes_sql() + " SELECT * FROM vs",
        "vote_metrics": _outcomes_sql() + f""" SELECT model_id, count(*) AS n, CASE WHEN count(*) >= 10 THEN avg(correct::INTEGER) END AS accuracy, CASE WHEN count(*) >= 10 THEN coalesce(avg(signed_return) / nullif(stddev_samp(signed_return), 0) * sqrt(252.0 / {HORIZON}), 0) END AS sharpe
            FROM vs WHERE status = 'resolved' AND "at" >= TIMESTAMP '{NOW}' - to_days(365) GROUP BY 1""",
        "sync_summary": _sync_sql(),
        "cpcv_paths": _paths_sql() + " SELECT * FROM pt",
        "path_dispersion": _paths_sql() + " SELECT count(*) AS paths, avg(sharpe) AS mean, coalesce(stddev_samp(sharpe), 0) AS std, min(sharpe) AS least, max(sharpe) AS most, avg((sharpe > 0)::INTEGER) AS share_positive FROM pt",
        "coalesced_decisions": _decisions_sql(), "permutation_importance": _importance_sql(), "permutation_null": _null_sql(), "capacity_probe": _capacity_sql()}
