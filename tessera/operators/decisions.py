"""Coalesced decisions: signals, model votes and the regime of one symbol that come close together are decided once."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.monitor import regime_component
from tessera.operators.strategy import required_edge_bps

#: Seconds that a decision waits for further components, seconds that one lives, the vote that acts, and the edge of full confidence.
JOIN_S, TTL_S, THRESHOLD, EDGE_BPS = 5, 86_400, 0.2, 200.0
FEED = ("at", "kind", "source", "signal", "confidence", "price", "stop", "target")
LIVE = "array<struct<source: string, strategy: string, signal: string, confidence: double, price: double, stop: double, target: double>>"


class Desk:
    """What is known of one symbol: the newest signal of each strategy, the newest model vote, the regime, and when a decision is due.

    Rows come in the order of FEED. Times are whole microseconds. A row at the time that a decision is due still belongs to it.
    """

    def __init__(self, join_s: float = JOIN_S, ttl_s: float = TTL_S):
        self.join, self.ttl = int(join_s * 1_000_000), int(ttl_s * 1_000_000)
        self.entries: dict[str, tuple] = {}  # strategy: at, signal, confidence, price, stop, target
        self.vote: tuple | None = None  # at, signal, confidence
        self.macro: tuple | None = None  # signal, confidence
        self.due: int | None = None

    def prune(self, now: int) -> None:
        self.entries = {k: e for k, e in self.entries.items() if now - e[0] <= self.ttl}
        if self.vote and now - self.vote[0] > self.ttl:
            self.vote = None

    def decide(self, until: int) -> Iterator[tuple[int, str]]:
        """The decision that is due up to a time, if any: its time and its components as JSON; none without a strategy's signal."""
        if self.due is None or self.due > until:
            return
        now, self.due = self.due, None
        self.prune(now)
        if not self.entries:
            return
        row = lambda source, strategy, signal, confidence, *levels: dict(zip(("source", "strategy", "signal", "confidence", "price", "stop", "target"), (source, strategy, signal, confidence, *levels), strict=False))
        live = [row(f"strategy:{k}", k, *e[1:]) for k, e in sorted(self.entries.items())]
        live += [row("ml", None, *self.vote[1:])] if self.vote else []
        live += [row("macro", None, *self.macro)] if self.macro else []
        yield now, json.dumps(live)

    def take(self, at: int, kind: str, source: str | None, signal: str | None, confidence: float | None, *levels: float | None) -> Iterator[tuple[int, str]]:
        """Takes a row; gives the decision that was due before it."""
        yield from self.decide(at - 1)
        if kind == "strategy":
            self.entries[source or ""] = (at, signal, confidence, *levels)
        elif kind == "ml":
            self.vote = (at, signal, confidence)
        else:
            self.macro = (signal, confidence) if signal else None
        if self.due is None and (kind != "macro" or any(at - e[0] <= self.ttl for e in self.entries.values())):
            self.due = at + self.join


def fanned(components: DataFrame, regimes: DataFrame, symbols: DataFrame) -> DataFrame:
    """``symbol`` and FEED: components ``symbol, ts, kind, source, signal, confidence, price, stop, target``, and each regime ``ts, regime`` for every one of ``symbols``.

    A neutral or unknown regime has no signal. ``symbols`` is the universe, a table of names that is broadcast.
    """
    bias = F.struct(F.col("regime").alias("source"), regime_component(F.col("regime")).alias("c"))
    none = F.lit(None).cast("double")
    macro = regimes.select("ts", bias.alias("b")).join(F.broadcast(symbols.select("symbol").distinct()))
    macro = macro.select("symbol", "ts", F.lit("macro").alias("kind"), "b.source", "b.c.signal", "b.c.confidence", none.alias("price"), none.alias("stop"), none.alias("target"))
    rows = components.select("symbol", "ts", "kind", "source", "signal", "confidence", "price", "stop", "target").unionByName(macro)
    return rows.where("symbol is not null and ts is not null and kind in ('strategy', 'ml', 'macro')").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


def plain(value: object) -> object:
    """A missing number is null."""
    return None if isinstance(value, float) and value != value else value


def coalesced(feed: DataFrame, join_s: float = JOIN_S, ttl_s: float = TTL_S) -> DataFrame:
    """``symbol, decided_at, live`` of :func:`fanned` rows: the live components of every decision.

    Symbols are dealt out and their rows read in order, a batch at a time; a task holds one symbol's newest components.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        desk, symbol = Desk(join_s, ttl_s), None
        for rows in batches:
            out = []
            for name, *row in rows[["symbol", *FEED]].itertuples(index=False, name=None):
                if name != symbol:
                    out += [(symbol, *d) for d in desk.decide(1 << 62)]
                    desk, symbol = Desk(join_s, ttl_s), name
                out += [(symbol, *d) for d in desk.take(*map(plain, row))]
            yield pd.DataFrame(out, columns=["symbol", "at", "live"])
        yield pd.DataFrame([(symbol, *d) for d in desk.decide(1 << 62)], columns=["symbol", "at", "live"])

    rows = feed.select("symbol", *FEED).repartition("symbol").sortWithinPartitions("symbol", *FEED)
    return told(rows.mapInPandas(run, "symbol string, at long, live string"))


def told(rows: DataFrame) -> DataFrame:
    return rows.select("symbol", F.timestamp_micros("at").alias("decided_at"), F.from_json("live", LIVE).alias("live"))


def decided(live: DataFrame, weights: DataFrame, sectors: DataFrame | None = None, tier: Column | None = None, edge_bps: float = EDGE_BPS) -> DataFrame:
    """One decision of each ``symbol, decided_at, live``: ``signal, confidence, score, cost_filtered, sources, price, stop, target, strategy, levels_missing, sector``.

    ``source, weight`` are restricted to the sources present and brought to a sum of 1; a source without one weighs as if all known ones
    were equal. A decision that doesn't pay its costs holds. Levels are those of the most confident strategy that agrees, ties to its name.
    """
    table = weights.agg(F.map_from_entries(F.collect_list(F.struct("source", "weight"))).alias("w"), F.count("*").alias("n"))  # one row, an entry for each source
    rows = live.join(F.broadcast(table))
    own = lambda c: F.coalesce(F.element_at("w", c["source"]), F.lit(1.0) / F.greatest(F.col("n"), F.lit(1)))
    sign = lambda c: F.when(c["signal"] == "BUY", c["confidence"]).when(c["signal"] == "SELL", -c["confidence"]).otherwise(0.0)
    add = lambda f: F.aggregate("live", F.lit(0.0), lambda a, c: a + f(c))
    total = add(own)
    score = F.round(add(lambda c: own(c) * sign(c)) / F.when(total != 0, total).otherwise(1.0), 9)  # sums in any order meet the threshold alike
    rows = rows.withColumn("score", score).withColumn("confidence", F.least(F.abs("score"), F.lit(1.0)))
    voted = F.when(F.col("score") >= THRESHOLD, "BUY").when(F.col("score") <= -THRESHOLD, "SELL").otherwise("HOLD")
    dear = (voted != "HOLD") & (F.col("confidence") * edge_bps < required_edge_bps(tier if tier is not None else F.lit("large")))
    rows = rows.withColumn("cost_filtered", dear).withColumn("signal", F.when(F.col("cost_filtered"), "HOLD").otherwise(voted))
    agree = F.filter("live", lambda c: c["strategy"].isNotNull() & (c["signal"] == F.col("signal")) & (F.col("signal") != "HOLD"))
    best = F.array_min(F.transform(agree, lambda c: F.struct((-c["confidence"]).alias("k"), c["strategy"].alias("strategy"), c["price"].alias("price"), c["stop"].alias("stop"), c["target"].alias("target"))))
    rows = rows.withColumn("best", best).select(
        "symbol", "decided_at", "signal", "confidence", "score", "cost_filtered", F.array_join(F.transform("live", lambda c: c["source"]), ",").alias("sources"),
        "best.price", "best.stop", "best.target", "best.strategy", ((F.col("signal") != "HOLD") & F.col("best").isNull()).alias("levels_missing"),
    )
    if sectors is None:
        return rows.withColumn("sector", F.lit(None).cast("string"))
    return rows.join(F.broadcast(sectors.select("symbol", "sector")), "symbol", "left")  # the universe's names
