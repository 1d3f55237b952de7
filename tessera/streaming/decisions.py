"""Decisions as a stream: the same desk of each symbol, its components in map state, decided by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tessera.operators.decisions import FEED, JOIN_S, TTL_S, Desk, plain, told


def _fields(**kinds: object) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in kinds.items()])


LEVELS = {"price": DoubleType, "stop": DoubleType, "target": DoubleType}


def _frame(symbol: str, made: list[tuple[int, str]]) -> pd.DataFrame:
    text = lambda values: pd.Series(values, dtype=object)  # noqa: E731  the state server's serializer wants plain strings
    return pd.DataFrame({"symbol": text([symbol] * len(made)), "at": pd.Series([d[0] for d in made], dtype="int64"), "live": text([d[1] for d in made])})


class Coalescer(StatefulProcessor):
    """Rows wait in list state until the watermark has passed them, so results depend neither on batches nor on the order of arrival."""

    def __init__(self, join_s: float, ttl_s: float):
        self.join_s, self.ttl_s = join_s, ttl_s

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _fields(at=LongType, kind=StringType, source=StringType, signal=StringType, confidence=DoubleType, **LEVELS))
        self.entries = handle.getMapState("entries", _fields(strategy=StringType), _fields(at=LongType, signal=StringType, confidence=DoubleType, **LEVELS))
        self.vote = handle.getValueState("vote", _fields(at=LongType, signal=StringType, confidence=DoubleType))
        self.macro = handle.getValueState("macro", _fields(signal=StringType, confidence=DoubleType))
        self.due = handle.getValueState("due", _fields(at=LongType))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(map(plain, r)) for part in rows for r in part[list(FEED)].itertuples(index=False, name=None)]
        self.waiting.appendList(new)
        self.handle.registerTimer(-(-min(r[0] for r in new) // 1000))
        yield _frame(key[0], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        desk = Desk(self.join_s, self.ttl_s)
        desk.entries = {k[0]: tuple(v) for k, v in self.entries.iterator()}
        desk.vote, desk.macro = (tuple(s.get()) if s.exists() else None for s in (self.vote, self.macro))
        desk.due = self.due.get()[0] if self.due.exists() else None
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: tuple((v is not None, v) for v in r))
        out = [d for r in rows if r[0] <= now for d in desk.take(*r)]
        out += desk.decide(now)
        desk.prune(now)
        self._keep(desk, [r for r in rows if r[0] > now])
        yield _frame(key[0], out)

    def _keep(self, desk: Desk, later: list[tuple]) -> None:
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        kept = {k[0] for k, _ in self.entries.iterator()}
        for name in kept - set(desk.entries):
            self.entries.removeKey((name,))
        for name, entry in desk.entries.items():
            self.entries.updateValue((name,), entry)
        for state, value in ((self.vote, desk.vote), (self.macro, desk.macro), (self.due, None if desk.due is None else (desk.due,))):
            if value is None:
                state.clear()
            else:
                state.update(value)
        times = [r[0] for r in later] + ([desk.due] if desk.due is not None else []) + [e[0] + desk.ttl + 1 for e in desk.entries.values()] + ([desk.vote[0] + desk.ttl + 1] if desk.vote else [])
        if times:
            self.handle.registerTimer(-(-min(times) // 1000))

    def close(self) -> None:
        pass


def coalesced(feed: DataFrame, late: str = "10 seconds", join_s: float = JOIN_S, ttl_s: float = TTL_S) -> DataFrame:
    """``symbol, decided_at, live`` of the stream of :func:`tessera.operators.decisions.fanned` rows; decisions come once the watermark has passed them.

    Rows behind the watermark are dropped by Spark and counted in the query's progress. Wants a RocksDB state store.
    """
    keyed = feed.select("symbol", "ts", *FEED).withWatermark("ts", late).groupBy("symbol")
    return told(keyed.transformWithStateInPandas(Coalescer(join_s, ttl_s), "symbol string, at long, live string", "Append", "eventTime"))
