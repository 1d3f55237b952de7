"""Structured Streaming forms: messages once, orders once a session, the circuit breaker and protective exits as keyed state, liquidations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.ledger import FLATTEN, HALT, WARN


def once(messages: DataFrame, key: str = "event_id", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each message once by its id; the ids of the last ``late`` are kept."""
    return messages.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def orders_once(orders: DataFrame, late: str = "5 days") -> DataFrame:
    """One order of a symbol and side in a session (a UTC day), first come; sessions older than ``late`` are forgotten."""
    return orders.withColumn("session", F.to_date("ts")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "side", "session"])


def breaker_changes(equity: DataFrame, start: float) -> DataFrame:
    """``account, ts, level`` whenever the circuit breaker of ``account, ts, equity`` changes: BLACK stays, RED lasts for its day.

    State is the peak, the latch, the day with its first value and halt, and the last level: a few numbers for each account.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        peak, black, day, first, halted, level = state.get if state.exists else (start, False, "", 0.0, "", "NONE")
        out = []
        for rows in [pd.concat(list(batches)).sort_values("ts")]:
            for ts, value in zip(rows["ts"], rows["equity"], strict=True):
                today = str(ts.date())
                if today != day:
                    day, first = today, value
                peak = max(peak, value)
                drop, loss = 1 - value / peak, 1 - value / first if first > 0 else 0.0
                black = black or drop >= FLATTEN
                halted = today if loss >= HALT else halted
                now = "BLACK" if black else "RED" if halted == today else "YELLOW" if drop >= WARN else "NONE"
                if now != level:
                    level = now
                    out.append((key[0], ts, level))
        state.update((peak, black, day, first, halted, level))
        yield pd.DataFrame(out, columns=["account", "ts", "level"])

    return equity.groupBy("account").applyInPandasWithState(
        step, "account string, ts timestamp, level string", "peak double, black boolean, day string, first double, halted string, level string", "append", GroupStateTimeout.NoTimeout
    )


def protective_exits(feed: DataFrame) -> DataFrame:
    """``symbol, ts, quantity, price, reason``: the sale of a whole position at its first mark at or beyond the stop or the target.

    ``feed`` is one stream of ``symbol, ts, kind, price, quantity, stop, target``: ``open`` sets a symbol's position and levels (the last one counts, none or a level of null protects nothing),
    ``mark`` tells its price. Rows of a batch are taken by time, an opening before a mark of the same time. State is one position a symbol; it goes with the exit.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        quantity, stop, target = state.get if state.exists else (0.0, float("nan"), float("nan"))
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "kind"], ascending=[True, False])
        for ts, kind, price, *opened in rows[["ts", "kind", "price", "quantity", "stop", "target"]].astype({c: "float64" for c in ("price", "quantity", "stop", "target")}).itertuples(index=False, name=None):
            if kind == "open":
                quantity, stop, target = opened
            elif quantity > 0 and (price <= stop or price >= target):  # a missing level is NaN and compares false
                out.append((key[0], ts, quantity, price, "stop" if price <= stop else "target"))
                quantity, stop, target = 0.0, float("nan"), float("nan")
        if quantity > 0:
            state.update((quantity, stop, target))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["symbol", "ts", "quantity", "price", "reason"])

    rows = feed.where("symbol is not null and ts is not null and kind in ('open', 'mark')")
    return rows.groupBy("symbol").applyInPandasWithState(
        step, "symbol string, ts timestamp, quantity double, price double, reason string", "quantity double, stop double, target double", "append", GroupStateTimeout.NoTimeout
    )


def liquidations(changes: DataFrame, positions: DataFrame) -> DataFrame:
    """``account, ts, symbol, side, quantity, price, reason``: the sale of each open position of ``account, symbol, quantity, last_price`` when the account's breaker turns BLACK.

    ``changes`` is the stream of :func:`breaker_changes`. Positions are a table, read anew by each batch; those without quantity or price stay out.
    """
    held = positions.where("quantity > 0 and last_price > 0").select("account", "symbol", F.col("quantity").cast("double").alias("quantity"), F.col("last_price").alias("price"))
    sold = changes.where("level = 'BLACK'").join(held, "account")
    return sold.select("account", "ts", "symbol", F.lit("SELL").alias("side"), "quantity", "price", F.lit("BLACK").alias("reason"))
