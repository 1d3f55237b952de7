"""Syncing the bar store with what vendors have landed: plans, sources in their order, restated histories, failed symbols apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.market import coverage
from tessera.operators.panel import restated, upsert
from tessera.operators.universe import fetch_plan
from tessera.sources.payloads import valid_bar

BAR = ["symbol", "ts", "open", "high", "low", "close", "volume", "adj_close"]


def first_source(landed: DataFrame) -> DataFrame:
    """Of each symbol the rows of its first source by ``priority`` that has any."""
    best = landed.groupBy("symbol").agg(F.min("priority").alias("priority"))
    return landed.join(best, ["symbol", "priority"], "left_semi")


def needs_catchup(last: Column, now: Column, close_hour: int = 23) -> Column:
    """Whether the last day synced (null: never) is before the day that a sync could cover: today from ``close_hour`` UTC on, before that yesterday. A day in the future counts as covered."""
    return last.isNull() | (last < F.date_sub(now.cast("date"), F.when(F.hour(now) >= close_hour, 0).otherwise(1)))


def sync(symbols: DataFrame, stored: DataFrame, landed: DataFrame, failures: DataFrame, now: Column, depth_days: int = 365 * 6, overlap_days: int = 5) -> tuple[DataFrame, DataFrame]:
    """The bars to store, and ``symbol, mode, rows, previous_latest, latest, error``, one row for each of ``symbols``.

    ``landed`` holds BAR, ``priority, seq``: all that the vendors have of each symbol; ``failures`` are ``symbol, error`` of requests that
    failed. A symbol without bars takes its full history, another what lies between ``overlap_days`` before its last bar and ``now``. Where an adjustment factor
    of the overlap has moved, the whole history is taken (``readjusted``), back to the first bar stored. A failed symbol, and one that
    the first source with rows sends bars for of which none is valid, keeps its bars and is told with its error; the others are not held up. Bars that are not valid stay out.
    """
    plan = fetch_plan(symbols, coverage(stored), now.cast("date"), depth_days, overlap_days).select("symbol", "mode", "start", "repair_start")
    down = failures.groupBy("symbol").agg(F.max("error").alias("error"))
    sent = first_source(landed.join(down, "symbol", "left_anti")).join(plan, "symbol").where(F.col("ts") <= now)
    good = sent.where(valid_bar())
    broken = sent.groupBy("symbol").agg(F.count_if(valid_bar()).alias("__n")).where("__n = 0").select("symbol", F.lit("no valid bar").alias("error"))
    window = good.where(F.to_date("ts") >= F.col("start"))
    moved = restated(stored, window.where("mode = 'incremental'")).where("restated").select("symbol", F.lit(True).alias("moved"))
    chosen = good.join(moved, "symbol", "left").where(F.to_date("ts") >= F.when(F.col("moved"), F.col("repair_start")).otherwise(F.col("start")))
    mode = F.when(F.max("moved"), "readjusted").otherwise(F.max("mode"))
    made = chosen.groupBy("symbol").agg(mode.alias("done"), F.countDistinct("ts").alias("rows"), F.max("ts").alias("newest"))
    known = stored.groupBy("symbol").agg(F.max("ts").alias("previous_latest"))
    summary = plan.join(made, "symbol", "left").join(known, "symbol", "left").join(down.unionByName(broken), "symbol", "left")
    failed = F.col("error").isNotNull()
    summary = summary.select(
        "symbol", F.when(failed, "failed").otherwise(F.coalesce("done", "mode")).alias("mode"), F.when(failed, 0).otherwise(F.coalesce("rows", F.lit(0))).cast("long").alias("rows"),
        "previous_latest", F.when(failed, F.col("previous_latest")).otherwise(F.coalesce("newest", "previous_latest")).alias("latest"), "error",
    )
    return upsert(stored.select(*BAR), chosen.select(*BAR, "seq")), summary


def rounded_up(summary: DataFrame) -> DataFrame:
    """One row: symbols, synced, failed, rows, readjusted."""
    return summary.agg(
        F.count("*").alias("symbols"), F.count_if(F.col("mode") != "failed").alias("synced"), F.count_if(F.col("mode") == "failed").alias("failed"), F.sum("rows").alias("rows"),
        F.count_if(F.col("mode") == "readjusted").alias("readjusted"),
    )
