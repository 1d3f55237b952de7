"""Messages of five topics to alerts, as a batch or a stream: nothing is remembered, so both give the same rows whatever the batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import monitor

#: Topic to the fields of its payload and the alert that they make.
TOPICS = {
    "breaker": ("level string, metric string, value double, threshold double, action string", monitor.breaker_alerts),
    "fill": ("symbol string, quantity double, price double, order_id string", monitor.fill_alerts),
    "revalidated": ("strategy string, original double, current double, degradation double, status string", monitor.revalidation_alerts),
    "status": ("strategy string, old_status string, new_status string, reason string, sharpe double", monitor.status_alerts),
    "drift": ("model_id string, drift_type string, severity string, action string", monitor.drift_alerts),
}
#: The fields that may be null.
OPTIONAL = ("sharpe",)


def _parsed(messages: DataFrame, topic: str) -> DataFrame:
    """``ts`` and the payload's fields, and ``fine``: no field but an optional one is missing."""
    schema = TOPICS[topic][0]
    rows = messages.where(F.col("topic") == topic).select("ts", "payload", F.from_json("payload", schema).alias("p"))
    names = [f.split()[0] for f in schema.split(", ")]
    fine = reduce(lambda a, b: a & b, [F.col(f"p.{n}").isNotNull() for n in names if n not in OPTIONAL])
    return rows.select("ts", "payload", *[F.col(f"p.{n}").alias(n) for n in names], F.coalesce(fine, F.lit(False)).alias("fine"))


def feed(messages: DataFrame, severity: str = "info") -> DataFrame:
    """``ts, severity, title, message`` of ``topic, ts, payload``, from ``severity`` on. Payloads that don't parse or lack a field make no alert; see :func:`refused`."""
    made = [make(_parsed(messages, topic).where("fine")) for topic, (_, make) in TOPICS.items()]
    return monitor.at_least(reduce(DataFrame.unionByName, made), severity)


def refused(messages: DataFrame) -> DataFrame:
    """``topic, ts, payload`` of the messages that make no alert: another topic, none, or a payload that lacks a field."""
    known = [_parsed(messages, topic).where("not fine").select(F.lit(topic).alias("topic"), "ts", "payload") for topic in TOPICS]
    other = messages.where(~F.coalesce(F.col("topic").isin(*TOPICS), F.lit(False))).select("topic", "ts", "payload")
    return reduce(DataFrame.unionByName, [*known, other])
