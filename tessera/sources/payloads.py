"""Parsing of landed vendor payloads: daily bars, company facts, macro vintages. Bad payloads give no rows, bad fields null."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Field to the concepts that report it and their units, best first.
CONCEPTS = {
    "revenue": [
        ("Revenues", "USD"), ("RevenueFromContractWithCustomerExcludingAssessedTax", "USD"), ("RevenueFromContractWithCustomerIncludingAssessedTax", "USD"), ("SalesRevenueNet", "USD"),
    ],
    "gross_profit": [("GrossProfit", "USD")],
    "cost_of_revenue": [("CostOfRevenue", "USD"), ("CostOfGoodsAndServicesSold", "USD"), ("CostOfGoodsSold", "USD"), ("CostOfServices", "USD")],
    "net_income": [("NetIncomeLoss", "USD")],
    "total_assets": [("Assets", "USD")],
    "total_liabilities": [("Liabilities", "USD")],
    "current_assets": [("AssetsCurrent", "USD")],
    "current_liabilities": [("LiabilitiesCurrent", "USD")],
    "shares_outstanding": [
        ("CommonStockSharesOutstanding", "shares"), ("WeightedAverageNumberOfSharesOutstandingBasic", "shares"), ("WeightedAverageNumberOfDilutedSharesOutstanding", "shares"),
    ],
    "operating_cash_flow": [("NetCashProvidedByUsedInOperatingActivities", "USD")],
    "eps": [("EarningsPerShareBasic", "USD/shares")],
}
#: Fixed value: the vintage that stands for an unknown one.
UNDATED = "9999-12-31"


def number(c: Column) -> Column:
    """A number, or null where the text is none (a single dot, empty, words)."""
    return c.try_cast("double")


def day(c: Column) -> Column:
    """A date from an ISO date or timestamp, or null."""
    return F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.to_date(F.try_to_timestamp(c)))


def daily_bars(payloads: DataFrame) -> DataFrame:
    """``symbol, ts, open, high, low, close, adj_close, volume`` from ``symbol, payload``: a series keyed by date.

    A payload that is no JSON or holds an error has no series. A bar goes if a price is missing or not positive, or its
    high and low don't enclose open and close.
    """
    series = F.from_json("payload", "`Time Series (Daily)` map<string, map<string, string>>")["Time Series (Daily)"]
    rows = payloads.select("symbol", F.explode(series).alias("at", "f"))
    field = lambda name: number(F.col("f")[name])
    rows = rows.select(
        "symbol", day(F.col("at")).cast("timestamp").alias("ts"), field("1. open").alias("open"), field("2. high").alias("high"), field("3. low").alias("low"),
        field("4. close").alias("close"), field("5. adjusted close").alias("adj_close"), field("6. volume").alias("volume"),
    )
    return rows.where(valid_bar() & F.col("ts").isNotNull())


def valid_bar() -> Column:
    """Whether ``open, high, low, close`` are all there and positive, the high and low enclose the others, and a volume is not negative."""
    enclosed = (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high"))
    known = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    return F.coalesce(known & enclosed & (F.least("open", "high", "low", "close") > 0) & (F.coalesce("volume", F.lit(0.0)) >= 0), F.lit(False))


def annual_facts(payloads: DataFrame) -> DataFrame:
    """``cik, tag, unit, period_end, value, filed`` from ``cik, payload``: annual values of the yearly reports, as first filed."""
    shape = "facts struct<`us-gaap`: map<string, struct<units: map<string, array<struct<end: string, val: double, form: string, fp: string, filed: string>>>>>>"
    facts = F.from_json("payload", shape)["facts"]["us-gaap"]
    rows = payloads.select("cik", F.explode(facts).alias("tag", "of")).select("cik", "tag", F.explode("of.units").alias("unit", "each"))
    rows = rows.select("cik", "tag", "unit", F.explode("each").alias("x")).where(F.col("x.form").isin("10-K", "10-K/A") & (F.col("x.fp") == "FY"))
    rows = rows.select("cik", "tag", "unit", day(F.col("x.end")).alias("period_end"), F.col("x.val").alias("value"), day(F.col("x.filed")).alias("filed"))
    first = F.struct(F.coalesce("filed", F.lit(UNDATED).cast("date")).alias("at"), "value")
    out = rows.where("period_end is not null and value is not null").groupBy("cik", "tag", "unit", "period_end").agg(F.min(first).alias("x"))
    return out.select("cik", "tag", "unit", "period_end", F.col("x.value").alias("value"), F.nullif(F.col("x.at"), F.lit(UNDATED).cast("date")).alias("filed"))


def statements(facts: DataFrame, concepts: Mapping[str, list[tuple[str, str]]] = CONCEPTS, newest: int | None = None) -> DataFrame:
    """``cik, period_end, filed_at`` and a column for each field: the best concept in its unit that a period has; filed when its last field was, null if one is undated."""
    ranked = [(field, tag, unit, i) for field, tags in concepts.items() for i, (tag, unit) in enumerate(tags)]
    table = F.broadcast(facts.sparkSession.createDataFrame(ranked, "field string, tag string, unit string, place int"))
    best = facts.join(table, ["tag", "unit"]).groupBy("cik", "field", "period_end").agg(F.min_by(F.struct("value", "filed"), "place").alias("x"))
    out = best.groupBy("cik", "period_end").agg(
        *[F.max(F.when(F.col("field") == f, F.col("x.value"))).alias(f) for f in concepts], F.when(F.count_if(F.col("x.filed").isNull()) == 0, F.max("x.filed")).alias("filed_at")
    )
    if newest is None:
        return out
    w = Window.partitionBy("cik").orderBy(F.desc("period_end"))
    return out.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= newest).drop("__k")


def macro_observations(payloads: DataFrame) -> DataFrame:
    """``series, observation_date, realtime_start, value`` from ``series, payload``: values that are numbers, the first of each date and vintage."""
    rows = payloads.select("series", F.posexplode(F.from_json("payload", "observations array<struct<date: string, realtime_start: string, value: string>>")["observations"]).alias("at", "x"))
    rows = rows.select("series", "at", day(F.col("x.date")).alias("observation_date"), day(F.col("x.realtime_start")).alias("realtime_start"), number(F.col("x.value")).alias("value"))
    rows = rows.where("observation_date is not null and value is not null")
    w = Window.partitionBy("series", "observation_date", "realtime_start").orderBy("at")
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "at")


def macro_coverage(observations: DataFrame) -> DataFrame:
    return observations.groupBy("series").agg(
        F.count("*").alias("observations"), F.count_if(F.col("realtime_start").isNull()).alias("undated"), F.min("observation_date").alias("first_date"), F.max("observation_date").alias("last_date")
    )
