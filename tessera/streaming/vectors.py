"""Bars to feature vectors, and vectors to votes: streams whose sinks are written anew by a replayed batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tessera.operators import market, technical
from tessera.operators.monitor import vote

#: Bars that a vector looks back over, itself included, and bars of a symbol that are kept: a bar may come so many less sessions late.
LOOKBACK, KEPT = 300, 600
PRICES = ("open", "high", "low", "close", "volume", "adj_close")
BAR = StructType([StructField("at", LongType()), *[StructField(c, DoubleType()) for c in PRICES]])
CHUNK = "symbol string, at long, " + ", ".join(f"{c} double" for c in PRICES) + ", fresh boolean"


class History(StatefulProcessor):
    """List state of a symbol's newest KEPT bars. New bars go out with the bars that their vectors look back over."""

    def init(self, handle) -> None:
        self.bars = handle.getListState("bars", BAR)
        self.cut = handle.getValueState("cut", StructType([StructField("bars", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {r[0]: tuple(r) for r in self.bars.get()}
        new: dict[int, tuple] = {}
        for part in rows:
            for bar in part[["at", *PRICES]].itertuples(index=False, name=None):
                bar = tuple(None if x != x else x for x in bar)
                if bar[0] not in new or tuple(map(str, bar)) > tuple(map(str, new[bar[0]])):  # of two in a batch the same one in any order
                    new[bar[0]] = bar
        known |= new
        every = sorted(known.values())
        cut = self.cut.get()[0] if self.cut.exists() else 0
        first = next(i for i, bar in enumerate(every) if bar[0] in new)
        first = max(first, LOOKBACK - 1) if cut else first  # what lies before is no longer whole
        out = every[max(0, first - LOOKBACK + 1) :]
        held = every[-KEPT:]
        self.bars.put(held)
        self.cut.update((cut + len(every) - len(held),))
        frame = pd.DataFrame(out, columns=["at", *PRICES]).astype({c: "float64" for c in PRICES})
        frame.insert(0, "symbol", pd.Series([key[0]] * len(out), dtype=object))
        yield frame.assign(fresh=frame["at"] >= (every[first][0] if first < len(every) else 1 << 62))

    def close(self) -> None:
        pass


def vectors(bars: DataFrame) -> DataFrame:
    """Every feature of every bar: trailing, technical and recursive ones."""
    keys = ["symbol", "ts"]
    return market.features(bars).join(technical.technical(bars), keys).join(technical.recursive(bars), keys)


def bars_to_vectors(bars: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes to ``out`` the vectors of the stream ``symbol, ts`` and PRICES: those of new bars, and anew those of the bars after a late or changed one.

    State is KEPT bars a symbol. A batch computes its new vectors with the functions that the batch queries use, over a chunk of bars for
    each symbol, and overwrites a folder of its own number, so a replay changes nothing. Bars later than KEPT - LOOKBACK sessions change later vectors only as far as their bars are kept.
    """
    rows = bars.where("symbol is not null and ts is not null").select("symbol", F.unix_micros("ts").alias("at"), *[F.col(c).cast("double").alias(c) for c in PRICES])
    chunks = rows.groupBy("symbol").transformWithStateInPandas(History(), CHUNK, "Append", "None")

    def write(chunk: DataFrame, number: int) -> None:
        chunk = chunk.persist()  # three functions read it; the state is advanced once
        fresh = chunk.where("fresh").select("symbol", F.timestamp_micros("at").alias("ts"))
        made = vectors(chunk.withColumn("ts", F.timestamp_micros("at")).drop("at", "fresh"))
        made.join(fresh, ["symbol", "ts"], "left_semi").write.mode("overwrite").parquet(f"{out}/batch={number}")
        chunk.unpersist()

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, path: str, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """What the batches of a sink have written, of rows with the same keys those of the latest batch."""
    rows = spark.read.parquet(path)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("__k", last).where("__k = 1").drop("__k", "batch")


def serve(rows: DataFrame, predict: Callable[[DataFrame], DataFrame], names: list[str], model_id: str, log: str, votes: str, checkpoint: str, most_missing: float = 0.5) -> StreamingQuery:
    """Starts a query that scores the stream ``symbol, ts`` and ``names``: every output goes to the inference log, BUY and SELL also to the votes.

    ``predict`` adds ``p``, the probability of a rise, to a batch whose missing features are neutral (0.5). Rows that lack more than
    ``most_missing`` of the features are refused and go to neither sink. A batch overwrites a folder of its own number in both, so a replay changes neither.
    """

    def write(batch: DataFrame, number: int) -> None:
        missing = sum((F.col(n).isNull().cast("int") for n in names), F.lit(0))
        known = batch.where(F.col("symbol").isNotNull() & (missing <= most_missing * len(names))).na.fill(0.5, names)
        said = vote(F.col("p"), []).alias("v")
        features = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names]))
        scored = predict(known).select("symbol", "ts", F.lit(model_id).alias("model_id"), "p", features.alias("features"), said).where("v is not null").persist()
        scored.select("symbol", "ts", "model_id", "p", "v.signal", "features").write.mode("overwrite").parquet(f"{log}/batch={number}")
        scored.where("v.signal <> 'HOLD'").select("symbol", "ts", "model_id", "p", "v.signal", "v.confidence").write.mode("overwrite").parquet(f"{votes}/batch={number}")
        scored.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
