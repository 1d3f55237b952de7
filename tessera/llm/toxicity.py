"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.minhash import _mix, _slices, word_hashes

#: Weights there are, which bounds the broadcast; labelled rows that are fitted at most; models fitted side by side.
BITS = 20
MOST_LABELLED = 16_384
MODELS = 1
ALPHA, BETA, L1, L2 = 0.2, 1.0, 12.0, 1.0
EPOCHS = 4


def feature_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct hashed features of each text: words, neighbours, and pairs with one or two words between."""
    hashes, first = word_hashes([_letters(t) for t in texts])
    kinds = [_mix(hashes + np.uint64(1))]
    for gap in (1, 2, 3):
        kinds.append(_mix(_mix(hashes[:-gap] + np.uint64(7 * gap)) * np.uint64(31) + hashes[gap:]))
    shift = np.uint64(64 - BITS)
    kinds = [(k >> shift).astype(np.int64) for k in kinds]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.unique(np.concatenate([k[a : max(a, b - gap)] for gap, k in enumerate(kinds)])).astype(np.int32))
    return out


_PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def _letters(text: bytes) -> bytes:
    return text.translate(_PUNCTUATION)


def fit_ftrl(sets: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the weights other than 0; index ``1 << BITS`` is the intercept."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for s, y in zip(sets, labels.tolist(), strict=True):
            i = np.append(s, size - 1)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    every = np.flatnonzero(np.abs(z) > L1)
    return every, weights(every)


def learn(labelled: DataFrame) -> DataFrame:
    """``feature, weight`` from ``doc_id, text, toxic``: the mean of MODELS models, each fitted to a share of the rows.

    The shares and the order of rows within follow a hash of doc_id. At most MOST_LABELLED rows are given.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "doc_id"])
        with np.errstate(over="ignore"):
            texts = [bytes(t) for t in rows["text"]]
            sets = [s for part in _slices(texts) for s in feature_sets(texts[part])]
        index, value = fit_ftrl(sets, rows["toxic"].to_numpy(np.float64))
        return pd.DataFrame({"feature": index, "weight": value / MODELS})

    rank = F.xxhash64("doc_id", F.lit(11))
    rows = labelled.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.col("toxic").cast("double").alias("toxic"), rank.alias("rank"), F.pmod(rank, F.lit(MODELS)).alias("model"))
    return rows.groupBy("model").applyInPandas(run, "feature long, weight double").groupBy("feature").agg(F.sum("weight").alias("weight"))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """Labelled documents outside the held-out fold (crc32 of the id's text, modulo 4, is 2), at most ``most`` by hash."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for ``doc_id, text``; a row for each row, null doc_ids left out.

    Empty and null texts get the score of the intercept. Without labels every score is one half.
    """
    docs = docs.where(F.col("doc_id").isNotNull())
    found = learn(training_rows(docs, labels)).where("weight <> 0").toArrow()  # at most 2 ** BITS + 1 rows
    weights = docs.sparkSession.sparkContext.broadcast((found.column(0).to_numpy(), found.column(1).to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << BITS) + 1)
        w[weights.value[0]] = weights.value[1]
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            with np.errstate(over="ignore"):
                for part in _slices(texts):
                    out += [w[s].sum() + w[-1] for s in feature_sets(texts[part])]
            score = 1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
