"""Quality classifier: histogram gradient-boosted trees over document statistics, scored from flat arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.minhash import _slices, word_hashes

#: Labelled rows that are fitted at most, chosen by a hash of the id; every document is scored.
MOST_LABELLED = 32_768
TREES, DEPTH, RATE, BINS = 60, 4, 0.15, 64
#: Ridge of a leaf, least sum of second derivatives in a leaf, and least gain of a split.
RIDGE, LEAST_HESSIAN, LEAST_GAIN = 1.0, 1.0, 1e-3

FEATURES = (
    "log_words", "word_length", "word_length_deviation", "log_longest_word", "upper", "digit", "mark", "symbol", "non_ascii", "space", "stop", "exclamation",
    "odd_words", "upper_words", "distinct_words", "top_word", "repeated_words", "log_lines", "line_words", "distinct_lines", "top_byte",
)
WINDOW = 8

_SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>{}[]\\^~@=+_"))
_MARK = np.isin(np.arange(256), list(b"!\"'(),-./:;?")) | _SYMBOL


def _ratio(a, b) -> np.ndarray:
    return np.asarray(a, np.float64) / np.maximum(b, 1)


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each UTF-8 text: sizes, and shares of bytes, words and lines. A text without words has zeros for its words."""
    hashes, first = word_hashes(texts)
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    space = _SPACES[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    length = (ends - starts).astype(np.float64)
    sums = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    odd, upper = (sums(k[data]) for k in (_SYMBOL, _UPPER))
    odd_word = (odd[ends] - odd[starts]) > 0
    upper_word = (upper[ends] - upper[starts]) * 2 > length
    eight = np.zeros(max(0, len(hashes) - WINDOW + 1), np.uint64)
    for k in range(WINDOW):
        eight = eight * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(eight)]
        eight ^= eight >> np.uint64(29)
    out = np.zeros((len(texts), len(FEATURES)))
    for i, (t, a, b) in enumerate(zip(texts, first[:-1].tolist(), first[1:].tolist(), strict=True)):
        n, words = len(t), b - a
        each = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        lines = [x for x in t.split(b"\n") if x.strip()]
        row = {"log_lines": np.log1p(len(lines)), "line_words": np.log1p(_ratio(words, len(lines))), "distinct_lines": _ratio(len(set(lines)), len(lines))}
        row |= {"upper": each[_UPPER].sum() / max(n, 1), "digit": each[_DIGIT].sum() / max(n, 1), "mark": each[_MARK].sum() / max(n, 1), "symbol": each[_SYMBOL].sum() / max(n, 1)}
        row |= {"non_ascii": each[128:].sum() / max(n, 1), "space": each[_SPACES].sum() / max(n, 1), "stop": _ratio(each[46], words), "exclamation": _ratio(each[33], words), "top_byte": each[~_SPACES].max() / max(n, 1)}
        if words:
            _, counts = np.unique(hashes[a:b], return_counts=True)
            row |= {"log_words": np.log1p(words), "word_length": length[a:b].mean(), "word_length_deviation": length[a:b].std(), "log_longest_word": np.log1p(length[a:b].max())}
            row |= {"odd_words": odd_word[a:b].mean(), "upper_words": upper_word[a:b].mean(), "distinct_words": len(counts) / words, "top_word": counts.max() / words}
            windows = eight[a : max(a, b - WINDOW + 1)]
            row["repeated_words"] = 1 - len(np.unique(windows)) / len(windows) if len(windows) else 0.0
        out[i] = [row.get(f, 0.0) for f in FEATURES]
    return out


@dataclass
class Trees:
    """Complete binary trees in arrays of trees x nodes: a row goes on to node 2 i + 1, or 2 i + 2 where its feature exceeds the edge."""

    feature: np.ndarray
    edge: np.ndarray
    value: np.ndarray
    start: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Sums of the leaves that each row of ``x`` reaches, all rows and trees a level at a time."""
        trees, rows = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(trees)), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.edge[trees, node])
        return self.start + self.value[trees, node].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def bin_edges(x: np.ndarray) -> list[np.ndarray]:
    """At most BINS - 1 edges of each column: distinct quantiles, a value belongs left of an edge that it equals."""
    at = np.linspace(0, 1, BINS + 1)[1:-1]
    return [np.unique(np.quantile(c, at, method="lower")) for c in x.T]


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """TREES trees of logistic loss. Each level adds up first and second derivatives by node, feature and bin, and splits where that gains most.

    Ties go to the first feature and the lowest edge. A node that gains nothing passes its rows on to the left.
    """
    edges = bin_edges(x)
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    n, width = x.shape
    positive = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(positive / (1 - positive)))
    nodes = (1 << (DEPTH + 1)) - 1
    feature, edge, value = np.zeros((TREES, nodes), np.int64), np.full((TREES, nodes), np.inf), np.zeros((TREES, nodes))
    margin = np.full(n, start)
    cell = bins + BINS * np.arange(width)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            base, many = (1 << level) - 1, 1 << level
            at = ((node - base)[:, None] * (width * BINS) + cell).ravel()
            sums = [np.bincount(at, np.repeat(v, width), many * width * BINS).reshape(many, width, BINS) for v in (g, h)]
            (gl, hl), (ga, ha) = (s.cumsum(axis=2) for s in sums), (s[:, :1].sum(axis=2, keepdims=True) for s in sums)
            gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
            gain[(hl < LEAST_HESSIAN) | (ha - hl < LEAST_HESSIAN)] = -np.inf
            for i, e in enumerate(edges):
                gain[:, i, len(e) :] = -np.inf
            best = np.round(gain, 9).reshape(many, -1).argmax(axis=1)
            for k, b in enumerate(best.tolist()):
                if gain[k].ravel()[b] > LEAST_GAIN:
                    feature[t, base + k], edge[t, base + k] = b // BINS, edges[b // BINS][b % BINS]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > edge[t, node])
        last = (1 << DEPTH) - 1
        gs, hs = (np.bincount(node - last, v, 1 << DEPTH) for v in (g, h))
        value[t, last:] = -RATE * gs / (hs + RIDGE)
        margin += value[t, node]
    return Trees(feature, edge, value, start)


def featured(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the statistics of each whole text; null counts as empty, rows without a doc_id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            with np.errstate(over="ignore"):
                rows = [statistics(texts[part]) for part in _slices(texts)]
            flat = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
            x = pa.FixedSizeListArray.from_arrays(pa.array(flat.astype(np.float32).ravel()), len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), x.cast(pa.list_(pa.float32()))], ["doc_id", "x"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, x array<float>")


def fold_of() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))


def training_rows(rows: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``doc_id, x, y`` of labelled rows outside the held-out fold (crc32 of the id's text, modulo 5, is 0), at most ``most`` ids by hash.

    Of several labels of an id the largest counts; each row of a repeated doc_id is one.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold_of() != 0)).groupBy("doc_id").agg(F.max("quality").alias("y"))
    chosen = usable.orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id").limit(most)
    return rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "x", F.col("y").cast("double").alias("y"))


def learn(labelled: DataFrame, most: int = MOST_LABELLED) -> Trees:
    """The trees of ``doc_id, x, y``, fitted in one task to at most ``most`` rows; without rows every margin is 0."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(t=rows["x"].map(tuple)).sort_values(["doc_id", "t", "y"])
        made = fit(np.array(rows["x"].tolist(), np.float32).astype(np.float64), rows["y"].to_numpy(np.float64))
        return pd.DataFrame({"feature": [made.feature.ravel()], "edge": [made.edge.ravel()], "value": [made.value.ravel()], "start": [made.start]})

    one = labelled.orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id", "x", "y").limit(most).withColumn("model", F.lit(0))
    got = one.groupBy("model").applyInPandas(run, "feature array<long>, edge array<double>, value array<double>, start double").collect()
    shape = (TREES, (1 << (DEPTH + 1)) - 1)
    if not got:
        return Trees(np.zeros(shape, np.int64), np.full(shape, np.inf), np.zeros(shape), 0.0)
    return Trees(*(np.array(got[0][c]).reshape(shape) for c in ("feature", "edge", "value")), got[0]["start"])


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for ``doc_id, text``; a row for each row with a doc_id.

    Statistics come from whole texts and are stored once; the trees (under 50 KB) are broadcast. Empty and null texts have a
    score as any other. Without usable labels every score is one half.
    """
    rows = stored(featured(docs), "statistics")
    sent = docs.sparkSession.sparkContext.broadcast(learn(training_rows(rows, labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.scores(x))], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold_of() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
