"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, survivors in double precision."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import spread_join, stored

#: Vectors in a block of candidates and of queries: a tile's working arrays stay under 100 MB.
CANDIDATES = 4096
QUERIES = 256


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding, dim`` of the vectors that take part: not null, finite throughout, and not zero."""
    rows = vectors.where(F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(finite & F.exists("embedding", lambda v: v != 0)).withColumn("dim", F.size("embedding"))


def _packed(rows: DataFrame, size: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Blocks ``dim, block, ids, data`` of about ``size`` vectors by a hash of the id, and ``dim, blocks``."""
    counts = stored(rows.groupBy("dim").agg(F.ceil(F.count("*") / size).cast("long").alias("blocks")), "dimensions")
    dealt = spread_join(rows, counts, ["dim"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col("blocks")))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = np.array(part["embedding"].tolist(), np.float64)
        ids = part["vec_id"].to_numpy(np.int64)
        return pd.DataFrame({"dim": [part["dim"].iloc[0]], "block": [part["block"].iloc[0]], "ids": [ids.tobytes()], "data": [x.tobytes()]})

    # dealt by both: Spark would take rows that lie dealt by dim alone as they are
    return dealt.repartition("dim", "block").groupBy("dim", "block").applyInPandas(run, "dim int, block long, ids binary, data binary"), counts


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 entries, a scale for each vector, and the length of what quantising lost."""
    scale = np.abs(x).max(axis=1) / 127
    scale = np.where(scale == 0, 1.0, scale)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` to ``y``; differences whose squares overflow or vanish are scaled first."""
    off = x - y
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        out = np.sqrt((off**2).sum(axis=1))
        odd = np.flatnonzero(~((out > 1e-140) & (out < 1e150)))
        if len(odd):
            most = np.abs(off[odd]).max(axis=1)
            unit = np.where((most > 0) & np.isfinite(most), most, 1.0)
            out[odd] = np.where(np.isfinite(most), unit * np.sqrt(((off[odd] / unit[:, None]) ** 2).sum(axis=1)), np.inf)
    return out


def tile(qi: np.ndarray, qx: np.ndarray, ci: np.ndarray, cx: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """For each query of the tile its ``k`` nearest candidates, other than itself: query, candidate, distance.

    With errors e of either side, the distance lies within e_q + e_c of that of the quantised vectors. Candidates whose lower
    bound exceeds the k-th smallest upper bound are out; the others are measured on the vectors themselves. Bounds are
    those of vectors scaled by a power of two to components up to 1, so no finite vector's products overflow.
    """
    unit = 2.0 ** -math.frexp(max(np.abs(qx).max(), np.abs(cx).max()))[1]
    (q, sq, eq), (c, sc, ec) = quantised(qx * unit), quantised(cx * unit)
    exact = np.float32 if q.shape[1] <= 1024 else np.float64  # sums of int8 products are whole numbers below 2 ** 24
    dots = (q.astype(exact) @ c.astype(exact).T).astype(np.float64) * sq[:, None] * sc
    nq, nc = ((v.astype(np.float64) ** 2).sum(axis=1) * s * s for v, s in ((q, sq), (c, sc)))
    about = np.sqrt(np.maximum(nq[:, None] + nc - 2 * dots, 0))
    slack = eq[:, None] + ec + 1e-6 * (np.sqrt(nq)[:, None] + np.sqrt(nc)) + 1e-150
    upper = np.where(qi[:, None] == ci, np.inf, about + slack)
    kth = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] > k else np.full(len(qi), np.inf)
    for i in range(len(qi)):
        left = np.flatnonzero((about[i] - slack[i] <= kth[i]) & (ci != qi[i]))
        for dist, cand in heapq.nsmallest(k, zip(distances(cx[left], qx[i]).tolist(), ci[left].tolist(), strict=True)):
            yield int(qi[i]), cand, dist


def _merged(k: int):
    """Merges rows ``query_id, vec_id, score`` in a heap of the ``k`` best for each query; its root is the worst of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for query, cand, dist in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                heap, row = heaps.setdefault(query, []), (-dist, -cand)
                if len(heap) < k:
                    heapq.heappush(heap, row)
                elif row > heap[0]:
                    heapq.heapreplace(heap, row)
        rows = [(query, rank, -cand, -dist) for query, heap in heaps.items() for rank, (dist, cand) in enumerate(sorted(heap, reverse=True), 1)]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "rank", "vec_id", "score"])

    return run


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest candidates of each query by Euclidean distance, exactly.

    Both have ``vec_id, embedding``; a query's own id is no candidate, ties go to the smaller id, fewer candidates
    give fewer rows. Vectors that are null, zero or hold null or non-finite components take no part; only vectors of
    equal dimension are compared. A repeated vec_id counts once, with its smallest embedding. Each block of queries
    meets each block of candidates in a tile, tiles are spread over the cluster, a tile hands on k rows a query,
    and heaps of k rows merge those of each query where its rows meet. Distances beyond the largest double are infinite.
    """
    once = lambda v: usable(v).groupBy("vec_id").agg(F.min(F.struct("embedding", "dim")).alias("e")).select("vec_id", "e.*")
    right, counts = _packed(once(candidates), CANDIDATES, 1)
    left, _ = _packed(once(queries), QUERIES, 2)
    left = spread_join(left, counts, ["dim"]).select("dim", F.col("ids").alias("qids"), F.col("data").alias("qdata"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                qi, ci = (np.frombuffer(p, np.int64) for p in parts[::2])
                qx, cx = (np.frombuffer(p, np.float64).reshape(-1, dim) for p in parts[1::2])
                rows = list(tile(qi, qx, ci, cx, k))
                columns = list(zip(*rows, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    tiles = left.join(right, ["dim", "block"]).select("dim", "qids", "qdata", "ids", "data")
    found = tiles.mapInArrow(run, "query_id long, vec_id long, score double").repartition("query_id")
    return found.mapInArrow(_merged(k), "query_id long, rank int, vec_id long, score double")
