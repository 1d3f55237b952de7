"""Vector code compression: product codes of integer parts, nearest entries by equal-average search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import spread_join, stored

PARTS, ENTRIES, ROUNDS, UNITS = 8, 16, 6, 4096
#: Integers that all codebooks of a table may hold together: they are sent to every task.
MOST_INTEGERS = 1 << 24
LIMB = 60  # bits of a whole number that one row of a sum holds
MOST_LONG = (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding, label`` of the vectors that take part: not null, no component null, infinite or not a number."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", "embedding", "label")


def integers(x: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """floor(UNITS * x) of rows of doubles as rows x parts x places; zeros fill up a dimension that the parts don't divide.

    int64 where distances and gaps of any two such rows fit it, else Python's whole numbers.
    """
    pad = -x.shape[1] % parts
    x = np.pad(np.asarray(x, np.float64), ((0, 0), (0, pad)))
    each = x.shape[1] // parts
    if np.abs(x).max(initial=0) < (1 << 29) / UNITS / max(1, each):
        whole = np.floor(x * UNITS).astype(np.int64)
    else:
        unscaled = [int(v) * UNITS if abs(v) >= 1 << 53 else int(np.floor(v * UNITS)) for v in x.ravel().tolist()]
        whole = np.array(unscaled, object).reshape(x.shape)
    return whole.reshape(len(x), parts, each)


def _one_kind(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x, book) if x.dtype == book.dtype else (x.astype(object), book.astype(object))


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``book`` for each row of ``x``, and its squared distance; ties go to the lower index.

    Entries are sorted by the sum of their components. From where a row's own sum falls, the search takes the entry with the
    nearer sum of the next one below and the next one above; as (gap of sums) ** 2 / dimension never exceeds the squared
    distance, a row is done once that of the nearer one is strictly more than its best. Rows go on side by side.
    """
    x, book = _one_kind(x, book)
    k, dim = book.shape
    sums = book.sum(axis=1)
    order = np.array(sorted(range(k), key=lambda j: sums[j]))
    sorted_sums = sums[order]
    own = x.sum(axis=1)
    above = np.searchsorted(sorted_sums, own)
    below = above - 1
    best, at = np.zeros(len(x), x.dtype), np.full(len(x), -1)
    rows = np.arange(len(x))
    while len(rows):
        lo, hi = below[rows], above[rows]
        gap_lo, gap_hi = own[rows] - sorted_sums[np.maximum(lo, 0)], sorted_sums[np.minimum(hi, k - 1)] - own[rows]
        down = (lo >= 0) & ((hi >= k) | (gap_lo <= gap_hi))
        gap = np.where(down, gap_lo, gap_hi)
        more = ((lo >= 0) | (hi < k)) & ((at[rows] < 0) | ~(gap * gap > best[rows] * dim)).astype(bool)
        rows, down, lo, hi = rows[more], down[more], lo[more], hi[more]
        entry = order[np.where(down, lo, hi)]
        off = x[rows] - book[entry]
        dist = (off * off).sum(axis=1)
        better = ((at[rows] < 0) | (dist < best[rows]) | ((dist == best[rows]) & (entry < at[rows]))).astype(bool)
        best[rows[better]], at[rows[better]] = dist[better], entry[better]
        below[rows[down]] -= 1
        above[rows[~down]] += 1
    return at, best


def _by_dimension(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, places of its rows in the batch, and their components."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        yield dim, at, flat[starts[at][:, None] + np.arange(dim)]


def _assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = [nearest_entries(x[:, p], books[p]) for p in range(x.shape[1])]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1].astype(object) for f in found], axis=1).sum(axis=1)


def _sums(books):
    """Partial sums of a task: ``dim, part, entry, place, limb, value``, and the number of rows at place -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, rows in _by_dimension(batch.column(0)):
                x = integers(rows)
                book = books.value[dim]
                code, _ = _assigned(x, book)
                held = total.setdefault(dim, np.zeros((*book.shape[:2], book.shape[2] + 1), object))
                for p in range(x.shape[1]):
                    for e in np.unique(code[:, p]).tolist():
                        mine = x[code[:, p] == e, p]
                        held[p, e, :-1] += mine.sum(axis=0).astype(object)
                        held[p, e, -1] += len(mine)
        out = []
        for dim, held in total.items():
            for (p, e, place), value in np.ndenumerate(held):
                size, limb = abs(int(value)), 0
                while size:
                    low = size & ((1 << LIMB) - 1)
                    out.append((dim, p, e, place if place < held.shape[2] - 1 else -1, limb, low if value > 0 else -low))
                    size, limb = size >> LIMB, limb + 1
        columns = list(zip(*out, strict=True)) or [[]] * 6
        names = ["dim", "part", "entry", "place", "limb", "value"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def codebooks(vectors: DataFrame, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """For each dimension of ``vectors`` (as :func:`usable` gives them) the entries as parts x entries x places, after ``rounds``.

    The first ones are the parts of the ENTRIES smallest vec_ids (all, if fewer; of equal ids the smaller embedding first). A
    round is one job: tasks assign and add up their rows, Spark adds the tasks' sums, and entries times dimension sums reach the driver.
    """
    spark = vectors.sparkSession
    # the smallest ids of each task come before those of all: no dimension's rows meet in one task
    dims = [r[0] for r in vectors.select(F.size("embedding").alias("d")).groupBy("d").count().orderBy("d").collect()]
    if sum(ENTRIES * d for d in dims) > MOST_INTEGERS:
        raise ValueError(f"codebooks of {len(dims)} dimensions hold more than {MOST_INTEGERS} integers")
    books = {}
    for d in dims:
        first = vectors.where(F.size("embedding") == d).orderBy("vec_id", "embedding").select("embedding").limit(ENTRIES).collect()
        books[d] = integers(np.array([r[0] for r in first], np.float64).reshape(len(first), d)).transpose(1, 0, 2)
    for _ in range(rounds if dims else 0):
        sent = spark.sparkContext.broadcast(books)
        parts = vectors.select("embedding").mapInArrow(_sums(sent), "dim long, part long, entry long, place long, limb long, value long")
        added = parts.groupBy("dim", "part", "entry", "place", "limb").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value")).collect()
        whole: dict[tuple, int] = {}
        for r in added:
            key = (r["dim"], r["part"], r["entry"], r["place"])
            whole[key] = whole.get(key, 0) + (int(r["value"]) << (LIMB * r["limb"]))
        new = {}
        for d, book in books.items():
            moved = book.astype(object)
            for p, e, place in np.ndindex(*book.shape):
                if n := whole.get((d, p, e, -1)):
                    moved[p, e, place] = whole.get((d, p, e, place), 0) // n
            small = max((abs(v) for v in moved.ravel().tolist()), default=0) * max(1, book.shape[2]) < 1 << 29
            new[d] = moved.astype(np.int64) if small else moved
        books = new
    return books


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label, label_error, codebooks_sha256`` for ``vec_id, embedding, label``.

    A row for each usable row (see :func:`usable`; a repeated vec_id has so many rows), none for an empty table. Each dimension
    has codebooks of its own; where PARTS don't divide it, zeros fill its end, and an empty vector has code 0 throughout. Whole
    numbers are exact at every size; an error, or a sum of errors, beyond the largest long is given as the largest long.
    """
    spark = vectors.sparkSession
    kept = stored(usable(vectors), "vectors")
    books = codebooks(kept)
    sent = spark.sparkContext.broadcast((books, {d: digest(b) for d, b in books.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, digests = sent.value
        for batch in batches:
            code, error, sha = ([None] * len(batch) for _ in range(3))
            for dim, at, rows in _by_dimension(batch.column(1)):
                indexes, errors = _assigned(integers(rows), books[dim])
                for i, row, e in zip(at.tolist(), indexes.tolist(), errors.tolist(), strict=True):
                    code[i], error[i], sha[i] = bytes(row).hex(), min(int(e), MOST_LONG), digests[dim]
            arrays = [batch.column(0), pa.array(code, pa.string()), pa.array(error, pa.int64()), batch.column(2), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "code", "error", "of", "codebooks_sha256"])

    keyed = kept.select("vec_id", "embedding", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")).alias("of"), "label")
    coded = keyed.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "of")
    coded = stored(coded.mapInArrow(run, "vec_id long, code string, error long, of string, codebooks_sha256 string"), "codes")
    total = F.sum(F.col("error").cast("decimal(19,0)")).cast("decimal(38,0)")
    by_label = coded.groupBy("of").agg(F.least(total, F.lit(MOST_LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    labelled = spread_join(coded, stored(by_label, "label-errors"), ["of"])
    label = F.when(F.col("of") != "null", F.substring("of", 2, 1 << 30)).cast(dict(vectors.dtypes)["label"])
    return labelled.select("vec_id", "code", "error", label.alias("label"), "label_error", "codebooks_sha256")
