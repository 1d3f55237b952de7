"""MinHash near-duplicates with tensored banding: table keys pair entries of two small collections of hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.graph import components

SHINGLE = 5
#: Entries of either collection, and minhashes in an entry: 2 x 16 x 2 minhashes make 16 x 16 tables of 4 minhashes.
#: A pair of similarity 0.75 shares no table with probability 1 - (1 - (1 - 0.75**2)**16)**2 = 4e-6.
ENTRIES = 16
ROWS = 2
#: A link: 100 * intersection >= PER_CENT * union.
PER_CENT = 75
#: Second tables, for members of first tables that hold several components: BANDS of BAND_ROWS minhashes (a pair of
#: similarity 0.75 shares none with probability (1 - 0.75**8)**92 = 5e-5), and two bits of each of SKETCHED minhashes,
#: of which such a pair shares fewer than LEAST_SKETCHED with probability 1e-5 (binomial with 0.8125 each).
BANDS = 92
BAND_ROWS = 8
SKETCHED = 704
#: Parts that all pairs are dealt into at least where one document has many of them.
PARTS = 1000
LEAST_SKETCHED = 526

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and where each text's words begin (one more entry at the end).

    Vectorised over the bytes of all texts: a word's hash is a difference of two prefix sums of a polynomial.
    """
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    space = _IS_SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    byte = (_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte * _powers(_BASE, len(byte)), dtype=np.uint64)])
    hashes = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(byte))[starts]
    first = np.searchsorted(starts, np.concatenate([[0], ends_of_texts]))
    return _mix(hashes + (ends - starts).astype(np.uint64)), first


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's five-word shingles; a shorter text is one shingle; none without words."""
    hashes, first = word_hashes(texts)
    n = max(0, len(hashes) - SHINGLE + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        rolled = _mix(rolled * np.uint64(31) + hashes[k : k + n])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for h in hashes[a:b]:
                whole = _mix(np.array([whole * np.uint64(31) + h], np.uint64))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _slices(texts: list[bytes], most: int = 1 << 20) -> Iterator[slice]:
    """Runs of texts of about 1 MB, so that working arrays stay small; a longer text is a run of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    n = 2 * ENTRIES * ROWS
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minhashes(s: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """For each scale and shift the least ``s * scale + shift`` of a set of mixed hashes; working arrays take 256 KB."""
    step = max(1, (1 << 15) // len(scale))
    least = np.full(len(scale), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), step):
        hashed = np.multiply.outer(s[i : i + step], scale)
        hashed += shift
        np.minimum(least, hashed.min(axis=0), out=least)
    return least


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n, same (binary), entries, sketch (array<long>)`` of ``doc_id, text``: set size, a 128-bit digest of
    the shingle set, and the 2 * ENTRIES hashed entries of both collections (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, shift = _seeds()
        with np.errstate(over="ignore"):
            for batch in batches:
                texts = batch.column(1).to_pylist()
                sizes, same, entries = [], [], []
                for part in _slices(texts):
                    for s in shingle_sets(texts[part]):
                        sizes.append(len(s))
                        same.append(_digest(s))
                        if len(s):
                            pairs = minhashes(s, scale, shift).reshape(2 * ENTRIES, ROWS)
                            key = _mix(_mix(pairs[:, 0] + np.arange(2 * ENTRIES, dtype=np.uint64)) + pairs[:, 1])
                            entries.append(key.view(np.int64))
                        else:
                            entries.append(np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.array(entries, pa.list_(pa.int64()))],
                    ["doc_id", "n", "same", "entries"],
                )

    return _texts(docs).mapInArrow(run, "doc_id long, n long, same binary, entries array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def _digest(s: np.ndarray) -> bytes:
    """128 bits of a set of shingle hashes, whatever their order."""
    return np.array([np.sum(_mix(s + c), dtype=np.uint64) for c in (np.uint64(1), np.uint64(2))], np.uint64).tobytes()


def sets_of(docs: DataFrame) -> DataFrame:
    """``doc_id, same, shingles (binary)``: the sorted set as little-endian unsigned 64-bit numbers, and its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                texts = batch.column(1).to_pylist()
                sets = [s for part in _slices(texts) for s in shingle_sets(texts[part])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "same", "shingles"])

    return _texts(docs).mapInArrow(run, "doc_id long, same binary, shingles binary")


def intersections(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, common`` for the stored table ``a, b``: the exact size of the intersection of the full sets.

    The pairs of one ``a`` go to as many parts as their share of all pairs asks for (PARTS of all pairs), so a document
    that a third of all others is compared with fills no task. Its set is sent once to each part, and the sets of its partners follow.
    """
    pairs = pairs.select("a", "b")
    counts = stored(pairs.groupBy("a").agg(F.count("*").alias("n")), "partners")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("n") * PARTS > total).select("a", F.ceil(F.col("n") * PARTS / F.lit(max(1, total))).cast("int").alias("parts")))  # PARTS rows at most
    part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = pairs.join(hot, "a", "left").select("a", "b", part.alias("part"))
    of_b = dealt.join(sets.select(F.col("doc_id").alias("b"), "shingles"), "b").select("a", "part", "b", "shingles")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    of_a = counts.select("a").join(hot, "a", "left").join(sets.select(F.col("doc_id").alias("a"), "shingles"), "a")
    of_a = of_a.select("a", parts, F.lit(None).cast("long").alias("b"), "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)  # the set of the a that is open
        for batch in batches:
            rows = []
            for a, b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                one = np.frombuffer(data.as_buffer(), np.uint64)
                if b is None:
                    head = one.copy()
                else:
                    rows.append((a, b, len(np.intersect1d(head, one, assume_unique=True))))
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "common"])

    met = of_a.unionByName(of_b).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return met.select("a", "b", "shingles").mapInArrow(run, "a long, b long, common long")


def second_signatures(sets: DataFrame) -> DataFrame:
    """``doc, keys (array<long>), sketch (array<long>)`` of ``doc_id, shingles``: band keys, and the sketched minhashes' two bits side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20240301)
        n = BANDS * BAND_ROWS
        scale, shift = rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)
        place = np.arange(32, dtype=np.uint64) * np.uint64(2)
        with np.errstate(over="ignore"):
            for batch in batches:
                keys, sketch = [], []
                for data in batch.column(1).to_pylist():
                    least = minhashes(np.frombuffer(data, np.uint64), scale, shift)
                    key = np.arange(BANDS, dtype=np.uint64)
                    for part in least.reshape(BANDS, BAND_ROWS).T:
                        key = _mix(key * np.uint64(31) + part)
                    mixed = _mix(least[:SKETCHED])
                    bits = (mixed & np.uint64(3)).reshape(-1, 32) << place
                    keys.append(key.view(np.int64))
                    sketch.append(np.bitwise_or.reduce(bits, axis=1).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], ["doc", "keys", "sketch"]
                )

    return sets.mapInArrow(run, "doc long, keys array<long>, sketch array<long>")


def _shared() -> Column:
    """Sketched minhashes whose two bits are equal in ``sa`` and ``sb``. A loop over words: unrolled, its code is too large for the compiler."""

    def differ(p: Column, q: Column) -> Column:
        x = p.bitwiseXOR(q)
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    return F.lit(SKETCHED) - F.aggregate(F.zip_with("sa", "sb", differ), F.lit(0), lambda n, d: n + d)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for ``doc_id, text``: components of links on five-word shingles.

    ASCII letters are lower-cased; words end at ASCII white space. A text with fewer words than five is one shingle;
    null, empty and blank texts have none and are linked with nothing. Documents with equal sets are one class.
    Representatives of classes meet in tables; in each table

    1. every member is compared with the table's most central member (it meets the most others), first the one that most tables name, then the rest
       whose component still differs,
    2. members of tables that still hold several components meet again in more selective tables and are compared
       across components, unless sizes, the triangle inequality of Jaccard distance or many more minhashes rule a
       link out.

    Pairs within a component never need comparing, so a large group of copies costs a few comparisons for each of
    its members. Rows of a repeated doc_id count as one document, that with the fewest shingles, of these
    that with the smallest digest of its set, whatever the order of rows; a null doc_id is left out.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    signed = stored(signatures(docs), "signatures")
    signed = signed.groupBy("doc_id").agg(F.min(F.struct("n", "same", "entries")).alias("s")).select("doc_id", "s.*")
    signed = stored(signed, "signed")
    classes = signed.where("n > 0").groupBy("same", "n").agg(F.min(F.struct("doc_id", "entries")).alias("r"))
    classes = stored(classes.select("same", "n", F.col("r.doc_id").alias("rep"), F.col("r.entries").alias("entries")), "classes")

    # entries that no other class has can't be part of a shared table
    each = classes.select(F.col("rep").alias("doc"), F.posexplode("entries").alias("e", "key"))
    shared = each.groupBy("e", "key").agg(F.count("*").alias("k")).where("k > 1").select("e", "key")
    each = each.join(shared, ["e", "key"], "left_semi")
    own = each.groupBy("doc").agg(F.collect_list(F.struct("e", "key")).alias("es"))  # at most 2 * ENTRIES
    own = stored(own, "entries")
    first = F.filter("es", lambda s: s["e"] < ENTRIES)
    second = F.filter("es", lambda s: s["e"] >= ENTRIES)
    tables = own.select("doc", F.explode(first).alias("x"), second.alias("ys")).select("doc", "x", F.explode("ys").alias("y"))
    tables = tables.select("doc", F.xxhash64("x.e", "x.key", "y.e", "y.key").alias("table"))
    tables = stored(tables.join(tables.groupBy("table").agg(F.count("*").alias("k")).where("k > 1"), "table"), "tables")
    # the original of a group of copies meets its copies more often than they meet each other: it heads their tables
    score = tables.groupBy("doc").agg(F.sum("k").alias("score"))
    tables = tables.select("doc", "table").join(score, "doc")
    heads = tables.groupBy("table").agg(F.max(F.struct("score", (-F.col("doc")).alias("m"))).alias("h")).select("table", (-F.col("h.m")).alias("head"))
    tables = stored(tables.select("doc", "table").join(heads, "table"), "headed")

    sizes = classes.select(F.col("rep").alias("doc"), "n")
    busy = stored(tables.select("doc").distinct(), "busy")
    sets = sets_of(docs.join(busy.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi"))
    chosen = signed.select("doc_id", "same")  # of a repeated doc_id the row that its signature is from
    sets = stored(sets.join(chosen, ["doc_id", "same"], "left_semi").dropDuplicates(["doc_id"]), "sets")

    def sized(pairs: DataFrame) -> DataFrame:
        """With the sizes ``na, nb``, without pairs whose sizes rule a link out."""
        out = pairs.join(sizes.withColumnsRenamed({"doc": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"doc": "b", "n": "nb"}), "b")
        return out.where(100 * F.least("na", "nb") >= PER_CENT * F.greatest("na", "nb"))

    def measured(pairs: DataFrame, name: str) -> DataFrame:
        pairs = stored(pairs, f"{name}-pairs")  # read three times
        common = intersections(pairs.select("a", "b"), sets).join(pairs.select("a", "b", "na", "nb"), ["a", "b"])
        union = F.col("na") + F.col("nb") - F.col("common")
        return stored(common.select("a", "b", (1 - F.col("common") / union).alias("far"), (100 * F.col("common") >= PER_CENT * union).alias("link")), name)

    def labelled(edges: DataFrame) -> DataFrame:
        found = components(edges.where("link").select("a", "b"))
        return stored(busy.join(found, busy["doc"] == found["node"], "left").select("doc", F.coalesce("component", "doc").alias("c")), "components")

    votes = tables.where("doc <> head").groupBy("doc", "head").agg(F.count("*").alias("k"))
    votes = stored(votes.select(F.col("head").alias("a"), F.col("doc").alias("b"), "k"), "votes")
    best = votes.groupBy("b").agg(F.max(F.struct("k", (-F.col("a")).alias("m"))).alias("s")).select((-F.col("s.m")).alias("a"), "b")
    best = stored(best, "best")
    edges = measured(sized(best), "links1")
    label = labelled(edges)

    def apart(pairs: DataFrame) -> DataFrame:
        la, lb = label.withColumnsRenamed({"doc": "a", "c": "ca"}), label.withColumnsRenamed({"doc": "b", "c": "cb"})
        return pairs.join(la, "a").join(lb, "b").where("ca <> cb")

    rest = apart(votes.select("a", "b").join(best, ["a", "b"], "left_anti")).select("a", "b")
    edges = stored(edges.unionByName(measured(sized(rest), "links2")), "links")
    label = labelled(edges)

    # tables that still hold several components
    there = tables.join(label, "doc")
    mixed = there.groupBy("table").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("table")
    rest = stored(there.join(mixed, "table", "left_semi").select("doc", "c").distinct(), "rest")
    pivot = best.select(F.col("a").alias("pivot"), F.col("b").alias("doc")).join(edges.select(F.col("a").alias("pivot"), F.col("b").alias("doc"), "far"), ["pivot", "doc"])
    again = second_signatures(sets.join(rest, sets["doc_id"] == rest["doc"], "left_semi"))
    again = stored(again.join(rest, "doc").join(sizes, "doc").join(pivot, "doc", "left"), "second")
    keys = again.select("doc", "c", F.explode("keys").alias("key"))
    several = keys.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    met = keys.join(several, "key", "left_semi").groupBy("doc").agg(F.collect_list("key").alias("met"))  # at most BANDS
    keyed = stored(met.join(again.drop("keys"), "doc"), "met").select("*", F.explode("met").alias("key"))  # both sides of the join read it
    x = keyed.select("key", F.col("doc").alias("a"), F.col("c").alias("ca"), F.col("pivot").alias("pa"), F.col("far").alias("fa"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("met").alias("ka"))
    y = keyed.select("key", F.col("doc").alias("b"), F.col("c").alias("cb"), F.col("pivot").alias("pb"), F.col("far").alias("fb"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("met").alias("kb"))
    bound = 1 - PER_CENT / 100 + 1e-9
    may = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & ~F.coalesce((F.col("pa") == F.col("pb")) & (F.abs(F.col("fa") - F.col("fb")) > bound), F.lit(False))
    may = may & (100 * F.least("na", "nb") >= PER_CENT * F.greatest("na", "nb"))
    may = may & (_shared() >= LEAST_SKETCHED) & (F.array_min(F.array_intersect("ka", "kb")) == F.col("key"))  # a pair comes from one of its keys
    across = x.join(y, "key").where(may).select("a", "b", "na", "nb").join(edges, ["a", "b"], "left_anti")
    edges = edges.unionByName(measured(across, "links3"))
    label = labelled(edges)

    of_class = classes.join(label, classes["rep"] == label["doc"], "left").select("same", "n", F.coalesce("c", "rep").alias("c"))
    rows = signed.join(of_class.withColumnRenamed("n", "size"), (signed["same"] == of_class["same"]) & (signed["n"] == F.col("size")), "left")
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id") == F.col("component_id"))
