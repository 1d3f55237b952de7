"""Merkle manifest of documents: leaf places from bitmap ranks, levels reduced in keyed slot arrays."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import spread_join, stored

#: Ids that share a word of a bitmap, and words that share a superblock of its popcount directory, as powers of two.
WORD_BITS, BLOCK_BITS = 6, 9
#: Levels that one slot array reduces: 2 ** LEVELS nodes meet in a task.
LEVELS = 11
#: Where the ids that are null lie: before the words of all others.
NO_ID = -(1 << 62)


def leaf(n_chars: Column | None = None) -> Column:
    """Digest of a document's doc_id, source, lang, n_chars and text: each ``-`` if null, else UTF-8 bytes, ``:`` and the value."""
    said = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    count = F.col("n_chars") if n_chars is None else n_chars
    return F.sha2(F.concat(said(F.col("doc_id")), said(F.col("source")), said(F.col("lang")), said(count), said(F.col("text"))), 256)


def running(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over all rows before in the order of columns; ``order`` is unique.

    Rows are range-partitioned and stored; one number of each partition reaches the driver, and no task has more than its range.
    """
    spark = rows.sparkSession
    many = max(1, spark.sparkContext.defaultParallelism)
    parted = stored(rows.repartitionByRange(many, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = {r["__part"]: r["s"] for r in parted.groupBy("__part").agg(F.sum(value).alias("s")).collect()}
    before, total = [F.lit(-1), F.lit(0).cast("long")], 0  # two entries for each partition
    for part in sorted(sums):
        before += [F.lit(part), F.lit(total).cast("long")]
        total += sums[part]
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.element_at(F.create_map(*before), F.col("__part"))
    return parted.withColumn(name, (start + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long")).drop("__part")


def bitmaps(rows: DataFrame) -> DataFrame:
    """``grp, word, bits, n, block``: the bitmap of ids that each group has, as its words that are not empty, and the rows of a word.

    Tasks merge their bits by a logical or before the exchange.
    """
    bit = F.when(F.col("doc_id").isNotNull(), F.expr(f"shiftleft(1L, cast(doc_id & {(1 << WORD_BITS) - 1} as int))")).otherwise(F.lit(0).cast("long"))
    words = rows.groupBy("grp", "word").agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n"))
    return words.withColumn("block", F.shiftright("word", BLOCK_BITS))


def directory(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``grp, word, bits, n, before`` (rows of the group in earlier words) and ``grp, first, size`` of each group.

    Superblocks get their running counts over all groups, words those within a superblock, as in a rank directory.
    """
    blocks = stored(running(words.groupBy("grp", "block").agg(F.sum("n").alias("rows")), ["grp", "block"], "rows", "at"), "superblocks")
    groups = stored(blocks.groupBy("grp").agg(F.min("at").alias("first"), F.sum("rows").cast("long").alias("size")), "groups")
    inside = Window.partitionBy("grp", "block").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    ranked = words.withColumn("in_block", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    placed = ranked.join(blocks.drop("rows"), ["grp", "block"])
    placed = spread_join(placed, groups.select("grp", "first"), ["grp"])
    return placed.select("grp", "word", "bits", "n", (F.col("at") + F.col("in_block") - F.col("first")).cast("long").alias("before")), groups


def coordinates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds ``pos``, the place of each of ``grp, doc_id, leaf, part`` in its group from 0, and ``size``; also gives ``grp, first, size``.

    An id's place is the count of its word's directory entry and the set bits below its own: nothing is sorted. Null ids come first.
    Only words with repeated or null ids number their rows by id, leaf and the part that wrote them, from counts of these.
    """
    rows = rows.withColumn("word", F.coalesce(F.shiftright("doc_id", WORD_BITS), F.lit(NO_ID)))
    words = stored(bitmaps(rows), "bitmaps")
    directed, groups = directory(words)
    directed = spread_join(stored(directed, "directory"), groups.select("grp", "size"), ["grp"])
    single = F.col("n") == F.bit_count("bits")
    # a word without repeated ids has as many rows as bits, so at most 64
    below = F.bit_count(F.expr(f"bits & ~shiftleft(-1L, cast(doc_id & {(1 << WORD_BITS) - 1} as int))"))
    unique = rows.join(directed.where(single), ["grp", "word"]).withColumn("pos", F.col("before") + below)
    copied = spread_join(rows, stored(directed.where(~single), "repeats"), ["grp", "word"])
    cell = ["grp", "word", "doc_id", "leaf", "part"]
    counts = stored(running(copied.groupBy(*cell, "before").agg(F.count("*").alias("c")), cell, "c", "over"), "cells")
    first = stored(counts.groupBy("grp", "word").agg(F.min("over").alias("under")), "firsts")
    starts = spread_join(counts, first, ["grp", "word"]).select(*cell, (F.col("before") + F.col("over") - F.col("under")).alias("start"))
    at = F.row_number().over(Window.partitionBy(*cell).orderBy(F.lit(0))) - 1
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in cell]
    more = copied.withColumn("at", at).alias("r").join(starts.alias("s"), same).select("r.*", "s.start")
    columns = [*[c for c in rows.columns if c != "word"], "size", "pos"]
    out = unique.select(*columns).unionByName(more.withColumn("pos", F.col("start") + F.col("at")).select(*columns))
    return out.withColumn("pos", F.col("pos").cast("long")), groups


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def slots(nodes: list[str], size: int, levels: int) -> list[list[str]]:
    """All levels of one slot array, from ``nodes`` up to ``levels`` of them; a level of one node ends it if the group has no other node."""
    out = [nodes]
    for _ in range(levels):
        if size <= 1:
            break
        last = out[-1]
        out.append([_h("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
        size = -(-size // 2)
    return out


def path(levels: list[list[str]], place: int) -> str:
    """What a node meets on its way up: for each level ``<`` or ``>`` and the sibling on that side, or ``.`` where it is alone."""
    out = []
    for level in levels[:-1]:
        other = place ^ 1
        out.append(("<" if other < place else ">") + level[other] if other < len(level) else ".")
        place >>= 1
    return "".join(out)


def fold(digest: str, way: str) -> tuple[str, str]:
    """The root that ``digest`` leads to along a path, and the digest of the path's siblings."""
    siblings, i = [], 0
    while i < len(way):
        side, other = way[i], way[i + 1 : i + 65]
        if side == ".":
            digest, i = _h(digest), i + 1
            continue
        digest, i = _h(other + digest if side == "<" else digest + other), i + 65
        siblings.append(other)
    return digest, _h("".join(siblings))


def _in_slots(rows: pd.DataFrame, levels: int) -> tuple[pd.DataFrame, list[list[str]]]:
    """Rows of one array put into its slots, and its levels."""
    slot = (rows["pos"] & ((1 << levels) - 1)).to_numpy()
    nodes = [""] * len(rows)
    for i, digest in zip(slot.tolist(), rows["digest"].tolist(), strict=True):
        nodes[i] = digest
    return rows.assign(slot=slot), slots(nodes, int(rows["size"].iloc[0]), levels)


ROW, WAY = "grp string, pos long, size long, digest string", "grp string, pos long, path string"


def climb(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Tables ``grp, pos, size, digest`` of every ``levels`` levels: ``nodes``, and so on to one row for each group, its root.

    A slot array has the nodes of one group and the same pos beyond ``levels`` bits, so no task gets more of them, whatever a group's size.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, made = _in_slots(rows, levels)
        size = -(-int(rows["size"].iloc[0]) // (1 << levels))
        return pd.DataFrame({"grp": [rows["grp"].iloc[0]], "pos": [int(rows["pos"].iloc[0]) >> levels], "size": [size], "digest": [made[-1][0]]})

    tiers = [nodes]
    most = nodes.agg(F.max("size")).first()[0] or 0
    while True:
        keyed = tiers[-1].select("grp", "pos", "size", "digest", F.shiftright("pos", levels).alias("array"))
        tiers.append(stored(keyed.repartition("grp", "array").groupBy("grp", "array").applyInPandas(run, ROW), "nodes"))
        most = -(-most // (1 << levels))
        if most <= 1:
            return tiers


def ways_down(tiers: list[DataFrame], ways: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``grp, pos, path`` of the arrays of the lowest tier, given those of the roots."""

    def run(key: tuple, rows: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"grp": [], "pos": [], "path": []})
        rows, made = _in_slots(rows, levels)
        rest = up["path"].iloc[0]
        return pd.DataFrame({"grp": rows["grp"], "pos": rows["pos"], "path": [path(made, i) + rest for i in rows["slot"].tolist()]})

    for tier in reversed(tiers[1:-1]):
        keyed = tier.withColumn("array", F.shiftright("pos", levels)).repartition("grp", "array").groupBy("grp", "array")
        ways = stored(keyed.cogroup(ways.repartition("grp", "pos").groupBy("grp", "pos")).applyInPandas(run, WAY), "paths")
    return ways


def _result(rows: pd.DataFrame, up: pd.DataFrame, levels: int) -> pd.DataFrame:
    rows, made = _in_slots(rows, levels)
    rest, root = up["path"].iloc[0], up["root"].iloc[0]
    folded, proof = [], []
    for slot, digest in zip(rows["slot"].tolist(), rows["shown"].tolist(), strict=True):
        a, b = fold(digest, path(made, slot) + rest)
        folded.append(a)
        proof.append(b)
    same = [f == root for f in folded]
    return pd.DataFrame({"id": rows["id"], "has_id": rows["has_id"], "leaf": rows["digest"], "subroot": up["subroot"].iloc[0], "root": root, "proof_sha256": proof, "folded_root": folded, "verified": same})


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, one row for each row of ``docs``.

    Each lang is a group of leaves in the order of doc_id, null ids first, rows of one id in the order of their leaves; null is a
    lang of its own and the first. The groups' roots in the bytewise order of lang are the leaves of the whole. Equal rows
    are as many leaves. The rows whose id's crc32 is divisible by 7 show a leaf with n_chars + 1 (a null count stays), which
    then doesn't lead to the root. No rows give no rows.
    """
    tampered = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    shown = F.when(tampered, leaf(F.col("n_chars").cast("decimal(38,0)") + 1))
    group = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), group.alias("grp"), leaf().alias("leaf"), shown.alias("shown"), F.spark_partition_id().alias("part"))
    leaves = stored(leaves, "leaves")
    placed, groups = coordinates(leaves)
    placed = stored(placed.withColumnRenamed("leaf", "digest"), "coordinates")
    tiers = climb(placed, levels)

    roots = tiers[-1].select("grp", F.col("digest").alias("subroot"))
    ranked = running(roots.withColumn("one", F.lit(1).cast("long")), ["grp"], "one", "pos")
    tops = stored(ranked.select(F.lit("").alias("of"), "grp", "pos", "subroot"), "subroots")
    upper = climb(tops.select(F.col("of").alias("grp"), "pos", F.lit(tops.count()).cast("long").alias("size"), F.col("subroot").alias("digest")), levels)
    start = upper[-1].select("grp", "pos", F.lit("").alias("path"))
    ways = ways_down([upper[0], *upper], start, levels)
    root = upper[-1].select(F.col("digest").alias("root"))  # one row
    known = tops.join(ways.select("pos", "path"), "pos").join(F.broadcast(root)).select("grp", "subroot", "root", "path")
    known = stored(known, "ways")
    down = ways_down(tiers, known.select("grp", F.lit(0).cast("long").alias("pos"), "path"), levels)
    told = spread_join(down.select("grp", F.col("pos").alias("array"), "path"), known.drop("path"), ["grp"])

    def run(key: tuple, rows: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        return _result(rows, up, levels) if len(rows) else pd.DataFrame({c: [] for c in ("id", "has_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")})

    mine = placed.select("grp", "pos", "size", "digest", F.coalesce("shown", "digest").alias("shown"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNotNull().alias("has_id"), F.shiftright("pos", levels).alias("array"))
    keyed = mine.repartition("grp", "array").groupBy("grp", "array").cogroup(told.repartition("grp", "array").groupBy("grp", "array"))
    found = keyed.applyInPandas(run, "id long, has_id boolean, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return found.select(F.when(F.col("has_id"), F.col("id")).alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
