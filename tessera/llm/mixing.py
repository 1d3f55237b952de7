"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Apart, numbered, repeated_ids, spread_join, stored, text_or_empty, word_count

#: Rows that one pivotal block holds on average, and blocks that meet in one node of the reduction tree.
BLOCK_ROWS = 4096
FAN_IN = 64
#: No document is taken more often than this, and no target exceeds this multiple of its source's size.
MOST_COPIES = 3


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = MOST_COPIES) -> DataFrame:
    """Adds ``source_key`` (the source's place from 0) and ``target`` to ``source, source_size``.

    Sources in code-point order, null last, get the weights in turn and share the sum of all sizes; a target stops
    at ``cap`` times its source's size and the excess goes to the others by weight until none is above. Only sums
    reach the driver, one round for each set of newly capped sources.
    """
    n = len(weights)
    ranked = numbered(sizes.withColumn("__null", F.col("source").isNull()), ["__null", "source"], "source_key").drop("__null")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_key") % n + 1).cast("int"))
    ranked = ranked.withColumn("__weight", weight)
    most = F.col("source_size") * float(cap)
    level = 0.0  # target by unit of weight
    while True:
        capped = F.col("__weight") * level > most
        total, fixed, open_weight = (
            ranked.agg(
                F.sum("source_size"),
                F.sum(F.when(capped, most).otherwise(0.0)),
                F.sum(F.when(capped, 0.0).otherwise(F.col("__weight"))),
            ).first()
        )
        new = (total - fixed) / open_weight if total and open_weight else level
        if new <= level:
            break
        level = new
    return ranked.withColumn("target", F.least(F.col("__weight") * level, most)).drop("__weight")


def _uniform(a: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each id, the same in every run (SplitMix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pivot(share: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Pivotal rounding of the shares in their order: each pair moves mass until one of the two is 0 or 1.

    What one of a pair loses in words (share times size) the other gains, so the words of all stay as they are, and
    either way of moving is as likely as leaves every expected share as it is. Entries without words pair by shares.
    The result is 0 or 1 everywhere but at two places at most (one with words, one without), whose shares are what is left over.
    """
    out = share.copy()
    eps = 1e-9
    held = {True: -1, False: -1}  # the one entry of either kind that is still fractional
    for i in range(len(out)):
        if not eps < out[i] < 1 - eps:
            out[i] = round(out[i])
            continue
        kind = bool(size[i] > 0)
        h = held[kind]
        if h < 0:
            held[kind] = i
            continue
        sh, si = (float(size[h]), float(size[i])) if kind else (1.0, 1.0)
        up = min((1 - out[h]) * sh, out[i] * si)  # words that h may gain, and lose
        down = min(out[h] * sh, (1 - out[i]) * si)
        gain = up if draws[i] * (up + down) < down else -down
        out[h], out[i] = out[h] + gain / sh, out[i] - gain / si
        left = [k for k in (h, i) if eps < out[k] < 1 - eps]
        for k in (h, i):
            if k not in left:
                out[k] = round(out[k])
        held[kind] = left[0] if left else -1
    return out


def pooled(share: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Pivotal rounding of entries with words, the largest first, each paired with all that follow it at once.

    The pair moves words until the entry is 0 or 1, or all that follow are: these give in proportion to their shares, or take in proportion
    to what they lack of 1. Words stay as they are, and where all shares begin equal so does every expected share. What is left
    over is one of the smallest entries, unless one outweighs what all after it can give and take.
    """
    out = share.copy()
    eps = 1e-9
    open_ = np.flatnonzero((share > eps) & (share < 1 - eps))
    out[share <= eps], out[share >= 1 - eps] = 0.0, 1.0
    s0, z = share[open_].astype(float), size[open_].astype(float)
    words, held = z[::-1].cumsum()[::-1], (z * s0)[::-1].cumsum()[::-1]
    a, b = 0.0, 1.0  # the share of an entry that is still open is a + b * s0
    for i, place in enumerate(open_.tolist()):
        s = min(1.0, max(0.0, a + b * s0[i]))
        total = words[i + 1] if i + 1 < len(z) else 0.0
        give = min(total, max(0.0, a * total + b * (held[i + 1] if i + 1 < len(z) else 0.0)))
        take = total - give
        up, down = min((1 - s) * z[i], give), min(s * z[i], take)
        if up + down <= eps:
            out[place] = s
            out[open_[i + 1 :]] = np.clip(a + b * s0[i + 1 :], 0, 1)
            break
        if draws[place] * (up + down) < down:
            s, a, b = s + up / z[i], a * (1 - up / give), b * (1 - up / give)
        else:
            s, a, b = s - down / z[i], down / take + a * (1 - down / take), b * (1 - down / take)
        out[place] = s if eps < s < 1 - eps else round(s)
    return np.where((out > eps) & (out < 1 - eps), out, np.round(out))


def _block(seed: int, first: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        share, size, draws = rows["share"].to_numpy(np.float64), rows["size"].to_numpy(np.int64), _uniform(rows["doc_id"].to_numpy(np.int64), seed)
        if first:  # all of a source begin with one share: large documents settle first, what is left over is small
            some = size > 0
            share[some] = pooled(share[some], size[some], draws[some])
        return rows.assign(share=pivot(share, size, draws))

    return run


def copies(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Integer copies for ``doc_id, source_key, size, ratio, n`` (rows of the source): floor(ratio) plus a rounded rest; adds ``copies``.

    Rows of a source fall into blocks by a hash of the id, about BLOCK_ROWS each however large the source is, are dealt out
    by source and block, and are rounded within, the largest paired with all smaller ones first; each block leaves two fractional rows at most, small ones. The left-over rows of
    FAN_IN blocks meet in the next level of the tree, and so on; the last ones of a source are rounded to the nearest.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_ROWS))
    whole = F.floor("ratio")
    rows = docs.select(
        "doc_id", "source_key", "size", whole.cast("long").alias("whole"), (F.col("ratio") - whole).alias("share"),
        F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), blocks).alias("block"),
    )
    schema = "doc_id long, source_key long, size long, whole long, share double, block long"
    most = docs.agg(F.max("n")).first()[0] or 0
    done, level, n = None, 0, max(1, -(-most // BLOCK_ROWS))
    while True:
        # dealt by both: Spark would take rows that a join left dealt by source_key alone as they are
        dealt = rows.repartition("source_key", "block")
        rounded = stored(dealt.groupBy("source_key", "block").applyInPandas(_block(seed + level, level == 0), schema), f"pivot{level}")
        fractional = (F.col("share") > 1e-9) & (F.col("share") < 1 - 1e-9)
        settled = rounded.where(~fractional)
        done = settled if done is None else done.unionByName(settled)
        rows = rounded.where(fractional).withColumn("block", F.floor(F.col("block") / FAN_IN))
        if n == 1:
            done = done.unionByName(rows)
            return done.select("doc_id", "source_key", "size", (F.col("whole") + F.round("share").cast("long")).alias("copies"))
        n, level = -(-n // FAN_IN), level + 1


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), seed: int = 7) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for ``doc_id, text, source``.

    A document's size is its number of words, null and empty texts have 0; a source takes ``target / source_size``
    copies of each document on average, each document either floor or ceil of that. Words are what the rounding keeps: a source's taken
    words miss its target by half of what is left over, a small document unless one outweighs all others of its block. Sources without words take
    nothing. A null source is one of its own. A repeated doc_id is so many documents. Reruns on the same rows agree.
    """
    sized = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "source", word_count(text_or_empty()).alias("size"))
    sized = stored(sized.withColumn("of", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))), "sizes")  # a key that is never null
    sources = sized.groupBy("source", "of").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = stored(source_targets(stored(sources, "sources"), weights), "targets")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST_COPIES)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    keyed = spread_join(sized.drop("source"), targets.select("of", "source_key", "n", ratio.alias("ratio")), ["of"])
    taken = copies(stored(keyed.drop("of"), "ratios"), seed)
    told = targets.select("source_key", "source", "source_size", "target")
    return spread_join(taken, told, ["source_key"]).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mixed`` says (rows with no copies go), columns unchanged, whatever their names.

    Rows of a repeated doc_id are numbered on both sides by source and size, which both have; within equal ones
    the rows of ``docs`` are in the order of their text, lang and other columns and the copies fall. Each row meets one row of the mix.
    """
    apart, many = Apart(docs), repeated_ids(docs)
    docs, same = apart.docs, F.col("doc_id") == F.col("__many")
    last = F.to_json("rest") if apart.others else F.lit(0)
    order = Window.partitionBy("doc_id").orderBy("source", "__size", *[c for c in ("text", "lang") if c in docs.columns], last)
    some = docs.join(many, same, "left_semi").withColumn("__size", word_count(text_or_empty())).withColumn("__at", F.row_number().over(order)).drop("__size")
    rows = docs.join(many, same, "left_anti").withColumn("__at", F.lit(1)).unionByName(some)
    falling = Window.partitionBy("doc_id").orderBy("source", "size", F.desc("copies"))
    times = mixed.select(F.col("doc_id").alias("__id"), F.row_number().over(falling).alias("__row"), F.col("copies").alias("__n")).where("__n > 0")
    met = rows.join(times, (F.col("doc_id") == F.col("__id")) & (F.col("__at") == F.col("__row")))
    return apart.restored(met.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n")))))
