"""Line deduplication within one edit by a deletion-neighbourhood join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Apart, let, stored, text_or_empty


def occurrences(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, line`` of the ``\\n``-split lines that hold a word; numbers start at 0."""
    lines = docs.select("doc_id", F.posexplode(F.split(text_or_empty(), "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _halves(line: Column, least_chars: int) -> Column:
    """Hashes of the first and last half, for this length and for one more: lines one edit apart share one."""

    def keys(n: Column) -> Column:
        p = F.floor((n - 1) / 2).cast("int")
        return F.array(F.xxhash64(F.lit("first"), p, F.substring(line, F.lit(1), p)), F.xxhash64(F.lit("last"), p, F.right(line, p)))

    n = F.length(line)
    return F.when(n >= least_chars, F.array_distinct(F.concat(keys(n), keys(n + 1)))).otherwise(F.array().cast("array<long>"))


def _blocks(lines: DataFrame) -> DataFrame:
    """Block deletions: ``id, len, block, sides, middle, full`` for ``id, line``.

    A line of n characters is laid out for n (``full``) and, as if one character were missing, for n + 1. Blocks
    have about the square root of that length, so all work on a line of n characters is of order n ** 1.5.
    """
    laid = lines.select("id", "line", F.length("line").alias("n")).select("*", F.explode(F.array(F.col("n"), F.col("n") + 1)).alias("len"))
    laid = laid.withColumn("step", F.greatest(F.lit(16), F.ceil(F.sqrt("len")).cast("int")))
    laid = laid.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("len") - 1) / F.col("step")).cast("int"))))
    begin = F.col("block") * F.col("step")
    after = F.col("len") - F.least(F.col("len"), begin + F.col("step"))
    return laid.select(
        "id", "len", "block", F.xxhash64(F.substring("line", F.lit(1), begin), F.right("line", after)).alias("sides"),
        F.substring("line", begin + 1, F.col("n") - begin - after).alias("middle"), (F.col("len") == F.col("n")).alias("full"),
    )


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys more than one ``id`` has."""
    many = rows.groupBy(*keys).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select(*keys)
    return rows.join(many, keys, "left_semi")


def near_lines(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """``id`` of the lines that have an earlier one within one edit; ``distinct`` has ``id, halves``.

    Lines that share no half with another line are ruled out first, then those that share no block deletion. The
    others emit every variant with one character deleted. Two lines with the same variant at the same place differ
    by a substitution, so the earliest stands for all; a line that equals another's variant differs by an insertion.
    The edit distance of each line to its earliest partner is verified on the texts.
    """
    half = distinct.select("id", F.explode("halves").alias("half"))
    left = stored(_shared(half, ["half"]).select("id").distinct(), "halves")
    some = docs.join(left.select(F.col("id.doc_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    lines = occurrences(some).select(F.struct("doc_id", "line_no").alias("id"), "line").join(left, "id").dropDuplicates(["id"])
    lines = stored(lines, "lines")
    place = ["len", "block", "sides"]
    rows = stored(_shared(_blocks(lines), place), "deletions")
    full, short = rows.where("full"), rows.where("NOT full")
    cut = lambda m, i: F.concat(F.substring(m, F.lit(1), i), F.substring(m, i + 2, F.length(m)))
    spots = F.when(F.length("middle") > 0, F.sequence(F.lit(0), F.length("middle") - 1)).otherwise(F.array().cast("array<int>"))
    variants = full.select("id", *place, "middle", F.explode(spots).alias("at"))
    variants = variants.select("id", *place, "at", F.xxhash64(cut(F.col("middle"), F.col("at"))).alias("rest"))
    variants = stored(variants, "variants")

    same = [*place, "at", "rest"]
    first = variants.groupBy(*same).agg(F.min("id").alias("early"), F.max("id").alias("late")).where("early <> late").select(*same, "early")
    swapped = variants.join(first, same).where("early < id").select("id", "early")
    same = [*place, "rest"]
    short = short.select("id", *place, F.xxhash64("middle").alias("rest"))
    of_short = short.groupBy(*same).agg(F.min("id").alias("early"))
    of_full = variants.groupBy(*same).agg(F.min("id").alias("early"))
    longer = variants.join(of_short, same).where("early < id").select("id", "early")
    shorter = short.join(of_full, same).where("early < id").select("id", "early")
    pairs = swapped.unionByName(longer).unionByName(shorter).groupBy("id").agg(F.min("early").alias("early"))
    text = lines.select(F.col("id").alias("early"), F.col("line").alias("before"))
    checked = pairs.join(lines, "id").join(text, "early").where(F.levenshtein("line", "before", 1) >= 0)
    return checked.select("id")


def dropped_lines(docs: DataFrame, least_chars: int = 0) -> DataFrame:
    """``doc_id, exact (array<int>), near (array<int>)``: numbers of the lines of ``doc_id, text`` that go.

    A line goes if an equal one, or one within one edit, comes earlier by
    (doc_id, line number), whether or not that one stays. Lines without a word stay. Rows of a repeated doc_id
    share their line numbers. A null doc_id is left out. A caller may ask for ``least_chars`` characters, under which lines
    are compared for equality only.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    found = occurrences(docs).select(
        F.struct("doc_id", "line_no").alias("id"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), F.col("line")).alias("g"), let(F.col("line"), lambda line: _halves(line, least_chars)).alias("halves")
    )
    # one row for each distinct line; halves are equal within it
    distinct = stored(found.groupBy("h", "g").agg(F.min("id").alias("first"), F.first("halves").alias("halves")), "distinct")
    near = near_lines(distinct.select(F.col("first").alias("id"), "halves"), docs).withColumn("near", F.lit(True))
    marked = distinct.select("h", "g", F.col("first").alias("id")).join(near, "id", "left").select("h", "g", F.col("id").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = found.select("id", "h", "g").join(marked, ["h", "g"]).where((F.col("id") != F.col("first")) | F.col("near"))
    gone = gone.groupBy("id").agg(F.max(F.col("id") != F.col("first")).alias("exact"))
    pick = lambda c: F.collect_list(F.when(c, F.col("id.line_no")))  # noqa: E731  no more than the document's lines
    return gone.groupBy(F.col("id.doc_id").alias("doc_id")).agg(pick(F.col("exact")).alias("exact"), pick(~F.col("exact")).alias("near"))


def without_lines(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``, and ``n_chars``, if there, brought up to date; other columns stay, whatever their names."""
    apart = Apart(docs)
    gone = dropped.select(F.col("doc_id").alias("__id"), F.concat("exact", "near").alias("__gone"))
    joined = apart.docs.join(gone, F.col("doc_id") == F.col("__id"), "left")

    def rest(lines: Column) -> Column:
        at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
        return F.array_join(F.transform(at, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), rest))
    return apart.restored(joined.withColumn("text", text), **({"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}))
