"""What the corpus operators share: word patterns, stored intermediate tables, ordered numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.tables import new_path, shared_dir, stored  # noqa: F401

#: ASCII white space, and a word as a run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a table that is broadcast after they are counted, and parts of a hot key where a table has more.
MOST_BROADCAST = 100_000
SALTS = 64


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words, without building them: every word ends before white space or at the end."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner", most: int = MOST_BROADCAST) -> DataFrame:
    """``rows`` with the columns of ``groups``, which has one row for each of ``keys``; a hot key stays spread.

    ``groups`` is counted: up to ``most`` rows are broadcast, so no row of ``rows`` moves. A larger table is repeated
    for SALTS salts and rows meet it by the keys and a hash of themselves, so that a key goes to as many tasks.
    """
    if groups.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(groups), keys, how)
    salted = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(SALTS)).cast("int")
    return rows.withColumn("__salt", salt).join(salted, [*keys, "__salt"], how).drop("__salt")


class Apart:
    """``docs`` as columns that an operator names and one struct of all others, ``rest``, so that no name of a caller's meets one of the operator's own."""

    BASE = ("doc_id", "text", "lang", "source")

    def __init__(self, docs: DataFrame):
        self.columns = docs.columns
        self.others = [c for c in docs.columns if c.lower() not in self.BASE]
        cell = lambda c: F.col("`" + c.replace("`", "``") + "`")
        packed = F.struct(*[cell(c).alias(f"c{i}") for i, c in enumerate(self.others)]) if self.others else F.lit(0)
        self.docs = docs.select(*[cell(c).alias(c.lower()) for c in docs.columns if c.lower() in self.BASE], packed.alias("rest"))

    def restored(self, rows: DataFrame, **changed: Column) -> DataFrame:
        """``rows`` with the caller's columns under their names and in their order; ``changed`` are new values of some of them."""
        value = lambda c: F.col(c.lower()) if c.lower() in self.BASE else F.col(f"rest.c{self.others.index(c)}")
        return rows.select(*[changed.get(c, value(c)).alias(c) for c in self.columns])


def repeated_ids(docs: DataFrame) -> DataFrame:
    """``__many``: each doc_id that several rows of ``docs`` have."""
    many = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    return stored(many.select(F.col("doc_id").alias("__many")), "repeats")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, ... in the order of the columns, without bringing all rows to one task.

    Rows are range-partitioned, stored in that order, and numbered by the sizes of the partitions before theirs.
    """
    parted = (
        df.repartitionByRange(max(1, df.sparkSession.sparkContext.defaultParallelism), *order)
        .sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    parted = stored(parted, "numbered")
    sizes = {r["__part"]: r["n"] for r in parted.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0  # one entry for each partition
    for part in sorted(sizes):
        before += [F.lit(part), F.lit(total)]
        total += sizes[part]
    start = F.element_at(F.create_map(*before), F.col("__part")) if before else F.lit(0)
    return parted.withColumn(name, (start + F.col("__at")).cast("long")).drop("__part", "__at")
