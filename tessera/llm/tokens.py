"""Token counts by a separator scan of flat, unindexed token files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import encode_words, tokenizer, words_of
from tessera.llm.common import stored

#: Tokens in a block of the scan, and in a file that the writer makes.
BLOCK = 1 << 20
FILE_TOKENS = 1 << 24


def width(path: str, end: int) -> str:
    """The type of a token in files: 16 bits if every id of the vocabulary and ``end`` fit, else 32."""
    return "<u2" if max(tokenizer(path, True).get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 and end < 1 << 16 else "<u4"


def write(docs: DataFrame, folder: str, path: str, end: int) -> tuple[DataFrame, DataFrame]:
    """Write the texts' ids, each text followed by ``end``, as flat little-endian files of numbers of :func:`width`.

    Returns the files ``file, tokens`` and the order of documents ``file, at, doc_id``. Strings of special tokens in a text are
    ordinary text, so ``end`` occurs at ends only. Null texts are empty; a null doc_id is left out. A task keeps the ids
    of words that it has met. Files are moved into place when complete.
    """

    kind = width(path, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        task, attempt, seq = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        met: dict[bytes, bytes] = {}
        stop = np.array([end], kind).tobytes()
        ids: list[int] = []
        parts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, ids, parts, size
            name = f"tokens-{task:06d}-{seq:05d}.bin"
            tmp = f"{base}/_tmp/{name}.{attempt}"
            with store.open_output_stream(tmp, compression=None) as out:
                for part in parts:
                    out.write(part)
            store.move(tmp, f"{base}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size // len(stop)], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], ["file", "tokens", "ids"])
            seq, ids, parts, size = seq + 1, [], [], 0
            return row

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                new = [w for w in set(words) if w not in met]
                met.update((w, np.frombuffer(b, np.uint32).astype(kind).tobytes()) for w, b in zip(new, encode_words(new, path, True), strict=True))
                parts.append(b"".join([*map(met.__getitem__, words), stop]))
                ids.append(doc)
                size += len(parts[-1])
                if len(met) > 400_000:
                    met.clear()
                if size >= len(stop) * FILE_TOKENS:
                    yield flush()
        if ids:
            yield flush()

    store, base = pyarrow.fs.FileSystem.from_uri(folder)
    store.create_dir(f"{base}/_tmp")
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    made = stored(rows.mapInArrow(run, "file string, tokens long, ids array<long>"), "token-files")
    return made.select("file", "tokens"), made.select("file", F.posexplode("ids").alias("at", "doc_id"))


def scan(files: DataFrame, folder: str, end: int, block: int = BLOCK, kind: str = "<u2") -> DataFrame:
    """``ordinal, file, at, n_tokens`` of every document in the files ``file, tokens``, read as one stream by file name.

    Blocks are searched on their own. Documents before a block and the place where the last one before it ended come
    from a prefix scan: running sums and maxima inside ranges of blocks, then over the ranges. ``n_tokens`` leaves the
    separator out; ``kind`` is the type of a token; ``at`` counts the ends in the document's file. Tokens after the last separator are a document.
    """
    spark = files.sparkSession
    size = np.dtype(kind).itemsize
    cuts = files.select("file", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("tokens") - 1, F.lit(0)), F.lit(block))).alias("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            ends, sizes = [], []
            for file, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{file}") as source:
                    tokens = np.frombuffer(source.read_at(size * block, size * begin), kind)
                ends.append(np.flatnonzero(tokens == end))
                sizes.append(len(tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["file", "begin", "size", "ends"])

    n = max(1, spark.sparkContext.defaultParallelism)
    found = cuts.select("file", "begin").repartition(4 * n).mapInArrow(run, "file string, begin long, size long, ends array<long>")
    parted = stored(found.repartitionByRange(n, "file", "begin").withColumn("part", F.spark_partition_id()), "blocks")
    upto = Window.partitionBy("part").orderBy("file", "begin").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    # in a range: tokens and ends before each block, and the last end before it, relative to the range's begin
    inside = parted.withColumn("t0", zero(F.sum("size").over(upto))).withColumn("d0", zero(F.sum(F.size("ends").cast("long")).over(upto)))
    inside = inside.withColumn("last", F.when(F.size("ends") > 0, F.col("t0") + F.element_at("ends", -1)))
    inside = inside.withColumn("before", F.max("last").over(upto))
    totals = inside.groupBy("part").agg(F.sum("size").alias("t"), F.sum(F.size("ends").cast("long")).alias("d"), F.max("last").alias("last"))
    t, d, last, rows = 0, 0, -1, []
    for r in sorted(totals.collect(), key=lambda r: r["part"]):  # a row for each range
        rows.append((r["part"], t, d, last))
        last = t + r["last"] if r["last"] is not None else last
        t, d = t + r["t"], d + r["d"]
    carry = F.broadcast(spark.createDataFrame(rows, "part int, ct long, cd long, cl long"))
    whole = inside.join(carry, "part").select("file", "begin", (F.col("ct") + F.col("t0")).alias("t"), (F.col("cd") + F.col("d0")).alias("d"), F.coalesce(F.col("ct") + F.col("before"), "cl").alias("prev"), "ends")
    each = whole.select("*", F.posexplode("ends").alias("k", "e")).select(
        (F.col("d") + F.col("k")).alias("ordinal"), "file",
        (F.col("t") + F.col("e") - F.when(F.col("k") == 0, F.col("prev")).otherwise(F.col("t") + F.get("ends", F.col("k") - 1)) - 1).alias("n_tokens"),
        F.col("d").alias("d"), "k",
    )
    start = whole.groupBy("file").agg(F.min("d").alias("file_first"))
    out = each.join(start, "file").select("ordinal", "file", (F.col("ordinal") - F.col("file_first")).alias("at"), "n_tokens")
    if t - last > 1:  # the stream's last document has no separator
        tail = files.agg(F.max("file").alias("file")).select(F.lit(d).cast("long").alias("ordinal"), "file", F.lit(None).cast("long").alias("at"), F.lit(t - last - 1).cast("long").alias("n_tokens"))
        out = out.unionByName(tail)
    return out


def counts(docs: DataFrame, spark: SparkSession, folder: str, path: str, end: int) -> DataFrame:
    """``doc_id, ordinal, n_tokens`` of ``doc_id, text``: written as token files, then counted by the scan."""
    files, order = write(docs, folder, path, end)
    return scan(files, folder, end, kind=width(path, end)).join(order, ["file", "at"]).select("doc_id", "ordinal", "n_tokens")
