"""BPE encoding and decoding through a table of distinct words.

Texts are split at ASCII white space (and before a comma or full stop that ends a word); a tokenizer whose
normaliser and pre-tokeniser never look across such places gives a text the ids of its words, one after another.
Each distinct word is therefore encoded once, and its ids are joined back by position:

* frequent words form a broadcast table of at most ``most_words`` rows, which no corpus can enlarge;
* every other word travels once for each block of documents that has it, is encoded where all blocks'
  mentions of it meet (once for each Arrow batch of them), and its ids travel back to the blocks. Nothing is dealt out by
  a key that can be hot. A block sends no more lists than it has such words, so what travels grows with the corpus.

Inside tasks, words and ids are Arrow arrays: no Python object is made for an occurrence of a word or for a token.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: Rows and bytes a word that the broadcast table may have: together its proven bound.
MOST_WORDS = 1 << 18
MOST_WORD_BYTES = 48
#: A word is a candidate for the table if one task's share of the corpus holds it so often.
LEAST_SEEN = 6
#: Bytes of text in a block of documents.
BLOCK_BYTES = 1 << 22
#: Bytes of text whose words are counted at once.
COUNTED_BYTES = 1 << 22
#: Bytes of the corpus' text for each bucket of the words that are in no table.
BUCKET_BYTES = 1 << 26
_GAP = np.uint32(0xFFFFFFFF)
_ENDS = re.compile(rb"[,.](?<=[A-Za-z].)(?![^\x20\x09-\x0D])")  # the rare character first, so that the search skips to it


#: The same for many texts at once. What a match takes of the white space is never the letter that the next one begins with.
_ENDS_RE2 = r"([A-Za-z])([,.])([\x20\x09-\x0D]|\z)"
#: Words that are encoded as one text, with a mark between each two.
TOGETHER = 64
_MARK = b"|"
#: Distinct words that a task counts before those that are rare so far go.
MOST_COUNTED = 1_000_000


def words_of(text: bytes) -> list[bytes]:
    return _ENDS.sub(rb" \g<0>", text).split()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """:func:`words_of` for an array of binary texts without nulls: the words of all, one after another as bytes in a string array, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.replace_substring_regex(texts.cast(pa.binary()), _ENDS_RE2, r"\1 \2\3").view(pa.string()))
    flat, ends = lists.flatten(), lists.offsets.to_numpy()
    full = pc.not_equal(pc.binary_length(flat), 0)  # white space at an end of a text gives an empty word
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), np.diff(upto[ends - ends[0]])


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows in runs whose last column, binary, has ``most`` bytes and less than a row more; the last run has what is left."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.columns[-1]).to_numpy(), dtype=np.int64)
        start, before = 0, 0
        while start < len(ends):
            stop = min(int(np.searchsorted(ends, before + most - size)) + 1, len(ends))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - before
            start, before = stop, int(ends[stop - 1])
            if size >= most:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


#: A text with blanks, stops and commas at every place that texts are split at, inside words and at their ends.
_PROBE = "Ab cd, ef. 1,000.50 x,y  don't\n\tthe end... (so), u.s. d\u00e9j\u00e0, \u4e2d\u6587. <a>."


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, specials_are_text: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    out.encode_special_tokens = specials_are_text
    if out.decoder is not None:
        raise ValueError(f"{path}: pieces must be joined by spaces, but this tokenizer has a decoder")
    ids = lambda text: out.encode(text, add_special_tokens=False).ids
    if ids(_PROBE) != [i for w in words_of(_PROBE.encode()) for i in ids(w.decode())]:
        raise ValueError(f"{path}: this tokenizer's ids of a text are not those of its words")
    return out


def encoded_words(words: list[bytes], path: str, specials_are_text: bool) -> np.ndarray:
    """The ids of the words, as unsigned 32-bit numbers, with a gap mark after each word's.

    Ids of a text are those of its words, so words are encoded many at a time with a word between them that has an id of its own.
    If that id comes more often, a word has it too, and each of these words is encoded alone.
    """
    made = tokenizer(path, specials_are_text)
    ids = lambda texts: [e.ids for e in made.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
    (mark,) = ids([_MARK])
    at_once = TOGETHER if len(mark) == 1 else 1
    groups = [words[i : i + at_once] for i in range(0, len(words), at_once)]
    out = []
    for i in range(0, len(groups), TOGETHER):
        some = groups[i : i + TOGETHER]
        for group, found in zip(some, ids([(b" " + _MARK + b" ").join(g) for g in some]), strict=True):
            found = np.array([*found, _GAP], np.uint32)
            if len(group) > 1:
                found[found == mark[0]] = _GAP
            if np.count_nonzero(found == _GAP) == len(group):
                out.append(found)
            else:
                out += [np.array([*x, _GAP], np.uint32) for x in ids(group)]
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def encode_words(words: list[bytes], path: str, specials_are_text: bool) -> list[bytes]:
    """The ids of each word, as the bytes of an array of unsigned 32-bit numbers."""
    numbers = encoded_words(words, path, specials_are_text)
    data, ends = numbers.tobytes(), (4 * np.flatnonzero(numbers == _GAP)).tolist()
    return [data[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends, strict=False)]


def _lists(numbers: np.ndarray) -> pa.ListArray:
    """The parts before each gap mark."""
    gaps = np.flatnonzero(numbers == _GAP)
    ends = np.concatenate([[0], gaps - np.arange(len(gaps))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.delete(numbers, gaps).view(np.int32)))


def frequent_words(docs: DataFrame, most_words: int = MOST_WORDS, least_seen: int = LEAST_SEEN) -> tuple[DataFrame, int]:
    """``word binary, n long``: at most ``most_words`` words, the most frequent by tasks' counts; and the bytes of all texts.

    Which words are in the table changes the cost of the encoding, never its result. The threshold is
    read off a histogram of the counts' logarithms, so there is no global sort.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.Table] = []
        size = 0

        def merged() -> pa.Table:
            return pa.concat_tables(seen).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def out(table: pa.Table) -> list[pa.RecordBatch]:
            return table.filter(pc.and_(pc.greater_equal(table["n"], least_seen), pc.less_equal(pc.binary_length(table["word"]), MOST_WORD_BYTES))).to_batches()

        for run in _runs(batches, COUNTED_BYTES):
            words, _ = split_words(run.columns[-1])
            found = words.value_counts()
            seen.append(pa.table({"word": found.field(0).view(pa.binary()), "n": found.field(1)}))
            size += pc.sum(pc.binary_length(run.columns[-1])).as_py()
            if sum(map(len, seen)) > 2 * MOST_COUNTED:
                seen = [merged()]
                if len(seen[0]) > MOST_COUNTED:  # bounded memory: rare words go, frequent ones come again
                    yield from out(seen[0])
                    seen = []
        if seen:
            yield from out(merged())
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([size], pa.int64())], ["word", "n"])

    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    counts = stored(texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    size = counts.where("word is null").agg(F.sum("n")).first()[0] or 0
    counts = counts.where("word is not null")
    steps = counts.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("step")).count().collect()  # 512 rows at most
    total, least = 0, None
    for step, rows in sorted(((r["step"], r["count"]) for r in steps), reverse=True):
        if total + rows > most_words:
            break
        total, least = total + rows, step
    return counts.where(F.lit(False) if least is None else F.floor(F.log2("n") * 8) >= least), size


def encoded_table(words: DataFrame, path: str, specials_are_text: bool) -> tuple[pa.Array, pa.Array]:
    """Words and ids of the bounded table of :func:`frequent_words`, encoded by tasks, each word once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(encoded_words(batch.column(0).to_pylist(), path, specials_are_text))], ["word", "ids"])

    words = words.sort(F.desc("n"), "word")  # bounded; indices by falling frequency pack well
    rows = words.select("word").mapInArrow(encode, "word binary, ids array<int>").toArrow()
    return rows.column(0).combine_chunks().cast(pa.binary()).view(pa.string()), rows.column(1).combine_chunks()


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as four byte planes: indices by falling frequency leave the upper planes near empty."""
    planes = np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def encode(docs: DataFrame, path: str, specials_are_text: bool = False, most_words: int = MOST_WORDS, least_seen: int = LEAST_SEEN) -> DataFrame:
    """``doc_id, ids array<int>`` for ``doc_id, text``: the ids of every text, as :func:`encode_blocks` makes them."""
    return _by_block(encode_blocks(docs, path, specials_are_text, most_words, least_seen), None, lambda doc_id, ids, _: [doc_id, ids], "doc_id long, ids array<int>")


class Blocks(NamedTuple):
    """Blocks of documents, ready to be read as ids, texts or digests.

    ``rows``: ``block, bucket, data, ids, lengths``; a block's own row has bucket -1, its documents and the indices of their words, every
    other row of it the ids of those of its words that a bucket has. ``hot``: the broadcast table's words and ids.
    """

    rows: DataFrame
    hot: Broadcast


def encode_blocks(docs: DataFrame, path: str, specials_are_text: bool = False, most_words: int = MOST_WORDS, least_seen: int = LEAST_SEEN) -> Blocks:
    """The ids of the texts of ``doc_id, text``, as blocks of documents for :func:`decode` and :func:`digests`.

    Null and empty texts have no ids. Repeated rows give as many rows. A null doc_id is left out.
    ``specials_are_text``: the strings of special tokens in a text are ordinary text.

    Documents are read once and become blocks of word indices: those of frequent words point into the broadcast
    table, those of other words into the block's own list of distinct words. The lists are dealt out by a hash of
    the word, each word is encoded where all its mentions meet, and the ids return to their block.
    """
    spark = docs.sparkSession
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    words, size = frequent_words(docs, most_words, least_seen)
    table = encoded_table(words, path, specials_are_text)
    hot = spark.sparkContext.broadcast(table)
    buckets = max(8, size // BUCKET_BYTES)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task = hot.value[0], TaskContext.get().partitionId()
        for n, run in enumerate(_runs(batches, BLOCK_BYTES)):
            flat, lengths = split_words(run.column(1))
            found = pc.index_in(flat, value_set=known)
            rare = flat.filter(found.is_null()).dictionary_encode()
            at = found.fill_null(-1).to_numpy()
            own = rare.dictionary.view(pa.binary())
            hashed = np.fromiter(map(zlib.crc32, own.to_pylist()), np.int64, len(own)) % buckets
            order = pc.sort_indices(own).to_numpy()
            order = order[np.argsort(hashed[order], kind="stable")]  # by bucket, then word
            place = np.empty(len(own), at.dtype)
            place[order] = np.arange(len(known), len(known) + len(own))
            at = at.copy()
            at[at < 0] = place[rare.indices.to_numpy()]
            used, first = np.unique(hashed[order], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array([*first, len(own)], pa.int32()), own.take(pa.array(order)))
            lists = [zstandard.compress(x, 3) for x in pc.binary_join(lists, b" ").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([task << 32 | n], pa.int64()), pa.array([run.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())),
                    pa.array([_packed(at)], pa.binary()), pa.array([used], pa.list_(pa.int32())), pa.array([lists], pa.list_(pa.binary())),
                ],
                ["block", "ids", "lengths", "words", "buckets", "lists"],
            )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [zstandard.decompress(data) for data in batch.column(2).to_pylist()]
            cuts = np.cumsum([0, *(x.count(b" ") + 1 for x in lists)]).tolist()
            words = pa.array([w for x in lists for w in x.split(b" ")], pa.binary()).dictionary_encode()
            numbers = encoded_words(words.dictionary.to_pylist(), path, specials_are_text)
            ends = np.concatenate([[0], np.flatnonzero(numbers == _GAP) + 1])
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers))
            out = [_packed(made.take(words.indices[a:b]).flatten().to_numpy()) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["block", "bucket", "data"])

    made = stored(
        docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).mapInArrow(
            blocks, "block long, ids array<long>, lengths array<int>, words binary, buckets array<int>, lists array<binary>"
        ),
        "blocks",
    )
    asked = made.select("block", F.explode(F.arrays_zip("buckets", "lists")).alias("x")).select("block", F.col("x.buckets").alias("bucket"), F.col("x.lists").alias("data"))
    replies = asked.repartition("bucket").mapInArrow(once, "block long, bucket int, data binary")
    none = {"ids": F.lit(None).cast("array<long>"), "lengths": F.lit(None).cast("array<int>")}
    rows = made.select("block", F.lit(-1).alias("bucket"), F.col("words").alias("data"), "ids", "lengths").unionByName(replies.withColumns(none))
    return Blocks(rows.repartition("block"), hot)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """``id, piece``: as many rows as the tokenizer's vocabulary has."""
    made = tokenizer(path, False)
    rows = [(i, made.id_to_token(i) or "") for i in range(made.get_vocab_size(with_added_tokens=True))]
    return spark.createDataFrame(rows, "id int, piece string")


def with_pieces(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` of :class:`Blocks` joined to ``__pieces``, the table of pieces laid out by id in one row, which the vocabulary bounds and which is broadcast.

    Ids meet their pieces where the text is and no position travels. A block's own row gets a copy, the others null.
    """
    row = F.transform(F.sort_array(F.collect_list(F.struct("id", "piece"))), lambda p: p["piece"]).alias("__pieces")
    return rows.join(F.broadcast(pieces(rows.sparkSession, path).agg(row)), F.col("bucket") < 0, "left")  # one row


def _texts(ids: pa.ListArray, of: pa.Array) -> pa.Array:
    """The value of ``of`` at each id, joined by one space, as a tokenizer without a decoder does it with pieces."""
    ends = ids.offsets.to_numpy()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends - ends[0]), of.take(ids.flatten())), " ")


def _by_block(encoded: Blocks, path: str | None, columns: Callable[[pa.Array, pa.ListArray, pa.Array], list[pa.Array]], schema: str) -> DataFrame:
    """``columns(doc_id, ids, pieces)`` of each block, where its words' ids and, with a path, the table of pieces have met it."""
    hot, names = encoded.hot, [c.split(" ")[0] for c in schema.split(", ")]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # the open block and the ids of its own words so far

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            (ids, lengths, data, row), replies = held
            table = pa.concat_arrays([hot.value[1], *(_lists(_unpacked(reply)).cast(hot.value[1].type) for reply in replies)])
            words = table.take(pa.array(_unpacked(data)))
            ends = words.offsets.to_numpy()[np.cumsum([0, *lengths])]
            yield pa.RecordBatch.from_arrays(columns(pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), words.values), row), names)

        for batch in batches:
            docs = zip(*(batch.column(c).to_pylist() for c in ("bucket", "data", "ids", "lengths")), strict=True)
            for (bucket, data, ids, lengths), row in zip(docs, batch.column("__pieces"), strict=True):
                if bucket < 0:
                    yield from close()
                    held = [(ids, lengths, data, row.values), []]
                else:
                    held[1].append(data)
        yield from close()

    rows = with_pieces(encoded.rows, path) if path else encoded.rows.withColumn("__pieces", F.lit(None).cast("array<string>"))
    return rows.sortWithinPartitions("block", "bucket").mapInArrow(joined, schema)


def decode(encoded: Blocks, path: str) -> DataFrame:
    """``doc_id, ids, text`` of the blocks that :func:`encode_blocks` makes."""
    return _by_block(encoded, path, lambda doc_id, ids, row: [doc_id, ids, _texts(ids, row)], "doc_id long, ids array<int>, text string")


def digests(encoded: Blocks, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the blocks: ids in decimal joined by one space, and the text of :func:`decode`."""

    def sha256(texts: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(t).hexdigest() for t in texts.cast(pa.binary()).to_pylist()], pa.string())

    def of(doc_id: pa.Array, ids: pa.ListArray, row: pa.Array) -> list[pa.Array]:
        numbers = pa.array(np.arange(len(row))).cast(pa.string())
        return [doc_id, ids.value_lengths().cast(pa.int64()), sha256(_texts(ids, numbers)), sha256(_texts(ids, row))]

    return _by_block(encoded, path, of, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
