"""A deterministic sharded WARC writer and its reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: Compressed bytes after which a file is rolled, bytes of payload in a shard at least, and shards at most: what their
#: first ids take in a task. A corpus above the product has larger shards, whose files are rolled all the same.
ROLL_BYTES = 32 << 20
SHARD_BYTES = 32 << 20
MOST_SHARDS = 1 << 16
HOT_SHARE = 1000
DATE = "2024-01-01T00:00:00Z"


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, digest, refers_to`` of the distinct pages: of equal payloads of ``least_bytes`` bytes or more the
    smallest page_id is the response (``refers_to`` null), others refer to it.

    A payload that more than one in HOT_SHARE pages has meets its pages by a broadcast of at most HOT_SHARE rows,
    so that a page that a third of all pages equals doesn't gather in one task."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    each = stored(pages.select("page_id", F.sha1(html).alias("digest"), F.octet_length(html).alias("bytes")).distinct(), "digests")
    first = each.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stored(first, "firsts")
    total = first.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE > total
    some = F.broadcast(first.where(hot).select("digest", F.col("first").alias("hot_first")))
    told = each.join(some, "digest", "left")
    rest = first.where(~hot).select(F.col("digest").alias("cold"), "first")
    told = told.join(rest, F.when(F.col("hot_first").isNull(), F.col("digest")) == F.col("cold"), "left").withColumn("first", F.coalesce("hot_first", "first"))
    return told.select("page_id", "digest", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))


def _record(page: int, url: str | None, html: bytes, refers_to: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
    name = lambda p: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{p}/{digest}')}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    block = http if refers_to is not None else http + html
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {page}", f"X-Payload-Bytes: {len(html)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def place_of(starts: list[int]) -> Column:
    """How many of the ascending ``starts`` after the first are not above page_id, which is not below the first."""
    known = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<long>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(starts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(known, at + step) <= F.col("page_id"), at + step).otherwise(at))


def shards(pages: DataFrame) -> list[int]:
    """The first id of each shard: in the order of ids a shard begins where the payload before it has passed another
    SHARD_BYTES (more above MOST_SHARDS of them).

    Ids and sizes alone are sorted by range; running sums inside the ranges and the ranges' totals give the payload
    before each page, so the ids decide where shards begin and how Spark deals the ranges doesn't.
    """
    n = max(1, pages.sparkSession.sparkContext.defaultParallelism)
    sizes = pages.select("page_id", F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("n")).groupBy("page_id").agg(F.sum("n").alias("n"))
    parted = stored(sizes.repartitionByRange(n, "page_id").withColumn("part", F.spark_partition_id()), "page_sizes")
    totals = sorted((r["part"], r["n"]) for r in parted.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row for each range
    total = sum(size for _, size in totals)
    step = max(SHARD_BYTES, -(-total // MOST_SHARDS))
    before, begin = 0, []
    for part, size in totals:
        begin.append((part, before))
        before += size
    if not begin:
        return []
    carry = F.broadcast(pages.sparkSession.createDataFrame(begin, "part int, begin long"))
    upto = Window.partitionBy("part").orderBy("page_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = parted.select("page_id", "part", (F.sum("n").over(upto) - F.col("n")).alias("inside")).join(carry, "part")
    firsts = running.groupBy(F.floor((F.col("begin") + F.col("inside")) / step).alias("shard")).agg(F.min("page_id").alias("first"))
    return sorted(r["first"] for r in firsts.collect())  # MOST_SHARDS + 1 at most


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, least_bytes: int = 0) -> DataFrame:
    """Write ``page_id, url, html`` as gzipped WARC files to ``folder`` and return the manifest
    ``file, records, bytes, sha256``.

    Records are sorted by page_id; a shard is a range of ids, a new file begins at each shard and after
    ``roll_bytes``. Names and contents follow from the rows alone, so a repeated attempt writes the same files. A file
    is written under a temporary name, then moved; the manifest, committed last, says which files count. Null html is empty;
    a null page_id is left out. One record is in memory at a time, whatever the size of a shard.
    """
    pages = pages.where(F.col("page_id").isNotNull()).select("page_id", "url", "html")
    starts = shards(pages)
    told = roles(pages, least_bytes).select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), "digest", "refers_to")
    rows = pages.select("page_id", F.lit(1).alias("kind"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    both = told.unionByName(rows).withColumn("shard", (place_of(starts) if starts else F.lit(0)).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        manifest: list[tuple] = []
        out, shard, seq, page, known = None, None, 0, None, {}

        def close() -> None:
            nonlocal out
            if out:
                out["stream"].close()
                store.move(out["tmp"], f"{base}/{out['name']}")
                manifest.append((out["name"], out["records"], out["bytes"], out["sha"].hexdigest()))
                out = None

        for batch in batches:
            for p, kind, url, html, digest, refers, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if p != page:
                        page, known = p, {}
                    known[digest] = refers
                    continue
                if s != shard or (out and out["bytes"] >= roll_bytes):
                    close()
                    shard, seq = s, seq + 1 if s == shard else 0
                if not out:
                    name = f"part-{shard:06d}-{seq:05d}.warc.gz"
                    tmp = f"{base}/_tmp/{name}.{attempt}"
                    out = {"name": name, "tmp": tmp, "stream": store.open_output_stream(tmp, compression=None), "records": 0, "bytes": 0, "sha": hashlib.sha256()}
                pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                data = pack.compress(_record(p, url, html, known.get(hashlib.sha1(html).hexdigest()))) + pack.flush()
                out["stream"].write(data)
                out["sha"].update(data)
                out["records"] += 1
                out["bytes"] += len(data)
        close()
        columns = list(zip(*manifest, strict=True)) or [[], [], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "records", "bytes", "sha256"])

    store, base = pyarrow.fs.FileSystem.from_uri(folder)
    store.create_dir(f"{base}/_tmp")
    dealt = both.select("page_id", "kind", "url", "html", "digest", "refers_to", "shard").repartitionById(max(1, len(starts)), F.col("shard").cast("int")).sortWithinPartitions("shard", "page_id", "kind")
    return stored(dealt.mapInArrow(run, "file string, records long, bytes long, sha256 string"), "manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` of every record of the manifest's files.

    The payload's digest and length are computed again from a response and must agree with its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = []
                buffer, at = memoryview(content), 0
                while at < len(buffer):
                    member, parts = zlib.decompressobj(31), []
                    while not member.eof and at < len(buffer):  # in steps: what follows a member is copied each time
                        parts.append(member.decompress(buffer[at : at + 16384]))
                        at += 16384
                    at = min(at, len(buffer)) - len(member.unused_data)
                    record = b"".join(parts)
                    head, _, block = record.partition(b"\r\n\r\n")
                    h = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                    digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Bytes"])
                    if h["WARC-Type"] == "response":
                        payload = block[: int(h["Content-Length"])].partition(b"\r\n\r\n")[2]
                        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"record {h['WARC-Record-ID']} is damaged")
                    refers = h.get("X-Refers-To-Page")
                    rows.append((int(h["X-Page-Id"]), h.get("WARC-Target-URI"), size, digest, h["WARC-Type"], int(refers) if refers else None))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if not manifest.limit(1).count():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(f"{folder}/*.warc.gz").withColumn("file", F.element_at(F.split("path", "/"), -1))
    return files.join(manifest.select("file"), "file", "left_semi").select("content").mapInArrow(run, schema)
