"""Deterministic sharded WARC writer and reader.

Records are range-sorted by id: a shard holds the records whose bytes begin within one stretch of the running total over all
records in the order of their ids, so the same table always makes the same shards, whatever its ids are.  Ids are
integers.  Each task sorts its shards and writes gzip members, rolling to a new file when the compressed size
passes a limit; headers, record ids and digests are made anew from the payload.  A file is written under a temporary name
and moved to its final one when complete; the manifest table, written last, is the commit: readers open only files in it.
A task that runs again writes the same bytes to the same names.  The first ids of the shards are broadcast: SHARDS at most, beyond
which shards grow with the table; files keep their size.

Of records with equal payloads of at least MIN_REVISIT bytes, the one with the largest id is a response, the others
revisits of it.  Equality is SHA-1, SHA-256 and length.  The payload moves once: revisit marks (id, digest, target) are
sorted into the same ranges just before their records.

Defined results: a null payload counts as empty; a null url becomes ``about:blank``; of rows repeated with the same id and
payload the first is the response and the others revisit that id; a null id sorts first, and is a revisit's target only
if every id of that payload is null; an empty table makes an empty manifest and reads back as no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrowtools import lean, slices, small_batches
from .common import Scratch, table

MIN_REVISIT, FILE_BYTES, SHARD_BYTES, SHARDS = 1000, 64_000_000, 32_000_000, 100_000
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _b32(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(raw).decode()


def make_record(page_id, url: str | None, payload: bytes, revisit: bool, target) -> bytes:
    sha = hashlib.sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, ('r' if revisit else '') + sha.hexdigest())}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines += [f"WARC-Payload-Digest: {_b32(sha.digest())}", f"WARC-Block-Digest: {_b32(hashlib.sha1(block).digest())}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(target, sha.hexdigest())}", f"WARC-Refers-To-Date: {DATE}"]
        if target is not None:
            lines.append(f"X-Refers-To-Page-ID: {target}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _File:
    """One archive file: temporary name while it grows."""

    def __init__(self, uri: str, name: str):
        self.fs, root = _filesystem(uri)
        self.final, self.temp = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(root, recursive=True)
        self.out, self.name, self.size, self.records, self.sha = self.fs.open_output_stream(self.temp, compression=None), name, 0, 0, hashlib.sha1()

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.records += 1

    def commit(self) -> tuple:
        self.out.close()
        self.fs.move(self.temp, self.final)
        return self.name, self.records, self.size, self.sha.hexdigest()


def _shard_starts(sizes: DataFrame, shard_bytes: int, scratch: Scratch) -> np.ndarray:
    """First id of each shard but the first: at most SHARDS numbers, from running totals over all records in order."""
    per_id = sizes.where("page_id is not null").groupBy("page_id").agg(F.sum("payload_bytes").alias("n"))
    ranged = scratch.keep(per_id.repartitionByRange("page_id").withColumn("p", F.spark_partition_id()), "ranged")
    totals = sorted(map(tuple, ranged.groupBy("p").agg(F.sum("n")).collect()))  # one row a partition
    total = sum(n for _, n in totals)
    size = max(shard_bytes, total // SHARDS + 1)
    if total <= size:
        return np.zeros(0, np.int64)
    before = np.cumsum([0, *(n for _, n in totals)])
    bases = F.broadcast(sizes.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(totals, before, strict=False)], "p int, base long"))
    running = F.sum("n").over(Window.partitionBy("p").orderBy("page_id")) - F.col("n")
    shard = ranged.withColumn("at", running).join(bases, "p").select("page_id", F.floor((F.col("base") + F.col("at")) / F.lit(size)).alias("shard"))
    starts = [r["first"] for r in shard.groupBy("shard").agg(F.min("page_id").alias("first")).orderBy("first").collect()]
    return np.array(starts[1:], np.int64)


def write_warc(pages: DataFrame, uri: str, scratch: Scratch, min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes pages(page_id, url, html) below uri; returns the manifest (file, records, bytes, sha1) once it is written."""
    small_batches(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    sizes = scratch.keep(pages.select("page_id", F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("sha1"), F.sha2(html, 256).alias("sha256")), "sizes")
    same = ["sha1", "sha256", "payload_bytes"]
    groups = sizes.where(F.col("payload_bytes") >= min_revisit).groupBy(*same).agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marks = sizes.join(groups, same).where("not (page_id <=> target)").select("page_id", "sha1", "target").distinct()
    starts = _shard_starts(sizes, shard_bytes, scratch)
    shared = pages.sparkSession.sparkContext.broadcast(starts)
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.lit(1).alias("k"), "url", F.col("html"), F.lit(None).cast("string").alias("sha1"), F.lit(None).cast(kind).alias("target"))
    rows = rows.unionByName(marks.select("page_id", F.lit(0).alias("k"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "sha1", "target"))

    def add_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pc.fill_null(b.column("page_id").cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            shard = np.searchsorted(shared.value, ids, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard)], [*b.schema.names, "shard"])

    rows = rows.mapInArrow(lean(add_shard), f"page_id {kind}, k int, url string, html string, sha1 string, target {kind}, shard int")
    rows = rows.repartitionById(len(starts) + 1, "shard").sortWithinPartitions("shard", "page_id", "k", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done, at, part, now, marked, written = None, [], None, 0, (None,), {}, set()
        for whole in batches:
            for b in slices(whole, "html"):
                for r in b.to_pylist():
                    if r["shard"] != at:
                        if out:
                            done.append(out.commit())
                        out, at, part = None, r["shard"], 0
                    if now != (r["page_id"],):
                        now, marked, written = (r["page_id"],), {}, set()
                    if not r["k"]:
                        marked[r["sha1"]] = r["target"]
                        continue
                    payload = (r["html"] or "").encode()
                    sha = hashlib.sha1(payload).hexdigest()
                    revisit = sha in marked or (len(payload) >= min_revisit and sha in written)
                    if out is None:
                        out = _File(uri, f"shard-{at:06d}-{part:04d}.warc.gz")
                    out.add(gzip_member(make_record(r["page_id"], r["url"], payload, revisit, marked.get(sha, r["page_id"]))))
                    written.add(sha)
                    if out.size >= file_bytes:
                        done.append(out.commit())
                        out, part = None, part + 1
        if out:
            done.append(out.commit())
        cols = list(zip(*done, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["file", "records", "bytes", "sha1"])

    return scratch.keep(rows.mapInArrow(lean(run), "file string, records long, bytes long, sha1 string"), "manifest")


def parse_records(read, size: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; read(n) gives compressed bytes.  One record is in memory at a time."""
    raw = b""
    while True:
        z, parts = zlib.decompressobj(31), []
        raw = raw or read(size)
        if not raw:
            return
        while not z.eof:
            if not raw and not (raw := read(size)):
                raise ValueError("archive ends within a record")
            parts.append(z.decompress(raw))
            raw = z.unused_data
        data = b"".join(parts)
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError("no WARC record")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        n = int(headers["Content-Length"])
        if rest[n:] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        yield headers, rest[:n]


def read_warc(manifest: DataFrame, uri: str, with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload, with digests verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
        fs, root = _filesystem(uri)
        for b in batches:
            for name in b.column("file").to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for h, block in parse_records(f.read):
                        digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:"))
                        payload = None
                        if h["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if hashlib.sha1(payload).digest() != digest or len(payload) != int(h["X-Payload-Length"]):
                                raise ValueError(f"{name}: a payload digest is wrong")
                        page, target = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                        rows.append((page and int(page), h["WARC-Target-URI"], int(h["X-Payload-Length"]), digest.hex(), h["WARC-Type"], target and int(target), *[payload] * with_payload))
                        if len(rows) >= (50 if with_payload else 5000):
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    # a fixed number of tasks, as a few rows of names would be put into one
    tasks = max(1, min(manifest.count(), 4 * max(manifest.sparkSession.sparkContext.defaultParallelism, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    return manifest.repartitionByRange(tasks, "file").mapInArrow(lean(run), schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    uri = scratch.path("archive")
    manifest = write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), uri, scratch)
    return read_warc(manifest, uri).drop("url")


OP3_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS html FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM q
"""
