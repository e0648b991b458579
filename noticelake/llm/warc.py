"""Operator 2: WARC archives, one gzip member per record, written and read record by record.

Archives are written by tasks into the folder that driver and executors share, under names of their
own; only the manifest, a table that Spark commits, says which archives count, so a repeated or lost
task leaves no half record in a result. The reader inflates one member at a time in small steps.
"""

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_KEYS, saved, table, work_dir

#: Payloads under so many bytes are always stored.
MIN_BYTES = 100
#: An archive is closed once it has so many compressed bytes.
ARCHIVE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
STEP = 1 << 16


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _qualified(spark: SparkSession, folder: str) -> str:
    """`folder` as an address with its scheme: without one, Spark's default file system is meant."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _local(uri: str) -> str:
    """file:/x and file:///x alike as file:///x."""
    return f"file:///{uri[5:].lstrip('/')}" if uri.startswith("file:") else uri


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record as one gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    raw = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class Members:
    """Reads gzip members one after another; `read` never goes beyond the current member."""

    def __init__(self, stream: BinaryIO, step: int = STEP) -> None:
        self.stream, self.step, self.rest = stream, step, b""

    def next(self) -> bool:
        """Start the next member; False at the end of the archive."""
        self.rest = self.rest or self.stream.read(self.step)
        self.packer, self.out = zlib.decompressobj(31), bytearray()
        return bool(self.rest)

    def fill(self, n: int) -> None:
        """At least n bytes in `out`, or all that the member still has."""
        while len(self.out) < n and not self.packer.eof:
            if not self.rest and not (more := self.stream.read(self.step)):
                raise ValueError("the archive ends within a gzip member")
            elif not self.rest:
                self.rest = more
            self.out += self.packer.decompress(self.rest, self.step)
            self.rest = self.packer.unused_data if self.packer.eof else self.packer.unconsumed_tail

    def take(self, n: int) -> bytes:
        self.fill(n)
        if len(self.out) < n:
            raise ValueError(f"the record is short of {n - len(self.out)} bytes")
        taken = bytes(self.out[:n])
        del self.out[:n]
        return taken

    def head(self) -> bytes:
        """Up to and with the blank line that ends the headers."""
        n = STEP // 16
        while (at := self.out.find(b"\r\n\r\n")) < 0:
            self.fill(n := 2 * n)
            if self.packer.eof and b"\r\n\r\n" not in self.out:
                raise ValueError("the record has no end of headers")
        return self.take(at + 4)


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; framing and digests are verified."""
    members = Members(stream)
    while members.next():
        version, *lines = members.head().decode().split("\r\n")[:-2]
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        block = members.take(int(headers["content-length"]))
        if members.take(4) != b"\r\n\r\n" or members.fill(1) or members.out:
            raise ValueError("the record doesn't end where its length says")
        if (want := headers.get("warc-block-digest")) and want != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError(f"the block of {headers.get('warc-record-id')} doesn't have its digest")
        yield headers, block


def _urn(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _page(urn: str | None) -> int | None:
    return None if urn in (None, "<urn:page:none>") else int(urn[len("<urn:page:") : -1])


def plan_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages (page_id, url, html) with payload, digest and refers_to (null: the record is a response)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= min_bytes
    first = rows.where(long).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    first = saved(first.where("n > 1"), "digests")
    total = first.agg(F.sum("n")).first()[0] or 0
    # a payload of many pages is broadcast; short payloads and those go anywhere, by a key that no digest equals
    hot = F.broadcast(first.where(F.col("n") * HOT_KEYS > total).select("digest", F.col("least").alias("hot")))
    cold = first.where(F.col("n") * HOT_KEYS <= total).select(F.col("digest").alias("key"), F.col("least").alias("cold"))
    key = F.when(long & F.col("hot").isNull(), F.col("digest")).otherwise(F.concat_ws("-", F.lit("any"), "page_id", "url"))
    joined = rows.join(hot, "digest", "left").withColumn("key", key).join(cold, "key", "left")
    least = F.coalesce("hot", "cold")
    other = F.col("page_id").isNull() | (F.col("page_id") > least)
    return joined.select("page_id", "url", "payload", "digest", F.when(other, least).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write `pages` (page_id, url, html) as archives in `folder`; returns their manifest (path, n, bytes).

    Equal payloads of at least `min_bytes` are stored once, under the smallest page_id; every other such row
    is a revisit of it. A null html is an empty payload. Rows that repeat the smallest page_id are all
    responses. A null page_id comes after all others; a group with no other id has responses only. A null
    url leaves out WARC-Target-URI. A payload is held in memory once, whole. Other columns are ignored. An
    empty table gives no archive.
    """

    folder = _qualified(pages.sparkSession, folder)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, out, path, n, size = [], None, "", 0, 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for at in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (c[at].as_py() for c in columns)
                block = payload if refers_to is None else b""
                headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE)]
                if url is not None:
                    headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
                if refers_to is not None:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to))]
                headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(len(payload))), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "text/html")]
                if out is None:
                    path = f"{_local(folder).rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
                    where, name = _open(path)
                    where.create_dir(os.path.dirname(name), recursive=True)
                    out = where.open_output_stream(name, compression=None)
                member = record(headers, block)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    done.append((path, n, size))
                    out, n, size = None, 0, 0
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["path", "n", "bytes"])

    return saved(plan_revisits(pages, min_bytes).mapInArrow(run, "path string, n long, bytes long"), "warc-manifest")


def read_warc(manifest: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per record of the archives at `manifest.path`: page_id, url, record_type, refers_to,
    payload_bytes, payload_digest (both of the full payload, also for revisits) and payload (null for revisits).
    """
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            where, name = _open(_local(path))
            with where.open_input_stream(name, compression=None) as stream:
                for headers, block in records(stream):
                    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and digest != hashlib.sha256(block).hexdigest():
                        raise ValueError(f"the payload of {headers['warc-record-id']} doesn't have its digest")
                    rows.append((_page(headers["warc-record-id"]), headers.get("warc-target-uri"), kind, _page(headers.get("warc-refers-to")), int(headers["warc-payload-length"]), digest, block if kind == "response" else None))
                    size += len(block)
                    if size >= batch_bytes or len(rows) >= 4096:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)

    spark = manifest.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(tasks, "path").mapInArrow(
        run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    back = read_warc(write_warc(pages, work_dir(spark, "warc")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op2_warc": query}
ORACLE_SQL = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM q GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, q.payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM q JOIN f ON q.payload_digest = f.payload_digest
"""
}
