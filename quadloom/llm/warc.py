"""WARC archives of pages: a writer, and a sequential reader with digest verification.

An archive is a run of gzip members, one for each record. Tasks can't write plain files to every store
that Spark can, so an archive is kept as rows ``archive, segment, data``: segments of whole members, in
order, which together are the bytes of the ``.warc.gz`` file. ``from_files`` gives the same rows for
such files in any store (a file is a row, so up to 2 GB), and ``members`` reads both the same way, a chunk at
a time: it inflates one member incrementally, takes the record's length from its content-length, hashes the
payload as it passes, and never holds more than a chunk and a header unless the payload is asked for.
Records of any type are framed by their content-length alone; the payload of responses and revisits that
hold an HTTP message is what follows its header, that of all others their whole block.

Equal payloads are written once: the page with the smallest id is a response record, the others are
revisit records that refer to it. Digests are computed in Spark; only ids and digests are shuffled to
find first pages, and the pages themselves once, to meet what they refer to.

Defined cases: null html is an empty payload; a page without an id is always a response; rows of one id
and payload are one page, written as often as they stand; ids, urls and payloads of any content are
kept, since header values are percent-encoded where they would break a line.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.common import stored, utf8

SEGMENT_BYTES = 1 << 20
CHUNK = 1 << 16
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SEGMENTS = "archive string, segment long, data binary"
RECORDS = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, verified boolean"


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object = None) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe='%:/?#[]@!$&()*+,;=~' + chr(39))}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(LEVEL, wbits=31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


class Damaged(ValueError):
    """Bytes that are no record."""


class Member:
    """Reader of one gzip member of a stream of chunks."""

    def __init__(self, chunks: Iterator[bytes], start: bytes):
        self.chunks, self.z, self.raw, self.out = chunks, zlib.decompressobj(wbits=31), start, b""

    def fill(self) -> bool:
        """Inflate at most a chunk more; false at the end of the member."""
        while not self.z.eof:
            data = self.raw or self.z.unconsumed_tail
            if not data:
                data = next(self.chunks, b"")
                if not data:
                    raise Damaged("the stream ends within a record")
            got = self.z.decompress(data, CHUNK)
            self.raw = self.z.unconsumed_tail
            if got:
                self.out += got
                return True
        return False

    def until(self, mark: bytes, most: int | None = None) -> bytes:
        """What stands before the mark, of any length or within the next ``most`` bytes."""
        seen, parts = b"", []
        while (at := (seen + self.out).find(mark)) < 0:
            keep = len(mark) - 1  # the mark may begin here
            both = seen + self.out
            parts.append(both[: max(0, len(both) - keep)])
            seen, self.out = both[len(parts[-1]) :], b""
            if most is not None and sum(map(len, parts)) > most or not self.fill():
                raise Damaged("a header without an end")
        both = seen + self.out
        self.out = both[at + len(mark) :]
        head = b"".join([*parts, both[:at]])
        if most is not None and len(head) + len(mark) > most:
            raise Damaged("an HTTP header longer than its record")
        return head

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in chunks."""
        while n > 0:
            if not self.out and not self.fill():
                raise Damaged("a record shorter than its content-length")
            part, self.out = self.out[:n], self.out[n:]
            n -= len(part)
            yield part


def headers(block: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = block.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def members(chunks: Iterable[bytes], with_payload: bool = False) -> Iterator[dict]:
    """Records of an archive, in order."""
    chunks = iter(chunks)
    rest = next(chunks, b"")
    while rest:
        m = Member(chunks, rest)
        version, head = headers(m.until(b"\r\n\r\n"))
        if not version.startswith("WARC/"):
            raise Damaged(f"no record: {version[:40]!r}")
        kind, length = head.get("warc-type", ""), head.get("content-length", "")
        if not length.isdigit():
            raise Damaged("a record without a content-length")
        body, fields = int(length), {}
        if kind in ("response", "revisit") and body and head.get("content-type", "").lower().startswith("application/http"):
            http = m.until(b"\r\n\r\n", body)
            fields, body = headers(http)[1], body - len(http) - 4
        sha, kept, n = hashlib.sha1(), [], 0
        for part in m.take(body):
            sha.update(part)
            n += len(part)
            if with_payload:
                kept.append(part)
        if b"".join(m.take(4)) != b"\r\n\r\n" or m.fill() or m.out:
            raise Damaged("a record that doesn't end where its content-length says")
        own, digest = base64.b32encode(sha.digest()).decode(), head.get("warc-payload-digest", "").removeprefix("sha1:")
        said = fields.get("content-length", "")
        full = int(said) if said.isdigit() else n
        yield {
            "record_id": head.get("warc-record-id"),
            "record_type": kind,
            "target_uri": head.get("warc-target-uri"),
            "refers_to": head.get("warc-refers-to"),
            "payload_digest": digest or own,
            "payload_bytes": full,
            "verified": None if kind == "revisit" else (not digest or own == digest) and full == n,
        } | ({"payload": b"".join(kept)} if with_payload else {})
        rest = m.z.unused_data or next(chunks, b"")


def first_pages(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``page_id, digest, refers_to`` of pages whose payload an earlier page has."""
    body = F.coalesce(utf8("html"), F.lit(b""))
    keys = pages.where(F.col("page_id").isNotNull() & (F.length(body) >= min_bytes)).select("page_id", F.sha1(body).alias("digest")).distinct()
    keys = stored(keys, "digests")
    firsts = stored(keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    return keys.join(firsts, "digest").where("page_id <> refers_to")


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages(page_id, url, html)`` as archives in the shared folder, one for each task."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    revisits = first_pages(pages, min_bytes).select("page_id", "digest", "refers_to")
    own = pages.select("page_id", "url", F.coalesce(utf8("html"), F.lit(b"")).alias("body"))
    own = own.withColumn("digest", F.sha1("body")).join(revisits, ["page_id", "digest"], "left")

    def write(batches):
        archive, n, data, size = f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0, [], 0

        def segment():
            return pa.RecordBatch.from_pydict({"archive": pa.array([archive]), "segment": pa.array([n], pa.int64()), "data": pa.array([b"".join(data)], pa.binary())})

        for b in batches:
            for page, url, body, digest, first in zip(*(b.column(c) for c in ("page_id", "url", "body", "digest", "refers_to")), strict=True):
                bare = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                data.append(record(page.as_py(), url.as_py(), body.as_py(), bare, first.as_py()))
                size += len(data[-1])
                if size >= SEGMENT_BYTES:
                    yield segment()
                    n, data, size = n + 1, [], 0
        if data:
            yield segment()

    return stored(own.mapInArrow(write, SEGMENTS), "archives")


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """Archive files of any store that Spark reads, each as one segment."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.lit(0).cast("long").alias("segment"), F.col("content").alias("data"))


def read_records(segments: DataFrame) -> DataFrame:
    """Records of archives as they stand: ids, type, digest, length, and whether payload and digest agree,
    which for a revisit only the record that it refers to can tell (null)."""
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.bool_()]

    def read(batches):
        for b in batches:
            for data in b.column(0):
                view = data.as_buffer()
                found = list(members(bytes(view[i : i + CHUNK]) for i in range(0, len(view), CHUNK)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in zip(names, kinds, strict=True)], names)

    return segments.select("data").mapInArrow(read, RECORDS)


def read_archives(segments: DataFrame) -> DataFrame:
    """Records of archives, revisits checked against the records they refer to: that one is verified and
    has their digest and length."""
    records = stored(read_records(segments), "records")
    rest, again = records.where("record_type <> 'revisit'"), records.where("record_type = 'revisit'")
    firsts = rest.where("verified").select(F.col("record_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    known = ["refers_to", "payload_digest", "payload_bytes"]
    good = again.join(firsts, known, "left_semi").withColumn("verified", F.lit(True))
    bad = again.join(firsts, known, "left_anti").withColumn("verified", F.lit(False))
    return rest.unionByName(good).unionByName(bad)
