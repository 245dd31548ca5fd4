"""WARC archives with a Zstandard dictionary of their own.

Each task writes its pages as WARC/1.1 records into ``.warc.zst`` files: a
dictionary is built from the first records of the archive, stands in a leading
skippable frame (magic 0x184D2A5D), and every record is a frame of its own,
compressed with it, so a reader that knows an offset needs the dictionary and one
frame. An archive is closed at ``ROLL`` bytes; memory stays at that plus a record.

Of records with equal payloads the one with the largest id is the response; the
others become revisits of it, without the payload. Which is which is found by
digest: only ids and digests meet there, and counts are combined before the
shuffle, so a payload in a third of all rows costs no large group of payloads.

Tasks write to names that no other attempt uses and return them; only what
successful tasks returned is read, so lost executors and repeated attempts leave
files that nobody looks at. Files go through pyarrow.fs, which knows file://,
hdfs://, s3:// and gs://.

Defined cases: a null payload is empty; equal payload and equal id are both the
response; null ids are read back as null; a null url has no header; control
characters of urls are percent-encoded; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlog.llm.shared import fresh_path, staged

ROLL = 32 << 20
SAMPLE = 2 << 20
DICTIONARY = 64 << 10
LEVEL = 6
DATE = "2026-01-01T00:00:00Z"
MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "<urn:kvlog:page:{}>"


def _clean(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(key, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False, date: str = DATE) -> bytes:
    """One WARC record; digest is base32. A revisit has the HTTP header only, whose Content-Length still tells the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_ID.format('' if key is None else key)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_ID.format('' if refers_to is None else refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int = DICTIONARY) -> zstandard.ZstdCompressionDict:
    """Trained where the records suffice for it, else the records themselves."""
    total = sum(map(len, samples))
    if len(samples) >= 16 and total >= 4 * size:
        try:
            return zstandard.train_dictionary(size, samples, k=512, d=8)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[:size] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Writer:
    """One archive: records are held until the dictionary's sample is full, then compressed one by one."""

    def __init__(self) -> None:
        self.waiting: list[bytes] = []
        self.held = 0
        self.out: io.BytesIO | None = None
        self.records = 0

    def add(self, raw: bytes) -> None:
        self.records += 1
        if self.out is not None:
            self.out.write(self.compressor.compress(raw))
            return
        self.waiting.append(raw)
        self.held += len(raw)
        if self.held >= SAMPLE:
            self._begin()

    def _begin(self) -> None:
        dictionary = build_dictionary([r[:65536] for r in self.waiting])
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
        raw = dictionary.as_bytes()
        self.out = io.BytesIO()
        self.out.write(struct.pack("<II", MAGIC, len(raw)) + raw)
        for r in self.waiting:
            self.out.write(self.compressor.compress(r))
        self.waiting = []

    def size(self) -> int:
        return self.out.tell() if self.out is not None else self.held

    def close(self) -> bytes:
        if self.out is None:
            self._begin()
        return self.out.getvalue()


def read_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    magic, size = struct.unpack_from("<II", raw)
    if magic != MAGIC:
        raise ValueError("no dictionary frame at the start of the archive")
    own = raw[8 : 8 + size]
    trained = own[:4] == b"\x37\xa4\x30\xec"
    dictionary = zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(raw[8 + size :]), read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            head[name.lower()] = value
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        yield head, block


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _with_targets(pages: DataFrame, key: str, url: str, payload: str, min_bytes: int) -> DataFrame:
    """key, url, payload, and for a revisit the id of its response."""
    base = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(payload, F.lit("")).alias("payload"))
    base = base.withColumn("sha1", F.sha1(F.encode("payload", "utf-8")))
    meta = base.where(F.octet_length("payload") >= min_bytes).select("key", "sha1")
    last = meta.groupBy("sha1").agg(F.max("key").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    # sizes of these tables grow with the pages: joined by merging at any size
    target = meta.join(last.hint("merge"), "sha1").where("key IS NULL OR key <> last").distinct()
    target = target.select(F.col("key").alias("k"), F.col("sha1").alias("s"), "last")
    return base.join(target.hint("merge"), base["key"].eqNullSafe(F.col("k")) & (base["sha1"] == F.col("s")), "left").select("key", "url", "payload", F.col("s").isNotNull().alias("revisit"), "last")


def write_archives(pages: DataFrame, to: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write pages as archives below the folder `to` (a new one in the shared folder if None); returns path, n_records, bytes of each."""
    spark = pages.sparkSession
    to = to or fresh_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer()

        def roll() -> pa.RecordBatch:
            raw, name = writer.close(), f"{to}/{uuid.uuid4().hex}.warc.zst"
            where, path = pafs.FileSystem.from_uri(name)
            where.create_dir(path.rpartition("/")[0], recursive=True)
            with where.open_output_stream(path) as f:
                f.write(raw)
            return pa.RecordBatch.from_pydict({"path": [name], "n_records": [writer.records], "bytes": [len(raw)]})

        for batch in batches:
            for k, u, p, again, last in zip(*(batch.column(c) for c in range(5)), strict=True):
                body = p.as_py().encode()
                writer.add(record(k.as_py(), u.as_py(), body, base32_sha1(body), last.as_py(), again.as_py()))
                if writer.size() >= ROLL:
                    yield roll()
                    writer = Writer()
        if writer.records:
            yield roll()

    out = _with_targets(pages, key, url, payload, min_bytes).mapInArrow(write, "path string, n_records long, bytes long")
    return staged(out, "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row for each record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
    start = len(_ID.partition("{")[0])

    def number(uri: str | None) -> int | None:
        return int(uri[start:-1]) if uri and uri[start:-1] else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])
        for batch in batches:
            for name in batch.column(0):
                where, path = pafs.FileSystem.from_uri(name.as_py())
                with where.open_input_stream(path) as f:
                    raw = f.read()
                rows, held = [], 0
                for head, block in read_records(raw):
                    http, _, body = block.partition(b"\r\n\r\n")
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    kind = head["warc-type"]
                    if kind == "response" and base32_sha1(body) != digest:
                        raise ValueError(f"payload of {head['warc-record-id']} doesn't have its digest")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    rows.append((number(head["warc-record-id"]), head.get("warc-target-uri"), size, digest, kind, number(head.get("warc-refers-to")), body.decode() if kind == "response" else None))
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r, strict=True)) for r in rows], fields)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r, strict=True)) for r in rows], fields)

    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(read, schema)
