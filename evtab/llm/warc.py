"""Zstandard WARC archives: writer and validating reader.

An archive is one skippable frame that holds the dictionary, then one frame per
record. Archives are written by the tasks that hold the rows, straight to the
shared folder; the manifest that Spark keeps names the archives of successful
tasks only, so files of failed or repeated attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evtab.llm.util import landed, new_path

#: Fixed values of the formats: magic numbers of a skippable frame with a
#: dictionary and of a Zstandard frame; the revisit profile.
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1"
STAMP = "1970-01-01T00:00:00Z"

#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 64 << 20
#: Payload bytes a task looks at to build the dictionary of its archives.
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 32 << 10
READ_BYTES = 256 << 10

RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


class ArchiveError(ValueError):
    """An archive that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    name = identifier.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit carries the HTTP header but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", record_id(page_id)),
            ("WARC-Date", STAMP),
            ("WARC-Payload-Digest", "sha1:" + digest(payload)),
            ("WARC-Block-Digest", "sha1:" + digest(block)),
            ("Content-Type", "application/http;msgtype=response"),
            ("Content-Length", str(len(block)))]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~%")
                     if url.isascii() and "%" not in url and url.isprintable() and " " not in url
                     else "data:," + quote(url, safe="")))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields and block of a record; raises ``ArchiveError`` if header, lengths or digests are wrong."""
    top, gap, rest = raw.partition(b"\r\n\r\n")
    first, *lines = top.split(b"\r\n")
    if not gap or first != VERSION:
        raise ArchiveError("no WARC header")
    head: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        key = name.decode("ascii").lower()
        if not colon or key in head:
            raise ArchiveError(f"bad header line {line[:60]!r}")
        head[key] = value.strip().decode("utf-8")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in head:
            raise ArchiveError(f"missing header {name}")
    if not head["content-length"].isdigit() or len(rest) != int(head["content-length"]) + 4 \
            or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError("the block is not as long as Content-Length says")
    block = rest[:-4]
    if "warc-block-digest" in head and head["warc-block-digest"] != "sha1:" + digest(block):
        raise ArchiveError("the block differs from its digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    sizes = [x.partition(b":")[2].strip() for x in http.split(b"\r\n")[1:]
             if x.partition(b":")[0].lower() == b"content-length"]
    if not gap or len(sizes) != 1 or not sizes[0].isdigit():
        raise ArchiveError("no HTTP header with a length")
    length, kind = int(sizes[0]), head["warc-type"]
    if kind == "response":
        if length != len(payload) or head["warc-payload-digest"] != "sha1:" + digest(payload):
            raise ArchiveError("the payload differs from its length or digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in head:
        raise ArchiveError(f"bad record of type {kind}")
    uri = head.get("warc-target-uri")
    if uri is not None and uri.startswith("data:,"):
        from urllib.parse import unquote
        uri = unquote(uri[6:])
    return {"page_id": page_of(head["warc-record-id"]), "url": uri, "payload_bytes": length,
            "payload_digest": head["warc-payload-digest"].removeprefix("sha1:"), "record_type": kind,
            "refers_to": page_of(head["warc-refers-to"]) if kind == "revisit" else None, "payload": payload}


def build_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from sample records (raw content where too few to train)."""
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-DICTIONARY_BYTES:]


class Writer:
    """Writes archives to a folder; a new one once the open one is large."""

    def __init__(self, folder: str, dictionary: bytes, archive_bytes: int) -> None:
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.root, self.limit = folder, archive_bytes
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zstd = zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=True, write_checksum=True)
        self.lead = struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary
        self.out, self.done, self.n, self.size = None, [], 0, 0

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.zst"
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            self.out.write(self.lead)
            self.n, self.size = 0, len(self.lead)
        frame = self.zstd.compress(record)
        self.out.write(frame)
        self.n += 1
        self.size += len(frame)
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.root.rstrip('/')}/{self.name}", self.n, self.size))
            self.out = None


def read_frames(source) -> Iterator[bytes]:
    """Records of an open archive, one frame at a time; ``source.read(n)`` gives bytes."""
    def exactly(n: int) -> bytes:
        got = source.read(n)
        if len(got) != n:
            raise ArchiveError("the archive ends inside its first frame")
        return bytes(got)

    magic, length = struct.unpack("<II", exactly(8))
    if magic != SKIPPABLE:
        raise ArchiveError("no dictionary in front")
    dictionary = exactly(length)
    if dictionary[:4] == ZSTD_MAGIC:
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    left, frame, parts = b"", None, []
    while True:
        chunk = left or bytes(source.read(READ_BYTES))
        left = b""
        if not chunk:
            break
        if frame is None:
            frame, parts = zstd.decompressobj(), []
        try:
            parts.append(frame.decompress(chunk))
        except zstandard.ZstdError as e:
            raise ArchiveError(f"bad frame: {e}") from e
        if frame.eof:
            left, frame = frame.unused_data, None
            yield b"".join(parts)
    if frame is not None:
        raise ArchiveError("the archive ends inside a frame")


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                  min_bytes: int = 0) -> DataFrame:
    """Rows ``page_id, url, payload, refers_to``.

    ``refers_to`` is the smallest page_id with the same payload, null for that
    page itself and for payloads of fewer than ``min_bytes`` bytes. Rows that
    repeat the smallest page_id are responses too; a row with a null page_id
    revisits if any page with an id has its payload, else it is a response.
    Digests are grouped before the join, only those that occur twice are
    joined back: a hot payload is one small row against a split partition.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b"")).alias("payload"))
    key: Column = F.sha1("payload")
    first = (rows.where(F.length("payload") >= min_bytes).groupBy(key.alias("key"))
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1 AND first IS NOT NULL").select("key", "first"))
    return (rows.withColumn("key", key).join(first, "key", "left")
            .select("page_id", "url", "payload",
                    F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")),
                           F.col("first")).alias("refers_to")))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES,
                   sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Write ``page_id, url, payload, refers_to`` rows; returns the manifest ``path, records, bytes``.

    Each task trains its dictionary on the first ``sample_bytes`` of its own
    records (documented bound; it affects the size of archives only) and holds
    no more than those records in memory.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, waiting, size = None, [], 0

        def start() -> Writer:
            w = Writer(folder, build_dictionary(waiting), archive_bytes)
            for r in waiting:
                w.add(r)
            waiting.clear()
            return w

        for batch in batches:
            for cells in zip(*batch.columns, strict=True):
                record = build_record(*(c.as_py() for c in cells))
                if out is not None:
                    out.add(record)
                    continue
                waiting.append(record)
                size += len(record)
                if size >= sample_bytes:
                    out = start()
        if waiting:
            out = start()
        if out is not None:
            out.close()
            path, n, size = zip(*out.done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(n, pa.int64()),
                                              pa.array(size, pa.int64())], names=["path", "records", "bytes"])

    return rows.select("page_id", "url", "payload", "refers_to").mapInArrow(
        run, "path string, records long, bytes long")


def read_archives(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """Records of the archives in ``manifest`` (``path, records``), every one validated.

    A wrong frame, header, length, digest or number of records fails the task.
    """
    names = [x.split(" ")[0] for x in RECORD.split(", ")] + ["payload"] * payload
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in names], names=names)

        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, name = fs.FileSystem.from_uri(path)
                rows, n, size = [], 0, 0
                with where.open_input_stream(name, compression=None) as source:
                    for raw in read_frames(source):
                        row = parse_record(raw)
                        n += 1
                        size += len(raw) if payload else 200
                        rows.append(row if payload else {k: row[k] for k in names})
                        if size >= 8 << 20:
                            yield out(rows)
                            rows, size = [], 0
                if n != records:
                    raise ArchiveError(f"{path} has {n} records; the manifest says {records}")
                if rows:
                    yield out(rows)

    return manifest.select("path", "records").mapInArrow(run, RECORD + (", payload binary" if payload else ""))


def archive_round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, **names: str) -> DataFrame:
    """Write every page to archives, read them back: one row per record.

    A null html is an empty payload; a null url gives a record without target;
    repeated rows give repeated records; an empty table gives no archive and no
    row; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    manifest = landed(write_archives(with_revisits(pages, min_bytes=min_bytes, **names), folder), "warc-manifest")
    n = max(1, min(manifest.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return read_archives(manifest.repartition(n))
