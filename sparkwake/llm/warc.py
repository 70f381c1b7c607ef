"""WARC archives compressed record by record with a Zstandard dictionary of their own.

Each archive file begins with a skippable frame (magic 0x184D2A5D) that holds a dictionary trained from a bounded
sample of the archive's records, drawn from all of them; then every record is a Zstandard frame of its own,
compressed with that dictionary, so that one record can be read by its offset alone. For that an archive's records
wait in a file beside it, each compressed by itself, until the last one has been seen. Records of equal payloads (digest and length) of
at least `min_revisit_bytes` bytes are stored once: the one with the smallest id is the response, the others are
revisits that refer to it.

Rows are dealt to archives by payload digest, which a join needs anyway; adaptive execution splits a digest that
many rows share. A task writes its archive under a name of its attempt and renames it at the end, so a task run
twice or lost leaves no broken archive; the index of archives that counts is the one of the attempt that ended.

Defined results: a null payload is empty; a null url becomes the record's own urn; repeated rows each get a
record; of equal rows that share the smallest id each is a response; a row with a null id is a revisit of the
smallest id among equal payloads, and a response if all ids are null. An empty table gives no archives.
Columns besides the id, the url and the payload are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwake.llm.common import materialize, new_path

SKIPPABLE = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
ARCHIVES = "archive string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"
SAMPLE_BYTES = 2_000_000  # bound of the sample that a dictionary is trained from
SAMPLES = 512  # and of its number of records
DICT_BYTES = 65_536


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _clean(url: str | None, page_id: int | None) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url) if url else _id(page_id)[1:-1]


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """The bytes of one WARC/1.1 record. A revisit keeps the HTTP head, whose Content-Length tells the payload's size."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url, page_id)}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to)}"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record's bytes; a response's payload is held against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    f = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(f["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    number = lambda x: None if x is None or (v := x.removeprefix("<urn:x-page:").removesuffix(">")) == "null" else int(v)
    found = {"page_id": number(f["WARC-Record-ID"]), "url": f["WARC-Target-URI"], "payload_bytes": size, "payload_digest": f["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": f["WARC-Type"], "refers_to": number(f.get("WARC-Refers-To")), "payload": payload}
    if found["record_type"] == "response" and (len(payload) != size or digest(payload) != found["payload_digest"]):
        raise ValueError(f"the payload of record {f['WARC-Record-ID']} differs from its digest")
    return found


def _filesystem(path: str):
    """A pyarrow file system and the path within it; the path is one that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def dictionary(samples: list[bytes]):
    """A Zstandard dictionary of records; of their joined bytes where they are too few to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=512, d=8) if len(samples) >= 16 else zstandard.ZstdCompressionDict(b"".join(samples)[-DICT_BYTES:] or b"\0")
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICT_BYTES:] or b"\0")


class _Sample:
    """A reservoir of records, each of all seen so far with the same chance; of each its first `share` bytes at most."""

    def __init__(self, sample_bytes: int):
        import random

        self.kept: list[bytes] = []
        self.seen, self.draw, self.share = 0, random.Random(7), max(1, sample_bytes // SAMPLES)

    def add(self, record: bytes) -> None:
        k = self.draw.randrange(self.seen + 1)
        self.seen += 1
        if len(self.kept) < SAMPLES:
            self.kept.append(record[: self.share])
        elif k < SAMPLES:
            self.kept[k] = record[: self.share]


def _write_archive(path: str, records: Iterator[bytes], sample_bytes: int = SAMPLE_BYTES) -> tuple[int, int]:
    """Writes records in order, with a dictionary trained from a sample of all of them."""
    import zstandard

    files, at = _filesystem(path)
    sample, count, size = _Sample(sample_bytes), 0, 0
    quick, back = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    first = next(records, None)
    if first is None:
        return 0, 0
    files.create_dir(at.rpartition("/")[0], recursive=True)
    draft, waiting = (f"{at}.{uuid.uuid4().hex}.{x}" for x in ("draft", "waiting"))
    with files.open_output_stream(waiting, compression=None) as out:
        for r in chain([first], records):
            sample.add(r)
            held = quick.compress(r)
            out.write(struct.pack("<Q", len(held)) + held)
            count += 1
    trained = dictionary(sample.kept)
    packed = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
    with files.open_output_stream(draft, compression=None) as out, files.open_input_stream(waiting, compression=None, buffer_size=1 << 20) as source:
        raw = trained.as_bytes()
        out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        size = 8 + len(raw)
        for _ in range(count):
            (n,) = struct.unpack("<Q", source.read(8))
            frame = packed.compress(back.decompress(source.read(n)))
            out.write(frame)
            size += len(frame)
    files.move(draft, at)
    files.delete_file(waiting)
    return count, size


def _whole(spark: SparkSession, folder: str) -> str:
    """folder with its scheme, as Spark resolves it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().replace("s3a://", "s3://", 1)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Writes pages as archives below folder, which all executors share; returns a row per archive."""
    folder = _whole(pages.sparkSession, folder)
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    first = base.where(F.col("size") >= min_revisit_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("sha", "size", "first")
    ready = base.join(first, ["sha", "size"], "left").select("page_id", "url", "payload", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for b in batches:
                for page_id, url, payload, first in zip(*(b.column(k) for k in ("page_id", "url", "payload", "first")), strict=True):
                    p, f = page_id.as_py(), first.as_py()
                    yield record(p, url.as_py(), payload.as_py(), f, f is not None and p != f)

        path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        count, size = _write_archive(path, records(), sample_bytes)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["archive", "records", "bytes"])

    return materialize(ready.mapInArrow(write, ARCHIVES), "warc-index")


def read_archive(path: str) -> Iterator[tuple[int, dict]]:
    """Offset and fields of each record, reading the file as a stream."""
    import zstandard

    files, at = _filesystem(path)
    with files.open_input_stream(at, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{path} has no leading dictionary frame")
        opened = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(f.read(size)))
        offset, rest = 8 + size, b""
        while True:
            one, parts = opened.decompressobj(), []
            used = 0
            while not one.eof:
                if not rest and not (rest := f.read(1 << 18)):
                    if used:
                        raise ValueError(f"{path} ends within a record")
                    return
                parts.append(one.decompress(rest))
                used += len(rest)
                rest = one.unused_data if one.eof else b""
            used -= len(rest)
            yield offset, parse(b"".join(parts))
            offset += used


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record of the archives that the rows of archives name, without the payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64())])
        for b in batches:
            for path in b.column("archive").to_pylist():
                rows: list[dict] = []
                for offset, found in read_archive(path):
                    del found["payload"]
                    rows.append(found | {"archive": path, "offset": offset})
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, archives.sparkSession.sparkContext.defaultParallelism)
    return archives.select("archive").repartition(n).mapInArrow(read, RECORDS)


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages to archives, reads them back, and returns a row per record."""
    return read_archives(write_archives(pages, folder or new_path(spark, "warc")))
