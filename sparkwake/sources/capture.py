"""Captures (pcap and pcapng) as DataFrames of packets, in batch and as streams.

A capture is read in byte ranges, each by a task of its own. A range owns the records that begin in it. It finds its
first one by looking for a chain of plausible headers, from `BACK` bytes before its border on (further than a record
reaches, so that a capture within a packet's payload can't be taken for the outer one), and it holds the place where it
ends against what the next range will find; they must meet, or reading fails. The blocks of pcapng are told by their
lengths, which stand before and behind; sections and interfaces are gathered by a first pass over all ranges.

A record whose length can't be right (over MAX_RECORD) is passed over: reading goes on at the next chain.
"""

from __future__ import annotations

import io
import ipaddress
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, file_us long, offset long, ts timestamp, caplen long, origlen long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, flags int, seq long, ack long, window int, payload binary, src_mac binary, dst_mac binary, vlan int, ttl int, ip_id int"
MAX_RECORD, BACK, SPLIT = 1 << 26, 1 << 20, 1 << 27
#: First bytes of a file: byte order and parts of a second.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
_SECTION = 0x0A0D0D0A


def decode_ip(data: bytes) -> dict | None:
    """Addresses, transport and payload of an IP packet; None if it is broken or of another transport."""
    if len(data) < 20:
        return None
    version = data[0] >> 4
    if version == 4:
        head, total = (data[0] & 15) * 4, struct.unpack_from(">H", data, 2)[0]
        if head < 20 or len(data) < head:
            return None
        kind, ttl, ip_id = data[9], data[8], struct.unpack_from(">H", data, 4)[0]
        src, dst = ("%d.%d.%d.%d" % tuple(data[k : k + 4]) for k in (12, 16))
        if struct.unpack_from(">H", data, 6)[0] & 0x1FFF:
            return None  # a later fragment
        body = data[head : max(total, head) if total else len(data)]
    elif version == 6 and len(data) >= 40:
        kind, ttl, ip_id = data[6], data[7], None
        src, dst = (str(ipaddress.IPv6Address(data[k : k + 16])) for k in (8, 24))
        body = data[40 : 40 + struct.unpack_from(">H", data, 4)[0]]
        while kind in (0, 43, 60) and len(body) >= 8:
            kind, body = body[0], body[(body[1] + 1) * 8 :]
    else:
        return None
    out = {"src_ip": src, "dst_ip": dst, "ttl": ttl, "ip_id": ip_id, "src_port": 0, "dst_port": 0, "flags": None, "seq": None, "ack": None, "window": None}
    if kind == 6 and len(body) >= 20:
        sp, dp, seq, ack, off, flags, window = struct.unpack_from(">HHIIBBH", body)
        return out | {"protocol": "tcp", "src_port": sp, "dst_port": dp, "seq": seq, "ack": ack, "flags": flags, "window": window, "payload": body[(off >> 4) * 4 :]}
    if kind == 17 and len(body) >= 8:
        sp, dp, size = struct.unpack_from(">HHH", body)
        return out | {"protocol": "udp", "src_port": sp, "dst_port": dp, "payload": body[8 : max(8, size)]}
    if kind in (1, 58) and len(body) >= 4:
        return out | {"protocol": "icmp", "payload": body}  # header included
    return None


def decode_frame(linktype: int, data: bytes) -> dict | None:
    """A link-layer frame; Ethernet (with any VLAN tags; the outer id is kept), raw IP, null and Linux cooked."""
    link = {"src_mac": None, "dst_mac": None, "vlan": None}
    if linktype in (12, 101):
        found = decode_ip(data)
    elif linktype == 0:
        found = decode_ip(data[4:])
    elif linktype == 113:
        found = decode_ip(data[16:]) if len(data) >= 16 and data[14:16] in (b"\x08\x00", b"\x86\xdd") else None
    elif linktype == 1 and len(data) >= 14:
        link |= {"dst_mac": data[:6], "src_mac": data[6:12]}
        at, kind = 14, data[12:14]
        while kind in (b"\x81\x00", b"\x88\xa8", b"\x91\x00") and len(data) >= at + 4:
            link["vlan"] = link["vlan"] if link["vlan"] is not None else struct.unpack_from(">H", data, at)[0] & 0x0FFF
            kind, at = data[at + 2 : at + 4], at + 4
        found = decode_ip(data[at:]) if kind in (b"\x08\x00", b"\x86\xdd") else None
    else:
        found = None
    return found and found | link


@dataclass
class Record:
    offset: int
    micros: int | None
    original: int
    linktype: int
    data: bytes


@dataclass
class Section:
    """What blocks of pcapng mean from some place on: byte order, and link type and time units of each interface."""

    order: str = "<"
    interfaces: list[tuple[int, int]] = field(default_factory=list)


class _Window:
    """Bytes of a file by place, read in large pieces."""

    def __init__(self, f: BinaryIO, size: int, piece: int = 1 << 20):
        self.f, self.size, self.piece, self.low, self.bytes = f, size, piece, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """n bytes from at on; fewer at the file's end."""
        if not self.low <= at <= at + n <= self.low + len(self.bytes):
            self.f.seek(at)
            self.low, self.bytes = at, self.f.read(min(max(n, self.piece), max(self.size - at, 0)))
        return self.bytes[at - self.low : at - self.low + n]


class Pcap:
    """The records of a pcap file by place."""

    first = 24

    def __init__(self, window: _Window, sections: list | None = None):
        self.w = window
        head = window.get(0, 24)
        self.order, self.scale = MAGIC[head[:4]]
        self.linktype = struct.unpack(f"{self.order}I", head[20:24])[0] & 0xFFFF if len(head) == 24 else 0
        self.most = max(struct.unpack(f"{self.order}I", head[16:20])[0], 1 << 18) if len(head) == 24 else 0
        first = window.get(24, 16)
        self.began = struct.unpack(f"{self.order}I", first[:4])[0] if len(first) == 16 else 0

    def _header(self, at: int) -> tuple[int, int, int, int] | None:
        head = self.w.get(at, 16)
        return struct.unpack(f"{self.order}IIII", head) if len(head) == 16 else None

    def _plausible(self, seconds: int, part: int, size: int, original: int) -> bool:
        return 0 <= size <= min(self.most, MAX_RECORD) and size <= original and 0 < original <= 1 << 24 and part < 1_000_000 * self.scale and abs(seconds - self.began) < 10**9

    def _chained(self, at: int, least: int) -> bool:
        """Whether plausible headers follow each other from at on, as far as least, or to the file's end."""
        n = 0
        while at < least or n < 4:
            head = self._header(at)
            if head is None:
                return at == self.w.size or n >= 4
            if not self._plausible(*head):
                return False
            at, n = at + 16 + head[2], n + 1
        return True

    def sync(self, low: int, least: int = 0) -> int:
        """The first place from low on at which a chain of records begins; the file's size if there is none."""
        while low + 16 <= self.w.size:
            data = self.w.get(low, min(1 << 20, self.w.size - low))
            raw = np.frombuffer(data, np.uint8)
            words = np.lib.stride_tricks.sliding_window_view(raw, 16)
            kind = np.dtype(f"{self.order}u4")
            part, size, original = (np.ascontiguousarray(words[:, k : k + 4]).view(kind)[:, 0] for k in (4, 8, 12))
            good = (original > 0) & (size <= min(self.most, MAX_RECORD)) & (size <= original) & (part < 1_000_000 * self.scale)
            for k in np.flatnonzero(good):
                if self._chained(low + int(k), least):
                    return low + int(k)
            low += len(words)
        return self.w.size

    def walk(self, at: int, high: int, problems: list[str], bodies: bool = True) -> Iterator[Record]:
        """The records that begin from at (a record's place) to before high; `end` is where the next one begins."""
        self.end = at
        while self.end < high:
            at = self.end
            head = self._header(at)
            if head is None:
                if at < self.w.size:
                    problems.append("the last record is cut off")
                return
            seconds, part, size, original = head
            if size > MAX_RECORD:
                problems.append("a record is too large")
                self.end = self.sync(at + 1)
                continue
            if at + 16 + size > self.w.size:
                problems.append("the last record is cut off")
                return
            self.end = at + 16 + size
            yield Record(at, seconds * 1_000_000 + part // self.scale, original, self.linktype, self.w.get(at + 16, size) if bodies else b"")


class Pcapng:
    """The packets of a pcapng file by place, given the sections and interfaces before it."""

    first = 0

    def __init__(self, window: _Window, sections: list | None = None):
        """sections: [place, type, body in hexadecimal] of the blocks that begin sections and define interfaces, in order."""
        self.w, self.sections = window, sections or []

    def _size(self, at: int) -> tuple[int, int, str] | None:
        """Type, length and byte order of the block at a place; None if there is none whose lengths agree."""
        head = self.w.get(at, 12)
        if len(head) < 12:
            return None
        orders = (("<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"),) if head[:4] == b"\x0a\x0d\x0d\x0a" else (self.order, "<" if self.order == ">" else ">")
        for order in orders:
            kind, size = struct.unpack(f"{order}II", head[:8])
            if size >= 12 and size % 4 == 0 and at + size <= self.w.size and (size <= 1 << 16 or size <= MAX_RECORD):
                if self.w.get(at + size - 4, 4) == head[4:8]:
                    return kind, size, order
        return None

    order = "<"

    def _chained(self, at: int, least: int) -> bool:
        n = 0
        while at < least or n < 4:
            if at == self.w.size:
                return n > 0
            if (block := self._size(at)) is None or n == 0 and block[0] not in (_SECTION, 1, 2, 3, 4, 5, 6, 10):
                return False
            at, n = at + block[1], n + 1
        return True

    def sync(self, low: int, least: int = 0) -> int:
        for at in range(-(-low // 4) * 4, self.w.size - 11, 4):
            if self._chained(at, least):
                return at
        return self.w.size

    def _state(self, at: int) -> Section:
        now = Section()
        for place, kind, body in self.sections:
            if place >= at:
                break
            now = _defined(now, kind, bytes.fromhex(body))
        return now

    def blocks(self, at: int, high: int, problems: list[str]) -> Iterator[tuple[int, int, int]]:
        self.end = at
        while self.end < high:
            at = self.end
            block = self._size(at)
            if block is None:
                if at < self.w.size:
                    problems.append("a block is broken" if at + 12 < self.w.size and self.sync(at + 4) < self.w.size else "the last block is cut off")
                    self.end = self.sync(at + 4)
                    if self.end < self.w.size:
                        continue
                return
            self.order = block[2]
            self.end = at + block[1]
            yield at, block[0], block[1]

    def walk(self, at: int, high: int, problems: list[str], bodies: bool = True) -> Iterator[Record]:
        now = self._state(at)
        for place, kind, size in self.blocks(at, high, problems):
            if kind in (_SECTION, 1):
                now = _defined(now, kind, self.w.get(place + 8, size - 12))
                if (place, kind) not in {(x[0], x[1]) for x in self.sections[-8:]} and not bodies:
                    self.sections.append([place, kind, self.w.get(place + 8, size - 12).hex()])
            elif kind == 6 and size >= 32:
                n, high_, low, caplen, original = struct.unpack(f"{now.order}IIIII", self.w.get(place + 8, 20))
                if n < len(now.interfaces):
                    linktype, per_second = now.interfaces[n]
                    yield Record(place, ((high_ << 32) | low) * 1_000_000 // per_second, original, linktype, self.w.get(place + 28, min(caplen, size - 32)) if bodies else b"")
            elif kind == 3 and size >= 16 and now.interfaces:
                original = struct.unpack(f"{now.order}I", self.w.get(place + 8, 4))[0]
                yield Record(place, None, original, now.interfaces[0][0], self.w.get(place + 12, min(original, size - 16)) if bodies else b"")


def _defined(now: Section, kind: int, body: bytes) -> Section:
    """The state behind a block that begins a section or defines an interface."""
    if kind == _SECTION:
        return Section("<" if body[:4] == b"\x4d\x3c\x2b\x1a" else ">", [])
    if len(body) < 8:
        return now
    per_second, at = 1_000_000, 8
    while at + 4 <= len(body):
        code, n = struct.unpack_from(f"{now.order}HH", body, at)
        if code == 9 and n and at + 4 < len(body):
            per_second = 2 ** (body[at + 4] & 127) if body[at + 4] & 128 else 10 ** body[at + 4]
        if code == 0:
            break
        at += 4 + n + -n % 4
    return Section(now.order, [*now.interfaces, (struct.unpack_from(f"{now.order}H", body)[0], per_second)])


def opened(f: BinaryIO, size: int, sections: list | None = None) -> Pcap | Pcapng | None:
    """The capture in a seekable file; None if it is none."""
    w = _Window(f, size)
    magic = w.get(0, 4)
    if magic in MAGIC and size >= 24:
        return Pcap(w)
    return Pcapng(w, sections) if magic == b"\x0a\x0d\x0d\x0a" else None


def started(capture: Pcap | Pcapng) -> int:
    """The time of a capture's first record in microseconds; 0 if it has none."""
    first = next(capture.walk(capture.first, capture.w.size, [], False), None)
    return (first.micros or 0) if first else 0


def records(f: BinaryIO, size: int, low: int = 0, high: int | None = None, sections: list | None = None, back: int = BACK, problems: list[str] | None = None) -> Iterator[Record]:
    """The records that begin in a byte range of a seekable file; what was wrong is added to problems."""
    problems = [] if problems is None else problems
    capture, high = opened(f, size, sections), size if high is None else high
    if capture is None:
        problems.append("no capture")
        return
    at = border(capture, low, back)
    yield from capture.walk(at, high, problems)
    if high < size and at < high and capture.end != (meets := border(capture, high, back)):
        raise ValueError(f"records do not meet at byte {high}: one range ends at {capture.end}, the next begins at {meets}; read the file in one range")


def border(capture: Pcap | Pcapng, low: int, back: int = BACK) -> int:
    """The place of the first record from low on."""
    if low <= capture.first:
        return capture.first
    since = low - back
    at = capture.first if since <= capture.first else capture.sync(since, low)
    if at >= low:
        return at
    for _ in capture.walk(at, low, [], False):
        pass
    return capture.end


_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "timestamp": pa.timestamp("us", "UTC")}
KIND = pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))])


def packet(path: str, file_us: int, r: Record) -> tuple | None:
    """A row of SCHEMA (ts in microseconds), or None for a record that holds no packet."""
    p = decode_frame(r.linktype, r.data)
    return p and (path, file_us, r.offset, r.micros, len(r.data), r.original, p["src_ip"], p["dst_ip"], p["src_port"], p["dst_port"], p["protocol"], p["flags"], p["seq"], p["ack"], p["window"], p["payload"], p["src_mac"], p["dst_mac"], p["vlan"], p["ttl"], p["ip_id"])


def batches(rows: Iterator[tuple], kind: pa.Schema, most: int = 10_000, most_bytes: int = 1 << 25) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most so many rows, and not many more payload bytes."""
    at = kind.get_field_index("payload")
    some: list[tuple] = []
    size = 0
    for r in rows:
        some.append(r)
        size += len(r[at])
        if len(some) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some, strict=True), kind, strict=True)], schema=kind)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some, strict=True), kind, strict=True)], schema=kind)


def packets(f: BinaryIO, size: int, path: str = "", **how) -> Iterator[tuple]:
    """Rows of SCHEMA of the records in a byte range of a file."""
    capture = opened(f, size)
    file_us = started(capture) if capture else 0
    for r in records(f, size, **how):
        if row := packet(path, file_us, r):
            yield row


def decode(contents: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """index (of the record) and SCHEMA of the packets of captures that come as rows of bytes."""
    kind = pa.schema([pa.field("index", pa.int64()), *KIND])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in parts:
                for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                    data = content.as_py() or b""
                    file_us = 0
                    for n, r in enumerate(records(io.BytesIO(data), len(data))):
                        file_us = file_us if n else r.micros or 0  # as started() tells
                        if row := packet(name, file_us, r):
                            yield n, *row

        yield from batches(rows(), kind)

    return contents.select(contents[path].cast("string").alias("path"), contents[content].alias("content")).mapInArrow(run, f"index long, {SCHEMA}")


def summary(contents: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, sha256, records, packets, unread (records that hold no packet), first, last, problem of each capture."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            out = []
            for data in b.column("content").to_pylist():
                problems: list[str] = []
                n, found, first, last, data = 0, 0, None, None, data or b""
                for r in records(io.BytesIO(data), len(data), problems=problems):
                    n += 1
                    if decode_frame(r.linktype, r.data):
                        found += 1
                        if r.micros is not None:
                            first, last = r.micros if first is None else min(first, r.micros), r.micros if last is None else max(last, r.micros)
                out.append({"records": n, "packets": found, "unread": n - found, "first_us": first, "last_us": last, "problem": problems[0] if problems else None})
            kind = pa.schema([("records", pa.int64()), ("packets", pa.int64()), ("unread", pa.int64()), ("first_us", pa.int64()), ("last_us", pa.int64()), ("problem", pa.string())])
            t = pa.RecordBatch.from_pylist(out, kind)
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("sha256"), *t.columns], names=["path", "sha256", *kind.names])

    rows = contents.select(contents[path].cast("string").alias("path"), F.sha2(contents[content], 256).alias("sha256"), contents[content].alias("content"))
    return rows.mapInArrow(run, "path string, sha256 string, records long, packets long, unread long, first_us long, last_us long, problem string")


def bounds(packets_: DataFrame) -> DataFrame:
    """path, packets, bytes, first_us, last_us of each capture, from its packets, however they were read."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return packets_.groupBy("path").agg(F.count(F.lit(1)).alias("packets"), F.sum("caplen").alias("bytes"), F.min(at).alias("first_us"), F.max(at).alias("last_us"))


def _files(path: str) -> list[tuple[str, int]]:
    """Captures at a path: a file, or those of a folder, with their sizes."""
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = files.get_file_info(at)
    found = files.get_file_info(fs.FileSelector(at)) if info.type == fs.FileType.Directory else [info]
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File)


def _open(path: str, root: str) -> BinaryIO:
    from pyarrow import fs

    files = fs.FileSystem.from_uri(root)[0] if "://" in root else fs.LocalFileSystem()
    return files.open_input_file(path)


@dataclass
class _Range(InputPartition):
    path: str
    low: int
    high: int
    size: int
    sections: list


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.back = options["path"], int(options.get("back", BACK))
        self.split, self.sections = int(options.get("split", SPLIT)), json.loads(options.get("sections", "{}"))

    def partitions(self) -> list[_Range]:
        out = []
        for path, size in _files(self.path):
            split = self.split
            if path not in self.sections:
                with _open(path, self.path) as f:
                    split = size if f.read(4) == b"\x0a\x0d\x0d\x0a" else split  # its interfaces aren't known
            out += [_Range(path, low, min(low + split, size), size, self.sections.get(path, [])) for low in range(0, size, max(split, 1))]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        with _open(partition.path, self.path) as f:
            yield from batches(packets(f, partition.size, partition.path, low=partition.low, high=partition.high, sections=partition.sections, back=self.back), KIND)


class _StreamReader(DataSourceStreamReader):
    """Offset: for each file [bytes, packets], both up to a record's end. Files may grow, and more may come.

    The driver walks over new headers to find records that are whole. `max_bytes` bounds a batch, `max_packets` the whole
    stream. While the place that a stream has reached is known to Spark alone, which may be so once after a restart, a
    batch takes all there is; `begin` says that there is no checkpoint yet, so that the first batch is bounded as well.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.most, self.all = int(options.get("max_bytes", 1 << 40)), int(options.get("max_packets", 1 << 62))
        self.split = int(options.get("split", SPLIT))
        self.now: dict[str, list[int]] = {}
        self.sections: dict[str, list] = {}
        self.known = options.get("begin", "false").lower() == "true"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        left = self.most if self.known else 1 << 62
        count = sum(n for _, n in self.now.values())
        for path, size in _files(self.path):
            at, n = self.now.get(path, [0, 0])
            if size <= at or left <= 0 or count >= self.all:
                continue
            with _open(path, self.path) as f:
                sections = self.sections.setdefault(path, [])
                capture = opened(f, size, sections)
                if capture is None:
                    continue
                capture.sections = sections
                end = max(at, capture.first)
                for r in capture.walk(end, size, [], False):
                    end, n, count, left = capture.end, n + 1, count + 1, left - (capture.end - r.offset)
                    if left <= 0 or count >= self.all:
                        break
            self.now[path] = [end, n]
        self.known = True
        return {k: list(v) for k, v in self.now.items()}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        out = []
        for path, (high, n) in sorted(end.items()):
            low = start.get(path, [0, 0])[0]
            self.now[path] = max(self.now.get(path, [0, 0]), [high, n])
            for a in range(low, high, self.split):
                out.append(_Range(path, a, min(a + self.split, high), high, list(self.sections.get(path, []))))
        self.known = True
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        """size is where whole records end; a range that begins a batch begins at a record."""
        with _open(partition.path, self.path) as f:
            if not partition.sections and f.read(4) == b"\x0a\x0d\x0d\x0a":
                capture = opened(f, partition.size, [])
                for _ in capture.walk(0, partition.low, [], False):
                    pass
                partition.sections = capture.sections
            yield from batches(packets(f, partition.size, partition.path, low=partition.low, high=partition.high, sections=partition.sections), KIND)

    def commit(self, end: dict) -> None:
        pass


class CaptureSource(DataSource):
    """Format `capture`: a capture or a folder of captures. Options of batches: split (bytes of a range), back; of streams:
    max_bytes, max_packets, begin."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(dict(self.options))


def sections_of(spark: SparkSession, path: str, split: int = SPLIT, back: int = BACK) -> dict[str, list]:
    """Places and bodies of the blocks that begin sections and define interfaces, by file, for the pcapng files at a path."""
    ranges = [(p, low, min(low + split, size), size) for p, size in _files(path) for low in range(0, size, split)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for r in b.to_pylist():
                with _open(r["path"], path) as f:
                    capture = opened(f, r["size"])
                    if not isinstance(capture, Pcapng):
                        continue
                    at = border(capture, r["low"], back)
                    found = [(r["path"], [place, kind, capture.w.get(place + 8, size - 12).hex()]) for place, kind, size in capture.blocks(at, r["high"], []) if kind in (_SECTION, 1)]
                    if found or not r["low"]:
                        yield pa.RecordBatch.from_pylist([{"path": p, "place": x[0], "kind": x[1], "body": x[2]} for p, x in found], pa.schema([("path", pa.string()), ("place", pa.int64()), ("kind", pa.int64()), ("body", pa.string())]))

    if not ranges:
        return {}
    df = spark.createDataFrame(ranges, "path string, low long, high long, size long").repartition(min(len(ranges), 10_000), "path", "low")
    out: dict[str, list] = {}
    for r in df.mapInArrow(run, "path string, place long, kind long, body string").orderBy("path", "place").collect():
        out.setdefault(r["path"], []).append([r["place"], r["kind"], r["body"]])
    return out


def read_capture(spark: SparkSession, path: str, split: int = SPLIT, back: int = BACK) -> DataFrame:
    """Packets of the captures at a path, by ranges of `split` bytes; rows don't depend on it."""
    spark.dataSource.register(CaptureSource)
    sections = sections_of(spark, path, split, back)
    return spark.read.format("capture").option("split", split).option("back", back).option("sections", json.dumps(sections)).load(path)


def stream_capture(spark: SparkSession, path: str, **options) -> DataFrame:
    """Packets of a capture or a folder of captures that grow and rotate, as a stream."""
    spark.dataSource.register(CaptureSource)
    reader = spark.readStream.format("capture")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)
