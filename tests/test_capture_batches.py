"""Packets of many small captures leave a task in batches of many."""

import struct
from types import SimpleNamespace

import pyarrow as pa

from sparkwake.sources import capture


def small(k):
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 32, k, 0, 64, 17, 0, bytes([10, 0, 0, k]), bytes([203, 0, 113, 255]))
    frame = ip + struct.pack(">HHHH", 53, 5000 + k, 12, 0) + b"data"
    return struct.pack(">IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 101) + struct.pack(">IIII", 1_700_000_000 + k, 7, len(frame), len(frame)) + frame


def test_many_captures_share_a_batch():
    """The function that decode gives to Spark, on one batch of 200 captures, one of them null."""
    held = {}

    class Contents(dict):
        def __missing__(self, name):
            return SimpleNamespace(cast=lambda _: SimpleNamespace(alias=lambda _: None), alias=lambda _: None)

        def select(self, *_):
            return SimpleNamespace(mapInArrow=lambda run, _: held.setdefault("run", run))

    capture.decode(Contents())
    b = pa.RecordBatch.from_pydict({"path": [f"p{k}" for k in range(200)], "content": [small(k) if k != 9 else None for k in range(200)]})
    out = list(held["run"](iter([b, b])))
    assert len(out) == 1
    rows = out[0].to_pylist()
    assert [r["path"] for r in rows] == [f"p{k}" for k in range(200) if k != 9] * 2
    assert {r["index"] for r in rows} == {0}
    assert [(r["src_ip"], r["dst_ip"], r["dst_port"], r["payload"]) for r in rows[:2]] == [("10.0.0.0", "203.0.113.255", 5000, b"data"), ("10.0.0.1", "203.0.113.255", 5001, b"data")]
