"""Parsers hold a few rows of an Arrow batch as Python objects, not all of them."""

import tracemalloc
from types import SimpleNamespace

import pyarrow as pa

from sparkwake.operators import dissect


def parsed(n, size):
    """What http_transactions gives of one batch of n conversations, and its peak of memory."""
    held = {}
    frame = SimpleNamespace(columns=["flow_id", "client", "server"], select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: held.setdefault("run", run)))
    dissect.http_transactions(frame)
    answer = f"HTTP/1.1 200 OK\r\nContent-Length: {size}\r\n\r\n".encode() + b"x" * size
    b = pa.RecordBatch.from_pydict({"flow_id": [f"F{k}" for k in range(n)], "client": [f"GET /{k} HTTP/1.1\r\nHost: h\r\n\r\n".encode() for k in range(n)], "server": [answer] * n})
    tracemalloc.start()
    rows = [(r["flow_id"], r["uri"], r["status"]) for out in held["run"](iter([b])) for r in out.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return rows, peak


def test_a_batch_is_not_held_as_objects(spark):
    rows, peak = parsed(4000, 10_000)
    assert rows == [(f"F{k}", f"/{k}", 200) for k in range(4000)] and peak < 20_000_000
