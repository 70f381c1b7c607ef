"""Memory of workers: small chunks of texts, and what a task took is handed back."""

import pyarrow as pa

from sparkwake.llm import common, decontam


def test_leaks_are_sought_in_small_chunks():
    b = pa.RecordBatch.from_arrays([pa.array(["word " * 60_000] * 7)], names=["text"])
    found = list(decontam._chunks(b))
    assert [len(x) for _, x in found] == [2, 2, 2, 1] and [lo for lo, _ in found] == [0, 2, 4, 6]


def test_memory_is_handed_back_behind_the_last_batch(monkeypatch):
    told = []
    monkeypatch.setattr(common, "hand_back", lambda: told.append("back"))
    assert list(common.frugal(lambda x: (told.append(b) or b for b in x))([1, 2])) == [1, 2] and told == [1, 2, "back"]
