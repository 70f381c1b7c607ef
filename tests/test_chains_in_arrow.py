import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from sparkwake.functions import codec


def test_values_of_every_chain():
    data = [b"some text", None, b"", b"\x00\xff" * 40, b"%41%zz", b"68656c6c6f"] * 100
    for chain in ("xor:0x2a", "xor:42 | xor:7", "xor:300", "xor:zz", "url", "hex", "xor:1|hex", "rot13|xor:0x0"):
        def one(v):
            try:
                return None if v is None else codec.apply_chain(v, chain)
            except ValueError:
                return None

        steps = [x.strip() for x in chain.split("|")]
        for values in (pa.array(data, pa.binary()), pa.array(data, pa.binary())[3:77], pa.array([], pa.binary())):
            assert codec._chained(values, steps, codec.MAX_OUTPUT).to_pylist() == [one(v) for v in values.to_pylist()]


def test_a_batch_is_not_held_as_objects():
    values = pa.array([bytes([k % 256]) * 20_000 for k in range(2000)], pa.binary())
    tracemalloc.start()
    out = codec._chained(values, ["rot13"], codec.MAX_OUTPUT)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 2000 and peak < 15_000_000


def test_column(spark):
    rows = spark.createDataFrame([(1, b"abc"), (2, None), (3, b"")], "k int, b binary")
    found = rows.select("k", codec.decoded(codec.decoded(F.col("b"), "xor:0x2a"), "xor:42").alias("b")).collect()
    assert {r.k: r.b and bytes(r.b) for r in found} == {1: b"abc", 2: None, 3: b""}
