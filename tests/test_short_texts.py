import base64

import pytest
from pyspark.sql import functions as F

from sparkwake.functions import codec
from sparkwake.plans import catalog

TEXTS = [None, "", "a", "\n", "\x00", " ", "ab", "\u00e9", "abc", "abcd", "====", "some words of text " * 99]


@pytest.mark.parametrize("name", ["decode_base64", "decode_hex"])
def test_every_text_is_decoded(spark, tmp_path, name):
    import duckdb

    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert {tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()} == set(con.execute(catalog.ORACLE_SQL[name]).fetchall())


@pytest.mark.parametrize(("step", "encode"), [("base64", base64.b64encode), ("hex", lambda t: t.hex().encode())])
def test_short_inputs(spark, step, encode):
    """Only what is known to be encoded may be short; built-in functions and the decoders in chains agree on it."""
    plain = [t.encode() for t in TEXTS if t is not None]
    odd = [b"Q", b"Q=", b"=", b"====", b"4", b"zz", b" ", b"\n\n"]
    rows = spark.createDataFrame([(encode(t),) for t in plain] + [(t,) for t in odd], "t binary")
    got = rows.select("t", codec.decoded(F.col("t"), step, short=True).alias("b"), codec.decoded(F.col("t"), step).alias("guarded")).collect()
    assert [bytes(r.b) for r in got[: len(plain)]] == plain

    def one(t, short):
        try:
            return codec.apply_chain(t, step, short=short)
        except ValueError:
            return None

    for r in got:
        t = bytes(r.t)
        assert (None if r.b is None else bytes(r.b)) == one(t, True) and (None if r.guarded is None else bytes(r.guarded)) == one(t, False), t
    assert all(r.guarded is None for r in got if len(r.t) < 4)
