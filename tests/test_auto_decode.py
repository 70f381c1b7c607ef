import hashlib
import time

import numpy as np

from sparkwake.functions import codec
from sparkwake.plans import catalog


def test_whole_texts_are_decoded(spark, tmp_path):
    texts = ["word " * 20_000 + "flag{end}", "short text", "é" * 30, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog.QUERIES["auto_decode"](spark, str(tmp_path)).collect()
    digests = {r.doc_id: r.digest for r in rows if r.chain == "base64|hex"}
    assert digests == {k: hashlib.md5(t.encode()).hexdigest() for k, t in enumerate(texts) if t}


def test_keys_are_searched_at_once():
    rng = np.random.default_rng(3)
    values = [bytes(rng.integers(0, 256, 4096, np.uint8)) for _ in range(400)] + [codec.xor(b"some plain words " * 200, k) for k in (0x80, 0xFF)]
    began = time.process_time()
    found = [codec.xor_search(v) for v in values]
    assert time.process_time() - began < 0.5
    plain = lambda v: next(((k, o) for k in range(1, 256) if codec.printable(o := codec.xor(v, k))), None)
    assert found[:3] + found[400:] == list(map(plain, values[:3] + values[400:])) and found[400] is not None


def test_values_leave_in_few_batches(spark):
    texts = ["68656c6c6f2f31", "68656c6c6f2f32", None, "", "\u0000\u0001"] * 3000
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)
    found = {(r.k, r.decoded) for r in codec.decoded_strings(rows, "k", depth=1).where("chain = 'hex'").collect()}
    assert found == {(k, f"hello/{k % 5 + 1}") for k, t in enumerate(texts) if t and t.startswith("68")}
