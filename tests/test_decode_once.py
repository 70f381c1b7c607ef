"""auto_decode looks at an output once, and its query makes values without a regular expression."""

import base64

from sparkwake.functions import codec
from sparkwake.plans import catalog


def test_outputs_are_looked_at_once(monkeypatch):
    seen, plain = [], codec.printable
    monkeypatch.setattr(codec, "printable", lambda data: seen.append(data) or plain(data))
    value = base64.b64encode(b"some words of text".hex().encode())
    found = codec._walked(value, 3, codec.MAX_OUTPUT)
    assert sorted(seen) == sorted([value, *(o for _, o, _ in found)])
    assert all(shown == plain(o) for _, o, shown in found) and (["base64", "hex"], b"some words of text") in codec.auto_decode(value)


def test_printable_of_long_values():
    for share in (0.84, 0.85, 0.86):
        for odd in (b"\x00", b"\x7f", b"\xff"):
            for plain in (b"a", b"\t", b"\r", b"\n", b" ", b"~"):
                for size in (100, 1000, 2000, 100_000):
                    n = int(share * size)
                    assert codec.printable(plain * n + odd * (size - n)) == (n / size > 0.85)


def test_letters_are_checked_to_the_end():
    for text, decode in ((b"QUJD" * 100, codec.un_base64), (b"4142" * 100, codec.un_hex)):
        assert decode(text) and decode(text[:-2] + b"-" + text[-1:]) is None and decode(text[:200] + b"=" + text[201:]) is None
    assert codec.un_base64(b"QQ==") == b"A" and codec.un_base64(b"====") is None and codec.un_base64(b"QQ==QQ==") is None


def test_values_are_made_without_a_regular_expression(spark, tmp_path):
    spark.createDataFrame([(1, "word " * 400)], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = catalog.QUERIES["auto_decode"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
