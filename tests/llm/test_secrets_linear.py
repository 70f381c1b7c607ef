"""Very long texts without spaces take linear time; weak spans against a loop over the text."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sparkwake.llm import secrets

VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
BASE64 = VALUE - set("_.=-")


def bare_keys(text):
    """Runs of 32 or more base64 characters with a digit, a capital and a small letter, and up to two `=` behind, by hand."""
    out, k = [], 0
    while k < len(text):
        if text[k] not in BASE64 or k and text[k - 1] in VALUE:
            k += 1
            continue
        end = k
        while end < len(text) and text[end] in BASE64:
            end += 1
        run = text[k:end]
        if len(run) >= 32 and any(c.isdigit() for c in run) and any(c.isupper() for c in run) and any(c.islower() for c in run):
            stop = end
            while stop < min(len(text), end + 2) and text[stop] == "=":
                stop += 1
            out.append((k, stop))
            k = stop
        else:
            k = end
    return out


def test_bare_keys_against_a_loop(spark):
    rng, texts = random.Random(1), []
    for _ in range(300):
        pieces = [rng.choice([" ", "汉", "_", "=", "==", "\n", "".join(rng.choices("abcABC019+/", k=rng.randrange(1, 50))), "a" * 40, "A1" * 20, "x" * 20 + "7Q" * 8]) for _ in range(rng.randrange(1, 9))]
        texts.append("".join(pieces))
    pattern = secrets.WEAK["key"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", secrets.places(F.col("text"), pattern, "key").alias("s"))
    got = {r.i: [(x.start, x.stop) for x in r.s] for r in rows.collect()}
    assert got == {i: bare_keys(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("name", ["one sign", "minified", "base64"])
def test_a_million_unspaced_characters(spark, name):
    rng = random.Random(2)
    minified = json.dumps([{"id": k, "name": f"n{k}", "v": [k * 7 % 13, None, True]} for k in range(40_000)], separators=(",", ":"))[:1_000_000]
    text = {"one sign": "汉" * 1_000_000, "minified": minified, "base64": "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000))}[name]
    docs = spark.createDataFrame([(1, text + " password=hunter2hunter2 user_name=admin host=db.example"), (2, "secret: abcdefghijklmno")], "doc_id long, text string").repartition(1)
    secrets.secret_spans(docs.limit(1)).collect()
    began = time.time()
    rows = {r.doc_id: r for r in secrets.secret_spans(docs).collect()}
    spent = time.time() - began
    shorter = time.time()
    secrets.secret_spans(docs.withColumn("text", F.substring("text", 1, 10_000))).collect()
    assert spent - (time.time() - shorter) < 4
    assert rows[1].n_assign == 1 and rows[2].n_assign == 1 and re.search(r"host:\d+:\d+", rows[1].spans)
