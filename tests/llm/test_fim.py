"""Fill-in-middle against regular expressions, block and checkpoint borders, and exact restoring."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwake.llm import fim


def plain(doc_id, text, seed=1):
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "", re.S)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, how, which = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    low, high = sorted((a % (len(tokens) + 1), b % (len(tokens) + 1)))
    if not text or re.search("<[PSM]>", text) or how % 100 >= 90:
        return len(tokens), "plain", None, None, text or ""
    p, m, s = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    if which % 100 < 20:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


letters = st.text(st.sampled_from("abZ é汉😀\n<>PSM.1"), max_size=80)


@settings(deadline=None, max_examples=300)
@given(st.one_of(st.none(), st.integers(-5, 400)), letters, st.integers(1, 9), st.integers(1, 40))
def test_every_border(doc_id, text, step, block):
    whole, fim._BLOCK = fim._BLOCK, block
    try:
        got = fim.write(doc_id, text.encode(), step=step)
    finally:
        fim._BLOCK = whole
    assert (*got[:4], got[4].decode()) == plain(doc_id, text)


@settings(deadline=None, max_examples=100)
@given(letters, st.integers(1, 7))
def test_locate_each_cut(text, step):
    index, tokens = fim.Checkpoints(text.encode(), step), re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    assert index.n == len(tokens)
    for cut in range(len(tokens) + 1):
        before = "".join(tokens[:cut])
        assert index.locate(cut) == (len(before.encode()), len(before))


def test_rows(spark):
    texts = [None, "", "a", "one two  three", "has <P> in it", "ends in <", ">starts", "汉字 und Wörter 😀", "<S", "word " * 300_000, "x" * 3_000_000, "é" * 400_000]
    rows = [(k + 11 * j, t, "f", 1) for j in range(4) for k, t in enumerate(texts[: 9 if j else None])] + [(None, "no id here", "f", 1), (1, "tie", "f", 1), (1, "tie", "f", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n long")
    found = fim.transform(docs)
    got = found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restore(found["output"], found["form"]).alias("back")).collect()
    assert sorted(tuple(r)[:6] for r in got if r.doc_id is not None) == sorted((i, *plain(i, t)) for i, t, _, _ in rows if i is not None)
    assert sorted((str(r.doc_id), r.back) for r in got) == sorted((str(i), t or "") for i, t, _, _ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).count() == 0
