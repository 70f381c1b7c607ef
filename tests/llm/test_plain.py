"""The parts of the operators that need no Spark."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwake.llm import ann, decontam, htmltext, licenses, neardup, packing, quality, toxicity, warc
from sparkwake.llm.common import WordHasher


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_plan_is_a_packing(items):
    counts = Counter(items)
    runs, n = packing.plan(counts, 50)
    held, seen = defaultdict(list), Counter()
    for length, _, m, first, each, offset in runs:
        seen[length] += m
        for i in range(m):
            held[first + i // each].append((offset + i % each * length, length))
    assert seen == counts and sorted(held) == list(range(n))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 50
    assert packing.lower_bound(counts, 50) <= n <= packing.plan(counts, 50, reduce=False)[1] + 1


def _best(items, capacity):
    """The least number of sequences, by search."""
    best = [len(items)]
    items = sorted(items, reverse=True)

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best[0]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 12), max_size=8))
def test_reduction_loses_nothing(items):
    p = packing._Plan(dict(Counter(items)), 12)
    p.reduce()
    left = [s for s, n in p.left.items() for _ in range(n)]
    assert p.sequences + _best(left, 12) == _best(items, 12)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet="ab'.,!?<|ÉéΣ́ \n　İ12", max_size=30), max_size=6))
def test_ids_of_words_are_ids_of_texts(texts):
    tokenizers = pytest.importorskip("tokenizers")
    of = tokenizers.Tokenizer.from_file(packing.vocabulary())
    texts = [*texts, "a<|endoftext|>b, <|ENDOFTEXT|>", "", "It's"]
    assert packing.WordTokenizer(packing.vocabulary()).encode(texts) == [np.array(of.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_shingles():
    h = WordHasher()
    assert len(neardup.shingles("", h)) == len(neardup.shingles(" \n", h)) == 0
    assert len(neardup.shingles("a B", h)) == 1 and (neardup.shingles("a B", h) == neardup.shingles("A b", h)).all()
    assert len(neardup.shingles("a b c d e a b c d e a", h)) == 5
    assert (neardup.shingles("É x", h) != neardup.shingles("é x", h)).any()  # A-Z only


@given(st.binary(max_size=200), st.integers(0, 10**12))
def test_warc_record_round_trip(payload, number):
    found = warc.parse(warc.record(number, "http://x/a b\r\nX: y", payload))
    assert (found["page_id"], found["payload"], found["payload_bytes"], found["record_type"]) == (number, payload, len(payload), "response")
    again = warc.parse(warc.record(number + 1, None, payload, number, True))
    assert (again["refers_to"], again["payload_bytes"], again["payload"]) == (number, len(payload), b"")


def test_warc_archive(tmp_path):
    path = str(tmp_path / "a.warc.zst")
    rows = [warc.record(k, f"http://x/{k}", b"payload %d " % k * 50) for k in range(40)]
    assert warc._write_archive(path, iter(rows))[0] == 40
    assert (tmp_path / "a.warc.zst").read_bytes()[:4] == b"\x5d\x2a\x4d\x18"
    got = list(warc.read_archive(path))
    assert [f["page_id"] for _, f in got] == list(range(40))
    data = (tmp_path / "a.warc.zst").read_bytes()
    (tmp_path / "b.warc.zst").write_bytes(data[:-5])
    with pytest.raises(ValueError):
        list(warc.read_archive(str(tmp_path / "b.warc.zst")))


def test_main_text():
    page = '<html><head><title>t</title></head><body><nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>One<br>two <a>l</a>.<div class="ad">Buy</div><p>Short.<script>"</p>"</script></article><section id=comments><p>Nice</p></section><footer>F</footer>'
    assert htmltext.main_text(page) == "T & U\n\nOne two l.\n\nShort."
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<script>x") == ""


@settings(deadline=None)
@given(st.text(alphabet="<>/p!-divabr=\"'& ;#", max_size=200))
def test_any_html_is_read(page):
    htmltext.main_text(page)


def test_anchors_cover_templates():
    notices = [licenses.words_of(x) for xs in licenses.TEMPLATES.values() for x in xs]
    chosen = set(licenses.anchors(notices))
    for n in notices:
        s = licenses.shingles_of(n)
        assert 100 * sum(not set(x.split()) & chosen for x in s) < licenses.PERCENT * len(s)


def test_lcs_and_leak():
    text = "alpha beta the gamma delta of epsilon zeta. eta theta iota kappa."
    items = decontam.Items([1], [text], decontam.Settings())
    words = decontam.words_of(text)
    assert items.lcs_length(0, words) == len(words) == len(items.lcs_places(0, words))
    assert items.leak(0, [b"x"] * 9 + words + [b"y"] * 9)[2:] == (9, 9 + len(words))
    reworded = [b"new" if k in (1, 6) else w for k, w in enumerate(words)]
    assert items.leak(0, reworded) and not items.leak(0, words[:6]) and not items.leak(0, words[::-1])


def test_index_finds_neighbours():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 24)) * rng.uniform(0.5, 2, (3000, 1))
    ids, norm = np.arange(3000), float(np.sqrt((x**2).sum(1).max())) * (1 + 1e-12)
    q, found, score, _ = ann.Index(ids, x, norm, ann.Settings(projections=75)).search(ids[:40], x[:40])
    hit = 0
    for k in range(40):
        s = x @ x[k]
        s[k] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & set(found[q == k]))
    assert hit >= 0.9 * 800
    few = ann.Index(ids[:5], x[:5], norm, ann.Settings()).search(ids[:1], x[:1])
    assert sorted(few[1]) == [1, 2, 3, 4]


def test_ftrl_learns_and_is_sparse():
    f = toxicity.Features(16)
    texts = [("you idiot go away " if k % 4 == 0 else "") + f"word{k % 17} some text number{k % 5}" for k in range(400)]
    examples = [(f.pairs([t])[1], int(k % 4 == 0)) for k, t in enumerate(texts)]
    m = toxicity.ftrl(examples, toxicity.Settings(bits=16))
    table = m.table()
    assert all((table[i].sum() + m.bias > 0) == bool(y) for i, y in examples) and len(m.index) < 100
    one = toxicity.ftrl([(np.array([1]), 0)] * 3, toxicity.Settings(bits=16))
    assert len(one.index) == 0 and one.bias < -10


def test_features_of_texts_do_not_depend_on_neighbours():
    f = toxicity.Features(18)
    texts = ["a b c d", "", "é, b!c", "a b c d"]
    doc, feature = f.pairs(texts)
    for k, t in enumerate(texts):
        assert set(feature[doc == k]) == set(toxicity.Features(18).pairs([t])[1])


def test_co_training_without_labels():
    none = [np.zeros((0, 3)), np.zeros((0, 2))]
    assert quality.co_train(none, np.zeros(0), None, quality.Settings()).score([np.zeros((2, 3)), np.zeros((2, 2))]).tolist() == [1.0, 1.0]
    assert zlib.crc32(b"1") % 5 in range(5) and len(quality.text_view("")) == len(quality.text_view("A b\n!"))
