"""Leaks by word order against trying every run, and what counts as a word."""

import math
from types import SimpleNamespace

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwake.llm import decontam


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = row
        row = [0]
        for k, y in enumerate(b):
            row.append(above[k] + 1 if x == y else max(above[k + 1], row[k]))
    return row[-1]


def held(items, i, words):
    """The largest share of item i that a run has which leaks it; 0 if none does."""
    w, best = items.words[i], 0
    span, least = math.ceil(1.5 * len(w)), math.ceil(0.6 * len(w))
    for start in range(len(words)):
        run = words[start : start + span]
        n = lcs(w, run)
        if n >= least and sum(x in run for x in items.answers[i]) >= 0.5 * len(items.answers[i]):
            best = max(best, n)
    return best / len(w)


def searched(items, words):
    split, doc, place, number = decontam._hits([" ".join(words)], items.vocabulary)
    best = {}
    for _, i, lo, hi in items.regions(doc, place, number):
        if found := items.leak(i, split[0][lo:hi]):
            best[i] = max(best.get(i, 0), found[0])
    return best


ITEMS = decontam.Items([1, 2, 3], ["a b c d e f. g h i j", "a c e g i k m o q. a b x y z", "t t u u v"], decontam.Settings(telling=2))


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from("abcdefghijkmoqtuvxyz"), max_size=60))
def test_any_words(words):
    found = searched(ITEMS, words)
    for i in range(3):
        assert found.get(i, 0) == held(ITEMS, i, [w.encode() for w in words])


def space_of(rng, rank):
    """Any space at all: a random one of few dimensions over random weights of words."""
    v = len(ITEMS.vocabulary)
    idf, basis = rng.uniform(1, 6, v), np.linalg.qr(rng.standard_normal((v, rank)))[0].astype(np.float32)
    cells = decontam._cells(np.repeat(np.arange(3), [len(c) for c in ITEMS.counts]), np.concatenate(ITEMS.counts), idf)
    inside = decontam._product(cells, basis)
    least = np.array([decontam._least(c, -(-n // 2), idf) for c, n in zip(ITEMS.counts, ITEMS.need.tolist(), strict=True)])
    return SimpleNamespace(idf=idf, basis=basis, items=inside, lost=decontam._outside(cells, inside), least=least)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from("abcdefghijkmoqtuvxyz"), max_size=200), st.integers(0, 99), st.integers(1, 12), st.sampled_from(["", "q ", "a zz "]))
def test_retrieval_loses_no_leak_in_any_space(words, seed, rank, again):
    words = [*words, *(again * 60).split(), *words[:7]]
    found = {i: share for _, i, share, *_ in decontam._found([" ".join(words)], ITEMS, space_of(np.random.default_rng(seed), rank), decontam.Settings(telling=2))}
    assert found == searched(ITEMS, words)


def test_only_what_is_retrieved_is_aligned():
    text, space = "n n a b c d e f g h i j m", space_of(np.random.default_rng(1), 12)
    assert [x[1] for x in decontam._found([text], ITEMS, space, decontam.Settings(telling=2))] == [0]
    space.items, space.least = -space.items, np.full(3, np.inf)
    assert list(decontam._found([text], ITEMS, space, decontam.Settings(telling=2))) == []


def test_edits_with_repeats():
    rng = np.random.default_rng(3)
    for _ in range(200):
        i = int(rng.integers(3))
        words = [w.decode() for w in ITEMS.words[i]]
        piece = list(words)
        for _ in range(int(rng.integers(5))):
            piece[int(rng.integers(len(piece)))] = "new"
        again = words[len(words) // 2 :] if rng.integers(2) else words[:3]
        text = ["n"] * int(rng.integers(30)) + piece + ["m"] * int(rng.integers(25)) + again * int(rng.integers(3)) + [words[0]] * int(rng.integers(4))
        found = searched(ITEMS, text)
        for k in range(3):
            assert found.get(k, 0) == held(ITEMS, k, [w.encode() for w in text])


def test_an_item_whose_second_half_follows_again(spark):
    item = " ".join(f"w{k}" for k in range(20))
    text = " ".join([item, *(f"x{k}" for k in range(20)), *(f"w{k}" for k in range(10, 20))])
    docs = spark.createDataFrame([(1, text), (None, text), (None, "fine"), (1, "fine too")], "doc_id int, text string")
    benchmark = spark.createDataFrame([(7, item)], "item_id int, text string")
    assert [(r.item_id, r.lcs) for r in decontam.leaks(docs.where("doc_id = 1"), benchmark).collect()] == [(7, 1.0)]
    assert sorted(r.text for r in decontam.clean(docs, benchmark).collect()) == ["fine", "fine too"]


def test_clean_with_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j", "x", 1), (2, None, None, 2)], "doc_id int, text string, _bad string, item int")
    benchmark = spark.createDataFrame([(7, "a b c d e f. g h i j"), (None, None)], "item_id int, text string")
    left = decontam.clean(docs, benchmark)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, None, None, 2)]
    assert decontam.clean(docs, benchmark.limit(0)).count() == 2 and decontam.clean(docs.limit(0), benchmark).count() == 0


def test_blocks_of_items_find_the_same(spark):
    items = [" ".join(f"i{k}w{j}" for j in range(15)) for k in range(30)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    docs = spark.createDataFrame([(k, f"x y {t} z") for k, t in enumerate(items)], "doc_id int, text string")
    for words in (50, 200_000):
        assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, benchmark, decontam.Settings(block_words=words)).collect()} == {(k, k) for k in range(30)}


def test_words_of_any_script():
    assert decontam.words_of("“Don’t” — stop… now×2") == "don t stop now 2".encode().split()
    assert decontam.words_of("Été Straße Ёлка") == "été straße ёлка".encode().split()
    assert decontam.words_of("東京、はABC") == "東 京 は abc".encode().split()
    assert decontam.words_of("") == decontam.words_of("…") == []
