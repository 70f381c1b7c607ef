"""Benchmark decontamination by latent semantic retrieval, word order and answers.

Passages of `documents` become TF-IDF vectors (damped counts) over telling words: all words of the benchmark but the
most frequent ones, see below. A distributed randomised SVD of them, with the items' own passages weighing as much as
the corpus's together, gives a latent space, in which every passage is held against every item; those whose
cosine reaches `cosine` are retrieved. A word repeated beside an item lowers a cosine at will, so where a passage's
weight could bring a leak below `cosine`, the search asks only for the least that a leak must have left. What it
retrieves, and nothing else, is then searched for places with enough telling words of an item for a leak; `retrieved`
tells which leaks reach `cosine` itself.

A candidate is a leak if some run of one and a half times the item's length holds, in order, at least `share` of the
item's words (a longest common subsequence), and at least half of the telling words of the item's answer (its last
sentence, or last third). So rewordings are found that keep most words in order. Every run counts, whatever stands
beside it; a fullest one is reported.

Frequent words are set aside only as long as every item keeps `telling` more words than `share` allows to be lost. A
leak so has a known number of the item's telling words within its run; places with fewer are passed over without
loss. Corpus figures (passages, document frequencies, the SVD's products) are sums over all documents. Items are
taken in blocks of about `block_words` words, so what is gathered on the driver or sent to executors (words and
latent vectors of a block) is bounded.

Words are runs of letters and digits of any script, without case; a character of a script written without spaces is a
word by itself.

Defined results: null or empty texts and items have no words and match nothing; items with equal text are each
reported; a null item id is reported as null; repeated rows each count, but a (doc_id, item_id) pair is reported
once; without items or documents there are no leaks. clean() decides on each row by its own text, so rows that share
a doc_id, null or not, stay or go each by itself. Columns besides the ids and texts are not looked at.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwake.llm.common import frugal, materialize, text_or_empty

_BREAKS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
#: First bytes in UTF-8 of characters that may be marks, or belong to scripts without spaces.
_ODD = bytes([0xC2, 0xCB, 0xCD, 0xD6, *range(0xD7, 0xDD), *range(0xE0, 0xF5)])
_TIMES = (b"\xc3\x97", b"\xc3\xb7")
_CHUNK = 500_000
_POSTINGS = 2_000_000
_SLICE = 16


@dataclass
class Settings:
    share: float = 0.6
    cosine: float = 0.3
    telling: int = 4
    block_words: int = 200_000  # of items in a block
    rank: int = 216  # of the latent space
    seed: int = 5


@lru_cache(1)
def _scripts() -> tuple[re.Pattern, re.Pattern]:
    """Characters beyond ASCII that part words, and those that are words by themselves."""
    marks = "".join(map(re.escape, (c for c in map(chr, range(128, 0x3400)) if unicodedata.category(c)[0] in "PSZC" and unicodedata.category(c) != "Cn")))
    return re.compile(f"[{marks}\ufe10-\ufe6f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65\ue000-\uf8ff\ufeff\ufffd\U0001f000-\U0001faff]"), re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def words_of(text: str) -> list[bytes]:
    low = text.lower()
    raw = low.encode("utf-8", "replace")
    if len(raw) > len(low) and (len(raw.translate(None, _ODD)) < len(raw) or any(x in raw for x in _TIMES)):
        marks, single = _scripts()
        raw = single.sub(r" \g<0> ", marks.sub(" ", low)).encode("utf-8", "replace")
    return raw.translate(_BREAKS).split()


def answer_of(text: str) -> list[bytes]:
    sentences = [w for x in re.split("[.\u3002]", text) if (w := words_of(x))]
    if len(sentences) > 1:
        return sentences[-1]
    found = words_of(text)
    return found[-max(1, len(found) // 3) :] if found else []


@dataclass
class Items:
    """A block of benchmark items: words, telling words and what a leak needs of them."""

    ids: list
    texts: list[str]
    s: Settings
    words: list[list[bytes]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.words = [words_of(t) for t in self.texts]
        need = [math.ceil(self.s.share * len(w)) for w in self.words]
        spread, least = Counter(w for ws in self.words for w in set(ws)), 2
        lost, frequent = [0] * len(self.words), set()
        held = [Counter(w) for w in self.words]
        for w, n in sorted(spread.items(), key=lambda x: (-x[1], x[0])):
            if n < least:
                break
            if all(not held[i][w] or lost[i] + held[i][w] + self.s.telling <= need[i] for i in range(len(need))):
                frequent.add(w)
                lost = [x + h[w] for x, h in zip(lost, held, strict=True)]
        self.least = need
        self.span = [math.ceil(1.5 * len(w)) for w in self.words]
        self.need = np.array([max(1, n - x) for n, x in zip(need, lost, strict=True)] or [1], np.int64)
        self.vocabulary = {w: k for k, w in enumerate(sorted(set(spread) - frequent))}
        self.counts = [np.array([self.vocabulary[w] for w in ws if w in self.vocabulary], np.int64) for ws in self.words]
        pairs = sorted((v, i) for i, c in enumerate(self.counts) for v in set(c.tolist()))
        self.post_items = np.array([i for _, i in pairs], np.int64)
        own = [Counter(c.tolist()) for c in self.counts]
        self.post_counts = np.array([own[i][v] for v, i in pairs], np.int64)
        self.post_start = np.searchsorted([v for v, _ in pairs], np.arange(len(self.vocabulary) + 1))
        self.window = max([48, *(math.ceil(1.5 * len(w)) for w in self.words)])
        self.answers = [[w for w in answer_of(t) if w in self.vocabulary] or answer_of(t) for t in self.texts]
        self.masks: list[dict[bytes, int]] = []
        for ws in self.words:
            m: dict[bytes, int] = {}
            for k, w in enumerate(ws):
                m[w] = m.get(w, 0) | 1 << k
            self.masks.append(m)

    def lcs_length(self, i: int, region: list[bytes], least: int = 0) -> int:
        """Length of the longest common subsequence of item i and region, all of an item's places at a time.

        0 if too few words are common for `least`.
        """
        common = list(filter(None, map(self.masks[i].get, region)))
        if len(common) < least:
            return 0
        v = full = (1 << len(self.words[i])) - 1
        for m in common:
            u = v & m
            v = ((v + u) | (v - u)) & full
        return len(self.words[i]) - v.bit_count()

    def lcs_places(self, i: int, region: list[bytes]) -> list[int]:
        """Places in region of one longest common subsequence with item i."""
        a, n = self.words[i], len(region)
        table = [[0] * (n + 1)]
        for x in a:
            above, row = table[-1], [0] * (n + 1)
            for k in range(n):
                row[k + 1] = above[k] + 1 if region[k] == x else max(above[k + 1], row[k])
            table.append(row)
        out, p, k = [], len(a), n
        while p and k:
            if a[p - 1] == region[k - 1] and table[p][k] == table[p - 1][k - 1] + 1:
                p, k = p - 1, k - 1
                out.append(k)
            elif table[p - 1][k] >= table[p][k - 1]:
                p -= 1
            else:
                k -= 1
        return out[::-1]

    def answered(self, i: int, run: list[bytes]) -> float:
        """Share of the telling words of item i's answer that a run has."""
        near = set(run)
        return sum(w in near for w in self.answers[i]) / max(1, len(self.answers[i]))

    def leak(self, i: int, region: list[bytes]) -> tuple[float, float, int, int] | None:
        """(share of item i in order, share of its answer, first and end place), if a run within region leaks it."""
        size, least, span = len(self.words[i]), self.least[i], self.span[i]
        total = self.lcs_length(i, region, least)
        if not size or total < least:
            return None
        places = self.lcs_places(i, region)
        if places[-1] - places[0] < span and (answer := self.answered(i, region[places[0] : places[0] + span])) >= 0.5:
            return total / size, answer, places[0], places[-1] + 1
        best: tuple[int, float, int] | None = None
        for start in (k for k, w in enumerate(region) if w in self.masks[i]):  # a run may begin at its first word in order
            run = region[start : start + span]
            n = self.lcs_length(i, run, least)
            if n >= least and (best is None or n > best[0]) and (answer := self.answered(i, run)) >= 0.5:
                best = n, answer, start
                if n == total:
                    break
        if best is None:
            return None
        n, answer, start = best
        places = self.lcs_places(i, region[start : start + span])
        return n / size, answer, start + places[0], start + places[-1] + 1

    def _enough(self, starts: np.ndarray, hit: np.ndarray, item: np.ndarray, at: np.ndarray, doc: np.ndarray, place: np.ndarray, number: np.ndarray, part: slice) -> np.ndarray:
        """Whether the run from each start still has enough telling words if one that its item has once counts once."""
        d, p, v = doc[part], place[part], number[part]
        same = np.argsort(v, kind="stable")
        again = (v[same[1:]] == v[same[:-1]]) & (d[same[1:]] == d[same[:-1]])
        before = np.full(len(p), -1)
        before[same[1:][again]] = p[same[:-1][again]]
        span = np.array(self.span, np.int64)
        shift = np.cumsum(np.r_[0, np.where(d[1:] != d[:-1], np.maximum(p[:-1] - p[1:], 0) + span.max() + 1, 0)])
        h = hit - part.start
        key = item * (1 << 42) + (p + shift)[h]
        stop = np.searchsorted(key, key[starts] + span[item[starts]])
        ok, n = np.zeros(len(starts), bool), stop - starts
        cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(n) // _POSTINGS)) + 1, len(starts)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            m = n[a:b]
            of = np.repeat(np.arange(b - a), m)
            each = np.repeat(starts[a:b], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            counts = np.bincount(of, (before[h[each]] < p[h[starts[a:b]]][of]) | (self.post_counts[at[each]] > 1), b - a)
            ok[a:b] = counts >= self.need[item[starts[a:b]]]
        return ok

    def regions(self, doc: np.ndarray, place: np.ndarray, number: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first and end place) of regions that hold every run with enough telling words, of hits in order of place.

        A long region comes in overlapping parts, each run whole in one of them.
        """
        span, n = np.array(self.span, np.int64), self.post_start[number + 1] - self.post_start[number]
        done, lo = np.cumsum(n), 0
        while lo < len(doc):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + _POSTINGS, "right")))
            stop = hi
            if hi < len(doc) and doc[hi] == doc[hi - 1]:  # runs that begin before may reach further
                last = int(np.searchsorted(doc, doc[hi], "right"))
                stop = hi + int(np.searchsorted(place[hi:last], place[hi - 1] + span.max(), "left"))
            m = n[lo:stop]
            at = np.repeat(self.post_start[number[lo:stop]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            item = self.post_items[at]
            order = np.argsort(item.astype(np.uint16) if len(span) < 1 << 16 else item, kind="stable")
            hit, item = np.repeat(np.arange(lo, stop), m)[order], item[order]
            end = np.arange(len(item)) + self.need[item] - 1
            fits = (end < len(item)) & (hit < hi)
            end = np.minimum(end, len(item) - 1)
            fits &= (item[end] == item) & (doc[hit[end]] == doc[hit]) & (place[hit[end]] - place[hit] < span[item])
            fits = np.flatnonzero(fits)
            fits = fits[self._enough(fits, hit, item, at[order], doc, place, number, slice(lo, stop))]
            hit, item = hit[fits], item[fits]
            if len(hit):
                d, p, s = doc[hit], place[hit], span[item]
                new = np.r_[True, (item[1:] != item[:-1]) | (d[1:] != d[:-1]) | (p[1:] - s[1:] >= p[:-1] + s[:-1])]
                first, last = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(hit)] - 1
                for k, i, x, y, w in zip(*(v.tolist() for v in (d[first], item[first], np.maximum(p[first] - s[first] + 1, 0), p[last] + s[last], s[first])), strict=True):
                    for start in range(x, max(x + 1, y - w), 3 * w):
                        yield k, i, start, min(y, start + 4 * w)
            lo = hi


def _hits(texts: list[str], vocabulary: dict[bytes, int]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; and of each telling word its text's number, place and number."""
    split = [words_of(t) for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    number = np.fromiter(map(vocabulary.get, chain.from_iterable(split), repeat(-1)), np.int64, lengths.sum())
    at = np.flatnonzero(number >= 0)
    starts = np.cumsum(lengths) - lengths
    doc = np.searchsorted(starts + lengths, at, "right")
    return split, doc, at - starts[doc], number[at]


def _chunks(b: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    column, lo = b.column("text"), 0
    while lo < len(column):
        hi, size, some = lo, 0, []
        while hi < len(column) and (not size or size < _CHUNK):
            some.append(column[hi].as_py() or "")
            size += len(some[-1]) + 1
            hi += 1
        yield lo, some
        lo = hi


def _sums(df: DataFrame, arrays: str, width: int) -> DataFrame:
    """Rows (key, part, slice) of array columns summed by key and part."""
    total = df.groupBy("key", "part").agg(*[F.sum(F.col(arrays)[k]).alias(f"x{k}") for k in range(width)])
    return total.select("key", "part", F.array(*[f"x{k}" for k in range(width)]).alias(arrays))


def _matrix(df: DataFrame, rows: int, columns: int) -> np.ndarray:
    out = np.zeros((rows, columns + -columns % _SLICE))
    for r in _sums(df, "x", _SLICE).toArrow().to_pylist():
        out[r["key"], r["part"] * _SLICE : (r["part"] + 1) * _SLICE] = r["x"]
    return out[:, :columns]


def _slices(matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    wide = np.pad(matrix, ((0, 0), (0, -matrix.shape[1] % _SLICE)))
    rows = np.flatnonzero(wide.any(axis=1))
    if len(rows):
        parts = wide.shape[1] // _SLICE
        values = pa.FixedSizeListArray.from_arrays(pa.array(wide[rows].reshape(-1)), _SLICE).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, parts).astype(np.int32)), pa.array(np.tile(np.arange(parts, dtype=np.int32), len(rows))), values], names=["key", "part", "x"])


def _sums_of(starts: np.ndarray, end: int, index: np.ndarray, value: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """For each run of cells (from a start to the next one) the rows of dense that it names, weighted and added up."""
    out = np.empty((len(starts), dense.shape[1]), dense.dtype)
    value = value.astype(dense.dtype)
    for k, (a, b) in enumerate(pairwise([*starts.tolist(), end])):
        np.dot(value[a:b], dense.take(index[a:b], axis=0), out=out[k])
    return out


def _product(cells: tuple[np.ndarray, np.ndarray, np.ndarray], dense: np.ndarray) -> np.ndarray:
    """A sparse matrix in cells (row, column, value), sorted by row, times a dense one; a row for each that has cells."""
    row, column, value = cells
    return _sums_of(np.flatnonzero(np.diff(row, prepend=-1)), len(row), column, value, dense)


def _cells(rows: np.ndarray, vids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, n = np.unique(rows * len(idf) + vids, return_counts=True)
    row, column = key // len(idf), key % len(idf)
    row = np.cumsum(np.diff(row, prepend=row[:1]) != 0)
    return row, column, (1 + np.log(n)) * idf[column]


def _transposed(cells: tuple[np.ndarray, np.ndarray, np.ndarray], dense: np.ndarray, height: int) -> np.ndarray:
    row, column, value = cells
    out = np.zeros((height, dense.shape[1]))
    order = np.argsort(column, kind="stable")
    column = column[order]
    starts = np.flatnonzero(np.diff(column, prepend=-1))
    out[column[starts]] = _sums_of(starts, len(column), row[order], value[order], dense)
    return out


class Space:
    """The latent space of a block of items over a corpus."""

    def __init__(self, docs: DataFrame, items: Items, s: Settings):
        spark, v = docs.sparkSession, len(items.vocabulary)
        shared = spark.sparkContext.broadcast(items)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            it = shared.value
            for b in batches:
                for _, texts in _chunks(b):
                    split, doc, place, number = _hits(texts, it.vocabulary)
                    passages = sum(-(-len(x) // it.window) for x in split)
                    rows = np.cumsum(np.diff(doc * (1 << 32) + place // it.window, prepend=-1) != 0) - 1
                    cells, times = np.unique(rows * v + number, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([passages], pa.int64()), pa.array([cells.tobytes()], pa.binary()), pa.array([times.astype(np.int32).tobytes()], pa.binary())], names=["passages", "cells", "times"])

        table = materialize(docs.select(text_or_empty().alias("text")).mapInArrow(frugal(count), "passages long, cells binary, times binary"), "passages")

        def read(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """The cells (row times v plus column) of each group of passages, and how often each has its word."""
            for cells, times in zip(b.column("cells"), b.column("times"), strict=True):
                yield np.frombuffer(cells.as_buffer(), np.int64), np.frombuffer(times.as_buffer(), np.int32)

        def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(v, np.int64)
            for b in batches:
                for cells, _ in read(b):
                    total += np.bincount(cells % v, minlength=v)
            has = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(total[has])], names=["key", "n"])

        sparse = table.select("cells", "times")
        df = np.zeros(v)
        for r in sparse.mapInArrow(frugal(frequencies), "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow().to_pylist():
            df[r["key"]] = r["n"]
        passages = (table.agg(F.sum("passages").alias("n")).first()["n"] or 0) + len(items.ids)
        own = np.bincount(np.concatenate([np.unique(c) for c in items.counts] or [np.zeros(0, np.int64)]).astype(np.int64), minlength=v)
        self.idf = np.log((1 + passages) / (1 + df + own)) + 1
        own_rows = np.concatenate([np.full(len(c), i) for i, c in enumerate(items.counts)])
        own_cells = _cells(own_rows.astype(np.int64), np.concatenate(items.counts), self.idf)
        mass = (own_cells[2] ** 2).sum()
        rank = min(s.rank, v, len(items.ids) + 16)
        omega = np.random.default_rng(s.seed).standard_normal((v, rank))
        idf = self.idf

        def square(dense: np.ndarray, both: bool) -> tuple[np.ndarray, float]:
            """AᵀA times dense, or with both denseᵀAᵀA times dense, over the corpus; and the mass of A."""
            given = spark.sparkContext.broadcast(dense.astype(np.float32))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                d, weight = given.value, 0.0
                out = np.zeros((d.shape[1] if both else v, d.shape[1]))
                for b in batches:
                    for at, times in read(b):
                        if len(at):
                            cells = at // v, at % v, (1 + np.log(times)) * idf[at % v]
                            weight += (cells[2] ** 2).sum()
                            ad = _product(cells, d)
                            out += (ad.T @ ad).astype(np.float64) if both else _transposed(cells, ad, v)
                yield from _slices(out)
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([[weight] + [0.0] * (_SLICE - 1)])], names=["key", "part", "x"])

            summed = materialize(_sums(sparse.mapInArrow(frugal(run), "key int, part int, x array<double>"), "x", _SLICE), "products")
            mass_row = summed.where("key < 0").first()
            return _matrix(summed.where("key >= 0"), d_rows(dense, both), dense.shape[1]), mass_row["x"][0] if mass_row else 0.0

        d_rows = lambda dense, both: dense.shape[1] if both else v
        b, corpus = square(omega, False)
        weight = max(corpus, 1.0) / max(mass, 1e-9)
        b += weight * _transposed(own_cells, _product(own_cells, omega), v)
        q, _ = np.linalg.qr(b)
        g, _ = square(q, True)
        own_q = _product(own_cells, q)
        values, turn = np.linalg.eigh(g + weight * own_q.T @ own_q)
        order = np.argsort(-values)
        self.singular = np.sqrt(np.maximum(values[order], 0))
        self.basis = (q @ turn[:, order]).astype(np.float32)
        self.items = np.zeros((len(items.ids), self.basis.shape[1]), np.float32)
        has = np.unique(own_rows).astype(np.int64)
        self.items[has] = _product(own_cells, self.basis)
        self.lost = np.zeros(len(items.ids))
        self.lost[has] = _outside(own_cells, self.items[has])
        self.least = np.array([_least(c, -(-n // 2), self.idf) for c, n in zip(items.counts, items.need.tolist(), strict=False)])


def _outside(cells: tuple[np.ndarray, np.ndarray, np.ndarray], inside: np.ndarray) -> np.ndarray:
    """At most how long the part of each row is that lies outside the space, given the part inside; 0.002 for rounding."""
    whole = np.bincount(cells[0], cells[2] ** 2, len(inside))
    return np.sqrt(np.maximum(whole - (inside.astype(np.float64) ** 2).sum(axis=1), 0)) + 2e-3 * np.sqrt(whole)


def _least(words: np.ndarray, need: int, idf: np.ndarray) -> float:
    """The least product of an item's vector with that of a passage which has `need` of the item's telling words."""
    v, n = np.unique(words, return_counts=True)
    each = ((1 + np.log(n)) * idf[v]) ** 2 / n  # what a further place of a word adds at least
    order = np.argsort(each)
    taken = np.minimum(n[order], np.maximum(need - (np.cumsum(n[order]) - n[order]), 0))
    return float((taken * each[order]).sum())


def _found(texts: list[str], it: Items, space: Space, s: Settings) -> Iterator[tuple]:
    """(number of the text, item, lcs, answer, cosine, retrieved, start, stop), the best leak for each text and item.

    Only items that the latent search retrieves for a text are aligned with it. Two passages hold all of a run, so one of
    them has half the telling words that a leak needs, hence a least product with the item; where that asks for less than
    the cosine does, since other words weigh much beside the item's, it is the bound, and no leak is passed over.
    """
    stride = -(-it.window // 2)
    size = np.maximum(np.linalg.norm(space.items, axis=1), 1e-12)
    unit = space.items / size[:, None]
    split, doc, place, number = _hits(texts, it.vocabulary)
    if not len(doc):
        return
    # A passage is two strides that follow each other, or one that stands alone; hits come in order of place.
    key = doc * (1 << 32) + place // stride
    new = np.diff(key, prepend=-1) != 0
    windows = key[new]
    cells = _cells(np.cumsum(new) - 1, number, space.idf)
    z = _product(cells, space.basis)
    beside = _outside(cells, z)
    follows = np.diff(windows) == 1
    alone = ~(np.r_[follows, False] | np.r_[False, follows])
    z, beside, windows = (np.concatenate([x, y[alone]]) for x, y in ((z[:-1][follows] + z[1:][follows], z), (beside[:-1][follows] + beside[1:][follows], beside), (windows[:-1][follows], windows)))
    order = np.argsort(windows)
    z, beside, windows = z[order], beside[order], windows[order]
    length = np.maximum(np.linalg.norm(z, axis=1), 1e-12)
    z /= length[:, None]
    near: dict[tuple[int, int], float] = {}
    asked = np.zeros((len(texts), len(it.ids)), bool)
    for lo in range(0, len(windows), 4096):
        part = slice(lo, lo + 4096)
        cosine = z[part] @ unit.T
        for k, i in zip(*(x.tolist() for x in np.nonzero(cosine >= s.cosine)), strict=True):
            key = int(windows[lo + k]) >> 32, i
            near[key] = max(near.get(key, -1.0), float(cosine[k, i]))
        bound = (space.least - beside[part, None] * space.lost) / (length[part, None] * size)
        k, i = np.nonzero(cosine >= np.minimum(s.cosine, bound - 1e-3))
        asked[windows[lo + k] >> 32, i] = True
    some = asked.any(axis=1)[doc]
    doc, place, number = doc[some], place[some], number[some]
    best: dict[tuple[int, int], tuple] = {}
    for d, i, lo, hi in it.regions(doc, place, number):
        found = it.leak(i, split[d][lo:hi]) if asked[d, i] else None
        if found and found[0] > best.get((d, i), (0,))[0]:
            best[d, i] = found[0], found[1], lo + found[2], lo + found[3]
    for (d, i), (lcs, answer, start, stop) in best.items():
        own = slice(*np.searchsorted(windows, (d << 32, (d + 1) << 32)))
        cosine = near.get((d, i), 0) or float((z[own] @ unit[i]).max())
        yield d, i, lcs, answer, cosine, (d, i) in near, start, stop


def _shared(docs: DataFrame, items: Items, space: Space, s: Settings):
    return docs.sparkSession.sparkContext.broadcast((items, space, s))


def _leaks(docs: DataFrame, items: Items, space: Space, s: Settings) -> DataFrame:
    shared = _shared(docs, items, space, s)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(lo + d, *x) for lo, texts in _chunks(b) for d, *x in _found(texts, *shared.value)]
            if out:
                at, item, lcs, answer, cosine, retrieved, start, stop = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), pa.array(item, pa.int32()), pa.array(lcs), pa.array(answer), pa.array(cosine), pa.array(retrieved), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], names=["doc_id", "item", "lcs", "answer", "cosine", "retrieved", "start", "stop"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(frugal(run), f"doc_id {kind}, item int, lcs double, answer double, cosine double, retrieved boolean, start long, stop long")


def _blocks(benchmark: DataFrame, s: Settings, id_col: str) -> Iterator[Items]:
    """The items in blocks of about `block_words` words (by characters; an item that is longer is a block with few others)."""
    asked = benchmark.select(F.col(id_col).alias("item_id"), text_or_empty().alias("text"))
    blocks = max(1, math.ceil((asked.agg(F.sum(F.char_length("text"))).first()[0] or 0) / (6 * s.block_words)))
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        items = Items([r["item_id"] for r in rows], [r["text"] for r in rows], s)
        if items.vocabulary:
            yield items


def leaks(docs: DataFrame, benchmark: DataFrame, s: Settings | None = None, id_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, lcs, answer, cosine, retrieved, and the word range start to stop: a row per document and item it leaks."""
    s = s or Settings()
    spark = docs.sparkSession
    kind, doc_kind = benchmark.schema[id_col].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    columns = ("lcs", "answer", "cosine", "retrieved", "start", "stop")
    found = spark.createDataFrame([], f"doc_id {doc_kind}, item_id {kind}, lcs double, answer double, cosine double, retrieved boolean, start long, stop long")
    for items in _blocks(benchmark, s, id_col):
        own = materialize(_leaks(docs, items, Space(docs, items, s), s), "leaks")
        names = spark.createDataFrame(list(enumerate(items.ids)), f"item int, item_id {kind}")
        found = found.unionByName(own.join(F.broadcast(names), "item").select("doc_id", "item_id", *columns))
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct(*columns)).alias("x")).select("doc_id", "item_id", "x.*")


def clean(docs: DataFrame, benchmark: DataFrame, s: Settings | None = None, id_col: str = "item_id") -> DataFrame:
    """The rows of docs that leak no item, all columns kept. Each row is judged by itself, where it lies: nothing is shuffled."""
    s = s or Settings()
    left = docs
    for items in _blocks(benchmark, s, id_col):
        shared = _shared(docs, items, Space(docs, items, s), s)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for lo, texts in _chunks(b):
                    keep[[lo + x[0] for x in _found(texts, *shared.value)]] = False
                yield b.filter(pa.array(keep))

        left = left.mapInArrow(frugal(run), docs.schema)
    return left
