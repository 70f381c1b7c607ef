"""Toxicity scores from logistic regression trained by FTRL-proximal over hashed word n-grams and skip-grams.

A document's features are present or absent: its words, the first 3 to 6 letters of each word (inflected
languages put the same stem into many words), its adjacent word pairs, and its pairs with one word between
(skip-grams), each hashed to `2 ** bits` places. Training keeps a learning rate for each coordinate and an L1
penalty, so that few weights differ from zero; these alone go to the executors. A labelled text is learnt from whole;
it has at most `2 ** bits` features, so a bounded number of texts brings a bounded number of them. The sample is gone
over again until `min_examples` were shown, at least twice and at most `max_epochs` times.

Defined results: null or empty text has no features, and its score is that of the intercept alone; a null
doc_id counts as the empty text in the choice of held-out rows; repeated rows each get a row; labels with null
doc_id or null mark are not learnt from; several labels of one doc_id each count as an example; without any
labels of both kinds every score is the share of toxic ones (0 without labels). Columns besides doc_id and text
are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwake.llm.common import frugal, held_out, materialize, mix, text_or_empty
from sparkwake.llm.warc import _filesystem

#: ASCII punctuation and control characters part words.
_BREAKS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_CHUNK = 1_000_000
_PREFIXES = (3, 4, 5, 6)


@dataclass
class Settings:
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    min_examples: int = 24_000  # examples shown in all, by repeating a small sample
    max_epochs: int = 12
    max_labelled: int = 8_000  # bound of the labelled sample that is learnt from


class Features:
    """Texts to (document, feature) pairs; remembers the features of words it has met."""

    def __init__(self, bits: int, keep: int = 300_000):
        self.mask, self.keep = np.uint64((1 << bits) - 1), keep
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.own = np.zeros(1 << 12, np.uint64)
        self.sub = np.zeros((1 << 12, len(_PREFIXES) + 1), np.int64)

    def _learn(self, words: list[bytes]) -> None:
        import xxhash

        new = list({w for w in words if w not in self.ids})
        if len(self.ids) + len(new) > self.keep and self.ids:
            self._reset()
            new = list(set(words))
        base = len(self.ids)
        while base + len(new) > len(self.own):
            self.own = np.concatenate([self.own, np.zeros_like(self.own)])
            self.sub = np.concatenate([self.sub, np.zeros_like(self.sub)])
        for k, w in enumerate(new, base):
            self.ids[w] = k
            h = xxhash.xxh3_64_intdigest(w)
            self.own[k] = h
            u = w.decode()
            # a word shorter than the prefix stands for itself once more
            self.sub[k] = [h & int(self.mask), *(xxhash.xxh3_64_intdigest(u[:n].encode(), n) & int(self.mask) if len(u) >= n else h & int(self.mask) for n in _PREFIXES)]

    def pairs(self, texts: list[str], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document's number, feature), by document; with weights only features whose weight is not 0."""
        split = [t.lower().encode("utf-8", "replace").translate(_BREAKS).split() for t in texts]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        words = [w for ws in split for w in ws]
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._learn(words)
        at = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        doc = np.repeat(np.arange(len(texts)), lengths)
        found: list[np.ndarray] = []

        def add(docs: np.ndarray, features: np.ndarray) -> None:
            if weights is not None:
                hit = weights[features] != 0
                docs, features = docs[hit], features[hit]
            found.append(np.unique((docs << 32) | features))

        for k in range(self.sub.shape[1]):
            add(doc, self.sub[at, k])
        own = self.own[at]
        for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
            same = doc[:-gap] == doc[gap:]
            both = mix(own[:-gap][same] * np.uint64(salt) + own[gap:][same]) & self.mask
            add(doc[:-gap][same], both.astype(np.int64))
        keys = np.unique(np.concatenate(found))
        return keys >> 32, keys & 0xFFFFFFFF


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _CHUNK characters (a longer text stands alone, whole)."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > _CHUNK:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


@dataclass
class Model:
    bits: int
    bias: float
    index: np.ndarray
    weight: np.ndarray

    def table(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.index] = self.weight
        return out


def ftrl(examples: list[tuple[np.ndarray, int]], s: Settings) -> Model:
    """FTRL-proximal: one pass after another over the examples, in an order drawn anew from a fixed seed."""
    size = 1 << s.bits
    z, n, bias, n0 = np.zeros(size), np.zeros(size), 0.0, 0.0
    z0 = 0.0
    toxic = sum(y for _, y in examples)
    if not examples or toxic in (0, len(examples)):
        p = min(max(toxic / max(len(examples), 1), 1e-6), 1 - 1e-6) if examples else 1e-6
        return Model(s.bits, math.log(p / (1 - p)), np.zeros(0, np.int64), np.zeros(0, np.float32))
    rng = np.random.default_rng(7)
    epochs = max(2, min(s.max_epochs, -(-s.min_examples // len(examples))))
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            i, y = examples[k][0].astype(np.int64), examples[k][1]
            zi, ni = z[i], n[i]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= s.l1, 0.0, -(zi - np.sign(zi) * s.l1) / ((s.beta + root) / s.alpha + s.l2))
            bias = -z0 / ((s.beta + math.sqrt(n0)) / s.alpha)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum() + bias))))
            g = p - y
            z[i] = zi + g - (np.sqrt(ni + g * g) - root) / s.alpha * w
            n[i] = ni + g * g
            z0, n0 = z0 + g - (math.sqrt(n0 + g * g) - math.sqrt(n0)) / s.alpha * bias, n0 + g * g
    hit = np.flatnonzero(np.abs(z) > s.l1)
    w = -(z[hit] - np.sign(z[hit]) * s.l1) / ((s.beta + np.sqrt(n[hit])) / s.alpha + s.l2)
    return Model(s.bits, -z0 / ((s.beta + math.sqrt(n0)) / s.alpha), hit, w.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Learns labels.toxic from at most `max_labelled` documents that are not held out, chosen by the hash of doc_id."""
    s = settings or Settings()
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(s.max_labelled)
    marks = marks.withColumn("doc_id", F.col("doc_id").cast("string"))
    chosen = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(marks), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(s.bits)
        for b in batches:
            texts, ids, toxic = (b.column(k).to_pylist() for k in ("text", "doc_id", "toxic"))
            for lo, hi in _chunks(texts):
                doc, feature = make.pairs(texts[lo:hi])
                cuts = np.searchsorted(doc, np.arange(1, hi - lo))
                packed = [np.asarray(x, np.uint32).tobytes() for x in np.split(feature, cuts)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.string()), pa.array(toxic[lo:hi], pa.int32()), pa.array(packed, pa.binary())], names=["doc_id", "toxic", "features"])

    path = materialize(chosen.mapInArrow(frugal(features), "doc_id string, toxic int, features binary"), "features").inputFiles()
    ids, marks_, sets = [], [], []
    for name in path:  # a file at a time, past the JVM, so that the driver holds each feature once
        files, at = _filesystem(unquote(name))
        for b in pq.ParquetFile(files.open_input_file(at)).iter_batches(256):
            ids += b.column(0).to_pylist()
            marks_ += b.column(1).to_pylist()
            sets += [np.frombuffer(x.as_py(), np.uint32) for x in b.column(2)]
    order = sorted(range(len(ids)), key=lambda k: (ids[k], marks_[k], zlib.crc32(sets[k])))
    return ftrl([(sets[k], int(marks_[k] > 0)) for k in order], s)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every row of docs, from the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        make, weights = Features(m.bits), m.table()
        for b in batches:
            texts = b.column("text").to_pylist()
            out = np.zeros(len(texts))
            for lo, hi in _chunks(texts):
                doc, feature = make.pairs(texts[lo:hi], weights)
                out[lo:hi] = np.bincount(doc, weights[feature].astype(np.float64), hi - lo)
            p = 1 / (1 + np.exp(-np.clip(out + m.bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(frugal(run), f"doc_id {kind}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    scored = score(docs, train(docs, labels, settings))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def reject_toxic(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns kept."""
    model = train(docs, labels, settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def toxic(text):
        import pandas as pd

        m = shared.value
        make, weights, texts = Features(m.bits), m.table(), text.tolist()
        out = np.zeros(len(texts))
        for lo, hi in _chunks(texts):
            doc, feature = make.pairs(texts[lo:hi], weights)
            out[lo:hi] = np.bincount(doc, weights[feature].astype(np.float64), hi - lo)
        return pd.Series(out + m.bias >= 0)

    return docs.where(~toxic(text_or_empty()))
