"""Quality scores by co-training two views of a document.

One classifier sees the text (shares of capitals, digits, symbols and separators, repetition, lengths, and the words
themselves, hashed to `_BUCKETS` places), the other the page's metadata (source, language, recorded length). Both are
logistic regressions. In each round either view scores all unlabelled documents and labels those it is surest of, as
many of each kind as the labels' share asks for and only above `sure`, and the other view learns from them too. At
the end each view's log-odds, told for each labelled row by regressions that did not see it, are calibrated, and a
last regression on both calibrated log-odds weighs the views; so a view that tells little counts little.

Learning uses at most `labelled` labelled documents, chosen by the hash of doc_id, never the held-out ones; each round
goes over all others but these (a label beyond the bound is not looked at; of equally sure ones the least by hash
count), and brings at most `per_round` of them to the driver for each view. Every document is scored from its whole text.

Defined results: null text is empty, null metadata are values of their own; labels with null doc_id or mark are not
learnt from; without labels of both kinds every score is the share of good ones (1 without labels); repeated rows
each get a row. Metadata columns that are missing count as null; other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwake.llm.common import held_out, materialize, text_or_empty

_SOURCES, _LANGS, _LENGTHS = 64, 16, 24
_BUCKETS = 128
_CLASSES = np.zeros(256, np.int64)
for _c in range(256):
    _CLASSES[_c] = 1 if 65 <= _c <= 90 else 2 if 97 <= _c <= 122 else 3 if 48 <= _c <= 57 else 4 if _c in (32, 9) else 5 if _c in (10, 13) else 6 if chr(_c) in ".,;:'\"-()?" else 7 if _c == 33 else 8 if _c == 124 else 9 if _c < 128 else 0


@dataclass
class Settings:
    labelled: int = 6_000  # bound of the labelled rows that are learnt from
    rounds: int = 4
    per_round: int = 200
    sure: float = 0.95
    l2: float = 1.0


@lru_cache(200_000)
def _bucket(word: bytes) -> int:
    return zlib.crc32(word) % _BUCKETS


def text_view(text: str) -> list[float]:
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    kinds = np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=10) / n if raw else np.zeros(10)
    words = raw.lower().split()
    w = max(1, len(words))
    distinct = len(set(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = kinds[1] + kinds[2] + kinds[0]
    bag = np.sqrt(np.bincount(np.fromiter(map(_bucket, words), np.int64, len(words)), minlength=_BUCKETS) / w)
    return [*bag.tolist(), *kinds.tolist(), math.sqrt(kinds[7]), math.sqrt(kinds[8]), math.sqrt(kinds[9]), kinds[1] / max(letters, 1e-9), math.log1p(w), distinct / w, distinct / w * math.log1p(w), len(raw) / w / 10, len(set(lines)) / max(1, len(lines)), w / max(1, len(lines)) / 50, float(w < 5), float(w < 20)]


def page_view(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    out = [0.0] * (_SOURCES + _LANGS + _LENGTHS)
    out[zlib.crc32(("" if source is None else f"s{source}").encode()) % _SOURCES] = 1.0
    out[_SOURCES + zlib.crc32(("" if lang is None else f"l{lang}").encode()) % _LANGS] = 1.0
    out[_SOURCES + _LANGS + (0 if n_chars is None else 1 + min(_LENGTHS - 2, int(math.log2(max(n_chars, 0) + 1))))] = 1.0
    return out


@dataclass
class Regression:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # the intercept last

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weight[:-1] + self.weight[-1]


def fit(x: np.ndarray, y: np.ndarray, l2: float) -> Regression:
    """Logistic regression by Newton's method, features standardised, the intercept free."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.r_[np.full(z.shape[1] - 1, l2), 1e-6]
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return Regression(mean, scale, w)


@dataclass
class Model:
    views: list[Regression]
    calibration: list[Regression]
    combined: Regression | None
    prior: float

    def score(self, views: list[np.ndarray]) -> np.ndarray:
        if self.combined is None:
            return np.full(len(views[0]), self.prior)
        logits = [c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.calibration, views, strict=True)]
        return 1 / (1 + np.exp(-np.clip(self.combined.logit(np.column_stack(logits)), -35, 35)))


def _out_of_fold(x: np.ndarray, y: np.ndarray, own: int, l2: float, folds: int = 4) -> np.ndarray:
    """Log-odds of the first `own` rows, each by a regression that did not see it."""
    out = np.zeros(own)
    fold = np.arange(len(y)) % folds
    for k in range(folds):
        seen = (fold != k) | (np.arange(len(y)) >= own)
        some = np.flatnonzero(~seen)
        out[some] = fit(x[seen], y[seen], l2).logit(x[some]) if len(set(y[seen].tolist())) > 1 else 0.0
    return out


def co_train(views: list[np.ndarray], y: np.ndarray, surest, s: Settings) -> Model:
    """views: features of the labelled rows, in each view.

    surest(models, wanted) gives for each view the documents that it is surest of, as (mark, other view's features):
    at most wanted[mark] of each mark, none of those it has given before.
    """
    if len(y) == 0 or y.min() == y.max():
        return Model([], [], None, float(y.mean()) if len(y) else 1.0)
    share = y.mean()
    own = [(x, y) for x in views]
    wanted = {1: math.ceil(s.per_round * share), 0: math.ceil(s.per_round * (1 - share))}
    for _ in range(s.rounds):
        models = [fit(x, t, s.l2) for x, t in own]
        for k, found in enumerate(surest(models, wanted)):
            if found:
                x, t = own[1 - k]
                own[1 - k] = np.vstack([x, *(f for _, f in found)]), np.r_[t, [float(m) for m, _ in found]]
    models = [fit(x, t, s.l2) for x, t in own]
    odds = [_out_of_fold(x, t, len(y), s.l2) for x, t in own]
    calibration = [fit(o[:, None], y, 1e-2) for o in odds]
    both = np.column_stack([c.logit(o[:, None]) for c, o in zip(calibration, odds, strict=True)])
    return Model(models, calibration, fit(both, y, 1e-2), float(share))


def _ready(docs: DataFrame) -> DataFrame:
    has = set(docs.columns)
    get = lambda name, kind: (F.col(name).cast(kind) if name in has else F.lit(None).cast(kind)).alias(name)
    return docs.select("doc_id", text_or_empty().alias("text"), get("source", "string"), get("lang", "string"), get("n_chars", "long"))


def _views(b: pa.RecordBatch) -> list[np.ndarray]:
    text = np.array([text_view(t.as_py()) for t in b.column("text")])
    page = np.array([page_view(*x) for x in zip(*(b.column(k).to_pylist() for k in ("source", "lang", "n_chars")), strict=True)])
    return [text, page]


def train(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> Model:
    s = s or Settings()
    spark = docs.sparkSession
    text_id = F.col("doc_id").cast("string")
    marked = labels.where(F.col("doc_id").isNotNull()).select(text_id.alias("doc_id"), F.col("quality").cast("int").alias("mark"))
    marks = marked.where(F.col("mark").isNotNull() & ~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "mark").limit(s.labelled)
    ready = _ready(docs).withColumn("doc_id", text_id).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    schema, sizes = "doc_id string, mark int, views binary", (len(text_view("")), _SOURCES + _LANGS + _LENGTHS)

    def parts(rows: list[bytes]) -> list[np.ndarray]:
        both = np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), sum(sizes)).astype(float)
        return [both[:, : sizes[0]], both[:, sizes[0] :]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                both = np.column_stack(_views(b)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array([x.tobytes() for x in both], pa.binary())], names=["doc_id", "mark", "views"])

    t = ready.join(F.broadcast(marks), "doc_id").mapInArrow(run, schema).toArrow().to_pylist()
    t.sort(key=lambda r: (r["doc_id"], r["mark"], r["views"]))
    views = parts([r["views"] for r in t])
    rest = materialize(ready.join(F.broadcast(marks.select("doc_id")), "doc_id", "left_anti").withColumn("mark", F.lit(-1)).mapInArrow(run, schema).select("doc_id", "views"), "unlabelled")
    taken: list[set[str]] = [set(), set()]

    def surest(models: list[Regression], wanted: dict[int, int]) -> list[list[tuple[int, np.ndarray]]]:
        shared = spark.sparkContext.broadcast((models, [frozenset(x) for x in taken]))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, before = shared.value
            for b in batches:
                ids, both = b.column("doc_id").to_pylist(), parts(b.column("views").to_pylist())
                for k, m in enumerate(known):
                    p = 1 / (1 + np.exp(-np.clip(m.logit(both[k]), -30, 30)))
                    for mark, sure in ((1, p), (0, 1 - p)):
                        some = [i for i in np.flatnonzero(sure >= s.sure).tolist() if ids[i] not in before[k]]
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(some), pa.int32()), pa.array([mark] * len(some), pa.int32()), pa.array(sure[some]), pa.array([ids[i] for i in some], pa.string()), pa.array([x.tobytes() for x in both[1 - k][some]], pa.binary())], names=["view", "mark", "sure", "doc_id", "other"])

        found = materialize(rest.mapInArrow(score, "view int, mark int, sure double, doc_id string, other binary"), "sure")
        out: list[list[tuple[int, np.ndarray]]] = [[], []]
        for k in (0, 1):
            for mark, n in wanted.items():
                best = found.where((F.col("view") == k) & (F.col("mark") == mark)).orderBy(F.col("sure").desc(), F.xxhash64("doc_id"), "doc_id").limit(n)
                for r in best.collect():
                    taken[k].add(r["doc_id"])
                    out[k].append((mark, np.frombuffer(r["other"])))
        return out

    return co_train(views, np.array([float(r["mark"] > 0) for r in t]), surest, s)


def quality(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher is better) and keep (score of 0.5 or more) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, s))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = shared.value.score(_views(b))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array(p >= 0.5)], names=["doc_id", "score", "keep"])

    scored = _ready(docs).mapInArrow(run, f"doc_id {kind}, score double, keep boolean")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "keep")
