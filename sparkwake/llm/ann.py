"""Nearest neighbours by collision counting: sorted projections, windows around the query, virtual rehashing.

Each hash function is one projection onto a random direction (directions are orthogonal in groups, which makes
counts steadier). A block of vectors keeps, for each projection, its vectors sorted by projected value. A query
starts with narrow windows centred at its own projections and widens them round by round, as if hashed anew with
wider buckets; a vector whose value falls into the windows of at least `threshold` of the projections is verified
by its exact inner product. A query is done when `k` verified vectors are within the current radius, or all
vectors of the block are verified.

The largest inner product is sought: vectors get one more component that gives all the largest norm, whereby the
nearest by distance is the one with the largest inner product; scores are inner products of the original vectors
in double precision, summed component by component, so that equal vectors tie wherever they lie.

Every row is indexed. Vectors are dealt to blocks by hash, each in one place only; a block's index is built once, and
all queries stream past it, a batch at a time. So a task holds one block and one batch, queries are copied once for
each block of vectors, and a block yields at most k rows a query.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part, neither
do rows with null ids; vectors are compared with those of equal length only; rows that share the query's id are no
candidates; repeated rows (id and vector) count once, as queries and as candidates; ties go to the smaller id. Fewer candidates than k are all returned. Columns besides the id and the vector are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwake.llm.common import materialize, tasks


@dataclass
class Settings:
    k: int = 20
    projections: int = 65  # rounded up to whole groups of orthogonal directions
    width: float = 1.45  # half a window's width, in standard deviations of the projections of a vector as long as the radius
    threshold: float = 0.83  # share of the projections in whose windows a vector must fall
    first_radius: float = 0.6  # times the largest norm
    growth: float = 1.12
    vectors: int = 32_768  # in a block
    queries: int = 1_024  # in a batch
    seed: int = 11


def directions(dim: int, s: Settings) -> np.ndarray:
    """dim x projections: groups of orthogonal unit vectors, uniform on the sphere."""
    rng, groups = np.random.default_rng(s.seed), []
    for _ in range(max(1, math.ceil(s.projections / dim))):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        groups.append(q * np.sign(np.diag(r)))
    return np.concatenate(groups, axis=1)


class Index:
    """A block of vectors with its sorted projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float, s: Settings):
        self.ids, self.vectors, self.norm, self.s = ids, vectors, norm, s
        spare = np.sqrt(np.maximum(norm**2 - (vectors**2).sum(1), 0))
        self.a = directions(vectors.shape[1] + 1, s)
        self.width = s.width / math.sqrt(len(self.a))
        values = (vectors @ self.a[:-1] + spare[:, None] * self.a[-1]).T.astype(np.float32)
        self.order = np.argsort(values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values, self.order, 1)

    def search(self, query_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Numbers of queries, ids and scores of what is found, and how many vectors were verified."""
        s, n, m = self.s, len(self.ids), len(self.sorted)
        # A query is scaled to the largest norm, which changes no order among its inner products.
        own = np.sqrt((queries**2).sum(1))
        scaled = queries * (self.norm / own)[:, None]
        at = (scaled @ self.a[:-1]).astype(np.float32)
        radii = [s.first_radius * self.norm]
        while radii[-1] < 2.1 * self.norm / min(1.0, self.width):
            radii.append(radii[-1] * s.growth)
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        least = max(1, math.ceil(s.threshold * m))
        out_q, out_i, out_s, checked = [], [], [], 0

        def windows(t: int) -> tuple[np.ndarray, np.ndarray]:
            if t not in bounds:
                half = np.float32(radii[t] * self.width)
                lo, hi = np.empty((len(at), m), np.int32), np.empty((len(at), m), np.int32)
                for j in range(m):
                    lo[:, j] = np.searchsorted(self.sorted[j], at[:, j] - half, "left")
                    hi[:, j] = np.searchsorted(self.sorted[j], at[:, j] + half, "right")
                bounds[t] = lo, hi
            return bounds[t]

        for q in range(len(at)):
            counts, done = np.zeros(n, np.int64), np.zeros(n, bool)
            rows, scores = np.zeros(0, np.int64), np.zeros(0)
            for t, radius in enumerate(radii):
                lo, hi = (x[q] for x in windows(t))
                if t:
                    was_lo, was_hi = (x[q] for x in windows(t - 1))
                    rings = [self.order[j, a:b] for j in range(m) for a, b in ((lo[j], was_lo[j]), (was_hi[j], hi[j])) if b > a]
                else:
                    rings = [self.order[j, lo[j] : hi[j]] for j in range(m)]
                if rings:
                    counts += np.bincount(np.concatenate(rings), minlength=n)
                new = np.flatnonzero((counts >= least) & ~done)
                if len(new):
                    done[new] = True
                    fresh = new[self.ids[new] != query_ids[q]]
                    checked += len(fresh)
                    rows = np.concatenate([rows, fresh])
                    scores = np.concatenate([scores, self.vectors[fresh] @ queries[q]])
                # distance to the scaled query, both of the largest norm: d^2 = 2 norm^2 - 2 <scaled, x>
                near = 2 * self.norm**2 - 2 * scores * (self.norm / own[q]) <= radius**2
                if near.sum() >= s.k or done.all():
                    break
            # Scores come component by component for those that may be among the k best, so equal vectors have equal ones.
            if len(rows) > s.k:
                slack = 1e-9 * self.norm * own[q]
                rows = rows[scores >= np.partition(scores, -s.k)[-s.k] - slack]
            scores = np.zeros(len(rows))
            for x, y in zip(self.vectors[rows].T, queries[q], strict=True):
                scores += x * y
            best = np.lexsort((self.ids[rows], -scores))[: s.k]
            out_q.append(np.full(len(best), q))
            out_i.append(self.ids[rows[best]])
            out_s.append(scores[best])
        return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s), checked


def _valid(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0)


def _matrix(t: pa.RecordBatch, name: str = "vector") -> np.ndarray:
    column = t.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(queries: DataFrame, vectors: DataFrame, s: Settings | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of all vectors for each query."""
    s = s or Settings()
    take = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & _valid(F.col("vector"))).withColumn("dim", F.size("vector"))
    base, asked = (materialize(take(x).dropDuplicates(["id", "vector"]), "vectors") for x in (vectors, queries))
    figures = base.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("square"), F.count(F.lit(1)).alias("n")).first()
    norm = math.sqrt(figures["square"] or 1.0) * (1 + 1e-12)
    parts = max(1, -(-figures["n"] // s.vectors))
    own = ["dim", "part", "asks", "id", "vector"]
    left = base.withColumns({"part": F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), "asks": F.lit(False)}).select(*own)
    right = asked.withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "asks": F.lit(True)}).select(*own)
    # Each block's vectors come before its queries.
    dealt = left.unionByName(right).withColumn("query_key", F.when(F.col("asks"), F.xxhash64("vector"))).repartition(max(parts, tasks(base.sparkSession)), "dim", "part").sortWithinPartitions("dim", "part", "asks")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, key, held, index = ["query_id", "query_key", "vec_id", "score"], None, [], None
        for b in batches:
            marks = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "part", "asks")])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1), b.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                t, now, asks = b.slice(low, high - low), tuple(marks[:2, low]), marks[2, low]
                if now != key:
                    key, held, index = now, [], None
                if not asks:
                    held.append((t.column("id").to_numpy(), _matrix(t)))
                elif held or index:
                    if index is None:
                        ids, rows = (np.concatenate(x) for x in zip(*held, strict=True))
                        index, held = Index(ids, rows, norm, s), []
                    for k in range(0, t.num_rows, s.queries):
                        some = t.slice(k, s.queries)
                        wanted = some.column("id").to_numpy()
                        q, i, score, _ = index.search(wanted, _matrix(some))
                        yield pa.RecordBatch.from_arrays([pa.array(wanted[q]), pa.array(some.column("query_key").to_numpy()[q]), pa.array(i), pa.array(score)], names=names)

    found = dealt.mapInArrow(meet, "query_id long, query_key long, vec_id long, score double")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")
