"""What the operators share: reading, intermediate tables and word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwake.tables import materialize, new_path, release, scope, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for added columns, lengthened until df has no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


SIEVE_BITS = 26


def sieve_place(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << SIEVE_BITS))


def sieve(df: DataFrame, *keys: Column) -> np.ndarray:
    """A bit for each place that a row of df has: 8 MB, whatever the number of rows. The more of them, the less it holds back."""
    at = df.select(sieve_place(*keys).alias("at")).select(F.expr("at div 64").cast("int").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
    t = at.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    out[t.column("word").to_numpy()] = t.column("bits").to_numpy()
    return out.view(np.uint64)


def sifted(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the places at may be a row's; the others are surely none's."""
    return (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def tasks(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for, which the cluster scales with its input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """df dealt by hash of keys over as many partitions as the session uses for shuffles."""
    return df.repartition(tasks(df.sparkSession), *keys)


def numbered(df: DataFrame, group: list[str], order: list[str], index: str, size: str) -> DataFrame:
    """df, written once, with each row's index (from 0) in its group by order, and the group's size.

    Rows are sorted by range over all partitions, whatever the groups' sizes, and numbered within their partition. What
    comes before a partition's rows of a group is summed from one count a partition and group, so a window holds at most
    as many rows as there are partitions. Group columns must not be null; rows that are equal in group and order are
    numbered in any order.
    """
    keys, (at, part, first, count) = [*group, *order], fresh(df, "at", "part", "first", "count")
    rows = df.repartitionByRange(tasks(df.sparkSession), *keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    rows = materialize(rows.withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    runs = rows.groupBy(part, *group).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(count))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum(count).over(whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(part, *group, (before - F.col(first)).alias(first), F.sum(count).over(whole).alias(size))
    return rows.join(runs, [part, *group]).withColumn(index, F.col(at) + F.col(first)).drop(at, part, first)


def hand_back() -> None:
    """Gives memory that is free, but still held by allocators, back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the C library of GNU
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, that hands back what it took: workers outlive their tasks, and an executor keeps several."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        hand_back()

    return whole


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of doc_id as text leaves remainder 0 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of uint64 (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher(dict):
    """word bytes -> 64-bit hash, remembering at most `keep` words."""

    def __init__(self, keep: int = 400_000):
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.keep:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
