"""Near duplicates from bottom-k sketches: one hash function, inverted lists, union sketches, exact Jaccard.

A document's set holds the hashes of its distinct shingles. Rows of equal sets form a class at once (its key is a
128-bit hash of the sorted set), and only one set of each class goes on. The k least hashes of a set are its
sketch. Inverted lists of the retained values tell which sets can be alike:

* a value kept by one class alone is no use to anyone and goes; a class needs `least` shared values to go on,
  which two sets of the wanted similarity share but for a chance of about 1e-9 (six standard deviations);
* each list has a leader, the member whose values are shared most, and each member is paired with the leaders of
  its lists, its best leader first; a group of thousands of near copies so takes thousands of pairs, not millions;
* what is still in different components meets in pools. Two sets with a link share a list among those of their
  rarest values, as many as the pigeonhole principle asks for; a list whose members are in several components goes
  to the pool of the component that most of them are in. In a pool, its members of other components are held
  against all others on full sets, block against block, and one link between two components suffices. So no link
  between components is lost, and no pairs are written out.

Before the leaders, sets of which too few shingles occur in other sets that went on to reach the wanted similarity
with any of them go, by counts over full sets. Pairs with leaders whose union sketch estimates a similarity too far
below the wanted one go; the rest is verified on full sets. Components come from contraction: each node joins its least neighbour, in the order of its random key, until
no link is left; nothing of this is gathered on the driver.

Sets are told apart by 128-bit hashes and shingles by 64-bit ones: among n shingles two share a hash by chance with
a probability of n * n / 2**65, and a link changes only if a share of such chances of its two sets does.

Full sets are made in a second pass over the texts, where they lie; a filter of fixed size passes over the rows that
none is needed of, so only sets that may have a link are shuffled.

Defined results: null or empty text, or one of white space only, has an empty set and is linked with nothing;
fewer words than a shingle make one shingle; repeated rows are copies; rows with a null doc_id are linked like all
others, but the id is ignored when the smallest of a component is sought (a component of null ids only has none, and
its rows are kept); an empty table gives no rows. Columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwake.llm.common import WordHasher, fresh, frugal, materialize, mix, release, scope, sieve, sieve_place, sifted, text_or_empty


@dataclass
class Settings:
    words: int = 5
    percent: int = 75  # 100 * intersection >= percent * union
    k: int = 64
    sigmas: float = 6.0
    block: int = 140  # sets of a pool in a block
    block_shingles: int = 500_000  # and shingles, unless a single set has more

    @property
    def floor(self) -> float:
        """Estimates below this are further than `sigmas` standard deviations below the wanted similarity."""
        j = self.percent / 100
        return j - self.sigmas * (j * (1 - j) / self.k) ** 0.5


_FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: str, hasher: WordHasher, words: int = 5) -> np.ndarray:
    """Sorted distinct signed 64-bit hashes of the word shingles of a text."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and white space is \x20\x09-\x0D
    if not found:
        return np.zeros(0, np.int64)
    h = hasher.hashes(found)
    n = min(words, len(h))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        acc = acc + h[i : len(h) - n + 1 + i] * _FACTORS[i]
    return np.unique(mix(acc).view(np.int64))


def text_key() -> Column:
    return F.xxhash64(text_or_empty()).alias("text_key")


def _key(u: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(u.tobytes())


def sketches(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, text_key, n_shingles, node (key of the set; null if empty), sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            sizes, nodes, least = [], [], []
            for t in b.column("text"):
                u = shingles(t.as_py(), hasher, s.words)
                sizes.append(len(u))
                nodes.append(_key(u) if len(u) else None)
                least.append(u[: s.k])
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in least])])
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(least) if least else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), lists], names=["doc_id", "text_key", "n_shingles", "node", "sketch"])

    return docs.select("doc_id", text_or_empty().alias("text"), text_key()).mapInArrow(frugal(run), f"doc_id {kind}, text_key long, n_shingles long, node binary, sketch array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """node, members (the sorted set), one row for each of nodes (node, and doc_id and text_key of a row that has the set)."""
    shared = docs.sparkSession.sparkContext.broadcast(sieve(nodes, F.col("doc_id"), F.col("text_key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        for b in batches:
            keys, sets = [], []
            for k in np.flatnonzero(sifted(shared.value, b.column("at").to_numpy())).tolist():
                u = shingles(b.column("text")[k].as_py(), hasher, s.words)
                if len(u) and (node := _key(u)) not in seen:
                    seen.add(node)
                    keys.append(node)
                    sets.append(u)
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), lists], names=["node", "members"])

    texts = docs.select(text_or_empty().alias("text"), sieve_place(F.col("doc_id"), text_key()).alias("at"))
    return texts.mapInArrow(frugal(run), "node binary, members array<long>").join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def estimate(a: Column, b: Column, k: int) -> Column:
    """Jaccard similarity by the k least values of the union of two sketches."""
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(least, F.array_intersect(a, b))) / F.size(least)


def verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) of nodes that are linked: sizes and union sketches first, then the full sets."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    near = near.where((100 * F.least("na", "nb") >= s.percent * F.greatest("na", "nb")) & (estimate(F.col("sa"), F.col("sb"), s.k) >= s.floor))
    whole = near.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("members").alias("ma")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("mb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("ma"), batch.column("mb"), strict=True)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit[i] = 100 * both >= s.percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(hit))

    return whole.select("a", "b", "ma", "mb").mapInArrow(frugal(run), "a binary, b binary")


def contract(links: DataFrame, labels: DataFrame | None, name: str) -> DataFrame:
    """node, label: labels after links (a, b between nodes) are added; nodes that neither names label themselves."""
    edges = links.select("a", "b")
    if labels is not None:
        edges = _relabel(edges, labels)
    edges = materialize(edges.where("a <> b").distinct(), name)
    found = labels
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("next")), F.struct(F.col("b").alias("node"), F.col("a").alias("next")))).alias("x")).select("x.*")
        to = materialize(ends.groupBy("node").agg(F.min("next").alias("least")).select("node", F.least("node", "least").alias("label")), name)
        if found is None:
            found = to
        else:
            moved = found.join(to.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
            fresh = to.join(found.select("node"), "node", "left_anti")
            found = materialize(moved.unionByName(fresh), name)
        edges = materialize(_relabel(edges, to).where("a <> b").distinct(), name)
    return found if found is not None else links.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)


def _relabel(edges: DataFrame, labels: DataFrame) -> DataFrame:
    for x in ("a", "b"):
        own = labels.select(F.col("node").alias(x), F.col("label").alias("to"))
        edges = edges.join(own, x, "left").withColumn(x, F.coalesce("to", x)).drop("to")
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def classes(docs: DataFrame, s: Settings | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, text_key, n_shingles, node) of every row; nodes that may be linked; node, label of those linked with others."""
    s = s or Settings()
    rows = materialize(sketches(docs, s), "sketches")
    nodes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    nodes = materialize(nodes.select("node", "row.*", "n_shingles", "sketch"), "nodes")
    values = nodes.select("node", "n_shingles", F.explode("sketch").alias("value"))
    shared = materialize(values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "values")
    kept = materialize(values.join(shared, "value"), "lists")
    least = F.floor(F.lit(s.floor) * F.least(F.col("n_shingles"), F.lit(s.k))).cast("int")
    stats = kept.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.sum("df").alias("weight"), F.first("n_shingles").alias("n_shingles")).where(F.col("c") >= F.greatest(least, F.lit(1)))
    stats = materialize(stats.withColumn("least", F.greatest(least, F.lit(1))), "stats")
    chosen = materialize(nodes.join(stats.select("node"), "node", "left_semi"), "chosen")
    sets = materialize(full_sets(docs, chosen, s), "sets")
    stats = materialize(stats.join(_possible(sets, s), "node", "left_semi"), "stats")
    lists = kept.select("node", "value").join(stats.select("node", "n_shingles", "least"), "node")
    again = lists.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    lists = materialize(lists.join(again, "value"), "lists")
    counts = lists.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.sum("df").alias("weight"))
    lists = materialize(lists.join(counts, "node").where("c >= least"), "lists")
    rank = F.struct((F.col("c") / F.lit(s.k)).alias("share"), "weight", F.col("node").alias("leader"))
    leaders = materialize(lists.groupBy("value").agg(F.max(rank).alias("top")).select("value", "top.leader"), "leaders")
    star = lists.join(leaders, "value").where("node <> leader").groupBy(F.col("node").alias("a"), F.col("leader").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    star = materialize(star, "star")
    best = star.groupBy("a").agg(F.max(F.struct("n", "b")).alias("top")).select("a", "top.b")
    labels = contract(verified(best, chosen, sets, s), None, "near")
    rest = star.select("a", "b").join(best, ["a", "b"], "left_anti")
    labels = contract(verified(materialize(_apart(rest, labels), "pairs"), chosen, sets, s), labels, "near")
    labels = contract(_pooled(lists, labels, sets, s), labels, "near")
    return rows, chosen, labels


def _possible(sets: DataFrame, s: Settings) -> DataFrame:
    """The nodes of sets of which enough shingles occur in others of sets for a link."""
    values = sets.select(F.xxhash64("node").alias("key"), F.explode("members").alias("value"))  # equal keys only keep more
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("value")
    counts = values.join(shared, "value").groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    sized = sets.select("node", F.xxhash64("node").alias("key"), F.size("members").alias("n"))
    return sized.join(counts, "key").where(100 * F.col("c") >= s.percent * F.col("n")).select("node")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs of nodes that are in different components so far."""
    for x in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")), x, "left").withColumn(f"l{x}", F.coalesce(f"l{x}", x))
    return pairs.where("la <> lb").select("a", "b")


def _pooled(lists: DataFrame, labels: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) between nodes that are in different components so far: at least one for each two components that are linked.

    Of two nodes with c and c' shared values that have at least `least` in common, the c - least + 1 rarest of one
    meet the c' - least' + 1 rarest of the other, least being the smaller of the two.
    """
    rare = lists.withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("df", "value"))).where("at <= c - least + 1")
    own = materialize(rare.join(labels, "node", "left").select("value", "node", F.coalesce("label", "node").alias("label")), "rare")
    tally = own.groupBy("value", "label").agg(F.count(F.lit(1)).alias("n"))
    pools = tally.groupBy("value").agg(F.max(F.struct("n", F.col("label").alias("pool"))).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("value", "top.pool")
    members = own.join(pools, "value").groupBy("pool", "node").agg(F.first("label").alias("label"))
    members = materialize(members.join(sets.select("node", F.size("members").alias("size")), "node").withColumn("asks", F.col("label") != F.col("pool")), "pools")
    blocks = lambda n, total: F.greatest(F.ceil(n / s.block), F.ceil(total / s.block_shingles), F.lit(1)).cast("int")
    count, total = F.count_if("asks"), F.sum(F.when(F.col("asks"), F.col("size")).otherwise(0))
    sizes = members.groupBy("pool").agg(blocks(count, total).alias("nx"), blocks(F.count(F.lit(1)), F.sum("size")).alias("ny"))
    sized = members.join(sizes, "pool").join(sets, "node")
    part = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["pool", "x", "y", "node", "label", "members"]
    asking = sized.where("asks").withColumn("x", part("nx", 1)).withColumn("y", every("ny")).select(*columns).toDF(*columns)
    asked = sized.withColumn("y", part("ny", 2)).withColumn("x", every("nx")).select(*columns)

    def meet(xs: pa.Table, ys: pa.Table) -> pa.Table:
        found: dict[tuple[bytes, bytes], tuple[bytes, bytes]] = {}
        if len(xs) and len(ys):
            column = ys.column("members").combine_chunks()
            size = column.value_lengths().to_numpy(zero_copy_only=False)
            values, owner = column.flatten().to_numpy(), np.repeat(np.arange(len(ys)), size)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            nodes, labels = ys.column("node").to_pylist(), ys.column("label").to_pylist()
            for node, label, own in zip(xs.column("node").to_pylist(), xs.column("label").to_pylist(), xs.column("members").combine_chunks(), strict=True):
                u = own.values.to_numpy()
                lo, hi = np.searchsorted(values, u, "left"), np.searchsorted(values, u, "right")
                n = hi - lo
                at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                both = np.bincount(owner[at], minlength=len(ys))
                for k in np.flatnonzero(100 * both >= s.percent * (len(u) + size - both)):
                    if labels[k] != label:
                        found.setdefault((min(label, labels[k]), max(label, labels[k])), (node, nodes[k]))
        schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
        return pa.Table.from_pylist([{"a": a, "b": b} for a, b in found.values()], schema)

    keys = ["pool", "x", "y"]
    return asking.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, "a binary, b binary")


def near_duplicates(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept, text_key, for every row of docs."""
    spark = docs.sparkSession
    with scope(spark) as made:
        rows, _, labels = classes(docs, s)
        smallest = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        joined = smallest.join(labels, "node", "left").select("node", "copies", F.col("label"), "first")
        groups = joined.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("first").alias("component"))
        told = joined.join(groups, "label", "left").select("node", F.coalesce("component", "first").alias("component_id"), (F.col("label").isNotNull() | (F.col("copies") > 1)).alias("more")).where("more").drop("more")
        told = materialize(told, "components")
        release(spark, [p for p in made if not p.rpartition("/")[2].startswith(("sketches-", "components-"))])
    columns = ["doc_id", "n_shingles", "node", "text_key"]
    # Empty sets have no class; a join would send them all to one task.
    none, some = (rows.where(F.col("node").isNull() if x else F.col("node").isNotNull()).select(*columns) for x in (True, False))
    out = some.join(told, "node", "left").unionByName(none.withColumn("component_id", F.lit(None).cast(rows.schema["doc_id"].dataType)))
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_key")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def one_of_each(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """The rows of docs that are kept, all columns as they are; of equal rows (doc_id and text) one.

    A row is decided upon by its doc_id and its text, so rows that share a doc_id but not the text are apart. Rows
    with a null doc_id go if a row with an id is in their component, and stay otherwise. Rows that surely are kept and
    occur once, as a filter of fixed size tells, stay where they are; the others meet their decision in a join.
    """
    spark = docs.sparkSession
    key = ["doc_id", "text_key"]
    decided = near_duplicates(docs, s).groupBy(*key).agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    touched = materialize(decided.where(~F.col("kept") | ((F.col("n") > 1) & F.col("doc_id").isNotNull())).select(*key, "kept"), "touched")
    shared = spark.sparkContext.broadcast(sieve(touched, *map(F.col, key)))

    @F.pandas_udf("boolean")
    def maybe(at):
        import pandas as pd

        return pd.Series(sifted(shared.value, at.to_numpy()))

    hit, text, one, other, kept = fresh(docs, "_hit", "_text", "_id", "_key", "_kept")
    marked = docs.withColumn(hit, maybe(sieve_place(F.col("doc_id"), text_key()))).withColumn(text, text_key())
    found = marked.where(hit).join(touched.toDF(one, other, kept), F.col("doc_id").eqNullSafe(F.col(one)) & (F.col(text) == F.col(other)), "left")
    found = materialize(found, "met")
    known, free = found.where(F.col(kept) & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", text]), found.where(F.col(kept).isNull())
    parts = [x.select(*docs.columns) for x in (marked.where(~F.col(hit)), free, known)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
