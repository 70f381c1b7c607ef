"""A Merkle manifest of a dataset: digests of rows, a tree of them for each source, and a tree over the sources.

H is the lower-case hexadecimal SHA-256 of its inputs' concatenation. A leaf is H of a row's columns, each `-` if null,
else its length in UTF-8 bytes, `:` and the value. Within a source leaves ascend by id; while there are several nodes,
every `fanout` consecutive ones (a last run may be shorter, down to one) become their H. What remains is the source's
subroot, and a lone leaf is one itself. Subroots, by source (null first, else by bytes), become the root likewise.

Levels are DataFrames. Rows get their number in a source by numbered(), so that a source of any size is spread over all
partitions; a node's number divided by the fanout is its parent's, and a group is one run of at most `fanout` children,
hashed in order. Proofs go down the same levels: each joins the runs of a level with what lies above them and appends
the run, so what is joined is one row a run, not one a document. Documents come last, out of the runs of leaves. Texts
are read once and never shuffled; the driver learns the size of the
largest source and the number of sources, nothing else.

Defined results: null and empty texts are different leaves; a null id comes first in its source and hashes as `-`; rows
that share an id are ordered by their digests, equal rows are leaves each; a null source is a source of its own; an
empty table has no rows, no runs and no root. Columns that aren't named don't count, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwake.llm.common import materialize, numbered

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def measured(value: Column) -> Column:
    """A value with its length before it, `-` for null: no two rows give the same concatenation."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(measured, values)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path (array of struct(run, at), from the leaves to the root)."""
    swapped = lambda h, x: F.transform(x["run"], lambda y, k: F.when(k == x["at"], h).otherwise(y))
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.array_join(swapped(h, x), ""), 256))


def siblings(path: Column) -> Column:
    """The digests beside each node of a path, one array from the leaves to the root."""
    return F.flatten(F.transform(path, lambda x: F.filter(x["run"], lambda _, k: k != x["at"])))


@dataclass
class Manifest:
    """leaves: key, i, n, h and each row's id and claimed digest. runs, a table a level: key, n, p (the run's number), run
    (digests in order), and at level 0 the members' rows. subroots: key, h, level. over and top are the same two for the
    tree over subroots; root has one row, h, or none."""

    leaves: DataFrame
    runs: list[DataFrame]
    subroots: DataFrame
    over: DataFrame
    top: list[DataFrame]
    root: DataFrame
    fanout: int


def _levels(nodes: DataFrame, most: int, fanout: int, name: str, *carried: str) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level over nodes (key, n, i, h, carried), and what remains of each key: key, h, level."""
    runs, ends, fields = [], nodes.where("n = 1").select("key", "h", F.lit(0).alias("level")), carried
    while most > 1:
        grouped = nodes.where("n > 1").groupBy("key", "n", F.expr(f"i div {fanout}").alias("p")).agg(F.array_sort(F.collect_list(F.struct("i", "h", *fields))).alias("members"))
        run = F.transform("members", lambda x: x["h"]).alias("run")
        runs.append(materialize(grouped.select("key", "n", "p", run, *(["members"] if not runs else [])), name))
        nodes = runs[-1].select("key", F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), F.col("p").alias("i"), F.sha2(F.array_join("run", ""), 256).alias("h"))
        ends = ends.unionByName(nodes.where("n = 1").select("key", "h", F.lit(len(runs)).alias("level")))
        fields, most = (), -(-most // fanout)
    return runs, ends


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "source", order: str = "doc_id", fanout: int = FANOUT, claimed: Column | None = None) -> Manifest:
    """The manifest of docs. claimed is another digest of a row that its proof shall be held against (null: its leaf)."""
    group = F.coalesce(F.concat(F.lit("s"), F.col(key).cast("string")), F.lit(""))
    given = F.lit(None).cast("string") if claimed is None else claimed
    rows = materialize(docs.select(group.alias("key"), F.col(order).alias("id"), leaf_of(*map(F.col, columns)).alias("h"), given.alias("claimed")), "leaves")
    leaves = numbered(rows, ["key"], ["id", "h"], "i", "n")
    most = leaves.agg(F.max("n")).first()[0] or 0
    runs, ends = _levels(leaves, most, fanout, "runs", "id", "claimed")
    subroots = materialize(ends, "subroots")
    over = numbered(subroots.select(F.lit(0).alias("key"), F.col("key").alias("of"), "h", "level"), ["key"], ["of"], "i", "n")
    top, root = _levels(over, subroots.count(), fanout, "top", "of", "level")
    return Manifest(leaves, runs, subroots, over, top, root.select("h"), fanout)


def _paths(nodes: DataFrame, runs: list[DataFrame], ends: DataFrame, fanout: int, *carried: str) -> DataFrame:
    """h, carried, path and the further columns of ends for every node. ends: key, level, path (what lies above an end)."""
    more = [c for c in ends.columns if c not in ("key", "level", "path")]
    own, single = [*carried, "h", "path", *more], nodes.where("n = 1").select("key", "h", *carried).join(ends.where("level = 0").drop("level"), "key")
    out, above = single.select(*own), None
    for k in reversed(range(len(runs))):
        new = ends.where(F.col("level") == k + 1).select("key", F.lit(0).cast("long").alias("p"), "path", *more)
        above = new if above is None else above.unionByName(new)
        here = runs[k].join(above, ["key", "p"])
        each = here.select("key", "p", "run", "path", *more, F.posexplode("run" if k else "members").alias("at", "x"))
        each = each.withColumn("path", F.concat(F.array(F.struct("run", "at")), "path"))
        if k:
            above = each.select("key", (F.col("p") * fanout + F.col("at")).alias("p"), "path", *more)
        else:
            out = out.unionByName(each.select(*[F.col(f"x.{c}") for c in carried], "x.h", "path", *more))
    return out


def proofs(m: Manifest) -> DataFrame:
    """id, leaf, claimed, path, subroot, root of every row; path has each level's run and the node's place in it."""
    start = m.root.select(F.lit(0).alias("key"), F.lit(len(m.top)).alias("level"), F.array().cast("array<struct<run:array<string>,at:int>>").alias("path"), F.col("h").alias("root"))
    tops = _paths(m.over, m.top, start, m.fanout, "of", "level")
    found = _paths(m.leaves, m.runs, tops.select(F.col("of").alias("key"), "level", "path", "root", F.col("h").alias("subroot")), m.fanout, "id", "claimed")
    return found.withColumnRenamed("h", "leaf")
