"""The Merkle manifest against a plain loop, on nulls, ties, repeats, one source, one row and no rows."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkwake.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, i long, h string, leaf string, path string, root string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    """The root, and each node's siblings from the leaves up."""
    beside, spots = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(spots):
            run = nodes[at // fanout * fanout : at // fanout * fanout + fanout]
            beside[k] += [run[: at % fanout], run[at % fanout + 1 :]]
            spots[k] = at // fanout
        nodes = [H(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
    return nodes[0], beside


def expected(rows, fanout):
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        groups[source].append((doc_id, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, n_chars, text and text.lower())))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = tree([r[1] for r in groups[s]], fanout)
    root, above = tree([trees[s][0] for s in order], fanout)
    for k, s in enumerate(order):
        for r, own in zip(groups[s], trees[s][1], strict=True):
            path, h = own + above[k], r[2]
            for a, b in zip(path[::2], path[1::2], strict=True):
                h = H(*a, h, *b)
            out.append((r[0], r[1], trees[s][0], root, H(*(x for part in path for x in part)), h))
    return out


ROWS = [(k * 7 % 90, f"Text {k}" if k % 3 else f"text {k}", "en", f"s{k % 4}" if k % 5 else "big", 6) for k in range(90)]
ODD = [(None, None, None, None, None), (None, "", None, "s1", 0), (3, "Tie", "en", "big", 3), (3, "tie", "en", "big", 3), (3, "Tie", "en", "big", 3), (5, "lone", "en", "é", 4), (6, "lone", "en", "Z", 4), (7, "汉字", "zh", "", 2), (8, "x" * 300_000, "en", "s2", None)]


@pytest.mark.parametrize("rows,fanout", [(ROWS + ODD, 16), (ROWS + ODD, 2), (ROWS, 3), ([r for r in ROWS if r[3] == "big"], 4), (ODD[:1], 16)])
def test_against_a_loop(spark, rows, fanout):
    docs = spark.createDataFrame([(*r[:2], r[2], r[3], r[4], "k", 1, "h", "l", "p", "r") for r in rows], SCHEMA).repartition(5)
    claimed = merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.lower("text"))
    m = merkle.manifest(docs, fanout=fanout, claimed=claimed)
    proof = F.sha2(F.array_join(merkle.siblings(F.col("path")), ""), 256)
    got = merkle.proofs(m).select("id", "leaf", "subroot", "root", proof, merkle.folded(F.coalesce("claimed", "leaf"), F.col("path"))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected(rows, fanout), key=repr)
    for r in merkle.proofs(m).select("root", merkle.folded(F.col("leaf"), F.col("path")).alias("f")).distinct().collect():
        assert r.root == r.f


def test_no_rows(spark):
    m = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert m.root.count() == 0 and m.runs == [] and merkle.proofs(m).count() == 0


def test_values_do_not_run_into_each_other(spark):
    rows = spark.createDataFrame([("1:a", None), ("1", ":a"), (None, "1:a"), ("-", "-")], "a string, b string")
    assert rows.select(merkle.leaf_of(F.col("a"), F.col("b"))).distinct().count() == 4
