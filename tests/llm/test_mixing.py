"""The mixture against a plain loop: targets with stops, what each document gives, positions, order; odd rows."""

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sparkwake.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, key string, at long, target double"


def wanted(sizes, weights=(1, 2, 3), epochs=3):
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, total, out = set(order), Fraction(sum(sizes.values())), {}
    while left:
        share = {s: total * weight[s] / sum(weight[x] for x in left) for s in left}
        stops = {s for s in left if share[s] > epochs * sizes[s]}
        if not stops:
            return out | share, weight
        for s in stops:
            out[s] = Fraction(epochs * sizes[s])
        left, total = left - stops, total - sum(out[s] for s in stops)
    return out, weight


def expected(rows):
    sizes, groups = defaultdict(int), defaultdict(list)
    for i, t, s in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] += n
        groups[s].append((hashlib.md5(f"1:{'' if i is None else i}".encode()).hexdigest(), i is not None, i or 0, n, i))
    target, weight = wanted(sizes)
    out = []
    for s, docs in groups.items():
        budget, at = min(int(target[s] + Fraction(1, 2)), 3 * sizes[s]), 0
        for _, _, _, n, i in sorted(docs):
            out.append((i, n, sizes[s], round(float(target[s]), 6), sum(min(max(budget - e * sizes[s] - at, 0), n) for e in range(3))))
            at += n
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "k", 2, 3.0) for i, t, s in rows], SCHEMA).repartition(3)


rng = random.Random(5)
ROWS = [(k, " ".join("w" for _ in range(rng.choice((0, 1, 5, 40, 400)))), rng.choice(("hot", "hot", "hot", "a", "é", "tiny", None, "\U00010000", "￿"))) for k in range(300)]
ODD = [(None, None, None), (None, "", "empty"), (7, "tie one two", "a"), (7, "tie one two", "a"), (7, "tie one", "a"), (900, " not space \x0b\x0c x", "a"), (901, "w " * 200_000, "long")]


@pytest.mark.parametrize("rows", [ROWS + ODD, ROWS[:40], ODD[:2], ODD[:1] + ODD[-1:], ODD[4:5]])
def test_against_a_loop(spark, rows):
    mixed = mixing.mix(table(spark, rows))
    got = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixed.collect()]
    assert sorted(got, key=repr) == sorted(expected(rows), key=repr)
    assert all(t <= 3 * n for _, n, _, _, t in got)
    by = mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 0.5 for r in by)


def test_positions_follow_the_schedule(spark):
    rows = [(k, "w " * 10, s) for k in range(400) for s in "abc"]
    mixed = mixing.mix(table(spark, rows))
    order = mixing.schedule(mixed).collect()
    assert [r.position for r in order] == sorted(r.position for r in order) and all(0 <= r.position < 1 for r in order)
    half = lambda s: sum(r.words for r in order if r.source == s and r.position < 0.5) / sum(r.words for r in order if r.source == s)
    # the integral of each schedule over the first half: 1.5 to 1, 1 to 1.25, 0.5 to 1
    for s, share in (("a", 0.625), ("b", 0.5), ("c", 0.375)):
        assert abs(half(s) - share) < 0.01
    again = mixing.schedule(mixing.mix(table(spark, rows[::-1]))).collect()
    assert [tuple(r) for r in order] == [tuple(r) for r in again]
    kept = mixing.by_position(mixed).collect()
    assert len(kept) == len(rows) and all(r.position is None for r in kept if r.taken == 0)


def test_other_weights_and_no_rows(spark):
    rows = [(k, "w " * 10, s) for k in range(30) for s in "ab"]
    mixed = mixing.mix(table(spark, rows), weights=(1, 9), epochs=2, curriculum={1: (1.0, 1.0), 9: (0.0, 2.0)})
    assert {(r.source, r.target, r.taken) for r in mixed.groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()} == {("a", 60.0, 60), ("b", 540.0, 540)}
    assert mixing.mix(table(spark, []).limit(0)).count() == 0
