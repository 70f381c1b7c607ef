"""The search over several blocks and dimensions against all inner products."""

import numpy as np
from pyspark.sql import functions as F

from sparkwake.llm import ann


def test_recall_over_blocks(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 24))
    x = centres[rng.integers(0, 30, 6000)] + 0.6 * rng.standard_normal((6000, 24))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(10_000 + k, rng.standard_normal(5).tolist()) for k in range(60)] + [(20_000, None), (20_020, [0.0] * 24), (20_040, [float("nan")] * 24), (40, x[40].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    s = ann.Settings(vectors=700, queries=64)
    found = ann.nearest(df.where(F.col("vec_id") % 20 == 0), df, s).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == [*range(0, 6000, 20), 10_000, 10_020, 10_040]
    hit = 0
    for q in range(0, 6000, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        best = set(np.lexsort((np.arange(6000), -scores))[:20].tolist())
        assert len(got[q]) == 20 and all(abs(score - scores[i]) < 1e-9 for i, score in got[q])
        hit += len(best & {i for i, _ in got[q]})
    assert hit / (300 * 20) >= 0.95
    assert all(10_000 <= i < 10_060 for q in (10_000, 10_020, 10_040) for i, _ in got[q])
