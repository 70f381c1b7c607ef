"""Every stage of the pipeline on nulls, repeats, ties, clashing columns and empty tables; co-training's exchange."""

import numpy as np
import pytest

from sparkwake.llm import neardup, quality, warc

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, base int, linked string, _hit boolean, text_key string, kept boolean, item int"


def text(k, n=40):
    return " ".join(f"{WORDS[(i * (k % 13 + 2) + i * i // (k % 5 + 2) + k) % 16]}{(i * k) % 97}" for i in range(n))


def rows_of(texts):
    return [(i, t, "en", "s", len(t or ""), "k", 1, "l", True, "tk", False, 3) for i, t in texts]


@pytest.fixture
def docs(spark):
    near = text(3).rsplit(" ", 1)[0] + " other"
    odd = [(1, text(1)), (2, text(1)), (3, text(3)), (4, near), (5, None), (6, ""), (5, None), (1, text(1)), (7, text(7)), (7, near), (None, text(9)), (None, text(9)), (None, text(1)), (8, "token=abcdefghijklmnop and " + text(8)), (9, text(1))]
    return spark.createDataFrame(rows_of(odd), SCHEMA)


def test_one_of_each(docs):
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    # of repeated rows one; of a shared id only the row that is a copy goes; null ids go with a copy that has an id
    assert got == sorted([(1, text(1)), (3, text(3)), (5, None), (6, ""), (7, text(7)), (None, text(9)), (None, text(9)), (8, "token=abcdefghijklmnop and " + text(8))], key=str)
    assert neardup.one_of_each(docs.limit(0)).count() == 0


def test_links_of_null_ids(spark):
    a = text(2, 100)
    b = a.rsplit(" ", 1)[0] + " zz"
    found = neardup.near_duplicates(spark.createDataFrame([(7, a), (None, b)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.component_id, r.kept) for r in sorted(found, key=lambda r: r.doc_id or 0)] == [(None, 7, False), (7, 7, True)]


def test_every_stage(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (7, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, text(11)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0
        found = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert found.columns == docs.columns and none.columns == docs.columns
        rows = found.collect()
        if name in ("decontamination", "secrets"):
            assert len(rows) == docs.count()
        if name == "secrets":
            assert [r.text for r in rows if r.doc_id == 8][0].startswith("[SECRET] and ") and sum(r.text is None for r in rows) == 2
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows) and {r.base for r in rows} == {1}
        if name == "packing":
            assert len({r.doc_id for r in rows}) == 10 and len(rows) == docs.count()


def test_leaks_by_stage(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(f"term{k}" for k in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows_of([(None, "x " + item), (None, "fine"), (4, item + " y"), (4, "fine too")]), SCHEMA)
    left = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path))
    assert sorted(r.text for r in left.collect()) == ["fine", "fine too"]


def accuracy(seed, rounds):
    """Of co-training on two views that each tell the class in part, from 16 labelled rows."""
    rng = np.random.default_rng(seed)
    y = (rng.random(3000) < 0.5).astype(float)
    views = [np.where(y[:, None] > 0, 1.2, -1.2) * rng.random((3000, 12)) + 1.5 * rng.standard_normal((3000, 12)) for _ in range(2)]
    rest, taken = np.arange(16, 2000), [set(), set()]

    def surest(models, wanted):
        out = [[], []]
        for k, m in enumerate(models):
            p = 1 / (1 + np.exp(-m.logit(views[k][rest])))
            for mark, sure in ((1, p), (0, 1 - p)):
                some = [i for i in np.argsort(-sure) if sure[i] >= 0.95 and i not in taken[k]][: wanted[mark]]
                taken[k].update(some)
                out[k] += [(mark, views[1 - k][rest[i]]) for i in some]
        return out

    model = quality.co_train([v[:16] for v in views], y[:16], surest, quality.Settings(rounds=rounds))
    return ((model.score([v[2000:] for v in views]) >= 0.5) == y[2000:]).mean()


def test_exchange_helps():
    assert np.mean([accuracy(k, 4) for k in range(10)]) > np.mean([accuracy(k, 0) for k in range(10)]) + 0.02


def test_dictionary_sample_is_of_all_records():
    s = warc._Sample(warc.SAMPLE_BYTES)
    for k in range(20_000):
        s.add(b"%d" % k)
    seen = np.array([int(x) for x in s.kept])
    assert len(seen) == warc.SAMPLES and 8_000 < seen.mean() < 12_000
