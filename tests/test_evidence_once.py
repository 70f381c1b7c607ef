"""Evidence searches the texts once, however many joins read what was found."""

from sparkwake.plans import wire


def test_texts_are_searched_once(spark, tmp_path):
    texts = ["some words", "é" * 600, "", None, "a flag{other} " * 90]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = wire.QUERIES["evidence_packets"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "locate(" not in plan
    rows = {r.flag: (r.start, r.packets) for r in found.collect()}
    assert rows == {f"flag{{doc_{k}}}": (len((t or "").encode()) + 1, 1) for k, t in enumerate(texts)}
