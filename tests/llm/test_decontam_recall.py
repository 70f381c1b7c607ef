from sparkwake.llm import decontam


def test_verbatim_item_beside_a_repeated_word(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(n)) for x, n in (("first", 12), ("second", 24)))
    noise = [("second3 " * n + a + " second3" * m) for n, m in ((0, 70), (30, 40), (70, 0))]
    junk = ["second3 " * 300, "first1 " * 300, a.split()[0] + " second5" * 90]
    docs = spark.createDataFrame(list(enumerate([*noise, *junk])), "doc_id int, text string")
    found = decontam.leaks(docs, spark.createDataFrame([(1, a), (2, b)], "item_id int, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.lcs, r.start, r.stop) for r in found) == [(0, 1, 1.0, 0, 12), (1, 1, 1.0, 30, 42), (2, 1, 1.0, 70, 82)]
