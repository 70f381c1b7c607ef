from sparkwake.llm import licenses


def test_every_place_of_a_licence(spark):
    mit, gpl2, gpl3 = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-2.0"][0], licenses.TEMPLATES["GPL-3.0"][1]
    edited = gpl2.replace("Foundation; either", "Foundation; and either").replace("can redistribute", "may redistribute")
    far = " word" * 200 + " "
    texts = [mit[0] + far + mit[0] + far + mit[2], gpl3 + far + edited, gpl3, " ".join([mit[2]] * 4), " ".join([mit[0]] * 3), edited + " " + gpl3, None]
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    told = lambda k: [x.rsplit(":", 3)[0] for x in rows[k].spans]
    assert told(0) == ["MIT"] * 3 and rows[0].licenses == ["MIT"] and rows[0].n_licenses == 1
    assert rows[0].spans[:2] == ["MIT:0:5:100", "MIT:205:210:100"]
    assert rows[1].licenses == ["GPL-2.0", "GPL-3.0"] and len(rows[1].spans) == 2
    assert told(2) == ["GPL-3.0"]
    size = len(licenses.words_of(mit[2]))
    assert rows[3].spans == [f"MIT:{k * size}:{(k + 1) * size}:100" for k in range(4)]
    assert rows[4].spans == [f"MIT:{k * 5}:{k * 5 + 5}:100" for k in range(3)]
    assert rows[5].licenses == ["GPL-2.0", "GPL-3.0"] and rows[6].spans == []
