import re

from sparkwake.llm import licenses


def test_windows_are_not_broadcast(spark, monkeypatch):
    """Only what the templates bound is sent to all executors: neither windows nor what was found, however small their files."""
    plans, written = [], licenses.materialize

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(licenses, "materialize", seen)
    notice = licenses.TEMPLATES["MIT"][0]
    found = licenses.scan(spark.createDataFrame([(1, notice), (2, "none"), (3, None), (4, notice)], "doc_id int, text string"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    broadcast = [keys for p in plans for keys in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", p)]
    assert len(plans) == 3 and broadcast and not [k for k in broadcast if "text_key" in k]
    assert {r.doc_id: r.licenses for r in found.collect()} == {1: ["MIT"], 2: [], 3: [], 4: ["MIT"]}
