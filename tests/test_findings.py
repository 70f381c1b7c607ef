import pytest
from pyspark.sql import functions as F

from sparkwake.operators import case, detect, export, rules
from sparkwake.plans import records

SCHEMA = "flow_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, ts_us long, fwd_bytes long, rev_bytes long, duration_us long, app string"


def test_every_flow_and_text_rule(spark):
    rows = [
        ("a", "10.0.0.1", "203.0.113.1", 40000, 443, "tcp", 0, 60_000, 100, 9_000_000, "Tls"), ("b", "10.0.0.1", "203.0.113.1", 40000, 443, "tcp", 900_000_000, 1, 1, 9_000_000, "Tls"),
        ("c", "10.0.0.1", "203.0.113.2", 40000, 4444, "tcp", 0, 1, 1, 0, None), ("d", "10.0.0.1", "203.0.113.2", 40000, 4444, "tcp", 0, 1, 1, 0, None),
        ("e", "10.0.0.1", "10.0.0.2", 0, 0, "icmp", 0, 400, 101, 0, "Icmp"), ("f", "10.0.0.1", "10.0.0.2", 0, 0, "icmp", 0, 400, 100, 0, "Icmp"), ("g", "10.0.0.2", "10.0.0.1", 990, 40001, "tcp", 0, 1, 1, 0, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    texts = spark.createDataFrame([("flag{x} and password=secret123",), ("flag{x}",), (None,)], "text string")
    found = {(r.rule, r.subject): (r.severity, r.confidence) for r in detect.all_findings(df, texts=texts).collect()}
    assert {k: v for k, v in found.items() if k[0] not in ("exfiltration", "traffic")} == {
        ("asymmetric", "a"): ("Medium", 0.65), ("encrypted_external", "203.0.113.1"): ("Medium", 0.7), ("suspicious_port", "c"): ("Medium", 0.6), ("suspicious_port", "d"): ("Medium", 0.6),
        ("icmp_volume", "e"): ("Medium", 0.6), ("ftps_port", "g"): ("High", 0.85), ("external", "2 addresses, 4 flows: 203.0.113.1 (2), 203.0.113.2 (2)"): ("Info", 0.3),
        ("flag", "flag{x}"): ("Critical", 1.0), ("credential", "HttpFormLogin secr...t123"): ("Medium", 0.95),
    }
    hellos = spark.createDataFrame([(None,), ("h",)], "sni string")
    (row,) = detect.all_findings(df, hellos).where("rule = 'encrypted_external'").collect()
    assert (row.severity, row.confidence) == ("Low", 0.4)
    assert [r.rule for r in detect.all_findings(df.limit(0)).collect()] == ["traffic"]
    ids = export.stix(detect.all_findings(df)).select(F.get_json_object("json", "$.id").alias("id"))
    assert ids.distinct().count() == ids.count()


def test_rules_of_ones_own(spark):
    """A row rule, a rule on a key that others use, and a rule on a source and key of its own."""
    df = spark.createDataFrame([(f"f{k}", "10.0.0.1", f"203.0.113.{k % 2}", 40000, 80, "tcp", 50 - k, 100 * k, 0, 0, "Http") for k in range(10)], SCHEMA)
    mine = rules.default().add(
        rules.Rule("tiny", "flows", "fwd_bytes < 200", "flow_id", "'Low'", "0.1", "ProtocolAnomaly", ("T1",)),
        rules.Rule("chatty", "flows", "inside > 4 and volume > 100", "key", "CASE WHEN volume > 2000 THEN 'High' ELSE 'Low' END", "0.5", key="address", measures={"inside": "sum(inside)", "volume": "sum(bytes)"}),
    ).add_key("mail", "sender", lambda d: d.withColumn("key", F.col("sender"))).add(rules.Rule("spam", "mail", "n > 1", "key", "'Medium'", "0.6", key="sender", measures={"n": "count(*)"}))
    mail = spark.createDataFrame([("a", 7), ("a", 5), ("b", 1)], "sender string, ts_us long")
    found = {(r.rule, r.subject): r for r in case.findings(df, registry=mine, mail=mail).collect()}
    assert found["tiny", "f1"].category == "ProtocolAnomaly" and found["tiny", "f1"].attack == ["T1"] and found["tiny", "f1"].first_us == 49
    assert found["chatty", "203.0.113.1"].severity == "High" and found["chatty", "203.0.113.0"].severity == "Low" and found["chatty", "203.0.113.1"].category == "Custom"
    assert (found["spam", "a"].first_us, found["spam", "a"].n) == (5, 1) and ("spam", "b") not in found
    assert {k for k, _ in found} == {"tiny", "chatty", "spam", "traffic", "external"}
    with pytest.raises(ValueError):
        rules.Registry().add(rules.Rule("x", "flows", "true", "key", "'Low'", "0.1", key="nothing"))
    clash = mine.add(rules.Rule("other", "flows", "inside > 1", "key", "'Low'", "0.1", key="address", measures={"inside": "max(inside)"}))
    with pytest.raises(ValueError):
        clash.findings(flows=df)


def test_equal_findings_are_one(spark):
    tx = spark.createDataFrame([("GET", f"/{k}", "h", "curl/8", 0, 0, 10 + k) for k in range(5)], "method string, uri string, host string, user_agent string, request_size long, response_size long, ts_us long")
    (one,) = case.described(rules.default().findings(http=tx)).collect()
    assert (one.rule, one.subject, one.n, one.first_us) == ("scripted_agent", "curl/8", 5, 10)


def test_rules_share_scans(spark):
    plan = records.finding_union_ranked(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 4
