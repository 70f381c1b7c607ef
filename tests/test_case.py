"""A capture from bytes to findings, index and reports, and as a stream."""

import json

import pytest

from sparkwake.functions import codec
from sparkwake.operators import case, dissect, export, index
from sparkwake.sources import capture
from sparkwake.streaming import alerts
from tests.test_core import pcap, tcp

WEB, SITE = ("10.0.0.9", "203.0.113.5", 4000, 80), ("203.0.113.5", "10.0.0.9", 80, 4000)
BOX, FTP = ("10.0.0.9", "203.0.113.6", 4001, 2121), ("203.0.113.6", "10.0.0.9", 2121, 4001)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    get = b"GET /admin?flag{one} HTTP/1.1\r\nHost: evil.example\r\nUser-Agent: curl/8\r\nAuthorization: Basic dXNlcjpwYXNz\r\n\r\n"
    ok = b"HTTP/1.1 200 OK\r\nContent-Length: 12\r\n\r\n\x89PNG12345678"
    frames = [tcp(*WEB, 1, 2), tcp(*SITE, 50, 18), tcp(*WEB, 2, 24, get), tcp(*SITE, 51, 24, ok), tcp(*BOX, 1, 2), tcp(*BOX, 2, 24, b"USER bob\r\nPASS hunter22\r\n"), tcp(*FTP, 9, 24, b"230 in\r\n")]
    where = tmp_path_factory.mktemp("captures")
    (where / "a.pcap").write_bytes(pcap(frames))
    return where


@pytest.fixture(scope="module")
def found(spark, folder, tmp_path_factory):
    return case.analyze(capture.read_capture(spark, str(folder)), str(tmp_path_factory.mktemp("case")))


def test_tables(found):
    assert found["statistics"].first().flows == 2 and found["flows"].where("packets = 4").count() == 1
    (art,) = found["artifacts"].collect()
    assert (art.mime, art.kind, art.name[-4:], art.size) == ("image/png", "Image", ".png", 12)
    assert {(r.kind, r.username, r.secret) for r in found["credentials"].collect()} >= {("HttpBasicAuth", "user", "pass"), ("FtpLogin", "bob", "hunter22")}
    rules = {r.rule: r for r in found["findings"].collect()}
    assert {"flag", "credential", "scripted_agent", "traffic", "external"} <= set(rules)
    assert rules["flag"].evidence == ["flag{one}"] and rules["flag"].category == "CtfFlag" and rules["flag"].attack == ["T1020"]
    assert {r.kind for r in found["indicators"].collect()} == {"IpAddress", "Url", "UserAgent", "FileHash"}
    text = found["summary"].first().summary
    assert text.startswith("capture: 2 conversations, 2 over TCP and 0 over UDP, in 7 packets") and "Credentials in the open" in text
    assert found["timeline"].where("kind = 'credential_harvested'").count() == found["credentials"].count()
    assert case.ranked(found["findings"]).first().severity == "Critical"


def test_empty_capture(spark, tmp_path):
    (tmp_path / "none.pcap").write_bytes(pcap([]))
    empty = case.analyze(capture.read_capture(spark, str(tmp_path)), str(tmp_path / "case"))
    assert empty["flows"].count() == empty["indicators"].count() == 0 and empty["summary"].count() == 1


def test_stored_index(spark, found, tmp_path):
    made = index.index_case(spark, str(tmp_path / "index"), found.tables, "a.pcap")
    ids = lambda q: {r.table for r in made.query(q).collect()}
    assert ids("evil.example") >= {"http", "texts"} and ids("http: admin") == {"http"} and ids("user_agent:curl") == {"http"}
    assert ids("hunter22 NOT user") == {"credentials"} and ids('"user bob"') >= {"texts"} and ids("^203 hunt*") <= {"texts"}
    assert ids("NEAR(bob hunter22, 2)") == {"texts"} and ids("NEAR(get curl, 1)") == set() and ids("nothing OR bob") >= {"credentials"}
    assert made.meta.where("key = 'source'").first().value == "a.pcap"
    (hit,) = made.query("findings: flag", 1).collect()
    assert "title=" in hit.snippet
    with pytest.raises(ValueError):
        made.query(" NOT ")
    with pytest.raises(Exception):
        index.SearchIndex.open(spark, str(tmp_path / "absent"))


def test_exports(spark, found):
    lines = export.stix_bundle(found["findings"], found["credentials"]).orderBy("part").collect()
    bundle = json.loads("".join(r.line for r in lines))
    kinds = [x["type"] for x in bundle["objects"]]
    assert kinds[0] == "identity" and kinds.count("indicator") == found["findings"].count() and kinds.count("observed-data") == found["credentials"].count()
    assert "hunter22" not in str([x for x in bundle["objects"] if x["type"] == "observed-data"])
    page = "".join(r.line for r in export.html_page(spark, "A <case>", {"flows": found["flows"]}, 1).orderBy("part").collect())
    assert page.count("<tr>") == 2 and "A &lt;case&gt;" in page and page.endswith("</html>")
    kinds = {(r.table, r.name): json.loads(r.type) for r in export.schema_table(spark, found.tables).collect()}
    assert kinds["flows", "flow_id"] == "string" and kinds["findings", "attack"]["elementType"] == "string"


def test_capture_stream(spark, folder, tmp_path):
    stream = alerts.captures(spark, str(folder), "protocol = 'tcp'")
    out = alerts.drain(alerts.packet_alerts(stream, ["flag\\{", "(", "PASS"]), "packet_alerts_test", str(tmp_path / "cp"))
    assert sorted(r.pattern for r in out.collect()) == ["PASS", "flag\\{"]
    alerts.record(stream, str(tmp_path / "packets"), str(tmp_path / "cp2"))
    assert case.analyze(spark.read.parquet(str(tmp_path / "packets")), str(tmp_path / "case"))["flows"].count() == 2


def test_broken_captures(spark):
    whole = pcap([tcp(*WEB, 1, 2)])
    rows = [("a", whole), ("b", whole[:-3]), ("c", b"nothing"), ("d", None)]
    got = {r.path: r for r in capture.summary(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert [got[k].problem for k in "abcd"] == [None, "the last record is cut off", "no capture", "no capture"] and got["a"].packets == 1 and got["b"].records == 0


def test_unpacking_is_bounded():
    import gzip

    assert codec.un_gzip(gzip.compress(b"x" * codec.MAX_OUTPUT)) == b"x" * codec.MAX_OUTPUT
    more = gzip.compress(b"x" * (codec.MAX_OUTPUT + 1))
    assert codec.un_gzip(more) is None and len(codec.apply_chain(more, "gunzip", most=1 << 30)) == codec.MAX_OUTPUT + 1


def test_best_effort_request():
    (tx,) = dissect.http(b"GET /x HTTP/1.1\r\nHost: h", b"")
    assert (tx["uri"], tx["host"], tx["status"]) == ("/x", "h", None)


def test_built_in_decoders(spark):
    import base64 as b64

    from pyspark.sql import functions as F

    texts = [b"", b"QUJD", b" QUJD\n", b"QUJ", b"QUI=", b"Q===", b"QU JD", b"4a4b", b"4a 4b\n", b"4", b"4a4", b"zz11", None, b64.b64encode(bytes(range(256))), bytes(range(256)).hex().encode()]
    df = spark.createDataFrame([(t,) for t in texts], "t binary").select("t", codec.decoded(F.col("t"), "base64").alias("b"), codec.decoded(F.col("t"), "hex").alias("h"))
    for r in df.collect():
        t = None if r.t is None else bytes(r.t)
        assert (r.b and bytes(r.b)) == (None if t is None else codec.un_base64(t)) and (r.h and bytes(r.h)) == (None if t is None else codec.un_hex(t)), t
