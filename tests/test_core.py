import base64
import io
import os
import random
import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkwake.functions import codec, net, text
from sparkwake.operators import case, detect, dissect, export, flows, index, reassembly, rules, search
from sparkwake.sources import capture
from sparkwake.streaming import alerts
from tests import plain_sessions

SF = "/root/testdata/sf0.001"
RECORDS = ["capture_decode", "capture_bounds", "packet_flows", "datagram_order", "stream_reassembly", "ftp_sessions", "smtp_sessions", "ssh_sessions", "telnet_sessions", "dhcp_leases", "smb_sessions", "icmp_messages", "tls_hellos", "dns_parse", "protocol_guess", "mime_magic", "http_artifacts", "credential_harvest", "findings_described", "ioc_union", "host_names", "timeline_case", "summary_case", "index_search", "index_phrase", "output_formats", "scalar_names", "decode_chains", "flows_oriented", "findings_on_roles", "evidence_packets", "http_times", "protocol_rules", "index_or", "index_not", "index_parentheses", "index_rows", "index_stored", "stream_alerts", "ip_enrichment"]


def tcp(src, dst, sp, dp, seq, flags, payload=b"", vlan=None):
    ip = lambda x: bytes(map(int, x.split(".")))
    body = struct.pack(">HHIIBBHHH", sp, dp, seq, 0, 5 << 4, flags, 100, 0, 0) + payload
    packet = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 7, 0, 64, 6, 0) + ip(src) + ip(dst) + body
    tag = b"" if vlan is None else struct.pack(">HH", 0x8100, vlan)
    return b"\1" * 6 + b"\2" * 6 + tag + b"\x08\0" + packet


def pcap(frames, start=1_700_000_000):
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for k, f in enumerate(frames):
        out += struct.pack("<IIII", start + k, 500, len(f), len(f)) + f
    return out


def pcapng(frame):
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    section = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    nano = struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0)
    ts = 1_700_000_000_000_000_500
    pad = frame + b"\0" * (-len(frame) % 4)
    return section + block(1, nano) + block(6, struct.pack("<IIIII", 0, ts >> 32, ts & 0xFFFFFFFF, len(frame), len(frame)) + pad)


def rows_of(data, **how):
    names = [c.split()[0] for c in capture.SCHEMA.split(", ")]
    return [dict(zip(names, r, strict=True)) for r in capture.packets(io.BytesIO(data), len(data), **how)]


def test_capture_formats():
    (row,) = rows_of(pcap([tcp("10.0.0.1", "10.0.0.2", 1234, 80, 1, 2, vlan=5), b"short", tcp("10.0.0.2", "10.0.0.1", 80, 1234, 9, 18)])[:-3])
    assert (row["offset"], row["src_ip"], row["src_port"], row["protocol"], row["vlan"]) == (24, "10.0.0.1", 1234, "tcp", 5)
    (row,) = rows_of(pcapng(tcp("1.1.1.1", "2.2.2.2", 1, 2, 3, 16, b"hi")))
    assert row["payload"] == b"hi" and row["ts"] % 1_000_000 == 0
    assert rows_of(b"") == []


def test_other_link_layers():
    frame = tcp("10.0.0.1", "10.0.0.2", 1234, 80, 1, 2, b"x")
    for kind, data in ((101, frame[14:]), (12, frame[14:]), (0, b"\2\0\0\0" + frame[14:]), (113, b"\0" * 14 + b"\x08\0" + frame[14:])):
        (row,) = rows_of(struct.pack(">IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, kind) + struct.pack(">IIII", 7, 5000, len(data), len(data)) + data)
        assert (row["src_ip"], row["payload"], row["ts"]) == ("10.0.0.1", b"x", 7_000_005)
    assert rows_of(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 250) + struct.pack("<IIII", 7, 5, 9, 9) + b"123456789") == []


def big_capture(rng, n=400, kind="pcap", damage=False):
    """Records of many sizes; some payloads hold whole captures of their own, which a reader may take for the outer one."""
    inner = pcap([tcp("6.6.6.6", "7.7.7.7", 1, 2, k, 16, b"inner") for k in range(12)])
    frames = []
    for k in range(n):
        body = inner if rng.random() < 0.2 else inner[24:] if rng.random() < 0.2 else bytes(rng.randrange(256) for _ in range(rng.randrange(0, 300)))
        frames.append(tcp("10.0.0.1", "10.0.0.2", 1000 + k % 50, 80, k, 24, body))
    if kind == "pcap":
        data = pcap(frames)
        return data[:-5] if damage else data
    block = lambda code, body: struct.pack("<II", code, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    section = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    micro, nano = block(1, struct.pack("<HHI", 1, 0, 0)), block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0))
    out = section + micro
    for k, f in enumerate(frames):
        if k == n // 3:
            out += nano  # a second interface that only shows up here
        if k == n // 2:
            out += section + nano + block(5, b"\0" * 8)  # and another section
        second = k >= n // 3 and k < n // 2 and k % 2
        ts = 1_700_000_000_000_000 + k if not (second or k >= n // 2) else 1_700_000_000_000_000_000 + k
        out += block(6, struct.pack("<IIIII", 1 if second else 0, ts >> 32, ts & 0xFFFFFFFF, len(f), len(f)) + f + b"\0" * (-len(f) % 4))
    return out


@pytest.mark.parametrize("kind,damage", [("pcap", False), ("pcap", True), ("pcapng", False)])
def test_ranges_give_the_rows_of_the_whole(kind, damage):
    rng = random.Random(11)
    data = big_capture(rng, 400, kind, damage)
    whole = rows_of(data)
    assert len(whole) == 400 - damage
    sections = [] if kind == "pcap" else [[place, code, data[place + 8 : place + size - 4].hex()] for place, code, size in capture.opened(io.BytesIO(data), len(data)).blocks(0, len(data), []) if code in (capture._SECTION, 1)]
    for _ in range(25):
        cuts = sorted({0, len(data), *(rng.randrange(len(data)) for _ in range(rng.randrange(1, 12)))})
        parts = [rows_of(data, low=a, high=b, back=4000, sections=sections) for a, b in zip(cuts, cuts[1:], strict=False)]
        assert [r for p in parts for r in p] == whole


def test_a_length_that_cannot_be_right():
    """Reading goes on behind a damaged record, and says so."""
    frames = [tcp("10.0.0.1", "10.0.0.2", 1000, 80, k, 24, b"data" * 20) for k in range(40)]
    data = bytearray(pcap(frames))
    at = 24 + 5 * (16 + len(frames[0]))
    data[at + 8 : at + 12] = b"\xff\xff\xff\x7f"
    problems: list[str] = []
    found = list(capture.records(io.BytesIO(data), len(data), problems=problems))
    assert len(found) == 39 and problems == ["a record is too large"]


def test_a_split_capture(spark, tmp_path):
    rng = random.Random(4)
    for name, kind in (("a.pcap", "pcap"), ("b.pcapng", "pcapng")):
        (tmp_path / name).write_bytes(big_capture(rng, 300, kind))
    key = lambda df: sorted(tuple(r) for r in df.select("path", "offset", "ts", "seq", F.md5("payload")).collect())
    whole = capture.read_capture(spark, str(tmp_path))
    parts = capture.read_capture(spark, str(tmp_path), split=20_000, back=4000)
    assert whole.rdd.getNumPartitions() == 2 and parts.rdd.getNumPartitions() > 6
    assert key(parts) == key(whole) and len(key(whole)) == 600
    (a, b) = capture.bounds(parts).orderBy("path").collect()
    assert a.packets == b.packets == 300 and a.first_us == 1_700_000_000_000_500


def test_a_capture_stream_continues(spark, tmp_path):
    """Files that grow in mid-record and rotate, bounded batches, and a restart: no packet is lost or comes twice."""
    frames = [tcp("10.0.0.1", "10.0.0.2", 1000, 80, k, 24, b"p%d" % k) for k in range(30)]
    data = pcap(frames)
    folder, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    cut = 24 + 10 * (16 + len(frames[0])) + 7

    def run(**options):
        stream = capture.stream_capture(spark, str(folder), **options).select("path", "offset", "seq")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
        return sorted((os.path.basename(r.path), r.seq) for r in spark.read.schema("path string, offset long, seq long").parquet(out).collect())

    (folder / "a.pcap").write_bytes(data[:cut])
    assert run() == [("a.pcap", k) for k in range(10)]
    assert run() == [("a.pcap", k) for k in range(10)]
    (folder / "a.pcap").write_bytes(data)
    (folder / "b.pcapng").write_bytes(pcapng(frames[3]))
    assert run(max_bytes=200) == [("a.pcap", k) for k in range(13)]
    for _ in range(2):
        assert run() == [("a.pcap", k) for k in range(30)] + [("b.pcapng", 3)]


def test_bounds_of_a_stream(spark, tmp_path):
    frames = [tcp("10.0.0.1", "10.0.0.2", 1000, 80, k, 24, b"p") for k in range(20)]
    (tmp_path / "a.pcap").write_bytes(pcap(frames))
    reader = capture._StreamReader({"path": str(tmp_path), "max_bytes": str(3 * (16 + len(frames[0]))), "max_packets": "8", "begin": "true"})
    (name,) = (str(tmp_path / "a.pcap"),)
    counts = [reader.latestOffset()[name][1] for _ in range(5)]
    assert counts == [3, 6, 8, 8, 8]
    again = capture._StreamReader({"path": str(tmp_path), "max_packets": "8"})
    assert again.latestOffset() == reader.latestOffset()


def assembled(segments):
    """Bytes of (sequence number, payload, SYN) segments, one by one, and whether some are missing: what reassembly is held against."""
    base = segments[0][0]
    rel = lambda n: (n - base + (1 << 31)) % (1 << 32) - (1 << 31)
    placed = sorted(((rel(n) + syn, k, d) for k, (n, d, syn) in enumerate(segments) if d), key=lambda x: (x[0], -len(x[2]), x[1]))
    starts = [rel(n) + 1 for n, _, syn in segments if syn]
    at, out, gap = min(starts) if starts else placed[0][0], b"", False
    for n, _, d in placed:
        if n + len(d) > at:
            gap, at = gap or n > at, max(n, at)
            out += d[at - n :]
            at = n + len(d)
    return out, gap


def test_reassembly_against_a_loop(spark):
    """Random segments of many flows: any order, overlaps that differ, repeats, gaps, wraps, with and without a SYN."""
    rng, rows, want = random.Random(3), [], {}
    for f in range(60):
        base, size, sent = rng.choice((0, 5, (1 << 32) - 40, rng.randrange(1 << 32))), rng.randrange(1, 200), []
        if rng.random() < 0.7:
            sent.append((base, b"", True))
        for _ in range(rng.randrange(1, 25)):
            a = rng.randrange(size)
            n = rng.randrange(1, 30)
            sent.append(((base + 1 + a) % (1 << 32), bytes(rng.randrange(256) for _ in range(n)), False))
        rng.shuffle(sent)
        want[f] = assembled(sent)
        rows += [(k * 60_000 + f, "10.0.0.1", "10.0.0.2", f, 80, "tcp", 2 if syn else 24, n, d) for k, (n, d, syn) in enumerate(sent)]
    packets = spark.createDataFrame(rows, "index long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, flags int, seq long, payload binary").repartition(6)
    port = flows.keyed(flows.placed(packets)).select("flow_id", F.col("src_port").alias("f")).distinct()
    got = {r.f: (bytes(r.data), r.gap) for r in reassembly.streams(packets).join(port, "flow_id").collect()}
    assert got == {f: x for f, x in want.items() if x[0]}


def test_reassembly_beyond_the_number_space(spark):
    """A direction of six GiB in sequence space: its pieces come in order and in cells of their own."""
    step = 1 << 30
    rows = [(0, 100, b"", 2)] + [(k * 2000, (101 + k * step) % (1 << 32), bytes([65 + k]) * 3, 24) for k in range(6)]
    packets = spark.createDataFrame([(i, "10.0.0.1", "10.0.0.2", 1, 80, "tcp", fl, n, d) for i, n, d, fl in rows], "index long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, flags int, seq long, payload binary")
    found = reassembly.intervals(packets).orderBy("at").collect()
    assert [(r.at, r.packed, r.gap) for r in found] == [(k * step, 3 * k, step - 3 if k else 0) for k in range(6)]
    plan = reassembly.intervals(packets)._jdf.queryExecution().toString()
    assert "InArrow" not in plan and "InPandas" not in plan
    whole = reassembly.streams(packets).first()
    assert bytes(whole.data) == b"AAABBBCCCDDDEEEFFF" and whole.gap and whole.bytes == 18
    assert reassembly.streams(packets, most=17).first().data is None
    (p,) = reassembly.located(spark.createDataFrame([(found[0].flow_id, True, 4, 8)], "flow_id string, forward boolean, start long, stop long"), reassembly.intervals(packets)).collect()
    assert (p.first_offset, p.last_offset, p.packets) == (2000, 4000, 2)


def test_capture_to_streams(spark, tmp_path):
    get = b"GET /a HTTP/1.1\r\nHost: h\r\nCookie: a=1; b=2\r\n\r\n"
    ok = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    c, s = ("10.0.0.9", "10.0.0.10", 4000, 80), ("10.0.0.10", "10.0.0.9", 80, 4000)
    frames = [tcp(*c, 100, 2), tcp(*s, 500, 18), tcp(*c, 111, 24, get[10:]), tcp(*c, 101, 24, get[:10]), tcp(*s, 501, 24, ok)]
    (tmp_path / "a.pcap").write_bytes(pcap(frames))
    packets = capture.read_capture(spark, str(tmp_path))
    (flow,) = flows.flows(packets).collect()
    assert (flow.lo_ip, flow.hi_ip, flow.client_forward, flow.app, flow.fwd_packets) == ("10.0.0.9", "10.0.0.10", True, "Http", 3)
    talk = dissect.conversations(reassembly.streams(packets), flows.flows(packets))
    (tx,) = dissect.http_transactions(talk).collect()
    assert (tx.method, tx.status, tx.cookies, tx.response_size) == ("GET", 200, ["a=1", "b=2"], 3)


def test_codec():
    assert codec.apply_chain(b"6447567a64413d3d", "hex | base64") == b"test"
    assert codec.apply_chain(codec.xor(b"hello", 0x42), "xor:0x42") == b"hello"
    assert codec.un_base64(b"abc") is None and codec.un_hex(b"abc") is None and codec.un_url(b"a+b") is None
    assert any(o == b"flag{found}" for _, o in codec.auto_decode(base64.b64encode(b"flag{found}")))
    with pytest.raises(ValueError):
        codec.apply_chain(b"x", "nope")


def test_dns_and_others():
    head = struct.pack(">HHHHHH", 1, 0x8180, 1, 1, 0, 0) + b"\7example\3com\0" + struct.pack(">HH", 1, 1)
    rows = dissect.dns(head + b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 300, 4) + bytes([93, 184, 216, 34]))
    assert [(r["name"], r["data"], r["ttl"]) for r in rows] == [("example.com", None, None), ("example.com", "93.184.216.34", 300)]
    assert dissect.dns(b"\0" * 5) == [] and dissect.dns(head[:12] + b"\xc0\x0c") == []
    assert plain_sessions.ftp(["227 Entering (192,168,1,1,4,1)", "229 ok (|||6446|)", "USER a", "PASS b", "RETR f"]) == {"username": "a", "password": "b", "files": ["f"], "auth_tls": False, "passive": False, "data_ports": [1025, 6446]}
    assert plain_sessions.smtp(["EHLO x", "MAIL FROM:<a@b>", "RCPT TO:<c@d>", "DATA", "Subject: hi", ".", "AUTH PLAIN " + base64.b64encode(b"\0u\0p").decode()])["password"] == "p"
    assert plain_sessions.ssh_banner(b"SSH-2.0-OpenSSH_8.9 x\r\n")["software"] == "OpenSSH_8.9"
    assert dissect.telnet(b"\xff\xfd\x01login: ")[0] == b"login: "
    lease = bytearray(240)
    lease[2] = 6
    lease[28:34], lease[236:240] = b"\xaa\xbb\xcc\xdd\xee\xff", b"\x63\x82\x53\x63"
    assert plain_sessions.dhcp(bytes(lease) + b"\x35\x01\x01\x0c\x06myhost\xff")["hostname"] == "myhost"
    assert dissect.icmp(b"\x08\0\0\0\0\0\0\0Hello")["payload"] == b"Hello"
    assert dissect.ja3(771, [0x0A0A, 4865], [0, 10], [29], [0])[0] == "771,4865,0-10,29,0"


@given(st.binary(max_size=300))
def test_parsers_never_raise(data):
    dissect.dns(data), dissect.dns(data, True), dissect.http(data, data), dissect.tls_hello(b"\x16\x03\x01" + data), dissect.smb(data), dissect.telnet(data), dissect.icmp(data)
    dissect.telnet_session([(True, data), (False, data)])
    rows_of(pcap([data]))


def test_sessions_against_loops(spark):
    rng, talk, leases = random.Random(12), [], []
    b64 = lambda x: base64.b64encode(x).decode()
    ftp = ["USER a b", "PASS  c", "user x", "RETR f.txt", "STOR \u00e9 g", "AUTH TLS", "auth ssl", "PASV", "PORT 1,2,3,4,5,6", "227 ok (1,2,3,4,7,8)", "229 in (|||99|)", "EPRT |1|1.1.1.1|77|", "", "  QUIT ", "227 none", "junk"]
    smtp = ["EHLO h", "helo  i ", "MAIL FROM:<a@b>", "mail from: <c@d> ", "RCPT TO:<e@f>", "RCPT TO:g@h", "AUTH LOGIN", b64(b"user"), b64(b"word"), "AUTH PLAIN " + b64(b"\0u\0p"), "DATA", "Subject: one", "text", "", ".", "NOOP", "RSET"]
    for k in range(120):
        lines = rng.choices(ftp if k % 2 else smtp, k=rng.randrange(12))
        end = rng.choice(("\r\n", "\n"))
        client = end.join(lines).encode() + (end.encode() if lines and rng.random() < 0.8 else b"")
        talk.append((str(k), client, end.join(rng.choices(ftp, k=rng.randrange(4))).encode()))
    lists = lambda n: b"".join(struct.pack(">I", len(x)) + x for x in rng.choices([b"a,b", b"", b"curve25519", b"x" * 40], k=n))
    for k in range(120, 170):
        offer = struct.pack(">IBB", 100, 4, rng.choice((20, 20, 21))) + b"c" * 16 + lists(rng.randrange(11))
        talk.append((str(k), rng.choice((b"SSH-2.0-OpenSSH_8.9 x\r\n", b"SSH-1.99-y\n", b"no", b"SSH-2.0", b"")) + offer[: rng.randrange(len(offer) + 1)], rng.choice((b"SSH-2.0-z w\r\n" + offer, b"", None))))
    for k in range(80):
        base = bytearray(rng.randrange(256) for _ in range(240))
        base[2], base[236:240] = rng.choice((6, 6, 1)), b"\x63\x82\x53\x63" if k % 9 else b"abcd"
        options = b"".join(rng.choice((b"\0", bytes([53, 1, rng.randrange(12)]), b"\x0c\x02hi", b"\x0f\x03dom", bytes([51, 4, 0, 0, 1, k]), bytes([51, 2, 0, 0]), bytes([3, 8, 1, 2, 3, 4, 5, 6, 7, 8]), bytes([6, 9, *range(9)]), bytes([54, 4, 9, 9, 9, 9]), bytes([99, 5, 1]), b"\xff")) for _ in range(rng.randrange(9)))
        leases.append((str(k), bytes(base) + options))
    df, segments = spark.createDataFrame(talk, "flow_id string, client binary, server binary"), spark.createDataFrame([*leases, ("short", b"x"), ("none", None)], "flow_id string, data binary")
    rows = lambda d: {r.pop("flow_id"): r for r in (x.asDict() for x in d.collect())}
    lines = lambda x: (x or b"").decode("utf-8", "replace").splitlines()
    size = lambda *x: sum(len(y or b"") for y in x)
    told, mail, ssh, lease = rows(dissect.ftp_sessions(df)), rows(dissect.smtp_sessions(df)), rows(dissect.ssh_sessions(df)), rows(dissect.dhcp_leases(segments))
    for k, c, s in talk:
        if int(k) < 120:
            assert told.get(k) == (plain_sessions.ftp(lines(c) + lines(s)) | {"bytes": size(c, s)} if size(c, s) else None), k
            assert mail.get(k) == (plain_sessions.smtp(lines(c)) if c else None) or "AUTH LOGIN" in lines(c), k
        want = plain_sessions.ssh(c or b"", s or b"")
        assert ssh.get(k) == (want[0] if want else None), k
    for k, d in leases:
        assert lease.get(k) == plain_sessions.dhcp(d), k
    assert len(lease) < len(leases)


def test_columns(spark):
    df = spark.createDataFrame([("10.0.0.10", "10.0.0.9", "xjfkqwrtzpls.evil.com"), ("8.8.8.8", "192.168.0.1", "mail.example.org")], "a string, b string, d string")
    rows = df.select(net.ip_key(F.col("a")) > net.ip_key(F.col("b")), net.is_external(F.col("a")), net.looks_generated(F.col("d")), net.root_domain(F.col("d"))).collect()
    assert [tuple(r) for r in rows] == [(True, False, True, "evil.com"), (False, True, False, "example.org")]
    flags = spark.createDataFrame([("some flag{a} more CTF{b}",)], "t string").select(text.flags(F.col("t")).alias("f")).first().f
    assert flags[:2] == ["flag{a}", "CTF{b}"]


def test_rules_at_threshold(spark):
    rows = [(k, "10.0.0.1", "203.0.113.1", 1, p, "tcp", 1_000_000_000 + k * 60_000_000, 100, 10, 0, "Http") for k, p in enumerate(range(16))]
    df = spark.createDataFrame(rows, "flow_id long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, ts_us long, fwd_bytes long, rev_bytes long, duration_us long, app string")
    assert detect.port_fanout(df).first().hit and not detect.port_fanout(df.where("dst_port < 15")).first().hit
    assert detect.beacons(df).first().hit
    assert {r.rule for r in detect.all_findings(df).collect()} == {"beacon", "port_scan", "traffic", "external"}
    assert export.stix(detect.all_findings(df)).count() == 4
    assert detect.all_findings(df.limit(0)).count() == 1


def test_search(spark):
    df = spark.createDataFrame([(1, "the evil.com host"), (2, "good host"), (3, None)], "id int, text string")
    assert [r.id for r in search.search(df, "evil.com", "id").collect()] == [1]
    assert [r.id for r in search.search(df, "host NOT evil", "id").collect()] == [2]
    assert {r.id for r in search.search(df, "ev* OR good", "id").collect()} == {1, 2}
    with pytest.raises(ValueError):
        search.parse("  ", set())


def test_longest_prefix(spark):
    import ipaddress

    from sparkwake.operators import enrich

    rng = random.Random(8)
    nets = ["0.0.0.0/0", "10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/23", "10.1.2.3", "2001:db8::/32", "2001:db8:0:1::/64", "::ffff:10.0.0.0/104", "fe80::/10", "10.1.0.0/16"]
    nets += [f"{rng.randrange(256)}.{rng.randrange(256)}.0.0/{rng.randrange(9, 17)}" for _ in range(60)]
    nets = [str(ipaddress.ip_network(n, strict=False)) for n in nets] + ["nothing", "10.0.0.0/40", None]
    ips = ["10.1.2.3", "10.1.2.4", "10.1.3.255", "10.1.4.0", "10.255.0.1", "11.0.0.1", "2001:db8::1", "2001:DB8:0:1:0::9", "fe80::1", "fec0::1", "::ffff:10.9.9.9", "::1", None, "10.1.2.3"] + [f"{rng.randrange(256)}.{rng.randrange(256)}.1.1" for _ in range(60)]
    found = enrich.looked_up(spark.createDataFrame([(i,) for i in ips], "ip string"), spark.createDataFrame([(n, f"about {n}") for n in nets], "network string, name string"))
    known = [ipaddress.ip_network(n) for n in nets if n not in ("nothing", "10.0.0.0/40", None)]
    for r in found.collect():
        address = r.ip and ipaddress.ip_address(r.ip)
        inside = [n for n in known if address and n.version == address.version and address in n]
        assert (r.about and r.about["network"]) == (str(max(inside, key=lambda n: n.prefixlen)) if inside else None), r.ip
    assert found.count() == len(ips) and "NestedLoop" not in found._jdf.queryExecution().toString()
    assert enrich.looked_up(spark.createDataFrame([("1.1.1.1",)], "ip string"), spark.createDataFrame([], "network string")).first().about is None


def test_flows_of_a_stream(spark, tmp_path):
    """The closed conversations of a stream are those of the batch, also when packets come late; open ones stay."""
    rng, rows = random.Random(6), []
    for f in range(25):
        at = rng.randrange(1000)
        for _ in range(rng.randrange(1, 12)):
            at += rng.choice((1, 5, 40, 130, 400))
            back = rng.random() < 0.4
            rows.append((at, f, back, rng.choice((2, 18, 24)), rng.choice((b"", b"data"))))
    rows.sort()
    packets = [("a", 0, k, at, *(("9.9.9.9", "10.0.0.1", 80, 1000 + f) if back else ("10.0.0.1", "9.9.9.9", 1000 + f, 80)), "tcp", flags_, data, 54) for k, (at, f, back, flags_, data) in enumerate(rows)]
    schema = "path string, file_us long, offset long, ts long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, flags int, payload binary, caplen long"
    own = spark.createDataFrame(packets, schema).withColumn("ts", F.timestamp_seconds("ts"))
    folder, shuffled = str(tmp_path / "in"), list(range(len(packets)))
    for part in range(4):  # each part's packets in any order: late within the watermark
        some = shuffled[part * len(packets) // 4 : (part + 1) * len(packets) // 4]
        rng.shuffle(some)
        spark.createDataFrame([packets[k] for k in some], schema).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(folder)
    end = spark.createDataFrame([("a", 0, 10**6, 10**6, "1.1.1.1", "2.2.2.2", 1, 2, "udp", None, b"", 1), ("a", 0, 10**6 + 1, 2 * 10**6, "1.1.1.1", "2.2.2.2", 1, 2, "udp", None, b"", 1)], schema).withColumn("ts", F.timestamp_seconds("ts"))
    end.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = alerts.drain(flows.flow_stream(stream, "120 seconds", "5 hours"), "flows_of_a_stream", str(tmp_path / "cp"))
    want = flows.flows(own, "120 seconds")
    plain = lambda df: sorted((tuple(r) for r in df.where("protocol = 'tcp'").select(sorted(set(df.columns) - {"flow_id"})).collect()), key=str)
    assert plain(got) == plain(want) and want.count() > 40
    assert got.where("protocol = 'udp'").count() == 1


def test_query_trees():
    def shown(node):
        return " ".join(node.terms) if isinstance(node, search.Phrase) else f"{node.kind}({', '.join(map(shown, node.parts))})"

    for text, tree in (
        ("a b", "and(a, b)"), ("a OR b c", "or(a, and(b, c))"), ("a b OR c", "or(and(a, b), c)"), ("(a OR b) c", "and(or(a, b), c)"), ("a NOT (b c)", "not(a, and(b, c))"), ("a NOT b c", "not(a, and(b, c))"), ("a NOT b NOT c", "not(not(a, b), c)"),
        ("a AND b OR c AND d", "or(and(a, b), and(c, d))"), ("a OR b NOT c", "or(a, not(b, c))"), ("((a))", "a"), ('"a b" c*', "and(a b, c*)"), ("evil.com", "evil com"), ("Caf\u00e9", "cafe"), ("not or", "and(not, or)"), ("x:y", "x y"), ("!!! a", "a"),
    ):
        assert shown(search.parse(text).tree) == tree, text
    q = search.parse("creds: user:bob NOT ^admin", {"credentials"}, {"user"})
    assert q.table == "credentials" and q.wanted == [search.Phrase(("bob",), "user")] and q.unwanted == [search.Phrase(("admin",), None, True)]
    assert search.parse("NEAR(a b, 3)").wanted == [search.Phrase(("a", "b"), near=3)]
    for text in ("", "NOT a", "a OR", "OR a", "a AND AND b", "(a", "a)", "()", "NOT", "!!!"):
        with pytest.raises(ValueError):
            search.parse(text)


def test_rows_that_share_a_key(spark):
    dns = spark.createDataFrame([("f", "evil.com"), ("f", "mail.org"), ("g", "evil.org")], "flow_id string, name string")
    made = index.SearchIndex.of({"dns": (dns, "flow_id", ("name",))})
    assert [r.id for r in made.query("dns: evil.org").collect()] == ["g"]
    assert sorted(r.id for r in made.query("dns: evil mail OR evil.org").collect()) == ["f", "g"]


def test_stream_alerts(spark, tmp_path):
    spark.createDataFrame([("flag{x}",), ("none",)], "text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    out = alerts.drain(alerts.alerts(stream, ["flag", "x"]), "alerts_test", str(tmp_path / "cp"))
    assert sorted(r.pattern for r in out.collect()) == ["flag", "x"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["canonical_key", "beacon_cv", "exfil_by_dst", "host_profiles", "url_sweep", "flag_sweep_dedup", "byte_entropy", "dns_volume", "creds_regex", "scoped_search", "mime_sniff", "phrase_search", *RECORDS])
def test_against_sql(spark, name):
    import duckdb

    from sparkwake.plans import catalog, records, wire

    con = duckdb.connect()
    for t in ("events", "documents", "pages", "benchmark", "orders", "lineitem", "nation"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    known, sql = (catalog.QUERIES | records.QUERIES | wire.QUERIES)[name], (catalog.ORACLE_SQL | records.ORACLE_SQL | wire.ORACLE_SQL)[name]
    a, b = known(spark, SF).toArrow().to_pylist(), con.execute(sql).to_arrow_table().to_pylist()

    def plain(v):
        return None if v is None else [plain(x) for x in v] if isinstance(v, list) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    rows = lambda t: sorted(str(sorted((k, plain(v)) for k, v in r.items())) for r in t)
    assert rows(a) == rows(b) and len(a)


def test_protocol_rules(spark):
    tx = spark.createDataFrame([("POST", "/gate.php", None, "curl/8", 200_000, 5), ("GET", "/", "h", "Mozilla/5.0 (X)", 0, 2_000_000)], "method string, uri string, host string, user_agent string, request_size long, response_size long")
    hello = spark.createDataFrame([("f", "client", 0x0301, None, next(iter(rules.BAD_JA3)))], "flow_id string, hello string, version int, sni string, ja3 string")
    names = spark.createDataFrame([("a" * 61, "A", 3, None)] * 6, "name string, type string, rcode int, data string")
    found = [r.rule for r in detect.ordered(rules.default().findings(http=tx, tls=hello, dns=names)).collect()]
    assert sorted(set(found)) == sorted({"scripted_agent", "large_post", "c2_path", "post_without_host", "large_download", "bad_ja3", "no_sni", "old_tls", "long_name", "nxdomain"})
    assert found[0] == "bad_ja3"
    many = spark.createDataFrame([(f"h{k}.evil.example", "A", 0, f"192.0.2.{k % 5}") for k in range(11)], "name string, type string, rcode int, data string")
    assert {(r.rule, r.subject) for r in rules.default().findings(dns=many).collect()} == {("dns_volume", "evil.example"), ("fast_flux", "evil.example")}
    iocs = case.indicators(dns=names, http=tx, artifacts=spark.createDataFrame([("x",)], "sha256 string")).collect()
    assert {(r.kind, r.confidence) for r in iocs} == {("Domain", 0.7), ("UserAgent", 0.7), ("UserAgent", 0.2), ("FileHash", 0.4), ("Url", 0.3), ("Url", 0.5)}
