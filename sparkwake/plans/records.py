"""Registered queries over packets, records and cases that are generated from the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwake.functions import codec, mime, net
from sparkwake.operators import carve, case, detect, dissect, export, flows as flow_ops, index, reassembly
from sparkwake.plans.adapters import FLOWS, NAMES, OUTSIDE, flows, names
from sparkwake.sources import capture
from sparkwake.tables import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _number(value: Column | int, size: int) -> Column:
    """A number as hexadecimal digits of `size` bytes, high byte first."""
    return F.lpad(F.hex((F.lit(value) if isinstance(value, int) else value).cast("long")), 2 * size, "0")


def _bytes(*parts: Column | str) -> Column:
    """Hexadecimal digits, text columns being digits already, as bytes."""
    return F.unhex(F.concat(*[F.lit(p.replace(" ", "")) if isinstance(p, str) else p for p in parts]))


def _digits(text: Column) -> Column:
    return F.hex(F.encode(text, "UTF-8"))


def _key() -> Column:
    return F.col("n_nationkey")


def _name() -> Column:
    return F.col("n_name")


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation for each event; flow_id is the event's."""
    own = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    events = _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("flow_id"), (F.col("event_id") % 25).cast("int").alias("n_nationkey"))
    return events.join(F.broadcast(own), "n_nationkey").select("n_nationkey", "n_name", "flow_id")


def _grown(sql: str) -> str:
    """SQL over nation, over every event's nation in place of it."""
    each = "(SELECT event_id::varchar AS flow_id, n_nationkey, n_name FROM events JOIN nation ON n_nationkey = event_id % 25)"
    return sql.replace("n_nationkey::varchar AS flow_id", "flow_id").replace("n_nationkey::varchar AS path", "flow_id AS path").replace("FROM nation", f"FROM {each} AS nation")


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture of three records for each nation: TCP in a VLAN, a frame too short, and UDP."""
    ip = lambda kind, size, src, dst: (_number(0x4500, 2), _number(size, 2), _number(_key(), 2), "0000 40", kind, "0000", src, dst)
    size = F.octet_length(_name())
    inner, outer = F.concat(F.lit("0A0000"), _number(_key(), 1)), F.concat(F.lit("CB0071"), _number(_key(), 1))
    tcp = ("010101010101 020202020202 8100", _number(_key() + 1, 2), "0800", *ip("06", 40 + size, inner, outer), _number(40000 + _key(), 2), _number(80, 2), _number(1000 + _key(), 4), _number(0, 4), "5018 0064 0000 0000", _digits(_name()))
    udp = ("010101010101 020202020202 0800", *ip("11", 28 + size, outer, inner), _number(53, 2), _number(5000 + _key(), 2), _number(8 + size, 2), "0000", _digits(_name()))
    record = lambda second, n, *frame: (_number(1_700_000_000 + second, 4), _number(500, 4), _number(n, 4), _number(n, 4), *frame)
    content = _bytes("A1B2C3D4 0002 0004 00000000 00000000 0000FFFF 00000001", *record(_key(), 58 + size, *tcp), *record(_key() + 1, 5, "0000000000"), *record(_key() + 2, 42 + size, *udp))
    return _nations(spark, sf_dir).select(F.col("flow_id").alias("path"), content.alias("content"))


@query(_grown("""SELECT n_nationkey::varchar AS path, i::bigint AS index, (1700000000 + n_nationkey + i)::bigint * 1000000 + 500 AS ts_us, (CASE i WHEN 0 THEN 58 ELSE 42 END + strlen(n_name))::bigint AS caplen,
CASE i WHEN 0 THEN '10.0.0.' ELSE '203.0.113.' END || n_nationkey AS src_ip, CASE i WHEN 0 THEN '203.0.113.' ELSE '10.0.0.' END || n_nationkey AS dst_ip, (CASE i WHEN 0 THEN 40000 + n_nationkey ELSE 53 END)::int AS src_port, (CASE i WHEN 0 THEN 80 ELSE 5000 + n_nationkey END)::int AS dst_port,
CASE i WHEN 0 THEN 'tcp' ELSE 'udp' END AS protocol, (CASE i WHEN 0 THEN 24 END)::int AS flags, (CASE i WHEN 0 THEN 1000 + n_nationkey END)::bigint AS seq, n_name AS payload, (CASE i WHEN 0 THEN n_nationkey + 1 END)::int AS vlan, 64 AS ttl, n_nationkey::int AS ip_id FROM nation, (SELECT unnest([0, 2]) AS i)"""))
def capture_decode(spark, sf_dir):
    p = capture.decode(_captures(spark, sf_dir))
    return p.select("path", "index", F.unix_micros("ts").alias("ts_us"), "caplen", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "flags", "seq", F.col("payload").cast("string").alias("payload"), "vlan", "ttl", "ip_id")


@query(_grown("SELECT n_nationkey::varchar AS path, 3::bigint AS records, 2::bigint AS packets, 1::bigint AS unread, (1700000000 + n_nationkey)::bigint * 1000000 + 500 AS first_us, (1700000002 + n_nationkey)::bigint * 1000000 + 500 AS last_us, NULL::varchar AS problem FROM nation"))
def capture_bounds(spark, sf_dir):
    return capture.summary(_captures(spark, sf_dir)).drop("sha256")


@query("SELECT doc_id::varchar AS path, sha256(text) AS sha256, 0::bigint AS records, 'no capture' AS problem FROM documents")
def file_sha256(spark, sf_dir):
    files = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return capture.summary(files).select("path", "sha256", "records", "problem")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as packets between a user's host and a few servers, either way."""
    e = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    back, i = F.col("event_id") % 2 == 1, F.col("event_id")
    user = F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 256).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"))
    server, low = F.concat(F.lit("203.0.113."), (F.col("user_id") % 3).cast("string")), (40000 + F.col("user_id") % 7).cast("int")
    kind = F.when(F.col("event_type") == "error", "udp").when((F.col("event_type") == "signup"), "icmp").otherwise("tcp")
    port = F.when(kind == "udp", 53).when(kind == "icmp", 0).when(F.col("event_type") == "click", 80).otherwise(443)
    low = F.when(kind == "icmp", 0).otherwise(low)
    flags = F.when(kind == "tcp", F.when(i % 5 == 0, 2).when(i % 5 == 1, 18).otherwise(24))
    payload = F.when((kind == "tcp") & (i % 5 < 2), F.lit(b"")).otherwise(F.encode(F.coalesce("props", F.lit("")), "UTF-8"))
    pick = lambda a, b: F.when(back, b).otherwise(a)
    return e.select(i.alias("index"), F.col("ts").cast("timestamp").alias("ts"), pick(user, server).alias("src_ip"), pick(server, user).alias("dst_ip"), pick(low, port).cast("int").alias("src_port"), pick(port, low).cast("int").alias("dst_port"), kind.alias("protocol"), flags.cast("int").alias("flags"), payload.alias("payload"), (54 + F.octet_length(payload)).cast("long").alias("caplen"))


PACKETS = """raw AS (SELECT event_id AS index, ts, event_id % 2 = 1 AS back, '10.0.' || (user_id // 256)::varchar || '.' || (user_id % 256)::varchar AS u, '203.0.113.' || (user_id % 3)::varchar AS s, CASE event_type WHEN 'error' THEN 'udp' WHEN 'signup' THEN 'icmp' ELSE 'tcp' END AS protocol,
CASE event_type WHEN 'error' THEN 53 WHEN 'signup' THEN 0 WHEN 'click' THEN 80 ELSE 443 END AS sp, CASE event_type WHEN 'signup' THEN 0 ELSE 40000 + user_id % 7 END AS up, coalesce(props, '') AS props FROM events),
packets AS (SELECT index, ts, protocol, CASE WHEN back THEN s ELSE u END AS src_ip, CASE WHEN back THEN u ELSE s END AS dst_ip, (CASE WHEN back THEN sp ELSE up END)::int AS src_port, (CASE WHEN back THEN up ELSE sp END)::int AS dst_port, CASE WHEN protocol = 'tcp' THEN CASE index % 5 WHEN 0 THEN 2 WHEN 1 THEN 18 ELSE 24 END END AS flags,
CASE WHEN protocol = 'tcp' AND index % 5 < 2 THEN '' ELSE props END AS payload FROM raw),
keyed AS (SELECT *, 54 + octet_length(encode(payload)) AS caplen, src_ip LIKE '10.%' AS forward, CASE WHEN src_ip LIKE '10.%' THEN src_ip ELSE dst_ip END AS lo_ip, CASE WHEN src_ip LIKE '10.%' THEN src_port ELSE dst_port END AS lo_port, CASE WHEN src_ip LIKE '10.%' THEN dst_ip ELSE src_ip END AS hi_ip, CASE WHEN src_ip LIKE '10.%' THEN dst_port ELSE src_port END AS hi_port FROM packets),
flowed AS (SELECT *, 'FL-' || substr(sha256(concat_ws('|', protocol, lo_ip, lo_port::varchar, hi_ip, hi_port::varchar)), 1, 32) AS flow_id, coalesce(flags & 18 = 2, false) AS syn, octet_length(encode(payload)) > 0 AS data FROM keyed)"""
_CLIENT = "CASE WHEN min(index) FILTER (syn) IS NOT NULL AND (min(index) FILTER (data AND NOT syn) IS NULL OR min(index) FILTER (syn) < min(index) FILTER (data AND NOT syn)) THEN arg_min(forward, index) FILTER (syn) ELSE coalesce(arg_min(forward, index) FILTER (data AND NOT syn), arg_min(forward, index) FILTER (syn)) END"


@query(f"""WITH {PACKETS} SELECT flow_id, any_value(lo_ip) AS lo_ip, any_value(hi_ip) AS hi_ip, any_value(protocol) AS protocol, epoch_us(arg_min(ts, index))::bigint AS start_us, epoch_us(arg_max(ts, index))::bigint AS last_us, count(*) FILTER (forward)::bigint AS fwd_packets, count(*) FILTER (NOT forward)::bigint AS rev_packets,
coalesce(sum(caplen) FILTER (forward), 0)::bigint AS fwd_bytes, coalesce(sum(caplen) FILTER (NOT forward), 0)::bigint AS rev_bytes, count(*) FILTER (syn)::bigint AS syns, {_CLIENT} AS client_forward, any_value(protocol) = 'tcp' AND count(*) FILTER (syn) = 0 AS incomplete, abs(epoch_us(arg_max(ts, index)) - epoch_us(arg_min(ts, index)))::bigint AS duration_us,
CASE any_value(protocol) WHEN 'icmp' THEN 'Icmp' WHEN 'udp' THEN 'Dns' ELSE CASE any_value(hi_port) WHEN 80 THEN 'Http' ELSE 'Tls' END END AS app FROM flowed GROUP BY 1""")
def packet_flows(spark, sf_dir):
    f = flow_ops.flows(packets(spark, sf_dir))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return f.select("flow_id", "lo_ip", "hi_ip", "protocol", micros("start").alias("start_us"), micros("last").alias("last_us"), "fwd_packets", "rev_packets", "fwd_bytes", "rev_bytes", "syns", "client_forward", "incomplete", "duration_us", "app")


@query(f"WITH {PACKETS} SELECT flow_id, row_number() OVER (PARTITION BY flow_id ORDER BY index)::int AS seq_no, CASE WHEN protocol = 'icmp' THEN 'Unknown' WHEN forward THEN 'ClientToServer' ELSE 'ServerToClient' END AS direction, payload AS text FROM flowed WHERE protocol <> 'tcp' AND data")
def datagram_order(spark, sf_dir):
    return flow_ops.datagrams(packets(spark, sf_dir)).select("flow_id", "seq_no", "direction", F.col("data").cast("string").alias("text"))


@query(f"WITH {PACKETS} SELECT count(*) FILTER (flags & 18 = 2)::bigint AS syn_only, count(*) FILTER (flags & 18 = 18)::bigint AS syn_ack, count(*) FILTER (flags & 8 = 8)::bigint AS push, count(*)::bigint AS packets, sum(caplen)::bigint AS bytes, sum(octet_length(encode(payload))) FILTER (protocol = 'icmp')::bigint AS icmp_bytes, count(*) FILTER (protocol = 'icmp')::bigint AS icmp FROM flowed")
def packet_flags(spark, sf_dir):
    p = packets(spark, sf_dir)
    has = lambda n: net.flag_set(F.col("flags"), n)
    ping = F.col("protocol") == "icmp"
    return p.agg(F.count_if(net.is_syn_only(F.col("flags"))).alias("syn_only"), F.count_if(net.is_syn_ack(F.col("flags"))).alias("syn_ack"), F.count_if(has("PSH")).alias("push"), F.count(F.lit(1)).alias("packets"), F.sum("caplen").alias("bytes"), F.sum(F.when(ping, F.octet_length("payload"))).alias("icmp_bytes"), F.count_if(ping).alias("icmp"))


@query("""WITH d AS (SELECT doc_id, encode(text) AS b FROM documents WHERE strlen(text) > 0), g AS (SELECT doc_id, octet_length(b) AS n, doc_id % 10 = 0 AND octet_length(b) > 1000 AS gap, b FROM d)
SELECT doc_id::varchar AS tag, (n - CASE WHEN gap THEN 500 ELSE 0 END)::bigint AS bytes, gap, md5(CASE WHEN gap THEN unhex(substr(hex(b), 1, 1000) || substr(hex(b), 2001)) ELSE b END) AS digest FROM g""")
def stream_reassembly(spark, sf_dir):
    """Texts sent in segments of 500 bytes (with 20 of the next one), out of order and one twice; some lose their second one."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b")).where(F.octet_length("b") > 0)
    extra = lambda k: F.when((k == 0) & (F.col("doc_id") % 10 == 0), 0).otherwise(20)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("b") - 1) / 500)), lambda k: F.struct(k.alias("k"), F.substring("b", 500 * k.cast("int") + 1, (500 + extra(k)).cast("int")).alias("payload")))
    parts = d.select("doc_id", F.octet_length("b").alias("n"), F.explode(cut).alias("x")).select("doc_id", "n", "x.*").where(~((F.col("k") == 1) & (F.col("doc_id") % 10 == 0) & (F.col("n") > 1000)))
    sent = parts.withColumn("again", F.explode(F.when(F.col("k") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    base = 4294967000  # the numbers wrap
    index_ = F.xxhash64("doc_id", "k", "again")
    ports = [F.lit(40000).alias("src_port"), F.lit(80).alias("dst_port"), F.lit("tcp").alias("protocol")]
    address = lambda c: F.concat(F.lit("10."), *[F.concat(F.floor(c / n) % 256, F.lit("." if n > 1 else "")) for n in (65536, 256, 1)])
    ends = [address(F.col("doc_id")).alias("src_ip"), F.lit("203.0.113.1").alias("dst_ip"), *ports]
    data = sent.select(*ends, index_.alias("index"), ((F.lit(base) + 1 + 500 * F.col("k")) % (1 << 32)).alias("seq"), F.lit(24).alias("flags"), "payload", "doc_id")
    hello = d.select(*ends, F.lit(-(1 << 63)).alias("index"), F.lit(base).alias("seq"), F.lit(2).alias("flags"), F.lit(b"").alias("payload"), "doc_id")
    streams = reassembly.streams(data.unionByName(hello))
    tags = flow_ops.keyed(hello).select("flow_id", F.col("doc_id").cast("string").alias("tag"))
    return streams.join(tags, "flow_id").select("tag", "bytes", "gap", F.md5("data").alias("digest"))


def _talk(spark: SparkSession, sf_dir: str, client: Column, server: Column) -> DataFrame:
    return _nations(spark, sf_dir).select("flow_id", client.alias("client"), server.alias("server"))


def _wire(*parts: Column | str) -> Column:
    return F.encode(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), "UTF-8")


@query(_grown("""SELECT n_nationkey::varchar AS flow_id, n_name AS username, 'pw' || n_nationkey AS password, ['f' || n_nationkey || '.txt', 'up.bin'] AS files, n_nationkey % 2 = 0 AS auth_tls, true AS passive, [(4 * 256 + n_nationkey)::int] AS data_ports,
(strlen('USER ' || n_name || 'PASS pw' || n_nationkey || 'RETR f' || n_nationkey || '.txtSTOR up.binPASV' || CASE WHEN n_nationkey % 2 = 0 THEN 'AUTH TLS' || chr(13) || chr(10) ELSE '' END || '227 Entering (10,0,0,1,4,' || n_nationkey || ')') + 12)::bigint AS bytes FROM nation"""))
def ftp_sessions(spark, sf_dir):
    tls = F.when(_key() % 2 == 0, F.lit("AUTH TLS\r\n")).otherwise("")
    client = _wire("USER ", _name(), "\r\nPASS pw", _key(), "\r\nRETR f", _key(), ".txt\r\nSTOR up.bin\r\nPASV\r\n", tls)
    return dissect.ftp_sessions(_talk(spark, sf_dir, client, _wire("227 Entering (10,0,0,1,4,", _key(), ")\r\n")))


@query(_grown("SELECT n_nationkey::varchar AS flow_id, 'host' || n_nationkey AS helo, n_name || '@a.example' AS mail_from, ['x@b.example', 'y' || n_nationkey || '@b.example'] AS rcpt_to, n_name AS username, 'secret' || n_nationkey AS password, 'About ' || n_name AS subject, 'Subject: About ' || n_name || chr(10) || 'Hello ' || n_nationkey AS body FROM nation"))
def smtp_sessions(spark, sf_dir):
    secret = F.regexp_replace(F.base64(_wire(F.lit("\0"), _name(), "\0secret", _key())), r"\s", "")
    client = _wire("EHLO host", _key(), "\r\nAUTH PLAIN ", secret, "\r\nMAIL FROM:<", _name(), "@a.example>\r\nRCPT TO:<x@b.example>\r\nRCPT TO:<y", _key(), "@b.example>\r\nDATA\r\nSubject: About ", _name(), "\r\nHello ", _key(), "\r\n.\r\nQUIT\r\n")
    return dissect.smtp_sessions(_talk(spark, sf_dir, client, F.lit(b"")))


@query(_grown("SELECT n_nationkey::varchar AS flow_id, 'SSH-2.0-OpenSSH_8.' || n_nationkey || ' x' AS client_banner, 'SSH-2.0-' || n_name AS server_banner, 'OpenSSH_8.' || n_nationkey AS client_software, string_split(n_name, ' ')[1] AS server_software, ['curve', 'dh' || n_nationkey] AS kex, ['aes'] AS ciphers, ['sha', 'md5'] AS macs FROM nation"))
def ssh_sessions(spark, sf_dir):
    names_ = [F.concat(F.lit("curve,dh"), _key().cast("string")), F.lit("rsa"), F.lit("aes"), F.lit("aes"), F.lit("sha,md5")]
    lists = [x for n in names_ for x in (_number(F.octet_length(n), 4), _digits(n))]
    offer = _bytes(_digits(F.concat(F.lit("SSH-2.0-OpenSSH_8."), _key().cast("string"), F.lit(" x\r\n"))), "00000100 04 14 000102030405060708090A0B0C0D0E0F", *lists)
    return dissect.ssh_sessions(_talk(spark, sf_dir, offer, _wire("SSH-2.0-", _name(), "\r\n")))


@query(_grown("SELECT n_nationkey::varchar AS flow_id, 'login: ' || n_name || chr(10) || 'Password: pw' || n_nationkey || chr(10) AS content, ['DO Echo', 'WILL WindowSize'] AS options, n_name AS username, 'pw' || n_nationkey AS password FROM nation"))
def telnet_sessions(spark, sf_dir):
    part = lambda server, data: F.struct(F.lit(server).alias("server"), data.alias("data"))
    parts = F.array(part(True, _bytes("FFFD01 FFFB1F", _digits(F.lit("login: ")))), part(False, _wire(_name(), "\n")), part(True, _wire("Password: ")), part(False, _wire("pw", _key(), "\n")))
    found = dissect.telnet_sessions(_nations(spark, sf_dir).select("flow_id", parts.alias("parts")))
    return found.select("flow_id", "content", "options", F.explode("logins").alias("x")).select("flow_id", "content", "options", "x.username", "x.password")


@query(_grown("SELECT n_nationkey::varchar AS flow_id, CASE n_nationkey % 3 WHEN 0 THEN 'Discover' WHEN 1 THEN 'Offer' ELSE 'Request' END AS message, '02:00:00:00:00:' || printf('%02x', n_nationkey) AS mac, '10.0.0.' || n_nationkey AS address, n_name AS hostname, '10.0.0.254' AS router, ['10.0.0.53', '10.0.1.53'] AS dns, 'example' AS domain, 3600::bigint AS lease, '10.0.0.1' AS server FROM nation"))
def dhcp_leases(spark, sf_dir):
    option = lambda code, digits: (_number(code, 1), _number((F.char_length(digits) / 2).cast("int"), 1), digits)
    data = _bytes("02 01 06 00", "00" * 12, "0A0000", _number(_key(), 1), "00" * 8, "0200000000", _number(_key(), 1), "00" * 10, "00" * 192, "63825363", *option(53, _number(_key() % 3 + 1, 1)), *option(12, _digits(_name())), *option(3, F.lit("0A0000FE")), *option(6, F.lit("0A0000350A000135")), *option(15, _digits(F.lit("example"))), *option(51, _number(3600, 4)), *option(54, F.lit("0A000001")), "FF")
    return dissect.dhcp_leases(_nations(spark, sf_dir).select("flow_id", data.alias("data")))


@query(_grown("SELECT n_nationkey::varchar AS flow_id, ['Negotiate', 'SessionSetup', 'TreeConnect'] AS commands, ['\\\\srv\\' || n_name] AS shares, n_name AS ntlm_user, 'DOM' AS ntlm_domain FROM nation"))
def smb_sessions(spark, sf_dir):
    wide = lambda t: F.hex(F.encode(t, "UTF-16LE"))
    message = lambda code, *rest: F.concat(F.lit("FE534D42" + "00" * 8), F.lit(f"{code:02X}00"), *[F.lit(x) if isinstance(x, str) else x for x in rest])
    framed = lambda m: F.concat(F.lit("00"), _number((F.char_length(m) / 2).cast("int"), 3), m)
    user, dom = wide(_name()), wide(F.lit("DOM"))
    two = lambda n: F.concat(F.substring(_number(n, 2), 3, 2), F.substring(_number(n, 2), 1, 2))
    size = (F.char_length(user) / 2).cast("int")
    # lengths and places of the domain (at 28) and the user (at 36) in a message of kind 3
    ntlm = ("4E544C4D53535000 03000000", "00" * 16, two(F.lit(6)), two(F.lit(6)), "2C000000", two(size), two(size), "32000000", dom, user)
    client = F.concat(framed(message(0)), framed(message(1, *[x.replace(" ", "") if isinstance(x, str) else x for x in ntlm])), framed(message(3, wide(F.concat(F.lit("\\\\srv\\"), _name())), "0000")))
    return dissect.smb_sessions(_talk(spark, sf_dir, F.unhex(client), F.lit(b"")))


@query(_grown("SELECT n_nationkey::varchar AS flow_id, CASE n_nationkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 0 ELSE 42 END::int AS type, n_nationkey::int AS code, CASE n_nationkey % 3 WHEN 0 THEN 'Echo Request' WHEN 1 THEN 'Echo Reply' ELSE 'Type 42' END AS name, n_name AS payload FROM nation"))
def icmp_messages(spark, sf_dir):
    kind = F.when(_key() % 3 == 0, 8).when(_key() % 3 == 1, 0).otherwise(42)
    data = _bytes(_number(kind, 1), _number(_key(), 1), "000000010002", _digits(_name()))
    return dissect.icmp_messages(_nations(spark, sf_dir).select("flow_id", data.alias("data"))).withColumn("payload", F.col("payload").cast("string"))


@query(_grown("""SELECT n_nationkey::varchar AS flow_id, 'client' AS hello, 771 AS version, 'TLS 1.2' AS version_name, lower(replace(n_name, ' ', '')) || '.example' AS sni, ['h2'] AS alpn, md5('771,4865-' || (49195 + n_nationkey) || ',0-10-11-16,29-23,0') AS ja3 FROM nation"""))
def tls_hellos(spark, sf_dir):
    host = F.concat(F.lower(F.replace(_name(), F.lit(" "), F.lit(""))), F.lit(".example"))
    n = F.octet_length(host)
    ext = lambda code, digits: F.concat(_number(code, 2), _number((F.char_length(digits) / 2).cast("int"), 2), digits)
    all_ = F.concat(ext(0x0A0A, F.lit("")), ext(0, F.concat(_number(n + 3, 2), F.lit("00"), _number(n, 2), _digits(host))), ext(10, F.lit("00062A2A001D0017")), ext(11, F.lit("0100")), ext(16, F.lit("0003026832")))
    body = F.concat(F.lit("0303" + "11" * 32 + "00" + "00061A1A1301"), _number(49195 + _key(), 2), F.lit("0100"), _number((F.char_length(all_) / 2).cast("int"), 2), all_)
    size = (F.char_length(body) / 2).cast("int")
    data = F.unhex(F.concat(F.lit("160301"), _number(size + 4, 2), F.lit("01"), _number(size, 3), body))
    found = dissect.tls_hellos(_nations(spark, sf_dir).select("flow_id", data.alias("data")))
    return found.select("flow_id", "hello", "version", net.named(F.col("version"), dissect.TLS_VERSIONS).alias("version_name"), "sni", "alpn", "ja3")


_STARTS = (("Tls", "160301"), ("Http", "474554202F"), ("Ssh", "5353482D322E30"), ("Ftp", "555345522078"), ("Ftp", "323230206670"), ("Smtp", "3232302053 4D5450"), ("Smtp", "45484C4F2078"), ("Smb", "00000010FE534D42"), ("Telnet", "FFFD01"), ("Dns", "000101000001000000000000"), (None, "0102"))


@query(_grown("SELECT n_nationkey::varchar AS flow_id, CASE n_nationkey % 11 " + " ".join(f"WHEN {k} THEN '{name}'" for k, (name, _) in enumerate(_STARTS) if name) + " END AS spoken FROM nation"))
def protocol_guess(spark, sf_dir):
    start = F.element_at(F.array(*[F.lit(x.replace(" ", "")) for _, x in _STARTS]), _key() % 11 + 1)
    talk = _nations(spark, sf_dir).select("flow_id", F.lit(None).cast("string").alias("app"), F.unhex(start).alias("client"), F.lit(b"").alias("server"))
    return dissect.routed(talk).select("flow_id", "spoken")


_MAGIC = (*((name, start) for start, name in mime.MAGIC), ("application/gzip", "1F8B"), ("text/plain", ""), ("application/octet-stream", "0001020304"))


@query(_grown("SELECT n_nationkey, CASE n_nationkey % 10 " + " ".join(f"WHEN {k} THEN '{m}'" for k, (m, _) in enumerate(_MAGIC)) + " END AS mime, CASE n_nationkey % 10 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(("Image", "Image", "Image", "Archive", "Executable", "Executable", "Document", "Archive", "File", "File"))) + " END AS kind, CASE n_nationkey % 10 " + " ".join(f"WHEN {k} THEN '{mime.EXTENSIONS.get(m, 'bin')}'" for k, (m, _) in enumerate(_MAGIC)) + " END AS extension FROM nation"))
def mime_magic(spark, sf_dir):
    data = F.unhex(F.concat(F.element_at(F.array(*[F.lit(x) for _, x in _MAGIC]), _key() % 10 + 1), F.when(_key() % 10 == 8, _digits(F.concat(_name(), F.lit(" text")))).otherwise(F.lit("00FF00FF"))))
    rows = _nations(spark, sf_dir).select("n_nationkey", mime.by_magic(data).alias("mime"))
    return rows.select("n_nationkey", "mime", mime.kind_of(F.col("mime")).alias("kind"), mime.extension_of(F.col("mime")).alias("extension"))


def _web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as HTTP conversations, one in four by POST."""
    client = F.encode(F.concat(F.when(F.col("page_id") % 4 == 0, "POST ").otherwise("GET "), F.lit("/p/"), F.col("page_id").cast("string"), F.lit(" HTTP/1.1\r\nHost: h"), (F.col("page_id") % 5).cast("string"), F.lit(".example\r\nUser-Agent: "), F.when(F.col("page_id") % 3 == 0, "curl/8.0").otherwise("Mozilla/5.0 (X11)"), F.lit("\r\nAuthorization: Basic "), F.regexp_replace(F.base64(F.encode(F.concat(F.lit("user"), (F.col("page_id") % 7).cast("string"), F.lit(":pw:x")), "UTF-8")), r"\s", ""), F.lit("\r\nCookie: session=s"), (F.col("page_id") % 3).cast("string"), F.lit("; lang=en\r\n\r\n")), "UTF-8")
    server = F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.coalesce("html", F.lit(""))), "UTF-8")
    return _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("flow_id"), client.alias("client"), server.alias("server"))


@query("""WITH a AS (SELECT sha256(html) AS sha256, md5(html) AS md5, octet_length(encode(html))::bigint AS size, min(page_id::varchar) AS flow_id, count(*)::bigint AS copies FROM pages WHERE html <> '' GROUP BY ALL)
SELECT 'AR-' || substr(sha256, 1, 32) AS id, 'File' AS kind, 'http_response_0_' || substr(sha256, 1, 8) || '.html' AS name, 'text/html' AS mime, size, sha256, md5, flow_id, 0 AS ordinal, copies FROM a""")
def http_artifacts(spark, sf_dir):
    return carve.artifacts(dissect.http_bodies(_web(spark, sf_dir)))


@query("""SELECT DISTINCT 'HttpBasicAuth' AS kind, 'user' || (page_id % 7) AS username, 'pw:x' AS secret, 'http' AS service, 'h' || (page_id % 5) || '.example' AS host FROM pages UNION ALL SELECT DISTINCT 'SessionCookie', 'session', 's' || (page_id % 3), 'http', 'h' || (page_id % 5) || '.example' FROM pages UNION ALL SELECT 'FtpLogin', n_name, 'pw' || n_nationkey, 'ftp', NULL FROM nation UNION ALL SELECT 'TelnetLogin', n_name, 'pw' || n_nationkey, 'telnet', NULL FROM nation UNION ALL SELECT 'BearerToken', NULL, 'abcdefgh' || n_nationkey, 'text', NULL FROM nation""")
def credential_harvest(spark, sf_dir):
    http = dissect.http_transactions(_web(spark, sf_dir))
    ftp = dissect.ftp_sessions(_talk(spark, sf_dir, _wire("USER ", _name(), "\r\nPASS pw", _key(), "\r\n"), F.lit(b"")))
    part = lambda server, data: F.struct(F.lit(server).alias("server"), data.alias("data"))
    telnet = dissect.telnet_sessions(_nations(spark, sf_dir).select("flow_id", F.array(part(True, _wire("login: ")), part(False, _wire(_name(), "\n")), part(True, _wire("Password: ")), part(False, _wire("pw", _key(), "\n"))).alias("parts")))
    texts = _nations(spark, sf_dir).select(F.concat(F.lit("Authorization: Bearer abcdefgh"), _key().cast("string")).alias("text"))
    return carve.harvest(http, ftp, None, telnet, texts).drop("id")


_OUT, _SRC = OUTSIDE.format("dst_ip"), OUTSIDE.format("src_ip")
_RANK = "CASE severity WHEN 'Info' THEN 0 WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 4 END::int"
_PORTS = ", ".join(map(str, detect.SUSPICIOUS_PORTS))
_ADMIN = ", ".join(map(str, detect.ADMIN_PORTS))
#: Every rule over flows, in SQL.
FOUND = f"""found AS (
SELECT 'exfiltration' AS rule, ip AS subject, CASE WHEN o > 1000000 THEN 'High' WHEN o > 100000 THEN 'Medium' WHEN o / greatest(a, 1) > 0.7 THEN 'Medium' ELSE 'Low' END AS severity, CASE WHEN o > 1000000 THEN 0.8 ELSE greatest(CASE WHEN o > 100000 THEN 0.6 ELSE 0.4 END, CASE WHEN o / greatest(a, 1) > 0.7 THEN 0.7 ELSE 0 END) END::double AS confidence, t AS first_us
FROM (SELECT min(ts_us) AS t, CASE WHEN {_OUT} THEN dst_ip ELSE src_ip END AS ip, sum(CASE WHEN {_OUT} THEN fwd_bytes ELSE rev_bytes END) AS o, sum(fwd_bytes + rev_bytes) AS a FROM flows WHERE {_OUT} <> {_SRC} GROUP BY 2) WHERE o > 10000
UNION ALL SELECT 'asymmetric', flow_id::varchar, 'Medium', 0.65, ts_us FROM flows WHERE fwd_bytes > 0 AND rev_bytes > 0 AND fwd_bytes / (fwd_bytes + rev_bytes) > 0.85 AND fwd_bytes > 50000 AND {_OUT}
UNION ALL SELECT 'beacon', dst_ip, 'High', 0.8, t FROM (SELECT dst_ip, min(ts_us) AS t, count(*) AS n, avg(gap) AS m, stddev_pop(gap) AS sd FROM (SELECT dst_ip, ts_us, floor((ts_us - lag(ts_us) OVER (PARTITION BY dst_ip ORDER BY ts_us, flow_id)) / 1000000.0) AS gap FROM flows WHERE {_OUT} AND NOT {_SRC}) GROUP BY 1) WHERE n >= 3 AND m < 300 AND CASE WHEN m > 0 THEN sd / m ELSE 1 END < 0.3
UNION ALL SELECT 'encrypted_external', dst_ip, 'Medium', 0.7, t FROM (SELECT dst_ip, min(ts_us) AS t, count(*) FILTER (NOT {_SRC}) AS n, count(*) FILTER (app = 'Tls') AS e, sum(fwd_bytes + rev_bytes) AS b FROM flows WHERE {_OUT} GROUP BY 1) WHERE n >= 2 AND e > 0 AND b > 5000
UNION ALL SELECT 'suspicious_port', flow_id::varchar, 'Medium', 0.6, ts_us FROM flows WHERE {_OUT} AND dst_port IN ({_PORTS})
UNION ALL SELECT 'icmp_volume', flow_id::varchar, 'Medium', 0.6, ts_us FROM flows WHERE app = 'Icmp' AND fwd_bytes + rev_bytes > 500
UNION ALL SELECT 'ftps_port', flow_id::varchar, 'High', 0.85, ts_us FROM flows WHERE 990 IN (src_port, dst_port)
UNION ALL SELECT 'port_scan', src_ip, 'Medium', 0.75, min(ts_us) FROM flows GROUP BY src_ip HAVING count(DISTINCT dst_port) > 15
UNION ALL SELECT 'lateral', src_ip, 'High', 0.7, (SELECT min(ts_us) FROM flows f WHERE f.src_ip = flows.src_ip) FROM flows WHERE NOT {_OUT} AND NOT {_SRC} AND dst_port IN ({_ADMIN}) GROUP BY src_ip HAVING count(DISTINCT dst_ip || ':' || dst_port) > 2
UNION ALL SELECT 'cleartext_' || lower(app), app, CASE app WHEN 'Ftp' THEN 'High' ELSE 'Medium' END, CASE app WHEN 'Smtp' THEN 0.7 ELSE 0.9 END, min(ts_us) FROM flows WHERE app IN ('Ftp', 'Telnet', 'Smtp') GROUP BY app
UNION ALL SELECT 'short_encrypted', dst_ip, 'Medium', 0.65, (SELECT min(ts_us) FROM flows f WHERE f.dst_ip = flows.dst_ip) FROM flows WHERE app = 'Tls' AND duration_us < 2000000 AND fwd_bytes + rev_bytes < 5000 AND {_OUT} GROUP BY dst_ip HAVING count(*) >= 3
UNION ALL SELECT 'traffic', count(*)::varchar, 'Info', 0.2, min(ts_us) FROM flows
UNION ALL SELECT 'external', any_value(h)::varchar || ' addresses, ' || any_value(f)::bigint::varchar || ' flows: ' || string_agg(dst_ip || ' (' || n || ')', ', ' ORDER BY n DESC, dst_ip), 'Info', 0.3, NULL FROM (SELECT dst_ip, n, count(*) OVER () AS h, sum(n) OVER () AS f, row_number() OVER (ORDER BY n DESC, dst_ip) AS r FROM (SELECT dst_ip, count(*) AS n FROM flows WHERE {_OUT} GROUP BY 1)) WHERE r <= 5 HAVING count(*) > 0)"""


@query(f"WITH {FLOWS}, {FOUND} SELECT rule, subject, severity, confidence, {_RANK} AS severity_rank FROM found")
def finding_union_ranked(spark, sf_dir):
    return detect.all_findings(flows(spark, sf_dir))


_KEY = "sha256(rule || '|' || subject)"


@query(f"""WITH {FLOWS}, {FOUND} SELECT '{{"type":"indicator","spec_version":"2.1","id":"indicator--' || concat_ws('-', substr({_KEY}, 1, 8), substr({_KEY}, 9, 4), '5' || substr({_KEY}, 14, 3), '8' || substr({_KEY}, 18, 3), substr({_KEY}, 21, 12)) || '","name":"' || rule || '","description":"' || subject || '","confidence":' || round(confidence * 100)::int || ',"labels":["' || severity || '","' || rule || '"]}}' AS json FROM found""")
def stix_export(spark, sf_dir):
    return export.stix(detect.all_findings(flows(spark, sf_dir)))


def _cases(column: int) -> str:
    return " ".join(f"WHEN '{k}' THEN " + (f"'{v[0]}'" if column == 0 else "[" + ", ".join(f"'{t}'" for t in v[1]) + "]::varchar[]") for k, v in case.RULES.items())


@query(f"WITH {FLOWS}, {FOUND} SELECT 'F-' || substr({_KEY}, 1, 32) AS id, rule, subject, severity, {_RANK} AS severity_rank, confidence, CASE rule {_cases(0)} END AS category, CASE rule {_cases(1)} END AS attack, CASE WHEN rule IN ('exfiltration', 'encrypted_external') THEN ['flows:\"' || subject || '\"'] ELSE []::varchar[] END AS pivots, []::varchar[] AS evidence, list_reduce(list_transform(string_split(rule, '_'), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || ' ' || b) || ': ' || subject AS title FROM found")
def findings_described(spark, sf_dir):
    return case.findings(flows(spark, sf_dir)).drop("n", "first_us")


@query(f"WITH {FLOWS}, {FOUND} SELECT CASE rule {_cases(0)} END AS category, count(*)::bigint AS n, max({_RANK})::int AS worst FROM found GROUP BY 1 HAVING category IN ('Exfiltration', 'LateralMovement')")
def findings_by_category(spark, sf_dir):
    found = case.findings(flows(spark, sf_dir), categories=["Exfiltration", "LateralMovement"])
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.max("severity_rank").alias("worst"))


_HELLO_ROWS = "(SELECT 'www' || n_nationkey || '.example' AS sni, md5('771,' || n_nationkey) AS ja3, n_nationkey % 2 = 0 AS client, (SELECT count(*) FROM events WHERE event_id % 25 = n_nationkey)::bigint AS n FROM nation)"


@query(f"""WITH {FLOWS}, {NAMES}, i AS (SELECT 'IpAddress' AS kind, ip AS value, 0.5::double AS confidence, []::varchar[] AS attack, count(*)::bigint AS n FROM (SELECT DISTINCT flow_id, unnest([src_ip, dst_ip]) AS ip FROM flows) WHERE {OUTSIDE.format('ip')} GROUP BY 2
UNION ALL SELECT 'Domain', name, 0.3, []::varchar[], count(*)::bigint FROM names GROUP BY 2
UNION ALL SELECT 'Url', 'http://h' || (page_id % 5) || '.example/p/' || page_id, 0.3, []::varchar[], 1 FROM pages
UNION ALL SELECT 'UserAgent', CASE WHEN page_id % 3 = 0 THEN 'curl/8.0' ELSE 'Mozilla/5.0 (X11)' END AS a, CASE WHEN a = 'curl/8.0' THEN 0.7 ELSE 0.2 END, CASE WHEN a = 'curl/8.0' THEN ['T1595'] ELSE []::varchar[] END, count(*)::bigint FROM pages GROUP BY 2
UNION ALL SELECT 'FileHash', sha256(html), 0.4, []::varchar[], 1 FROM (SELECT DISTINCT html FROM pages WHERE html <> '')
UNION ALL SELECT CASE WHEN client THEN 'Ja3Fingerprint' ELSE 'Ja3sFingerprint' END, ja3, 0.4, []::varchar[], n FROM {_HELLO_ROWS}) SELECT * FROM i""")
def ioc_union(spark, sf_dir):
    web = _web(spark, sf_dir)
    hellos = _nations(spark, sf_dir).select(F.when(_key() % 2 == 0, "client").otherwise("server").alias("hello"), F.md5(F.concat(F.lit("771,"), _key().cast("string"))).alias("ja3"))
    return case.indicators(flows(spark, sf_dir), names(spark, sf_dir), dissect.http_transactions(web), carve.artifacts(dissect.http_bodies(web)), hellos)


@query(f"""WITH {FLOWS}, {NAMES}, h AS (SELECT ip, sum(s)::bigint AS sent, sum(g)::bigint AS received, count(*)::bigint AS n_flows FROM (SELECT src_ip AS ip, fwd_bytes AS s, rev_bytes AS g FROM flows UNION ALL SELECT dst_ip, rev_bytes, fwd_bytes FROM flows) GROUP BY 1), n AS (SELECT data AS ip, list_sort(list(DISTINCT name)) AS names FROM names WHERE data IS NOT NULL GROUP BY 1)
SELECT ip, sent, received, n_flows, NOT {OUTSIDE.format('ip')} AS internal, coalesce(names, []) AS names FROM h LEFT JOIN n USING (ip)""")
def host_names(spark, sf_dir):
    dns = names(spark, sf_dir)
    f = flows(spark, sf_dir).withColumn("dst_ip", F.col("dst_ip"))
    return case.hosts(f, dns).select("ip", "sent", "received", "n_flows", "internal", "names")


@query(f"""WITH {FLOWS}, {FOUND} SELECT ts_us, 'flow_start' AS kind, concat_ws(' ', coalesce(app, protocol), src_ip || ':' || src_port, '->', dst_ip || ':' || dst_port, '(' || (fwd_bytes + rev_bytes) || ' bytes)') AS summary, 'Info' AS severity, flow_id::varchar AS ref FROM flows
UNION ALL SELECT coalesce(first_us, 7), 'finding_' || lower(severity), list_reduce(list_transform(string_split(rule, '_'), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || ' ' || b) || ': ' || subject, severity, 'F-' || substr({_KEY}, 1, 32) FROM found
UNION ALL SELECT 7, 'http_transaction', CASE WHEN page_id % 4 = 0 THEN 'POST' ELSE 'GET' END || ' h' || (page_id % 5) || '.example /p/' || page_id || ' -> 200', 'Info', page_id || '#0' FROM pages
UNION ALL SELECT 7, 'credential_harvested', 'FtpLogin user=' || n_name || ' svc=ftp', 'High', 'CR-' || substr(sha256('FtpLogin|' || n_name || '|pw' || n_nationkey || '|ftp|'), 1, 32) FROM nation""")
def timeline_case(spark, sf_dir):
    f = flows(spark, sf_dir)
    secrets = carve.harvest(ftp=dissect.ftp_sessions(_talk(spark, sf_dir, _wire("USER ", _name(), "\r\nPASS pw", _key(), "\r\n"), F.lit(b""))))
    return case.timeline(f, case.findings(f), dissect.http_transactions(_web(spark, sf_dir)), secrets, 7)


_ADDRESSES = f"(SELECT count(*) FILTER (NOT {OUTSIDE.format('ip')}) AS i, count(*) FILTER ({OUTSIDE.format('ip')}) AS e FROM (SELECT DISTINCT unnest([src_ip, dst_ip]) AS ip FROM flows))"


@query(f"WITH {FLOWS} SELECT count(*)::bigint AS flows, count(*) FILTER (protocol = 'tcp')::bigint AS tcp, count(*) FILTER (protocol = 'udp')::bigint AS udp, NULL::bigint AS packets, sum(fwd_bytes + rev_bytes)::bigint AS bytes, (max(ts_us) - min(ts_us)) / 1000000 AS seconds, any_value(i)::bigint AS internal, any_value(e)::bigint AS external FROM flows, {_ADDRESSES}")
def statistics_case(spark, sf_dir):
    return case.statistics(flows(spark, sf_dir))


@query(f"""WITH {FLOWS}, {FOUND}, c AS (SELECT *, CASE rule {_cases(0)} END AS category, CASE rule {_cases(1)} END AS attack FROM found), n AS (SELECT count(*) AS n, count(*) FILTER (severity = 'Critical') AS c, count(*) FILTER (severity = 'High') AS h, count(*) FILTER (severity = 'Medium') AS m, count(*) FILTER (category = 'Exfiltration') AS x, count(*) FILTER (category = 'C2Communication') AS z, string_agg(DISTINCT subject, ', ' ORDER BY subject) FILTER (category = 'ClearTextProtocol') AS t FROM c)
SELECT concat_ws(' ', 'test: ' || (SELECT count(*) FROM flows) || ' conversations, ' || (SELECT count(*) FROM flows) || ' over TCP and 0 over UDP; first to last start ' || (SELECT printf('%.1f', (max(ts_us) - min(ts_us)) / 1000000) FROM flows) || ' s.', (SELECT 'Hosts seen: ' || i || ' inside, ' || e || ' outside.' FROM {_ADDRESSES}),
(SELECT 'Mostly ' || string_agg(app || ' (' || n || ')', ', ' ORDER BY n DESC, app) || '.' FROM (SELECT coalesce(app, 'Unknown') AS app, count(*) AS n FROM flows GROUP BY 1 ORDER BY n DESC, app LIMIT 4)),
CASE WHEN c + h + m > 0 THEN 'Rules hit ' || n || ' times, of these ' || concat_ws(', ', CASE WHEN c > 0 THEN c || ' critical' END, CASE WHEN h > 0 THEN h || ' high' END, CASE WHEN m > 0 THEN m || ' medium' END) || '.' END,
CASE WHEN x > 0 THEN 'Data may have left the network: ' || x || ' hits.' END, CASE WHEN z > 0 THEN 'Hosts may be under remote control: ' || z || ' hits.' END, (SELECT 'Credentials in the open: ' || count(*) || ' (FtpLogin).' FROM nation),
CASE WHEN t <> '' THEN 'Anyone on the path could read: ' || t || '.' END, (SELECT 'Techniques: ' || string_agg(DISTINCT split_part(a, '.', 1), ', ' ORDER BY split_part(a, '.', 1)) || '.' FROM (SELECT unnest(attack) AS a FROM c))) AS summary FROM n""")
def summary_case(spark, sf_dir):
    f = flows(spark, sf_dir)
    secrets = carve.harvest(ftp=dissect.ftp_sessions(_talk(spark, sf_dir, _wire("USER ", _name(), "\r\nPASS pw", _key(), "\r\n"), F.lit(b""))))
    return case.summary(f, case.findings(f), secrets, None, "test")


def _index(spark: SparkSession, sf_dir: str) -> index.SearchIndex:
    return index.SearchIndex.of({"documents": (_table(spark, sf_dir, "documents"), "doc_id", ("lang", "text")), "pages": (_table(spark, sf_dir, "pages"), "page_id", ("url", "html"))})


_TOKENS = "regexp_extract_all(lower(strip_accents(coalesce({0}, ''))), '[\\p{{L}}\\p{{N}}]+')"
#: Documents of both tables as lists of terms by column.
_WORDS = "w AS (SELECT 'documents' AS t, doc_id::varchar AS id, " + _TOKENS.format("lang") + " AS a, " + _TOKENS.format("text") + " AS b FROM documents UNION ALL SELECT 'pages', page_id::varchar, " + _TOKENS.format("url") + ", " + _TOKENS.format("html") + " FROM pages)"


def _ranked_sql(phrases: list[str], where: str, scope: str = "true") -> str:
    """BM25 of phrases, each an expression for its count over the columns a and b."""
    counts = ", ".join(f"{p} AS f{k}" for k, p in enumerate(phrases))
    n = ", ".join(f"count(*) FILTER (f{k} > 0) OVER (PARTITION BY t) AS n{k}" for k in range(len(phrases)))
    score = " + ".join(f"greatest(ln((n - n{k} + 0.5) / (n{k} + 0.5)), 1e-6) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * len / avg))" for k in range(len(phrases)))
    return f"WITH {_WORDS}, c AS (SELECT t, id, len(a) + len(b) AS len, {counts} FROM w WHERE {scope}), s AS (SELECT *, count(*) OVER (PARTITION BY t) AS n, avg(len) OVER (PARTITION BY t) AS avg, {n} FROM c) SELECT t AS \"table\", id, round({score}, 6) AS score FROM s WHERE {where}"


def _count(term: str, *columns: str) -> str:
    return "(" + " + ".join(f"len(list_filter({c}, lambda x: x = '{term}'))" for c in columns) + ")"


def _pairs(one: str, two: str, *columns: str) -> str:
    return "(" + " + ".join(f"len(list_filter(range(1, len({c})), lambda i: {c}[i] = '{one}' AND {c}[i + 1] = '{two}'))" for c in columns) + ")"


@query(_ranked_sql([_count("the", "a", "b"), _count("example", "a", "b")], "f0 > 0 AND f1 > 0"))
def index_search(spark, sf_dir):
    return _index(spark, sf_dir).query("the example", None).select("table", "id", F.round("score", 6).alias("score"))


@query(_ranked_sql([_pairs("of", "the", "a", "b")], f"f0 > 0 AND {0} = 0".format("0")).replace("WHERE f0 > 0 AND 0 = 0", "WHERE f0 > 0"))
def index_phrase(spark, sf_dir):
    return _index(spark, sf_dir).query('"of the"', None).select("table", "id", F.round("score", 6).alias("score"))


@query(_ranked_sql([_count("en", "a")], "f0 > 0", "t = 'documents'"))
def index_column(spark, sf_dir):
    return _index(spark, sf_dir).query("documents: lang:en", None).select("table", "id", F.round("score", 6).alias("score"))


_THE, _EXAMPLE, _OF, _CAFE = (_count(t, "a", "b") for t in ("the", "example", "of", "fur"))


def _asked(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return _index(spark, sf_dir).query(text, None).select("table", "id", F.round("score", 6).alias("score"))


@query(_ranked_sql([_THE, _EXAMPLE, _OF], "f0 > 0 OR (f1 > 0 AND f2 > 0)"))
def index_or(spark, sf_dir):
    return _asked(spark, sf_dir, "the OR example of")


@query(_ranked_sql([_THE, _EXAMPLE, _OF], "(f0 > 0 AND f1 > 0) OR f2 > 0"))
def index_and_or(spark, sf_dir):
    return _asked(spark, sf_dir, "the example OR of")


@query(_ranked_sql([_THE, _EXAMPLE, _OF], "(f0 > 0 OR f1 > 0) AND f2 > 0"))
def index_parentheses(spark, sf_dir):
    return _asked(spark, sf_dir, "(the OR example) of")


@query(f"WITH {_WORDS}, x AS (SELECT t, id FROM w WHERE {_THE} > 0 AND {_EXAMPLE} > 0) SELECT s.* FROM (" + _ranked_sql([_OF], "f0 > 0") + ") s LEFT JOIN x ON x.t = s.\"table\" AND x.id = s.id WHERE x.id IS NULL")
def index_not(spark, sf_dir):
    return _asked(spark, sf_dir, "of NOT (the example)")


@query(_ranked_sql([_CAFE], "f0 > 0"))
def index_folded(spark, sf_dir):
    """Marks on letters don't matter, in the text or in the query."""
    return _asked(spark, sf_dir, "F\u00dcR")


@query(_ranked_sql([_OF], "f0 > 0"))
def index_stored(spark, sf_dir):
    """A stored index, opened again."""
    folder = new_path(spark, "index")
    index.SearchIndex.create(spark, folder, {"documents": (_table(spark, sf_dir, "documents"), "doc_id", ("lang", "text")), "pages": (_table(spark, sf_dir, "pages"), "page_id", ("url", "html"))}, "test")
    return index.SearchIndex.open(spark, folder).query("of", None).select("table", "id", F.round("score", 6).alias("score"))


@query("SELECT \"table\", id, score FROM (SELECT *, row_number() OVER (PARTITION BY \"table\" ORDER BY score DESC, id) AS r FROM (" + _ranked_sql([_THE], "f0 > 0").replace("round(", "(").replace(", 6) AS score", ") AS score") + ")) WHERE r <= 5 ORDER BY score DESC, \"table\", id LIMIT 30")
def index_best(spark, sf_dir):
    """The best thirty, of each table its share."""
    return _index(spark, sf_dir).query("the", 30).select("table", "id", "score")


@query("""WITH n AS (SELECT DISTINCT user_id, 'h' || (event_id % 3) || '.' || event_type || (user_id % 20) || '.example' AS name FROM events) SELECT DISTINCT user_id::varchar AS id FROM n WHERE name LIKE 'h1.view%'""")
def index_rows(spark, sf_dir):
    """A phrase within one name of a host that asked for many: rows that share a key don't run into each other."""
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type").distinct()
    name = F.concat(F.lit("h"), (F.col("event_id") % 3).cast("string"), F.lit("."), F.col("event_type"), (F.col("user_id") % 20).cast("string"), F.lit(".example"))
    rows = e.select("user_id", name.alias("name")).distinct()
    return index.SearchIndex.of({"dns": (rows, "user_id", ("name",))}).query("dns: h1.view*", None).select("id")


@query("SELECT doc_id::varchar AS id, 'lang=' || lang || CASE WHEN length(text) > 120 THEN ' | text=' || substr(text, 1, 120) || '...' WHEN text <> '' THEN ' | text=' || text ELSE '' END AS snippet FROM documents")
def index_snippets(spark, sf_dir):
    return index.documents(_table(spark, sf_dir, "documents"), "documents", "doc_id", ("lang", "text")).select("id", "snippet")


@query(_grown("SELECT '<tr><td>' || n_nationkey || '</td><td>' || replace(replace(n_name, '&', '&amp;'), '<', '&lt;') || '</td><td>&lt;a &amp; &quot;b&quot;&gt;</td></tr>' AS html FROM nation"))
def html_rows(spark, sf_dir):
    return export.html_rows(_nations(spark, sf_dir).select("n_nationkey", "n_name", F.lit('<a & "b">').alias("x")))


@query(_grown("SELECT 'json' AS format, '{\"n_nationkey\":' || n_nationkey || ',\"x\":\"a,\\\"b\\\"\"}' AS line FROM nation UNION ALL SELECT 'csv', n_nationkey || ',\"a,\"\"b\"\"\"' FROM nation UNION ALL SELECT 'table', rpad(n_nationkey::varchar, 40, ' ') || '  ' || rpad('a,\"b\"', 40, ' ') FROM nation"))
def output_formats(spark, sf_dir):
    rows = _nations(spark, sf_dir).select("n_nationkey", F.lit('a,"b"').alias("x"))
    one = lambda k: export.FORMATS[k](rows).select(F.lit(k).alias("format"), "line")
    return one("json").unionByName(one("csv")).unionByName(one("table"))


@query(_grown("""SELECT n_nationkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) ELSE printf('%.1f MB', b / 1048576) END AS size, CASE WHEN length(n_name) <= 8 THEN '****' ELSE substr(n_name, 1, 4) || '...' || right(n_name, 4) END AS masked,
CASE n_nationkey % 7 WHEN 0 THEN 'NOERROR' WHEN 1 THEN 'FORMERR' WHEN 2 THEN 'SERVFAIL' WHEN 3 THEN 'NXDOMAIN' WHEN 4 THEN 'NOTIMP' WHEN 5 THEN 'REFUSED' ELSE 'UNKNOWN' END AS rcode, n_nationkey % 2 = 0 AS before, CASE n_nationkey % 3 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' ELSE 'Medium' END AS severity,
CASE WHEN b % 9 > 7.5 THEN 'Encrypted' WHEN b % 9 > 6.5 THEN 'Compressed' WHEN b % 9 > 4.5 THEN 'Mixed' WHEN b % 9 > 2 THEN 'Structured' ELSE 'Repetitive' END AS class FROM (SELECT *, (n_nationkey * n_nationkey * n_nationkey * 400)::bigint AS b FROM nation)"""))
def scalar_names(spark, sf_dir):
    size = (_key() * _key() * _key() * 400).cast("long")
    seq = net.seq_before(F.when(_key() % 2 == 0, F.lit(4294967290)).otherwise(F.lit(5)), F.when(_key() % 2 == 0, F.lit(5)).otherwise(F.lit(4294967290)))
    kind = F.element_at(F.array(F.lit("SshPrivateKey"), F.lit("Jwt"), F.lit("SessionCookie")), _key() % 3 + 1)
    return _nations(spark, sf_dir).select("n_nationkey", net.readable_bytes(size).alias("size"), net.masked(_name()).alias("masked"), net.named(_key() % 7, net.RCODES).alias("rcode"), seq.alias("before"), detect.credential_severity(kind).alias("severity"), codec.entropy_class(size % 9).alias("class"))


@query("SELECT doc_id, md5(text) AS hexed, md5(text) AS chained, md5(text) AS percent, md5(text) AS masked FROM documents WHERE octet_length(encode(text)) >= 4")
def decode_chains(spark, sf_dir):
    """Texts through hexadecimal, base64 of that, percent signs and XOR, and back."""
    data = F.encode("text", "UTF-8")
    d = _table(spark, sf_dir, "documents").where(F.octet_length(data) >= 4)
    hexed, masked = F.hex(data).cast("binary"), F.transform(F.array(data), lambda x: x)[0]
    b64 = F.regexp_replace(F.base64(hexed), r"\s", "").cast("binary")
    percent = F.regexp_replace(F.hex(data), "(..)", "%$1").cast("binary")
    once = codec.decoded(masked, "xor:0x2a")
    return d.select("doc_id", F.md5(codec.decoded(hexed, "hex")).alias("hexed"), F.md5(codec.decoded(b64, "base64 | hex")).alias("chained"), F.md5(codec.decoded(percent, "url")).alias("percent"), F.md5(codec.decoded(once, "xor:42")).alias("masked"))


@query("SELECT page_id::varchar AS flow_id, 'GET' AS method, url AS uri, 200 AS status, 'text/html' AS content_type, octet_length(encode(html))::bigint AS response_size, CASE WHEN html <> '' THEN sha256(html) END AS body_sha256 FROM pages")
def http_parse(spark, sf_dir):
    req = F.encode(F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\nHost: x\r\n\r\n")), "UTF-8")
    res = F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), F.col("html")), "UTF-8")
    return dissect.http_transactions(_table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("flow_id"), req.alias("client"), res.alias("server"))).select("flow_id", "method", "uri", "status", "content_type", "response_size", "body_sha256")


@query(_grown("""WITH n AS (SELECT n_nationkey::varchar AS flow_id, n_nationkey::int AS id, lower(replace(n_name, ' ', '')) || '.example' AS name, n_nationkey FROM nation)
SELECT flow_id, id, true AS is_response, 0 AS rcode, name, 'A' AS type, NULL::bigint AS ttl, NULL::varchar AS data FROM n UNION ALL SELECT flow_id, id, true, 0, name, 'A', 300 + n_nationkey, '192.0.2.' || n_nationkey FROM n UNION ALL SELECT flow_id, id, true, 0, name, 'TXT', 60, 'v=' || n_nationkey FROM n UNION ALL SELECT flow_id, id, true, 0, name, 'MX', 60, name FROM n"""))
def dns_parse(spark, sf_dir):
    """A response per nation: an address, a text and a mail host, by compressed names; every second one over TCP."""
    label = F.lower(F.replace(_name(), F.lit(" "), F.lit("")))
    text = F.concat(F.lit("v="), _key().cast("string"))
    name = (_number(F.octet_length(label), 1), _digits(label), "07", _digits(F.lit("example")), "00")
    txt = (_number(F.octet_length(text) + 1, 2), _number(F.octet_length(text), 1), _digits(text))
    body = F.concat(*[F.lit(x.replace(" ", "")) if isinstance(x, str) else x for x in (_number(_key(), 2), "8180 0001 0003 0000 0000", *name, "0001 0001", "C00C 0001 0001", _number(300 + _key(), 4), "0004 C00002", _number(_key(), 1), "C00C 0010 0001 0000003C", *txt, "C00C 000F 0001 0000003C 0004 000A C00C")])
    tcp = _key() % 2 == 0
    data = F.unhex(F.when(tcp, F.concat(_number((F.char_length(body) / 2).cast("int"), 2), body)).otherwise(body))
    return dissect.dns_records(_nations(spark, sf_dir).select("flow_id", data.alias("data"), tcp.alias("tcp"))).drop("at")


_SURE = f"(SELECT 'IpAddress' AS kind, ip AS value, 0.5::double AS confidence FROM (SELECT DISTINCT unnest([src_ip, dst_ip]) AS ip FROM flows) WHERE {OUTSIDE.format('ip')} UNION ALL SELECT DISTINCT 'Domain', name, 0.3 FROM names)"


@query(f"WITH {FLOWS}, {NAMES} SELECT row_number() OVER (ORDER BY confidence DESC, kind, value)::int AS n, kind, value, confidence FROM {_SURE} QUALIFY n <= 20")
def iocs_to_enrich(spark, sf_dir):
    asked = case.to_enrich(case.indicators(flows(spark, sf_dir), names(spark, sf_dir)))
    return asked.select(F.row_number().over(Window.orderBy(F.col("confidence").desc(), "kind", "value")).alias("n"), "kind", "value", "confidence")


@query(f"WITH {FLOWS} SELECT ip, sum(s + g)::bigint AS total FROM (SELECT src_ip AS ip, fwd_bytes AS s, rev_bytes AS g FROM flows UNION ALL SELECT dst_ip, rev_bytes, fwd_bytes FROM flows) GROUP BY 1 ORDER BY total DESC, ip LIMIT 10")
def hosts_by_traffic(spark, sf_dir):
    return case.by_traffic(case.hosts(flows(spark, sf_dir))).limit(10).select("ip", (F.col("sent") + F.col("received")).alias("total"))


@query(f"WITH {FLOWS}, {FOUND} SELECT ts_us, kind, ref FROM (SELECT ts_us, 'flow_start' AS kind, flow_id::varchar AS ref, 0 AS s FROM flows UNION ALL SELECT coalesce(first_us, 0), 'finding_' || lower(severity), 'F-' || substr({_KEY}, 1, 32), 1 FROM found) ORDER BY ts_us, s, kind, ref LIMIT 50")
def timeline_in_order(spark, sf_dir):
    f = flows(spark, sf_dir)
    return case.in_order(case.timeline(f, case.findings(f), at_us=0)).limit(50).select("ts_us", "kind", "ref")


@query(f"WITH {FLOWS}, {FOUND} (SELECT 'first' AS asked, rule, subject FROM found ORDER BY {_RANK} DESC, confidence DESC, rule, subject LIMIT 1) UNION ALL SELECT 'F-0', rule, subject FROM found WHERE substr({_KEY}, 1, 1) = '0'")
def finding_lookup(spark, sf_dir):
    found = case.findings(flows(spark, sf_dir))
    asked = lambda x: case.by_id(found, x).select(F.lit(x).alias("asked"), "rule", "subject")
    return asked("first").unionByName(asked("F-0"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g+00:00') AS at, floor((epoch_us(ts) - 1704067200000000) / 1000) / 1000 AS seconds FROM events")
def event_times(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return _table(spark, sf_dir, "events").select("event_id", case.rfc3339(at).alias("at"), case.seconds_between(F.lit(1704067200000000), at).alias("seconds"))


@query(_grown("SELECT n_nationkey, 'hex' AS chain, n_name || '/' || n_nationkey AS decoded FROM nation WHERE length(n_name || '/' || n_nationkey) > 3 UNION ALL SELECT n_nationkey, 'hex|rot13', translate(n_name || '/' || n_nationkey, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'NOPQRSTUVWXYZABCDEFGHIJKLM') FROM nation"))
def decoded_strings(spark, sf_dir):
    """Names in hexadecimal (with a mark that no other decoder takes), as far as two steps tell; the hexadecimal text turned by 13 is left out."""
    rows = _nations(spark, sf_dir).select("n_nationkey", _digits(F.concat(_name(), F.lit("/"), _key().cast("string"))).alias("text"))
    return codec.decoded_strings(rows, "n_nationkey", depth=2).where("chain in ('hex', 'hex|rot13')")


@query("SELECT doc_id, md5(text) AS digest, round(e, 6) AS entropy FROM documents JOIN (WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents), c AS (SELECT doc_id, x, count(*) AS n FROM b GROUP BY 1, 2) SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM c GROUP BY 1) USING (doc_id) WHERE octet_length(encode(text)) >= 4")
def sql_functions(spark, sf_dir):
    """Registered functions in SQL text."""
    codec.register(spark)
    rows = _table(spark, sf_dir, "documents").where(F.octet_length(F.encode("text", "UTF-8")) >= 4)
    return rows.select("doc_id", F.expr("md5(apply_chain(cast(hex(encode(text, 'UTF-8')) as binary), 'hex'))").alias("digest"), F.round(F.expr("entropy(text)"), 6).alias("entropy"))


@query(f"""WITH {FLOWS}, {NAMES}, {FOUND}, f AS (SELECT string_agg(severity || ' ' || list_reduce(list_transform(string_split(rule, '_'), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || ' ' || b) || ': ' || subject, chr(10) ORDER BY {_RANK} DESC, confidence DESC, rule, subject) AS t FROM (SELECT * FROM found ORDER BY {_RANK} DESC, confidence DESC, rule, subject LIMIT 3)),
i AS (SELECT string_agg(kind || ' ' || value, chr(10) ORDER BY confidence DESC, kind, value) AS u FROM (SELECT * FROM {_SURE} ORDER BY confidence DESC, kind, value LIMIT 3)) SELECT 'Findings:' || chr(10) || t || chr(10) || 'Indicators:' || chr(10) || u AS brief FROM f, i""")
def case_brief(spark, sf_dir):
    f = flows(spark, sf_dir)
    return case.brief(case.findings(f), case.indicators(f, names(spark, sf_dir)), 3)


@query("SELECT table_name AS \"table\", name FROM (VALUES ('nation', 'n_nationkey'), ('nation', 'n_name'), ('nation', 'flow_id'), ('region', 'r_regionkey'), ('region', 'r_name')) t(table_name, name)")
def schema_table(spark, sf_dir):
    return export.schema_table(spark, {"nation": _nations(spark, sf_dir), "region": _table(spark, sf_dir, "region")}).select("table", "name")
