"""Registered queries over packets in several files: roles, rules on roles, evidence in packets and times of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwake.functions.text import flags
from sparkwake.operators import case, detect, dissect, enrich, flows as flow_ops, reassembly, rules
from sparkwake.plans.records import FOUND, _RANK
from sparkwake.streaming import alerts
from sparkwake.tables import materialize, new_path

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


def _address(n: Column, net: str) -> Column:
    return F.concat(F.lit(net), F.floor(n / 256).cast("string"), F.lit("."), (n % 256).cast("string"))


def two_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as packets between hosts inside and servers outside with lower addresses, in two files whose names sort
    against their times and whose offsets overlap."""
    e = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    i, late = F.col("event_id"), F.col("event_id") % 4 >= 2
    back = i % 3 == 2
    host, server = _address(F.col("user_id"), "192.168."), F.concat(F.lit("8.8.8."), (F.col("user_id") % 3).cast("string"))
    icmp = F.col("event_type") == "signup"
    there = F.when(icmp, 0).when(F.col("event_type") == "click", 80).when(F.col("event_type") == "view", 443).when(F.col("event_type") == "purchase", 4444).otherwise(990)
    here = F.when(icmp, 0).otherwise(40000 + F.col("user_id") % 7)
    syn, answer = ~back & (i % 5 == 0), back & (i % 5 == 1)
    payload = F.when(~icmp & (syn | answer), F.lit(b"")).otherwise(F.encode(F.coalesce("props", F.lit("")), "UTF-8"))
    pick = lambda a, b: F.when(back, b).otherwise(a)
    return e.select(
        F.when(late, "a.pcap").otherwise("z.pcap").alias("path"), F.when(late, 2000).otherwise(1000).cast("long").alias("file_us"), (F.floor(i / 4) * 2 + i % 2).alias("offset"), F.col("ts").cast("timestamp").alias("ts"),
        pick(host, server).alias("src_ip"), pick(server, host).alias("dst_ip"), pick(here, there).cast("int").alias("src_port"), pick(there, here).cast("int").alias("dst_port"), F.when(icmp, "icmp").otherwise("tcp").alias("protocol"),
        F.when(~icmp, F.when(syn, 2).when(answer, 18).otherwise(24)).cast("int").alias("flags"), (i * 10).alias("seq"), payload.alias("payload"), (54 + F.octet_length(payload)).cast("long").alias("caplen"),
    )


#: The same as flows in SQL: place n, whether the host inside sends, and what makes it the client.
TWO_FILES = """p AS (SELECT CASE WHEN event_id % 4 >= 2 THEN 1000000000000 ELSE 0 END + event_id AS n, ts, event_id % 3 <> 2 AS out, event_type = 'signup' AS icmp, '192.168.' || (user_id // 256) || '.' || (user_id % 256) AS h, '8.8.8.' || (user_id % 3) AS s,
(CASE event_type WHEN 'signup' THEN 0 ELSE 40000 + user_id % 7 END)::int AS hp, (CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN 80 WHEN 'view' THEN 443 WHEN 'purchase' THEN 4444 ELSE 990 END)::int AS sp, event_type <> 'signup' AND event_id % 3 <> 2 AND event_id % 5 = 0 AS syn, event_type <> 'signup' AND event_id % 3 = 2 AND event_id % 5 = 1 AS answer, coalesce(props, '') AS props FROM events),
q AS (SELECT *, CASE WHEN syn OR answer THEN 0 ELSE octet_length(encode(props)) END AS size FROM p),
g AS (SELECT h, s, hp, sp, icmp, min(n) FILTER (syn) AS syn_n, min(n) FILTER (size > 0) AS data_n, arg_min(out, n) FILTER (size > 0) AS data_out, count(*) FILTER (answer) AS answers, arg_min(out, n) AS any_out, epoch_us(arg_min(ts, n))::bigint AS start_us, epoch_us(arg_max(ts, n))::bigint AS last_us,
count(*) FILTER (out)::bigint AS op, count(*) FILTER (NOT out)::bigint AS ip, coalesce(sum(54 + size) FILTER (out), 0)::bigint AS ob, coalesce(sum(54 + size) FILTER (NOT out), 0)::bigint AS ib FROM q GROUP BY ALL),
o AS (SELECT *, CASE WHEN syn_n IS NOT NULL AND (data_n IS NULL OR syn_n < data_n) THEN true WHEN data_n IS NOT NULL THEN data_out WHEN answers > 0 THEN true ELSE any_out END AS mine, 'FL-' || substr(sha256(concat_ws('|', CASE WHEN icmp THEN 'icmp' ELSE 'tcp' END, s, sp::varchar, h, hp::varchar)), 1, 32) AS flow_id FROM g),
flows AS (SELECT flow_id, CASE WHEN mine THEN h ELSE s END AS src_ip, CASE WHEN mine THEN s ELSE h END AS dst_ip, CASE WHEN mine THEN hp ELSE sp END AS src_port, CASE WHEN mine THEN sp ELSE hp END AS dst_port, CASE WHEN icmp THEN 'icmp' ELSE 'tcp' END AS protocol, start_us AS ts_us, CASE WHEN mine THEN ob ELSE ib END AS fwd_bytes, CASE WHEN mine THEN ib ELSE ob END AS rev_bytes,
CASE WHEN mine THEN op ELSE ip END AS fwd_packets, CASE WHEN mine THEN ip ELSE op END AS rev_packets, last_us, abs(last_us - start_us) AS duration_us, CASE WHEN icmp THEN 'Icmp' WHEN sp = 80 THEN 'Http' WHEN sp = 443 THEN 'Tls' END AS app FROM o)"""


@query(f"WITH {TWO_FILES} SELECT flow_id, src_ip AS client_ip, src_port AS client_port, dst_ip AS server_ip, dst_port AS server_port, fwd_packets AS c2s_packets, rev_packets AS s2c_packets, fwd_bytes AS c2s_bytes, rev_bytes AS s2c_bytes, ts_us AS start_us, last_us FROM flows")
def flows_oriented(spark, sf_dir):
    f = flow_ops.oriented(flow_ops.flows(two_files(spark, sf_dir)))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return f.select("flow_id", "client_ip", "client_port", "server_ip", "server_port", "c2s_packets", "s2c_packets", "c2s_bytes", "s2c_bytes", micros("start").alias("start_us"), micros("last").alias("last_us"))


@query(f"WITH {TWO_FILES}, {FOUND} SELECT rule, subject, severity, confidence, {_RANK} AS severity_rank FROM found")
def findings_on_roles(spark, sf_dir):
    return detect.all_findings(case.from_packets(two_files(spark, sf_dir)))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, a flag behind each, sent by a host of its own in segments of 500 bytes, each with 30 of the next one."""
    whole = F.encode(F.concat(F.coalesce("text", F.lit("")), F.lit(" flag{doc_"), F.col("doc_id").cast("string"), F.lit("}")), "UTF-8")
    d = _table(spark, sf_dir, "documents").select("doc_id", whole.alias("b"))
    k, n = F.col("k"), F.col("doc_id")
    sent = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("b") - 1) / 500)), lambda k: F.struct(k.alias("k"), F.substring("b", (k * 500 + 1).cast("int"), F.lit(530)).alias("payload")))
    parts = d.select("doc_id", F.explode(sent).alias("x")).select("doc_id", "x.*")
    host = F.concat(F.lit("10."), F.floor(n / 65536).cast("string"), F.lit("."), (F.floor(n / 256) % 256).cast("string"), F.lit("."), (n % 256).cast("string"))
    return parts.select(
        F.lit("c.pcap").alias("path"), F.lit(0).cast("long").alias("file_us"), (n * 100_000 + k).alias("offset"), F.timestamp_millis(1_700_000_000_000 + n * 1000 + k).alias("ts"), host.alias("src_ip"), F.lit("203.0.113.1").alias("dst_ip"), F.lit(40000).alias("src_port"), F.lit(80).alias("dst_port"),
        F.lit("tcp").alias("protocol"), F.lit(24).alias("flags"), ((F.lit(4294967000) + k * 500) % (1 << 32)).alias("seq"), "payload", F.lit(584).cast("long").alias("caplen"),
    )


@query("""WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS a, octet_length(encode(coalesce(text, ''))) + 1 + length('flag{doc_' || doc_id || '}') AS b FROM documents),
s AS (SELECT *, CASE WHEN a >= 500 THEN CASE WHEN a % 500 < 30 THEN a // 500 - 1 ELSE a // 500 END ELSE 0 END AS low, CASE WHEN b - 1 >= 500 THEN CASE WHEN (b - 1) % 500 < 30 THEN (b - 1) // 500 - 1 ELSE (b - 1) // 500 END ELSE 0 END AS high FROM d)
SELECT 'flag{doc_' || doc_id || '}' AS flag, a::bigint AS start, b::bigint AS stop, 'c.pcap' AS path, (doc_id * 100000 + low)::bigint AS first_offset, (doc_id * 100000 + high)::bigint AS last_offset, (high - low + 1)::bigint AS packets, ((1700000000000 + doc_id * 1000 + low) * 1000)::bigint AS ts_us FROM s""")
def evidence_packets(spark, sf_dir):
    """The packets that each planted flag came in: the bytes that a packet repeats from the one before are that one's."""
    packets = flagged(spark, sf_dir)
    where = materialize(reassembly.intervals(packets), "intervals")
    flows = materialize(case.from_packets(packets), "flows")
    talk = materialize(dissect.conversations(reassembly.streams(packets, where=where), flows), "talk")
    told = dissect.stream_text(talk).select("flow_id", F.explode(flags(F.col("text"))).alias("value")).where("value like 'flag{doc\\\\_%'")
    found = case.evidence(told.select(F.col("value").alias("finding"), "flow_id", "value", F.lit(None).cast("long").alias("at")), talk, flows, where)
    return found.select(F.col("finding").alias("flag"), "start", "stop", "path", "first_offset", "last_offset", "packets", F.unix_micros("ts").alias("ts_us"))


def web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as two requests on one connection each, the page in segments of 1000 bytes as the second answer."""
    p, n = _table(spark, sf_dir, "pages").select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("b")), F.col("page_id")
    ask = lambda path: F.concat(F.lit(f"GET /{path}/"), n.cast("string"), F.lit(" HTTP/1.1\r\nHost: h.example\r\n\r\n"))
    size = F.octet_length("b").cast("string")
    server = F.concat(F.encode(F.concat(F.lit("HTTP/1.1 204 No\r\nContent-Length: 0\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: "), size, F.lit("\r\n\r\n")), "UTF-8"), F.col("b"))
    one = lambda mine, at, seq, data: F.struct(F.lit(mine).alias("mine"), at.cast("long").alias("at"), seq.cast("long").alias("seq"), data.alias("data"))
    asks = F.array(one(True, F.lit(0), F.lit(5), F.encode(ask("a"), "UTF-8")), one(True, F.lit(2), 5 + F.octet_length(ask("a")), F.encode(ask("b"), "UTF-8")))
    rows = p.withColumn("server", server)
    told = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("server") - 1) / 1000)), lambda k: one(False, k * 2 + 1, k * 1000, F.substring("server", (k * 1000 + 1).cast("int"), F.lit(1000))))
    each = rows.select("page_id", F.explode(F.concat(asks, told)).alias("x")).select("page_id", "x.*")
    host = F.concat(F.lit("192.168."), F.floor(n / 256).cast("string"), F.lit("."), (n % 256).cast("string"))
    pick = lambda a, b: F.when(F.col("mine"), a).otherwise(b)
    return each.select(
        F.lit("w.pcap").alias("path"), F.lit(0).cast("long").alias("file_us"), (n * 100_000 + F.col("at")).alias("offset"), F.timestamp_millis(1_700_000_000_000 + n * 1000 + F.col("at")).alias("ts"), pick(host, F.lit("8.8.8.8")).alias("src_ip"), pick(F.lit("8.8.8.8"), host).alias("dst_ip"),
        pick(F.lit(40000), F.lit(80)).alias("src_port"), pick(F.lit(80), F.lit(40000)).alias("dst_port"), F.lit("tcp").alias("protocol"), F.lit(24).alias("flags"), "seq", F.col("data").alias("payload"), (54 + F.octet_length("data")).cast("long").alias("caplen"),
    )


@query("SELECT 1700000000000000 + page_id * 1000000 + i * 2000 AS ts_us, CASE i WHEN 0 THEN 'GET h.example /a/' || page_id || ' -> 204' ELSE 'GET h.example /b/' || page_id || ' -> 200' END AS summary, page_id * 100000 + i * 2 AS \"offset\", 'w.pcap' AS path FROM pages, (SELECT unnest([0, 1]) AS i)")
def http_times(spark, sf_dir):
    """Transactions with the time and packet of their request, on a timeline."""
    packets = web(spark, sf_dir)
    where, flows = reassembly.intervals(packets), case.from_packets(packets)
    talk = dissect.conversations(reassembly.streams(packets, found=reassembly.segments(packets, where)), flows)
    http = reassembly.timed(dissect.http_transactions(talk), F.coalesce("request_at", "response_at"), F.col("request_at").isNotNull(), flows, where)
    known = http.select(F.concat_ws("#", "flow_id", F.col("ordinal").cast("string")).alias("ref"), "path", "offset")
    return case.timeline(flows, http=http).where("kind = 'http_transaction'").join(known, "ref").select("ts_us", "summary", "offset", "path")


def protocol_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """events as HTTP transactions, TLS hellos and DNS records that meet every rule over them."""
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    some = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (i % n + 1).cast("int"))
    agent = some(6, "curl/8.0", "Mozilla/5.0 (X11)", "AutoIt x/1", "short", "Mozilla/4.0 (compatible; MSIE 6.0;)", "")
    http = e.select("ts_us", some(2, "GET", "POST").alias("method"), F.concat(some(4, "/x/", "/gate.php?", "/panel/", "/y/"), u).alias("uri"), F.when(i % 7 != 0, F.lit("h.example")).alias("host"), agent.alias("user_agent"), F.when(i % 11 == 1, 200_000).otherwise(10).cast("long").alias("request_size"), F.when(i % 13 == 0, 2_000_000).otherwise(10).cast("long").alias("response_size"))
    name = F.when(i % 5 == 0, F.concat(F.lit("ftp."), u)).when(i % 5 == 1, F.concat(F.lit("FTPS"), u)).when(i % 5 != 2, F.lit("www.example"))
    tls = e.select("ts_us", F.concat(F.lit("f"), i.cast("string")).alias("flow_id"), F.when(i % 3 == 2, "server").otherwise("client").alias("hello"), name.alias("sni"), some(4, *list(rules.BAD_JA3)[:2], "00", None).alias("ja3"), some(5, 769, 771, 772, 768, 771).cast("int").alias("version"))
    dns = e.select("ts_us", F.concat(F.when(i % 9 == 0, F.repeat(F.lit("a"), F.lit(60))).otherwise("b"), F.lit("."), (F.col("user_id") % 20).cast("string"), F.lit("r.example")).alias("name"), some(3, "A", "TXT", "AAAA").alias("type"), (F.when(i % 10 == 0, 3).otherwise(0)).alias("rcode"), F.when(i % 3 == 1, F.repeat(F.lit("t"), F.when(i % 2 == 0, 101).otherwise(100).cast("int"))).otherwise(F.concat(F.lit("192.0.2."), (i % (F.col("user_id") % 9 + 1)).cast("string"))).alias("data"))
    return http, tls, dns


def _list(*values: str | int | None) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


_HTTP = f"""http AS (SELECT epoch_us(ts)::bigint AS t, {_list('GET', 'POST')}[event_id % 2 + 1] AS method, {_list('/x/', '/gate.php?', '/panel/', '/y/')}[event_id % 4 + 1] || user_id AS uri, event_id % 7 = 0 AS bare, {_list('curl/8.0', 'Mozilla/5.0 (X11)', 'AutoIt x/1', 'short', 'Mozilla/4.0 (compatible; MSIE 6.0;)', '')}[event_id % 6 + 1] AS agent, event_id % 11 = 1 AS big, event_id % 13 = 0 AS huge FROM events),
tls AS (SELECT epoch_us(ts)::bigint AS t, 'f' || event_id AS f, event_id % 3 <> 2 AS client, CASE event_id % 5 WHEN 0 THEN 'ftp.' || user_id WHEN 1 THEN 'FTPS' || user_id WHEN 2 THEN NULL ELSE 'www.example' END AS sni, event_id % 4 AS j, {_list(769, 771, 772, 768, 771)}[event_id % 5 + 1] AS version FROM events),
dns AS (SELECT epoch_us(ts)::bigint AS t, CASE WHEN event_id % 9 = 0 THEN repeat('a', 60) ELSE 'b' END || '.' || (user_id % 20) || 'r.example' AS name, (user_id % 20) || 'r.example' AS root, event_id % 3 AS k, event_id % 10 = 0 AS failed, CASE WHEN event_id % 3 = 1 THEN repeat('t', CASE WHEN event_id % 2 = 0 THEN 101 ELSE 100 END) ELSE '192.0.2.' || (event_id % (user_id % 9 + 1)) END AS data FROM events)"""
_BAD = list(rules.BAD_JA3.items())[:2]


@query(f"""WITH {_HTTP}, x AS (SELECT 'scripted_agent' AS rule, agent AS subject, 'Low' AS severity, 0.6 AS confidence, t, 1 AS n FROM http WHERE agent = 'curl/8.0' UNION ALL SELECT 'large_download', uri, 'Low', 0.4, t, 1 FROM http WHERE huge UNION ALL SELECT 'large_post', uri, 'Medium', 0.6, t, 1 FROM http WHERE big AND method = 'POST'
UNION ALL SELECT 'c2_path', uri, 'Medium', 0.65, t, 1 FROM http WHERE uri LIKE '/gate%' OR uri LIKE '/panel%' UNION ALL SELECT 'malware_agent', agent, 'High', 0.85, t, 1 FROM http WHERE agent LIKE 'AutoIt%' OR agent LIKE '%MSIE 6.0;%' UNION ALL SELECT 'odd_agent', agent, 'Low', 0.5, t, 1 FROM http WHERE agent IN ('short', '')
UNION ALL SELECT 'post_without_host', uri, 'Medium', 0.7, t, 1 FROM http WHERE method = 'POST' AND bare UNION ALL SELECT 'bad_ja3', CASE j WHEN 0 THEN '{_BAD[0][1]} {_BAD[0][0]}' ELSE '{_BAD[1][1]} {_BAD[1][0]}' END, 'Critical', 0.95, t, 1 FROM tls WHERE client AND j < 2 UNION ALL SELECT 'no_sni', f, 'Medium', 0.6, t, 1 FROM tls WHERE client AND sni IS NULL
UNION ALL SELECT 'ftp_sni', sni, 'High', 0.8, t, 1 FROM tls WHERE client AND lower(sni) LIKE 'ftp%' UNION ALL SELECT 'old_tls', f, 'Medium', 0.6, t, 1 FROM tls WHERE version IN (768, 769) UNION ALL SELECT 'long_name', name, 'Medium', 0.7, t, 1 FROM dns WHERE length(name) > 60 UNION ALL SELECT 'large_txt', name, 'Medium', 0.6, t, 1 FROM dns WHERE k = 1 AND length(data) > 100
UNION ALL SELECT 'nxdomain', count(*) FILTER (failed)::varchar, 'Medium', 0.7, min(t), 1 FROM dns HAVING count(*) FILTER (failed) > 5 UNION ALL SELECT 'dns_volume', root, 'Low', 0.5, min(t), 1 FROM dns GROUP BY root HAVING count(*) > 10 UNION ALL SELECT 'fast_flux', root, 'Medium', 0.7, min(t), 1 FROM dns GROUP BY root HAVING count(DISTINCT data) FILTER (k <> 1) >= 5)
SELECT rule, subject, any_value(severity) AS severity, any_value(confidence)::double AS confidence, sum(n)::bigint AS n, min(t) AS first_us FROM x GROUP BY 1, 2""")
def protocol_rules(spark, sf_dir):
    """Every rule over transactions, hellos and names, each with hits."""
    http, tls, dns = protocol_records(spark, sf_dir)
    return rules.default().findings(http=http, tls=tls, dns=dns)


@query("""WITH a AS (SELECT event_id, user_id % 30 AS u, user_id % 7 AS m, event_id % 5 = 0 AS six FROM events)
SELECT event_id, CASE WHEN six THEN '2001:db8:' || printf('%x', u) || '::' || printf('%x', event_id % 256) ELSE '10.' || u || '.' || m || '.' || (event_id % 256) END AS ip, CASE WHEN six THEN CASE WHEN u < 25 THEN 'v6 ' || u ELSE 'v6' END WHEN u >= 25 THEN 'all' WHEN m = u % 7 THEN 'lab ' || u ELSE 'site ' || u END AS label FROM a""")
def ip_enrichment(spark, sf_dir):
    """Addresses of both families in nested networks; the innermost names the place."""
    e, i = _table(spark, sf_dir, "events").select("event_id", "user_id"), F.col("event_id")
    text = lambda c: c.cast("string")
    u, low = F.col("user_id") % 30, lambda c: F.lower(F.hex(c))
    ip = F.when(i % 5 == 0, F.concat(F.lit("2001:0DB8:"), low(u), F.lit("::"), low(i % 256))).otherwise(F.concat(F.lit("10."), text(u), F.lit("."), text(F.col("user_id") % 7), F.lit("."), text(i % 256)))
    n = F.col("n_nationkey")
    named = lambda net, label: F.struct(net.alias("network"), label.alias("label"))
    some = F.array(named(F.concat(F.lit("10."), text(n), F.lit(".0.0/16")), F.concat(F.lit("site "), text(n))), named(F.concat(F.lit("10."), text(n), F.lit("."), text(n % 7), F.lit(".0/24")), F.concat(F.lit("lab "), text(n))), named(F.concat(F.lit("2001:db8:"), low(n), F.lit("::/48")), F.concat(F.lit("v6 "), text(n))), named(F.lit("10.0.0.0/8"), F.lit("all")), named(F.lit("2001:db8::/32"), F.lit("v6")))
    table = _table(spark, sf_dir, "nation").select(F.explode(some).alias("x")).select("x.*")
    found = enrich.looked_up(e.select("event_id", ip.alias("ip")), table)
    return found.select("event_id", F.replace("ip", F.lit("2001:0DB8"), F.lit("2001:db8")).alias("ip"), F.col("about.label").alias("label"))


@query(f"WITH {TWO_FILES} SELECT dst_ip AS ip, dst_port AS port, protocol, app, count(*)::bigint AS n_flows, count(DISTINCT src_ip)::bigint AS clients FROM flows GROUP BY ALL")
def host_services(spark, sf_dir):
    return detect.services(case.from_packets(two_files(spark, sf_dir)))


@query("SELECT event_id, '^err' AS pattern FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'purchase|click' FROM events WHERE event_type IN ('purchase', 'click') UNION ALL SELECT event_id, 'c.*k' FROM events WHERE event_type = 'click'")
def stream_alerts(spark, sf_dir):
    """Alerts of a stream that reads all there is, recorded and read again."""
    rows, source, out = _table(spark, sf_dir, "events").select("event_id", "event_type"), new_path(spark, "arrivals"), new_path(spark, "alerts")
    rows.write.parquet(source)
    told = alerts.alerts(spark.readStream.schema(rows.schema).parquet(source), ["^err", "purchase|click", "c.*k"], "event_type").select("event_id", "pattern")
    alerts.record(told, out, new_path(spark, "checkpoint"))
    return spark.read.schema(told.schema).parquet(out)
