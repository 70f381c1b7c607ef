"""Registered queries over the test tables, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwake.functions import codec, mime, net, text
from sparkwake.operators import detect, search
from sparkwake.plans.adapters import FLOWS, NAMES, OUTSIDE, flows, names

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OUT, _SRC = OUTSIDE.format("dst_ip"), OUTSIDE.format("src_ip")
_IPKEY = "(split_part({0},'.',1)::bigint*16777216 + split_part({0},'.',2)::bigint*65536 + split_part({0},'.',3)::bigint*256 + split_part({0},'.',4)::bigint)"
_FWD = f"({_IPKEY.format('src_ip')}, src_port) <= ({_IPKEY.format('dst_ip')}, dst_port)"


@query(f"WITH {FLOWS} SELECT flow_id, CASE WHEN {_FWD} THEN src_ip ELSE dst_ip END AS lo_ip, CASE WHEN {_FWD} THEN src_port ELSE dst_port END AS lo_port, CASE WHEN {_FWD} THEN dst_ip ELSE src_ip END AS hi_ip, {_FWD} AS forward FROM flows")
def canonical_key(spark, sf_dir):
    return flows(spark, sf_dir).select("flow_id", net.canonical().alias("k")).select("flow_id", "k.lo_ip", "k.lo_port", "k.hi_ip", "k.forward")


@query(f"WITH {FLOWS}, g AS (SELECT dst_ip, floor((ts_us - lag(ts_us) OVER (PARTITION BY dst_ip ORDER BY ts_us, flow_id)) / 1000000.0) AS gap FROM flows WHERE {_OUT} AND NOT {_SRC}), t AS (SELECT dst_ip, count(*)::bigint AS n, avg(gap) AS m, stddev_pop(gap) AS sd FROM g GROUP BY 1) SELECT dst_ip, n, round(m, 6) AS mean_gap, round(CASE WHEN m > 0 THEN sd / m ELSE 1.0 END, 6) AS cv, (CASE WHEN m > 0 THEN sd / m ELSE 1.0 END) < 0.3 AND m < 300 AS hit FROM t WHERE n >= 3")
def beacon_cv(spark, sf_dir):
    return detect.beacons(flows(spark, sf_dir)).withColumn("mean_gap", F.round("mean_gap", 6)).withColumn("cv", F.round("cv", 6))


_EXFIL = f"SELECT ip, sum(o)::bigint AS bytes_out, sum(a)::bigint AS bytes_total, count(*)::bigint AS n_flows FROM (SELECT CASE WHEN {_OUT} THEN dst_ip ELSE src_ip END AS ip, CASE WHEN {_OUT} THEN fwd_bytes ELSE rev_bytes END AS o, fwd_bytes + rev_bytes AS a FROM flows WHERE {_OUT} <> {_SRC}) GROUP BY 1"
_LEVEL = "CASE WHEN bytes_out > 1000000 THEN 'High' WHEN bytes_out > 100000 THEN 'Medium' WHEN bytes_out > 10000 THEN CASE WHEN bytes_out / greatest(bytes_total, 1) > 0.7 THEN 'Medium' ELSE 'Low' END END"


@query(f"WITH {FLOWS} SELECT *, {_LEVEL} AS severity, CASE WHEN bytes_out > 1000000 THEN 0.8 WHEN bytes_out > 10000 THEN greatest(CASE WHEN bytes_out > 100000 THEN 0.6 ELSE 0.4 END, CASE WHEN bytes_out / greatest(bytes_total, 1) > 0.7 THEN 0.7 ELSE 0 END) END::double AS confidence FROM ({_EXFIL})")
def exfil_by_dst(spark, sf_dir):
    return detect.exfiltration(flows(spark, sf_dir))


@query(f"WITH {FLOWS} SELECT flow_id, dst_ip, fwd_bytes, rev_bytes FROM flows WHERE fwd_bytes > 0 AND rev_bytes > 0 AND fwd_bytes / (fwd_bytes + rev_bytes) > 0.85 AND fwd_bytes > 50000 AND {_OUT}")
def asymmetric_flows(spark, sf_dir):
    return detect.asymmetric(flows(spark, sf_dir)).select("flow_id", "dst_ip", "fwd_bytes", "rev_bytes")


@query("SELECT src_ip, ports, ports > 15 AS hit FROM (SELECT '10.1.0.' || l_suppkey::varchar AS src_ip, count(DISTINCT l_partkey % (l_suppkey % 30 + 1))::bigint AS ports FROM lineitem GROUP BY 1)")
def port_fanout(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("10.1.0."), F.col("l_suppkey").cast("string")).alias("src_ip"), (F.col("l_partkey") % (F.col("l_suppkey") % 30 + 1)).alias("dst_port"))
    return detect.port_fanout(rows)


@query(f"WITH {FLOWS} SELECT src_ip, targets, targets > 2 AS hit FROM (SELECT src_ip, count(DISTINCT dst_ip || ':' || dst_port::varchar)::bigint AS targets FROM flows WHERE NOT {_OUT} AND NOT {_SRC} AND dst_port IN (445,139,3389,22,23,5985,5986,135,593) GROUP BY 1)")
def lateral_targets(spark, sf_dir):
    return detect.lateral(flows(spark, sf_dir))


@query(f"WITH {FLOWS} SELECT flow_id, dst_ip, dst_port FROM flows WHERE {_OUT} AND dst_port IN (4444,5555,6666,7777,8888,9999,1337,31337,12345,54321,3389,5900,5985,5986,2222,8443,8080,1080,9090)")
def suspicious_ports(spark, sf_dir):
    return detect.suspicious_ports(flows(spark, sf_dir)).select("flow_id", "dst_ip", "dst_port")


@query(f"WITH {FLOWS} SELECT dst_ip, count(*)::bigint AS n FROM flows WHERE {_OUT} GROUP BY 1 ORDER BY n DESC, dst_ip LIMIT 5")
def ext_dest_summary(spark, sf_dir):
    return flows(spark, sf_dir).where(net.is_external(F.col("dst_ip"))).groupBy("dst_ip").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "dst_ip").limit(5)


@query(f"WITH {FLOWS} SELECT app AS kind, arg_min(flow_id, (ts_us, flow_id)) AS flow_id, min(ts_us) AS ts_us FROM flows WHERE app IN ('Ftp', 'Telnet', 'Smtp') GROUP BY 1")
def cleartext_first_seen(spark, sf_dir):
    return detect.first_cleartext(flows(spark, sf_dir)).select("kind", "flow_id", "ts_us")


@query(f"WITH {FLOWS} SELECT dst_ip, n, n >= 3 AS hit FROM (SELECT dst_ip, count(*)::bigint AS n FROM flows WHERE app = 'Tls' AND duration_us < 2000000 AND fwd_bytes + rev_bytes < 5000 AND {_OUT} GROUP BY 1)")
def short_encrypted(spark, sf_dir):
    return detect.short_encrypted(flows(spark, sf_dir))


@query(f"WITH {FLOWS} SELECT sum(fwd_bytes + rev_bytes)::bigint AS bytes, count(*)::bigint AS n_flows, count(*) FILTER (protocol = 'tcp')::bigint AS tcp, count(*) FILTER (protocol = 'udp')::bigint AS udp, count(DISTINCT CASE WHEN {_OUT} THEN dst_ip END)::bigint AS external FROM flows")
def traffic_summary(spark, sf_dir):
    return detect.traffic(flows(spark, sf_dir))


@query(f"WITH {FLOWS} SELECT coalesce(app, 'Unknown') AS app, count(*)::bigint AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM flows GROUP BY 1")
def proto_breakdown(spark, sf_dir):
    t = flows(spark, sf_dir).groupBy(F.coalesce("app", F.lit("Unknown")).alias("app")).agg(F.count(F.lit(1)).alias("n"))
    return t.select("app", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("percent"))


@query(f"WITH {FLOWS} SELECT ip, sum(b)::bigint AS bytes FROM (SELECT src_ip AS ip, fwd_bytes AS b FROM flows UNION ALL SELECT dst_ip, rev_bytes FROM flows) GROUP BY 1 ORDER BY bytes DESC, ip LIMIT 20")
def top_talkers(spark, sf_dir):
    return detect.talkers(flows(spark, sf_dir))


@query(f"WITH {FLOWS} SELECT least(src_port, dst_port) AS port, count(*)::bigint AS n FROM flows GROUP BY 1 ORDER BY n DESC, port LIMIT 20")
def top_ports(spark, sf_dir):
    return detect.busy_ports(flows(spark, sf_dir))


@query(f"WITH {FLOWS} SELECT ip, sum(s)::bigint AS sent, sum(g)::bigint AS received, count(*)::bigint AS n_flows, min(ts_us) AS first_us, max(ts_us) AS last_us, coalesce(string_agg(DISTINCT app, ',' ORDER BY app), '') AS services FROM (SELECT src_ip AS ip, fwd_bytes AS s, rev_bytes AS g, ts_us, app FROM flows UNION ALL SELECT dst_ip, rev_bytes, fwd_bytes, ts_us, app FROM flows) GROUP BY 1")
def host_profiles(spark, sf_dir):
    return detect.hosts(flows(spark, sf_dir))


@query(f"WITH {FLOWS} SELECT ts_us, 'flow_start' AS kind, flow_id::varchar AS ref FROM flows UNION ALL SELECT epoch_us(o_orderdate)::bigint, 'order', o_orderkey::varchar FROM orders")
def timeline_union(spark, sf_dir):
    a = flows(spark, sf_dir).select("ts_us", F.lit("flow_start").alias("kind"), F.col("flow_id").cast("string").alias("ref"))
    o = _table(spark, sf_dir, "orders").select(F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts_us"), F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("ref"))
    return a.unionByName(o)


def _sweep(name: str, kind: str, table: str, key: str, column: str, pattern: str, least: int = 0) -> None:
    sql = f"SELECT {key}, value FROM (SELECT {key}, unnest(regexp_extract_all({column}, '{pattern.replace(chr(39), chr(39) * 2)}')) AS value FROM {table})" + (f" WHERE length(value) >= {least}" if least else "")
    f = lambda spark, sf_dir: text.sweep(_table(spark, sf_dir, table), kind, key, column)
    QUERIES[name], ORACLE_SQL[name] = f, sql


for _name, _kind, _t, _k, _c in (("url_sweep", "Url", "pages", "page_id", "url"), ("email_sweep", "Email", "documents", "doc_id", "text"), ("ipv4_sweep", "Ipv4", "documents", "doc_id", "text"), ("base64_sweep", "Base64Blob", "documents", "doc_id", "text"), ("hex_sweep", "HexBlob", "documents", "doc_id", "text")):
    _sweep(_name, _kind, _t, _k, _c, *text.SWEEPS[_kind])

_SPLICED = "text || CASE doc_id % 4 WHEN 0 THEN ' flag{doc_' || doc_id::varchar || '}' WHEN 1 THEN ' picoCTF{x' || (doc_id % 7)::varchar || '}' ELSE '' END"


_MATCHES = " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(t, '{p}')) AS flag FROM s" for p in text.FLAGS)


@query(f"WITH s AS (SELECT doc_id, {_SPLICED} AS t FROM documents), m AS ({_MATCHES}) SELECT flag, min(doc_id) AS doc_id FROM m GROUP BY 1")
def flag_sweep_dedup(spark, sf_dir):
    d = F.col("doc_id")
    splice = F.when(d % 4 == 0, F.concat(F.lit(" flag{doc_"), d.cast("string"), F.lit("}"))).when(d % 4 == 1, F.concat(F.lit(" picoCTF{x"), (d % 7).cast("string"), F.lit("}"))).otherwise("")
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.explode(text.flags(F.concat("text", splice))).alias("flag"))
    return rows.groupBy("flag").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def decode_base64(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("b"))
    return rows.select("doc_id", F.md5(codec.decoded(F.regexp_replace("b", r"\s", "").cast("binary"), "base64", short=True)).alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def decode_hex(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.hex(F.encode("text", "UTF-8")).alias("h"))
    return rows.select("doc_id", F.md5(codec.decoded(F.col("h").cast("binary"), "hex", short=True)).alias("digest"))


@query("SELECT doc_id, md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm')) AS digest FROM documents")
def decode_rot13(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(text.rot13(F.col("text"))).alias("digest"))


@query("SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*)::bigint AS copies FROM documents GROUP BY 1")
def sha256_dedup(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents), c AS (SELECT doc_id, x, count(*) AS n FROM b GROUP BY 1, 2), t AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM c GROUP BY 1) SELECT doc_id, round(coalesce(e, 0.0), 6) AS entropy FROM documents LEFT JOIN t USING (doc_id)")
def byte_entropy(spark, sf_dir):
    return text.byte_entropy(_table(spark, sf_dir, "documents"), "doc_id").withColumn("entropy", F.round("entropy", 6))


@query("SELECT page_id, CASE WHEN strlen(regexp_replace(html, '[^\\x20-\\x7e\\n\\r\\t]', '', 'g')) / octet_length(encode(html)) > 0.85 THEN 'text/plain' ELSE 'application/octet-stream' END AS mime, sha256(html) AS sha FROM pages")
def mime_sniff(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", mime.by_magic(F.encode("html", "UTF-8")).alias("mime"), F.sha2("html", 256).alias("sha"))


@query("SELECT root, count(*)::bigint AS n FROM (SELECT string_split(h, '.')[-2] || '.' || string_split(h, '.')[-1] AS root FROM (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS h FROM pages)) GROUP BY 1")
def root_domain(spark, sf_dir):
    return _table(spark, sf_dir, "pages").groupBy(net.root_domain(net.host_of(F.col("url"))).alias("root")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH h AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages), l AS (SELECT host, string_split(host, '.')[1] AS label FROM h), c AS (SELECT *, len(regexp_extract_all(label, '[aeiou]')) AS v, len(regexp_extract_all(label, '[bcdfghjklmnpqrstvwxyz]')) AS c, len(regexp_extract_all(label, '[0-9]')) AS d, length(label) AS n FROM l) SELECT host, host LIKE '%.%' AND n >= 8 AND (v = 0 OR c > 5 * v OR d >= n // 2) AS generated FROM c")
def dga_labels(spark, sf_dir):
    h = _table(spark, sf_dir, "pages").select(net.host_of(F.col("url")).alias("host")).distinct()
    return h.select("host", net.looks_generated(F.col("host")).alias("generated"))


@query("SELECT url AS value, max(CASE WHEN lower(url) LIKE '%..%' OR lower(url) LIKE '%\\%2e\\%2e%' ESCAPE '\\' THEN 0.9 WHEN regexp_matches(lower(url), '/admin|/shell|/cmd|/exec') THEN 0.7 ELSE 0.3 END)::double AS confidence FROM pages GROUP BY 1")
def url_ioc(spark, sf_dir):
    return detect.url_iocs(_table(spark, sf_dir, "pages")).withColumn("confidence", F.col("confidence").cast("double"))


_PATHS = ("/en/1", "/fr/", "/de/")


@query("SELECT page_id, CASE WHEN contains(url, '/en/1') THEN '/en/1' WHEN contains(url, '/fr/') THEN '/fr/' WHEN contains(url, '/de/') THEN '/de/' END AS pattern FROM pages WHERE contains(url, '/en/1') OR contains(url, '/fr/') OR contains(url, '/de/')")
def c2_uri_match(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", detect.first_contained(F.col("url"), _PATHS).alias("pattern")).where("pattern is not null")


@query("SELECT event_id, md5('771,' || (event_id % 97 + 4865)::varchar || '-49195,0-10-' || (event_id % 97)::varchar || ',29-23,0') AS ja3 FROM events")
def ja3_hash(spark, sf_dir):
    k = (F.col("event_id") % 97).cast("int")
    ints = lambda *x: F.array_join(F.transform(net.without_grease(F.array(*[v if not isinstance(v, int) else F.lit(v) for v in x])), lambda v: v.cast("string")), "-")
    return _table(spark, sf_dir, "events").select("event_id", F.md5(F.concat_ws(",", F.lit("771"), ints(0x0A0A, k + 4865, 49195), ints(0, 10, k), ints(0x2A2A, 29, 23), F.lit("0"))).alias("ja3"))


@query(f"WITH {NAMES} SELECT root, count(*)::bigint AS n, count(*) FILTER (rcode = 3)::bigint AS nxdomain, count(*) > 10 AS hit FROM names GROUP BY 1")
def dns_volume(spark, sf_dir):
    return detect.dns_volume(names(spark, sf_dir))


@query(f"WITH {NAMES} SELECT root, count(DISTINCT data)::bigint AS addresses, count(DISTINCT data) >= 5 AS hit FROM names WHERE data IS NOT NULL GROUP BY 1")
def dns_fastflux(spark, sf_dir):
    return detect.fast_flux(names(spark, sf_dir))


@query("WITH s AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' Bearer abcdefgh' || doc_id::varchar WHEN 1 THEN ' ghp_aaaaaaaaaaaaaaaaaaaa' || doc_id::varchar ELSE '' END AS t FROM documents), m AS (SELECT doc_id, 'BearerToken' AS kind, unnest(regexp_extract_all(t, '[Bb]earer ([A-Za-z0-9._~+/-]{8,}=*)', 1)) AS value FROM s UNION ALL SELECT doc_id, 'ApiKey', unnest(regexp_extract_all(t, 'AKIA[A-Z0-9]{16}')) FROM s UNION ALL SELECT doc_id, 'ApiKey', unnest(regexp_extract_all(t, 'gh[poshru]_[A-Za-z0-9]{20,}')) FROM s UNION ALL SELECT doc_id, 'HttpFormLogin', unnest(regexp_extract_all(t, 'password=([^&\\s]{4,})', 1)) FROM s) SELECT DISTINCT * FROM m")
def creds_regex(spark, sf_dir):
    d = F.col("doc_id")
    splice = F.when(d % 3 == 0, F.concat(F.lit(" Bearer abcdefgh"), d.cast("string"))).when(d % 3 == 1, F.concat(F.lit(" ghp_aaaaaaaaaaaaaaaaaaaa"), d.cast("string"))).otherwise("")
    return text.credentials(_table(spark, sf_dir, "documents").select("doc_id", F.concat("text", splice).alias("text")), "doc_id")


_TOKENS = "regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+')"


def _bm25(terms: list[str], table: str, key: str) -> str:
    f = [f"len(list_filter(w, lambda x: x = '{t}'))" for t in terms]
    cols = ", ".join(f"{x} AS f{i}" for i, x in enumerate(f))
    part = " + ".join(f"greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / a))" for i in range(len(f)))
    return f"WITH t AS (SELECT {key}, {_TOKENS} AS w FROM {table}), c AS (SELECT {key}, len(w) AS len, {cols} FROM t), g AS (SELECT count(*) AS n, avg(len) AS a, {', '.join(f'count(*) FILTER (f{i} > 0) AS n{i}' for i in range(len(f)))} FROM c) SELECT {key}, round({part}, 6) AS score FROM c, g WHERE {' AND '.join(f'f{i} > 0' for i in range(len(f)))}"


@query(_bm25(["thble", "inner"], "documents", "doc_id").replace("'inner'", "'onha'"))
def bm25_search(spark, sf_dir):
    return search.search(_table(spark, sf_dir, "documents"), "thble onha", "doc_id", limit=None).withColumn("score", F.round("score", 6))


@query(_bm25(["the", "of"], "benchmark", "item_id"))
def scoped_search(spark, sf_dir):
    q = search.parse("benchmark: the of", {"benchmark", "documents"})
    return search.search(_table(spark, sf_dir, q.table), q, "item_id", limit=None).withColumn("score", F.round("score", 6))


_PHRASE = "len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the'))"


@query(f"WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents), c AS (SELECT doc_id, len(w) AS len, {_PHRASE} AS f, len(list_filter(w, lambda x: x = 'thble')) AS x FROM t), g AS (SELECT count(*) AS n, avg(len) AS a, count(*) FILTER (f > 0) AS k FROM c) SELECT doc_id, round(greatest(ln((n - k + 0.5) / (k + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / a)), 6) AS score FROM c, g WHERE f > 0 AND x = 0")
def phrase_search(spark, sf_dir):
    return search.search(_table(spark, sf_dir, "documents"), '"of the" NOT thble', "doc_id", limit=None).withColumn("score", F.round("score", 6))


@query(f"WITH {FLOWS}, h AS (SELECT dst_ip AS v FROM flows WHERE {_OUT} GROUP BY 1) SELECT 'IpAddress' AS kind, v AS value, v LIKE '203.%' AS malicious, (CASE WHEN v LIKE '203.%' THEN 80 ELSE 10 END)::int AS score FROM h")
def ioc_enrichment(spark, sf_dir):
    iocs = flows(spark, sf_dir).where(net.is_external(F.col("dst_ip"))).select(F.lit("IpAddress").alias("kind"), F.col("dst_ip").alias("value")).distinct()
    feed = iocs.select("value", F.when(F.col("value").startswith("203."), 80).otherwise(10).alias("abuse"), F.lit(0).alias("vt"), F.lit(1).alias("pulses"))
    return detect.enrich(iocs, feed)


@query(f"WITH {FLOWS} SELECT concat_ws(' ', 'Flows: ' || count(*)::varchar || '.', 'Bytes: ' || sum(fwd_bytes + rev_bytes)::bigint::varchar || '.', 'External hosts: ' || count(DISTINCT CASE WHEN {_OUT} THEN dst_ip END)::varchar || '.') AS summary FROM flows")
def exec_summary(spark, sf_dir):
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("."))
    return detect.traffic(flows(spark, sf_dir)).select(F.concat_ws(" ", line("Flows", "n_flows"), line("Bytes", "bytes"), line("External hosts", "external")).alias("summary"))


@query()
def auto_decode(spark, sf_dir):
    b = F.base64(F.encode(F.hex(F.encode("text", "UTF-8")), "UTF-8"))
    for end in "\r\n":
        b = F.replace(b, F.lit(end), F.lit(""))
    rows = _table(spark, sf_dir, "documents").select("doc_id", b.cast("binary").alias("data"))
    return codec.auto_decoded(rows, "doc_id").select("doc_id", F.array_join("chain", "|").alias("chain"), "printable", F.md5("data").alias("digest"))
