"""The registry of rules, and the plan that runs many rules with few scans.

A rule reads one source (flows, http, tls, dns, or any table that is given by name). Without a key it looks at single
rows; all such rules of a source run in one scan. With a key it looks at one row a value of the key, with the measures
(aggregates) it names; all rules of a source and key share one aggregation. Conditions, subjects and measures are SQL
expressions over the source's columns, so rules can be kept as data, and users can add theirs:

    mine = default().add(Rule("big_flow", "flows", "fwd_bytes > 1e9", "flow_id", "'High'", "0.8", "Exfiltration"))
    mine.findings(flows=flows)

Equal findings (rule and subject) are one, with the number of rows behind it, the highest severity and confidence, and
the time of the first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwake.functions.net import PRIVATE_PATTERN, is_external, is_internal, root_domain

SEVERITY = ("Info", "Low", "Medium", "High", "Critical")
#: Ports that rules look for (fixed values).
SUSPICIOUS_PORTS = (4444, 5555, 6666, 7777, 8888, 9999, 1337, 31337, 12345, 54321, 3389, 5900, 5985, 5986, 2222, 8443, 8080, 1080, 9090)
ADMIN_PORTS = (445, 139, 3389, 22, 23, 5985, 5986, 135, 593)
#: TLS fingerprints of known malware, words of its requests and agents (fixed values).
BAD_JA3 = {
    "51c64c77e60f3980eea90869b68c58a8": "CobaltStrike", "72a589da586844d7f0818ce684948eea": "CobaltStrike", "a0e9f5d64349fb13191bc781f81f42e1": "CobaltStrike",
    "b742b407517bac9536a77a7b0fee28e9": "CobaltStrike", "ae4edc6faf64d08308082ad26be60767": "CobaltStrike", "649d6810e8392f63dc311eecb6b7098b": "CobaltStrike",
    "e35df3e28c5ce5e11c2b726fad6d31ac": "Metasploit", "5d65ea3fb1d4aa7d826733f2f4c474bf": "Metasploit", "c12f54a3f91dc7bafd92cb59fe009a35": "Sliver",
    "3b5074b1b5d032e5620f69f9f700ff0e": "TrickBot", "6734f37431670b3ab4292b8f60f29984": "Dridex", "e7d705a3286e19ea42f587b344ee6865": "Emotet",
    "4d7a28d6f2263ed61de88ca66eb01189": "Emotet", "c2b93e3c03adfaf2f6c5ad1a44bdc5f8": "QakBot", "37f463bf4616ecd445d4a1937da06e19": "IcedID",
    "8916410db85077a5460817142dcbc8de": "AgentTesla", "a56c02640a77b3e4a0a7ec78a2ac7324": "FormBook", "cd08e31494816f6d8f9960b22c77c80a": "SnakeKeylogger",
    "4cbaed7d3be18d505ed14098bdfe2439": "RedLine", "b2910e5b0a311293e7e941c6ea80e46a": "Raccoon", "c64eb5dd1a0e9dc88bab84a2ffe2feb8": "AsyncRAT",
    "09e1e1e0f37ed38e3a5f8d6a5d458e3d": "NjRAT", "2d1eb5817ece335c05db1cfb403d2c2e": "DarkComet",
}
C2_PATHS = ("/submit.php", "/gate.php", "/panel/", "/login.php", "/index.php?id=", "/connect.php", "/command.php", "/beacon/", "/api/v1/report", "/wp-content/uploads/", "/wp-includes/js/", "/.env", "/config.php", "/upload.php", "/data.php", "/task.php")
MALWARE_AGENTS = ("JEGJWE", "Mozilla/4.0 (compatible; MSIE 6.0;", "AutoIt", "CholObj")
SCRIPT_AGENTS = ("python-requests", "curl", "wget", "powershell", "nmap", "nikto", "sqlmap", "gobuster", "dirbuster", "masscan", "zgrab", "httpx")




def rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITY)), severity).cast("int") - 1


@dataclass(frozen=True)
class Rule:
    """name, source, condition, subject, severity and confidence as SQL; key and the measures that the condition reads."""

    name: str
    source: str
    when: str
    subject: str
    severity: str
    confidence: str
    category: str = "Custom"
    attack: tuple[str, ...] = ()
    key: str | None = None
    measures: dict[str, str] = field(default_factory=dict)


#: What a key makes of its source: rows with `key` and the columns that measures read.
Key = Callable[[DataFrame], DataFrame]


@dataclass
class Registry:
    """Rules by name, and keys by source and name. Adding returns another registry."""

    rules: dict[str, Rule] = field(default_factory=dict)
    keys: dict[tuple[str, str], Key] = field(default_factory=dict)

    def add(self, *rules: Rule) -> Registry:
        for r in rules:
            if r.key and (r.source, r.key) not in self.keys:
                raise ValueError(f"{r.name}: {r.source} has no key {r.key}")
        return Registry(self.rules | {r.name: r for r in rules}, self.keys)

    def add_key(self, source: str, name: str, key: Key) -> Registry:
        return Registry(self.rules, self.keys | {(source, name): key})

    def without(self, *names: str) -> Registry:
        return Registry({k: r for k, r in self.rules.items() if k not in names}, self.keys)

    def hits(self, **inputs: DataFrame) -> list[DataFrame]:
        """rule, subject, severity, confidence, ts_us and n of every hit: a table for each source and key that has rules."""
        groups: dict[tuple[str, str | None], list[Rule]] = {}
        for r in self.rules.values():
            if inputs.get(r.source) is not None:
                groups.setdefault((r.source, r.key), []).append(r)
        return [_hits(inputs[source], rules, key and self.keys[source, key]) for (source, key), rules in groups.items()]

    def findings(self, **inputs: DataFrame) -> DataFrame:
        """rule, subject, severity, confidence, n, first_us of the rules whose source is given, equal ones once."""
        parts = self.hits(**inputs)
        if not parts:
            raise ValueError("no rule has its source")
        return once(reduce(DataFrame.unionByName, parts))


def once(hits: DataFrame) -> DataFrame:
    worst = F.max_by("severity", F.struct(rank(F.col("severity")), "confidence"))
    return hits.groupBy("rule", "subject").agg(worst.alias("severity"), F.max("confidence").alias("confidence"), F.sum("n").alias("n"), F.min("ts_us").alias("first_us"))


def _hits(df: DataFrame, rules: list[Rule], key: Key | None) -> DataFrame:
    if key:
        measures: dict[str, str] = {}
        for r in rules:
            for name, sql in r.measures.items():
                if measures.setdefault(name, sql) != sql:
                    raise ValueError(f"{r.name}: {name} means something else to another rule of this key")
        rows = key(df)
        first = F.min("ts_us") if "ts_us" in rows.columns else F.lit(None)
        df = rows.groupBy("key").agg(*[F.expr(sql).alias(name) for name, sql in measures.items()], first.alias("ts_us"))
    return in_one_pass(df, [(r.name, F.expr(r.when), F.expr(r.subject), F.expr(r.severity), F.expr(r.confidence)) for r in rules])


def in_one_pass(df: DataFrame, cases: list[tuple[str, Column, Column, Column, Column]]) -> DataFrame:
    """Hits of (rule, condition, subject, severity, confidence), all of them in one scan; ts_us where df has it."""
    at = (F.col("ts_us") if "ts_us" in df.columns else F.lit(None)).cast("long")
    one = lambda rule, when, subject, severity, sure: F.when(when, F.struct(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), severity.alias("severity"), sure.cast("double").alias("confidence"), at.alias("ts_us"), F.lit(1).cast("long").alias("n")))
    return df.select(F.explode(F.array_compact(F.array(*[one(*c) for c in cases]))).alias("x")).select("x.*")


def by_address(flows: DataFrame, span: int = 3600) -> DataFrame:
    """A row for each external address and `span` seconds: flows between it and the inside, flows toward it, and gaps.

    out, total, crossing: bytes toward it, all bytes and number of flows whose other end is internal. flows, bytes,
    encrypted, short: of flows that it serves. inside, gap_sum, gap_square: of those from inside, the gaps (whole seconds)
    also to the span before. So a busy address is many rows before it is one.
    """
    end = lambda ip, other, served, sent, got: F.when(is_external(F.col(ip)), F.struct(F.col(ip).alias("key"), is_internal(F.col(other)).alias("crosses"), F.lit(served).alias("served"), F.col(sent).alias("out"), F.col(got).alias("back"), "app", "duration_us", "ts_us"))
    ends = F.array_compact(F.array(end("dst_ip", "src_ip", True, "fwd_bytes", "rev_bytes"), end("src_ip", "dst_ip", False, "rev_bytes", "fwd_bytes")))
    rows = flows.select(F.explode(ends).alias("x")).select("x.*").withColumn("part", F.floor(F.col("ts_us") / (span * 1_000_000)))
    own, total = F.col("crosses") & F.col("served"), F.col("out") + F.col("back")
    whole = lambda later, before: F.floor((later - before) / 1_000_000)
    before = F.max(F.when(own, F.col("ts_us"))).over(Window.partitionBy("key", "part").orderBy("ts_us").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("gap", F.when(own, whole(F.col("ts_us"), before)))
    coded = F.col("served") & F.col("app").isin("Tls", "Https")
    each = rows.groupBy("key", "part").agg(
        F.sum(F.when(F.col("crosses"), F.col("out"))).alias("out"), F.sum(F.when(F.col("crosses"), total)).alias("total"), F.count_if("crosses").alias("crossing"),
        F.count_if("served").alias("flows"), F.sum(F.when(F.col("served"), total)).alias("bytes"), F.count_if(coded).alias("encrypted"), F.count_if(coded & (F.col("duration_us") < 2_000_000) & (total < 5000)).alias("short"),
        F.count_if(own).alias("inside"), F.sum("gap").alias("s"), F.sum(F.col("gap") * F.col("gap")).alias("q"), F.min(F.when(own, F.col("ts_us"))).alias("first"), F.max(F.when(own, F.col("ts_us"))).alias("last"), F.min("ts_us").alias("ts_us"),
    )
    earlier = F.max("last").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("between", F.coalesce(whole(F.col("first"), earlier), F.lit(0)))
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    return each.withColumns({"gap_sum": none("s") + F.col("between"), "gap_square": none("q") + F.col("between") * F.col("between")}).drop("s", "q", "first", "last", "between")


def by_origin(flows: DataFrame) -> DataFrame:
    """A row for each source address and port that it went to: how many internal hosts, where the port is for administration."""
    inner = is_internal(F.col("src_ip")) & is_internal(F.col("dst_ip")) & F.col("dst_port").isin(*ADMIN_PORTS)
    return flows.groupBy(F.col("src_ip").alias("key"), F.col("dst_port").alias("port")).agg(F.countDistinct(F.when(inner, F.col("dst_ip"))).alias("targets"), F.min("ts_us").alias("ts_us"))


def by_root(records: DataFrame) -> DataFrame:
    """A row for each root domain and address that its names resolve to (null: other records)."""
    answer = F.when(F.col("type").isin("A", "AAAA"), F.col("data"))
    at = F.min("ts_us").alias("ts_us") if "ts_us" in records.columns else F.lit(None).cast("long").alias("ts_us")
    return records.groupBy(root_domain(F.col("name")).alias("key"), answer.alias("answer")).agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("rcode") == 3).alias("failed"), at)


def by_nothing(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.lit(0))


def _texts(words: tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "\\'") + "'" for w in words)


def _has(column: str, words: tuple[str, ...]) -> str:
    return f"exists(array({_texts(words)}), w -> contains({column}, w))"


def default() -> Registry:
    """Every built-in rule."""
    inside = lambda ip: f"{ip} rlike '{PRIVATE_PATTERN}'"
    outside = lambda ip: f"not {inside(ip)}"
    ports = lambda x: ", ".join(map(str, x))
    both, mean, bad = "fwd_bytes + rev_bytes", "try_divide(gap_sum, inside - 1)", f"map({', '.join(f'{chr(39)}{k}{chr(39)}, {chr(39)}{v}{chr(39)}' for k, v in BAD_JA3.items())})"
    gaps = {"inside": "sum(inside)", "gap_sum": "sum(gap_sum)", "gap_square": "sum(gap_square)"}
    flows, bytes_ = {"flows": "sum(flows)"}, {"bytes": "sum(bytes)"}
    volume = {"out": "sum(out)", "total": "sum(total)"}
    one_way = "out / greatest(total, 1) > 0.7"
    spread = "try_divide(sqrt(greatest((inside - 1D) * gap_square - double(gap_sum) * gap_sum, 0D)), inside - 1)"
    agent = "lower(user_agent)"
    found = Registry().add_key("flows", "address", by_address).add_key("flows", "origin", by_origin).add_key("dns", "root", by_root).add_key("dns", "all", by_nothing)
    return found.add(
        Rule("exfiltration", "flows", "out > 10000", "key", f"CASE WHEN out > 1000000 THEN 'High' WHEN out > 100000 OR {one_way} THEN 'Medium' ELSE 'Low' END", f"CASE WHEN out > 1000000 THEN 0.8 WHEN {one_way} THEN 0.7 WHEN out > 100000 THEN 0.6 ELSE 0.4 END", "Exfiltration", ("T1041",), "address", volume),
        Rule("asymmetric", "flows", f"fwd_bytes > 50000 and rev_bytes > 0 and try_divide(fwd_bytes, {both}) > 0.85 and {outside('dst_ip')}", "flow_id", "'Medium'", "0.65", "Exfiltration", ("T1048",)),
        Rule("beacon", "flows", f"inside >= 3 and {mean} < 300 and CASE WHEN gap_sum > 0 THEN try_divide({spread}, {mean}) ELSE 1 END < 0.3", "key", "'High'", "0.8", "C2Communication", ("T1071", "T1573"), "address", gaps),
        Rule("encrypted_external", "flows", "inside >= 2 and encrypted > 0 and bytes > 5000", "key", "'Medium'", "0.7", "C2Communication", ("T1573",), "address", {"inside": "sum(inside)", "encrypted": "sum(encrypted)"} | bytes_),
        Rule("suspicious_port", "flows", f"dst_port in ({ports(SUSPICIOUS_PORTS)}) and {outside('dst_ip')}", "flow_id", "'Medium'", "0.6", "Anomaly", ("T1571",)),
        Rule("icmp_volume", "flows", f"app = 'Icmp' and {both} > 500", "flow_id", "'Medium'", "0.6", "Exfiltration", ("T1095",)),
        Rule("ftps_port", "flows", "src_port = 990 or dst_port = 990", "flow_id", "'High'", "0.85", "Exfiltration", ("T1048.003", "T1071.002")),
        Rule("port_scan", "flows", "ports > 15", "key", "'Medium'", "0.75", "ReconActivity", ("T1046",), "origin", {"ports": "count(port)"}),
        Rule("lateral", "flows", "targets > 2", "key", "'High'", "0.7", "LateralMovement", ("T1021",), "origin", {"targets": "sum(targets)"}),
        Rule("cleartext_ftp", "flows", "app in ('Ftp', 'FtpData')", "'Ftp'", "'High'", "0.9", "ClearTextProtocol", ("T1048.003", "T1071.002")),
        Rule("cleartext_telnet", "flows", "app = 'Telnet'", "'Telnet'", "'Medium'", "0.9", "ClearTextProtocol", ("T1021.005",)),
        Rule("cleartext_smtp", "flows", "app = 'Smtp'", "'Smtp'", "'Medium'", "0.7", "Exfiltration", ("T1048.003",)),
        Rule("short_encrypted", "flows", "short >= 3", "key", "'Medium'", "0.65", "C2Communication", ("T1573", "T1071"), "address", {"short": "sum(short)"}),
        Rule("traffic", "flows", "true", "string(null)", "'Info'", "0.2", "Anomaly"),
        Rule("scripted_agent", "http", _has(agent, SCRIPT_AGENTS), "user_agent", "'Low'", "0.6", "ReconActivity", ("T1595",)),
        Rule("large_download", "http", "response_size > 1000000", "uri", "'Low'", "0.4", "Anomaly", ("T1105",)),
        Rule("large_post", "http", "request_size > 100000 and method = 'POST'", "uri", "'Medium'", "0.6", "Exfiltration", ("T1041",)),
        Rule("c2_path", "http", _has("uri", C2_PATHS), "uri", "'Medium'", "0.65", "C2Communication", ("T1071.001",)),
        Rule("malware_agent", "http", _has("user_agent", MALWARE_AGENTS), "user_agent", "'High'", "0.85", "C2Communication", ("T1071.001",)),
        Rule("odd_agent", "http", "user_agent = '' or (length(user_agent) < 20 and not contains(user_agent, ' ') and not contains(user_agent, '/'))", "user_agent", "'Low'", "0.5", "Anomaly", ("T1071.001",)),
        Rule("post_without_host", "http", "method = 'POST' and host is null", "uri", "'Medium'", "0.7", "C2Communication", ("T1071.001",)),
        Rule("bad_ja3", "tls", f"hello = 'client' and map_contains_key({bad}, coalesce(ja3, ''))", f"concat_ws(' ', try_element_at({bad}, ja3), ja3)", "'Critical'", "0.95", "C2Communication", ("T1071",)),
        Rule("no_sni", "tls", "hello = 'client' and sni is null", "flow_id", "'Medium'", "0.6", "C2Communication", ("T1573.002",)),
        Rule("ftp_sni", "tls", "hello = 'client' and (contains(lower(sni), 'ftp.') or startswith(lower(sni), 'ftp'))", "sni", "'High'", "0.8", "Exfiltration", ("T1048.003",)),
        Rule("old_tls", "tls", "version in (2, 768, 769)", "flow_id", "'Medium'", "0.6", "CertificateIssue", ("T1573.002",)),
        Rule("long_name", "dns", "octet_length(name) > 60", "name", "'Medium'", "0.7", "SuspiciousDns", ("T1071.004",)),
        Rule("large_txt", "dns", "type = 'TXT' and octet_length(data) > 100", "name", "'Medium'", "0.6", "Exfiltration", ("T1048.003",)),
        Rule("nxdomain", "dns", "failures > 5", "failures", "'Medium'", "0.7", "SuspiciousDns", ("T1568.002",), "all", {"failures": "count_if(rcode = 3)"}),
        Rule("dns_volume", "dns", "records > 10", "key", "'Low'", "0.5", "SuspiciousDns", ("T1071.004",), "root", {"records": "sum(records)"}),
        Rule("fast_flux", "dns", "addresses >= 5", "key", "'Medium'", "0.7", "SuspiciousDns", ("T1568.001",), "root", {"addresses": "count(answer)"}),
    )
