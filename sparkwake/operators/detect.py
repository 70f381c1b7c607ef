"""Measures and rules over flows, names and transactions. Every rule keeps its measure and marks what it hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwake.functions.net import is_external, is_internal, masked, root_domain
from sparkwake.functions.text import credentials, flags
from sparkwake.operators.rules import ADMIN_PORTS, SUSPICIOUS_PORTS, Registry, default, once, rank

def beacons(flows: DataFrame, span: int = 3600) -> DataFrame:
    """dst_ip, n, mean_gap, cv (of whole seconds between flows from inside), hit.

    Gaps are taken within `span` seconds first and then between the ends of these spans, so no task sees all flows of
    an address that many talk to. Whole seconds add up exactly.
    """
    own = flows.where(is_external(F.col("dst_ip")) & is_internal(F.col("src_ip"))).select("dst_ip", "ts_us", F.floor(F.col("ts_us") / (span * 1_000_000)).alias("part"))
    gap = lambda later, before: F.floor((later - before) / 1_000_000)
    inner = own.withColumn("gap", gap(F.col("ts_us"), F.lag("ts_us").over(Window.partitionBy("dst_ip", "part").orderBy("ts_us"))))
    each = inner.groupBy("dst_ip", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("gap").alias("s"), F.sum(F.col("gap") * F.col("gap")).alias("q"), F.min("ts_us").alias("first"), F.max("ts_us").alias("last"))
    between = gap(F.col("first"), F.lag("last").over(Window.partitionBy("dst_ip").orderBy("part")))
    out = each.withColumn("gap", F.coalesce(between, F.lit(0))).groupBy("dst_ip").agg(F.sum("n").alias("n"), F.sum(F.coalesce("s", F.lit(0)) + F.col("gap")).alias("s"), F.sum(F.coalesce("q", F.lit(0)) + F.col("gap") * F.col("gap")).alias("q")).where("n >= 3")
    gaps, s, q = (F.col("n") - 1).cast("double"), F.col("s").cast("double"), F.col("q").cast("double")
    mean, sd = s / gaps, F.sqrt(F.greatest(gaps * q - s * s, F.lit(0.0))) / gaps
    out = out.select("dst_ip", "n", mean.alias("mean_gap"), F.when(mean > 0, sd / mean).otherwise(1.0).alias("cv"))
    return out.withColumn("hit", (F.col("cv") < 0.3) & (F.col("mean_gap") < 300))


def exfiltration(flows: DataFrame) -> DataFrame:
    """Per external address: bytes toward it, all bytes, flows, severity and confidence by volume and ratio."""
    one = is_external(F.col("dst_ip")) != is_external(F.col("src_ip"))
    out_ = is_external(F.col("dst_ip"))
    rows = flows.where(one).select(F.when(out_, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("ip"), F.when(out_, F.col("fwd_bytes")).otherwise(F.col("rev_bytes")).alias("out"), (F.col("fwd_bytes") + F.col("rev_bytes")).alias("total"))
    t = rows.groupBy("ip").agg(F.sum("out").alias("bytes_out"), F.sum("total").alias("bytes_total"), F.count(F.lit(1)).alias("n_flows"))
    ratio = F.col("bytes_out") / F.greatest(F.col("bytes_total"), F.lit(1))
    level = F.when(F.col("bytes_out") > 1_000_000, 3).when(F.col("bytes_out") > 100_000, 2).when(F.col("bytes_out") > 10_000, 1)
    sure = F.when(level == 3, 0.8).when(level == 2, 0.6).when(level == 1, 0.4)
    one_way = level.isNotNull() & (ratio > 0.7)
    sure = F.when(one_way, F.greatest(sure, F.lit(0.7))).otherwise(sure)
    level = F.when(one_way, F.greatest(level, F.lit(2))).otherwise(level)
    return t.withColumn("severity", F.when(level == 3, "High").when(level == 2, "Medium").when(level == 1, "Low")).withColumn("confidence", sure)


def is_asymmetric() -> Column:
    share = F.col("fwd_bytes") / (F.col("fwd_bytes") + F.col("rev_bytes"))
    return (F.col("fwd_bytes") > 50_000) & (F.col("rev_bytes") > 0) & (share > 0.85) & is_external(F.col("dst_ip"))


def asymmetric(flows: DataFrame) -> DataFrame:
    return flows.where(is_asymmetric())


def port_fanout(flows: DataFrame, over: int = 15) -> DataFrame:
    t = flows.groupBy("src_ip").agg(F.countDistinct("dst_port").alias("ports"))
    return t.withColumn("hit", F.col("ports") > over)


def lateral(flows: DataFrame, over: int = 2) -> DataFrame:
    own = flows.where(is_internal(F.col("src_ip")) & is_internal(F.col("dst_ip")) & F.col("dst_port").isin(*ADMIN_PORTS))
    t = own.groupBy("src_ip").agg(F.countDistinct("dst_ip", "dst_port").alias("targets"))
    return t.withColumn("hit", F.col("targets") > over)


def on_suspicious_port() -> Column:
    return F.col("dst_port").isin(*SUSPICIOUS_PORTS) & is_external(F.col("dst_ip"))


def suspicious_ports(flows: DataFrame) -> DataFrame:
    return flows.where(on_suspicious_port())


def first_cleartext(flows: DataFrame) -> DataFrame:
    """The first flow of each protocol that sends passwords in clear text."""
    kind = F.when(F.col("app").isin("Ftp", "FtpData"), "Ftp").when(F.col("app").isin("Telnet", "Smtp"), F.col("app"))
    rows = flows.withColumn("kind", kind).where(F.col("kind").isNotNull())
    return rows.groupBy("kind").agg(F.min(F.struct("ts_us", "flow_id")).alias("x")).select("kind", "x.ts_us", "x.flow_id")


def _is_short() -> Column:
    return F.col("app").isin("Tls", "Https") & (F.col("duration_us") < 2_000_000) & (F.col("fwd_bytes") + F.col("rev_bytes") < 5000)


def destinations(flows: DataFrame) -> DataFrame:
    """Per external destination: flows, those from inside, encrypted and short encrypted ones, bytes."""
    own = flows.where(is_external(F.col("dst_ip")))
    return own.groupBy("dst_ip").agg(F.count(F.lit(1)).alias("flows"), F.count_if(is_internal(F.col("src_ip"))).alias("n"), F.count_if(F.col("app").isin("Tls", "Https")).alias("encrypted"), F.count_if(_is_short()).alias("short"), F.sum(F.col("fwd_bytes") + F.col("rev_bytes")).alias("bytes"))


def short_encrypted(flows: DataFrame) -> DataFrame:
    t = destinations(flows).where("short > 0").select("dst_ip", F.col("short").alias("n"))
    return t.withColumn("hit", F.col("n") >= 3)


def traffic(flows: DataFrame) -> DataFrame:
    return flows.agg(F.sum(F.col("fwd_bytes") + F.col("rev_bytes")).alias("bytes"), F.count(F.lit(1)).alias("n_flows"), F.count_if(F.col("protocol") == "tcp").alias("tcp"), F.count_if(F.col("protocol") == "udp").alias("udp"), F.countDistinct(F.when(is_external(F.col("dst_ip")), F.col("dst_ip"))).alias("external"))


def talkers(flows: DataFrame, limit: int = 20) -> DataFrame:
    """Addresses by bytes sent."""
    ends = flows.select(F.explode(F.array(F.struct(F.col("src_ip").alias("ip"), F.col("fwd_bytes").alias("b")), F.struct(F.col("dst_ip").alias("ip"), F.col("rev_bytes").alias("b")))).alias("x")).select("x.*")
    return ends.groupBy("ip").agg(F.sum("b").alias("bytes")).orderBy(F.col("bytes").desc(), "ip").limit(limit)


def busy_ports(flows: DataFrame, limit: int = 20) -> DataFrame:
    return flows.withColumn("port", F.least("src_port", "dst_port")).where("port > 0").groupBy("port").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "port").limit(limit)


def hosts(flows: DataFrame) -> DataFrame:
    """Per address: bytes sent and received, flows, first and last time, services."""
    end = lambda ip, sent, got: F.struct(F.col(ip).alias("ip"), F.col(sent).alias("sent"), F.col(got).alias("got"), "ts_us", "app")
    rows = flows.select(F.explode(F.array(end("src_ip", "fwd_bytes", "rev_bytes"), end("dst_ip", "rev_bytes", "fwd_bytes"))).alias("x")).select("x.*")
    return rows.groupBy("ip").agg(F.sum("sent").alias("sent"), F.sum("got").alias("received"), F.count(F.lit(1)).alias("n_flows"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.array_join(F.array_sort(F.collect_set("app")), ",").alias("services"))


def services(flows: DataFrame) -> DataFrame:
    """ip, port, protocol, app, n_flows, clients: what each address serves, a row a service."""
    own = flows.groupBy(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"), "protocol", "app")
    return own.agg(F.count(F.lit(1)).alias("n_flows"), F.countDistinct("src_ip").alias("clients"))


def dns_volume(records: DataFrame, over: int = 10) -> DataFrame:
    t = records.groupBy(root_domain(F.col("name")).alias("root")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rcode") == 3).alias("nxdomain"))
    return t.withColumn("hit", F.col("n") > over)


def fast_flux(records: DataFrame, at_least: int = 5) -> DataFrame:
    own = records.where(F.col("type").isin("A", "AAAA") & F.col("data").isNotNull())
    t = own.groupBy(root_domain(F.col("name")).alias("root")).agg(F.countDistinct("data").alias("addresses"))
    return t.withColumn("hit", F.col("addresses") >= at_least)


def first_contained(text: Column, words: tuple[str, ...]) -> Column:
    """The first of words that text contains; null if none."""
    out = F.when(F.contains(text, F.lit(words[0])), F.lit(words[0]))
    for w in words[1:]:
        out = out.when(F.contains(text, F.lit(w)), F.lit(w))
    return out


def encrypted_external(flows: DataFrame, hellos: DataFrame | None = None) -> DataFrame:
    """External addresses with at least two flows from inside, one encrypted flow and over 5000 bytes in all.

    A server name in any hello (sni) of the capture lowers severity and confidence.
    """
    t, named = destinations(flows), F.lit(False)
    if hellos is not None:
        t, named = t.crossJoin(F.broadcast(hellos.agg((F.count("sni") > 0).alias("named")))), F.col("named")
    t = t.where("n >= 2 and encrypted > 0 and bytes > 5000")
    return t.select("dst_ip", "n", "bytes", F.when(named, "Low").otherwise("Medium").alias("severity"), F.when(named, 0.4).otherwise(0.7).alias("confidence"))


def is_icmp_volume() -> Column:
    return (F.col("app") == "Icmp") & (F.col("fwd_bytes") + F.col("rev_bytes") > 500)


def on_ftps_port() -> Column:
    return (F.col("src_port") == 990) | (F.col("dst_port") == 990)


def external_summary(flows: DataFrame) -> DataFrame:
    """summary: one row of external addresses, flows toward them and the five most frequent; none without any."""
    t = destinations(flows).select("dst_ip", F.col("flows").alias("n"), F.pmod(F.hash("dst_ip"), F.lit(64)).alias("part"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("n").desc(), "dst_ip"))
    best = F.when(F.col("place") <= 5, F.struct((-F.col("n")).alias("m"), "dst_ip"))
    all_ = t.withColumn("place", place).agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("flows"), F.slice(F.array_sort(F.collect_list(best)), 1, 5).alias("top")).where("hosts > 0")
    named = F.array_join(F.transform("top", lambda x: F.concat(x["dst_ip"], F.lit(" ("), (-x["m"]).cast("string"), F.lit(")"))), ", ")
    return all_.select(F.concat(F.col("hosts").cast("string"), F.lit(" addresses, "), F.col("flows").cast("string"), F.lit(" flows: "), named).alias("summary"))


def finding(df: DataFrame, rule: Column | str, subject: Column | str, severity: Column | str, confidence: Column | float, ts_us: Column | None = None) -> DataFrame:
    """Hits as the registry gives them, from rows that are one each."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    at = F.lit(None) if ts_us is None else ts_us
    return df.select(lit(rule).alias("rule"), (subject if isinstance(subject, Column) else F.col(subject)).cast("string").alias("subject"), lit(severity).alias("severity"), lit(confidence).cast("double").alias("confidence"), at.cast("long").alias("ts_us"), F.lit(1).cast("long").alias("n"))


def found(flows: DataFrame, hellos: DataFrame | None = None, more: list[DataFrame] | None = None, registry: Registry | None = None, **inputs: DataFrame) -> DataFrame:
    """rule, subject, severity, confidence, n, first_us of every rule of the registry whose source is given, each once.

    Flows are read four times: by row, by external address, by origin, and for the external summary. `more` are tables of
    hits that come along. A server name in any hello of the capture lowers what encrypted_external says.
    """
    registry = registry or default()
    parts = [*registry.hits(flows=flows, **inputs), finding(external_summary(flows), "external", "summary", "Info", 0.3), *(more or [])]
    if "traffic" in registry.rules:
        none = flows.sparkSession.range(1).select(F.lit("traffic").alias("rule"), F.lit(None).cast("string").alias("subject"), F.lit("Info").alias("severity"), F.lit(0.2).alias("confidence"), F.lit(None).cast("long").alias("ts_us"), F.lit(0).cast("long").alias("n"))
        parts.append(none)
    out = once(reduce(DataFrame.unionByName, parts))
    out = out.withColumn("subject", F.when(F.col("rule") == "traffic", F.col("n").cast("string")).otherwise(F.col("subject")))
    if hellos is None:
        return out
    named = out.crossJoin(F.broadcast(hellos.agg((F.count("sni") > 0).alias("named"))))
    less = F.col("named") & (F.col("rule") == "encrypted_external")
    return named.withColumns({"severity": F.when(less, "Low").otherwise(F.col("severity")), "confidence": F.when(less, 0.4).otherwise(F.col("confidence"))}).drop("named")


def credential_severity(kind: Column) -> Column:
    return F.when(kind == "SshPrivateKey", "Critical").when(kind.isin("HttpBasicAuth", "FtpLogin", "TelnetLogin", "SmtpAuth", "Pop3Login", "Jwt", "ApiKey"), "High").otherwise("Medium")


def text_rules(texts: DataFrame, text: str = "text") -> list[DataFrame]:
    """Every flag and every credential (masked, with its kind) of texts, each once."""
    some = texts.select(F.explode(flags(F.col(text))).alias("flag")).distinct()
    secret = credentials(texts.select(F.lit(0).alias("_key"), text), "_key", text).select("kind", "value").distinct()
    return [finding(some, "flag", "flag", "Critical", 1.0), finding(secret, "credential", F.concat_ws(" ", "kind", masked(F.col("value"))), credential_severity(F.col("kind")), 0.95)]


def ordered(hits: DataFrame) -> DataFrame:
    """Findings, most severe first."""
    return hits.withColumn("severity_rank", rank(F.col("severity"))).orderBy(F.col("severity_rank").desc(), F.col("confidence").desc(), "rule", "subject")


def all_findings(flows: DataFrame, hellos: DataFrame | None = None, texts: DataFrame | None = None, registry: Registry | None = None, **inputs: DataFrame) -> DataFrame:
    """rule, subject, severity, confidence, severity_rank of all rules whose source is given, most severe first."""
    return ordered(found(flows, hellos, text_rules(texts) if texts is not None else None, registry, **inputs)).drop("n", "first_us")


def url_iocs(urls: DataFrame, url: str = "url") -> DataFrame:
    """value, confidence: each URL once; traversal .9, administrative paths .7, the rest .3."""
    u = F.lower(F.col(url))
    risk = F.when(F.contains(u, F.lit("..")) | F.contains(u, F.lit("%2e%2e")), 0.9).when(u.rlike("/admin|/shell|/cmd|/exec"), 0.7).otherwise(0.3)
    return urls.groupBy(F.col(url).alias("value")).agg(F.max(risk).alias("confidence"))


def enrich(iocs: DataFrame, feed: DataFrame) -> DataFrame:
    """iocs (kind, value) joined with a feed (value, abuse, vt, pulses): malicious and score."""
    j = iocs.join(feed, "value", "left")
    bad = (F.coalesce("abuse", F.lit(0)) > 50) | (F.coalesce("vt", F.lit(0)) > F.when(F.col("kind") == "FileHash", 0).otherwise(3)) | ((F.col("kind") == "IpAddress") & (F.coalesce("pulses", F.lit(0)) > 5))
    return j.select("kind", "value", bad.alias("malicious"), F.greatest(F.coalesce("abuse", F.lit(0)), F.coalesce("vt", F.lit(0))).alias("score"))
