"""Artifacts from the bodies of HTTP responses, and credentials from dissected records and texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwake.functions.mime import by_magic, extension_of, kind_of
from sparkwake.functions.text import credentials


def artifacts(bodies: DataFrame) -> DataFrame:
    """id, kind, name, mime, size, sha256, md5, flow_id and ordinal of each distinct body (flow_id, ordinal, content_type, body).

    Of equal bodies the first by flow_id and ordinal counts, and `copies` tells how many there are. The declared type
    goes before the one that the bytes tell.
    """
    rows = bodies.where(F.octet_length("body") > 0).select("flow_id", "ordinal", F.coalesce(F.trim(F.split_part(F.lower("content_type"), F.lit(";"), F.lit(1))), by_magic(F.col("body"))).alias("mime"), F.octet_length("body").cast("long").alias("size"), F.sha2("body", 256).alias("sha256"), F.md5("body").alias("md5"))
    first = rows.groupBy("sha256").agg(F.min(F.struct("flow_id", "ordinal", "mime", "size", "md5")).alias("x"), F.count(F.lit(1)).alias("copies"))
    out = first.select("sha256", "copies", "x.*")
    name = F.concat(F.lit("http_response_"), F.col("ordinal").cast("string"), F.lit("_"), F.substring("sha256", 1, 8), F.lit("."), extension_of(F.col("mime")))
    return out.select(F.concat(F.lit("AR-"), F.substring("sha256", 1, 32)).alias("id"), kind_of(F.col("mime")).alias("kind"), name.alias("name"), "mime", "size", "sha256", "md5", "flow_id", "ordinal", "copies")


def save(bodies: DataFrame, folder: str) -> None:
    """Distinct bodies as rows of Parquet (sha256, body) below folder, in parts by the hash's first digit."""
    rows = bodies.where(F.octet_length("body") > 0).withColumn("sha256", F.sha2("body", 256)).dropDuplicates(["sha256"])
    rows.select("sha256", "body", F.substring("sha256", 1, 1).alias("part")).write.partitionBy("part").parquet(folder)


def _credential(df: DataFrame, kind: Column | str, user: Column | str | None, secret: Column | str, service: str, host: Column | str | None = None) -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else c if isinstance(c, Column) else F.col(c)
    own = lambda c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)
    return df.select((kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), text(user).alias("username"), text(secret).alias("secret"), F.lit(service).alias("service"), text(host).alias("host"), own("flow_id", "string"), own("request_at", "long"))


def basic_auth(header: Column) -> Column:
    """User and password, parted by a colon, of an Authorization header of kind Basic; null for others."""
    plain = F.try_to_binary(F.regexp_extract(header, r"^(?i:basic)\s+(\S+)\s*$", 1), F.lit("base64")).cast("string")
    return F.when(header.rlike(r"^(?i:basic)\s+\S"), plain)


def sightings(http: DataFrame | None = None, ftp: DataFrame | None = None, smtp: DataFrame | None = None, telnet: DataFrame | None = None, texts: DataFrame | None = None, text: str = "text") -> DataFrame:
    """id, kind, username, secret, service, host, flow_id and request_at (of HTTP) of every place where a credential stands."""
    parts: list[DataFrame] = []
    if http is not None:
        sign = F.col("request_headers")["authorization"]
        pair = basic_auth(sign)
        where = [c for c in ("flow_id", "request_at") if c in http.columns]
        known = http.select("host", sign.alias("sign"), pair.alias("pair"), "cookies", *where)
        parts.append(_credential(known.where(F.contains("pair", F.lit(":"))), "HttpBasicAuth", F.split_part("pair", F.lit(":"), F.lit(1)), F.expr("substring(pair, locate(':', pair) + 1)"), "http", "host"))
        parts.append(_credential(known.where(F.col("sign").rlike(r"^(?i:bearer)\s+\S")), "BearerToken", None, F.regexp_extract("sign", r"^(?i:bearer)\s+(\S+)", 1), "http", "host"))
        jar = known.select("host", *where, F.explode("cookies").alias("cookie")).where(F.split_part(F.lower("cookie"), F.lit("="), F.lit(1)).rlike("sess|token|auth|sid"))
        parts.append(_credential(jar, "SessionCookie", F.split_part("cookie", F.lit("="), F.lit(1)), F.expr("substring(cookie, locate('=', cookie) + 1)"), "http", "host"))
    if ftp is not None:
        parts.append(_credential(ftp.where("password is not null"), "FtpLogin", "username", "password", "ftp"))
    if smtp is not None:
        parts.append(_credential(smtp.where("password is not null"), "SmtpAuth", "username", "password", "smtp"))
    if telnet is not None:
        parts.append(_credential(telnet.select("flow_id", F.explode("logins").alias("x")).select("flow_id", "x.*"), "TelnetLogin", "username", "password", "telnet"))
    if texts is not None:
        key = "flow_id" if "flow_id" in texts.columns else "_key"
        rows = texts.select("flow_id", text) if key == "flow_id" else texts.select(F.lit(0).alias("_key"), text)
        parts.append(_credential(credentials(rows, key, text), F.col("kind"), None, "value", "text"))
    if not parts:
        raise ValueError("no records to look at")
    found = reduce(DataFrame.unionByName, parts).where(F.char_length("secret") > 0)
    return found.select(F.concat(F.lit("CR-"), F.substring(F.sha2(F.concat_ws("|", "kind", F.coalesce("username", F.lit("")), "secret", "service", F.coalesce("host", F.lit(""))), 256), 1, 32)).alias("id"), "*")


def harvest(http: DataFrame | None = None, ftp: DataFrame | None = None, smtp: DataFrame | None = None, telnet: DataFrame | None = None, texts: DataFrame | None = None, text: str = "text") -> DataFrame:
    """id, kind, username, secret, service, host: every distinct credential of the records that are given."""
    return sightings(http, ftp, smtp, telnet, texts, text).drop("flow_id", "request_at").distinct()
