"""A case's tables as JSON lines, CSV, HTML and STIX 2.1, all as DataFrames of lines, and their schema."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.simpleString()
    value = F.to_json(name) if kind.startswith(("array", "map", "struct")) else F.base64(name) if kind == "binary" else F.col(name).cast("string")
    return F.coalesce(value, F.lit(""))


def html_rows(df: DataFrame, limit: int | None = None) -> DataFrame:
    """A table row of HTML for each row of df, or for `limit` of them."""
    cells = [F.concat(F.lit("<td>"), escaped(_text(df, c)), F.lit("</td>")) for c in df.columns]
    return (df if limit is None else df.limit(limit)).select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"))


def html_page(spark: SparkSession, title: str, tables: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """part, line: a page with a table for each DataFrame, in order of part."""
    plain = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    line = lambda part, html: spark.createDataFrame([(part, html)], "part int, line string")
    out = line(0, f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{plain(title)}</title></head><body><h1>{plain(title)}</h1>")
    for k, (name, df) in enumerate(tables.items()):
        head = "".join(f"<th>{plain(c)}</th>" for c in df.columns)
        out = out.unionByName(line(3 * k + 1, f"<h2>{plain(name)}</h2><table><tr>{head}</tr>")).unionByName(html_rows(df, limit).select(F.lit(3 * k + 2).alias("part"), F.col("html").alias("line"))).unionByName(line(3 * k + 3, "</table>"))
    return out.unionByName(line(3 * len(tables) + 1, "</body></html>"))


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def csv_lines(df: DataFrame) -> DataFrame:
    """line: values quoted where they hold a comma, a quote or a line break."""
    quoted = lambda t: F.when(t.rlike("[,\"\r\n]"), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)
    return df.select(F.concat_ws(",", *[quoted(_text(df, c)) for c in df.columns]).alias("line"))


def table_lines(df: DataFrame, width: int = 40) -> DataFrame:
    """line: values in columns of equal width, longer ones cut."""
    return df.select(F.concat_ws("  ", *[F.rpad(_text(df, c), width, " ") for c in df.columns]).alias("line"))


FORMATS = {"json": json_lines, "csv": csv_lines, "table": table_lines}


def schema_table(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """table, name, type (JSON) and nullable of each column."""
    rows = [(t, f.name, json.dumps(f.dataType.jsonValue()), f.nullable) for t, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table string, name string, type string, nullable boolean")


def _uuid(*key: Column) -> Column:
    """A version 5 like UUID of the content."""
    h = F.sha2(F.concat_ws("|", *key), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def stix(findings: DataFrame) -> DataFrame:
    """A STIX 2.1 indicator for each finding (rule, subject, severity, confidence), as JSON; ids follow the content.

    Category and techniques become labels and references where the findings have them.
    """
    has = set(findings.columns)
    labels = F.array("severity", "rule", *(["category"] if "category" in has else []))
    extra = [F.transform("attack", lambda t: F.struct(F.lit("mitre-attack").alias("source_name"), t.alias("external_id"))).alias("external_references")] if "attack" in has else []
    body = F.struct(F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), F.concat(F.lit("indicator--"), _uuid(F.col("rule"), F.col("subject"))).alias("id"), F.col("rule").alias("name"), F.col("subject").alias("description"), F.round(F.col("confidence") * 100).cast("int").alias("confidence"), labels.alias("labels"), *extra)
    return findings.select(F.to_json(body).alias("json"))


def stix_bundle(findings: DataFrame, credentials: DataFrame, name: str = "sparkwake") -> DataFrame:
    """part, line: a bundle of an identity, an indicator per finding and observed data per credential (without secrets)."""
    spark = findings.sparkSession
    one = spark.range(1)
    identity = one.select(F.to_json(F.struct(F.lit("identity").alias("type"), F.lit("2.1").alias("spec_version"), F.concat(F.lit("identity--"), _uuid(F.lit(name))).alias("id"), F.lit(name).alias("name"), F.lit("system").alias("identity_class"))).alias("json"))
    seen = credentials.select(F.to_json(F.struct(F.lit("observed-data").alias("type"), F.lit("2.1").alias("spec_version"), F.concat(F.lit("observed-data--"), _uuid(F.col("id"))).alias("id"), F.lit(1).alias("number_observed"), F.col("kind").alias("x_credential_kind"), F.col("username").alias("x_username"), F.col("service").alias("x_service"))).alias("json"))
    objects = [x.select(F.lit(2 * k + 1).alias("part"), F.concat(F.lit(","), "json").alias("line")) for k, x in enumerate((stix(findings), seen), 1)]
    head = identity.select(F.lit(0).alias("part"), F.concat(F.lit('{"type":"bundle","id":"bundle--'), _uuid(F.lit(name), F.lit("bundle")), F.lit('","objects":['), "json").alias("line"))
    tail = one.select(F.lit(9).alias("part"), F.lit("]}").alias("line"))
    return head.unionByName(objects[0]).unionByName(objects[1]).unionByName(tail)
