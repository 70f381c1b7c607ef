"""Addresses looked up in tables of networks: the longest prefix counts.

A network table has one row a network (`203.0.113.0/24`, `2001:db8::/32`, or a single address) and any columns about it, as
the tables of countries, operators and registrations have. Both sides meet by equality of (family, length, prefix): an
address takes part once for each length that the table has, so no range is compared and no side is broadcast unless
Spark finds it small. Only distinct addresses are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwake.functions.net import ip_key


def bits(key: Column) -> Column:
    """The bits of an address's key (see ip_key) as text: 32 or 128 of them."""
    digits = F.substring(F.hex(key), 3, 32)
    word = lambda k: F.lpad(F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 2), 32, "0")
    return F.when(F.octet_length(key) == 5, word(0)).otherwise(F.concat(*map(word, range(4))))


def networks(table: DataFrame, network: str = "network") -> DataFrame:
    """family (bytes of a key), length, prefix and about (a struct of the table's columns) of each network, once.

    Of rows for one network the smallest by its columns counts. What is no network is left out.
    """
    key, given = ip_key(F.split_part(network, F.lit("/"), F.lit(1))), F.nullif(F.split_part(network, F.lit("/"), F.lit(2)), F.lit("")).try_cast("int")
    rows = table.select(key.alias("key"), given.alias("length"), F.contains(network, F.lit("/")).alias("cut"), F.struct(*table.columns).alias("about")).where(F.octet_length("key").isin(5, 17))
    most = F.when(F.octet_length("key") == 5, 32).otherwise(128)
    rows = rows.withColumn("length", F.when(F.col("cut"), F.col("length")).otherwise(most)).where(F.col("length").between(0, most))
    return rows.groupBy(F.octet_length("key").alias("family"), "length", F.substr(bits(F.col("key")), F.lit(1), F.col("length")).alias("prefix")).agg(F.min("about").alias("about"))


def looked_up(rows: DataFrame, table: DataFrame, ip: str = "ip", network: str = "network") -> DataFrame:
    """rows with `about`: the columns of the longest network that holds the address; null where none does."""
    known = networks(table, network)
    lengths = known.select("family", "length").distinct().collect()  # at most 33 and 129
    of = lambda family: F.array(*[F.lit(r["length"]) for r in lengths if r["family"] == family]).cast("array<int>")
    own = rows.select(F.col(ip).alias("ip")).where("ip is not null").distinct().withColumn("key", ip_key(F.col("ip")))
    own = own.select("ip", F.octet_length("key").alias("family"), bits(F.col("key")).alias("bits"))
    each = own.select("ip", "family", "bits", F.explode(F.when(F.col("family") == 5, of(5)).when(F.col("family") == 17, of(17))).alias("length"))
    each = each.withColumn("prefix", F.substr("bits", F.lit(1), F.col("length")))
    best = each.join(known, ["family", "length", "prefix"]).groupBy("ip").agg(F.max_by("about", "length").alias("about"))
    return rows.join(best.withColumnRenamed("ip", ip), ip, "left")
