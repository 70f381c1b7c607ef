"""The test tables hold no packets; these views give flow and name operators rows of the same shape.

They show that operators are right, not what real traffic looks like. Each view comes as a DataFrame and as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwake.functions.net import application


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as flows: one in fifty is scheduled every 250 s to a host of its own, and sends fifty times as much."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    slot = F.col("event_id") % 50 == 0
    kind = lambda **x: F.coalesce(*[F.when(F.col("event_type") == k, v if not isinstance(v, (str, int)) else F.lit(v)) for k, v in x.items()])
    inner = F.concat(F.lit("10.9."), (F.col("event_id") % 4).cast("string"), F.lit(".1"))
    admin = F.when(F.col("event_id") % 3 == 0, 445).when(F.col("event_id") % 3 == 1, 3389).otherwise(22)
    dst = F.when(slot, "198.51.100.77").otherwise(kind(view="203.0.113.10", click="198.51.100.20", purchase="203.0.113.30", signup="192.0.2.40", error=inner))
    port = F.when(slot, 443).otherwise(kind(view=443, click=80, purchase=21, signup=4444, error=admin))
    sized = F.floor(F.coalesce("value", F.lit(0.0)) * 100).cast("long") * F.when(slot, 50).otherwise(1)
    src = F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 256).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"))
    ts = F.when(slot, 1704067200000000 + F.col("event_id") * 5_000_000).otherwise(F.unix_micros(F.col("ts").cast("timestamp")))
    out = e.select(F.col("event_id").alias("flow_id"), src.alias("src_ip"), dst.alias("dst_ip"), (40000 + F.col("event_id") % 1000).cast("int").alias("src_port"), port.cast("int").alias("dst_port"), F.lit("tcp").alias("protocol"), ts.cast("long").alias("ts_us"), sized.alias("fwd_bytes"), ((F.col("event_id") % 7) * 100).cast("long").alias("rev_bytes"), ((F.col("event_id") % 5) * 1_000_000).cast("long").alias("duration_us"))
    return out.withColumn("app", application(F.col("protocol"), F.col("src_port"), F.col("dst_port")))


FLOWS = """flows AS (SELECT *, CASE least(src_port, dst_port) WHEN 443 THEN 'Tls' WHEN 80 THEN 'Http' WHEN 21 THEN 'Ftp' WHEN 445 THEN 'Smb' WHEN 22 THEN 'Ssh' END AS app FROM (
SELECT event_id AS flow_id, '10.0.' || (user_id // 256)::varchar || '.' || (user_id % 256)::varchar AS src_ip,
CASE WHEN event_id % 50 = 0 THEN '198.51.100.77' WHEN event_type = 'view' THEN '203.0.113.10' WHEN event_type = 'click' THEN '198.51.100.20' WHEN event_type = 'purchase' THEN '203.0.113.30' WHEN event_type = 'signup' THEN '192.0.2.40' WHEN event_type = 'error' THEN '10.9.' || (event_id % 4)::varchar || '.1' END AS dst_ip,
(40000 + event_id % 1000)::int AS src_port,
(CASE WHEN event_id % 50 = 0 THEN 443 WHEN event_type = 'view' THEN 443 WHEN event_type = 'click' THEN 80 WHEN event_type = 'purchase' THEN 21 WHEN event_type = 'signup' THEN 4444 WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 445 WHEN 1 THEN 3389 ELSE 22 END END)::int AS dst_port,
'tcp' AS protocol, (CASE WHEN event_id % 50 = 0 THEN 1704067200000000 + event_id * 5000000 ELSE epoch_us(ts) END)::bigint AS ts_us,
floor(coalesce(value, 0.0) * 100)::bigint * CASE WHEN event_id % 50 = 0 THEN 50 ELSE 1 END AS fwd_bytes, ((event_id % 7) * 100)::bigint AS rev_bytes, ((event_id % 5) * 1000000)::bigint AS duration_us FROM events))"""

#: In SQL: whether an address of the view is external.
OUTSIDE = "(NOT ({0} LIKE '10.%' OR {0} LIKE '192.168.%' OR {0} LIKE '127.%'))"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as DNS records: names by user and type, answers by event, failures for errors."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    ok = F.col("event_type") != "error"
    name = F.concat(F.lit("h"), (F.col("event_id") % 3).cast("string"), F.lit("."), F.col("event_type"), (F.col("user_id") % 20).cast("string"), F.lit(".example"))
    return e.select("event_id", name.alias("name"), F.lit("A").alias("type"), F.when(ok, 0).otherwise(3).alias("rcode"), F.when(ok, F.concat(F.lit("192.0.2."), (F.col("event_id") % (F.col("user_id") % 9 + 1)).cast("string"))).alias("data"))


NAMES = """names AS (SELECT event_id, 'h' || (event_id % 3)::varchar || '.' || event_type || (user_id % 20)::varchar || '.example' AS name, event_type || (user_id % 20)::varchar || '.example' AS root,
CASE WHEN event_type <> 'error' THEN 0 ELSE 3 END AS rcode, CASE WHEN event_type <> 'error' THEN '192.0.2.' || (event_id % (user_id % 9 + 1))::varchar END AS data FROM events)"""
