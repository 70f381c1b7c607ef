"""The bytes of streams are shuffled to their places and to their directions, and no further time."""

from sparkwake.operators import reassembly


def test_bytes_are_shuffled_twice(spark):
    rows = [("10.0.0.1", "203.0.113.1", 40000, 80, "tcp", k, 100 + 4 * k, 24, bytes([65 + k]) * 4) for k in range(5) if k != 3]
    packets = spark.createDataFrame(rows, "src_ip string, dst_ip string, src_port int, dst_port int, protocol string, index long, seq long, flags int, payload binary")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = reassembly.streams(packets)
        plan = found._jdf.queryExecution().executedPlan().toString()
        joining = plan[plan.index("listagg(") : plan.rindex("partial_listagg(")]
        assert plan.count("Scan ExistingRDD") == 1 and "Exchange" not in joining, plan
        for most, data in ((1 << 30, b"AAAABBBBCCCCEEEE"), (16, b"AAAABBBBCCCCEEEE"), (15, None)):
            (r,) = reassembly.streams(packets, most).collect()
            assert (r.data and bytes(r.data), r.gap, r.bytes) == (data, True, 16)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
