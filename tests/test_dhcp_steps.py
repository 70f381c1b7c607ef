"""The walk over DHCP options reads numbers only where an option stands."""

from sparkwake.operators import dissect


def test_steps_read_few_numbers(spark):
    head = bytes([2, 1, 6]) + bytes(233) + b"\x63\x82\x53\x63"
    tails = {"a": b"\x00\x00\x35\x01\x02\xff\x35\x01\x01", "b": b"\x35\x01\x03\x0c\x02hi", "c": b"\x35\x01\x05\x0c\x09hi", "d": b"\x35\x01\x01\x0c", "e": b"\xff" + bytes(300), "f": b""}
    found = dissect.dhcp_leases(spark.createDataFrame([(k, head + t) for k, t in tails.items()], "flow_id string, data binary"))
    assert {r.flow_id: (r.message, r.hostname) for r in found.collect()} == {"a": ("Offer", None), "b": ("Request", "hi"), "c": ("Ack", "hi"), "d": ("Discover", None), "e": (None, None), "f": (None, None)}
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    (walk,) = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "aggregate(" in x]
    assert walk.count("conv(") <= 3
