"""Packets to flows, and segments of conversations.

Packets of one file are in the file's order, and files follow each other by the time of their first record: a packet's
place is (file_us, path, offset). Rows without these columns come from one file and are placed by `index`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwake.functions.net import address_text, application, ip_key

PLACE = ("file_us", "path", "offset")
#: Bytes of a file (or packets, where there is only an index) that make up a chunk, the unit of two-step windows.
CHUNK_BYTES, CHUNK_PACKETS = 1 << 20, 1024


def placed(packets: DataFrame) -> DataFrame:
    """packets with all columns of PLACE, and chunk: a short run of a file's packets."""
    known = "offset" in packets.columns
    width, at = (CHUNK_BYTES, F.col("offset")) if known else (CHUNK_PACKETS, F.col("index").cast("long"))
    missing = {"file_us": F.lit(0).cast("long"), "path": F.lit(""), "ts": F.lit(None).cast("timestamp")}
    rows = packets.withColumns({k: v for k, v in missing.items() if k not in packets.columns}).withColumn("offset", at)
    return rows.withColumn("file_us", F.coalesce("file_us", F.lit(0))).withColumn("chunk", F.floor(F.col("offset") / width))


def place() -> Column:
    return F.struct(*PLACE)


def keyed(packets: DataFrame) -> DataFrame:
    """packets with the canonical endpoints (lo_ip, lo_port, hi_ip, hi_port), forward and a deterministic flow_id.

    Addresses in different spellings are one endpoint.
    """
    ends = packets.withColumns({"src_key": ip_key(F.col("src_ip")), "dst_key": ip_key(F.col("dst_ip"))})
    ends = ends.withColumn("forward", F.struct("src_key", "src_port") <= F.struct("dst_key", "dst_port"))
    pick = lambda a, b: F.when(F.col("forward"), a).otherwise(b)
    names = {f"{end}_text": address_text(F.col(f"{end}_ip"), F.col(f"{end}_key")) for end in ("src", "dst")}
    cross = {f"lo_{c}": pick(F.col(f"src_{c}"), F.col(f"dst_{c}")) for c in ("ip", "port", "text")} | {f"hi_{c}": pick(F.col(f"dst_{c}"), F.col(f"src_{c}")) for c in ("ip", "port", "text")}
    rows = ends.withColumns(names).withColumns(cross)
    named = F.concat_ws("|", "protocol", "lo_text", "lo_port", "hi_text", "hi_port")
    rows = rows.withColumn("flow_id", F.concat(F.lit("FL-"), F.substring(F.sha2(named, 256), 1, 32)))
    return rows.drop("src_key", "dst_key", "src_text", "dst_text", "lo_text", "hi_text")


def parted(rows: DataFrame, timeout: str) -> DataFrame:
    """Keyed and placed rows with flow_id parted where a flow was silent for longer than timeout.

    Silences are counted within chunks first and then between them, so no task sees all packets of a long flow.
    """
    chunk = ["flow_id", "file_us", "path", "chunk"]
    long = lambda before: F.coalesce((F.col("ts").cast("timestamp") > before + F.expr(f"INTERVAL {timeout}")).cast("int"), F.lit(0))
    inside = Window.partitionBy(*chunk).orderBy("offset")
    rows = rows.withColumn("gap", long(F.lag("ts").over(inside).cast("timestamp"))).withColumn("part", F.sum("gap").over(inside))
    each = rows.groupBy(*chunk).agg(F.min_by("ts", "offset").alias("ts"), F.max_by("ts", "offset").alias("last"), F.sum("gap").alias("gaps"))
    order = Window.partitionBy("flow_id").orderBy("file_us", "path", "chunk")
    each = each.withColumn("here", long(F.lag("last").over(order).cast("timestamp")))
    ahead = F.sum("here").over(order) + F.sum("gaps").over(order) - F.col("gaps")
    rows = rows.join(each.select(*chunk, ahead.alias("ahead")), chunk)
    return rows.withColumn("flow_id", F.concat_ws("-", "flow_id", F.col("part") + F.col("ahead"))).drop("gap", "part", "ahead")


def _summed(grouped) -> DataFrame:
    """The columns of a flow from its packets, for batches and streams alike."""
    syn = F.coalesce(F.col("flags").bitwiseAND(F.lit(0x12)) == 0x02, F.lit(False))
    answer = F.coalesce(F.col("flags").bitwiseAND(F.lit(0x12)) == 0x12, F.lit(False))
    data, at, forward = F.length("payload") > 0, place(), F.col("forward")
    first = lambda which: F.min(F.when(which, F.struct(*PLACE, "forward")))
    side = lambda which, what: F.sum(F.when(which, what).otherwise(0))
    out = grouped.agg(
        F.min("lo_ip").alias("lo_ip"), F.min("hi_ip").alias("hi_ip"), F.min_by("ts", at).alias("start"), F.max_by("ts", at).alias("last"),
        F.count_if("forward").alias("fwd_packets"), F.count_if(~forward).alias("rev_packets"), side(forward, F.col("caplen")).alias("fwd_bytes"), side(~forward, F.col("caplen")).alias("rev_bytes"),
        F.count_if(syn).alias("syns"), first(syn).alias("syn"), first(data & ~syn).alias("data"), first(answer).alias("answer"), first(F.lit(True)).alias("any"),
    )
    began = F.col("syn").isNotNull() & (F.col("data").isNull() | (F.col("syn") < F.col("data")))
    out = out.withColumn("client_forward", F.when(began, F.col("syn.forward")).otherwise(F.coalesce("data.forward", "syn.forward")))
    out = out.withColumn("from_lo", F.coalesce("client_forward", ~F.col("answer.forward"), F.col("any.forward")))
    out = out.withColumn("app", application(F.col("protocol"), F.col("lo_port"), F.col("hi_port")))
    duration = F.abs(F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp")))
    return out.withColumn("duration_us", duration).withColumn("incomplete", (F.col("protocol") == "tcp") & (F.col("syns") == 0)).drop("syn", "data", "answer", "any")


FLOW = ("flow_id", "protocol", "lo_port", "hi_port")


def flows(packets: DataFrame, timeout: str | None = None) -> DataFrame:
    """One row per conversation (canonical endpoints and transport); with a timeout a silence parts a conversation.

    The first and last packets are those in order of place, over all files. Counts and bytes are per direction: forward
    is from the lower endpoint. The client is the sender of a SYN before any data, else of the first data; null if
    there is neither.
    """
    rows = keyed(placed(packets))
    return _summed((parted(rows, timeout) if timeout else rows).groupBy(*FLOW))


def flow_stream(packets: DataFrame, silence: str = "120 seconds", late: str = "10 minutes") -> DataFrame:
    """The same over a stream of packets: a conversation comes out once it was silent for `silence`, with all its columns.

    A session of event time is the state: one row of sums for each open conversation, dropped when the watermark (`late`
    behind the latest packet) passes its end. Packets later than that are left out. flow_id ends in the session's start.
    """
    rows = keyed(placed(packets.withColumn("ts", F.col("ts").cast("timestamp")))).withWatermark("ts", late)
    out = _summed(rows.groupBy(F.session_window("ts", silence).alias("session"), *FLOW))
    return out.withColumn("flow_id", F.concat_ws("-", "flow_id", F.unix_micros("session.start"))).drop("session")


def oriented(found: DataFrame) -> DataFrame:
    """Flows with roles beside the canonical endpoints: client and server address and port, packets and bytes each way.

    Where neither SYN nor data tells the client, the receiver of a SYN with ACK is, else the sender of the first packet.
    """
    pick = lambda a, b: F.when(F.col("from_lo"), F.col(a)).otherwise(F.col(b))
    roles = {"client_ip": pick("lo_ip", "hi_ip"), "client_port": pick("lo_port", "hi_port"), "server_ip": pick("hi_ip", "lo_ip"), "server_port": pick("hi_port", "lo_port")}
    ways = {f"{way}_{what}": pick(f"{a}_{what}", f"{b}_{what}") for what in ("packets", "bytes") for way, a, b in (("c2s", "fwd", "rev"), ("s2c", "rev", "fwd"))}
    return found.withColumns(roles | ways)


def datagrams(packets: DataFrame) -> DataFrame:
    """flow_id, seq_no, direction, data, ts of UDP and ICMP payloads, numbered in order of place.

    Numbers are counted within chunks and then over them. The lower endpoint counts as the client.
    """
    rows = keyed(placed(packets.where(F.col("protocol").isin("udp", "icmp") & (F.length("payload") > 0))))
    chunk = ["flow_id", "file_us", "path", "chunk"]
    each = rows.groupBy(*chunk).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("flow_id").orderBy("file_us", "path", "chunk")
    each = each.select(*chunk, (F.sum("n").over(order) - F.col("n")).alias("ahead"))
    rows = rows.join(each, chunk)
    seq = F.row_number().over(Window.partitionBy(*chunk).orderBy("offset")) + F.col("ahead")
    way = F.when(F.col("protocol") == "icmp", "Unknown").when(F.col("forward"), "ClientToServer").otherwise("ServerToClient")
    return rows.select("flow_id", seq.cast("int").alias("seq_no"), way.alias("direction"), F.col("payload").alias("data"), "ts")
