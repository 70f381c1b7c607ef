"""TCP reassembly as joins and windows: which bytes of which packet stand where in a stream.

A direction of a conversation may be of any length, so nothing holds one whole:

1. Sequence numbers are unwrapped chunk by chunk. A chunk is a run of a file's packets that spans far less than half of
   the number space, so a packet's number is told by its distance from the chunk's first one; first ones are told by
   lag over a direction's chunks.
2. A direction starts behind its (lowest) SYN, or else at its lowest byte.
3. Segments are trimmed in cells of the stream: in order of their first byte (of two the longer one first) a segment
   keeps what lies behind the furthest byte so far, a running maximum within the cell and over the cells before.

All that runs on keys, written twice on the way so that no step is planned or computed again; intervals() is the map from stream offsets to packets. segments() fetches payloads by a join on
a packet's place, parts() puts short runs of a stream together and streams() whole directions that fit a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwake.operators.flows import PLACE, keyed, placed
from sparkwake.tables import materialize

CELL = 1 << 20
SPACE = 1 << 32
WAY = ("flow_id", "forward")


def _apart(a: Column, b: Column) -> Column:
    """a - b in sequence space, the shorter way round."""
    return F.pmod(a - b + SPACE // 2, F.lit(SPACE)) - SPACE // 2


def _unwrapped(packets: DataFrame) -> DataFrame:
    """flow_id, forward, place, ts, at (first byte's number, unwrapped), size and syn of TCP packets with a SYN or bytes."""
    syn, size = F.coalesce(F.col("flags").bitwiseAND(F.lit(2)) != 0, F.lit(False)), F.coalesce(F.octet_length("payload"), F.lit(0))
    tcp = keyed(placed(packets.where("protocol = 'tcp'")))
    rows = tcp.select(*WAY, *PLACE, "chunk", "ts", F.col("seq").cast("long").alias("seq"), size.alias("size"), syn.alias("syn")).where("size > 0 or syn")
    rows = materialize(rows, "tcp")
    chunk = [*WAY, "file_us", "path", "chunk"]
    order = Window.partitionBy(*WAY).orderBy("file_us", "path", "chunk")
    first = rows.groupBy(*chunk).agg(F.min_by("seq", "offset").alias("first"))
    step = F.coalesce(_apart(F.col("first"), F.lag("first").over(order)), F.lit(0))
    base = first.withColumn("step", step).select(*chunk, "first", F.sum("step").over(order).alias("base"))
    at = F.col("base") + _apart(F.col("seq"), F.col("first")) + F.col("syn").cast("int")
    return rows.join(base, chunk).select(*WAY, *PLACE, "ts", at.alias("at"), "size", "syn")


def intervals(packets: DataFrame) -> DataFrame:
    """flow_id, forward, at, packed, size, skip, gap, place, ts: the packets whose bytes make up each stream.

    `size` bytes of the payload behind its first `skip` stand at stream offset `at`; `gap` bytes before it are missing.
    `packed` is the offset in the bytes that are there, with nothing in place of gaps, as streams() joins them.
    Of overlapping bytes those that start earlier count, and among them the longer segment; of equal ones the first.
    """
    rows = _unwrapped(packets)
    starts = rows.groupBy(*WAY).agg(F.coalesce(F.min(F.when(F.col("syn"), F.col("at"))), F.min(F.when(F.col("size") > 0, F.col("at")))).alias("origin"))
    own = rows.where("size > 0").join(starts, list(WAY)).withColumn("at", F.col("at") - F.col("origin")).where("at + size > 0")
    cell = F.floor(F.greatest(F.col("at"), F.lit(0)) / CELL).alias("cell")
    once = own.groupBy(*WAY, cell, "at", "size").agg(F.min(F.struct(*PLACE, "ts")).alias("x")).select(*WAY, "cell", "at", "size", "x.*")
    once = materialize(once, "placed")
    end, before = F.col("at") + F.col("size"), Window.unboundedPreceding
    inner = F.max(end).over(Window.partitionBy(*WAY, "cell").orderBy("at", F.col("size").desc()).rowsBetween(before, -1))
    cells = once.groupBy(*WAY, "cell").agg(F.max(end).alias("end"))
    over = cells.select(*WAY, "cell", F.max("end").over(Window.partitionBy(*WAY).orderBy("cell").rowsBetween(before, -1)).alias("earlier"))
    reach = F.greatest(F.coalesce("inner", F.lit(0)), F.coalesce("earlier", F.lit(0)))
    start, gap = F.greatest("at", "reach"), F.greatest(F.col("at") - F.col("reach"), F.lit(0))
    kept = once.withColumn("inner", inner).join(over, [*WAY, "cell"]).withColumn("reach", reach).where(end > F.col("reach")).withColumn("gap", gap)
    lost = F.sum("gap").over(Window.partitionBy(*WAY, "cell").orderBy("at", F.col("size").desc()))
    holes = kept.groupBy(*WAY, "cell").agg(F.sum("gap").alias("holes"))
    holes = holes.select(*WAY, "cell", (F.sum("holes").over(Window.partitionBy(*WAY).orderBy("cell")) - F.col("holes")).alias("holes"))
    kept = kept.withColumn("lost", lost).join(holes, [*WAY, "cell"])
    packed = start - F.col("lost") - F.col("holes")
    return kept.select(*WAY, start.alias("at"), packed.alias("packed"), (end - start).cast("int").alias("size"), (start - F.col("at")).cast("int").alias("skip"), "gap", *PLACE, "ts")


def segments(packets: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The rows of intervals() with their bytes as data."""
    found = intervals(packets) if found is None else found
    tcp = placed(packets.where("protocol = 'tcp'")).where(F.octet_length("payload") > 0).select(*PLACE, "payload")
    return found.join(tcp, list(PLACE)).withColumn("data", F.substring("payload", F.col("skip") + 1, F.col("size"))).drop("payload")


def parts(rows: DataFrame, size: int = CELL) -> DataFrame:
    """flow_id, forward, part, at, data, gap: segments that begin within `size` bytes of a stream, put together."""
    grouped = rows.groupBy(*WAY, F.floor(F.col("at") / size).alias("part"))
    return grouped.agg(F.min("at").alias("at"), F.expr("listagg(data) WITHIN GROUP (ORDER BY at)").alias("data"), (F.max("gap") > 0).alias("gap"))


def streams(packets: DataFrame, most: int = 1 << 30, found: DataFrame | None = None, where: DataFrame | None = None) -> DataFrame:
    """flow_id, forward, data, gap, bytes of every direction with bytes.

    What stands on either side of a gap is joined. A direction of more than `most` bytes has null data: a value can't
    hold it, but its segments and parts do. where: the intervals, found: the segments, if these are at hand.

    Sizes are told by keys, so bytes are shuffled twice: to their places, and to their directions without those too large.
    """
    if found is None:
        where = materialize(intervals(packets), "intervals") if where is None else where
        found = segments(packets, where)
    sized = (found if where is None else where).groupBy(*WAY).agg(F.sum("size").alias("bytes"), (F.max("gap") > 0).alias("gap"))
    large = sized.where(F.col("bytes") > most).select(*WAY)  # as few as fit all bytes; of a small bound maybe many
    rows = parts(found.join(F.broadcast(large) if most >= CELL else large, list(WAY), "left_anti").repartition(*WAY))
    whole = rows.groupBy(*WAY).agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY part)").alias("data"))
    return sized.join(whole, list(WAY), "left").select(*WAY, "data", "gap", "bytes")


def turns(rows: DataFrame, flows: DataFrame) -> DataFrame:
    """flow_id and parts, an array of struct(server, data) of a conversation's segments in order of time."""
    own = rows.join(flows.select("flow_id", "from_lo"), "flow_id")
    said = F.array_sort(F.collect_list(F.struct(*PLACE, (F.col("forward") != F.col("from_lo")).alias("server"), "data")))
    return own.groupBy("flow_id").agg(F.transform(said, lambda x: F.struct(x["server"].alias("server"), x["data"].alias("data"))).alias("parts"))


def located(spans: DataFrame, found: DataFrame) -> DataFrame:
    """Each distinct span (flow_id, forward, start, stop: packed offsets) with the packets that its bytes came in.

    Adds path, first_offset and last_offset (of the packets' records in their files), packets and ts (of the first byte).
    Spans meet intervals cell by cell; a span whose bytes are in no packet keeps nulls.
    """
    span = [*WAY, "start", "stop"]
    own = spans.select(*span).distinct()
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / CELL), F.floor(F.greatest(high - 1, low) / CELL))).alias("cell")
    theirs = found.select(*WAY, "packed", "size", *PLACE, "ts", cells(F.col("packed"), F.col("packed") + F.col("size")))
    met = own.select(*span, cells(F.col("start"), F.col("stop"))).join(theirs, [*WAY, "cell"]).where("packed < stop and packed + size > start")
    told = met.groupBy(*span).agg(F.min(F.struct("packed", "path", "offset", "ts")).alias("a"), F.max(F.struct("packed", "offset")).alias("b"), F.countDistinct(*PLACE).alias("packets"))
    told = told.select(*span, "a.path", F.col("a.offset").alias("first_offset"), F.col("b.offset").alias("last_offset"), "packets", "a.ts")
    return own.join(told, span, "left")


def timed(records: DataFrame, at: Column, from_client: Column, flows: DataFrame, found: DataFrame) -> DataFrame:
    """records with stream_id, and ts, path and offset of the packet that holds packed offset `at` of one side's stream."""
    rows = records.drop("ts", "path", "offset").join(flows.select("flow_id", "from_lo"), "flow_id", "left")
    rows = rows.withColumns({"start": at.cast("long"), "forward": F.coalesce(from_client == F.col("from_lo"), F.lit(True))})
    spans = rows.where("start is not null").select(*WAY, "start", (F.col("start") + 1).alias("stop"))
    told = located(spans, found).select(*WAY, "start", "ts", "path", F.col("first_offset").alias("offset"))
    return rows.join(told, [*WAY, "start"], "left").drop("from_lo", "start", "forward").withColumns({"stream_id": stream_id(), "ts_us": F.unix_micros(F.col("ts").cast("timestamp"))})


def stream_id() -> Column:
    return F.concat(F.lit("ST-"), F.substring("flow_id", 4, 1 << 20))
