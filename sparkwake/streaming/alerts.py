"""Alerts on streams: rows whose text matches patterns; captures as streams, recording and progress."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from sparkwake.sources import capture


def alerts(stream: DataFrame, patterns: list[str], text: str = "text") -> DataFrame:
    """A row per row and pattern it matches; stateless, for batches and streams alike."""
    hit = F.filter(F.array(*[F.when(F.col(text).rlike(p), F.lit(p)) for p in patterns]), lambda p: p.isNotNull())
    return stream.select("*", F.explode(hit).alias("pattern"))


def drain(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there and returns what it wrote, for tests and batch replays."""
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def captures(spark: SparkSession, folder: str, where: str | None = None, **options) -> DataFrame:
    """Packets of the captures in a folder, as they grow and as more come, as a stream; with a predicate only those.

    Options: max_bytes (of a batch) and max_packets (in all).
    """
    packets = capture.stream_capture(spark, folder, **options)
    return packets.where(where) if where else packets


def packet_alerts(packets: DataFrame, patterns: list[str]) -> DataFrame:
    """A row per packet whose payload is UTF-8 text and pattern that it matches; patterns that are none are passed over."""
    good = []
    for p in patterns:
        try:
            re.compile(p)
            good.append(p)
        except re.error:
            continue
    text = F.col("payload").cast("string")
    rows = packets.where(F.is_valid_utf8(text)).withColumn("text", text)
    return alerts(rows, good) if good else rows.withColumn("pattern", F.lit(None).cast("string")).limit(0)


def record(stream: DataFrame, folder: str, checkpoint: str, seconds: float | None = None) -> None:
    """Appends a stream to Parquet below folder, for batch analysis: what is there, or as it comes for some seconds."""
    writer = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    q = (writer.trigger(availableNow=True) if seconds is None else writer).start()
    q.awaitTermination(None if seconds is None else seconds)
    if q.isActive:
        q.stop()


class Progress(StreamingQueryListener):
    """Counts the rows that the session's streams have taken in; `told` gets (rows in all, rows of the batch)."""

    def __init__(self, told=None):
        self.rows, self.told = 0, told

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        if self.told:
            self.told(self.rows, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
