"""Sinks for streaming queries: JSON frames in files, any callable, nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from pelagia.functions import rules

Sink = Callable[[DataFrame, int], None]


def discard(batch: DataFrame, number: int) -> None:
    """Compute a batch and drop it: what a benchmark writes to."""
    batch.write.format("noop").mode("overwrite").save()


def frames(path: str) -> Sink:
    """Alert envelopes as JSON lines, a folder per batch, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        envelope = F.to_json(F.struct(F.lit("alert").alias("type"), F.struct(*batch.columns).alias("alert"))).alias("value")
        batch.select(envelope).write.mode("overwrite").text(f"{path}/batch={number}")

    return write


def start(stream: DataFrame, sink: Sink, checkpoint: str, seconds: float | None = None) -> StreamingQuery:
    """Run a stream into a sink; all that is there now if no trigger interval is given."""
    writer: DataStreamWriter = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
    return writer.start()


def counted(fixes: DataFrame, name: str = "fixes") -> DataFrame:
    """fixes with counters that each micro-batch reports: rows and, of those, rows behind the newest by a minute and more."""
    late = F.col("ts_ms") < F.unix_millis(F.current_timestamp()) - 60_000
    return fixes.observe(name, F.count(F.lit(1)).alias("ingested"), F.count_if(late).alias("late"))


def per_second(fixes: DataFrame, delay: str = "1 second") -> DataFrame:
    """start, n: fixes of each second of event time."""
    timed = fixes.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", "1 second").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def cooled(alerts: DataFrame, seconds: int = 20) -> DataFrame:
    """One alert per vessel and kind code within a watermark of ``seconds``: the feed's cooldown as streaming state."""
    timed = alerts.withColumn("at", F.timestamp_millis("at_ms")).withColumn("code", rules.feed_code("kind")).withWatermark("at", f"{seconds} seconds")
    return timed.dropDuplicatesWithinWatermark(["mmsi", "code"]).drop("at", "code")
