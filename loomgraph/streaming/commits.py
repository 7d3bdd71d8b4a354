"""Governed commits and event windows as streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import governance
from ..sources.sinks import append_edges

IDEMPOTENT = ("chunk", "content_sha256", "policy_id", "run_id")


def once(proposals: DataFrame, time: str, late: str = "1 day", key: Sequence[str] = IDEMPOTENT) -> DataFrame:
    """A stream of proposals without repeated deliveries of a key within the watermark."""
    return proposals.withWatermark(time, late).dropDuplicatesWithinWatermark([*key, "filer", "relation", "target"])


def commit_stream(proposals: DataFrame, policies: Sequence[governance.EdgePolicy], edges: str, audits: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Audit every proposal of a stream and append the committed ones to the edge store.

    Both tables are written by batch number, so a batch that is run again after a failure replaces what it wrote.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        audited = governance.audit_edges(df, policies).persist()
        try:
            audited.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{audits}/epoch={epoch}")
            record = F.struct("chunk", "span", "route", "confidence", "extractor").alias("provenance")
            done = audited.filter("committed").select(F.col("filer").alias("head"), "relation", F.col("target").alias("tail"), record)
            done.write.mode("overwrite").parquet(f"{edges}/epoch={epoch}")
        finally:
            audited.unpersist()

    w = proposals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def event_windows(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their values by type in tumbling windows, with late data up to the watermark; batch or stream."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", time: str = "ts", user: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: events closer than the gap; batch or stream."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


__all__ = ["append_edges", "commit_stream", "event_windows", "once", "sessions"]
