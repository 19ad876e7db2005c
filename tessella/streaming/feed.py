"""Streams: the trace feed, alerts ahead of reports, windowed counts.

The feed and the two queries over the merged stream mirror the progress stream of single runs; watermarks and windows are
this engine's addition for the `events` feed. Results of a drained stream equal those of the batch query.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.findings import triage

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str, files_at_once: int = 4) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def counts(stream: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by window and type; rows later than the watermark are dropped."""
    at = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return at.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def frames(kind: str, stream: DataFrame) -> DataFrame:
    """Server-sent event frames: event and data lines."""
    return stream.select(F.concat(F.lit(f"event: {kind}\ndata: "), F.to_json(F.struct("*")), F.lit("\n\n")).alias("frame"))


def serve(stream: DataFrame, study_id: str, send: Callable[[str], None], checkpoint: str, order: str = "ts") -> None:
    """Sends the frames of one study's run to a client: start, a node frame for each event in its order, complete. A run is a handful of rows."""
    frame = lambda kind, body: f"event: {kind}\ndata: {json.dumps(body, ensure_ascii=False)}\n\n"
    send(frame("start", {"study_id": study_id}))
    sent = 0

    def batch(df: DataFrame, n: int) -> None:
        nonlocal sent
        for r in frames("node", df.orderBy(order)).toLocalIterator():
            send(r["frame"])
            sent += 1

    drain(stream.where(F.col("study_id") == study_id).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint))
    send(frame("complete", {"study_id": study_id, "nodes": sent}))


def alerts_first(findings: DataFrame, on_alert: Callable[[DataFrame, int], None], on_report: Callable[[DataFrame, int], None], checkpoint: str):
    """A streaming query whose batches are triaged, and handed on, before anything is reported from them."""

    def batch(df: DataFrame, n: int) -> None:
        df.persist()
        try:
            on_alert(triage(df), n)
            on_report(df, n)
        finally:
            df.unpersist()

    return findings.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def append(stream: DataFrame, path: str, checkpoint: str):
    """Incremental writes: what an interrupted run has written stays, and a restart goes on behind it."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)


def drain(query) -> None:
    """Runs a started-to-be query over what is there, then ends it."""
    query.trigger(availableNow=True).start().awaitTermination()
