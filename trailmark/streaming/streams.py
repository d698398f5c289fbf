"""Structured Streaming forms of ingest, sessionisation and quality counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailmark.functions.cutting import cut
from trailmark.operators.contract import judged
from trailmark.operators.ingest import insert
from trailmark.operators.sessions import missing

LATENESS = "1 hour"


def ingest(events: DataFrame, store: str, checkpoint: str, lateness: str = LATENESS) -> StreamingQuery:
    """Accepted canonical events of a stream into the store, each id once (T1). Repetitions within
    the lateness bound stop at the stream's state, later ones at the store."""
    once = events.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(["event_id"])

    def add(batch: DataFrame, _: int) -> None:
        insert(batch, store)

    return once.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, timeout: str, lateness: str = LATENESS) -> DataFrame:
    """Sessions of a stream, or of a table: start, last event, events, path with repetitions
    collapsed (T2). A stream emits a session once the watermark is past its end; filter on the
    window only after the sink."""
    rows = events.where(~missing("session_id") & ~missing("screen_id"))
    if events.isStreaming:
        rows = rows.withWatermark("timestamp", lateness)
    step = F.struct("timestamp", "event_id", "screen_id")
    grouped = rows.groupBy("app_id", "session_id", F.session_window("timestamp", timeout).alias("w")).agg(F.min("timestamp").alias("started"), F.max("timestamp").alias("ended"), F.count("*").alias("n_events"), F.array_sort(F.collect_list(step)).alias("steps"))
    walked = F.transform("steps", lambda x: x["screen_id"])
    path = F.filter(F.transform(walked, lambda s, i: F.when((i == 0) | (F.get(walked, i - 1) != s), s)), lambda s: s.isNotNull())
    return grouped.select("app_id", "session_id", "started", "ended", "n_events", path.alias("path"))


def counters(events: DataFrame, width: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Quality counters of each tumbling window."""
    rows = events.withWatermark("timestamp", lateness) if events.isStreaming else events
    grouped = rows.groupBy("app_id", F.window("timestamp", width).alias("w")).agg(F.count("*").alias("n_events"), F.count_if(missing("session_id")).alias("no_session"), F.count_if(missing("screen_id")).alias("no_screen"), F.count_if(F.col("event_name") == "error").alias("n_errors"))
    return grouped.select("app_id", F.col("w.start").alias("window_start"), "n_events", "no_session", "no_screen", "n_errors")


def conformance(events: DataFrame, plan_events: DataFrame, plan_properties: DataFrame, width: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Events and offending ones of each tumbling window, and how they offend (T3 with Q5). The
    plan's tables are static and joined to the stream by event; they are written once, so that no
    batch of the stream finds them again, or by the size of what they were read off."""
    rows = judged(events, cut(plan_events, "plan-events"), cut(plan_properties, "plan-properties"))
    rows = rows.withWatermark("timestamp", lateness) if events.isStreaming else rows
    of = lambda kind: F.count_if(F.exists("violations", lambda v: v["violation"] == kind)).alias(f"n_{kind}")
    kinds = ("unknown_event", "wrong_screen", "missing_property", "type_mismatch")
    grouped = rows.groupBy("app_id", F.window("timestamp", width).alias("w")).agg(F.count("*").alias("n_events"), F.count_if(F.size("violations") > 0).alias("n_offending"), *map(of, kinds))
    return grouped.select("app_id", F.col("w.start").alias("window_start"), "n_events", "n_offending", *[f"n_{k}" for k in kinds])


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now, into a table."""
    if mode == "append":
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return

    def replace(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    write: Callable = df.writeStream.outputMode("update").foreachBatch(replace)
    write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
