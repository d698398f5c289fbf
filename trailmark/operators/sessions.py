"""Sessionisation: events to steps to traces (M1 to M5).

Everything partitions by (app_id, session_id) or finer, so one exchange serves all windows.
A session of very many events (a bot) would be one task; ``bucket_s`` cuts sessions into stretches of
time, each a window of its own, which take over what the stretches before them end with. With
``most``, only sessions beyond that many events are cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TIMEOUT_S = 30 * 60
SESSION = ("app_id", "session_id")


def missing(name: str):
    """Null or empty."""
    return F.coalesce(F.col(name), F.lit("")) == ""


def usable_events(events: DataFrame) -> DataFrame:
    return events.where(~missing("session_id") & ~missing("screen_id"))


def exclusions(events: DataFrame) -> DataFrame:
    """Events without a session, and of the others those without a screen."""
    return events.groupBy("app_id").agg(
        F.count("*").alias("n_events"),
        F.count_if(missing("session_id")).alias("no_session"),
        F.count_if(~missing("session_id") & missing("screen_id")).alias("no_screen"),
    )


def split_bots(events: DataFrame, most: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Events of sessions up to ``most`` events, and the sessions beyond with their counts."""
    bots = events.groupBy(*SESSION).agg(F.count("*").alias("n_events")).where(F.col("n_events") > most)
    return events.join(bots.select(*SESSION), list(SESSION), "left_anti"), bots


def segmented(events: DataFrame, timeout_s: int = TIMEOUT_S) -> DataFrame:
    """Usable events with ``segment`` (0, 1, ...) and ``trace_id``; a gap longer than the timeout splits."""
    by_time = W.partitionBy(*SESSION).orderBy("timestamp", "event_id")
    gap = F.unix_micros("timestamp") - F.unix_micros(F.lag("timestamp").over(by_time))
    opens = F.coalesce(gap > timeout_s * 1_000_000, F.lit(False)).cast("int")
    flagged = usable_events(events).withColumn("__opens", opens)
    segment = F.sum("__opens").over(by_time.rowsBetween(W.unboundedPreceding, 0))
    numbered = flagged.withColumn("segment", segment).drop("__opens")
    suffix = F.when(F.col("segment") > 0, F.concat(F.lit("#"), F.col("segment").cast("string"))).otherwise("")
    return numbered.withColumn("trace_id", F.concat("session_id", suffix))


def _in_stretches(events: DataFrame, timeout_s: int, collapse: bool, bucket_s: int) -> DataFrame:
    """``stepped``, with windows over stretches of ``bucket_s`` seconds of a session."""
    order, key = ("timestamp", "event_id"), [*SESSION, "__stretch"]
    rows = usable_events(events).withColumn("__stretch", F.floor(F.unix_micros("timestamp") / F.lit(1_000_000 * bucket_s)))
    here, stretches = W.partitionBy(*key).orderBy(*order), W.partitionBy(*SESSION).orderBy("__stretch")
    last = F.struct("timestamp", "screen_id")
    ends = rows.groupBy(*key).agg(F.max_by(last, F.struct(*order)).alias("__end")).withColumn("__end", F.lag("__end").over(stretches))
    rows = rows.withColumn("__before", F.lag(last).over(here)).join(ends, key).withColumn("__before", F.coalesce("__before", "__end")).drop("__end")
    gap = F.unix_micros("timestamp") - F.unix_micros("__before.timestamp")
    opens = F.coalesce(gap > timeout_s * 1_000_000, F.lit(False))
    moved = F.col("__before").isNotNull() & ~F.col("__opens") & ((F.col("screen_id") != F.col("__before.screen_id")) if collapse else F.lit(True))
    rows = rows.withColumn("__opens", opens).withColumn("__moved", moved.cast("int")).withColumn("__opens", F.col("__opens").cast("int"))
    # Running sums within a stretch, on top of those of the stretches before it.
    so_far = stretches.rowsBetween(W.unboundedPreceding, -1)
    held = rows.groupBy(*key).agg(F.sum("__opens").alias("o"), F.sum("__moved").alias("m"))
    held = held.select(*key, *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(f"__held_{c}") for c in "om"])
    run = here.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"__o": F.sum("__opens").over(run), "__m": F.sum("__moved").over(run)}).join(held, key)
    rows = rows.withColumns({"segment": F.col("__o") + F.col("__held_o"), "__moves": F.col("__m") + F.col("__held_m")})
    first = rows.where("__opens = 1 OR __before IS NULL").select(*SESSION, "segment", F.col("__moves").alias("__from"))
    rows = rows.join(first, [*SESSION, "segment"]).withColumn("step_no", (F.col("__moves") - F.col("__from")).cast("long"))
    suffix = F.when(F.col("segment") > 0, F.concat(F.lit("#"), F.col("segment").cast("string"))).otherwise("")
    return rows.withColumn("trace_id", F.concat("session_id", suffix)).select(*events.columns, "segment", "trace_id", "step_no")


def stepped(events: DataFrame, timeout_s: int = TIMEOUT_S, collapse: bool = True, bucket_s: int | None = None, most: int | None = None) -> DataFrame:
    """Segmented events with ``step_no``; runs of one screen are one step unless ``collapse`` is off."""
    if most is not None:
        usual, bots = split_bots(events, most)
        theirs = events.join(bots.select(*SESSION), list(SESSION), "left_semi")
        return stepped(usual, timeout_s, collapse).unionByName(_in_stretches(theirs, timeout_s, collapse, bucket_s or timeout_s))
    if bucket_s is not None:
        return _in_stretches(events, timeout_s, collapse, bucket_s)
    rows = segmented(events, timeout_s)
    in_trace = W.partitionBy(*SESSION, "segment").orderBy("timestamp", "event_id")
    if collapse:
        changed = F.coalesce((F.col("screen_id") != F.lag("screen_id").over(in_trace)).cast("int"), F.lit(0))
        rows = rows.withColumn("__changed", changed)
        return rows.withColumn("step_no", F.sum("__changed").over(in_trace.rowsBetween(W.unboundedPreceding, 0))).drop("__changed")
    return rows.withColumn("step_no", (F.row_number().over(in_trace) - 1).cast("long"))


def trace_steps(events: DataFrame, timeout_s: int = TIMEOUT_S, collapse: bool = True, bucket_s: int | None = None, most: int | None = None) -> DataFrame:
    """One row for each screen visit: entered, exited, dwell, events, interactions, monetary sum."""
    rows = stepped(events, timeout_s, collapse, bucket_s, most)
    acted = F.when(F.col("event_type") != "screen_view", F.struct("timestamp", "event_id", "event_name"))
    grouped = rows.groupBy(*SESSION, "segment", "trace_id", "step_no").agg(
        F.first("screen_id").alias("screen_id"),
        F.min("timestamp").alias("entered"),
        F.max("timestamp").alias("exited"),
        F.count("*").alias("n_events"),
        F.transform(F.array_sort(F.collect_list(acted)), lambda x: x["event_name"]).alias("interactions"),
        F.sum(F.col("order_value").cast("decimal(28,6)")).alias("order_value"),
        F.max_by("user_id", F.when(~missing("user_id"), F.struct("timestamp", "event_id"))).alias("user_id"),
        F.min_by(F.struct("platform", "app_version"), F.struct("timestamp", "event_id")).alias("device"),
    )
    return grouped.withColumn("dwell_s", (F.unix_micros("exited") - F.unix_micros("entered")) / 1e6)


def traces(steps: DataFrame) -> DataFrame:
    """One row for each trace. The user is the last one known; the device is that of the first event."""
    step = F.struct("step_no", "screen_id")
    grouped = steps.groupBy(*SESSION, "segment", "trace_id").agg(
        F.transform(F.array_sort(F.collect_list(step)), lambda x: x["screen_id"]).alias("path"),
        F.min("entered").alias("started"),
        F.max("exited").alias("ended"),
        F.count("*").alias("length"),
        F.sum("n_events").alias("n_events"),
        F.sum(F.size("interactions")).alias("n_interactions"),
        F.sum("order_value").alias("order_value"),
        F.max_by("user_id", F.when(F.col("user_id").isNotNull(), F.col("step_no"))).alias("user_id"),
        F.min_by("device", "step_no").alias("device"),
    )
    duration = (F.unix_micros("ended") - F.unix_micros("started")) / 1e6
    return grouped.withColumns({"terminal": F.element_at("path", -1), "duration_s": duration}).select("*", "device.*").drop("device")


def usable(trace_rows: DataFrame) -> DataFrame:
    """Traces with a transition."""
    return trace_rows.where("length >= 2")


def summary(trace_rows: DataFrame) -> DataFrame:
    """Traces, usable and too short ones, splits, mean length."""
    return trace_rows.groupBy("app_id").agg(
        F.count("*").alias("n_traces"),
        F.count_if(F.col("length") >= 2).alias("n_usable"),
        F.count_if(F.col("length") < 2).alias("n_too_short"),
        F.count_if(F.col("segment") > 0).alias("n_splits"),
        (F.sum("length") / F.count("*")).alias("mean_length"),
    )


def event_log(steps: DataFrame) -> DataFrame:
    """The log (case, activity, timestamp) that process-mining tools read (K9)."""
    return steps.select(F.col("trace_id").alias("case_id"), F.col("screen_id").alias("activity"), F.col("entered").alias("timestamp"))
