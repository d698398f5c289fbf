"""Risk signals on the users' timelines: as-of join and what is read off it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def located(signals: DataFrame, events: DataFrame, bucket_s: int | None = None) -> DataFrame:
    """Each signal with the screen and position (from 0) of its session's last event at or before it.

    Events and signals are one timeline for each session, read with one sort; at equal times
    events come first, so a tie counts as before. Positions count all events of the session, those
    without a screen too. A signal before the first event, or of an unknown session, stays
    without both; signals and events without a session go around the window, as they would all
    be one group of it. ``signals``: app_id, signal_id, session_id, timestamp and more.

    With ``bucket_s`` the window is a stretch of so many seconds of a session, which takes over the last
    event and the count of the stretches before it, so a session of very many events is many tasks.
    """
    line = events.where("session_id IS NOT NULL").select("app_id", "session_id", "timestamp", F.lit(0).alias("o"), F.col("event_id").cast("string").alias("tie"), F.struct(F.lit(1).alias("is_event"), "screen_id").alias("event"), F.lit(None).cast(signals.select(F.struct("*").alias("s")).schema["s"].dataType).alias("signal"))
    marks = signals.where("session_id IS NOT NULL").select("app_id", "session_id", "timestamp", F.lit(1).alias("o"), F.col("signal_id").cast("string").alias("tie"), F.lit(None).cast(line.schema["event"].dataType).alias("event"), F.struct("*").alias("signal"))
    order = ("timestamp", "o", F.length("tie"), "tie")
    rows, key = line.unionByName(marks), ["app_id", "session_id"]
    if bucket_s is not None:
        rows = rows.withColumn("stretch", F.floor(F.unix_micros("timestamp") / F.lit(1_000_000 * bucket_s)))
        so_far = W.partitionBy(*key).orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
        ends = rows.groupBy(*key, "stretch").agg(F.count("event").alias("c"), F.max_by("event", F.when(F.col("event").isNotNull(), F.struct(*order))).alias("e"))
        held = ends.select(*key, "stretch", F.coalesce(F.sum("c").over(so_far), F.lit(0)).alias("held_n"), F.last("e", ignorenulls=True).over(so_far).alias("held_event"))
        key = [*key, "stretch"]
    ordered = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    seen = rows.withColumns({"last_event": F.last("event", ignorenulls=True).over(ordered), "n": F.count("event").over(ordered)})
    if bucket_s is not None:
        seen = seen.join(held, key).withColumns({"last_event": F.coalesce("last_event", "held_event"), "n": F.col("n") + F.col("held_n")})
    known = F.col("n") > 0
    found = seen.where("o = 1").select("signal.*", F.when(known, F.col("last_event.screen_id")).alias("screen_id"), F.when(known, F.col("n") - 1).alias("position_in_session"))
    lost = signals.where("session_id IS NULL")
    return found.unionByName(lost.select("*", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("screen_id", "position_in_session")]))


def by_screen(located_rows: DataFrame) -> DataFrame:
    """Signals of each screen that has any."""
    return located_rows.where("screen_id IS NOT NULL").groupBy("app_id", "screen_id").agg(F.count("*").alias("n_signals"))


def localisation_rate(located_rows: DataFrame) -> DataFrame:
    """Share of signals with a screen, in per cent."""
    return located_rows.groupBy("app_id").agg(F.count("*").alias("n_signals"), F.count("screen_id").alias("n_located"), (F.count("screen_id") * 100 / F.count("*")).alias("located_pct"))
