"""Quality of an event store (Q1 to Q4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.operators.sessions import missing

#: check: limit, whether more is better, whether a breach blocks.
CHECKS = {
    "volume": (1000.0, True, True),
    "freshness_h": (4.0, False, True),
    "null_session_pct": (5.0, False, True),
    "orphan_pct": (5.0, False, True),
    "screen_coverage_pct": (90.0, True, True),
    "conformance_pct": (95.0, True, True),
    "out_of_order_pct": (1.0, False, False),
    "duplicate_pct": (0.1, False, False),
}


def out_of_order(events: DataFrame) -> DataFrame:
    """Sessions and those whose arrival order isn't their time order (Q2)."""
    arrival = W.partitionBy("app_id", "session_id").orderBy("read_order")
    back = F.coalesce(F.lag("timestamp").over(arrival) > F.col("timestamp"), F.lit(False))
    per_session = events.where(~missing("session_id")).withColumn("back", back).groupBy("app_id", "session_id").agg(F.bool_or("back").alias("back"))
    return per_session.groupBy("app_id").agg(F.count("*").alias("n_sessions"), F.count_if("back").alias("n_out_of_order"))


def duplicates(events: DataFrame) -> DataFrame:
    """Repeated emissions: events beyond the first of a session, name and time (Q3)."""
    same = events.groupBy("app_id", "session_id", "event_name", "timestamp").agg(F.count("*").alias("c"))
    return same.groupBy("app_id").agg(F.sum("c").alias("n_events"), F.sum(F.col("c") - 1).alias("n_duplicates"))


def freshness(events: DataFrame, now: Column) -> DataFrame:
    """Hours since the last event (Q4)."""
    return events.groupBy("app_id").agg(((F.unix_micros(now) - F.unix_micros(F.max("timestamp"))) / 3.6e9).alias("freshness_h"))


def checks(events: DataFrame, screens: DataFrame, now: Column, conformance: DataFrame | None = None) -> DataFrame:
    """(app_id, check, value, limit, passed, blocking). ``screens``: declared (app_id, screen_id);
    ``conformance``: (app_id, conformance_pct) of the tracking plan. An app with declared screens
    but no event has volume 0 and no freshness, both breached."""
    one_pass = events.groupBy("app_id").agg(
        F.count("*").cast("double").alias("volume"),
        ((F.unix_micros(now) - F.unix_micros(F.max("timestamp"))) / 3.6e9).alias("freshness_h"),
        (F.count_if(missing("session_id")) * 100 / F.count("*")).alias("null_session_pct"),
        (F.count_if(~missing("screen_tag") & missing("screen_id")) * 100 / F.count("*")).alias("orphan_pct"),
    )
    seen = screens.join(events.select("app_id", "screen_id").distinct().withColumn("seen", F.lit(1)), ["app_id", "screen_id"], "left")
    covered = seen.groupBy("app_id").agg((F.count("seen") * 100 / F.count("*")).alias("screen_coverage_pct"))
    order = out_of_order(events).select("app_id", F.coalesce(F.try_divide(F.col("n_out_of_order") * 100, F.col("n_sessions")), F.lit(0.0)).alias("out_of_order_pct"))
    twice = duplicates(events).select("app_id", (F.col("n_duplicates") * 100 / F.col("n_events")).alias("duplicate_pct"))
    apps = screens.select("app_id").union(events.select("app_id")).distinct()
    wide = apps.join(one_pass, "app_id", "left").na.fill(0.0, ["volume"]).join(covered, "app_id", "left").join(order, "app_id", "left").join(twice, "app_id", "left")
    if conformance is not None:
        wide = wide.join(conformance, "app_id", "left")
    names = [c for c in CHECKS if c in wide.columns]
    long = wide.unpivot("app_id", names, "check", "value").where("value IS NOT NULL OR check = 'freshness_h'")
    limit, more, blocks = (F.create_map(*[F.lit(x) for k, v in CHECKS.items() for x in (k, v[i])]) for i in range(3))
    rows = long.withColumns({"limit": limit[F.col("check")], "blocking": blocks[F.col("check")]})
    held = F.when(more[F.col("check")], F.col("value") >= F.col("limit")).otherwise(F.col("value") <= F.col("limit"))
    return rows.withColumn("passed", F.coalesce(held, F.lit(False)))


def verdict(check_rows: DataFrame) -> DataFrame:
    """Whether all blocking checks pass."""
    return check_rows.groupBy("app_id").agg(F.bool_and(F.col("passed") | ~F.col("blocking")).alias("passed"), F.count_if(~F.col("passed")).alias("n_failed"))
