"""Parity between platforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.operators import drift

WARN, ALERT = 0.15, 0.30


def platform_of(spelling: Column) -> Column:
    """One name for each platform; null is unknown."""
    low = F.lower(F.trim(F.coalesce(spelling, F.lit("unknown"))))
    return F.when(low.isin("ios", "iphone", "ipad"), "ios").otherwise(low)


def counts(trace_rows: DataFrame) -> DataFrame:
    """(app_id, platform, path, n_sessions) of usable traces."""
    named = trace_rows.where("length >= 2").withColumn("platform", platform_of(F.col("platform")))
    return named.groupBy("app_id", "platform", "path").agg(F.count("*").alias("n_sessions"))


def matrix(count_rows: DataFrame, platforms: list[str], min_sessions: int = 1) -> DataFrame:
    """Sessions of each path on each platform, for paths that reach ``min_sessions`` on one."""
    pivoted = count_rows.groupBy("app_id", "path").pivot("platform", platforms).agg(F.sum("n_sessions")).na.fill(0)
    return pivoted.where(F.greatest(*platforms, F.lit(0)) >= min_sessions)


def exclusive_paths(count_rows: DataFrame, min_sessions: int = 1) -> DataFrame:
    """Paths of one platform only."""
    grouped = count_rows.groupBy("app_id", "path").agg(F.count("*").alias("n_platforms"), F.min("platform").alias("platform"), F.max("n_sessions").alias("n_sessions"))
    return grouped.where((F.col("n_platforms") == 1) & (F.col("n_sessions") >= min_sessions)).drop("n_platforms")


def exclusive_screens(count_rows: DataFrame) -> DataFrame:
    """Screens that only one platform shows."""
    shown = count_rows.select("app_id", "platform", F.explode("path").alias("screen_id"))
    return shown.groupBy("app_id", "screen_id").agg(F.count_distinct("platform").alias("n"), F.min("platform").alias("platform")).where("n = 1").drop("n")


def asymmetric(count_rows: DataFrame, covered: DataFrame) -> DataFrame:
    """Paths that several platforms walk and tests cover on some but not all.
    ``covered``: (app_id, platform, path)."""
    marked = count_rows.join(covered.distinct().withColumn("covered", F.lit(1)), ["app_id", "platform", "path"], "left").na.fill(0, ["covered"])
    grouped = marked.groupBy("app_id", "path").agg(F.count("*").alias("n_platforms"), F.min("covered").alias("low"), F.max("covered").alias("high"))
    return grouped.where("n_platforms >= 2 AND low <> high").select("app_id", "path", "n_platforms")


def divergence(count_rows: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence between an app's first two platforms by name, with its status."""
    ranked = count_rows.withColumn("nth", F.dense_rank().over(W.partitionBy("app_id").orderBy("platform")))
    sides = [ranked.where(F.col("nth") == i).select("app_id", F.col("path").alias("key"), F.col("n_sessions").alias("weight")) for i in (1, 2)]
    both = sides[1].select("app_id").distinct()
    value = drift.js_divergence(*sides).join(both, "app_id", "left_semi")
    status = F.when(F.col("js_divergence") >= ALERT, "alert").when(F.col("js_divergence") >= WARN, "warn").otherwise("ok")
    return value.withColumn("status", status)
