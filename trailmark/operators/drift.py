"""Drift between two windows of variants.

A distribution is a frame (app_id, key, weight).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPSILON = 1e-10
OTHER = "__other__"
#: metric: warn and alert from these values on.
THRESHOLDS = {"js_divergence": (0.10, 0.20), "psi": (0.10, 0.25), "novel_rate": (0.05, 0.15), "drop_off_shift": (0.10, 0.20)}


def aligned(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both weights and both shares of each key, zero where a side lacks it."""
    joined = before.withColumnRenamed("weight", "w0").join(after.withColumnRenamed("weight", "w1"), ["app_id", "key"], "full_outer").na.fill(0, ["w0", "w1"])
    app = W.partitionBy("app_id")
    share = {f"p{i}": F.coalesce(F.try_divide(F.col(f"w{i}"), F.sum(f"w{i}").over(app)), F.lit(0.0)) for i in (0, 1)}
    return joined.withColumns(share)


def js_divergence(before: DataFrame, after: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence in bits: 0 to 1; one side empty gives 1."""

    def part(p: str) -> Column:
        mean = (F.col("p0") + F.col("p1")) / 2
        return F.when(F.col(p) > 0, F.col(p) * F.log2(F.col(p) / mean)).otherwise(0.0)

    value = F.when((F.sum("p0") == 0) | (F.sum("p1") == 0), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum((part("p0") + part("p1")) / 2))))
    return aligned(before, after).groupBy("app_id").agg(value.alias("js_divergence"))


def bucketed(distribution: DataFrame, k: int = 10) -> DataFrame:
    """The k heaviest keys of an app, the rest as one; a distribution of up to k keys stays."""
    heaviest = W.partitionBy("app_id").orderBy(F.desc("weight"), "key")
    key = F.when(F.row_number().over(heaviest) <= k, F.col("key")).otherwise(OTHER)
    return distribution.withColumn("key", key).groupBy("app_id", "key").agg(F.sum("weight").alias("weight"))


def psi(before: DataFrame, after: DataFrame, k: int | None = 10) -> DataFrame:
    """Population stability index over bucketed sides (each side on its own), or over all keys."""
    sides = (before, after) if k is None else (bucketed(before, k), bucketed(after, k))
    p, q = (F.greatest(F.col(c), F.lit(EPSILON)) for c in ("p0", "p1"))
    return aligned(*sides).groupBy("app_id").agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))


def movers(before: DataFrame, after: DataFrame, k: int = 5) -> DataFrame:
    """Keys whose share moved most, in percentage points to two places."""
    delta = F.round((F.col("p1") - F.col("p0")) * 100, 2)
    moved = aligned(before, after).withColumn("delta_pp", delta)
    rank = W.partitionBy("app_id").orderBy(F.desc(F.abs("delta_pp")), "key")
    return moved.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("app_id", "rank", "key", "w0", "w1", "delta_pp")


def novel(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys of the later window that the earlier one lacks; swap the sides for vanished ones."""
    return after.join(before, ["app_id", "key"], "left_anti")


def novel_rate(before: DataFrame, after: DataFrame) -> DataFrame:
    """Share of the later window's weight on novel keys."""
    is_new = F.col("w0") == 0
    return aligned(before, after).groupBy("app_id").agg(F.coalesce(F.try_divide(F.sum(F.when(is_new, F.col("w1")).otherwise(0)), F.sum("w1")), F.lit(0.0)).alias("novel_rate"))


def report(before: DataFrame, after: DataFrame, ends_before: DataFrame, ends_after: DataFrame, thresholds: dict[str, tuple[float, float]] = THRESHOLDS, by_app: DataFrame | None = None) -> DataFrame:
    """(app_id, metric, value, status) of the four metrics. ``by_app``: (app_id, metric, warn, alert)
    of apps with thresholds of their own; where one is null or absent, the default holds (D6)."""
    parts = [
        js_divergence(before, after).select("app_id", F.lit("js_divergence").alias("metric"), F.col("js_divergence").alias("value")),
        psi(before, after).select("app_id", F.lit("psi").alias("metric"), F.col("psi").alias("value")),
        novel_rate(before, after).select("app_id", F.lit("novel_rate").alias("metric"), F.col("novel_rate").alias("value")),
        js_divergence(ends_before, ends_after).select("app_id", F.lit("drop_off_shift").alias("metric"), F.col("js_divergence").alias("value")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    warn = F.create_map(*[F.lit(x) for m, (w, _) in thresholds.items() for x in (m, w)])
    alert = F.create_map(*[F.lit(x) for m, (_, a) in thresholds.items() for x in (m, a)])
    rows = rows.withColumns({"warn": warn[F.col("metric")], "alert": alert[F.col("metric")]})
    if by_app is not None:
        own = by_app.select("app_id", "metric", F.col("warn").alias("own_warn"), F.col("alert").alias("own_alert"))
        rows = rows.join(own, ["app_id", "metric"], "left").withColumns({"warn": F.coalesce("own_warn", "warn"), "alert": F.coalesce("own_alert", "alert")})
    status = F.when(F.col("value") >= F.col("alert"), "alert").when(F.col("value") >= F.col("warn"), "warn").otherwise("ok")
    return rows.select("app_id", "metric", "value", status.alias("status"))


def overall(report_rows: DataFrame) -> DataFrame:
    """The worst status of an app."""
    worst = F.max(F.when(F.col("status") == "alert", 2).when(F.col("status") == "warn", 1).otherwise(0))
    return report_rows.groupBy("app_id").agg(F.element_at(F.array(F.lit("ok"), F.lit("warn"), F.lit("alert")), worst + 1).alias("overall"))
