"""Variants, that is distinct paths, and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.functions.ranking import numbered, with_totals


def variants(trace_rows: DataFrame) -> DataFrame:
    """One row for each path of usable traces: sessions, users, durations, share of sessions."""
    grouped = trace_rows.where("length >= 2").groupBy("app_id", "path").agg(
        F.count("*").alias("n_sessions"),
        F.count_distinct("user_id").alias("n_users"),
        F.sum(F.unix_micros("ended") - F.unix_micros("started")).alias("total_us"),
    )
    grouped = with_totals(grouped, ["app_id"], total=F.sum("n_sessions"))
    return grouped.withColumns({"share": F.col("n_sessions") / F.col("total"), "mean_duration_s": F.col("total_us") / F.col("n_sessions") / 1e6}).drop("total")


def examples(trace_rows: DataFrame, k: int = 3) -> DataFrame:
    """The first traces of each path by start."""
    first = W.partitionBy("app_id", "path").orderBy("started", "trace_id")
    return trace_rows.where("length >= 2").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k).select("app_id", "path", "nth", "trace_id")


def label(path: Column) -> Column:
    """A path's name: up to five screens whole, else the first four and the last."""
    long = F.concat(F.array_join(F.slice(path, 1, 4), " > "), F.lit(" > … > "), F.element_at(path, -1))
    return F.when(F.size(path) <= 5, F.array_join(path, " > ")).otherwise(long)


def coverage_curve(variant_rows: DataFrame) -> DataFrame:
    """Variants by falling count with the share of sessions that they and those before make up."""
    rows = with_totals(variant_rows.select("app_id", "path", "n_sessions"), ["app_id"], total=F.sum("n_sessions"))
    ranked = numbered(rows, ["app_id"], [F.desc("n_sessions"), "path"], "rank", {"running": F.col("n_sessions")})
    return ranked.select("app_id", "path", "n_sessions", "rank", (F.col("running") * 100 / F.col("total")).alias("cumulative_pct"))


def needed_for(curve: DataFrame, target_pct: float = 95.0) -> DataFrame:
    """How many variants reach a share; tested on the rounded value as the reports show it."""
    return curve.where(F.round("cumulative_pct", 2) >= target_pct).groupBy("app_id").agg(F.min("rank").alias("n_needed"))


def entropy(variant_rows: DataFrame) -> DataFrame:
    """Shannon entropy of the variants in bits."""
    rows = with_totals(variant_rows.select("app_id", "n_sessions"), ["app_id"], total=F.sum("n_sessions"))
    return rows.withColumn("p", F.col("n_sessions") / F.col("total")).groupBy("app_id").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy_bits"), F.count("*").alias("n_variants"))


def drop_off(trace_rows: DataFrame) -> DataFrame:
    """Usable traces by the screen where they end."""
    return trace_rows.where("length >= 2").groupBy("app_id", "terminal").agg(F.count("*").alias("n_sessions"))


def monetary(trace_rows: DataFrame) -> DataFrame:
    """Money of each path."""
    return trace_rows.where("length >= 2").groupBy("app_id", "path").agg(F.sum("order_value").alias("monetary"))
