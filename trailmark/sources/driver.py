"""The canonical event view of the driver tables: an adapter like any vendor's.

The event type is name, tag and screen at once; a user is a session; platforms are spelt in
several ways on purpose, so that parity has something to normalise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events: one row for each row of ``events``."""
    raw = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    spelling = F.when(F.col("user_id") % 3 == 0, "Android").when(F.col("user_id") % 3 == 1, "iPhone").otherwise("ios")
    return raw.select(
        F.lit("demo").alias("app_id"),
        "event_id",
        F.col("event_type").alias("event_name"),
        F.when(F.col("event_type") == "view", "screen_view").otherwise("interaction").alias("event_type"),
        F.col("event_type").alias("screen_tag"),
        F.col("event_type").alias("screen_id"),
        user.alias("session_id"),
        user.alias("user_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(F.dayofmonth("ts") <= 15, "1.0").otherwise("2.0").alias("app_version"),
        spelling.alias("platform"),
        F.col("value").alias("order_value"),
        F.col("props").alias("properties"),
        F.col("event_id").alias("read_order"),
    )


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second event log: customers as sessions, order priorities as screens."""
    raw = table(spark, sf_dir, "orders")
    case = F.col("o_custkey").cast("string")
    return raw.select(
        F.lit("orders").alias("app_id"),
        F.col("o_orderkey").alias("event_id"),
        F.col("o_orderstatus").alias("event_name"),
        F.lit("screen_view").alias("event_type"),
        F.col("o_orderpriority").alias("screen_id"),
        case.alias("session_id"),
        case.alias("user_id"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.lit("web").alias("platform"),
        F.lit("1.0").alias("app_version"),
        F.col("o_totalprice").alias("order_value"),
    )
