"""Normalisation of vendor records, and the idempotent store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.parsing import event_id, event_type, ingest_time
from trailmark.sources.vendors import CONNECTORS


def normalise(records: DataFrame, source: str, tags: DataFrame | None = None, app_id: str = "app") -> DataFrame:
    """Canonical events of ``records`` (VARIANT ``record``), with ``reject_reason`` (null if accepted).

    ``tags``: declared (ord, screen_id, screen_tag); the first declaring screen wins. A tag that no
    screen declares keeps its event, without a screen.
    """
    rows = _once(CONNECTORS.get(source).adapter(records).drop("record"))
    rows = _once(rows.withColumn("timestamp", ingest_time(F.col("time_text"))).drop("time_text"))
    reason = F.when(F.col("event_name").isNull(), "no event name").when(F.col("timestamp").isNull(), "no timestamp")
    rows = rows.withColumns(
        {
            "app_id": F.lit(app_id),
            "source": F.lit(source),
            "event_type": event_type(F.col("event_name")),
            "event_id": event_id(F.col("session_id"), F.col("event_name"), F.col("screen_tag"), F.col("timestamp"), F.col("properties")),
            "event_date": F.to_date("timestamp"),
            "reject_reason": reason,
        }
    )
    if tags is None:
        return rows.withColumn("screen_id", F.lit(None).cast("string"))
    return resolved(rows, tags)


def _once(rows: DataFrame) -> DataFrame:
    """The same rows; what they hold is computed once for each, not again for each later use."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def resolved(rows: DataFrame, tags: DataFrame, column: str = "screen_tag") -> DataFrame:
    """Rows with ``screen_id`` by tag or page object."""
    first = tags.groupBy(F.col(column).alias("__tag")).agg(F.min_by("screen_id", "ord").alias("screen_id"))
    return rows.join(first, F.col(column) == F.col("__tag"), "left").drop("__tag")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reject_reason IS NULL").drop("reject_reason")


def summary(rows: DataFrame) -> DataFrame:
    """Ingested and rejected records, acceptance, events without a screen."""
    ok = F.col("reject_reason").isNull()
    return rows.groupBy("app_id", "source").agg(
        F.count_if(ok).alias("ingested"), F.count_if(~ok).alias("rejected"), (F.count_if(ok) * 100 / F.count("*")).alias("acceptance_pct"), F.count_if(ok & F.col("screen_id").isNull() & F.col("screen_tag").isNotNull()).alias("orphans")
    )


def orphan_tags(rows: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent tags that no screen declares."""
    lost = rows.where("reject_reason IS NULL AND screen_id IS NULL AND screen_tag IS NOT NULL")
    return lost.groupBy("screen_tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "screen_tag").limit(k)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def insert(batch: DataFrame, path: str, key: str = "event_id", date: str = "event_date") -> int:
    """Append the rows whose key the store lacks; returns how many (K1 to K3).

    The store is partitioned by date and sorted by session within a file; just the keys of the
    batch's dates are read, and the rows are counted as they are written. The rebalance keeps a
    date in few files, and splits one that is too large for a task.
    """
    spark = batch.sparkSession
    dated = batch.withColumn(date, F.to_date("timestamp"))
    there = exists(spark, path)
    if there:
        dated = dated.cache()  # for its dates and its rows
    new = dated.dropDuplicates([key])
    if there:
        days = [r[0] for r in dated.select(date).distinct().collect()]  # at most the days of a batch
        held = spark.read.schema(dated.select(key, date).schema).parquet(path).where(F.col(date).isin(days)).select(key)
        new = new.join(held, key, "left_anti")
    written = Observation()
    rows = new.observe(written, F.count(F.lit(1)).alias("n"))
    rows.hint("rebalance", F.col(date)).sortWithinPartitions(date, "session_id", "timestamp").write.mode("append").partitionBy(date).parquet(path)
    dated.unpersist()
    return written.get["n"]


def save_bucketed(events: DataFrame, table: str, buckets: int, path: str, mode: str = "errorifexists") -> DataFrame:
    """Events as a table bucketed and sorted by session (K3), so that whatever is grouped by session
    reads it without a shuffle. ``path`` is in a folder that all executors share. Choose the number of
    buckets for files of some hundred megabytes; ``mode`` append adds files to the same buckets.
    """
    # One task writes a bucket, so each has one file.
    dealt = events.repartition(buckets, "app_id", "session_id").sortWithinPartitions("app_id", "session_id", "timestamp")
    writer = dealt.write.mode(mode).format("parquet").bucketBy(buckets, "app_id", "session_id").sortBy("app_id", "session_id", "timestamp")
    writer.option("path", path).saveAsTable(table)
    return events.sparkSession.table(table)


def counters(events: DataFrame) -> DataFrame:
    """The store's counters in one pass (K4)."""
    return events.groupBy("app_id").agg(
        F.count("*").alias("n_events"),
        F.count_distinct("session_id").alias("n_sessions"),
        F.count_if(F.col("screen_id").isNull() & F.col("screen_tag").isNotNull()).alias("n_orphans"),
        F.count_if(F.col("session_id").isNull()).alias("n_no_session"),
        F.max("timestamp").alias("last_at"),
    )


def screen_counts(events: DataFrame) -> DataFrame:
    return events.where("screen_id IS NOT NULL").groupBy("app_id", "screen_id").agg(F.count("*").alias("n_events"))


def session_timeline(events: DataFrame, session: Column) -> DataFrame:
    """One session's events in order."""
    return events.where(F.col("session_id") == session).orderBy("timestamp", "event_id")
