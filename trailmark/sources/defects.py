"""Exports of an issue tracker: escaped defects, and gaps that were reported before.

A file holds ``{"defects": [...], "gaps_reported": [...]}`` or a bare array of defects. Files may
also be JSON lines of such documents, which split by lines where whole files would not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.parsing import ingest_time


def read_exports(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One variant ``export`` for each document, with its file."""
    text = spark.read.text(path) if lines else spark.read.text(path, wholetext=True)
    rows = text.where(F.trim("value") != "")
    return rows.select(F.parse_json("value").alias("export"), F.col("_metadata.file_path").alias("file"))


def _records(exports: DataFrame, listed: Column) -> DataFrame:
    return exports.select("file", F.explode(listed).alias("r"))


def _text(path: str) -> Column:
    return F.try_variant_get("r", path, "string")


def _list(path: str) -> Column:
    return F.coalesce(F.try_variant_get("r", path, "array<string>"), F.array().cast("array<string>"))


def defects(exports: DataFrame, app_id: str, now: Column | None = None) -> DataFrame:
    """Defects of the exports. One without an id is an error; an absent date is ``now``, an absent
    severity medium, absent lists are empty."""
    bare = F.startswith(F.schema_of_variant("export"), F.lit("ARRAY"))
    listed = F.when(bare, F.try_variant_get("export", "$", "array<variant>")).otherwise(F.try_variant_get("export", "$.defects", "array<variant>"))
    rows = _records(exports, listed)
    named = F.when(_text("$.defect_id").isNull(), F.raise_error(F.concat(F.lit("a defect without defect_id in "), "file")).cast("string")).otherwise(_text("$.defect_id"))
    found = F.coalesce(ingest_time(_text("$.detected_at")), F.current_timestamp() if now is None else now)
    return rows.select(
        F.lit(app_id).alias("app_id"),
        named.alias("defect_id"),
        F.coalesce(_text("$.title"), F.lit("")).alias("title"),
        found.alias("detected_at"),
        F.coalesce(_text("$.release"), F.lit("")).alias("release"),
        _text("$.journey_id").alias("journey_id"),
        _list("$.screens").alias("screens"),
        F.coalesce(_text("$.severity"), F.lit("medium")).alias("severity"),
        _list("$.covering_tests").alias("covering_tests"),
        F.coalesce(_text("$.notes"), F.lit("")).alias("notes"),
    )


def reported_gaps(exports: DataFrame, app_id: str) -> DataFrame:
    """Gaps of the exports; bare arrays have none. ``caused_defect`` and ``closed_by_test`` are ids
    or null."""
    rows = _records(exports, F.try_variant_get("export", "$.gaps_reported", "array<variant>"))
    return rows.select(
        F.lit(app_id).alias("app_id"), _text("$.journey_id").alias("journey_id"), ingest_time(_text("$.reported_at")).alias("reported_at"), F.coalesce(_text("$.severity"), F.lit("medium")).alias("severity"),
        _text("$.closed_by_test").alias("closed_by_test"), _text("$.caused_defect").isNotNull().alias("caused_defect"),
    )
