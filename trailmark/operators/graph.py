"""The directly-follows graph of traces and its comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def transitions(path_rows: DataFrame, *keep: str) -> DataFrame:
    """(source, target, position) of each consecutive pair of ``path``, with the columns to keep."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("source"), F.get("path", i + 1).alias("target"), i.alias("position")))
    return path_rows.where(F.size("path") >= 2).select(*keep, F.explode(pairs).alias("pair")).select(*keep, "pair.*")


def edges(path_rows: DataFrame) -> DataFrame:
    """(app_id, source, target, weight) over traces with a transition."""
    return transitions(path_rows, "app_id").groupBy("app_id", "source", "target").agg(F.count("*").alias("weight"))


def nodes(path_rows: DataFrame) -> DataFrame:
    """(app_id, screen_id, visits, starts, ends): visits count steps, not sessions."""
    walked = path_rows.where(F.size("path") >= 2).select("app_id", "path", F.posexplode("path").alias("at", "screen_id"))
    return walked.groupBy("app_id", "screen_id").agg(
        F.count("*").alias("visits"),
        F.count_if(F.col("at") == 0).alias("starts"),
        F.count_if(F.col("at") == F.size("path") - 1).alias("ends"),
    )


def probabilities(edge_rows: DataFrame) -> DataFrame:
    """Edges with outgoing weight of the source and transition probability; ends don't count."""
    out = F.sum("weight").over(W.partitionBy("app_id", "source"))
    return edge_rows.withColumn("outgoing", out).withColumn("probability", F.col("weight") / F.col("outgoing"))


def top_edges(edge_rows: DataFrame, k: int = 10) -> DataFrame:
    return edge_rows.orderBy(F.desc("weight"), "app_id", "source", "target").limit(k)


def without_noise(edge_rows: DataFrame, node_rows: DataFrame, min_weight: int) -> tuple[DataFrame, DataFrame]:
    """Edges from ``min_weight`` on, and the nodes that they touch."""
    kept = edge_rows.where(F.col("weight") >= min_weight)
    touched = kept.select("app_id", F.explode(F.array("source", "target")).alias("screen_id")).distinct()
    return kept, node_rows.join(touched, ["app_id", "screen_id"], "left_semi")


def exit_rates(node_rows: DataFrame) -> DataFrame:
    rate = F.coalesce(F.try_divide(F.col("ends"), F.col("visits")), F.lit(0.0))
    return node_rows.withColumns({"exit_rate": rate, "entry_point": F.col("starts") > 0})


def with_screens(node_rows: DataFrame, screens: DataFrame) -> DataFrame:
    """Nodes joined with declared screens; a screen that nobody visited has zero visits."""
    joined = node_rows.join(screens, ["app_id", "screen_id"], "full_outer")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("visits", "starts", "ends")}
    return joined.withColumns(counts | {"critical": F.coalesce("critical", F.lit(False)), "declared": F.col("domain").isNotNull()})


def uncovered(edge_rows: DataFrame, tested: DataFrame, min_weight: int = 1) -> DataFrame:
    """Production transitions that no test walks."""
    return edge_rows.where(F.col("weight") >= min_weight).join(tested, ["app_id", "source", "target"], "left_anti")


def unreachable(tested: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Tested transitions that production never shows."""
    return tested.join(edge_rows, ["app_id", "source", "target"], "left_anti")


def unseen_critical(screens: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Critical screens without traffic."""
    return screens.where("critical").join(node_rows, ["app_id", "screen_id"], "left_anti")


def conformance(path_rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Share of each trace's transitions that an edge set allows."""
    marked = allowed.select("app_id", "source", "target").distinct().withColumn("ok", F.lit(1))
    pairs = transitions(path_rows, "app_id", "trace_id").join(marked, ["app_id", "source", "target"], "left")
    return pairs.groupBy("app_id", "trace_id").agg(F.count("*").alias("n_transitions"), F.count("ok").alias("n_allowed"), (F.count("ok") / F.count("*")).alias("conformance"))


def export(edge_rows: DataFrame, node_rows: DataFrame, folder: str) -> None:
    """Graph tables as JSON: screens by visits, transitions by weight, probability to 4 places (K6)."""
    node_rows.orderBy(F.desc("visits"), "screen_id").write.json(f"{folder}/nodes")
    probabilities(edge_rows).withColumn("probability", F.round("probability", 4)).orderBy(F.desc("weight"), "source", "target").write.json(f"{folder}/edges")
