"""Findings: what the suite misses, keeps for nothing, or can't be mapped.

A finding is (app_id, kind, severity, subject, sessions, critical, detail). A test's id is its
subject; a journey's or a transition's otherwise.
"""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.functions.ranking import numbered, with_totals
from trailmark.operators.coverage import covering_counts

SEVERITIES = ("info", "low", "medium", "high", "critical")
KINDS = ("coverage_gap", "obsolete", "stale", "over_tested", "assertion_gap", "unmapped_test", "protected_retained")
# Which kinds become tickets, and the priority of a severity.
TICKETABLE = ("coverage_gap", "stale", "assertion_gap", "unmapped_test")
PRIORITY = {"critical": "Highest", "high": "High", "medium": "Medium", "low": "Low", "info": "Lowest"}
MIN_WEIGHT = 5
REASON_LENGTH = 25
OVER_TESTED = 3


def _finding(rows: DataFrame, kind: Column | str, severity: Column | str, subject: Column, sessions: Column, critical: Column, detail: Column) -> DataFrame:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select("app_id", as_column(kind).alias("kind"), as_column(severity).alias("severity"), subject.alias("subject"), F.coalesce(sessions.cast("long"), F.lit(0)).alias("sessions"), F.coalesce(critical, F.lit(False)).alias("critical"), F.substring(detail, 1, 255).alias("detail"))


def _none() -> Column:
    return F.lit(None).cast("long")


def touches(path: Column, critical: list[str]) -> Column:
    return F.arrays_overlap(path, F.array(*map(F.lit, critical))) if critical else F.lit(False)


def journey_gaps(journeys: DataFrame, coverage: DataFrame, critical: list[str]) -> DataFrame:
    """Journeys that tests don't cover in full (G4). ``journeys``: app_id, journey_id, path, n_sessions."""
    rows = journeys.join(coverage, ["app_id", "journey_id"]).where("coverage < 1").withColumn("critical", touches(F.col("path"), critical))
    severity = F.when((F.col("n_covered") == 0) & F.col("critical"), "critical").when((F.col("n_covered") == 0) | F.col("critical"), "high").otherwise("medium")
    return _finding(rows, "coverage_gap", severity, F.col("journey_id"), F.col("n_sessions"), F.col("critical"), F.array_join(F.slice("missing", 1, 4), ", "))


def transition_gaps(transition_rows: DataFrame, coverage: DataFrame, critical: list[str], min_weight: int = MIN_WEIGHT) -> DataFrame:
    """Heavy untested transitions that no journey's gap names already."""
    named = coverage.where("coverage < 1").select("app_id", F.explode("missing").alias("pair")).distinct()
    rows = transition_rows.where((F.col("n_tests") == 0) & (F.col("weight") >= min_weight)).withColumn("pair", F.concat_ws(" > ", "source", "target")).join(named, ["app_id", "pair"], "left_anti")
    rows = rows.withColumn("critical", touches(F.array("source", "target"), critical))
    return _finding(rows, "coverage_gap", F.when(F.col("critical"), "high").otherwise("low"), F.col("pair"), F.col("weight"), F.col("critical"), F.col("pair"))


def registry_pattern(pattern: str) -> str:
    """Java expression of a registry pattern: ``re:`` is searched, else a glob must fit wholly."""
    return pattern[3:] if pattern.startswith("re:") else "^" + fnmatch.translate(pattern).replace(r"\Z", "").replace(r"\z", "").removesuffix("$") + "$"


def protected(tests: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """Tests with ``pattern`` and ``reason`` of the first registry entry that matches.

    The registry is an ordered list in the driver's configuration, so it becomes one expression.
    """
    hit = F.lit(None).cast("struct<pattern:string,reason:string>")
    for pattern, reason in reversed(patterns):
        hit = F.when(F.col("test_id").rlike(registry_pattern(pattern)), F.struct(F.lit(pattern).alias("pattern"), F.lit(reason).alias("reason"))).otherwise(hit)
    return tests.withColumn("__hit", hit).select("*", "__hit.pattern", "__hit.reason").drop("__hit")


def reachability(tested: DataFrame, edges: DataFrame) -> DataFrame:
    """(app_id, test_id, n_transitions, n_unreachable) by what production shows."""
    seen = tested.join(edges.select("app_id", "source", "target", F.lit(1).alias("seen")), ["app_id", "source", "target"], "left")
    return seen.groupBy("app_id", "test_id").agg(F.count("*").alias("n_transitions"), (F.count("*") - F.count("seen")).alias("n_unreachable"))


def dead_tests(reach: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """Obsolete tests walk nothing that production shows; protected ones are kept (G6). Stale ones
    walk some of it (G7)."""
    rows = protected(reach.where("n_unreachable > 0"), patterns)
    whole = F.col("n_unreachable") == F.col("n_transitions")
    kind = F.when(~whole, "stale").when(F.col("pattern").isNotNull(), "protected_retained").otherwise("obsolete")
    severity = F.when(kind == "protected_retained", "info").when(kind == "stale", "medium").otherwise("low")
    detail = F.concat(F.col("n_unreachable").cast("string"), F.lit(" of "), F.col("n_transitions").cast("string"), F.lit(" transitions unseen"))
    return _finding(rows, kind, severity, F.col("test_id"), _none(), F.lit(False), detail)


def over_tested(journeys: DataFrame, tested: DataFrame, least: int = OVER_TESTED) -> DataFrame:
    """Low-scored journeys with many tests (G8): below the score at place n // 2 of the falling list.
    Only their tests are counted."""
    ordered_ = numbered(with_totals(journeys, ["app_id"], half=F.floor(F.count("*") / 2)), ["app_id"], [F.desc("score"), "journey_id"], "nth")
    median = ordered_.where(F.col("nth") - 1 == F.col("half")).select("app_id", F.col("score").alias("median"))
    low = journeys.join(median, "app_id").where(F.col("score") < F.col("median")).select(journeys.columns)
    rows = low.join(covering_counts(low, tested), ["app_id", "journey_id"]).where(F.col("n_tests") >= least)
    return _finding(rows, "over_tested", "low", F.col("journey_id"), F.col("n_sessions"), F.lit(False), F.concat(F.col("n_tests").cast("string"), F.lit(" tests")))


def assertion_gaps(facts: DataFrame, critical: list[str]) -> DataFrame:
    """Critical screens that a test walks but never asserts."""
    wanted = F.array(*map(F.lit, critical)) if critical else F.array().cast("array<string>")
    rows = facts.withColumn("bare", F.array_sort(F.array_except(F.array_intersect("covered", wanted), F.col("asserted")))).where(F.size("bare") > 0)
    return _finding(rows, "assertion_gap", "medium", F.col("test_id"), _none(), F.lit(True), F.array_join("bare", ", "))


def unmapped(tests: DataFrame, paths: DataFrame, most: int = 20) -> DataFrame:
    """One finding for each app with tests that map to no screen; the first ones are listed."""
    lost = tests.join(paths.select("app_id", "test_id"), ["app_id", "test_id"], "left_anti")
    # The limit on the rank acts before the shuffle, so the window sees few rows of each task.
    nth = F.row_number().over(W.partitionBy("app_id").orderBy("test_id"))
    listed = lost.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("app_id").agg(F.array_join(F.array_sort(F.collect_list("test_id")), ", ").alias("listed"))
    rows = lost.groupBy("app_id").agg(F.count("*").alias("n")).join(listed, "app_id")
    return _finding(rows, "unmapped_test", "medium", F.concat(F.col("n").cast("string"), F.lit(" tests")), _none(), F.lit(False), F.col("listed"))


def rank_of(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1


def ordered(findings: DataFrame) -> DataFrame:
    """Findings with their place: worst first, then by sessions."""
    return numbered(findings, ["app_id"], [F.desc(rank_of(F.col("severity"))), F.desc("sessions"), "kind", "subject"], "place")


def tallies(findings: DataFrame) -> DataFrame:
    """(app_id, measure, label, n) by severity and kind, zeros included."""
    apps = findings.select("app_id").distinct()
    labels = apps.select("app_id", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(x).alias("label")) for m, xs in (("severity", SEVERITIES), ("kind", KINDS)) for x in xs])).alias("l")).select("app_id", "l.*")
    counted = findings.select("app_id", F.explode(F.array(F.struct(F.lit("severity").alias("measure"), F.col("severity").alias("label")), F.struct(F.lit("kind").alias("measure"), F.col("kind").alias("label")))).alias("l")).groupBy("app_id", "l.measure", "l.label").agg(F.count("*").alias("n"))
    return labels.join(counted, ["app_id", "measure", "label"], "left").na.fill(0, ["n"])


def tickets(findings: DataFrame, floor: str = "medium") -> DataFrame:
    """Payloads of the findings that become tickets (K8)."""
    priority = F.create_map(*[F.lit(x) for item in PRIORITY.items() for x in item])
    rows = findings.where(F.col("kind").isin(*TICKETABLE) & (rank_of(F.col("severity")) >= SEVERITIES.index(floor)))
    labels = F.array_compact(F.array(F.col("kind"), F.when(F.col("critical"), "critical-screen")))
    summary = F.substring(F.concat(F.lit("["), F.col("kind"), F.lit("] "), F.col("subject")), 1, 255)
    rows = rows.withColumns({"summary": summary, "priority": priority[F.col("severity")], "labels": labels})
    return rows.select("app_id", "summary", "priority", "labels", F.to_json(F.struct("summary", "priority", "labels", "detail", "sessions")).alias("payload"))


def metrics(coverage_summary: DataFrame, tally_rows: DataFrame, journeys: DataFrame, top: int = 20) -> DataFrame:
    """Long table (app_id, metric, labels, value) of the coverage figures, findings and top journeys (K7)."""
    figures = coverage_summary.unpivot("app_id", [c for c in coverage_summary.columns if c != "app_id"], "metric", "value").withColumn("labels", F.create_map().cast("map<string,string>"))
    counts = tally_rows.select("app_id", F.lit("findings").alias("metric"), F.col("n").cast("double").alias("value"), F.create_map("measure", "label").alias("labels"))
    first = W.partitionBy("app_id").orderBy(F.desc("n_sessions"), "journey_id")
    ratios = journeys.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= top).select("app_id", F.lit("journey_coverage").alias("metric"), F.col("coverage").alias("value"), F.create_map(F.lit("journey"), "journey_id").alias("labels"))
    cast = figures.withColumn("value", F.col("value").cast("double"))
    return cast.unionByName(counts).unionByName(ratios)


def deletable(findings: DataFrame, removed: list[str], patterns: list[tuple[str, str]]) -> DataFrame:
    """Obsolete tests with a second signal (the id names a removed screen or a retired flag), and no
    protection (J19)."""
    second = F.exists(F.array(*map(F.lit, removed)), lambda x: F.contains(F.col("test_id"), x)) if removed else F.lit(False)
    rows = protected(findings.where("kind = 'obsolete'").select("app_id", F.col("subject").alias("test_id")), patterns)
    return rows.where(second & F.col("pattern").isNull()).select("app_id", "test_id")


def guarded(rows: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """The rows, or an error at run time if one of them is protected."""
    checked = protected(rows, patterns)
    message = F.concat(F.lit("protected test in a deletion: "), F.col("test_id"))
    return checked.withColumn("test_id", F.when(F.col("pattern").isNull(), F.col("test_id")).otherwise(F.raise_error(message).cast("string"))).drop("pattern", "reason")


def stale_entries(registry: DataFrame, today: Column) -> DataFrame:
    """Registry entries past their review date (Q16). ``registry``: app_id, pattern, category,
    reason, owner, review_by; an entry without a date is never reviewed, so it is stale too."""
    return registry.where(F.col("review_by").isNull() | (F.col("review_by") < today))


def registry_issues(registry: DataFrame, least: int = REASON_LENGTH) -> DataFrame:
    """Entries whose reason is too short to explain why low traffic isn't low importance."""
    short = registry.where(F.length(F.trim(F.coalesce("reason", F.lit("")))) < least)
    return short.select("app_id", F.lit("thin_reason").alias("rule"), F.lit("error").alias("severity"), F.col("pattern").alias("subject"))


def entries_by_category(registry: DataFrame, today: Column) -> DataFrame:
    """(app_id, category, n_entries, n_stale) of a registry (Q16)."""
    return registry.groupBy("app_id", "category").agg(F.count("*").alias("n_entries"), F.count_if(F.col("review_by").isNull() | (F.col("review_by") < today)).alias("n_stale"))
