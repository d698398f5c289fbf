"""Phase gates: tables of checks that must all pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators.screens import STABILITY, USABLE


def check(rows: DataFrame, gate: str, name: str, passed: Column, detail: Column) -> DataFrame:
    """One check for each app from a frame with one row for each app."""
    return rows.select("app_id", F.lit(gate).alias("gate"), F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.cast("string").alias("detail"))


def all_of(*checks: DataFrame) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def verdicts(check_rows: DataFrame) -> DataFrame:
    """Whether each gate passes, and how many of its checks do."""
    return check_rows.groupBy("app_id", "gate").agg(F.bool_and("passed").alias("passed"), F.count("*").alias("n_checks"), F.count_if("passed").alias("n_passed"))


def _counted(apps: DataFrame, rows: DataFrame) -> DataFrame:
    """(app_id, n) with 0 for apps that have no row."""
    return apps.join(rows.groupBy("app_id").agg(F.count("*").alias("n")), "app_id", "left").na.fill(0, ["n"])


def store_gate(plan_issues: DataFrame, quality_verdict: DataFrame, conformance: DataFrame, personal: DataFrame, located: DataFrame, min_conformance: float = 95.0) -> DataFrame:
    """The plan holds, quality passed, events keep the plan, hold no personal data, and signals are
    located (X1). ``personal``: (app_id, n) findings by kind."""
    apps = quality_verdict.select("app_id")
    broken = _counted(apps, plan_issues.where("severity = 'error'"))
    found = apps.join(personal.groupBy("app_id").agg(F.sum("n").alias("n")), "app_id", "left").na.fill(0, ["n"])
    return all_of(
        check(broken, "store", "plan", F.col("n") == 0, F.col("n")),
        check(quality_verdict, "store", "quality", F.col("passed"), F.concat(F.col("n_failed").cast("string"), F.lit(" failed"))),
        check(conformance, "store", "conformance", F.col("conformance_pct") >= min_conformance, F.round("conformance_pct", 2)),
        check(found, "store", "no_personal_data", F.col("n") == 0, F.col("n")),
        check(located, "store", "risk_located", F.col("n_located") > 0, F.col("n_located")),
    )


def journey_gate(compression: DataFrame, scores: DataFrame, unseen: DataFrame, traces: DataFrame, signals: DataFrame, most: int = 100, min_mapped_pct: float = 95.0) -> DataFrame:
    """The catalogue is built, holds the sessions of usable traces, is tractable and named, failures are attributed,
    and critical screens are seen (X2). ``signals``: (app_id, screen_id, n_signals)."""
    ranked = scores.groupBy("app_id").agg(F.count("*").alias("n"), F.count_if(F.col("name").isNotNull()).alias("n_named"), F.sum(F.when(F.col("name").isNotNull(), F.col("n_sessions"))).alias("held"))
    apps = traces.select("app_id").distinct()
    mapped = traces.groupBy("app_id").agg(F.count_if(F.col("length") >= 2).alias("n_traces")).join(ranked, "app_id", "left").na.fill(0)
    share = F.try_divide(F.col("held") * 100, F.col("n_traces"))
    lost = _counted(apps, unseen)
    failures = apps.join(signals.groupBy("app_id").agg(F.sum("n_signals").alias("n")), "app_id", "left").na.fill(0, ["n"])
    return all_of(
        check(mapped, "journeys", "built", F.col("n") > 0, F.col("n")),
        check(mapped, "journeys", "mapped", share >= min_mapped_pct, F.round(share, 1)),
        check(compression, "journeys", "tractable", F.col("n_needed") <= most, F.col("n_needed")),
        check(failures, "journeys", "risk_attributed", F.col("n") > 0, F.col("n")),
        check(mapped, "journeys", "named", F.col("n") == F.col("n_named"), F.col("n_named")),
        check(lost, "journeys", "critical_seen", F.col("n") == 0, F.col("n")),
    )


def suite_gate(files: DataFrame, coverage_summary: DataFrame, tests: DataFrame, findings: DataFrame, registry: DataFrame, min_parsed_pct: float = 85.0, min_mapped_pct: float = 70.0) -> DataFrame:
    """Files parse, tests map to screens, transitions are modelled, findings exist, and a registry
    was consulted (X3). ``files``: (app_id, file, parsed)."""
    read = files.groupBy("app_id").agg((F.count_if("parsed") * 100 / F.count("*")).alias("pct"))
    total = tests.groupBy("app_id").agg(F.count("*").alias("n_tests")).join(coverage_summary, "app_id")
    mapped = (F.col("n_tests") - F.col("unmapped_tests")) * 100 / F.col("n_tests")
    apps = tests.select("app_id").distinct()
    kept = _counted(apps, findings.where("kind = 'protected_retained'")).join(registry.select("app_id", F.lit(True).alias("consulted")).distinct(), "app_id", "left")
    made = _counted(apps, findings)
    return all_of(
        check(read, "suite", "parsed", F.col("pct") >= min_parsed_pct, F.round("pct", 2)),
        check(total, "suite", "mapped", mapped >= min_mapped_pct, F.round(mapped, 2)),
        check(coverage_summary, "suite", "covered", F.col("n_transitions") > 0, F.round("covered_pct", 2)),
        check(made, "suite", "findings", F.col("n") > 0, F.col("n")),
        check(kept, "suite", "registry_used", F.col("consulted"), F.col("n")),
    )


def locator_gate(journeys: DataFrame, element_best: DataFrame, resolution: DataFrame, stability: DataFrame, claims: DataFrame, min_rate: float = 0.8) -> DataFrame:
    """Steps resolve, a journey is executable, unresolved screens say why, screens keep their
    identity, no fragile locator is handed on, and claims hold (X4). ``journeys`` as of
    ``screens.journey_resolution``, ``claims`` as of ``screens.verified_claims``."""
    steps = journeys.groupBy("app_id").agg((F.sum("n_resolved") / F.sum("n_steps")).alias("rate"), F.count_if("executable").alias("n"), F.count("*").alias("n_all"))
    none = F.col("n_resolved") == 0
    told = sum(F.col(c) for c in ("n_no_candidate", "n_ambiguous", "n_fragile") if c in resolution.columns)
    screens = resolution.groupBy("app_id").agg(F.count_if(none).alias("n"), F.count_if(none & (told > 0)).alias("n_told"))
    level = F.create_map(*[F.lit(x) for item in STABILITY.items() for x in item])[F.col("strategy")]
    weak = element_best.groupBy("app_id").agg(F.count_if(level < USABLE).alias("n"))
    refuted = resolution.select("app_id").distinct().join(claims.groupBy("app_id").agg(F.count_if(F.col("status").isin("missing", "ambiguous")).alias("n")), "app_id", "left")
    return all_of(
        check(steps, "locators", "resolved", F.col("rate") >= min_rate, F.round("rate", 4)),
        check(steps, "locators", "executable", F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" of "), F.col("n_all").cast("string"))),
        check(screens, "locators", "diagnosed", (F.col("n") == 0) | (F.col("n_told") > 0), F.col("n_told")),
        check(stability, "locators", "identity", F.col("stability_pct") >= min_rate * 100, F.round("stability_pct", 2)),
        check(weak, "locators", "none_fragile", F.col("n") == 0, F.col("n")),
        check(refuted, "locators", "claims_hold", F.coalesce(F.col("n"), F.lit(0)) == 0, F.coalesce(F.col("n").cast("string"), F.lit("unverified"))),
    )


def run_gate(verdict_rows: DataFrame) -> DataFrame:
    """At least one test is validated."""
    n = verdict_rows.groupBy("app_id").agg(F.count_if(F.col("verdict") == "validated").alias("n"))
    return check(n, "runs", "validated", F.col("n") > 0, F.col("n"))


def outcome_gate(report: DataFrame, proposal: DataFrame, most_blind: float = 0.5) -> DataFrame:
    """Defects are attributed, precision and recall are defined, the blind spot is small, a proposal exists."""
    made = proposal.groupBy("app_id").agg(F.count("*").alias("n"))
    return all_of(
        check(report, "outcomes", "attributed", F.col("n_defects") > 0, F.col("n_defects")),
        check(report, "outcomes", "defined", F.col("precision").isNotNull() & F.col("recall").isNotNull(), F.round("precision", 3)),
        check(report, "outcomes", "blind_spot", F.col("blind_spot") <= most_blind, F.round("blind_spot", 3)),
        check(made, "outcomes", "proposal", F.col("n") > 0, F.col("n")),
    )


def foundation_gate(taxonomy_issues: DataFrame, readiness_verdict: DataFrame, apps: DataFrame, registry: DataFrame, baselines: DataFrame) -> DataFrame:
    """No taxonomy error, the instrumentation is ready, the registry is populated and fresh, and a
    baseline exists (X0). ``registry`` as of ``gaps.entries_by_category``; ``baselines``: app_id."""
    errors = _counted(apps, taxonomy_issues.where("severity = 'error'"))
    entries = apps.join(registry.groupBy("app_id").agg(F.sum("n_entries").alias("n"), F.sum("n_stale").alias("stale")), "app_id", "left").na.fill(0)
    taken = _counted(apps, baselines)
    return all_of(
        check(errors, "foundation", "taxonomy", F.col("n") == 0, F.col("n")),
        check(readiness_verdict, "foundation", "readiness", F.col("passed"), F.round("score", 1)),
        check(entries, "foundation", "registry", (F.col("n") > 0) & (F.col("stale") == 0), F.concat(F.col("n").cast("string"), F.lit(" entries, "), F.col("stale").cast("string"), F.lit(" stale"))),
        check(taken, "foundation", "baseline", F.col("n") > 0, F.col("n")),
    )


def portfolio_gate(portfolio_rows: DataFrame, drafts: DataFrame, least: int = 3) -> DataFrame:
    """Several apps have data, and a scaffold exists."""
    n = portfolio_rows.agg(F.count_if(F.col("health") != "no-data").alias("n")).select(F.lit("(all)").alias("app_id"), "n")
    made = drafts.agg(F.count("*").alias("n")).select(F.lit("(all)").alias("app_id"), "n")
    return all_of(check(n, "portfolio", "apps_with_data", F.col("n") >= least, F.col("n")), check(made, "portfolio", "scaffold", F.col("n") > 0, F.col("n")))
