"""What came of it: escaped defects, tuning, test runs, governance, baselines, portfolio
(J14, J18, K10, L14, O1 to O7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COMPONENTS = ("frequency", "business_value", "risk", "exposure")
HIT = 0.5
MIN_EVIDENCE, STEP, MAX_STEP, MIN_WEIGHT = 10, 0.2, 0.05, 0.05
MIN_PROFILES = 3
# Which way each baseline metric is better.
HIGHER_IS_BETTER = {
    "automated_coverage_pct": True,
    "golden_journey_coverage_pct": True,
    "escaped_defects_per_release": False,
    "mean_time_to_detect_hours": False,
    "regression_suite_runtime_minutes": False,
    "flaky_test_pct": False,
    "manual_authoring_hours_per_sprint": False,
    "total_test_count": True,
}


def _ratio(a: Column, b: Column) -> Column:
    """a / b, null where undefined."""
    return F.try_divide(a, b)


def attributed(defects: DataFrame, journeys: DataFrame) -> DataFrame:
    """Each defect with its origin (J14). ``journeys``: (app_id, journey_id, coverage)."""
    rows = defects.join(journeys.select("app_id", "journey_id", "coverage", F.lit(True).alias("golden")), ["app_id", "journey_id"], "left")
    origin = F.when(F.coalesce("journey_id", F.lit("")) == "", "out_of_scope").when(F.col("golden").isNull(), "unknown_journey").when(F.col("coverage") >= 1, "covered_but_missed").otherwise("uncovered_gap")
    return rows.withColumn("origin", origin).drop("golden")


def outcome_report(attributed_rows: DataFrame, gap_outcomes: DataFrame) -> DataFrame:
    """Precision, recall and blind spot, null where undefined, and when the first and the last defect
    were detected (O1). ``gap_outcomes``: (app_id, journey_id, closed_by_test, caused_defect)."""
    of = lambda x: F.count_if(F.col("origin") == x)
    window = [f("detected_at").alias(f"window_{x}") for f, x in ((F.min, "start"), (F.max, "end"))] if "detected_at" in attributed_rows.columns else []
    a = attributed_rows.groupBy("app_id").agg(of("uncovered_gap").alias("n_gap"), of("covered_but_missed").alias("n_missed"), of("unknown_journey").alias("n_unknown"), of("out_of_scope").alias("n_out"), F.count("*").alias("n_defects"), *window)
    caused = F.coalesce(F.col("caused_defect"), F.lit(False))
    closed = F.col("closed_by_test").isNotNull()
    b = gap_outcomes.groupBy("app_id").agg(F.count_if(caused).alias("true_positives"), F.count_if(~caused & closed).alias("false_positives"), F.count_if(~caused & ~closed).alias("unresolved"))
    rows = a.join(b, "app_id", "full_outer").na.fill(0)
    missed = F.col("n_missed") + F.col("n_unknown")
    in_scope = F.col("n_defects") - F.col("n_out")
    return rows.withColumns(
        {"false_negatives": missed, "precision": _ratio(F.col("true_positives"), F.col("true_positives") + F.col("false_positives")), "recall": _ratio(F.col("true_positives"), F.col("true_positives") + missed), "blind_spot": _ratio(F.col("n_unknown"), in_scope)}
    )


def hit_rates(attributed_rows: DataFrame, scores: DataFrame) -> DataFrame:
    """How often each score component saw an in-scope defect's journey (O2). ``scores``: app_id,
    journey_id and the components."""
    rows = attributed_rows.where("origin <> 'out_of_scope'").join(scores, ["app_id", "journey_id"])
    long = rows.select("app_id", *COMPONENTS).unpivot("app_id", list(COMPONENTS), "component", "value")
    return long.groupBy("app_id", "component").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= HIT).alias("n_seen"), (F.count_if(F.col("value") >= HIT) / F.count("*")).alias("hit_rate"))


def weight_proposal(rates: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weights moved toward components that saw more, by bounded steps; none on thin evidence (O3)."""
    now = F.create_map(*[F.lit(x) for item in weights.items() for x in item])[F.col("component")]
    mean = F.avg("hit_rate").over(W.partitionBy("app_id"))
    delta = F.greatest(F.lit(-MAX_STEP), F.least(F.lit(MAX_STEP), (F.col("hit_rate") - mean) * STEP))
    enough = F.col("n") >= MIN_EVIDENCE
    rows = rates.withColumn("weight", now).withColumn("delta", F.when(enough, delta).otherwise(0.0))
    proposed = F.when(enough, F.greatest(F.lit(MIN_WEIGHT), F.col("weight") + F.col("delta"))).otherwise(F.col("weight"))
    return rows.withColumns({"proposed": proposed, "evidence": F.when(enough, "enough").otherwise("insufficient")})


def run_verdicts(runs: DataFrame, min_profiles: int = MIN_PROFILES) -> DataFrame:
    """validated, failed, flaky or unvalidated for each test over its executed runs."""
    done = F.col("executed")
    rows = runs.groupBy("app_id", "test_name").agg(
        F.count_if(done).alias("n_runs"), F.count_if(done & F.col("passed")).alias("n_passed"), F.count_distinct(F.when(done, F.col("profile"))).alias("n_profiles"), F.round(F.avg(F.when(done, F.col("duration_s"))), 2).alias("mean_duration_s")
    )
    verdict = F.when((F.col("n_runs") == 0) | (F.col("n_profiles") < min_profiles), "unvalidated").when(F.col("n_passed") == F.col("n_runs"), "validated").when(F.col("n_passed") == 0, "failed").otherwise("flaky")
    return rows.withColumns({"pass_rate": _ratio(F.col("n_passed"), F.col("n_runs")), "verdict": verdict})


def validation_summary(verdict_rows: DataFrame) -> DataFrame:
    """Tests by verdict, and the share that validated at the first attempt, in per cent."""
    of = lambda verdict: F.count_if(F.col("verdict") == verdict)
    figures = [of(v).alias(f"n_{v}") for v in ("validated", "failed", "flaky", "unvalidated")]
    return verdict_rows.groupBy("app_id").agg(F.count("*").alias("n_generated"), *figures, F.round(of("validated") * 100 / F.count("*"), 1).alias("first_attempt_pass_rate"))


def lineage_from_runs(runs: DataFrame, provenance: DataFrame, reviews: DataFrame, as_of: Column) -> DataFrame:
    """A lineage row for each test that was run.

    ``provenance``: app_id, artifact_id, journey_id, sessions, taxonomy_fingerprint,
    locator_sources, generator, model, prompt, created_at; of several for a test the last counts, and
    the prompt is kept as its hash. ``reviews``: app_id, artifact_id, reviewed_at, review_id,
    review_decision, reviewer, rejection_reason; the last one up to ``as_of`` counts, and without
    one the test is pending.
    """
    key = ["app_id", "artifact_id"]
    tests = runs.groupBy("app_id", F.col("test_name").alias("artifact_id")).agg(F.count_if("executed").alias("validation_runs"), F.array_sort(F.collect_set("profile")).alias("validation_profiles"))
    told = [c for c in provenance.columns if c not in (*key, "prompt")]
    known = provenance.withColumn("prompt_hash", prompt_hash(F.col("prompt"))).groupBy(*key).agg(F.max_by(F.struct(*told, "prompt_hash"), "created_at").alias("p")).select(*key, "p.*")
    said = ("review_decision", "reviewer", "reviewed_at", "rejection_reason")
    judged = reviews.where(F.col("reviewed_at") <= as_of).groupBy(*key).agg(F.max_by(F.struct(*said), F.struct("reviewed_at", "review_id")).alias("r")).select(*key, "r.*")
    rows = tests.join(known, key, "left").join(judged, key, "left")
    return rows.withColumns({"artifact_type": F.lit("test"), "review_decision": F.coalesce("review_decision", F.lit("pending"))})


def append_lineage(rows: DataFrame, path: str) -> None:
    """Add records to the log; what is there stays."""
    rows.write.mode("append").parquet(path)


def complete() -> Column:
    """Whether a record tells why its test exists."""
    named = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("journey_id", "generator", "taxonomy_fingerprint")]
    return named[0] & named[1] & named[2]


def lineage_summary(lineage: DataFrame) -> DataFrame:
    """Reviews and acceptance of generated artefacts (O4). An approval needs a reviewer; the
    acceptance rate is that of all records."""
    decision = F.col("review_decision")
    approved = F.count_if((decision == "approved") & (F.coalesce("reviewer", F.lit("")) != ""))
    return lineage.groupBy("app_id").agg(
        F.count("*").alias("n"), F.count_if(complete()).alias("n_complete"), approved.alias("n_approved"), F.count_if(decision == "rejected").alias("n_rejected"), F.count_if(decision == "pending").alias("n_pending"), F.round(approved / F.count("*"), 3).alias("acceptance_rate")
    )


def rejection_themes(lineage: DataFrame) -> DataFrame:
    """Rejections by reason; a blank one is unspecified."""
    reason = F.coalesce(F.nullif(F.lower(F.trim("rejection_reason")), F.lit("")), F.lit("unspecified"))
    return lineage.where("review_decision = 'rejected'").groupBy("app_id", reason.alias("theme")).agg(F.count("*").alias("n"))


def prompt_hash(prompt: Column) -> Column:
    return F.left(F.sha2(prompt, 256), F.lit(16))


def costs(usage: DataFrame, rates: dict[str, float]) -> DataFrame:
    """Cost of each use (category, unit, units), by the rate of its unit."""
    rate = F.create_map(*[F.lit(x) for item in rates.items() for x in item])[F.col("unit")]
    return usage.withColumn("cost", F.col("units") * F.coalesce(rate, F.lit(0.0)))


def cost_summary(cost_rows: DataFrame) -> DataFrame:
    """Cost by category, and for each artefact."""
    rows = cost_rows.groupBy("app_id", "category").agg(F.sum(F.col("cost").cast("decimal(28,6)")).alias("total"), F.count_distinct("artifact_id").alias("n_artifacts"))
    return rows.withColumns({"total": F.col("total").cast("double"), "per_artifact": _ratio(F.col("total").cast("double"), F.col("n_artifacts"))})


def baseline_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(app_id, metric, before, after, delta, delta_pct, improved) of two snapshots (J18, O6). An
    app that only one side has is an error."""
    names = [c for c in HIGHER_IS_BETTER if c in before.columns and c in after.columns]
    long = [df.select("app_id", *[F.col(c).cast("double").alias(c) for c in names]).unpivot("app_id", names, "metric", side) for df, side in ((before, "before"), (after, "after"))]
    rows = long[0].withColumn("__b", F.lit(1)).join(long[1].withColumn("__a", F.lit(1)), ["app_id", "metric"], "full_outer")
    message = F.concat(F.lit("no counterpart for app "), F.col("app_id"))
    agreed = F.when(F.col("__b").isNull() | F.col("__a").isNull(), F.raise_error(message).cast("string")).otherwise(F.col("app_id"))
    better = F.create_map(*[F.lit(x) for item in HIGHER_IS_BETTER.items() for x in item])[F.col("metric")]
    delta = F.col("after") - F.col("before")
    improved = F.when(F.col("delta") == 0, F.lit(None)).otherwise((F.col("delta") > 0) == better)
    rows = rows.select(agreed.alias("app_id"), "metric", "before", "after", delta.alias("delta"))
    return rows.withColumns({"delta_pct": _ratio(F.col("delta") * 100, F.col("before")), "improved": improved})


def with_checksum(snapshots: DataFrame) -> DataFrame:
    """Snapshots with a checksum over the metrics, not the notes."""
    names = sorted(c for c in snapshots.columns if c not in ("notes", "checksum"))
    return snapshots.withColumn("checksum", F.sha2(F.to_json(F.struct(*names)), 256))


def save_snapshots(snapshots: DataFrame, path: str) -> None:
    """Append snapshots; one that exists for its app and release is an error."""
    from trailmark.operators.ingest import exists

    spark: SparkSession = snapshots.sparkSession
    rows = with_checksum(snapshots)
    if exists(spark, path):
        held = spark.read.parquet(path).select("app_id", "release_version", F.lit(True).alias("__held"))
        rows = rows.join(held, ["app_id", "release_version"], "left")
        message = F.concat(F.lit("a snapshot exists for "), "app_id", F.lit(" "), "release_version")
        rows = rows.withColumn("app_id", F.when(F.col("__held"), F.raise_error(message).cast("string")).otherwise(F.col("app_id"))).drop("__held")
    rows.write.mode("append").parquet(path)


def load_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots whose checksums still fit; a damaged one is an error."""
    rows = spark.read.parquet(path)
    names = sorted(c for c in rows.columns if c not in ("notes", "checksum"))
    good = F.sha2(F.to_json(F.struct(*names)), 256) == F.col("checksum")
    message = F.concat(F.lit("damaged snapshot of "), "app_id")
    return rows.withColumn("app_id", F.when(good, F.col("app_id")).otherwise(F.raise_error(message).cast("string")))


def portfolio(apps: DataFrame) -> DataFrame:
    """Health of each app, defects against its own baseline, days to go live (O7). ``apps``: app_id,
    status, coverage_pct, critical_gaps, escaped_defects, baseline_defects, onboarded_on, live_on."""
    health = (
        F.when(F.col("status") != "active", F.col("status")).when(F.col("coverage_pct").isNull(), "no-data").when((F.col("critical_gaps") > 0) | (F.col("coverage_pct") < 50), "at-risk").otherwise("healthy")
    )
    change = F.try_divide((F.col("escaped_defects") - F.col("baseline_defects")) * 100, F.nullif(F.col("baseline_defects"), F.lit(0)))
    return apps.withColumns({"health": health, "defect_delta_pct": F.round(change, 1), "onboarding_days": F.datediff("live_on", "onboarded_on")})


def weakest(portfolio_rows: DataFrame, k: int = 3) -> DataFrame:
    """The k active apps with the lowest coverage; apps without data first."""
    active = portfolio_rows.where("status = 'active'")
    return active.orderBy(F.col("coverage_pct").asc_nulls_first(), "app_id").limit(k)
