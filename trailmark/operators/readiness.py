"""Readiness of an app's instrumentation, and the draft of its contract (Q9, Q10, Q13 to Q15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.functions.parsing import NAVIGATION, critical_screen, sensitivity, snake_case, title_case
from trailmark.operators.contract import taxonomy_issues
from trailmark.operators.privacy import flattened
from trailmark.operators.sessions import missing

#: dimension: weight. Sessions below ``BLOCKER`` fail the audit whatever the score.
WEIGHTS = {"screen_coverage": 0.25, "action_coverage": 0.15, "session_integrity": 0.20, "identity": 0.15, "naming": 0.15, "binding": 0.10}
BLOCKER, GATE = 80.0, 70.0
REQUIRED = 0.95


def _pct(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100, whole), F.lit(0.0))


def dimensions(events: DataFrame, screens: DataFrame) -> DataFrame:
    """(app_id, dimension, score, weight). ``screens``: declared (app_id, screen_id, bound)."""
    named = ~F.coalesce("event_name", F.lit("")).isin(*NAVIGATION)
    per_screen = events.where("screen_id IS NOT NULL").groupBy("app_id", "screen_id").agg(F.bool_or(named).alias("acted"), F.lit(True).alias("seen"))
    by_screen = screens.join(per_screen, ["app_id", "screen_id"], "left").groupBy("app_id").agg(
        _pct(F.count("seen"), F.count("*")).alias("screen_coverage"), _pct(F.count_if("acted"), F.count("seen")).alias("action_coverage"), _pct(F.count_if("bound"), F.count("*")).alias("binding")
    )
    arrival = W.partitionBy("app_id", "session_id").orderBy("read_order")
    back = F.coalesce(F.lag("timestamp").over(arrival) > F.col("timestamp"), F.lit(False))
    per_session = events.where(~missing("session_id")).withColumn("back", back).groupBy("app_id", "session_id").agg(F.bool_or("back").alias("back"), F.count_distinct(F.when(~missing("user_id"), F.col("user_id"))).alias("n_users"))
    by_session = per_session.groupBy("app_id").agg(_pct(F.count_if(~F.col("back")), F.count("*")).alias("ordered"), (100 - _pct(F.count_if(F.col("n_users") > 1), F.count_if(F.col("n_users") > 0))).alias("one_user"))
    presence = events.groupBy("app_id").agg(
        _pct(F.count_if(~missing("session_id")), F.count("*")).alias("with_session"),
        _pct(F.count_if(~missing("user_id")), F.count("*")).alias("with_user"),
        _pct(F.count_distinct(F.when(F.col("screen_id").isNotNull(), F.col("screen_tag"))), F.count_distinct("screen_tag")).alias("naming"),
    )
    wide = presence.join(by_screen, "app_id", "left").join(by_session, "app_id", "left")
    wide = wide.withColumns({"session_integrity": F.col("with_session") * 0.6 + F.coalesce("ordered", F.lit(0.0)) * 0.4, "identity": F.col("with_user") * 0.5 + F.coalesce("one_user", F.lit(0.0)) * 0.5})
    weight = F.create_map(*[F.lit(x) for item in WEIGHTS.items() for x in item])
    return wide.unpivot("app_id", list(WEIGHTS), "dimension", "score").withColumns({"score": F.coalesce("score", F.lit(0.0)), "weight": weight[F.col("dimension")]})


def verdict(dimension_rows: DataFrame) -> DataFrame:
    """Weighted score, blocker, and whether the gate is passed."""
    score = F.sum(F.col("score") * F.col("weight")) / F.sum("weight")
    blocked = F.bool_or((F.col("dimension") == "session_integrity") & (F.col("score") < BLOCKER))
    rows = dimension_rows.groupBy("app_id").agg(score.alias("score"), blocked.alias("blocked"))
    return rows.withColumn("passed", (F.col("score") >= GATE) & ~F.col("blocked"))


def remediation(dimension_rows: DataFrame) -> DataFrame:
    """Dimensions by what they cost, most first (Q10)."""
    cost = (100 - F.col("score")) * F.col("weight")
    ranked = W.partitionBy("app_id").orderBy(F.desc("cost"), "dimension")
    return dimension_rows.withColumn("cost", cost).withColumn("rank", F.row_number().over(ranked))


def draft_screens(events: DataFrame) -> DataFrame:
    """Tags by volume as draft screens with sensitivity and critical flag (Q13)."""
    tag = F.col("screen_tag")
    seen = events.where(~missing("screen_tag")).groupBy("app_id", "screen_tag").agg(F.count("*").alias("n_events"))
    level = sensitivity(tag)
    drafted = seen.withColumns({"screen_id": snake_case(tag), "display_name": title_case(tag), "sensitivity": level["level"], "reason": level["reason"], "critical": critical_screen(tag)})
    return drafted.withColumns({"occlusion_required": F.col("sensitivity") == "critical", "needs_review": F.col("sensitivity") != "low"})


def draft_properties(events: DataFrame) -> DataFrame:
    """(app_id, event_name, key, type, n, required): a type that all values fit, required from
    ``REQUIRED`` of the occurrences on (Q14)."""
    total = events.groupBy("app_id", "event_name").agg(F.count("*").alias("n_events"))
    leaves = flattened(events.select("app_id", "event_id", "event_name", "properties"), most=1).where("type <> 'VOID'")
    kind = F.when(F.bool_and(F.col("type") == "BOOLEAN"), "boolean").when(F.bool_and(F.col("type").rlike("^(BIGINT|INT|SMALLINT|TINYINT)")), "integer")
    kind = kind.when(F.bool_and(F.col("type").rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)")), "number").otherwise("string")
    grouped = leaves.groupBy("app_id", "event_name", "key").agg(kind.alias("type"), F.count("*").alias("n"))
    return grouped.join(total, ["app_id", "event_name"]).withColumn("required", F.col("n") >= F.col("n_events") * F.lit(REQUIRED)).drop("n_events")


def draft_events(events: DataFrame) -> DataFrame:
    """Events with the screens where they occur; ``*`` for navigation (Q14)."""
    grouped = events.groupBy("app_id", "event_name").agg(F.count("*").alias("n_events"), F.array_sort(F.collect_set("screen_tag")).alias("screens"))
    return grouped.withColumn("screens", F.when(F.col("event_name").isin(*NAVIGATION), F.array(F.lit("*"))).otherwise(F.col("screens")))


def unmapped_tags(events: DataFrame, k: int = 5) -> DataFrame:
    """The most frequent tags of each app that no screen declares, which its naming score lacks (Q9e)."""
    lost = events.where(~missing("screen_tag") & F.col("screen_id").isNull()).groupBy("app_id", "screen_tag").agg(F.count("*").alias("n_events"))
    place = F.row_number().over(W.partitionBy("app_id").orderBy(F.desc("n_events"), "screen_tag"))
    return lost.withColumn("rank", place).where(F.col("rank") <= k)


def predicted_errors(draft_screen_rows: DataFrame) -> DataFrame:
    """(app_id, rule, severity, subject): errors of the contract that the draft will show at once, as it
    can't know page objects (Q15)."""
    none = F.array().cast("array<string>")
    drafted = draft_screen_rows.select("app_id", "screen_id", F.lit("draft").alias("domain"), "sensitivity", "occlusion_required", "critical", F.array("screen_tag").alias("analytics_tags"), none.alias("page_objects"))
    return taxonomy_issues(drafted, drafted.select("app_id", "domain").distinct()).where("severity = 'error'")


def draft_summary(events: DataFrame) -> DataFrame:
    """What a draft found, and what it leaves open: events without a tag, errors to expect (Q15)."""
    screens, names = draft_screens(events), draft_events(events)
    seen = events.groupBy("app_id").agg(F.count("*").alias("n_events"), F.count_if(missing("screen_tag")).alias("n_unmapped"))
    errors = predicted_errors(screens).groupBy("app_id").agg(F.count("*").alias("n_errors"))
    return seen.join(review_effort(screens, names), "app_id", "left").join(errors, "app_id", "left").na.fill(0)


def review_effort(draft_screen_rows: DataFrame, draft_event_rows: DataFrame) -> DataFrame:
    """Items to review and the hours they take: two, a tenth for each, a fiftieth for each event (Q15)."""
    screens = draft_screen_rows.groupBy("app_id").agg(F.count("*").alias("n_screens"), F.count_if("needs_review").alias("n_review"))
    events = draft_event_rows.groupBy("app_id").agg(F.count("*").alias("n_event_names"))
    return screens.join(events, "app_id", "left").withColumn("hours", F.lit(2.0) + F.col("n_review") * 0.1 + F.coalesce("n_event_names", F.lit(0)) * 0.02)
