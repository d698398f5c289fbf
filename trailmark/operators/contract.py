"""Tracking-plan conformance and the plan's and taxonomy's own checks.

``plan_events``: (app_id, name, screens array; ``*`` is any). ``plan_properties``: (app_id, event,
name, type, required); a null event holds for all. ``screens``: (app_id, ord, screen_id, domain,
sensitivity, occlusion_required, critical, analytics_tags, page_objects).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = {
    "string": "^STRING",
    "integer": "^(BIGINT|INT|SMALLINT|TINYINT)",
    "number": "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)",
    "boolean": "^BOOLEAN",
    "timestamp": "^(TIMESTAMP|STRING|BIGINT)",
}


def judged(events: DataFrame, plan_events: DataFrame, plan_properties: DataFrame, strict: bool = False) -> DataFrame:
    """``events`` with ``violations``, an array of (violation, detail) that is empty if the event
    keeps to the plan; ``properties`` is JSON.

    The plan is joined as two tables by event, so this holds for a stream of events as well.
    """
    plan = plan_events.select("app_id", F.col("name").alias("event_name"), F.lit(1).alias("__known"), F.col("screens").alias("__screens"))
    # A common property is one of each event, so that a single equi-join serves both.
    common = plan_properties.where("event IS NULL").drop("event").join(plan_events.select("app_id", F.col("name").alias("event")), "app_id")
    expected = plan_properties.where("event IS NOT NULL").unionByName(common).select("app_id", F.col("event").alias("event_name"), F.struct(F.col("name").alias("__name"), F.col("type").alias("__type"), F.col("required").alias("__required")).alias("p"))
    listed = expected.groupBy("app_id", "event_name").agg(F.collect_list("p").alias("__expected"))
    rows = events.join(plan, ["app_id", "event_name"], "left").join(listed, ["app_id", "event_name"], "left")
    bag = F.coalesce(F.try_variant_get(F.try_parse_json("properties"), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    kinds = F.create_map(*[F.lit(x) for item in TYPES.items() for x in item])
    known = F.col("__known").isNotNull()

    def one(violation: str, detail: Column) -> Column:
        return F.struct(F.lit(violation).alias("violation"), detail.alias("detail"))

    def of_property(p: Column) -> Column:
        value = F.try_element_at(F.col("__map"), p["__name"])
        kind = F.schema_of_variant(value)
        absent = value.isNull() | (kind == "VOID")
        return F.when(absent & p["__required"], one("missing_property", p["__name"])).when(~absent & ~F.regexp_like(kind, kinds[p["__type"]]), one("type_mismatch", p["__name"]))

    none = F.array().cast("array<struct<violation:string,detail:string>>")
    nothing = F.array().cast("array<struct<__name:string,__type:string,__required:boolean>>")
    rows = rows.withColumns({"__map": bag, "__expected": F.coalesce("__expected", nothing)})
    wrong = F.col("screen_id").isNotNull() & ~F.array_contains("__screens", F.lit("*")) & ~F.array_contains("__screens", F.col("screen_id"))
    found = [F.when(F.coalesce(wrong, F.lit(False)), F.array(one("wrong_screen", F.col("screen_id")))).otherwise(none), F.filter(F.transform("__expected", of_property), lambda x: x.isNotNull())]
    if strict:
        extra = F.array_except(F.map_keys("__map"), F.transform("__expected", lambda x: x["__name"]))
        found.append(F.transform(extra, lambda x: one("undeclared_property", x)))
    all_found = F.when(known, F.concat(*found)).otherwise(F.array(one("unknown_event", F.lit(""))))
    return rows.withColumn("violations", all_found).drop("__known", "__screens", "__expected", "__map")


def violations(events: DataFrame, plan_events: DataFrame, plan_properties: DataFrame, strict: bool = False) -> DataFrame:
    """(app_id, event_id, event_name, violation, detail) of each event; ``properties`` is JSON."""
    rows = judged(events.select("app_id", "event_id", "event_name", "screen_id", "properties"), plan_events, plan_properties, strict)
    return rows.select("app_id", "event_id", "event_name", F.explode("violations").alias("v")).select("app_id", "event_id", "event_name", "v.*")


def conformance(events: DataFrame, violation_rows: DataFrame) -> DataFrame:
    """Events, offending ones (each once), and conformance in per cent."""
    offending = violation_rows.groupBy("app_id").agg(F.count_distinct("event_id").alias("n_offending"))
    total = events.groupBy("app_id").agg(F.count("*").alias("n_events"))
    rows = total.join(offending, "app_id", "left").na.fill(0, ["n_offending"])
    return rows.withColumn("conformance_pct", (F.col("n_events") - F.col("n_offending")) * 100 / F.col("n_events"))


def _issues(rows: DataFrame, rule: str, severity: str, subject: str) -> DataFrame:
    return rows.select("app_id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(subject).cast("string").alias("subject"))


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy("app_id", *keys).agg(F.count("*").alias("n")).where("n > 1")


def plan_issues(plan_events: DataFrame, plan_properties: DataFrame) -> DataFrame:
    """Duplicate events and properties, redefined common properties, restricted navigation (Q6), and
    names that aren't in snake case (Q8b)."""
    common = plan_properties.where("event IS NULL").select("app_id", "name")
    own = plan_properties.where("event IS NOT NULL")
    parts = [
        _issues(_repeated(plan_events, "name"), "duplicate_event", "error", "name"),
        _issues(_repeated(own, "event", "name"), "duplicate_property", "error", "name"),
        _issues(own.join(common, ["app_id", "name"], "left_semi"), "redefined_common_property", "error", "name"),
        _issues(plan_events.where((F.col("name") == "screen_view") & ~F.array_contains("screens", F.lit("*"))), "restricted_screen_view", "warning", "name"),
        _issues(plan_events.where(~F.col("name").rlike("^[a-z][a-z0-9_]*$")), "name_format", "error", "name"),
        _issues(plan_properties.where(~F.col("name").rlike("^[a-z][a-z0-9_]*$")), "property_format", "error", "name"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def taxonomy_issues(screens: DataFrame, domains: DataFrame) -> DataFrame:
    """The taxonomy's contract."""
    tags = screens.select("app_id", "screen_id", F.explode_outer("analytics_tags").alias("tag"))
    objects = screens.select("app_id", "screen_id", F.explode_outer("page_objects").alias("page_object"))
    bare = F.col("critical") & (F.size("page_objects") == 0)
    parts = [
        _issues(_repeated(screens, "screen_id"), "unique_id", "error", "screen_id"),
        _issues(_repeated(tags.where("tag IS NOT NULL"), "tag"), "unique_tag", "error", "tag"),
        _issues(_repeated(objects.where("page_object IS NOT NULL"), "page_object"), "unique_page_object", "error", "page_object"),
        _issues(screens.join(domains, ["app_id", "domain"], "left_anti"), "known_domain", "error", "screen_id"),
        _issues(screens.where((F.col("sensitivity") == "critical") & ~F.col("occlusion_required")), "occlusion", "error", "screen_id"),
        _issues(screens.where(F.size("analytics_tags") == 0), "observable", "error", "screen_id"),
        _issues(screens.where(bare), "automatable", "error", "screen_id"),
        _issues(screens.where(~F.col("critical") & (F.size("page_objects") == 0)), "automatable", "warning", "screen_id"),
        _issues(screens.where(~F.col("screen_id").rlike("^[a-z][a-z0-9_]*$")), "id_format", "error", "screen_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _parts_of_hash(content: Column) -> list[Column]:
    """Four numbers of 60 bits of the content's hash, as decimals that add up without loss."""
    digest = F.sha2(content, 256)
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]


def taxonomy_summary(screens: DataFrame) -> DataFrame:
    """Counts, and a fingerprint that doesn't depend on any order (Q8).

    The fingerprint is the hash of the sums of the screens' hashes, which partitions add up; screens
    that are declared twice count twice. ``platform`` counts if the screens have one.
    """
    lists = [F.array_join(F.array_sort(c), ",") for c in ("analytics_tags", "page_objects")]
    platform = [F.coalesce("platform", F.lit(""))] if "platform" in screens.columns else []
    content = F.concat_ws("|", "screen_id", *lists, *platform)
    sums = [F.sum(x).cast("string") for x in _parts_of_hash(content)]
    return screens.groupBy("app_id").agg(
        F.count("*").alias("n_screens"),
        F.count_if("critical").alias("n_critical"),
        F.count_if(F.size("page_objects") > 0).alias("n_bound"),
        F.left(F.sha2(F.concat_ws("|", *sums), 256), F.lit(16)).alias("fingerprint"),
    )
