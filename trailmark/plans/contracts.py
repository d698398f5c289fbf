"""Queries on contract, readiness, onboarding and personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import contract, privacy, readiness
from trailmark.sources import driver

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def plan(spark, sf_dir):
    """A plan read off the data itself: purchases belong to their screen, errors are not declared."""
    names = driver.events(spark, sf_dir).where("event_name <> 'error'").select("app_id", F.col("event_name").alias("name")).distinct()
    events = names.withColumn("screens", F.when(F.col("name") == "signup", F.array(F.lit("welcome"))).otherwise(F.array(F.lit("*"))))
    properties = names.where("name IN ('click', 'purchase')").select("app_id", F.col("name").alias("event"), F.lit("k").alias("name"), F.when(F.col("name") == "click", "integer").otherwise("string").alias("type"), F.lit(True).alias("required"))
    return events, properties


VIOLATIONS = """v AS (SELECT event_id, event_type, 'unknown_event' AS violation, '' AS detail FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, event_type, 'wrong_screen', event_type FROM events WHERE event_type = 'signup'
UNION ALL SELECT event_id, event_type, 'type_mismatch', 'k' FROM events WHERE event_type = 'purchase' AND props LIKE '%"k"%' UNION ALL SELECT event_id, event_type, 'missing_property', 'k' FROM events WHERE event_type IN ('click', 'purchase') AND props NOT LIKE '%"k"%')"""


@query(f"WITH {VIOLATIONS} SELECT event_id, event_type AS event_name, violation, detail FROM v")
def q_violations(spark, sf_dir):
    return contract.violations(driver.events(spark, sf_dir), *plan(spark, sf_dir)).drop("app_id")


@query(f"WITH {VIOLATIONS}, n AS (SELECT (SELECT count(*) FROM events) AS n_events, (SELECT count(DISTINCT event_id) FROM v) AS n_offending) SELECT *, (n_events - n_offending) * 100 / n_events AS conformance_pct FROM n")
def q_conformance(spark, sf_dir):
    rows = driver.events(spark, sf_dir)
    return contract.conformance(rows, contract.violations(rows, *plan(spark, sf_dir))).drop("app_id")


def part_screens(spark, sf_dir):
    """Parts as declared screens."""
    rows = driver.table(spark, sf_dir, "part")
    return rows.select(
        F.lit("demo").alias("app_id"), F.col("p_partkey").alias("ord"), F.concat(F.lit("part_"), (F.col("p_partkey") % 1900).cast("string")).alias("screen_id"), F.col("p_brand").alias("domain"),
        F.when(F.col("p_size") > 40, "critical").otherwise("low").alias("sensitivity"), (F.col("p_size") % 2 == 0).alias("occlusion_required"), (F.col("p_size") > 45).alias("critical"),
        F.when(F.col("p_size") % 10 > 0, F.array(F.concat(F.lit("tag_"), F.col("p_partkey").cast("string")))).otherwise(F.array().cast("array<string>")).alias("analytics_tags"),
        F.when(F.col("p_size") % 3 > 0, F.array(F.concat(F.lit("po_"), (F.col("p_partkey") % 1950).cast("string")))).otherwise(F.array().cast("array<string>")).alias("page_objects"),
    )


@query("""WITH s AS (SELECT 'part_' || (p_partkey % 1900) AS screen_id, p_brand AS domain, p_size, 'po_' || (p_partkey % 1950) AS po FROM part)
SELECT 'unique_id' AS rule, 'error' AS severity, screen_id AS subject FROM s GROUP BY screen_id HAVING count(*) > 1
UNION ALL SELECT 'unique_page_object', 'error', po FROM s WHERE p_size % 3 > 0 GROUP BY po HAVING count(*) > 1
UNION ALL SELECT 'known_domain', 'error', screen_id FROM s WHERE domain NOT LIKE '%1'
UNION ALL SELECT 'occlusion', 'error', screen_id FROM s WHERE p_size > 40 AND p_size % 2 = 1 UNION ALL SELECT 'observable', 'error', screen_id FROM s WHERE p_size % 10 = 0
UNION ALL SELECT 'automatable', CASE WHEN p_size > 45 THEN 'error' ELSE 'warning' END, screen_id FROM s WHERE p_size % 3 = 0""")
def q_taxonomy_issues(spark, sf_dir):
    screens = part_screens(spark, sf_dir)
    domains = screens.where("domain LIKE '%1'").select("app_id", "domain").distinct()
    return contract.taxonomy_issues(screens, domains).drop("app_id")


HASHED = ", ".join(f"sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS HUGEINT))" for i in range(4))


@query(f"""WITH s AS (SELECT sha256(concat_ws('|', 'part_' || (p_partkey % 1900), CASE WHEN p_size % 10 > 0 THEN 'tag_' || p_partkey ELSE '' END, CASE WHEN p_size % 3 > 0 THEN 'po_' || (p_partkey % 1950) ELSE '' END)) AS h, * FROM part)
SELECT count(*) AS n_screens, count(*) FILTER (p_size > 45) AS n_critical, count(*) FILTER (p_size % 3 > 0) AS n_bound, left(sha256(concat_ws('|', {HASHED})), 16) AS fingerprint FROM s""")
def q_taxonomy_summary(spark, sf_dir):
    return contract.taxonomy_summary(part_screens(spark, sf_dir)).drop("app_id")


def order_plan(spark, sf_dir):
    """Orders as plan rows, with names that repeat."""
    rows = driver.table(spark, sf_dir, "orders")
    name = F.concat(F.lit("e_"), (F.col("o_orderkey") % 9000).cast("string"))
    events = rows.select(F.lit("demo").alias("app_id"), name.alias("name"), F.array(F.lit("*")).alias("screens"))
    properties = rows.select(F.lit("demo").alias("app_id"), F.when(F.col("o_custkey") % 100 > 0, name).alias("event"), F.concat(F.when(F.col("o_custkey") % 97 == 5, "P-").otherwise("p_"), F.col("o_custkey").cast("string")).alias("name"), F.lit("string").alias("type"), F.lit(True).alias("required"))
    return events, properties


@query("""WITH p AS (SELECT CASE WHEN o_custkey % 100 > 0 THEN 'e_' || (o_orderkey % 9000) END AS event, CASE WHEN o_custkey % 97 = 5 THEN 'P-' ELSE 'p_' END || o_custkey AS name FROM orders)
SELECT 'duplicate_event' AS rule, 'error' AS severity, 'e_' || (o_orderkey % 9000) AS subject FROM orders GROUP BY 3 HAVING count(*) > 1
UNION ALL SELECT 'duplicate_property', 'error', name FROM p WHERE event IS NOT NULL GROUP BY event, name HAVING count(*) > 1
UNION ALL SELECT 'property_format', 'error', name FROM p WHERE name LIKE 'P-%'
UNION ALL SELECT 'redefined_common_property', 'error', name FROM p WHERE event IS NOT NULL AND name IN (SELECT name FROM p WHERE event IS NULL)""")
def q_plan_issues(spark, sf_dir):
    return contract.plan_issues(*order_plan(spark, sf_dir)).drop("app_id")


def declared(spark, sf_dir):
    seen = driver.events(spark, sf_dir).select("app_id", "screen_id").distinct()
    return seen.withColumn("bound", F.col("screen_id") != "error")


READINESS = """WITH b AS (SELECT user_id, bool_or(coalesce(back, false)) AS back FROM (SELECT user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) > ts AS back FROM events) GROUP BY user_id),
d(dimension, score, weight) AS (SELECT 'screen_coverage', 100.0, 0.25 UNION ALL SELECT 'action_coverage', 100.0, 0.15 UNION ALL SELECT 'session_integrity', 60 + 0.4 * (SELECT count(*) FILTER (NOT back) * 100 / count(*) FROM b), 0.2
UNION ALL SELECT 'identity', 100.0, 0.15 UNION ALL SELECT 'naming', 100.0, 0.15 UNION ALL SELECT 'binding', (SELECT count(DISTINCT event_type) FILTER (event_type <> 'error') * 100 / count(DISTINCT event_type) FROM events), 0.1)"""


@query(f"{READINESS} SELECT dimension, round(score, 6) AS score, CAST(weight AS DOUBLE) AS weight, round((100 - score) * weight, 6) AS cost, CAST(row_number() OVER (ORDER BY (100 - score) * weight DESC, dimension) AS INTEGER) AS rank FROM d")
def q_readiness(spark, sf_dir):
    rows = readiness.remediation(readiness.dimensions(driver.events(spark, sf_dir), declared(spark, sf_dir)))
    return rows.select("dimension", F.round("score", 6).alias("score"), "weight", F.round("cost", 6).alias("cost"), "rank")


@query(f"{READINESS} SELECT round(sum(score * weight) / sum(weight), 6) AS score, bool_or(dimension = 'session_integrity' AND score < 80) AS blocked, sum(score * weight) / sum(weight) >= 70 AND NOT bool_or(dimension = 'session_integrity' AND score < 80) AS passed FROM d")
def q_readiness_verdict(spark, sf_dir):
    rows = readiness.verdict(readiness.dimensions(driver.events(spark, sf_dir), declared(spark, sf_dir)))
    return rows.select(F.round("score", 6).alias("score"), "blocked", "passed")


@query("SELECT event_type AS screen_tag, count(*) AS n_events, CASE event_type WHEN 'signup' THEN 'critical' ELSE 'low' END AS sensitivity, event_type = 'signup' AS critical FROM events GROUP BY event_type")
def q_scaffold_screens(spark, sf_dir):
    return readiness.draft_screens(driver.events(spark, sf_dir)).select("screen_tag", "n_events", "sensitivity", "critical")


@query("SELECT event_type AS event_name, 'k' AS key, 'integer' AS type, count(*) AS n, true AS required FROM events GROUP BY event_type")
def q_scaffold_events(spark, sf_dir):
    return readiness.draft_properties(driver.events(spark, sf_dir)).drop("app_id")


@query("SELECT count(DISTINCT event_type) AS n_screens, count(DISTINCT event_type) FILTER (event_type = 'signup') AS n_review, count(DISTINCT event_type) AS n_event_names, round(2 + 0.1 * count(DISTINCT event_type) FILTER (event_type = 'signup') + 0.02 * count(DISTINCT event_type), 6) AS hours FROM events")
def q_review_effort(spark, sf_dir):
    rows = driver.events(spark, sf_dir)
    return readiness.review_effort(readiness.draft_screens(rows), readiness.draft_events(rows)).select("n_screens", "n_review", "n_event_names", F.round("hours", 6).alias("hours"))


def tagged(spark, sf_dir):
    """Events of which some have no tag, and some a tag that no screen declares."""
    rows = driver.events(spark, sf_dir)
    kind = F.col("event_id") % 10
    return rows.withColumns({"screen_tag": F.when(kind == 3, None).when(kind == 4, F.concat(F.lit("lost_"), F.col("event_id") % 90)).otherwise(F.col("screen_tag")), "screen_id": F.when(kind > 4, F.col("screen_id"))})


TAGGED = "t AS (SELECT event_type AS event_name, CASE event_id % 10 WHEN 3 THEN NULL WHEN 4 THEN 'lost_' || (event_id % 90) ELSE event_type END AS tag, event_id % 10 > 4 AS mapped FROM events)"


@query(f"WITH {TAGGED} SELECT tag AS screen_tag, count(*) AS n_events, CAST(row_number() OVER (ORDER BY count(*) DESC, tag) AS INTEGER) AS rank FROM t WHERE tag IS NOT NULL AND NOT mapped GROUP BY tag QUALIFY rank <= 5")
def q_unmapped_tags(spark, sf_dir):
    return readiness.unmapped_tags(tagged(spark, sf_dir)).drop("app_id")


@query(f"""WITH {TAGGED}, s AS (SELECT DISTINCT tag FROM t WHERE tag IS NOT NULL), n AS (SELECT count(*) AS n_screens, count(*) FILTER (tag = 'signup') AS n_review FROM s)
SELECT (SELECT count(*) FROM t) AS n_events, (SELECT count(*) FROM t WHERE tag IS NULL) AS n_unmapped, n_screens, n_review, (SELECT count(DISTINCT event_name) FROM t) AS n_event_names, n_review AS n_errors,
round(2 + 0.1 * n_review + 0.02 * (SELECT count(DISTINCT event_name) FROM t), 6) AS hours FROM n""")
def q_draft_summary(spark, sf_dir):
    """What a draft finds and leaves open; its critical screen has no page object yet."""
    return readiness.draft_summary(tagged(spark, sf_dir)).drop("app_id").withColumn("hours", F.round("hours", 6))


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]{2,}')) AS x, 'email' AS kind FROM documents
UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:bearer\s+[\p{L}\p{N}_.-]{20,}|eyJ[\p{L}\p{N}_-]{10,}\.[\p{L}\p{N}_-]{10,}|(?:api[_-]?key|token|secret|password)\s*[=:]\s*\S{8,})')), 'credential' FROM documents)
SELECT doc_id, kind, '<redacted len=' || length(x) || ' sha=' || substr(sha256(x), 1, 8) || '>' AS sample FROM t""")
def q_pii_texts(spark, sf_dir):
    """Addresses and credentials in documents, redacted."""
    found = driver.table(spark, sf_dir, "documents").select("doc_id", F.explode(privacy.findings(F.col("text"))).alias("f")).select("doc_id", "f.*")
    return found.where("kind IN ('email', 'credential')")


@query()
def q_pii_scan(spark, sf_dir):
    """All kinds in documents and conversations."""
    texts = driver.table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), "text").union(driver.table(spark, sf_dir, "conversations").select(F.lit("conversations"), "text"))
    return texts.select("origin", F.explode(privacy.findings(F.col("text"))).alias("f")).groupBy("origin", "f.kind").agg(F.count("*").alias("n"), F.count_distinct("f.sample").alias("n_values"))


def personal(spark, sf_dir):
    """Findings in the events, given a bag with contact data."""
    rows = driver.events(spark, sf_dir)
    bag = F.expr("to_json(named_struct('contact', named_struct('email', CASE WHEN event_id >= 0 AND CAST(user_id AS INT) % 2 = 0 THEN concat('u', user_id, '@example.com') ELSE '' END), 'hops', array('10.0.0.1', 'none'), 'n', event_id))")
    return privacy.report(privacy.scan_properties(rows.withColumn("properties", bag)))


@query("""SELECT 'suspicious_key' AS kind, event_type AS event_name, 'contact.email' AS path, count(*) AS n FROM events GROUP BY event_type
UNION ALL SELECT 'email', event_type, 'contact.email', count(*) FROM events WHERE user_id % 2 = 0 GROUP BY event_type UNION ALL SELECT 'ip_address', event_type, 'hops[0]', count(*) FROM events GROUP BY event_type""")
def q_pii_report(spark, sf_dir):
    return personal(spark, sf_dir).select("kind", "event_name", "path", "n")


@query("SELECT event_type AS event_name, count(*) AS n_events, event_type AS screens FROM events GROUP BY event_type")
def q_scaffold_event_screens(spark, sf_dir):
    rows = readiness.draft_events(driver.events(spark, sf_dir))
    return rows.select("event_name", "n_events", F.array_join("screens", ",").alias("screens"))
