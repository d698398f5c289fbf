"""Queries on test coverage: the suite is read off the first half of the month, production off the second."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions.cutting import cut
from trailmark.operators import coverage, gaps, graph, variants
from trailmark.plans import journeys
from trailmark.plans.journeys import EV, ctes
from trailmark.sources import driver

CRITICAL = ["purchase"]
# Why a test is protected.
CATEGORIES = ["regulatory", "financial", "data_rights", "accessibility", "security", "safety", "disaster_recovery"]
PATTERNS = [("9*", "kept by contract with the payment team"), ("re:#3$", "kept for the quarterly audit of refunds")]
QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def refs(spark, sf_dir):
    """Steps of all traces as screen references of tests; clicks are unsure."""
    steps = journeys.steps(spark, sf_dir, "1.0")
    confidence = F.when(F.col("screen_id") == "click", "low").when(F.col("screen_id") == "view", "medium").otherwise("high")
    return steps.select("app_id", F.col("trace_id").alias("test_id"), "screen_id", confidence.alias("confidence"), F.col("step_no").alias("line"), F.lit(0).alias("ord"))


def tests_of(reference):
    language = F.when(F.hash("test_id") % 2 == 0, "java").otherwise("python")
    return reference.select("app_id", "test_id").distinct().withColumn("language", language)


def tests(spark, sf_dir):
    return tests_of(refs(spark, sf_dir))


def tested(spark, sf_dir):
    return coverage.tested_transitions(coverage.test_paths(refs(spark, sf_dir)))


def edges(spark, sf_dir):
    return graph.edges(journeys.traces(spark, sf_dir, "2.0"))


def busy(prod):
    """Edges of at least average weight."""
    return prod.join(prod.groupBy("app_id").agg(F.avg("weight").alias("mean")), "app_id").where("weight >= mean")


def busy_edges(spark, sf_dir):
    return busy(edges(spark, sf_dir))


def golden(spark, sf_dir):
    """Variants of the second half as journeys, scored by their sessions."""
    rows = variants.variants(journeys.traces(spark, sf_dir, "2.0"))
    return rows.select("app_id", F.array_join("path", " > ").alias("journey_id"), "path", "n_sessions", F.col("n_sessions").cast("double").alias("score"))


BASE = f"""{EV}, {ctes('0', 'early')}, {ctes('1', 'NOT early')},
refs AS (SELECT trace_id AS test_id, screen_id, step_no FROM steps0),
sure AS (SELECT *, lag(screen_id) OVER (PARTITION BY test_id ORDER BY step_no) AS before FROM refs WHERE screen_id <> 'click'),
tp AS (SELECT test_id, list(screen_id ORDER BY step_no) AS walk FROM sure WHERE before IS NULL OR before <> screen_id GROUP BY test_id),
tt AS (SELECT DISTINCT test_id, walk[i] AS source, walk[i + 1] AS target FROM (SELECT test_id, walk, unnest(generate_series(1, len(walk) - 1)) AS i FROM tp)),
te AS (SELECT source, target, count(*) AS n_tests FROM tt GROUP BY ALL),
tc AS (SELECT edges1.source, edges1.target, weight, coalesce(n_tests, 0) AS n_tests FROM edges1 LEFT JOIN te USING (source, target)),
jp AS (SELECT path, walk[i] AS source, walk[i + 1] AS target, i FROM (SELECT path, walk, unnest(generate_series(1, len(walk) - 1)) AS i FROM (SELECT DISTINCT path, walk FROM usable1))),
jc AS (SELECT path AS journey_id, count(*) AS n_pairs, count(n_tests) AS n_covered, count(n_tests) / count(*) AS coverage, coalesce(string_agg(source || ' > ' || target, ', ' ORDER BY i) FILTER (n_tests IS NULL), '') AS missing
  FROM jp LEFT JOIN te USING (source, target) GROUP BY path),
jt AS (SELECT path AS journey_id, count(DISTINCT test_id) AS n_tests FROM jp JOIN tt USING (source, target) GROUP BY path)"""


@query(f"{BASE} SELECT test_id, array_to_string(walk, ' > ') AS path FROM tp")
def g_test_paths(spark, sf_dir):
    return coverage.test_paths(refs(spark, sf_dir)).select("test_id", journeys.path_text())


@query(f"{BASE} SELECT * FROM tc")
def g_transition_coverage(spark, sf_dir):
    return coverage.transition_coverage(edges(spark, sf_dir), tested(spark, sf_dir)).drop("app_id")


@query(f"{BASE} SELECT * FROM jc")
def g_journey_coverage(spark, sf_dir):
    rows = coverage.journey_coverage(golden(spark, sf_dir), tested(spark, sf_dir))
    return rows.select("journey_id", "n_pairs", "n_covered", "coverage", F.array_join("missing", ", ").alias("missing"))


@query(f"""{BASE} SELECT count(*) AS n_transitions, count(*) FILTER (n_tests > 0) AS n_covered, count(*) FILTER (n_tests > 0) * 100 / count(*) AS covered_pct, coalesce(sum(weight) FILTER (n_tests > 0), 0) * 100 / sum(weight) AS weighted_pct,
(SELECT count(*) FROM jc WHERE coverage = 1) AS journeys_full, (SELECT count(*) FROM jc WHERE coverage = 0) AS journeys_none, (SELECT count(DISTINCT test_id) FROM refs WHERE test_id NOT IN (SELECT test_id FROM tp)) AS unmapped_tests FROM tc""")
def g_coverage(spark, sf_dir):
    paths, walked = coverage.test_paths(refs(spark, sf_dir)), tested(spark, sf_dir)
    return coverage.summary(coverage.transition_coverage(edges(spark, sf_dir), walked), coverage.journey_coverage(golden(spark, sf_dir), walked), tests(spark, sf_dir), paths).drop("app_id")


@query(f"{BASE} SELECT source, target, n_tests FROM te")
def g_redundancy(spark, sf_dir):
    return coverage.redundancy(tested(spark, sf_dir)).drop("app_id")


@query(f"{BASE} SELECT source, target, weight FROM tc WHERE n_tests = 0 AND weight >= 2")
def j_uncovered(spark, sf_dir):
    walked = tested(spark, sf_dir).select("app_id", "source", "target").distinct()
    return graph.uncovered(edges(spark, sf_dir), walked, 2).select("source", "target", "weight")


@query(f"{BASE} SELECT source, target, n_tests FROM te WHERE (source, target) NOT IN (SELECT (source, target) FROM edges1 WHERE weight >= (SELECT avg(weight) FROM edges1))")
def j_unreachable(spark, sf_dir):
    return graph.unreachable(coverage.redundancy(tested(spark, sf_dir)), busy_edges(spark, sf_dir)).select("source", "target", "n_tests")


REACH = "r AS (SELECT test_id, count(*) AS n_transitions, count(*) FILTER ((source, target) NOT IN (SELECT (source, target) FROM edges1 WHERE weight >= (SELECT avg(weight) FROM edges1))) AS n_unreachable FROM tt GROUP BY test_id)"
KIND = "CASE WHEN n_unreachable < n_transitions THEN 'stale' WHEN test_id LIKE '9%' OR test_id LIKE '%#3' THEN 'protected_retained' ELSE 'obsolete' END"
FOUND = f"""{BASE}, {REACH}, d AS (SELECT *, {KIND} AS kind FROM r WHERE n_unreachable > 0),
half AS (SELECT n_sessions AS median FROM (SELECT n_sessions, row_number() OVER (ORDER BY n_sessions DESC, path) - 1 AS nth, count(*) OVER () AS n FROM variants1) WHERE nth = n // 2),
f AS (SELECT 'coverage_gap' AS kind, CASE WHEN n_covered = 0 AND contains(journey_id, 'purchase') THEN 'critical' WHEN n_covered = 0 OR contains(journey_id, 'purchase') THEN 'high' ELSE 'medium' END AS severity, journey_id AS subject, n_sessions AS sessions FROM jc JOIN variants1 ON path = journey_id WHERE coverage < 1
UNION ALL SELECT 'coverage_gap', CASE WHEN 'purchase' IN (source, target) THEN 'high' ELSE 'low' END, source || ' > ' || target, weight FROM tc WHERE n_tests = 0 AND weight >= 5 AND source || ' > ' || target NOT IN (SELECT source || ' > ' || target FROM jp WHERE (source, target) NOT IN (SELECT (source, target) FROM te))
UNION ALL SELECT kind, CASE kind WHEN 'stale' THEN 'medium' WHEN 'protected_retained' THEN 'info' ELSE 'low' END, test_id, 0 FROM d
UNION ALL SELECT 'over_tested', 'low', journey_id, n_sessions FROM jt JOIN variants1 ON path = journey_id, half WHERE n_tests >= 3 AND n_sessions < median
UNION ALL SELECT 'assertion_gap', 'medium', test_id, 0 FROM refs GROUP BY test_id HAVING bool_or(screen_id = 'purchase') AND NOT bool_or(screen_id = 'purchase' AND step_no = 0)
UNION ALL SELECT 'unmapped_test', 'medium', n || ' tests', 0 FROM (SELECT count(DISTINCT test_id) AS n FROM refs WHERE test_id NOT IN (SELECT test_id FROM tp)) WHERE n > 0)"""


def suite_tables(spark, sf_dir):
    """(refs, tested, edges, golden) as tables, so that the events aren't shuffled anew by each that reads them."""
    reference = cut(refs(spark, sf_dir), "refs")
    walked = cut(coverage.tested_transitions(coverage.test_paths(reference)), "tested")
    return reference, walked, cut(edges(spark, sf_dir), "edges"), cut(golden(spark, sf_dir), "golden")


def findings(spark, sf_dir, suite=None):
    """All findings; ``suite`` as of ``suite_tables``."""
    reference, walked, prod, goals = suite or suite_tables(spark, sf_dir)
    paths = coverage.test_paths(reference)
    covered = coverage.journey_coverage(goals, walked)
    asserted = reference.where("line = 0").select("app_id", "test_id", "screen_id")
    parts = [
        gaps.journey_gaps(goals, covered, CRITICAL),
        gaps.transition_gaps(coverage.transition_coverage(prod, walked), covered, CRITICAL),
        gaps.dead_tests(gaps.reachability(walked, busy(prod)), PATTERNS),
        gaps.over_tested(goals, walked),
        gaps.assertion_gaps(coverage.test_facts(reference, asserted), CRITICAL),
        gaps.unmapped(tests_of(reference), paths),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"{FOUND} SELECT *, CAST(row_number() OVER (ORDER BY list_position(['info', 'low', 'medium', 'high', 'critical'], severity) DESC, sessions DESC, kind, subject) AS INTEGER) AS place FROM f")
def g_findings(spark, sf_dir):
    return gaps.ordered(findings(spark, sf_dir)).select("kind", "severity", "subject", "sessions", "place")


@query(f"""{FOUND}, l(measure, label) AS (SELECT 'severity', unnest(['info', 'low', 'medium', 'high', 'critical']) UNION ALL SELECT 'kind', unnest(['coverage_gap', 'obsolete', 'stale', 'over_tested', 'assertion_gap', 'unmapped_test', 'protected_retained']))
SELECT measure, label, (SELECT count(*) FROM f WHERE CASE measure WHEN 'kind' THEN kind ELSE severity END = label) AS n FROM l""")
def g_tallies(spark, sf_dir):
    return gaps.tallies(findings(spark, sf_dir)).drop("app_id")


@query(f"{FOUND} SELECT substr('[' || kind || '] ' || subject, 1, 255) AS summary, CASE severity WHEN 'critical' THEN 'Highest' WHEN 'high' THEN 'High' ELSE 'Medium' END AS priority FROM f WHERE kind IN ('coverage_gap', 'stale', 'assertion_gap', 'unmapped_test') AND severity IN ('medium', 'high', 'critical')")
def k_tickets(spark, sf_dir):
    return gaps.tickets(findings(spark, sf_dir)).select("summary", "priority")


@query(f"""{FOUND}, l(measure, label) AS (SELECT 'severity', unnest(['info', 'low', 'medium', 'high', 'critical']) UNION ALL SELECT 'kind', unnest(['coverage_gap', 'obsolete', 'stale', 'over_tested', 'assertion_gap', 'unmapped_test', 'protected_retained'])),
g AS (SELECT CAST(count(*) AS DOUBLE) AS n_transitions, CAST(count(*) FILTER (n_tests > 0) AS DOUBLE) AS n_covered, CAST(count(*) FILTER (n_tests > 0) * 100 / count(*) AS DOUBLE) AS covered_pct, CAST(coalesce(sum(weight) FILTER (n_tests > 0), 0) * 100 / sum(weight) AS DOUBLE) AS weighted_pct,
  (SELECT CAST(count(*) AS DOUBLE) FROM jc WHERE coverage = 1) AS journeys_full, (SELECT CAST(count(*) AS DOUBLE) FROM jc WHERE coverage = 0) AS journeys_none, (SELECT CAST(count(DISTINCT test_id) AS DOUBLE) FROM refs WHERE test_id NOT IN (SELECT test_id FROM tp)) AS unmapped_tests FROM tc)
SELECT metric, '{{}}' AS labels, value FROM (UNPIVOT g ON COLUMNS(*) INTO NAME metric VALUE value)
UNION ALL SELECT 'findings', '{{"' || measure || '":"' || label || '"}}', (SELECT CAST(count(*) AS DOUBLE) FROM f WHERE CASE measure WHEN 'kind' THEN kind ELSE severity END = label) FROM l
UNION ALL SELECT 'journey_coverage', '{{"journey":"' || journey_id || '"}}', CAST(coverage AS DOUBLE) FROM (SELECT journey_id, coverage, row_number() OVER (ORDER BY n_sessions DESC, journey_id) AS nth FROM jc JOIN variants1 ON path = journey_id) WHERE nth <= 20""")
def k_metrics(spark, sf_dir):
    walked, goals = tested(spark, sf_dir), golden(spark, sf_dir)
    covered = coverage.journey_coverage(goals, walked)
    figures = coverage.summary(coverage.transition_coverage(edges(spark, sf_dir), walked), covered, tests(spark, sf_dir), coverage.test_paths(refs(spark, sf_dir)))
    rows = gaps.metrics(figures, gaps.tallies(findings(spark, sf_dir)), goals.join(covered, ["app_id", "journey_id"]))
    return rows.select("metric", F.to_json("labels").alias("labels"), "value")


@query(f"{FOUND} SELECT subject AS test_id FROM f WHERE kind = 'obsolete' AND contains(subject, '#1')")
def j_deletable(spark, sf_dir):
    rows = gaps.deletable(findings(spark, sf_dir), ["#1"], PATTERNS)
    return gaps.guarded(rows, PATTERNS).select("test_id")


@query(f"{BASE} SELECT test_id, CASE WHEN test_id LIKE '9%' THEN '9*' WHEN test_id LIKE '%#3' THEN 're:#3$' END AS pattern FROM (SELECT DISTINCT test_id FROM refs)")
def j_registry(spark, sf_dir):
    return gaps.protected(tests(spark, sf_dir), PATTERNS).select("test_id", "pattern")


@query(f"""{BASE}, u AS (SELECT DISTINCT test_id FROM refs) SELECT 'tests' AS measure, 'all' AS label, count(*) AS n FROM u UNION ALL SELECT 'tests', 'mapped', count(*) FROM tp
UNION ALL SELECT 'confidence', CASE screen_id WHEN 'click' THEN 'low' WHEN 'view' THEN 'medium' ELSE 'high' END, count(*) FROM refs GROUP BY 2""")
def g_suite_summary(spark, sf_dir):
    reference = refs(spark, sf_dir)
    return coverage.suite_summary(tests(spark, sf_dir), coverage.test_paths(reference), reference).where("measure <> 'language'").drop("app_id")


@query(f"""{BASE} SELECT test_id, coalesce(string_agg(DISTINCT screen_id, ',' ORDER BY screen_id) FILTER (screen_id <> 'click'), '') AS covered, coalesce(string_agg(DISTINCT screen_id, ',') FILTER (screen_id = 'click'), '') AS uncertain,
CASE WHEN bool_or(screen_id = 'click') THEN 'low' WHEN bool_or(screen_id = 'view') THEN 'medium' ELSE 'high' END AS weakest FROM refs GROUP BY test_id""")
def g_test_facts(spark, sf_dir):
    reference = refs(spark, sf_dir)
    rows = coverage.test_facts(reference, reference.where("line = 0").select("app_id", "test_id", "screen_id"))
    return rows.select("test_id", F.array_join("covered", ",").alias("covered"), F.array_join("uncertain", ",").alias("uncertain"), "weakest")


@query(f"{BASE} SELECT screen_id, count(DISTINCT test_id) AS n_tests, string_agg(DISTINCT test_id, ',' ORDER BY test_id) AS tests FROM refs WHERE screen_id <> 'click' GROUP BY screen_id")
def g_screen_tests(spark, sf_dir):
    """The tests that touch each screen."""
    reference = refs(spark, sf_dir)
    rows = coverage.screen_tests(coverage.test_facts(reference, reference.where("line = 0").select("app_id", "test_id", "screen_id")))
    return rows.select("screen_id", "n_tests", F.array_join("tests", ",").alias("tests"))


TODAY = "2024-06-01"


def registry(spark, sf_dir):
    """Suppliers as registry entries, a fifth of them to be reviewed before today, some never."""
    rows = driver.table(spark, sf_dir, "supplier")
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("s_nationkey") % len(CATEGORIES) + 1).cast("int"))
    days = (F.col("s_suppkey") % 500).cast("int") - 100
    review = F.when(F.col("s_suppkey") % 31 > 0, F.date_add(F.to_date(F.lit(TODAY)), days))
    return rows.select(F.lit("demo").alias("app_id"), F.col("s_name").alias("pattern"), category.alias("category"), F.when(F.col("s_suppkey") % 17 == 0, "   kept   ").otherwise(F.concat(F.lit("kept for the auditors of "), "s_name")).alias("reason"), F.lit("qa").alias("owner"), review.alias("review_by"))


ENTRIES = f"""s AS (SELECT s_name AS pattern, {CATEGORIES!r}[CAST(s_nationkey % {len(CATEGORIES)} AS INTEGER) + 1] AS category, CASE WHEN s_suppkey % 31 > 0 THEN DATE '{TODAY}' + CAST(s_suppkey % 500 - 100 AS INTEGER) END AS review_by FROM supplier)"""


@query(f"WITH {ENTRIES} SELECT pattern, category, CAST(review_by AS VARCHAR) AS review_by FROM s WHERE review_by IS NULL OR review_by < DATE '{TODAY}'")
def q_registry_stale(spark, sf_dir):
    rows = gaps.stale_entries(registry(spark, sf_dir), F.to_date(F.lit(TODAY)))
    return rows.select("pattern", "category", F.col("review_by").cast("string").alias("review_by"))


@query("SELECT 'thin_reason' AS rule, 'error' AS severity, s_name AS subject FROM supplier WHERE s_suppkey % 17 = 0")
def q_registry_issues(spark, sf_dir):
    return gaps.registry_issues(registry(spark, sf_dir)).drop("app_id")


@query(f"WITH {ENTRIES} SELECT category, count(*) AS n_entries, count(*) FILTER (review_by IS NULL OR review_by < DATE '{TODAY}') AS n_stale FROM s GROUP BY category")
def q_registry_categories(spark, sf_dir):
    return gaps.entries_by_category(registry(spark, sf_dir), F.to_date(F.lit(TODAY))).drop("app_id")
