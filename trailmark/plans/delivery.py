"""Queries on screens and locators (read off parts), outcomes and governance (orders, line items),
streams (events) and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions.cutting import cut, new_path
from trailmark.functions.parsing import locator_strategy, suite_strategy
from trailmark.operators import archetypes, coverage, gates, graph, outcomes, quality, readiness, risk, screens
from trailmark.plans import clusters, contracts, journeys, testing
from trailmark.sources import driver
from trailmark.sources.defects import defects as read_defects
from trailmark.sources.defects import read_exports, reported_gaps
from trailmark.streaming import streams

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Parts as elements: a block of ten part keys is a screen. Release 2 changes ids, texts and packages
#: of some, takes a neighbour's id, renames screens, gives a screen's name to its neighbour, loses some.
ELEMENTS = """SELECT 'demo' AS app_id, v AS app_version, CASE WHEN v = '2' AND k % 23 = 5 THEN 'moved_' || k WHEN v = '2' AND k % 29 = 7 THEN 'screen_' || (k + 1) WHEN v = '2' AND k % 37 = 12 THEN 'screen_' || (k - 1) ELSE 'screen_' || k END AS screen_id,
CAST(p AS INT) AS doc_pos, CASE WHEN p % 4 = 0 THEN 'android.widget.Button' WHEN p % 4 = 1 THEN 'XCUIElementTypeCell' ELSE 'android.widget.TextView' END AS element_type,
CASE WHEN p % 5 <> 0 THEN CASE WHEN v = '2' AND p % 9 = 1 THEN 'com.app.beta' ELSE 'com.app' END || ':id/r' || CASE WHEN p % 11 = 0 THEN 0 WHEN k % 13 = 4 AND p % 10 < 4 THEN k ELSE p END END AS resource_id,
CASE WHEN p % 3 <> 0 THEN 'acc ' || CASE WHEN v = '2' AND (p % 7 = 0 OR k % 31 = 9) THEN p + 100000 WHEN v = '2' AND k % 19 = 4 AND p % 10 = 2 THEN p - 1 ELSE p END END AS accessibility_id,
CASE WHEN p % 13 <> 0 THEN CASE WHEN v = '2' AND k % 31 = 9 THEN 'other ' || p WHEN v = '2' AND p % 6 = 0 THEN upper(p_name) || '  ' || p ELSE p_name || ' ' || p END END AS text, CASE WHEN p % 26 = 13 THEN 'label ' || p END AS label,
p % 4 = 0 AS clickable, CASE WHEN p % 78 <> 0 THEN '/hierarchy/node[' || p || ']' END AS xpath_positional
FROM (SELECT p_partkey AS p, CAST(FLOOR(p_partkey / 10) AS BIGINT) AS k, p_name FROM part) AS parts, (SELECT '1' AS v UNION ALL SELECT '2') AS versions WHERE NOT (v = '2' AND (k % 17 = 3 OR k % 29 = 8 OR k % 37 = 11))"""


def elements(spark, sf_dir):
    return spark.sql(ELEMENTS.replace("FROM part)", "FROM {part})"), part=driver.table(spark, sf_dir, "part"))


E = f"""WITH e AS (SELECT *, '//' || element_type || CASE WHEN text <> '' THEN '[@text="' || text || '"]' WHEN label <> '' THEN '[@label="' || label || '"]' ELSE '' END AS semantic,
CASE WHEN contains(resource_id, '/') THEN substr(resource_id, instr(resource_id, '/') + 1) ELSE '' END AS short, regexp_replace(string_split(element_type, '.')[-1], '^XCUIElementType', '') AS kind, left(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))), 60) AS plain FROM ({ELEMENTS}))"""
CANDIDATES = f"""{E}, c AS (SELECT app_version, screen_id, doc_pos, 'accessibility_id' AS strategy, accessibility_id AS value FROM e WHERE accessibility_id IS NOT NULL UNION ALL SELECT app_version, screen_id, doc_pos, 'resource_id', resource_id FROM e WHERE resource_id IS NOT NULL
UNION ALL SELECT app_version, screen_id, doc_pos, 'semantic_xpath', semantic FROM e WHERE semantic LIKE '%]' UNION ALL SELECT app_version, screen_id, doc_pos, 'positional_xpath', xpath_positional FROM e WHERE xpath_positional IS NOT NULL),
k AS (SELECT *, count(*) OVER (PARTITION BY app_version, screen_id, strategy, value) AS matches FROM c),
s AS (SELECT *, CASE strategy WHEN 'accessibility_id' THEN 1.0 WHEN 'resource_id' THEN 0.8 WHEN 'semantic_xpath' THEN 0.55 ELSE 0.15 END AS base FROM k),
l AS (SELECT app_version, screen_id, doc_pos, strategy, value, matches, CAST(CASE WHEN matches = 1 THEN base ELSE base / (1 + matches) END AS DOUBLE) AS stability, matches = 1 AND base >= 0.5 AS usable FROM s)"""


@query(f"{CANDIDATES} SELECT app_version, screen_id, doc_pos, strategy, value, matches, round(stability, 6) AS stability, usable FROM l")
def l_candidates(spark, sf_dir):
    return screens.candidates(elements(spark, sf_dir)).drop("app_id").withColumn("stability", F.round("stability", 6))


BEST = f"""{CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY app_version, screen_id, doc_pos ORDER BY stability DESC, matches, value) AS place FROM l),
rb AS (SELECT app_version, screen_id, doc_pos, arg_min(strategy, place) FILTER (usable) AS strategy, arg_min(value, place) FILTER (usable) AS value, count(*) FILTER (usable) AS n_usable, count(*) FILTER (matches = 1) AS n_unique FROM r GROUP BY ALL),
bs AS (SELECT e.app_version, e.screen_id, e.doc_pos, strategy, value, coalesce(n_usable, 0) AS n_usable, CASE WHEN n_usable > 0 THEN NULL WHEN n_unique IS NULL THEN 'no candidate' WHEN n_unique = 0 THEN 'all ambiguous' ELSE 'only fragile' END AS diagnosis FROM e LEFT JOIN rb USING (app_version, screen_id, doc_pos))"""


def best_locators(spark, sf_dir):
    rows = elements(spark, sf_dir)
    return screens.best(screens.candidates(rows), rows)


@query(f"{BEST} FROM bs")
def l_best(spark, sf_dir):
    """The best locator of each element, and why some have none."""
    return best_locators(spark, sf_dir).drop("app_id")


@query(f"{E} SELECT app_version, screen_id, count(*) AS n_elements, count(*) FILTER (clickable) AS n_interactive, count(accessibility_id) AS n_accessibility, count(resource_id) AS n_resource FROM e GROUP BY ALL")
def l_dump_summary(spark, sf_dir):
    return screens.summary(elements(spark, sf_dir)).drop("app_id")


@query(f"""{E}, n AS (SELECT *, count(accessibility_id) OVER (PARTITION BY app_version, screen_id, accessibility_id) AS na, count(nullif(short, '')) OVER (PARTITION BY app_version, screen_id, nullif(short, '')) AS nr, count(text) OVER (PARTITION BY app_version, screen_id, text) AS nt FROM e),
b AS (SELECT *, lower(regexp_replace(coalesce(CASE WHEN na = 1 THEN accessibility_id END, CASE WHEN nr = 1 THEN short END, CASE WHEN nt = 1 THEN text END, kind), '[^A-Za-z0-9]+', '_', 'g')) AS base FROM n)
SELECT app_version, screen_id, doc_pos, base || CASE WHEN nth > 1 THEN '_' || nth ELSE '' END AS role FROM (SELECT *, row_number() OVER (PARTITION BY app_version, screen_id, base ORDER BY doc_pos) AS nth FROM b)""")
def l_roles(spark, sf_dir):
    return screens.roles(elements(spark, sf_dir)).select("app_version", "screen_id", "doc_pos", "role")


FINGERPRINTS = f"""WITH RECURSIVE {E.removeprefix('WITH ')},
ty AS (SELECT app_version, screen_id, kind AS t, count(*) AS n FROM e GROUP BY ALL),
fp AS (SELECT app_version, screen_id, coalesce(list(DISTINCT accessibility_id ORDER BY accessibility_id) FILTER (accessibility_id IS NOT NULL), []) AS ids, list(DISTINCT nullif(plain, '')) AS words,
  (SELECT list({{'t': t, 'n': n}} ORDER BY t) FROM ty WHERE ty.app_version = e.app_version AND ty.screen_id = e.screen_id) AS types FROM e GROUP BY app_version, screen_id),
fq AS (SELECT app_version, screen_id, ids, types, list_sort([x FOR x IN words IF x IS NOT NULL]) AS texts FROM fp)"""
#: All pairs of screens of the two releases, and the greedy claims one screen after another.
MATCHES = f"""{FINGERPRINTS},
ab AS (SELECT a.screen_id AS screen_a, b.screen_id AS screen_b, a.ids AS ia, b.ids AS ib, a.texts AS xa, b.texts AS xb, a.types AS ta, b.types AS tb FROM fq a, fq b WHERE a.app_version = '1' AND b.app_version = '2'),
sc AS (SELECT screen_a, screen_b, CASE WHEN len(ia) + len(ib) = 0 THEN 1.0 ELSE len(list_intersect(ia, ib)) / len(list_distinct(ia || ib)) END AS ji, CASE WHEN len(xa) + len(xb) = 0 THEN 1.0 ELSE len(list_intersect(xa, xb)) / len(list_distinct(xa || xb)) END AS jx,
  list_distinct([x.t FOR x IN ta] || [x.t FOR x IN tb]) AS names, map_from_entries(ta) AS ma, map_from_entries(tb) AS mb FROM ab),
pr AS MATERIALIZED (SELECT screen_a, screen_b, round(ji * 0.55::DOUBLE + list_sum([least(coalesce(ma[k], 0), coalesce(mb[k], 0)) FOR k IN names]) / list_sum([greatest(coalesce(ma[k], 0), coalesce(mb[k], 0)) FOR k IN names]) * 0.25::DOUBLE + jx * 0.2::DOUBLE, 4) AS similarity FROM sc),
ok AS (FROM pr WHERE similarity >= 0.55), same AS (FROM ok WHERE screen_a = screen_b),
op AS (SELECT screen_a, list({{'b': screen_b, 's': similarity}} ORDER BY similarity DESC, screen_b) AS options FROM ok WHERE screen_a <> screen_b AND NOT (screen_b < screen_a AND screen_b IN (SELECT screen_b FROM same)) GROUP BY screen_a),
todo AS (SELECT row_number() OVER (ORDER BY f.screen_id) AS nth, f.screen_id AS screen_a, pr.similarity AS own, coalesce(options, []) AS options
  FROM fq f LEFT JOIN op ON op.screen_a = f.screen_id LEFT JOIN pr ON pr.screen_a = f.screen_id AND pr.screen_b = f.screen_id WHERE f.app_version = '1' AND f.screen_id NOT IN (SELECT screen_a FROM same)),
claim AS (SELECT CAST(0 AS BIGINT) AS nth, CAST(NULL AS VARCHAR) AS screen_a, CAST(NULL AS VARCHAR) AS screen_b, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS DOUBLE) AS similarity, CAST([] AS VARCHAR[]) AS taken
  UNION ALL SELECT nth, screen_a, CASE WHEN got IS NOT NULL THEN got.b WHEN own IS NOT NULL THEN screen_a END, CASE WHEN got IS NOT NULL THEN 'renamed' WHEN own IS NOT NULL THEN 'changed' ELSE 'not_captured' END, coalesce(got.s, own),
    CASE WHEN got IS NOT NULL THEN list_append(taken, got.b) WHEN own IS NOT NULL THEN list_append(taken, screen_a) ELSE taken END
  FROM (SELECT todo.nth, todo.screen_a, todo.own, ([x FOR x IN todo.options IF NOT list_contains(claim.taken, x.b)])[1] AS got, claim.taken FROM claim JOIN todo ON todo.nth = claim.nth + 1)),
both_ AS (SELECT screen_a, screen_b, 'matched' AS status, similarity FROM same UNION ALL SELECT screen_a, screen_b, status, similarity FROM claim WHERE nth > 0),
mt AS (FROM both_ UNION ALL SELECT NULL, screen_id, 'new', NULL FROM fq WHERE app_version = '2' AND screen_id NOT IN (SELECT screen_b FROM both_ WHERE screen_b IS NOT NULL))"""


@query(f"""{FINGERPRINTS} SELECT app_version, screen_id, left(sha256(array_to_string(ids, ',') || '|' || array_to_string([x.t || ':' || x.n FOR x IN types], ',')), 16) AS digest, CAST(len(ids) AS INTEGER) AS n_ids, CAST(len(texts) AS INTEGER) AS n_texts FROM fq""")
def l_fingerprints(spark, sf_dir):
    return screens.fingerprints(elements(spark, sf_dir)).select("app_version", "screen_id", "digest", F.size("ids").alias("n_ids"), F.size("texts").alias("n_texts"))


@query(f"{MATCHES} FROM mt")
def l_screen_matches(spark, sf_dir):
    return screens.matched_screens(screens.fingerprints(elements(spark, sf_dir)), "1", "2").drop("app_id")


@query(f"{MATCHES} SELECT count(*) AS n_comparable, round(count(*) FILTER (status IN ('matched', 'renamed')) * 100 / count(*), 1) AS stability_pct FROM mt WHERE status <> 'not_captured'")
def l_identity_stability(spark, sf_dir):
    return screens.identity_stability(screens.matched_screens(screens.fingerprints(elements(spark, sf_dir)), "1", "2")).drop("app_id")


MIX = ", ".join(f"count(*) FILTER (strategy = '{x}') AS {x}" for x in screens.STABILITY)


@query(f"""{BEST} SELECT app_version, screen_id, count(*) AS n_elements, count(*) FILTER (n_usable > 0) AS n_resolved, round(count(*) FILTER (n_usable > 0) / count(*), 3) AS rate, {MIX},
count(*) FILTER (diagnosis = 'no candidate') AS n_no_candidate, count(*) FILTER (diagnosis = 'all ambiguous') AS n_ambiguous, count(*) FILTER (diagnosis = 'only fragile') AS n_fragile FROM bs GROUP BY ALL""")
def l_resolution(spark, sf_dir):
    return screens.screen_resolution(best_locators(spark, sf_dir)).select("*", "strategy_mix.*").drop("app_id", "strategy_mix")


def claims(spark, sf_dir):
    """The best locators of release 1, ids of parts by their resource, and ids that nobody has."""
    rows = elements(spark, sf_dir).where("app_version = '1'")
    own = screens.own_claims(elements(spark, sf_dir), "1")
    one = lambda where, role, strategy, value: rows.where(where).select("app_id", "screen_id", role.alias("role"), F.lit(strategy).alias("strategy"), value.alias("value"))
    by_id = one("resource_id IS NOT NULL AND doc_pos % 2 = 0", F.when(F.col("doc_pos") % 8 == 0, "LINE_ITEM").otherwise(F.concat(F.lit("po_"), "doc_pos")), "resource_id", F.col("resource_id"))
    lost = one("doc_pos % 50 = 7", F.lit("nobody"), "accessibility_id", F.concat(F.lit("none "), "doc_pos"))
    return own.union(by_id.distinct()).union(lost)


CLAIMS = f"""{BEST}, cl AS (SELECT screen_id, CAST(doc_pos AS VARCHAR) AS role, strategy, value FROM bs WHERE app_version = '1' AND strategy IS NOT NULL
UNION SELECT screen_id, CASE WHEN doc_pos % 8 = 0 THEN 'LINE_ITEM' ELSE 'po_' || doc_pos END, 'resource_id', resource_id FROM e WHERE app_version = '1' AND resource_id IS NOT NULL AND doc_pos % 2 = 0
UNION SELECT screen_id, 'nobody', 'accessibility_id', 'none ' || doc_pos FROM e WHERE app_version = '1' AND doc_pos % 50 = 7),
hit AS (SELECT cl.*, e.app_version, e.doc_pos FROM cl JOIN e ON e.screen_id = cl.screen_id AND CASE strategy WHEN 'accessibility_id' THEN e.accessibility_id = value WHEN 'resource_id' THEN e.resource_id = value OR (e.resource_id <> '' AND e.short = string_split(value, '/')[-1])
  WHEN 'semantic_xpath' THEN e.semantic = value ELSE e.xpath_positional = value END),
cf AS (SELECT cl.*, cl.screen_id IN (SELECT screen_id FROM e WHERE app_version = '2') AS dumped, (SELECT count(*) FROM hit WHERE hit.app_version = '2' AND (hit.screen_id, hit.role, hit.strategy, hit.value) = (cl.screen_id, cl.role, cl.strategy, cl.value)) AS n,
  (SELECT min(doc_pos) FROM hit WHERE hit.app_version = '1' AND (hit.screen_id, hit.role, hit.strategy, hit.value) = (cl.screen_id, cl.role, cl.strategy, cl.value)) AS pos FROM cl)"""
HEALED = f"""{CLAIMS},
lo AS (SELECT cf.*, p.accessibility_id, p.text, p.plain, p.kind, p.short, p.clickable FROM cf LEFT JOIN e p ON p.app_version = '1' AND p.screen_id = cf.screen_id AND p.doc_pos = cf.pos WHERE dumped),
li AS (SELECT lo.screen_id, lo.role, lo.strategy, lo.value, q.doc_pos AS other, round(CASE WHEN lo.accessibility_id <> '' AND lo.accessibility_id = q.accessibility_id THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN lo.text <> '' AND lo.plain = q.plain THEN 0.25::DOUBLE ELSE 0 END
  + CASE WHEN lo.kind = q.kind THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN lo.short <> '' AND lo.short = q.short THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN lo.clickable = q.clickable THEN 0.05::DOUBLE ELSE 0 END, 4) AS likeness
  FROM lo JOIN e q ON q.app_version = '2' AND q.screen_id = lo.screen_id WHERE n = 0 AND pos IS NOT NULL),
tp AS (SELECT screen_id, role, strategy, value, arg_max(other, likeness * 1e9 - other) AS other, max(likeness) AS confidence FROM li WHERE likeness >= 0.45 GROUP BY ALL),
w(strategy, level) AS (VALUES ('accessibility_id', 1.0), ('resource_id', 0.8), ('semantic_xpath', 0.55)),
h AS (SELECT lo.screen_id, lo.role, lo.strategy, lo.value, n AS found, CASE WHEN n = 1 THEN 'fine' WHEN n > 1 THEN 'ambiguous' WHEN pos IS NULL THEN 'not_in_baseline' WHEN b.value IS NULL THEN 'unrepairable' WHEN (SELECT level FROM w WHERE w.strategy = b.strategy) < (SELECT level FROM w WHERE w.strategy = lo.strategy) THEN 'review' ELSE 'repaired' END AS status,
  b.strategy AS new_strategy, b.value AS new_value, confidence FROM lo LEFT JOIN tp USING (screen_id, role, strategy, value) LEFT JOIN bs b ON b.app_version = '2' AND b.screen_id = lo.screen_id AND b.doc_pos = tp.other)"""


@query(f"{HEALED} FROM h")
def l_healing(spark, sf_dir):
    """Claimed locators of release 1 in release 2: what still matches, and repairs of what doesn't."""
    return screens.healed(claims(spark, sf_dir), elements(spark, sf_dir), "1", "2").drop("app_id")


FIGURES = "count(*) AS n, round(count(*) FILTER (status = 'fine') * 100 / count(*), 1) AS survived_pct, count(*) FILTER (status = 'repaired') AS n_repaired, count(*) FILTER (status = 'review') AS n_review, count(*) FILTER (status IN ('unrepairable', 'ambiguous', 'not_in_baseline')) AS n_unrepairable"


@query(f"{HEALED} SELECT strategy, {FIGURES} FROM h GROUP BY strategy UNION ALL SELECT '(all)', {FIGURES} FROM h")
def l_survival(spark, sf_dir):
    return screens.survival(screens.healed(claims(spark, sf_dir), elements(spark, sf_dir), "1", "2")).drop("app_id")


def claimed(spark, sf_dir):
    return screens.verified_claims(claims(spark, sf_dir), elements(spark, sf_dir).where("app_version = '2'"))


VERIFIED = f"""{CLAIMS}, vc AS (SELECT screen_id, role, strategy, value, CASE WHEN dumped THEN n END AS found, CASE WHEN NOT dumped THEN 'unverified' WHEN n = 0 THEN 'missing' WHEN n > 1 AND NOT regexp_matches(lower(role), 's$|item|row|cell|card|entry|option|tile|chip') THEN 'ambiguous' ELSE 'fine' END AS status FROM cf)"""


@query(f"{VERIFIED} FROM vc")
def l_claims(spark, sf_dir):
    """Locators of release 1 claimed for release 2."""
    return claimed(spark, sf_dir).drop("app_id")


def sources(spark, sf_dir):
    """Release 1 as page objects and release 2 as a crawl, whose roles are their places."""
    ranked = screens.candidates(elements(spark, sf_dir)).where("strategy IN ('accessibility_id', 'resource_id')")
    source = F.when(F.col("app_version") == "1", "page_object").otherwise("crawl")
    return ranked.select("app_id", "screen_id", source.alias("source"), F.col("app_version").cast("int").alias("source_ord"), F.concat(F.lit("role"), "app_version", F.lit("_"), "doc_pos").alias("role"), "strategy", "value", "matches")


MERGED = f"""{CANDIDATES}, so AS (SELECT screen_id, app_version AS v, CASE app_version WHEN '1' THEN 'page_object' ELSE 'crawl' END AS source, 'role' || app_version || '_' || doc_pos AS role, strategy, value, matches FROM l WHERE strategy IN ('accessibility_id', 'resource_id')),
ow AS (SELECT *, first_value(role) OVER (PARTITION BY screen_id, strategy, value ORDER BY v, role) AS owner FROM so WHERE matches = 1),
fo AS (SELECT screen_id, role, arg_min(owner, (v, owner)) AS owner FROM ow WHERE owner <> role GROUP BY ALL),
me AS (SELECT screen_id, coalesce(owner, role) AS role, strategy, value, arg_min(matches, v) AS matches, list(DISTINCT source ORDER BY source) AS sources FROM so LEFT JOIN fo USING (screen_id, role) GROUP BY ALL)"""


@query(f"{MERGED} SELECT screen_id, role, strategy, value, matches, array_to_string(sources, ',') AS sources FROM me")
def l_merged_locators(spark, sf_dir):
    return screens.merged_locators(sources(spark, sf_dir)).drop("app_id").withColumn("sources", F.array_join("sources", ","))


@query(f"""{MERGED}, ro AS (SELECT screen_id, role, arg_min(strategy, (CASE strategy WHEN 'accessibility_id' THEN 0 ELSE 1 END, value)) FILTER (matches = 1) AS strategy, flatten(list(sources)) AS sources FROM me GROUP BY screen_id, role),
de AS (SELECT DISTINCT screen_id FROM e UNION SELECT 'screen_' || (p_partkey + 1000000) FROM part WHERE p_partkey % 100 = 0)
SELECT screen_id, coalesce(array_to_string(list_sort(list_distinct(flatten(list(sources) FILTER (sources IS NOT NULL)))), ','), '') AS sources, count(role) AS n_roles, count(strategy) AS n_resolved, coalesce(round(count(strategy) / nullif(count(role), 0), 3), 0) AS rate,
count(*) FILTER (strategy = 'accessibility_id') AS accessibility_id, count(*) FILTER (strategy = 'resource_id') AS resource_id, count(*) FILTER (role IS NOT NULL AND strategy IS NULL) AS n_ambiguous,
CASE WHEN count(role) = 0 THEN 'no source reached the screen' WHEN count(strategy) < count(role) THEN 'unresolved roles' END AS diagnosis FROM de LEFT JOIN ro USING (screen_id) GROUP BY screen_id""")
def l_source_resolution(spark, sf_dir):
    """Screens of both releases and some that no source reached, by what their merged locators resolve."""
    unseen = driver.table(spark, sf_dir, "part").where("p_partkey % 100 = 0").select(F.lit("demo").alias("app_id"), F.concat(F.lit("screen_"), (F.col("p_partkey") + 1000000).cast("string")).alias("screen_id"))
    declared = elements(spark, sf_dir).select("app_id", "screen_id").union(unseen)
    rows = screens.source_resolution(screens.merged_locators(sources(spark, sf_dir)), declared)
    return rows.select("screen_id", F.array_join("sources", ",").alias("sources"), "n_roles", "n_resolved", "rate", "strategy_mix.accessibility_id", "strategy_mix.resource_id", "n_ambiguous", "diagnosis")


@query("""SELECT screen_id || '.xml' AS file, count(*) AS n_elements, count(accessibility_id) AS n_accessibility, max(depth) AS max_depth FROM (SELECT 'screen_' || CAST(FLOOR(p_partkey / 10) AS BIGINT) AS screen_id, CASE WHEN p_partkey % 3 <> 0 THEN 'a' END AS accessibility_id, 1 AS depth FROM part
UNION ALL SELECT DISTINCT 'screen_' || CAST(FLOOR(p_partkey / 10) AS BIGINT), NULL, 0 FROM part) GROUP BY ALL""")
def s_ui_dumps(spark, sf_dir):
    """Dumps that Spark writes of the parts, parsed again."""
    rows = elements(spark, sf_dir).where("app_version = '1'")
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    node = F.concat(F.lit('<node class="'), "element_type", F.lit('" content-desc="'), esc(F.col("accessibility_id")), F.lit('" text="'), esc(F.col("text")), F.lit('" clickable="'), F.col("clickable").cast("string"), F.lit('"/>'))
    dumps = rows.groupBy("screen_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("doc_pos", node.alias("n")))), lambda x: x["n"])).alias("body"))
    xml = dumps.select(F.concat("screen_id", F.lit(".xml")).alias("file"), F.concat(F.lit('<hierarchy><node class="root">'), "body", F.lit("</node></hierarchy>")).alias("content"))
    return screens.parse_dumps(xml).groupBy("file").agg(F.count("*").alias("n_elements"), F.count("accessibility_id").alias("n_accessibility"), F.max("depth").alias("max_depth"))


@query(f"{testing.BASE}, s AS (SELECT DISTINCT target AS screen FROM te) SELECT journey_id, count(*) AS n_steps, count(screen) AS n_resolved, count(screen) / count(*) AS ratio, count(screen) = count(*) AS executable FROM (SELECT path AS journey_id, unnest(walk) AS step FROM (SELECT DISTINCT path, walk FROM usable1)) LEFT JOIN s ON step = screen GROUP BY journey_id")
def l_journey_resolution(spark, sf_dir):
    reached = testing.tested(spark, sf_dir).select("app_id", F.col("target").alias("screen_id")).distinct()
    return screens.journey_resolution(testing.golden(spark, sf_dir), reached).drop("app_id")


@query(f"{testing.BASE}, s AS (SELECT DISTINCT target AS screen FROM te) SELECT step AS screen_id, count(DISTINCT journey_id) AS n_journeys FROM (SELECT path AS journey_id, unnest(walk) AS step FROM (SELECT DISTINCT path, walk FROM usable1)) WHERE step NOT IN (SELECT screen FROM s) GROUP BY step")
def l_blocking_screens(spark, sf_dir):
    reached = testing.tested(spark, sf_dir).select("app_id", F.col("target").alias("screen_id")).distinct()
    return screens.blocking_screens(testing.golden(spark, sf_dir), reached).drop("app_id")


RUNS = """r AS (SELECT CAST(l_partkey AS VARCHAR) AS test_name, l_returnflag AS profile, l_discount > 0.02 AS passed, l_quantity > 2 AS executed, l_quantity AS duration_s FROM lineitem),
v AS (SELECT test_name, count(*) FILTER (executed) AS n_runs, count(*) FILTER (executed AND passed) AS n_passed, count(DISTINCT profile) FILTER (executed) AS n_profiles, round(avg(duration_s) FILTER (executed), 2) AS mean_duration_s FROM r GROUP BY test_name),
w AS (SELECT *, n_passed / nullif(n_runs, 0) AS pass_rate, CASE WHEN n_runs = 0 OR n_profiles < 3 THEN 'unvalidated' WHEN n_passed = n_runs THEN 'validated' WHEN n_passed = 0 THEN 'failed' ELSE 'flaky' END AS verdict FROM v)"""


def runs(spark, sf_dir):
    rows = driver.table(spark, sf_dir, "lineitem")
    return rows.select(F.lit("demo").alias("app_id"), F.col("l_partkey").cast("string").alias("test_name"), F.col("l_returnflag").alias("profile"), (F.col("l_discount") > 0.02).alias("passed"), (F.col("l_quantity") > 2).alias("executed"), F.col("l_quantity").alias("duration_s"))


@query(f"WITH {RUNS} SELECT * FROM w")
def l_verdicts(spark, sf_dir):
    return outcomes.run_verdicts(runs(spark, sf_dir)).drop("app_id")


@query(f"WITH {RUNS} SELECT count(*) AS n_generated, count(*) FILTER (verdict = 'validated') AS n_validated, count(*) FILTER (verdict = 'failed') AS n_failed, count(*) FILTER (verdict = 'flaky') AS n_flaky, count(*) FILTER (verdict = 'unvalidated') AS n_unvalidated, round(100 * count(*) FILTER (verdict = 'validated') / count(*), 1) AS first_attempt_pass_rate FROM w")
def l_validation_summary(spark, sf_dir):
    return outcomes.validation_summary(outcomes.run_verdicts(runs(spark, sf_dir))).drop("app_id")


def defects(spark, sf_dir):
    rows = driver.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    journey = F.when(F.col("o_custkey") % 10 > 0, F.concat(F.lit("j"), (F.col("o_custkey") % 40).cast("string")))
    return rows.select(F.lit("demo").alias("app_id"), F.col("o_orderkey").alias("defect_id"), journey.alias("journey_id"), F.col("o_orderdate").cast("timestamp").alias("detected_at"))


def golden(spark, sf_dir):
    """Journeys j0 to j29, read off the customers, with a coverage."""
    n = F.col("c_custkey") % 40
    rows = driver.table(spark, sf_dir, "customer").select(F.concat(F.lit("j"), n.cast("string")).alias("journey_id"), n.alias("n")).distinct().where("n < 30")
    share = lambda k: (F.col("n") * k % 10) / 10
    return rows.select(F.lit("demo").alias("app_id"), "journey_id", F.when(F.col("n") % 3 == 0, 1.0).otherwise(0.5).alias("coverage"), *[share(k).alias(c) for k, c in zip((1, 3, 7, 9), outcomes.COMPONENTS, strict=True)])


DEFECTS = """d AS (SELECT o_orderkey AS defect_id, CASE WHEN o_custkey % 10 > 0 THEN 'j' || (o_custkey % 40) END AS journey_id, o_custkey % 40 AS n FROM orders WHERE o_orderpriority = '1-URGENT'),
a AS (SELECT defect_id, journey_id, n, CASE WHEN journey_id IS NULL THEN 'out_of_scope' WHEN n >= 30 THEN 'unknown_journey' WHEN n % 3 = 0 THEN 'covered_but_missed' ELSE 'uncovered_gap' END AS origin FROM d)"""
GAPS = "g AS (SELECT o_orderpriority = '2-HIGH' AS caused, o_orderstatus = 'F' AS closed FROM orders WHERE o_orderpriority <> '1-URGENT')"


@query(f"WITH {DEFECTS} SELECT defect_id, journey_id, origin FROM a")
def j_defect_origin(spark, sf_dir):
    return outcomes.attributed(defects(spark, sf_dir), golden(spark, sf_dir)).select("defect_id", "journey_id", "origin")


def exports(spark, sf_dir):
    """Orders as tracker exports that Spark writes: one document for each customer, a bare array for
    every third; urgent orders are defects and the others reported gaps."""
    rows = driver.table(spark, sf_dir, "orders")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    defect = F.struct(F.col("o_orderkey").cast("string").alias("defect_id"), F.when(F.col("o_custkey") % 4 > 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("detected_at"), F.when(F.col("o_orderstatus") != "P", F.lower("o_orderstatus")).alias("severity"), F.array(F.concat(F.lit("s"), F.col("o_custkey").cast("string"))).alias("screens"))
    gap = F.struct(F.col("o_orderkey").cast("string").alias("journey_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("reported_at"), F.when(F.col("o_orderstatus") == "F", "t").alias("closed_by_test"), F.when(F.col("o_orderpriority") == "2-HIGH", "d").alias("caused_defect"))
    lists = rows.groupBy("o_custkey").agg(F.collect_list(F.when(urgent, defect)).alias("defects"), F.collect_list(F.when(~urgent, gap)).alias("gaps_reported"))
    path = new_path(spark, "exports")
    lists.select(F.when(F.col("o_custkey") % 3 == 0, F.to_json("defects")).otherwise(F.to_json(F.struct("defects", "gaps_reported"))).alias("value")).write.text(path)
    return read_exports(spark, path, lines=True)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS defect_id, CASE WHEN o_custkey % 4 > 0 THEN epoch_us(o_orderdate::TIMESTAMP) ELSE 0 END AS detected_us, CASE WHEN o_orderstatus <> 'P' THEN lower(o_orderstatus) ELSE 'medium' END AS severity, 's' || o_custkey AS screens, 0::INTEGER AS n_tests FROM orders WHERE o_orderpriority = '1-URGENT'""")
def s_defects(spark, sf_dir):
    """Defects of exports, written and read back."""
    rows = read_defects(exports(spark, sf_dir), "demo", F.timestamp_micros(F.lit(0)))
    return rows.select("defect_id", F.unix_micros("detected_at").alias("detected_us"), "severity", F.array_join("screens", ",").alias("screens"), F.size("covering_tests").alias("n_tests"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS journey_id, epoch_us(o_orderdate::TIMESTAMP) AS reported_us, 'medium' AS severity, CASE WHEN o_orderstatus = 'F' THEN 't' END AS closed_by_test, o_orderpriority = '2-HIGH' AS caused_defect FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_custkey % 3 > 0""")
def s_reported_gaps(spark, sf_dir):
    """Reported gaps of exports, which bare arrays don't have."""
    return reported_gaps(exports(spark, sf_dir), "demo").select("journey_id", F.unix_micros("reported_at").alias("reported_us"), "severity", "closed_by_test", "caused_defect")


def report(spark, sf_dir):
    rows = driver.table(spark, sf_dir, "orders").where("o_orderpriority <> '1-URGENT'")
    gaps = rows.select(F.lit("demo").alias("app_id"), F.when(F.col("o_orderstatus") == "F", "t").alias("closed_by_test"), (F.col("o_orderpriority") == "2-HIGH").alias("caused_defect"))
    return outcomes.outcome_report(outcomes.attributed(defects(spark, sf_dir), golden(spark, sf_dir)), gaps)


@query(f"""WITH {DEFECTS}, {GAPS}, n AS (SELECT count(*) FILTER (origin = 'uncovered_gap') AS n_gap, count(*) FILTER (origin = 'covered_but_missed') AS n_missed, count(*) FILTER (origin = 'unknown_journey') AS n_unknown, count(*) FILTER (origin = 'out_of_scope') AS n_out, count(*) AS n_defects FROM a),
o AS (SELECT count(*) FILTER (caused) AS true_positives, count(*) FILTER (NOT caused AND closed) AS false_positives, count(*) FILTER (NOT caused AND NOT closed) AS unresolved FROM g)
SELECT *, n_missed + n_unknown AS false_negatives, true_positives / nullif(true_positives + false_positives, 0) AS precision, true_positives / nullif(true_positives + n_missed + n_unknown, 0) AS recall, n_unknown / nullif(n_defects - n_out, 0) AS blind_spot, (SELECT epoch_us(min(o_orderdate)::TIMESTAMP) FROM orders WHERE o_orderpriority = '1-URGENT') AS window_start, (SELECT epoch_us(max(o_orderdate)::TIMESTAMP) FROM orders WHERE o_orderpriority = '1-URGENT') AS window_end FROM n, o""")
def o_outcomes(spark, sf_dir):
    rows = report(spark, sf_dir).drop("app_id")
    return rows.withColumns({c: F.unix_micros(c) for c in ("window_start", "window_end")})


RATES = """h AS (SELECT component, count(*) AS n, count(*) FILTER ((n * k) % 10 >= 5) AS n_seen, count(*) FILTER ((n * k) % 10 >= 5) / count(*) AS hit_rate FROM a, (VALUES ('frequency', 1), ('business_value', 3), ('risk', 7), ('exposure', 9)) AS c(component, k) WHERE origin NOT IN ('out_of_scope', 'unknown_journey') GROUP BY component)"""


@query(f"WITH {DEFECTS}, {RATES} SELECT * FROM h")
def o_hit_rate(spark, sf_dir):
    goals = golden(spark, sf_dir)
    return outcomes.hit_rates(outcomes.attributed(defects(spark, sf_dir), goals), goals).drop("app_id")


@query(f"""WITH {DEFECTS}, {RATES}, w AS (SELECT component, CASE component WHEN 'frequency' THEN 0.3 WHEN 'business_value' THEN 0.3 WHEN 'risk' THEN 0.25 ELSE 0.15 END AS weight, greatest(-0.05, least(0.05, (hit_rate - avg(hit_rate) OVER ()) * 0.2)) AS delta FROM h)
SELECT component, CAST(weight AS DOUBLE) AS weight, round(delta, 6) AS delta, round(greatest(0.05, weight + delta), 6) AS proposed FROM w""")
def o_weight_proposal(spark, sf_dir):
    goals = golden(spark, sf_dir)
    rates = outcomes.hit_rates(outcomes.attributed(defects(spark, sf_dir), goals), goals)
    return outcomes.weight_proposal(rates, archetypes.WEIGHTS).select("component", "weight", F.round("delta", 6).alias("delta"), F.round("proposed", 6).alias("proposed"))


def lineage(spark, sf_dir):
    """Tests of the parts with the provenance that customers tell, reviewed by orders up to a date."""
    told = driver.table(spark, sf_dir, "customer").where("c_custkey % 3 > 0")
    provenance = told.select(
        F.lit("demo").alias("app_id"), F.col("c_custkey").cast("string").alias("artifact_id"), F.when(F.col("c_custkey") % 7 > 0, F.concat(F.lit("j"), "c_nationkey")).alias("journey_id"), F.col("c_custkey").alias("sessions"), F.when(F.col("c_custkey") % 5 > 0, "f").otherwise("").alias("taxonomy_fingerprint"),
        F.array(F.lit("crawl")).alias("locator_sources"), F.lit("template").alias("generator"), F.lit("m").alias("model"), F.col("c_name").alias("prompt"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )
    orders = driver.table(spark, sf_dir, "orders")
    decision = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "rejected").otherwise("pending")
    reviews = orders.select(F.lit("demo").alias("app_id"), F.col("o_custkey").cast("string").alias("artifact_id"), F.col("o_orderdate").cast("timestamp").alias("reviewed_at"), F.col("o_orderkey").alias("review_id"), decision.alias("review_decision"), F.when(F.col("o_orderkey") % 10 > 0, "r").alias("reviewer"), F.concat(F.lit("  "), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")).otherwise("")).alias("rejection_reason"))
    return outcomes.lineage_from_runs(runs(spark, sf_dir), provenance, reviews, F.lit(REVIEWED).cast("timestamp"))


REVIEWED = "1997-01-01"
LINEAGE = f"""WITH {RUNS}, pf AS (SELECT test_name, string_agg(DISTINCT profile, ',' ORDER BY profile) AS profiles FROM r GROUP BY test_name),
rv AS (SELECT CAST(o_custkey AS VARCHAR) AS test_name, arg_max({{'d': CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'rejected' ELSE 'pending' END, 'by': CASE WHEN o_orderkey % 10 > 0 THEN 'r' END, 'why': '  ' || CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority ELSE '' END}}, (o_orderdate, o_orderkey)) AS x FROM orders WHERE o_orderdate <= DATE '{REVIEWED}' GROUP BY 1),
ln AS (SELECT test_name AS artifact_id, CASE WHEN c_custkey % 7 > 0 THEN 'j' || c_nationkey END AS journey_id, CASE WHEN c_custkey % 5 > 0 THEN 'f' ELSE '' END AS fingerprint, CASE WHEN c_custkey IS NOT NULL THEN 'template' END AS generator, left(sha256(c_name), 16) AS prompt_hash,
  n_runs AS validation_runs, profiles, coalesce(x.d, 'pending') AS decision, x.by AS reviewer, x.why AS why FROM v JOIN pf USING (test_name) LEFT JOIN rv USING (test_name) LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = test_name AND c_custkey % 3 > 0)"""


@query(f"{LINEAGE} SELECT artifact_id, journey_id, prompt_hash, validation_runs, profiles, decision AS review_decision, coalesce(journey_id <> '' AND generator <> '' AND fingerprint <> '', false) AS complete FROM ln")
def o_lineage_rows(spark, sf_dir):
    """Lineage of tests from their runs, provenance and the last review before a date."""
    rows = lineage(spark, sf_dir)
    return rows.select("artifact_id", "journey_id", "prompt_hash", "validation_runs", F.array_join("validation_profiles", ",").alias("profiles"), "review_decision", outcomes.complete().alias("complete"))


@query(f"""{LINEAGE} SELECT count(*) AS n, count(*) FILTER (journey_id <> '' AND generator <> '' AND fingerprint <> '') AS n_complete, count(*) FILTER (decision = 'approved' AND reviewer <> '') AS n_approved, count(*) FILTER (decision = 'rejected') AS n_rejected, count(*) FILTER (decision = 'pending') AS n_pending,
round(count(*) FILTER (decision = 'approved' AND reviewer <> '') / count(*), 3) AS acceptance_rate FROM ln""")
def o_lineage(spark, sf_dir):
    """The log, written and read back."""
    path = new_path(spark, "lineage")
    outcomes.append_lineage(lineage(spark, sf_dir), path)
    return outcomes.lineage_summary(spark.read.parquet(path)).drop("app_id")


@query(f"{LINEAGE} SELECT coalesce(nullif(lower(trim(why)), ''), 'unspecified') AS theme, count(*) AS n FROM ln WHERE decision = 'rejected' GROUP BY 1")
def o_rejection_themes(spark, sf_dir):
    return outcomes.rejection_themes(lineage(spark, sf_dir)).drop("app_id")


@query("""WITH c AS (SELECT l_returnflag AS category, l_orderkey, CAST(l_quantity * CASE l_linestatus WHEN 'F' THEN 0.05 ELSE 0.003 END AS DECIMAL(28, 6)) AS cost FROM lineitem)
SELECT category, CAST(sum(cost) AS DOUBLE) AS total, count(DISTINCT l_orderkey) AS n_artifacts, round(CAST(sum(cost) AS DOUBLE) / count(DISTINCT l_orderkey), 6) AS per_artifact FROM c GROUP BY category""")
def o_cost(spark, sf_dir):
    rows = driver.table(spark, sf_dir, "lineitem")
    usage = rows.select(F.lit("demo").alias("app_id"), F.col("l_returnflag").alias("category"), F.col("l_quantity").alias("units"), F.when(F.col("l_linestatus") == "F", "device_minute").otherwise("input_tokens_1k").alias("unit"), F.col("l_orderkey").cast("string").alias("artifact_id"))
    return outcomes.cost_summary(outcomes.costs(usage, {"device_minute": 0.05, "input_tokens_1k": 0.003})).drop("app_id").withColumn("per_artifact", F.round("per_artifact", 6))


def snapshots(spark, sf_dir, release: str):
    """Metrics of each nation's customers; release 2 counts the rich ones only."""
    rows = driver.table(spark, sf_dir, "customer").where("c_acctbal > 0" if release == "2" else "TRUE")
    return rows.groupBy(F.col("c_nationkey").cast("string").alias("app_id")).agg(F.lit(release).alias("release_version"), F.count("*").cast("double").alias("total_test_count"), F.count_if(F.col("c_mktsegment") == "BUILDING").cast("double").alias("flaky_test_pct"), F.lit("n").alias("notes"))


@query("""WITH m AS (SELECT CAST(c_nationkey AS VARCHAR) AS app_id, count(*) AS a0, count(*) FILTER (c_acctbal > 0) AS a1, count(*) FILTER (c_mktsegment = 'BUILDING') AS b0, count(*) FILTER (c_mktsegment = 'BUILDING' AND c_acctbal > 0) AS b1 FROM customer GROUP BY 1),
l AS (SELECT app_id, 'total_test_count' AS metric, CAST(a0 AS DOUBLE) AS before, CAST(a1 AS DOUBLE) AS after FROM m WHERE a1 > 0 UNION ALL SELECT app_id, 'flaky_test_pct', CAST(b0 AS DOUBLE), CAST(b1 AS DOUBLE) FROM m WHERE a1 > 0)
SELECT *, after - before AS delta, (after - before) * 100 / nullif(before, 0) AS delta_pct, CASE WHEN after <> before THEN (after > before) = (metric = 'total_test_count') END AS improved FROM l""")
def o_baseline_delta(spark, sf_dir):
    after = snapshots(spark, sf_dir, "2")
    return outcomes.baseline_delta(snapshots(spark, sf_dir, "1").join(after.select("app_id"), "app_id", "left_semi"), after)


@query("SELECT CAST(c_nationkey AS VARCHAR) AS app_id, '1' AS release_version, CAST(count(*) AS DOUBLE) AS total_test_count FROM customer GROUP BY 1 UNION ALL SELECT CAST(c_nationkey AS VARCHAR), '2', CAST(count(*) AS DOUBLE) FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def k_snapshots(spark, sf_dir):
    """Snapshots of two releases, saved and loaded with their checksums verified."""
    path = new_path(spark, "snapshots")
    outcomes.save_snapshots(snapshots(spark, sf_dir, "1"), path)
    outcomes.save_snapshots(snapshots(spark, sf_dir, "2"), path)
    return outcomes.load_snapshots(spark, path).select("app_id", "release_version", "total_test_count")


def portfolio(spark, sf_dir):
    rows = driver.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("app_id")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("rich"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("b"))
    day = F.to_date(F.lit("2024-01-01"))
    apps = rows.select("app_id", F.when(F.col("n") % 7 == 0, "paused").otherwise("active").alias("status"), F.when(F.col("n") % 5 > 0, F.col("rich") * 100 / F.col("n")).alias("coverage_pct"), (F.col("b") % 2).alias("critical_gaps"), F.col("rich").alias("escaped_defects"), F.col("b").alias("baseline_defects"), day.alias("onboarded_on"), F.date_add(day, F.col("n").cast("int")).alias("live_on"))
    return outcomes.portfolio(apps)


PORTFOLIO = """p AS (SELECT CAST(c_nationkey AS VARCHAR) AS app_id, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS rich, count(*) FILTER (c_mktsegment = 'BUILDING') AS b FROM customer GROUP BY 1),
q AS (SELECT app_id, CASE WHEN n % 7 = 0 THEN 'paused' ELSE 'active' END AS status, CASE WHEN n % 5 > 0 THEN rich * 100 / n END AS coverage_pct, b % 2 AS critical_gaps, round((rich - b) * 100 / nullif(b, 0), 1) AS defect_delta_pct, CAST(n AS INTEGER) AS onboarding_days FROM p)"""


@query(f"WITH {PORTFOLIO} SELECT app_id, CASE WHEN status <> 'active' THEN status WHEN coverage_pct IS NULL THEN 'no-data' WHEN critical_gaps > 0 OR coverage_pct < 50 THEN 'at-risk' ELSE 'healthy' END AS health, defect_delta_pct, onboarding_days FROM q")
def o_portfolio(spark, sf_dir):
    return portfolio(spark, sf_dir).select("app_id", "health", "defect_delta_pct", "onboarding_days")


@query(f"WITH {PORTFOLIO} SELECT app_id, coverage_pct FROM q WHERE status = 'active' ORDER BY coverage_pct NULLS FIRST, app_id LIMIT 3")
def o_weakest(spark, sf_dir):
    return outcomes.weakest(portfolio(spark, sf_dir)).select("app_id", "coverage_pct")


def stream(spark, sf_dir):
    """The driver's events as a stream of canonical events."""
    path = f"{sf_dir}/events.parquet"
    raw = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    user = F.col("user_id").cast("string")
    return raw.select(F.lit("demo").alias("app_id"), "event_id", F.col("event_type").alias("event_name"), F.col("event_type").alias("screen_id"), user.alias("session_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("props").alias("properties"))


@query(f"""{journeys.ONE} SELECT session_id, epoch_us(started) AS started_us, epoch_us(ended) AS ended_us, n_events, path FROM traces WHERE ended + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def t_sessions(spark, sf_dir):
    """Sessions that a stream over the events has closed."""
    out = new_path(spark, "stream-sessions")
    streams.run_to_table(streams.sessions(stream(spark, sf_dir), "6 hours"), out, f"{out}-state")
    return spark.read.parquet(out).select("session_id", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "n_events", journeys.path_text())


@query("SELECT epoch_us(date_trunc('hour', ts)) AS window_us, count(*) AS n_events, 0 AS no_session, 0 AS no_screen, count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY 1")
def t_counters(spark, sf_dir):
    """Quality counters of a stream, the last state of each window."""
    out = new_path(spark, "stream-counters")
    streams.run_to_table(streams.counters(stream(spark, sf_dir)), out, f"{out}-state", "update")
    rows = spark.read.parquet(out)
    last = rows.groupBy("window_start").agg(F.max_by(F.struct("n_events", "no_session", "no_screen", "n_errors"), "batch").alias("c"))
    return last.select(F.unix_micros("window_start").alias("window_us"), "c.*")


@query(f"""WITH {contracts.VIOLATIONS}, k AS (SELECT event_id, bool_or(violation = 'unknown_event') AS unknown, bool_or(violation = 'wrong_screen') AS wrong, bool_or(violation = 'missing_property') AS missing, bool_or(violation = 'type_mismatch') AS mismatch FROM v GROUP BY event_id)
SELECT epoch_us(date_trunc('hour', ts)) AS window_us, count(*) AS n_events, count(k.event_id) AS n_offending, count(*) FILTER (unknown) AS n_unknown_event, count(*) FILTER (wrong) AS n_wrong_screen, count(*) FILTER (missing) AS n_missing_property, count(*) FILTER (mismatch) AS n_type_mismatch FROM events LEFT JOIN k USING (event_id) GROUP BY 1""")
def t_conformance(spark, sf_dir):
    """Conformance of a stream to the plan, the last state of each window."""
    out = new_path(spark, "stream-conformance")
    figures = ("n_events", "n_offending", "n_unknown_event", "n_wrong_screen", "n_missing_property", "n_type_mismatch")
    streams.run_to_table(streams.conformance(stream(spark, sf_dir), *contracts.plan(spark, sf_dir)), out, f"{out}-state", "update")
    last = spark.read.parquet(out).groupBy("window_start").agg(F.max_by(F.struct(*figures), "batch").alias("c"))
    return last.select(F.unix_micros("window_start").alias("window_us"), "c.*")


@query("SELECT event_type AS event_name, count(*) AS n FROM events GROUP BY event_type")
def t_ingest(spark, sf_dir):
    """The store after a stream."""
    out = new_path(spark, "stream-store")
    streams.ingest(stream(spark, sf_dir), out, f"{out}-state").awaitTermination()
    return spark.read.parquet(out).groupBy("event_name").agg(F.count("*").alias("n"))


@query(f"""{journeys.ONE} SELECT session_id, epoch_us(started) AS started_us, epoch_us(ended) AS ended_us, n_events, path FROM traces""")
def t_session_window(spark, sf_dir):
    """The stream's function over a table."""
    rows = streams.sessions(driver.events(spark, sf_dir), "6 hours")
    return rows.select("session_id", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "n_events", journeys.path_text())


def gate(name: str, check: str, passed: str, detail: str, rows: str, app: str = "demo") -> str:
    return f"""SELECT '{app}' AS app_id, '{name}' AS gate, '{check}' AS "check", {passed} AS passed, CAST({detail} AS VARCHAR) AS detail FROM ({rows})"""


#: Each check over the rows of the query that it judges.
GATES = " UNION ALL ".join(
    [
        gate("foundation", "taxonomy", "count(*) = 0", "count(*)", contracts.ORACLE_SQL["q_taxonomy_issues"] + ") WHERE severity IN ('error'"),
        gate("foundation", "readiness", "passed", "round(score, 1)", contracts.ORACLE_SQL["q_readiness_verdict"]),
        gate("foundation", "registry", "sum(n_entries) > 0 AND sum(n_stale) = 0", "sum(n_entries) || ' entries, ' || sum(n_stale) || ' stale'", testing.ORACLE_SQL["q_registry_categories"]),
        gate("foundation", "baseline", "count(*) > 0", "count(*)", "SELECT 1 WHERE EXISTS (FROM customer)"),
        gate("store", "plan", "count(*) = 0", "count(*)", contracts.ORACLE_SQL["q_plan_issues"] + ") WHERE severity IN ('error'"),
        gate("store", "quality", "bool_and(passed OR NOT blocking)", "count(*) FILTER (NOT passed) || ' failed'", f"SELECT passed, blocking FROM ({journeys.ORACLE_SQL['q_checks']}) UNION ALL SELECT conformance_pct >= {quality.CHECKS['conformance_pct'][0]}, {quality.CHECKS['conformance_pct'][2]} FROM ({contracts.ORACLE_SQL['q_conformance']})"),
        gate("store", "conformance", "conformance_pct >= 95", "round(conformance_pct, 2)", contracts.ORACLE_SQL["q_conformance"]),
        gate("store", "no_personal_data", "coalesce(sum(n), 0) = 0", "coalesce(sum(n), 0)", contracts.ORACLE_SQL["q_pii_report"]),
        gate("store", "risk_located", "n_located > 0", "n_located", journeys.ORACLE_SQL["q_localisation_rate"]),
        gate("suite", "parsed", "count(*) FILTER (parsed) * 100 / count(*) >= 85", "round(count(*) FILTER (parsed) * 100 / count(*), 2)", f"{testing.BASE} SELECT string_split(test_id, '#')[1] AS file, bool_or(screen_id <> 'click') AS parsed FROM refs GROUP BY 1"),
        gate("suite", "mapped", "max(n) FILTER (label = 'mapped') * 100 / max(n) FILTER (label = 'all') >= 70", "round(max(n) FILTER (label = 'mapped') * 100 / max(n) FILTER (label = 'all'), 2)", testing.ORACLE_SQL["g_suite_summary"]),
        gate("suite", "covered", "n_transitions > 0", "round(covered_pct, 2)", testing.ORACLE_SQL["g_coverage"]),
        gate("suite", "findings", "sum(n) > 0", "sum(n)", testing.ORACLE_SQL["g_tallies"] + ") WHERE measure IN ('kind'"),
        gate("suite", "registry_used", "true", "n", testing.ORACLE_SQL["g_tallies"] + ") WHERE label IN ('protected_retained'"),
        gate("locators", "resolved", "sum(n_resolved) / sum(n_steps) >= 0.8", "round(sum(n_resolved) / sum(n_steps), 4)", ORACLE_SQL["l_journey_resolution"]),
        gate("locators", "executable", "count(*) FILTER (executable) > 0", "count(*) FILTER (executable) || ' of ' || count(*)", ORACLE_SQL["l_journey_resolution"]),
        gate("locators", "diagnosed", "count(*) FILTER (n_resolved = 0) = 0 OR count(*) FILTER (n_resolved = 0 AND n_no_candidate + n_ambiguous + n_fragile > 0) > 0", "count(*) FILTER (n_resolved = 0 AND n_no_candidate + n_ambiguous + n_fragile > 0)", ORACLE_SQL["l_resolution"]),
        gate("locators", "identity", "stability_pct >= 80", "round(stability_pct, 2)", ORACLE_SQL["l_identity_stability"]),
        gate("locators", "none_fragile", "count(*) FILTER (strategy = 'positional_xpath') = 0", "count(*) FILTER (strategy = 'positional_xpath')", ORACLE_SQL["l_best"]),
        gate("locators", "claims_hold", "count(*) FILTER (status IN ('missing', 'ambiguous')) = 0", "count(*) FILTER (status IN ('missing', 'ambiguous'))", ORACLE_SQL["l_claims"]),
        gate("runs", "validated", "count(*) FILTER (verdict = 'validated') > 0", "count(*) FILTER (verdict = 'validated')", ORACLE_SQL["l_verdicts"]),
        gate("outcomes", "attributed", "n_defects > 0", "n_defects", ORACLE_SQL["o_outcomes"]),
        gate("outcomes", "defined", "precision IS NOT NULL AND recall IS NOT NULL", "round(precision, 3)", ORACLE_SQL["o_outcomes"]),
        gate("outcomes", "blind_spot", "blind_spot <= 0.5", "round(blind_spot, 3)", ORACLE_SQL["o_outcomes"]),
        gate("outcomes", "proposal", "count(*) > 0", "count(*)", ORACLE_SQL["o_weight_proposal"]),
        gate("portfolio", "apps_with_data", "count(*) FILTER (health <> 'no-data') >= 3", "count(*) FILTER (health <> 'no-data')", ORACLE_SQL["o_portfolio"], "(all)"),
        gate("portfolio", "scaffold", "count(*) > 0", "count(*)", contracts.ORACLE_SQL["q_scaffold_screens"], "(all)"),
    ]
)


@query(GATES)
def x_gates(spark, sf_dir):
    """All gates of the demo app but that of the journeys."""
    events = driver.events(spark, sf_dir)
    apps = events.select("app_id").distinct()
    declared = contracts.declared(spark, sf_dir)
    conformance = contracts.contract.conformance(events, contracts.contract.violations(events, *contracts.plan(spark, sf_dir)))
    checks = quality.verdict(quality.checks(events, declared.select("app_id", "screen_id"), F.lit("2024-02-01 00:00:00").cast("timestamp"), conformance.select("app_id", "conformance_pct")))
    part_screens = contracts.part_screens(spark, sf_dir)
    taxonomy = contracts.contract.taxonomy_issues(part_screens, part_screens.where("domain LIKE '%1'").select("app_id", "domain").distinct())
    registry = testing.gaps.entries_by_category(testing.registry(spark, sf_dir), F.to_date(F.lit(testing.TODAY)))
    baselines = snapshots(spark, sf_dir, "1").select(F.lit("demo").alias("app_id")).distinct()
    tables = reference, walked, prod, goal_paths = testing.suite_tables(spark, sf_dir)
    covered, test_rows = coverage.journey_coverage(goal_paths, walked), testing.tests_of(reference)
    suite = coverage.summary(coverage.transition_coverage(prod, walked), covered, test_rows, coverage.test_paths(reference))
    files = reference.groupBy("app_id", F.split_part("test_id", F.lit("#"), F.lit(1)).alias("file")).agg(F.bool_or(F.col("confidence") != "low").alias("parsed"))
    goals = golden(spark, sf_dir)
    proposal = outcomes.weight_proposal(outcomes.hit_rates(outcomes.attributed(defects(spark, sf_dir), goals), goals), archetypes.WEIGHTS)
    element_rows = elements(spark, sf_dir)
    found = cut(best_locators(spark, sf_dir), "best-locators")
    reached = walked.select("app_id", F.col("target").alias("screen_id")).distinct()
    rows = gates.all_of(
        gates.foundation_gate(taxonomy, readiness.verdict(readiness.dimensions(events, declared)), apps, registry, baselines),
        gates.store_gate(contracts.contract.plan_issues(*contracts.order_plan(spark, sf_dir)), checks, conformance, contracts.personal(spark, sf_dir), risk.localisation_rate(journeys.located(spark, sf_dir))),
        gates.suite_gate(files, suite, test_rows, testing.findings(spark, sf_dir, tables), registry),
        gates.locator_gate(screens.journey_resolution(goal_paths, reached), found, screens.screen_resolution(found), screens.identity_stability(screens.matched_screens(screens.fingerprints(element_rows), "1", "2")), claimed(spark, sf_dir)),
        gates.run_gate(outcomes.run_verdicts(runs(spark, sf_dir))),
        gates.outcome_gate(report(spark, sf_dir), proposal),
        gates.portfolio_gate(portfolio(spark, sf_dir), readiness.draft_screens(events)),
    )
    return rows.select("app_id", "gate", "check", "passed", "detail")


@query(f"""{clusters.ARCHETYPES}, ok AS (SELECT (SELECT min(nth) FILTER (reached >= 95) FROM re) <= 100 AS tractable, NOT EXISTS (FROM ev WHERE screen_id = 'purchase') OR EXISTS (FROM usable WHERE list_contains(walk, 'purchase')) AS seen,
EXISTS (FROM gr) AS built, (SELECT sum(n_sessions) FROM gr) >= 0.95 * (SELECT count(*) FROM usable) AS mapped, (SELECT count(*) > 0 FROM ({journeys.ORACLE_SQL["q_risk_by_screen"]})) AS located)
SELECT 'demo' AS app_id, 'journeys' AS gate, tractable AND seen AND built AND mapped AND located AS passed, CAST(6 AS BIGINT) AS n_checks, CAST(1 + tractable::INT + seen::INT + built::INT + mapped::INT + located::INT AS BIGINT) AS n_passed FROM ok""")
def x_journey_gate(spark, sf_dir):
    """The gate of the mined catalogue."""
    member_rows = archetypes.members(clusters.found(spark, sf_dir), clusters.CRITICAL)
    rows = archetypes.archetypes(member_rows)
    seen = driver.events(spark, sf_dir).select("app_id", "screen_id").distinct().withColumns({"display_name": F.initcap("screen_id"), "domain": F.lit("shop"), "critical": F.col("screen_id").isin(clusters.CRITICAL)})
    walked = journeys.traces(spark, sf_dir)
    unseen = graph.unseen_critical(seen, graph.nodes(walked))
    return gates.verdicts(gates.journey_gate(archetypes.compression(rows), archetypes.named(rows, seen), unseen, walked, risk.by_screen(journeys.located(spark, sf_dir))))


#: Parts as claimed locators of all forms.
CLAIMED = """v AS (SELECT p_partkey, CASE p_partkey % 14 WHEN 0 THEN '~' || p_name WHEN 1 THEN 'id=x' || p_partkey WHEN 2 THEN 'com.app:id/x' WHEN 3 THEN '//a[' || p_partkey || ']' WHEN 4 THEN '(//a)[3]' WHEN 5 THEN '//a[@text=''b'']'
WHEN 6 THEN '(/a/b' WHEN 7 THEN '**/XCUIElementTypeCell' WHEN 8 THEN '10, 20' WHEN 9 THEN '-android uiautomator x' WHEN 10 THEN '-ios predicate y' WHEN 11 THEN '#css' WHEN 12 THEN '.css' ELSE '  ' || p_name END AS value FROM part)"""


@query(f"""WITH {CLAIMED}, t AS (SELECT p_partkey, trim(value) AS value FROM v)
SELECT p_partkey, CASE WHEN value LIKE '~%' THEN 'accessibility_id' WHEN contains(value, ':id/') OR value LIKE 'id=%' THEN 'resource_id'
  WHEN value LIKE '//%' OR value LIKE '(%' THEN CASE WHEN len([1 FOR k IN range(1, 20) IF contains(value, '[' || k || ']')]) > 0 THEN 'positional_xpath' ELSE 'semantic_xpath' END
  WHEN value LIKE '**/%' THEN 'class_chain' ELSE 'accessibility_id' END AS strategy,
  CASE WHEN value LIKE '//%' OR value LIKE '(//%' THEN 'xpath' WHEN value LIKE '~%' THEN 'accessibility_id' WHEN contains(value, ':id/') OR value LIKE 'id=%' THEN 'resource_id'
  WHEN value LIKE '-android uiautomator%' OR value LIKE '-ios%' THEN 'platform_query' WHEN value LIKE '#%' OR value LIKE '.%' THEN 'css' ELSE 'other' END AS in_suite FROM t""")
def p_locator_strategy(spark, sf_dir):
    """Strategies told from the locator strings alone, by the resolver's and by the suite's rules."""
    rows = spark.sql(f"WITH part AS (SELECT * FROM {{part}}), {CLAIMED} SELECT * FROM v", part=driver.table(spark, sf_dir, "part"))
    return rows.select("p_partkey", locator_strategy(F.col("value")).alias("strategy"), suite_strategy(F.col("value")).alias("in_suite"))


@query(f"""WITH {CLAIMED}, t AS (SELECT trim(value) AS value FROM v), f AS (SELECT test_name, bool_or(executed) AS parsed FROM (SELECT CAST(l_partkey AS VARCHAR) AS test_name, l_quantity > 45 AS executed FROM lineitem) GROUP BY test_name)
SELECT 'files' AS measure, 'scanned' AS label, CAST(count(*) AS DOUBLE) AS value FROM f UNION ALL SELECT 'files', 'parse_rate_pct', round(count(*) FILTER (parsed) * 100 / count(*), 1) FROM f
UNION ALL SELECT 'page_objects', 'all', count(*) FROM part UNION ALL SELECT 'page_objects', 'bound', count(*) FILTER (p_size % 3 > 0) FROM part
UNION ALL SELECT 'locators', CASE WHEN value LIKE '//%' OR value LIKE '(//%' THEN 'xpath' WHEN value LIKE '~%' THEN 'accessibility_id' WHEN contains(value, ':id/') OR value LIKE 'id=%' THEN 'resource_id'
  WHEN value LIKE '-android uiautomator%' OR value LIKE '-ios%' THEN 'platform_query' WHEN value LIKE '#%' OR value LIKE '.%' THEN 'css' ELSE 'other' END, count(*) FROM t GROUP BY 2""")
def g_suite_quality(spark, sf_dir):
    """Files, page objects and locators of a suite read off line items and parts."""
    files = runs(spark, sf_dir).groupBy("app_id", F.col("test_name").alias("file")).agg(F.bool_or(F.col("duration_s") > 45).alias("parsed"))
    parts = driver.table(spark, sf_dir, "part")
    objects = parts.select(F.lit("demo").alias("app_id"), F.col("p_partkey").alias("page_object"), F.when(F.col("p_size") % 3 > 0, "s").alias("screen_id"))
    values = spark.sql(f"WITH part AS (SELECT * FROM {{part}}), {CLAIMED} SELECT 'demo' AS app_id, value FROM v", part=parts)
    return coverage.suite_quality(files, objects, values).drop("app_id")
