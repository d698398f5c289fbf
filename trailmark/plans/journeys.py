"""Queries over the driver's events: sessions, graph, variants, drift, parity, risk, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.cutting import cut, new_path
from trailmark.operators import archetypes, drift, graph, ingest, parity, quality, risk, sessions, variants
from trailmark.sources import driver

TIMEOUT_S = 6 * 3600


def path_text():
    return F.array_join("path", " > ").alias("path")


def steps(spark: SparkSession, sf_dir: str, half: str | None = None) -> DataFrame:
    rows = driver.events(spark, sf_dir)
    return sessions.trace_steps(rows if half is None else rows.where(F.col("app_version") == half), TIMEOUT_S)


def traces(spark: SparkSession, sf_dir: str, half: str | None = None) -> DataFrame:
    return sessions.traces(steps(spark, sf_dir, half))


def ctes(n: str = "", where: str = "TRUE") -> str:
    """DuckDB: steps and traces of the events under a condition."""
    return f"""
g{n} AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS opens FROM ev WHERE {where} WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
s{n} AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM g{n}),
c{n} AS (SELECT *, CASE WHEN screen_id <> lag(screen_id) OVER w THEN 1 ELSE 0 END AS changed FROM s{n} WINDOW w AS (PARTITION BY session_id, segment ORDER BY ts, event_id)),
n{n} AS (SELECT *, CAST(sum(changed) OVER (PARTITION BY session_id, segment ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS step_no FROM c{n}),
steps{n} AS (SELECT session_id, segment, session_id || CASE WHEN segment > 0 THEN '#' || segment ELSE '' END AS trace_id, step_no, min(screen_id) AS screen_id,
  min(ts) AS entered, max(ts) AS exited, count(*) AS n_events, count(*) FILTER (screen_id <> 'view') AS n_interactions, sum(CAST(value AS DECIMAL(28, 6))) AS order_value,
  min(platform) AS platform FROM n{n} GROUP BY session_id, segment, step_no),
traces{n} AS (SELECT session_id, segment, trace_id, list(screen_id ORDER BY step_no) AS walk, string_agg(screen_id, ' > ' ORDER BY step_no) AS path, min(entered) AS started, max(exited) AS ended,
  count(*) AS length, CAST(sum(n_events) AS BIGINT) AS n_events, CAST(sum(n_interactions) AS BIGINT) AS n_interactions, sum(order_value) AS order_value, arg_max(screen_id, step_no) AS terminal, min(platform) AS platform
  FROM steps{n} GROUP BY session_id, segment, trace_id),
usable{n} AS (SELECT * FROM traces{n} WHERE length >= 2),
pairs{n} AS (SELECT trace_id, walk[i] AS source, walk[i + 1] AS target, i FROM (SELECT trace_id, walk, unnest(generate_series(1, length - 1)) AS i FROM usable{n})),
edges{n} AS (SELECT source, target, count(*) AS weight FROM pairs{n} GROUP BY ALL),
variants{n} AS (SELECT path, count(*) AS n_sessions, count(DISTINCT session_id) AS n_users, CAST(sum(epoch_us(ended) - epoch_us(started)) AS BIGINT) AS total_us FROM usable{n} GROUP BY path)"""


EV = """WITH ev AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS session_id, event_type AS screen_id, value, props, day(ts) <= 15 AS early,
  CASE user_id % 3 WHEN 0 THEN 'android' ELSE 'ios' END AS platform FROM events)"""
ONE = f"{EV}, {ctes()}"
TWO = f"{EV}, {ctes('0', 'early')}, {ctes('1', 'NOT early')}"
#: Shares of the variants of both halves side by side.
SHARES = """, d AS (SELECT coalesce(a.path, b.path) AS key, coalesce(a.n_sessions, 0) AS w0, coalesce(b.n_sessions, 0) AS w1 FROM variants0 a FULL JOIN variants1 b ON a.path = b.path),
p AS (SELECT *, w0 / sum(w0) OVER () AS p0, w1 / sum(w1) OVER () AS p1 FROM d)"""
JS = "sum((CASE WHEN p0 > 0 THEN p0 * log2(p0 / ((p0 + p1) / 2)) ELSE 0 END + CASE WHEN p1 > 0 THEN p1 * log2(p1 / ((p0 + p1) / 2)) ELSE 0 END) / 2)"
TAIL = """, b0 AS (SELECT CASE WHEN row_number() OVER (ORDER BY n_sessions DESC, path) <= 10 THEN path ELSE '__other__' END AS key, n_sessions AS w FROM variants0),
b1 AS (SELECT CASE WHEN row_number() OVER (ORDER BY n_sessions DESC, path) <= 10 THEN path ELSE '__other__' END AS key, n_sessions AS w FROM variants1),
sh0 AS (SELECT key, sum(w) / (SELECT sum(w) FROM b0) AS p FROM b0 GROUP BY key), sh1 AS (SELECT key, sum(w) / (SELECT sum(w) FROM b1) AS p FROM b1 GROUP BY key),
q AS (SELECT greatest(coalesce(sh0.p, 0), 1e-10) AS p, greatest(coalesce(sh1.p, 0), 1e-10) AS q FROM sh0 FULL JOIN sh1 ON sh0.key = sh1.key)"""
ENDS = """, t0 AS (SELECT terminal AS key, count(*) AS w FROM usable0 GROUP BY terminal), t1 AS (SELECT terminal AS key, count(*) AS w FROM usable1 GROUP BY terminal),
e AS (SELECT coalesce(t0.w, 0) / (SELECT sum(w) FROM t0) AS p0, coalesce(t1.w, 0) / (SELECT sum(w) FROM t1) AS p1 FROM t0 FULL JOIN t1 ON t0.key = t1.key)"""

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    """Register a function as the query of its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"{ONE} SELECT count(*) AS n_traces, count(*) FILTER (length >= 2) AS n_usable, count(*) FILTER (length < 2) AS n_too_short, count(*) FILTER (segment > 0) AS n_splits, sum(length) / count(*) AS mean_length FROM traces")
def m_sessionize_summary(spark, sf_dir):
    return sessions.summary(traces(spark, sf_dir)).drop("app_id")


@query("SELECT count(*) AS n_events, count(*) FILTER (user_id IS NULL) AS no_session, count(*) FILTER (user_id IS NOT NULL AND event_type IS NULL) AS no_screen FROM events")
def m_exclusions(spark, sf_dir):
    return sessions.exclusions(driver.events(spark, sf_dir)).drop("app_id")


@query(f"{ONE} SELECT trace_id, step_no, screen_id, epoch_us(entered) AS entered_us, epoch_us(exited) AS exited_us, n_events, n_interactions, CAST(order_value AS DOUBLE) AS order_value FROM steps")
def m_trace_steps(spark, sf_dir):
    rows = steps(spark, sf_dir)
    return rows.select("trace_id", "step_no", "screen_id", F.unix_micros("entered").alias("entered_us"), F.unix_micros("exited").alias("exited_us"), "n_events", F.size("interactions").cast("long").alias("n_interactions"), F.col("order_value").cast("double").alias("order_value"))


@query(f"{ONE} SELECT trace_id, path, length, terminal, n_events, n_interactions, epoch_us(started) AS started_us, epoch_us(ended) AS ended_us, session_id AS user_id, CAST(order_value AS DOUBLE) AS order_value FROM traces")
def m_traces(spark, sf_dir):
    rows = traces(spark, sf_dir)
    return rows.select("trace_id", path_text(), "length", "terminal", "n_events", "n_interactions", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "user_id", F.col("order_value").cast("double").alias("order_value"))


#: Sessions with more events than this, here a few, are cut into stretches of a day.
MOST = 20


@query(f"{ONE} SELECT trace_id, step_no, screen_id, epoch_us(entered) AS entered_us, n_events FROM steps")
def m_trace_steps_of_bots(spark, sf_dir):
    """The same steps, where sessions of many events are windows of a day's stretch each."""
    rows = sessions.trace_steps(driver.events(spark, sf_dir), TIMEOUT_S, bucket_s=86_400, most=MOST)
    return rows.select("trace_id", "step_no", "screen_id", F.unix_micros("entered").alias("entered_us"), "n_events")


@query(f"{ONE} SELECT trace_id, path, n_events FROM traces")
def k_bucketed_traces(spark, sf_dir):
    """Traces of a store bucketed by session, which are found without a shuffle."""
    path = new_path(spark, "bucketed")
    store = ingest.save_bucketed(driver.events(spark, sf_dir), f"trailmark_{path.rsplit('-', 1)[-1]}", 8, path)
    return sessions.traces(sessions.trace_steps(store, TIMEOUT_S)).select("trace_id", path_text(), "n_events")


@query(f"{ONE} SELECT trace_id AS case_id, screen_id AS activity, epoch_us(entered) AS at_us FROM steps")
def k_event_log(spark, sf_dir):
    return sessions.event_log(steps(spark, sf_dir)).select("case_id", "activity", F.unix_micros("timestamp").alias("at_us"))


@query(f"{ONE} SELECT source, target, weight, round(weight / sum(weight) OVER (PARTITION BY source), 4) AS probability FROM edges")
def k_graph_export(spark, sf_dir):
    """The exported graph, read back."""
    folder, walked = new_path(spark, "graph"), traces(spark, sf_dir)
    graph.export(graph.edges(walked), graph.nodes(walked), folder)
    return spark.read.json(f"{folder}/edges").select("source", "target", "weight", "probability")


@query(f"{ONE} SELECT source, target, weight FROM edges")
def m_dfg_edges(spark, sf_dir):
    return graph.edges(traces(spark, sf_dir)).drop("app_id")


NODES = f"""{ONE}, v AS (SELECT walk, length, unnest(generate_series(1, length)) AS i FROM usable),
nodes AS (SELECT walk[i] AS screen_id, count(*) AS visits, count(*) FILTER (i = 1) AS starts, count(*) FILTER (i = length) AS ends FROM v GROUP BY ALL)"""


@query(f"{NODES} SELECT *, ends / visits AS exit_rate, starts > 0 AS entry_point FROM nodes")
def m_dfg_nodes(spark, sf_dir):
    return graph.exit_rates(graph.nodes(traces(spark, sf_dir))).drop("app_id")


@query(f"{ONE} SELECT source, target, weight, CAST(sum(weight) OVER (PARTITION BY source) AS BIGINT) AS outgoing, weight / sum(weight) OVER (PARTITION BY source) AS probability FROM edges")
def m_edge_probability(spark, sf_dir):
    return graph.probabilities(graph.edges(traces(spark, sf_dir))).drop("app_id")


@query(f"{ONE} SELECT source, target, weight FROM edges ORDER BY weight DESC, source, target LIMIT 10")
def m_top_edges(spark, sf_dir):
    return graph.top_edges(graph.edges(traces(spark, sf_dir))).drop("app_id")


@query(f"{NODES}, h AS (SELECT * FROM edges WHERE weight * 20 >= (SELECT max(weight) FROM edges)) SELECT screen_id, visits, starts, ends FROM nodes WHERE screen_id IN (SELECT source FROM h UNION SELECT target FROM h)")
def m_dfg_noise_filter(spark, sf_dir):
    rows = traces(spark, sf_dir)
    edge_rows = graph.edges(rows)
    floor = edge_rows.agg(F.ceil(F.max("weight") / 20).cast("int")).first()[0] or 0
    return graph.without_noise(edge_rows, graph.nodes(rows), floor)[1].drop("app_id")


@query(f"{ONE}, top AS (SELECT source, target FROM edges ORDER BY weight DESC, source, target LIMIT 10) SELECT trace_id, count(*) AS n_transitions, count(top.source) AS n_allowed, count(top.source) / count(*) AS conformance FROM pairs LEFT JOIN top USING (source, target) GROUP BY trace_id")
def m_conformance(spark, sf_dir):
    rows = traces(spark, sf_dir)
    return graph.conformance(rows, graph.top_edges(graph.edges(rows))).drop("app_id")


@query(f"{ONE} SELECT path, n_sessions, n_users, total_us, n_sessions / sum(n_sessions) OVER () AS share, total_us / n_sessions / 1e6 AS mean_duration_s FROM variants")
def m_variants(spark, sf_dir):
    return variants.variants(traces(spark, sf_dir)).withColumn("path", F.array_join("path", " > ")).drop("app_id")


@query(f"{ONE} SELECT path, nth, trace_id FROM (SELECT path, trace_id, CAST(row_number() OVER (PARTITION BY path ORDER BY started, trace_id) AS INTEGER) AS nth FROM usable) WHERE nth <= 3")
def m_variant_examples(spark, sf_dir):
    return variants.examples(traces(spark, sf_dir)).select(path_text(), "nth", "trace_id")


@query(f"""{ONE} SELECT path, CASE WHEN length <= 5 THEN path ELSE array_to_string(walk[1:4], ' > ') || ' > … > ' || walk[length] END AS label FROM (SELECT DISTINCT path, walk, length FROM usable)""")
def p_variant_label(spark, sf_dir):
    return variants.variants(traces(spark, sf_dir)).select(path_text(), variants.label(F.col("path")).alias("label"))


@query(f"{ONE} SELECT path, n_sessions, CAST(row_number() OVER w AS INTEGER) AS rank, sum(n_sessions) OVER (w ROWS UNBOUNDED PRECEDING) * 100 / sum(n_sessions) OVER () AS cumulative_pct FROM variants WINDOW w AS (ORDER BY n_sessions DESC, string_split(path, ' > '))")
def m_coverage_curve(spark, sf_dir):
    return variants.coverage_curve(variants.variants(traces(spark, sf_dir))).withColumn("path", F.array_join("path", " > ")).drop("app_id")


@query(f"{ONE}, k AS (SELECT row_number() OVER w AS rank, sum(n_sessions) OVER (w ROWS UNBOUNDED PRECEDING) * 100 / sum(n_sessions) OVER () AS pct FROM variants WINDOW w AS (ORDER BY n_sessions DESC, path)) SELECT CAST(min(rank) AS INTEGER) AS n_needed FROM k WHERE round(pct, 2) >= 95")
def m_needed_for_95(spark, sf_dir):
    return variants.needed_for(variants.coverage_curve(variants.variants(traces(spark, sf_dir)))).drop("app_id")


@query(f"{ONE}, q AS (SELECT n_sessions / sum(n_sessions) OVER () AS p FROM variants) SELECT round(-sum(p * log2(p)), 6) AS entropy_bits, count(*) AS n_variants FROM q")
def m_entropy(spark, sf_dir):
    return variants.entropy(variants.variants(traces(spark, sf_dir))).select(F.round("entropy_bits", 6).alias("entropy_bits"), "n_variants")


@query(f"{ONE} SELECT terminal, count(*) AS n_sessions FROM usable GROUP BY terminal")
def m_dropoff(spark, sf_dir):
    return variants.drop_off(traces(spark, sf_dir)).drop("app_id")


@query(f"{ONE} SELECT path, CAST(sum(order_value) AS DOUBLE) AS monetary FROM usable GROUP BY path")
def m_monetary(spark, sf_dir):
    return variants.monetary(traces(spark, sf_dir)).select(path_text(), F.col("monetary").cast("double").alias("monetary"))


@query("""WITH o AS (SELECT o_custkey, o_orderpriority AS screen_id, o_orderdate, o_orderkey, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
SELECT before AS source, screen_id AS target, count(*) AS weight FROM o WHERE before <> screen_id GROUP BY ALL""")
def m_orders_dfg(spark, sf_dir):
    century = 100 * 366 * 86400
    return graph.edges(sessions.traces(sessions.trace_steps(driver.order_events(spark, sf_dir), century))).drop("app_id")


def halves(spark, sf_dir) -> list[DataFrame]:
    """Variants of both halves of the month as distributions."""
    return [variants.variants(traces(spark, sf_dir, v)).select("app_id", F.array_join("path", " > ").alias("key"), F.col("n_sessions").alias("weight")) for v in ("1.0", "2.0")]


def ends(spark, sf_dir) -> list[DataFrame]:
    return [variants.drop_off(traces(spark, sf_dir, v)).select("app_id", F.col("terminal").alias("key"), F.col("n_sessions").alias("weight")) for v in ("1.0", "2.0")]


def windows(spark, sf_dir) -> list[DataFrame]:
    """Both halves' variants, and where these end, as distributions. Each half is sessionised once and
    its variants are written, as the report's metrics read them several times."""
    found = [cut(variants.variants(traces(spark, sf_dir, v)).select("app_id", "path", F.col("n_sessions").alias("weight")), "variants") for v in ("1.0", "2.0")]
    paths = [x.select("app_id", F.array_join("path", " > ").alias("key"), "weight") for x in found]
    return paths + [x.groupBy("app_id", F.element_at("path", -1).alias("key")).agg(F.sum("weight").alias("weight")) for x in found]


@query(f"{TWO}{SHARES} SELECT round({JS}, 6) AS js_divergence FROM p")
def d_js(spark, sf_dir):
    return drift.js_divergence(*halves(spark, sf_dir)).select(F.round("js_divergence", 6).alias("js_divergence"))


@query(f"{TWO}{TAIL} SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM q")
def d_psi(spark, sf_dir):
    return drift.psi(*halves(spark, sf_dir)).select(F.round("psi", 6).alias("psi"))


@query(f"{TWO}{SHARES} SELECT CAST(row_number() OVER (ORDER BY abs(delta_pp) DESC, key) AS INTEGER) AS rank, * FROM (SELECT key, w0, w1, round((p1 - p0) * 100, 2) AS delta_pp FROM p) QUALIFY rank <= 5")
def d_movers(spark, sf_dir):
    return drift.movers(*halves(spark, sf_dir)).drop("app_id")


@query(f"{TWO} SELECT path AS key, n_sessions AS weight FROM variants1 WHERE path NOT IN (SELECT path FROM variants0)")
def d_novel(spark, sf_dir):
    return drift.novel(*halves(spark, sf_dir)).drop("app_id")


@query(f"{TWO} SELECT path AS key, n_sessions AS weight FROM variants0 WHERE path NOT IN (SELECT path FROM variants1)")
def d_vanished(spark, sf_dir):
    before, after = halves(spark, sf_dir)
    return drift.novel(after, before).drop("app_id")


@query(f"{TWO}{ENDS} SELECT round({JS}, 6) AS js_divergence FROM e")
def d_dropoff_shift(spark, sf_dir):
    return drift.js_divergence(*ends(spark, sf_dir)).select(F.round("js_divergence", 6).alias("js_divergence"))


@query(f"""{TWO}{SHARES}{TAIL}{ENDS}, m(metric, value, warn, alert) AS (SELECT 'js_divergence', (SELECT {JS} FROM p), 0.1, 0.2 UNION ALL SELECT 'psi', (SELECT sum((q - p) * ln(q / p)) FROM q), 0.1, 0.25
UNION ALL SELECT 'novel_rate', (SELECT sum(w1) FILTER (w0 = 0) / sum(w1) FROM p), 0.05, 0.15 UNION ALL SELECT 'drop_off_shift', (SELECT {JS} FROM e), 0.1, 0.2)
SELECT metric, round(value, 6) AS value, CASE WHEN value >= alert THEN 'alert' WHEN value >= warn THEN 'warn' ELSE 'ok' END AS status FROM m""")
def d_report(spark, sf_dir):
    return drift.report(*windows(spark, sf_dir)).select("metric", F.round("value", 6).alias("value"), "status")


@query(f"""{TWO}{SHARES}{TAIL}{ENDS}, m(metric, value, warn, alert) AS (SELECT 'js_divergence', (SELECT {JS} FROM p), 0.001, 0.2 UNION ALL SELECT 'psi', (SELECT sum((q - p) * ln(q / p)) FROM q), 0.0001, 0.0002
UNION ALL SELECT 'novel_rate', (SELECT sum(w1) FILTER (w0 = 0) / sum(w1) FROM p), 2, 3 UNION ALL SELECT 'drop_off_shift', (SELECT {JS} FROM e), 0.1, 0.2)
SELECT metric, round(value, 6) AS value, CASE WHEN value >= alert THEN 'alert' WHEN value >= warn THEN 'warn' ELSE 'ok' END AS status FROM m""")
def d_report_by_app(spark, sf_dir):
    """The report under the app's own thresholds; one of them leaves the alert to the default."""
    apps = driver.events(spark, sf_dir).select("app_id").distinct()
    own = apps.selectExpr("app_id", "stack(3, 'js_divergence', 0.001D, CAST(NULL AS DOUBLE), 'psi', 0.0001D, 0.0002D, 'novel_rate', 2D, 3D) AS (metric, warn, alert)")
    return drift.report(*windows(spark, sf_dir), by_app=own).select("metric", F.round("value", 6).alias("value"), "status")


PLATFORMS = f"{ONE}, pc AS (SELECT platform, path, count(*) AS n_sessions FROM usable GROUP BY ALL)"


@query(f"{PLATFORMS} SELECT path, CAST(coalesce(sum(n_sessions) FILTER (platform = 'android'), 0) AS BIGINT) AS android, CAST(coalesce(sum(n_sessions) FILTER (platform = 'ios'), 0) AS BIGINT) AS ios FROM pc GROUP BY path")
def d_parity_matrix(spark, sf_dir):
    return parity.matrix(parity.counts(traces(spark, sf_dir)), ["android", "ios"]).withColumn("path", F.array_join("path", " > ")).drop("app_id")


@query(f"{PLATFORMS} SELECT path, min(platform) AS platform, max(n_sessions) AS n_sessions FROM pc GROUP BY path HAVING count(*) = 1 AND max(n_sessions) >= 2")
def d_parity_exclusive(spark, sf_dir):
    return parity.exclusive_paths(parity.counts(traces(spark, sf_dir)), 2).withColumn("path", F.array_join("path", " > ")).drop("app_id")


@query(f"""{PLATFORMS}, d AS (SELECT coalesce(a.n_sessions, 0) / (SELECT sum(n_sessions) FROM pc WHERE platform = 'android') AS p0, coalesce(b.n_sessions, 0) / (SELECT sum(n_sessions) FROM pc WHERE platform = 'ios') AS p1
FROM (FROM pc WHERE platform = 'android') a FULL JOIN (FROM pc WHERE platform = 'ios') b ON a.path = b.path) SELECT round({JS}, 6) AS js_divergence, CASE WHEN {JS} >= 0.3 THEN 'alert' WHEN {JS} >= 0.15 THEN 'warn' ELSE 'ok' END AS status FROM d""")
def d_parity_js(spark, sf_dir):
    return parity.divergence(parity.counts(traces(spark, sf_dir))).select(F.round("js_divergence", 6).alias("js_divergence"), "status")


@query(f"""{PLATFORMS}, t AS (SELECT platform, path FROM pc WHERE n_sessions >= 5) SELECT path, count(*) AS n_platforms FROM pc LEFT JOIN t USING (platform, path)
GROUP BY path HAVING count(*) >= 2 AND count(*) <> count(*) FILTER ((platform, path) IN (FROM t)) AND count(*) FILTER ((platform, path) IN (FROM t)) > 0""")
def d_parity_asymmetric(spark, sf_dir):
    rows = parity.counts(traces(spark, sf_dir))
    covered = rows.where("n_sessions >= 5").select("app_id", "platform", "path")
    return parity.asymmetric(rows, covered).select(path_text(), "n_platforms")


def signals(spark, sf_dir) -> DataFrame:
    """The error events as risk signals."""
    rows = driver.events(spark, sf_dir).where("event_name = 'error'")
    return rows.select("app_id", F.col("event_id").alias("signal_id"), "session_id", "timestamp")


def located(spark, sf_dir) -> DataFrame:
    return risk.located(signals(spark, sf_dir), driver.events(spark, sf_dir).where("event_name <> 'error'"))


ASOF = """WITH e AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type <> 'error' GROUP BY ALL),
e2 AS (SELECT e.*, x.event_type AS screen_id, (SELECT count(*) FROM events y WHERE y.event_type <> 'error' AND y.user_id = e.user_id AND y.ts <= e.ts) - 1 AS position FROM e JOIN events x USING (event_id)),
l AS (SELECT s.event_id AS signal_id, e2.screen_id, e2.position AS position_in_session FROM (SELECT * FROM events WHERE event_type = 'error') s ASOF LEFT JOIN e2 ON s.user_id = e2.user_id AND s.ts >= e2.ts)"""


@query(f"{ASOF} SELECT * FROM l")
def j_risk_asof(spark, sf_dir):
    return located(spark, sf_dir).select("signal_id", "screen_id", "position_in_session")


@query(f"{ASOF} SELECT * FROM l")
def j_risk_asof_in_stretches(spark, sf_dir):
    """The same join in windows of a day."""
    rows = risk.located(signals(spark, sf_dir), driver.events(spark, sf_dir).where("event_name <> 'error'"), bucket_s=86_400)
    return rows.select("signal_id", "screen_id", "position_in_session")


@query(f"{ASOF} SELECT screen_id, count(*) AS n_signals FROM l WHERE screen_id IS NOT NULL GROUP BY screen_id")
def q_risk_by_screen(spark, sf_dir):
    return risk.by_screen(located(spark, sf_dir)).drop("app_id")


@query(f"{ASOF} SELECT count(*) AS n_signals, count(screen_id) AS n_located, count(screen_id) * 100 / count(*) AS located_pct FROM l")
def q_localisation_rate(spark, sf_dir):
    return risk.localisation_rate(located(spark, sf_dir)).drop("app_id")


@query("SELECT CAST(sum(c) AS BIGINT) AS n_events, CAST(sum(c - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS c FROM events GROUP BY user_id, event_type, ts)")
def q_duplicates(spark, sf_dir):
    return quality.duplicates(driver.events(spark, sf_dir)).drop("app_id")


@query("""SELECT count(*) AS n_sessions, count(*) FILTER (back) AS n_out_of_order FROM (SELECT user_id, bool_or(coalesce(back, false)) AS back
FROM (SELECT user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) > ts AS back FROM events) GROUP BY user_id)""")
def q_ordering(spark, sf_dir):
    return quality.out_of_order(driver.events(spark, sf_dir)).drop("app_id")


@query("""WITH v AS (SELECT CAST(count(*) AS DOUBLE) AS volume, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 3.6e9 AS fresh, count(*) FILTER (user_id IS NULL) * 100 / count(*) AS nulls,
  count(*) FILTER (event_type IS NULL) * 100 / count(*) AS orphans FROM events),
o AS (SELECT count(*) FILTER (back) * 100 / count(*) AS pct FROM (SELECT user_id, bool_or(coalesce(back, false)) AS back FROM (SELECT user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) > ts AS back FROM events) GROUP BY user_id)),
d AS (SELECT sum(c - 1) * 100 / sum(c) AS pct FROM (SELECT count(*) AS c FROM events GROUP BY user_id, event_type, ts)),
r("check", value, "limit", more, blocking) AS (SELECT 'volume', volume, 1000.0, true, true FROM v UNION ALL SELECT 'freshness_h', fresh, 4.0, false, true FROM v UNION ALL SELECT 'null_session_pct', nulls, 5.0, false, true FROM v
  UNION ALL SELECT 'orphan_pct', orphans, 5.0, false, true FROM v UNION ALL SELECT 'screen_coverage_pct', 100.0, 90.0, true, true UNION ALL SELECT 'out_of_order_pct', pct, 1.0, false, false FROM o UNION ALL SELECT 'duplicate_pct', pct, 0.1, false, false FROM d)
SELECT "check", round(value, 6) AS value, CAST("limit" AS DOUBLE) AS "limit", CASE WHEN more THEN value >= "limit" ELSE value <= "limit" END AS passed, blocking FROM r""")
def q_checks(spark, sf_dir):
    rows = driver.events(spark, sf_dir)
    screens = rows.select("app_id", "screen_id").distinct()
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return quality.checks(rows, screens, now).select("check", F.round("value", 6).alias("value"), "limit", "passed", "blocking")


@query("""SELECT "check", CAST(value AS DOUBLE) AS value, CAST("limit" AS DOUBLE) AS "limit", passed, blocking FROM (VALUES ('volume', 0.0, 1000.0, false, true), ('freshness_h', NULL, 4.0, false, true), ('screen_coverage_pct', 0.0, 90.0, false, true)) AS t("check", value, "limit", passed, blocking) WHERE EXISTS (FROM events)""")
def q_checks_of_silent_app(spark, sf_dir):
    """An app with declared screens and no event yet breaches its checks."""
    rows = driver.events(spark, sf_dir)
    screens = rows.select("app_id", "screen_id").distinct()
    silent = screens.select(F.lit("silent").alias("app_id"), "screen_id")
    found = quality.checks(rows, screens.union(silent), F.lit("2024-02-01 00:00:00").cast("timestamp")).where("app_id = 'silent'")
    return found.select("check", "value", "limit", "passed", "blocking")


@query("SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'android' ELSE 'ios' END AS platform FROM events")
def p_platform(spark, sf_dir):
    return driver.events(spark, sf_dir).select("event_id", parity.platform_of(F.col("platform")).alias("platform"))


@query(f"{ONE} SELECT path, CASE WHEN terminal = 'error' THEN 'failed' ELSE 'exploratory' END AS outcome FROM (SELECT DISTINCT path, terminal FROM usable)")
def p_outcome(spark, sf_dir):
    found = variants.variants(traces(spark, sf_dir)).withColumn("outcome", archetypes.outcome(F.col("path")))
    return found.select(path_text(), "outcome")


def declared(spark, sf_dir) -> DataFrame:
    """Event types and brands as declared screens; brands are never seen."""
    seen = driver.events(spark, sf_dir).select("screen_id").distinct().select("screen_id", F.lit("shop").alias("domain"), (F.col("screen_id") == "purchase").alias("critical"))
    brands = driver.table(spark, sf_dir, "part").select(F.col("p_brand").alias("screen_id")).distinct().select("screen_id", F.lit("brands").alias("domain"), F.col("screen_id").endswith("3").alias("critical"))
    return seen.where("screen_id <> 'error'").union(brands).withColumn("app_id", F.lit("demo"))


@query(f"{NODES}, b AS (SELECT DISTINCT p_brand FROM part) SELECT screen_id, visits, starts, ends, screen_id = 'purchase' AS critical, screen_id <> 'error' AS declared FROM nodes UNION ALL SELECT p_brand, 0, 0, 0, p_brand LIKE '%3', true FROM b")
def j_graph_screens(spark, sf_dir):
    rows = graph.with_screens(graph.nodes(traces(spark, sf_dir)), declared(spark, sf_dir))
    return rows.select("screen_id", "visits", "starts", "ends", "critical", "declared")


@query("SELECT DISTINCT p_brand AS screen_id FROM part WHERE p_brand LIKE '%3'")
def j_unseen_critical(spark, sf_dir):
    return graph.unseen_critical(declared(spark, sf_dir), graph.nodes(traces(spark, sf_dir))).select("screen_id")


@query(f"{TWO}{SHARES}{TAIL}{ENDS} SELECT CASE WHEN greatest((SELECT {JS} FROM p) / 0.2, (SELECT sum((q - p) * ln(q / p)) FROM q) / 0.25, (SELECT sum(w1) FILTER (w0 = 0) / sum(w1) FROM p) / 0.15, (SELECT {JS} FROM e) / 0.2) >= 1 THEN 'alert' ELSE 'other' END AS overall")
def d_overall(spark, sf_dir):
    found = drift.overall(drift.report(*windows(spark, sf_dir)))
    return found.select(F.when(F.col("overall") == "alert", "alert").otherwise("other").alias("overall"))


@query(f"{PLATFORMS}, sx AS (SELECT platform, unnest(string_split(path, ' > ')) AS screen_id FROM pc WHERE n_sessions >= 3) SELECT screen_id, min(platform) AS platform FROM sx GROUP BY screen_id HAVING count(DISTINCT platform) = 1")
def d_parity_screens(spark, sf_dir):
    return parity.exclusive_screens(parity.counts(traces(spark, sf_dir)).where("n_sessions >= 3")).drop("app_id")
