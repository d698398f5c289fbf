"""Queries over vendor payloads that Spark derives from the driver's events, and over the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions import parsing
from trailmark.functions.cutting import cut, new_path
from trailmark.operators import ingest
from trailmark.sources import driver, vendors

QUERIES = {}
ORACLE_SQL = {}
CANONICAL = ("event_name", "screen_tag", "session_id", "user_id", "app_version", "platform")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Each vendor's payload as a SQL expression over the raw events.
PAYLOADS = {
    "raw": "named_struct('event_name', event_type, 'screen', event_type, 'session_id', user_id, 'user_id', user_id, 'ts', unix_micros(CAST(ts AS TIMESTAMP)), 'app_version', '1.0', 'platform', 'ios', 'value', value, 'properties', named_struct('p', props))",
    "rudderstack": "named_struct('type', 'track', 'event', event_type, 'userId', user_id, 'originalTimestamp', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\"), 'context', named_struct('sessionId', user_id, 'app', named_struct('version', '1.0'), 'os', named_struct('name', 'ios')), 'properties', named_struct('screen_name', event_type, 'value', value))",
    "firebase": "named_struct('event_name', event_type, 'event_timestamp', unix_micros(CAST(ts AS TIMESTAMP)), 'user_id', user_id, 'platform', 'ios', 'app_info', named_struct('version', '1.0'), 'event_params', array(named_struct('key', 'firebase_screen', 'value', named_struct('string_value', event_type, 'int_value', NULL)), named_struct('key', 'ga_session_id', 'value', named_struct('string_value', NULL, 'int_value', user_id))))",
    "mixpanel": "named_struct('event', event_type, 'properties', map_from_arrays(array('$screen_name', '$session_id', '$user_id', 'time', '$app_version_string', '$os', 'value'), array(event_type, CAST(user_id AS STRING), CAST(user_id AS STRING), CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS STRING), '1.0', 'ios', CAST(value AS STRING))))",
    "uxcam": "named_struct('eventName', event_type, 'eventScreen', event_type, 'eventDate', CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS STRING), 'url', 'replay', 'sessionProperty', named_struct('sessionId', user_id), 'userProperty', named_struct('kUXCam_UserIdentity', user_id), 'eventProperty', named_struct('value', value), 'device', named_struct('appVersion', '1.0', 'platform', 'ios'))",
}


def payloads(spark, sf_dir, vendor: str):
    rows = driver.table(spark, sf_dir, "events")
    return rows.select("event_id", F.to_json(F.expr(PAYLOADS[vendor])).alias("json")).select(F.col("event_id").alias("source_id"), F.parse_json("json").alias("record"))


def _vendor(vendor: str):
    def run(spark, sf_dir):
        rows = ingest.normalise(payloads(spark, sf_dir, vendor), vendor)
        return rows.select("source_id", *CANONICAL, F.unix_micros("timestamp").alias("at_us"), "event_type", "reject_reason")

    run.__name__ = f"s_{vendor}"
    return run


for _vendor_name in PAYLOADS:
    query("SELECT event_id AS source_id, event_type AS event_name, event_type AS screen_tag, CAST(user_id AS VARCHAR) AS session_id, CAST(user_id AS VARCHAR) AS user_id, '1.0' AS app_version, 'ios' AS platform, epoch_us(ts) AS at_us, 'interaction' AS event_type, CAST(NULL AS VARCHAR) AS reject_reason FROM events")(_vendor(_vendor_name))


@query("SELECT event_id AS source_id, 'crash' AS kind, CAST(user_id AS VARCHAR) AS session_id, epoch_us(ts) AS at_us, value > 50 AS fatal, event_type AS title FROM events WHERE event_type = 'error'")
def s_crashlytics(spark, sf_dir):
    rows = driver.table(spark, sf_dir, "events").where("event_type = 'error'")
    payload = F.expr("named_struct('event_timestamp', unix_micros(CAST(ts AS TIMESTAMP)), 'issue_title', event_type, 'error_type', 'FATAL', 'is_fatal', value > 50, 'application', named_struct('session_id', user_id), 'user_id', event_id)")
    signals = vendors.risk_signals(rows.select(F.parse_json(F.to_json(payload)).alias("record")), "crashlytics")
    return signals.select(F.col("user_id").cast("long").alias("source_id"), "kind", "session_id", F.unix_micros("timestamp").alias("at_us"), "fatal", "title")


@query("SELECT event_id AS source_id, 'error' AS kind, CAST(user_id AS VARCHAR) AS session_id, epoch_us(ts) AS at_us, value > 50 AS fatal, props AS title FROM events WHERE event_type = 'error'")
def s_sentry(spark, sf_dir):
    rows = driver.table(spark, sf_dir, "events").where("event_type = 'error'")
    tags = "CASE WHEN event_id % 2 = 0 THEN parse_json(to_json(named_struct('session_id', user_id))) ELSE parse_json(to_json(array(named_struct('key', 'session_id', 'value', CAST(user_id AS STRING))))) END"
    payload = F.expr(f"named_struct('timestamp', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), 'level', CASE WHEN value > 50 THEN 'fatal' ELSE 'error' END, 'title', props, 'tags', {tags}, 'user', named_struct('id', event_id))")
    signals = vendors.risk_signals(rows.select(F.parse_json(F.to_json(payload)).alias("record")), "sentry")
    return signals.select(F.col("user_id").cast("long").alias("source_id"), "kind", "session_id", F.unix_micros("timestamp").alias("at_us"), "fatal", "title")


@query("SELECT event_id AS source_id, CASE event_type WHEN 'error' THEN 'anr' ELSE 'rage_tap' END AS kind, CAST(user_id AS VARCHAR) AS session_id FROM events WHERE event_type IN ('error', 'click')")
def s_uxcam_failures(spark, sf_dir):
    rows = driver.table(spark, sf_dir, "events")
    payload = F.expr("named_struct('eventName', CASE event_type WHEN 'error' THEN 'ANR' WHEN 'click' THEN 'Rage Tap' ELSE event_type END, 'eventDate', CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS STRING), 'sessionProperty', named_struct('sessionId', user_id), 'userProperty', named_struct('kUXCam_UserIdentity', event_id))")
    signals = vendors.risk_signals(rows.select(F.parse_json(F.to_json(payload)).alias("record")), "uxcam_failures")
    return signals.select(F.col("user_id").cast("long").alias("source_id"), "kind", "session_id")


@query("SELECT event_id, epoch_us(ts) AS packed_us, epoch_us(ts) AS seconds_us, epoch_us(ts) AS millis_us, epoch_us(ts) AS iso_us FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def p_timestamps(spark, sf_dir):
    rows = driver.table(spark, sf_dir, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    forms = {"packed_us": F.date_format("ts", "yyyyMMddHHmmss"), "seconds_us": F.unix_seconds("ts").cast("string"), "millis_us": F.unix_millis("ts").cast("string"), "iso_us": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")}
    return rows.select("event_id", *[F.unix_micros(parsing.ingest_time(form)).alias(name) for name, form in forms.items()])


NAMES = """n AS (SELECT p_partkey, CASE p_partkey % 16 WHEN 0 THEN 'Sign In' WHEN 1 THEN 'Sign-In' WHEN 2 THEN 'userID' WHEN 3 THEN 'UserProfileScreen' WHEN 4 THEN '' WHEN 5 THEN '--' WHEN 6 THEN 'OrderHistory' WHEN 7 THEN 'HTMLPage' WHEN 8 THEN 'FAQ page' WHEN 9 THEN 'Payment' ELSE p_name || ' ' || p_type END AS name FROM part)"""


@query(f"""WITH {NAMES}, s AS (SELECT p_partkey, coalesce(nullif(lower(trim(regexp_replace(regexp_replace(name, '(.)([A-Z][a-z])', '\\1_\\2', 'g'), '[^a-zA-Z0-9]+', '_', 'g'), '_')), ''), 'unknown') AS snake FROM n)
SELECT p_partkey, snake, CASE WHEN regexp_matches(snake, '{"|".join(parsing.SENSITIVITY["critical"])}') THEN 'critical' WHEN regexp_matches(snake, '{"|".join(parsing.SENSITIVITY["high"])}') THEN 'high' ELSE 'low' END AS level FROM s""")
def p_names(spark, sf_dir):
    """Names with capitals, blanks and signs in snake case, and their sensitivity."""
    name = spark.sql(f"WITH part AS (SELECT * FROM {{part}}), {NAMES} SELECT * FROM n", part=driver.table(spark, sf_dir, "part"))
    return name.select("p_partkey", parsing.snake_case(F.col("name")).alias("snake"), parsing.sensitivity(F.col("name"))["level"].alias("level"))



TAGS = "(SELECT DISTINCT event_type AS tag FROM events WHERE event_type <> 'error')"


def tags(spark, sf_dir):
    rows = driver.table(spark, sf_dir, "events").where("event_type <> 'error'").select("event_type").distinct()
    return rows.select(F.lit(1).alias("ord"), F.concat(F.lit("screen_"), "event_type").alias("screen_id"), F.col("event_type").alias("screen_tag"))


@query(f"SELECT count(*) AS ingested, 0 AS rejected, 100.0 AS acceptance_pct, count(*) FILTER (tag IS NULL) AS orphans FROM events LEFT JOIN {TAGS} ON event_type = tag")
def p_ingest_summary(spark, sf_dir):
    return ingest.summary(ingest.normalise(payloads(spark, sf_dir, "raw"), "raw", tags(spark, sf_dir))).drop("app_id", "source")


@query("SELECT event_type AS screen_tag, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY event_type")
def p_orphan_tags(spark, sf_dir):
    return ingest.orphan_tags(ingest.normalise(payloads(spark, sf_dir, "raw"), "raw", tags(spark, sf_dir)))


@query("SELECT count(*) AS n_events, count(DISTINCT user_id) AS n_sessions, 0 AS n_orphans, 0 AS n_no_session, epoch_us(max(ts)) AS last_us FROM events")
def k_counters(spark, sf_dir):
    return ingest.counters(driver.events(spark, sf_dir)).select("n_events", "n_sessions", "n_orphans", "n_no_session", F.unix_micros("last_at").alias("last_us"))


@query("SELECT event_type AS screen_id, count(*) AS n_events FROM events GROUP BY event_type")
def k_screen_counts(spark, sf_dir):
    return ingest.screen_counts(driver.events(spark, sf_dir)).drop("app_id")


@query("SELECT event_type AS event_name, count(*) AS n FROM (SELECT DISTINCT event_type, user_id, ts, value, props FROM events) GROUP BY event_type")
def k_insert(spark, sf_dir):
    """The store after the same events were inserted twice, the second time among more.

    The canonical events are a table, so payloads are normalised once for both inserts."""
    path = new_path(spark, "store")
    rows = cut(ingest.accepted(ingest.normalise(payloads(spark, sf_dir, "raw"), "raw")).drop("source_id", "screen_id"), "batch")
    ingest.insert(rows.where("event_name <> 'error'"), path)
    ingest.insert(rows, path)
    return spark.read.parquet(path).groupBy("event_name").agg(F.count("*").alias("n"))


@query("SELECT CAST(l_partkey AS VARCHAR) AS subject, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey, year(l_shipdate) FROM lineitem) GROUP BY 1")
def k_insert_signals(spark, sf_dir):
    """The store of signals after inserts that overlap, by their content-addressed ids."""
    rows = driver.table(spark, sf_dir, "lineitem")
    at = F.date_trunc("year", F.col("l_shipdate").cast("timestamp"))
    subject, session = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    signals = rows.select(parsing.signal_id(session, F.lit("crash"), subject, at).alias("signal_id"), session.alias("session_id"), subject.alias("subject"), at.alias("timestamp"), "l_linenumber")
    path = new_path(spark, "signals")
    ingest.insert(signals.where("l_linenumber <= 2").drop("l_linenumber"), path, key="signal_id", date="signal_date")
    ingest.insert(signals.drop("l_linenumber"), path, key="signal_id", date="signal_date")
    return spark.read.parquet(path).groupBy("subject").agg(F.count("*").alias("n"))


@query("SELECT event_id AS source_id, substr(sha256(concat_ws('|', CAST(user_id AS VARCHAR), event_type, event_type, strftime(ts::TIMESTAMP, '%Y-%m-%dT%H:%M:%S.%fZ'), 'p')), 1, 32) AS event_id FROM events")
def p_event_ids(spark, sf_dir):
    """Content-addressed ids of events."""
    rows = driver.events(spark, sf_dir)
    return rows.select(F.col("event_id").alias("source_id"), parsing.event_id(F.col("session_id"), F.col("event_name"), F.col("screen_tag"), F.col("timestamp"), F.lit("p")).alias("event_id"))


@query("SELECT e.event_id, 'part_' || min(p_partkey) AS screen_id FROM events e JOIN part ON p_size = event_id % 60 GROUP BY e.event_id UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 60 NOT IN (SELECT p_size FROM part)")
def j_page_objects(spark, sf_dir):
    """Events whose page object several screens declare: the first one wins, unknown ones stay without."""
    rows = driver.events(spark, sf_dir).select("event_id", (F.col("event_id") % 60).alias("page_object"))
    declared = driver.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("part_"), "p_partkey").alias("screen_id"), F.col("p_size").alias("page_object"))
    return ingest.resolved(rows, declared, "page_object").select("event_id", "screen_id")
