"""Parsing, vendor adapters, store, contract, privacy, readiness, streams."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trailmark.functions import parsing
from trailmark.operators import contract, ingest, privacy, readiness, risk, screens
from trailmark.plans import intake
from trailmark.sources import vendors
from trailmark.streaming import streams


def records(spark, *payloads):
    return spark.createDataFrame([(json.dumps(p),) for p in payloads], "json string").select(F.parse_json("json").alias("record"))


def test_timestamps(spark):
    forms = ["20260804153045", "1785000000", "1785000000000", "1785000000000000", "2026-08-04T15:30:45Z", "2026-08-04T17:30:45+02:00", "2026-08-04 15:30:45", "2026", "nonsense", None, ""]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, t string")
    got = [r.s for r in df.select("i", F.unix_seconds(parsing.ingest_time(F.col("t"))).alias("s")).orderBy("i").collect()]
    packed = int(datetime.fromisoformat("2026-08-04T15:30:45+00:00").timestamp())
    assert got[:7] == [packed, 1785000000, 1785000000, 1785000000, packed, packed, packed]
    assert got[7] == 2026 and got[8:] == [None, None, None]  # a bare number is seconds
    audit = [r.s for r in df.select("i", F.unix_seconds(parsing.readiness_time(F.col("t"))).alias("s")).orderBy("i").collect()]
    assert audit[1] == audit[2] == 1785000000


def test_ids_and_names(spark):
    df = records(spark, {"a": 12345, "b": 9.0, "c": True, "d": "x", "e": ""})
    assert df.select(*[parsing.id_text(F.col("record"), f"$.{k}") for k in "abcde"]).first()[:] == ("12345", "9", "True", "x", None)
    names = spark.createDataFrame([("PaymentMethod",), ("OTPVerify",), ("OrderHistory",), ("Zorblatt",)], "n string")
    rows = names.select(parsing.snake_case(F.col("n")).alias("s"), parsing.sensitivity(F.col("n"))["level"].alias("l"), parsing.title_case(F.col("n")).alias("t")).collect()
    assert [tuple(r) for r in rows] == [("payment_method", "critical", "Payment Method"), ("otp_verify", "critical", "Otp Verify"), ("order_history", "high", "Order History"), ("zorblatt", "low", "Zorblatt")]
    props = spark.createDataFrame([('{"v": 2.5}',), ('{"v": true}',), ('{"v": "2"}',), ("{}",), (None,)], "p string")
    assert [r[0] for r in props.select(parsing.number_of(F.col("p"), "v")).collect()] == [2.5, None, None, None, None]


def flat(df):
    return [r.asDict() for r in df.select(*vendors.FLAT).collect()]


def test_adapters(spark):
    screen = flat(vendors.rudderstack(records(spark, {"type": "screen", "event": "Home", "userId": 678, "anonymousId": 9.0, "originalTimestamp": "2026-08-04T15:30:45Z", "context": {"sessionId": 12345, "app": {"version": "8"}, "os": {"name": "iOS"}}, "properties": {"b": 1, "a": "x"}})))[0]
    assert (screen["event_name"], screen["screen_tag"], screen["session_id"], screen["user_id"], screen["anonymous_id"], screen["properties"]) == ("screen_view", "Home", "12345", "678", "9", '{"a":"x","b":1}')
    fire = flat(vendors.firebase(records(spark, {"event_name": "tap", "event_timestamp": 1785000000000000, "event_params": [{"key": "firebase_screen", "value": {"string_value": "Cart"}}, {"key": "ga_session_id", "value": {"int_value": 77}}, {"key": "v", "value": {"double_value": 2.5}}]})))[0]
    assert (fire["screen_tag"], fire["session_id"], json.loads(fire["properties"])["v"]) == ("Cart", "77", "2.5")
    mix = flat(vendors.mixpanel(records(spark, {"event": "tap", "properties": {"$screen_name": "Cart", "$session_id": "s", "distinct_id": "d", "time": 1785000000, "kept": 1, "token": "t"}})))[0]
    assert (mix["screen_tag"], mix["user_id"], mix["properties"]) == ("Cart", "d", '{"kept":1}')
    raw = flat(vendors.raw(records(spark, {"event": "tap", "screen": "Cart", "session_id": "s", "ts": 1785000000, "extra": 1, "properties": {"extra": 2, "p": None}})))[0]
    assert json.loads(raw["properties"]) == {"extra": 2, "p": None}
    cam = vendors.unwrap(records(spark, {"success": True, "data": [{"eventName": "tap", "eventScreen": "Cart", "url": "u", "eventProperty": {"q": 1}}]}))
    assert json.loads(flat(vendors.uxcam(cam))[0]["properties"]) == {"q": 1, "replay_url": "u"}
    with pytest.raises(Exception, match="success=false"):
        vendors.unwrap(records(spark, {"success": False})).collect()


def test_signals_and_registry(spark):
    rows = vendors.risk_signals(records(spark, {"timestamp": "2026-08-04T15:30:45Z", "level": "fatal", "title": "t", "tags": [{"key": "session_id", "value": "s1"}]}, {"timestamp": "2026-08-04T15:30:45Z", "tags": {"session_id": "s2"}, "message": "m"}, {"title": "no time"}), "sentry").collect()
    assert sorted((r.session_id, r.fatal, r.title) for r in rows) == [("s1", True, "t"), ("s2", False, "m")]
    with pytest.raises(ValueError, match="known are"):
        vendors.CONNECTORS.get("segment")
    with pytest.raises(ValueError, match="replace"):
        vendors.CONNECTORS.add("raw", vendors.Connector(vendors.raw))


def raw_event(i, **more):
    return {"event": "tap", "screen": "Home", "session_id": "s", "ts": 1785000000 + i, **more}


def test_normalise_and_store(spark, tmp_path):
    tags = spark.createDataFrame([(1, "home", "Home"), (2, "home_2", "Home")], "ord int, screen_id string, screen_tag string")
    rows = ingest.normalise(records(spark, raw_event(0), raw_event(1, screen="Legacy"), {"event": "tap"}, {"ts": 1}), "raw", tags)
    found = ingest.summary(rows).first()
    assert (found.ingested, found.rejected, found.acceptance_pct, found.orphans) == (2, 2, 50.0, 1)
    assert {r.reject_reason for r in rows.collect()} == {None, "no timestamp", "no event name"}
    assert [tuple(r) for r in ingest.orphan_tags(rows).collect()] == [("Legacy", 1)]
    assert rows.where("screen_tag = 'Home'").first().screen_id == "home"
    store = str(tmp_path / "store")
    good = ingest.accepted(rows)
    assert ingest.insert(good, store) == 2 and ingest.insert(good, store) == 0
    more = ingest.accepted(ingest.normalise(records(spark, raw_event(0), raw_event(5)), "raw", tags))
    assert ingest.insert(more, store) == 1
    assert ingest.counters(spark.read.parquet(store)).first().n_events == 3


def test_read_events(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.jsonl").write_text('{"event": 1}\n\n{"event": 2}\n')
    (tmp_path / "arrays").mkdir()
    (tmp_path / "arrays" / "a.json").write_text('[{"event": 1},\n {"event": 2}]')
    for folder, array in (("lines", False), ("arrays", True)):
        rows = vendors.read_events(spark, str(tmp_path / folder), array).orderBy("read_order")
        assert [r[0] for r in rows.select(F.variant_get("record", "$.event", "int")).collect()] == [1, 2]


def test_contract(spark):
    plan_events = spark.createDataFrame([("a", "buy", ["review"]), ("a", "view", ["*"])], "app_id string, name string, screens array<string>")
    plan_props = spark.createDataFrame([("a", "buy", "q", "integer", True), ("a", None, "build", "string", False)], "app_id string, event string, name string, type string, required boolean")
    rows = spark.createDataFrame(
        [("a", 1, "mystery", None, "{}"), ("a", 2, "buy", "review", '{"q": "2"}'), ("a", 3, "buy", "home", '{"q": 2}'), ("a", 4, "buy", None, '{"x": 1}'), ("a", 5, "view", "any", '{"build": "b"}'), ("a", 6, "view", "any", None)],
        "app_id string, event_id long, event_name string, screen_id string, properties string",
    )
    found = contract.violations(rows, plan_events, plan_props)
    assert sorted((r.event_id, r.violation) for r in found.collect()) == [(1, "unknown_event"), (2, "type_mismatch"), (3, "wrong_screen"), (4, "missing_property")]
    assert contract.conformance(rows, found).first().conformance_pct == pytest.approx(100 * 2 / 6)
    strict = contract.violations(rows, plan_events, plan_props, strict=True).where("violation = 'undeclared_property'").collect()
    assert [(r.event_id, r.detail) for r in strict] == [(4, "x")]


@pytest.mark.parametrize(
    ("text", "kinds"),
    [("mail user@example.com", {"email"}), ("call +44 7700 900123", {"phone"}), ("at 192.168.1.44", {"ip_address"}), ("Bearer abcdefghijklmnopqrstuvwxyz", {"credential"}), ("id 123-45-6789", {"national_id"}), ("4111111111111111", {"card"}), ("nothing here", set())],
)
def test_detectors(spark, text, kinds):
    rows = spark.createDataFrame([(text,)], "t string").select(F.explode(privacy.findings(F.col("t"))).alias("f")).select("f.*").collect()
    assert kinds <= {r.kind for r in rows} and (rows == [] or kinds)
    assert all(text not in r.sample and r.sample.startswith("<redacted len=") for r in rows)


def test_flatten_and_report(spark):
    bag = json.dumps({"a": {"b": [{"c": "user@example.com"}, 2]}, "Email": None, "n": 5})
    rows = spark.createDataFrame([("x", 1, "tap", bag), ("x", 2, "tap", bag)], "app_id string, event_id long, event_name string, properties string")
    leaves = {r.path: r.value for r in privacy.flattened(rows.where("event_id = 1")).collect()}
    assert {"a.b[0].c", "a.b[1]", "Email", "n"} <= set(leaves) and leaves["a.b[1]"] == "2"
    found = {(r.kind, r.path): r.n for r in privacy.report(privacy.scan_properties(rows)).collect()}
    assert found == {("email", "a.b[0].c"): 2, ("suspicious_key", "Email"): 2}
    assert privacy.scan_properties(rows, allowed=("Email",)).where("kind = 'suspicious_key'").count() == 0


def test_drafts(spark):
    values = [{"b": True, "i": 1, "n": 1 if i else 1.5, "s": "x", "z": None, **({"o": 1} if i else {})} for i in range(10)]
    rows = spark.createDataFrame([("x", i, "tap", json.dumps(v), "PaymentMethod") for i, v in enumerate(values)], "app_id string, event_id long, event_name string, properties string, screen_tag string")
    got = {r.key: (r.type, r.required) for r in readiness.draft_properties(rows).collect()}
    assert got == {"b": ("boolean", True), "i": ("integer", True), "n": ("number", True), "s": ("string", True), "o": ("integer", False)}
    screen = readiness.draft_screens(rows).first()
    assert (screen.screen_id, screen.sensitivity, screen.critical) == ("payment_method", "critical", True)


def test_streams_agree_with_tables(spark, tmp_path):
    rows = spark.range(500).select(F.lit("a").alias("app_id"), F.col("id").alias("event_id"), F.lit("tap").alias("event_name"), F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("screen_id"), (F.col("id") % 11).cast("string").alias("session_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 400 + F.when(F.col("id") > 250, 9000).otherwise(0)).alias("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    streams.run_to_table(streams.sessions(source, "2 hours"), str(tmp_path / "out"), str(tmp_path / "state"))
    key = lambda r: (r.session_id, r.started, r.ended, r.n_events, tuple(r.path))
    batch = {key(r) for r in streams.sessions(rows, "2 hours").collect()}
    got = {key(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got < batch and len(batch) - len(got) <= 11
    streams.ingest(source.union(source), str(tmp_path / "store"), str(tmp_path / "state2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store")).count() == 500


def test_sensitivity_finds_the_name_once(spark):
    """The first marker in list order, and one snake-case name however many markers there are."""
    names = ["UserProfileScreen", "Sign In", "Help", "OrderPin", "plain", "", None]
    wanted = []
    for name in names:
        low = (name or "").lower().replace(" ", "_").replace("userprofile", "user_profile").replace("orderpin", "order_pin")
        hits = [(level, m) for level, ms in parsing.SENSITIVITY.items() for m in ms if m in low]
        wanted.append(hits[0] if hits else ("low", "no marker"))
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    found = rows.select("i", parsing.sensitivity(F.col("name")).alias("s"))
    assert [tuple(r.s) for r in found.orderBy("i").collect()] == wanted
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 3


def test_stream_reads_a_plan_written_once(spark, capsys):
    """No batch of a stream finds the plan again, which was a product of all its partitions."""
    from trailmark.plans import contracts, delivery

    sf_dir = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        streams.conformance(delivery.stream(spark, sf_dir), *contracts.plan(spark, sf_dir)).explain(True)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = capsys.readouterr().out
    assert "plan-events" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_names_of_screens(spark):
    """Snake case, title and sensitivity of names with capitals, blanks and signs."""
    want = {"userID": "userid", "Sign In": "sign_in", "Sign-In": "sign_in", "UserProfileScreen": "user_profile_screen", "": "unknown", "--": "unknown", "HTMLPage": "html_page", "A": "a", "__x__y": "x_y"}
    names = spark.createDataFrame([(n,) for n in want], "n string")
    rows = names.select("n", parsing.snake_case(F.col("n")).alias("s"), parsing.sensitivity(F.col("n")).alias("l"), parsing.critical_screen(F.col("n")).alias("c")).collect()
    assert {r.n: r.s for r in rows} == want
    assert {r.n for r in rows if r.l["level"] == "critical"} == {"Sign In", "Sign-In"} == {r.n for r in rows if r.c}
    assert {r.n for r in rows if r.l["level"] == "high"} == {"UserProfileScreen"}


def test_nested_properties_are_never_cut(spark):
    deep = '{"a":' * 20 + '"x@y.zz"' + "}" * 20
    rows = spark.createDataFrame([("app", "1", "e", '{"a": [{"b": "x@y.zz"}]}'), ("app", "2", "e", deep), ("app", "3", "e", "not json"), ("app", "4", "e", None)], "app_id string, event_id string, event_name string, properties string")
    found = {r.event_id: r.path for r in privacy.scan_properties(rows).where("kind = 'email'").collect()}
    assert found == {"1": "a[0].b", "2": ".".join("a" * 20)}
    assert privacy.scan_properties(rows.where("event_id = '3'")).collect() == []


def test_screens_without_ids_are_matched_by_type_and_text(spark):
    """Two id-less screens with like types are the same screen under another name."""
    columns = "app_id string, app_version string, screen_id string, accessibility_id string, text string, element_type string"
    rows = [("a", v, s, None, t, "x.Button") for v, s in (("1", "old"), ("2", "new")) for t in (f"hello {s}", None)]
    rows += [("a", v, "named", f"id {i}", None, "x.Text") for v in "12" for i in range(3)]
    got = screens.matched_screens(screens.fingerprints(spark.createDataFrame(rows, columns)), "1", "2").collect()
    assert {(r.screen_a, r.screen_b, r.status) for r in got} == {("old", "new", "renamed"), ("named", "named", "matched")}


def test_signals_without_a_session_stay_unlocated(spark):
    events = spark.createDataFrame([("a", "s", 1, "e1", "home"), ("a", None, 1, "e2", "lost")], "app_id string, session_id string, t int, event_id string, screen_id string").withColumn("timestamp", F.timestamp_seconds("t")).drop("t")
    signals = spark.createDataFrame([("a", "x1", "s", 2), ("a", "x2", None, 2), ("a", "x3", "s", 0)], "app_id string, signal_id string, session_id string, t int").withColumn("timestamp", F.timestamp_seconds("t")).drop("t")
    got = {r.signal_id: (r.screen_id, r.position_in_session) for r in risk.located(signals, events).collect()}
    assert got == {"x1": ("home", 0), "x2": (None, None), "x3": (None, None)}


def test_defect_exports(spark, tmp_path):
    from trailmark.sources import defects

    (tmp_path / "a.json").write_text('{"defects": [{"defect_id": "D1", "detected_at": "2024-05-01T10:00:00Z", "screens": ["cart", "pay"], "journey_id": "j1"}],\n "gaps_reported": [{"journey_id": "j2", "reported_at": "2024-04-01T00:00:00Z", "caused_defect": "D1"}, {"journey_id": "j3", "reported_at": null, "closed_by_test": "t"}]}')
    (tmp_path / "b.json").write_text('[{"defect_id": "D2", "severity": "high"}]')
    (tmp_path / "c.json").write_text(" ")
    exports = defects.read_exports(spark, str(tmp_path))
    rows = {r.defect_id: r for r in defects.defects(exports, "app", F.timestamp_micros(F.lit(0))).collect()}
    assert set(rows) == {"D1", "D2"}
    assert rows["D1"].screens == ["cart", "pay"] and rows["D1"].severity == "medium" and rows["D1"].journey_id == "j1"
    assert rows["D2"].severity == "high" and rows["D2"].covering_tests == [] and rows["D2"].journey_id is None
    gaps = {r.journey_id: (r.caused_defect, r.closed_by_test, r.reported_at is None) for r in defects.reported_gaps(exports, "app").collect()}
    assert gaps == {"j2": (True, None, False), "j3": (False, "t", True)}
    (tmp_path / "d.json").write_text('[{"title": "no id"}]')
    with pytest.raises(Exception, match="without defect_id"):
        defects.defects(defects.read_exports(spark, str(tmp_path)), "app").collect()


def test_registry_entries_past_their_review_are_stale(spark):
    from trailmark.operators import gaps

    rows = spark.sql("SELECT 'app' AS app_id, * FROM VALUES ('a*', 'security', DATE '2024-01-01'), ('b*', 'security', DATE '2024-06-01'), ('c*', 'safety', NULL) AS t(pattern, category, review_by)")
    today = F.to_date(F.lit("2024-06-01"))
    assert {r.pattern for r in gaps.stale_entries(rows, today).collect()} == {"a*", "c*"}
    assert {(r.category, r.n_entries, r.n_stale) for r in gaps.entries_by_category(rows, today).collect()} == {("security", 2, 1), ("safety", 1, 1)}
    assert gaps.entries_by_category(rows.where("false"), today).count() == 0


def test_gates_fail_without_what_they_need(spark):
    from trailmark.operators import gates

    one = lambda sql: spark.sql(sql)
    apps = one("SELECT 'app' AS app_id")
    issues = one("SELECT 'app' AS app_id, 'warning' AS severity")
    ready = one("SELECT 'app' AS app_id, 91.5 AS score, true AS passed")
    registry = one("SELECT 'app' AS app_id, 'security' AS category, 2L AS n_entries, 1L AS n_stale")
    rows = {r.check: r.passed for r in gates.foundation_gate(issues, ready, apps, registry, apps.where("false")).collect()}
    assert rows == {"taxonomy": True, "readiness": True, "registry": False, "baseline": False}
    steps = one("SELECT 'app' AS app_id, 'j' AS journey_id, 10L AS n_steps, 9L AS n_resolved, false AS executable")
    best = one("SELECT 'app' AS app_id, 'positional_xpath' AS strategy UNION ALL SELECT 'app', NULL")
    resolution = one("SELECT 'app' AS app_id, 's' AS screen_id, 0L AS n_resolved, 2L AS n_ambiguous, 0L AS n_fragile")
    claims = one("SELECT 'app' AS app_id, 'fine' AS status").where("false")
    rows = {r.check: (r.passed, r.detail) for r in gates.locator_gate(steps, best, resolution, one("SELECT 'app' AS app_id, 80.0D AS stability_pct"), claims).collect()}
    assert rows == {"resolved": (True, "0.9"), "executable": (False, "0 of 1"), "diagnosed": (True, "1"), "identity": (True, "80.0"), "none_fragile": (False, "1"), "claims_hold": (True, "unverified")}


def test_both_inserts_read_one_table_of_normalised_events(spark, monkeypatch, tmp_path):
    at = "TIMESTAMP_NTZ '2024-01-01 00:00:01'"
    rows = spark.sql(f"SELECT id AS event_id, {at} AS ts, id % 3 AS user_id, IF(id % 2 = 0, 'view', 'error') AS event_type, 1.5D AS value, '{{\"k\": 1}}' AS props FROM range(12)")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    read, plain = [], ingest.insert
    monkeypatch.setattr(ingest, "insert", lambda batch, path: read.append(batch.inputFiles()) or plain(batch, path))
    assert {tuple(r) for r in intake.k_insert(spark, str(tmp_path)).collect()} == {("view", 3), ("error", 3)}
    assert len(read) == 2 and read[0] and set(read[0]) == set(read[1]) and not any("events.parquet" in f for f in read[0])
