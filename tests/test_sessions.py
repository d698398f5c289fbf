"""Sessions, graph, variants: golden cases on inline events."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trailmark.operators import drift, graph, parity, quality, risk, sessions, variants

T0 = datetime(2026, 8, 3, 10)
EVENTS = "app_id string, event_id long, event_name string, event_type string, screen_tag string, screen_id string, session_id string, user_id string, timestamp timestamp, app_version string, platform string, order_value double, read_order long"


def events(spark, *rows, session="s1"):
    """Rows (screen, offset[, name[, user]])."""
    out = []
    for i, row in enumerate(rows):
        screen, at, name, user = (*row, *("screen_view", "u1")[len(row) - 2 :])
        out.append(("a", i, name, "screen_view" if name == "screen_view" else "interaction", screen, screen, session, user, T0 + timedelta(seconds=at), "1", "ios", 1.5, i))
    return spark.createDataFrame(out, EVENTS)


def paths(df, **kw):
    rows = sessions.traces(sessions.trace_steps(df, **kw)).orderBy("segment").collect()
    return [(r.trace_id, r.path) for r in rows]


def test_steps_collapse(spark):
    df = events(spark, ("home", 0), ("home", 5, "tap"), ("home", 9), ("cart", 20))
    assert paths(df) == [("s1", ["home", "cart"])]
    first = sessions.trace_steps(df).orderBy("step_no").first()
    assert (first.n_events, first.dwell_s, first.interactions) == (3, 9.0, ["tap"])
    assert paths(events(spark, ("home", 0), ("home", 5)), collapse=False) == [("s1", ["home", "home"])]


@pytest.mark.parametrize(("gap", "timeout", "n"), [(7200, 1800, 2), (600, 1800, 1), (600, 300, 2), (1800, 1800, 1), (1801, 1800, 2)])
def test_timeouts(spark, gap, timeout, n):
    found = paths(events(spark, ("home", 0), ("cart", gap)), timeout_s=timeout)
    assert [t for t, _ in found] == ["s1", "s1#1"][:n]


def test_exclusions_and_gaps_over_orphans(spark):
    df = events(spark, ("home", 0), (None, 1000), ("cart", 2000)).unionByName(events(spark, ("home", 0), session=""))
    row = sessions.exclusions(df).first()
    assert (row.n_events, row.no_session, row.no_screen) == (4, 1, 1)
    assert len(paths(df)) == 2  # the orphan doesn't bridge the gap


def test_user_is_the_last_known_one(spark):
    df = events(spark, ("splash", 0, "screen_view", None), ("login", 1, "screen_view", ""), ("otp", 2, "screen_view", "u7"), ("home", 3, "screen_view", "u42"), ("x", 4, "screen_view", None))
    assert sessions.traces(sessions.trace_steps(df)).first().user_id == "u42"


def test_graph_and_noise(spark):
    df = events(spark, ("home", 0), ("cart", 1), ("pay", 2)).unionByName(events(spark, ("home", 0), ("cart", 1), ("fail", 2), session="s2"))
    traces = sessions.traces(sessions.trace_steps(df))
    edges = {(r.source, r.target): r.weight for r in graph.edges(traces).collect()}
    assert edges == {("home", "cart"): 2, ("cart", "pay"): 1, ("cart", "fail"): 1}
    nodes = {r.screen_id: (r.visits, r.starts, r.ends, r.exit_rate) for r in graph.exit_rates(graph.nodes(traces)).collect()}
    assert nodes["home"] == (2, 2, 0, 0.0) and nodes["pay"] == (1, 0, 1, 1.0)
    kept, touched = graph.without_noise(graph.edges(traces), graph.nodes(traces), 2)
    assert kept.count() == 1 and {r.screen_id for r in touched.collect()} == {"home", "cart"}
    total = graph.probabilities(graph.edges(traces)).groupBy("source").agg(F.sum("probability").alias("p")).collect()
    assert all(abs(r.p - 1) < 1e-12 for r in total)


def test_variants_and_curve(spark):
    rows = [("a", ["x", "y"] if i < 80 else ["x", "z"] if i < 95 else ["q", "z"], 2, f"t{i}", f"u{i % 9}", T0, T0, "z") for i in range(100)]
    traces = spark.createDataFrame(rows, "app_id string, path array<string>, length long, trace_id string, user_id string, started timestamp, ended timestamp, terminal string")
    found = variants.variants(traces)
    curve = [(r["rank"], r.cumulative_pct) for r in variants.coverage_curve(found).orderBy("rank").collect()]
    assert curve == [(1, 80.0), (2, 95.0), (3, 100.0)]
    assert variants.needed_for(variants.coverage_curve(found)).first().n_needed == 2
    even = spark.createDataFrame([("a", ["s", str(i)], 5) for i in range(16)], "app_id string, path array<string>, n_sessions long")
    assert abs(variants.entropy(even).first().entropy_bits - 4) < 1e-12


def dist(spark, weights):
    return spark.createDataFrame([("a", k, v) for k, v in weights.items()], "app_id string, key string, weight long")


def test_divergence_and_psi(spark):
    js = lambda a, b: drift.js_divergence(dist(spark, a), dist(spark, b)).first().js_divergence
    assert js({"x": 3, "y": 1}, {"x": 3, "y": 1}) == 0 and js({"x": 1}, {"y": 1}) == 1 and js({"x": 1}, {}) == 1
    assert abs(js({"x": 3, "y": 1}, {"x": 1, "y": 5}) - js({"x": 1, "y": 5}, {"x": 3, "y": 1})) < 1e-12
    psi = lambda a, b, **kw: drift.psi(dist(spark, a), dist(spark, b), **kw).first().psi
    assert psi({"x": 50, "y": 50}, {"x": 52, "y": 48}) < 0.1 < 0.25 < psi({"x": 50, "y": 50}, {"x": 90, "y": 10})
    assert 0 < psi({"x": 1, "y": 1}, {"x": 2}) < 100
    tail = {f"k{i:03}": 500 // (i + 1) for i in range(150)}
    jitter = {k: max(1, round(v * (1 + 0.02 * (-1) ** i))) for i, (k, v) in enumerate(tail.items())}
    assert psi(tail, jitter) < 0.05


def test_report_status(spark):
    a, b = dist(spark, {"x": 90, "y": 10}), dist(spark, {"x": 10, "z": 90})
    rows = drift.report(a, b, a, a)
    assert {r.metric: r.status for r in rows.collect()} == {"js_divergence": "alert", "psi": "alert", "novel_rate": "alert", "drop_off_shift": "ok"}
    assert drift.overall(rows).first().overall == "alert"


def test_as_of_join(spark):
    line = events(spark, ("home", 0), ("cart", 10), (None, 12), ("pay", 20))
    signals = spark.createDataFrame([("a", i, s, T0 + timedelta(seconds=t)) for i, (s, t) in enumerate([("s1", 11), ("s1", 10), ("s1", 13), ("s1", 99), ("s1", -1), ("ghost", 5), (None, 5)])], "app_id string, signal_id long, session_id string, timestamp timestamp")
    found = risk.located(signals, line)
    got = {r.signal_id: (r.screen_id, r.position_in_session) for r in found.collect()}
    assert got == {0: ("cart", 1), 1: ("cart", 1), 2: (None, 2), 3: ("pay", 3), 4: (None, None), 5: (None, None), 6: (None, None)}
    assert risk.localisation_rate(found).first().n_located == 3


def test_quality_checks(spark):
    df = events(spark, ("home", 10), ("home", 0), ("home", 0))
    assert quality.out_of_order(df).first().n_out_of_order == 1
    assert quality.duplicates(df).first().n_duplicates == 1
    screens = spark.createDataFrame([("a", "home"), ("a", "cart")], "app_id string, screen_id string")
    rows = {r.check: r for r in quality.checks(df, screens, F.lit(T0)).collect()}
    assert rows["screen_coverage_pct"].value == 50 and not rows["screen_coverage_pct"].passed and not rows["volume"].passed
    assert not quality.verdict(quality.checks(df, screens, F.lit(T0))).first().passed


def test_parity(spark):
    rows = [("a", p, path, 10) for p, path in (("android", ["h", "c"]), ("ios", ["h", "s"]), ("android", ["h"]), ("ios", ["h"]))]
    counts = spark.createDataFrame(rows, "app_id string, platform string, path array<string>, n_sessions long")
    assert {(r.platform, tuple(r.path)) for r in parity.exclusive_paths(counts).collect()} == {("android", ("h", "c")), ("ios", ("h", "s"))}
    assert {(r.screen_id, r.platform) for r in parity.exclusive_screens(counts).collect()} == {("c", "android"), ("s", "ios")}
    covered = counts.where("platform = 'android'").select("app_id", "platform", "path")
    assert [r.path for r in parity.asymmetric(counts, covered).collect()] == [["h"]]
    assert abs(parity.divergence(counts).first().js_divergence - 0.5) < 1e-9
    assert parity.divergence(counts.where("platform = 'ios'")).count() == 0
    names = spark.createDataFrame([(" iPhone ",), ("IPAD",), (None,), ("Android",)], "p string")
    assert [r[0] for r in names.select(parity.platform_of(F.col("p"))).collect()] == ["ios", "ios", "unknown", "android"]


def test_stretches_of_a_session_carry_over(spark):
    import random

    rng, rows, at = random.Random(8), [], 0
    for i in range(400):
        at += rng.choice([0, 1, 40, 90, 2000, 7000])
        rows.append((rng.choice(["home", "home", "cart", None]), at))
    df = events(spark, *rows).unionByName(events(spark, ("home", 0), ("cart", 5), session="s2"))
    want = {kw: sorted(map(str, sessions.trace_steps(df, collapse=kw).collect())) for kw in (True, False)}
    for kw in (True, False):
        for options in ({"bucket_s": 60}, {"bucket_s": 3600}, {"bucket_s": 3600, "most": 10}, {"most": 10}):
            assert sorted(map(str, sessions.trace_steps(df, collapse=kw, **options).collect())) == want[kw]
    signals = spark.createDataFrame([("a", f"x{i}", rng.choice(["s1", "s1", "s2", "s3", None]), T0 + timedelta(seconds=rng.randint(-5, at + 10))) for i in range(80)], "app_id string, signal_id string, session_id string, timestamp timestamp")
    assert sorted(map(str, risk.located(signals, df, bucket_s=3600).collect())) == sorted(map(str, risk.located(signals, df).collect()))


def test_bucketed_store_needs_no_shuffle(spark, tmp_path):
    from trailmark.operators import ingest

    df = events(spark, ("home", 0), ("cart", 5), ("home", 9000)).unionByName(events(spark, ("home", 0), session="s2"))
    store = ingest.save_bucketed(df, "bucketed_events", 4, str(tmp_path / "store"))
    found = sessions.traces(sessions.trace_steps(store))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
    assert sorted(map(str, found.collect())) == sorted(map(str, sessions.traces(sessions.trace_steps(df)).collect()))
    ingest.save_bucketed(events(spark, ("home", 0), session="s3"), "bucketed_events", 4, str(tmp_path / "store"), mode="append")
    assert spark.table("bucketed_events").count() == 5
    spark.sql("DROP TABLE bucketed_events")
