"""Path similarity, archetypes, scores, coverage, gaps, screens, outcomes, gates, the registry."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from trailmark.functions import sequences
from trailmark.operators import archetypes, coverage, gaps, gates, outcomes, screens

VARIANTS = "app_id string, path array<string>, n_sessions long, n_users long, total_us long"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def sim(a, b):
    return lcs(a, b) / max(len(a), len(b))


def test_similarity_and_backbone(spark):
    rng = random.Random(1)
    pairs = [[[rng.choice("abcde") for _ in range(rng.randint(1, 12))] for _ in range(2)] for _ in range(150)]
    pairs += [[["a"] * 70 + ["b"], ["a", "b"] * 40], [list("abcd"), list("axcy")], [["a"], []], [[], []], [["home", "cart"], ["home", "search"]]]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    rows = df.withColumns({"n": sequences.lcs_length(a, b), "s": sequences.similarity(a, b), "k": sequences.backbone(a, b)}).orderBy("i").collect()
    for r, (x, y) in zip(rows, pairs, strict=True):
        assert r.n == lcs(x, y) == len(r.k)
        assert lcs(r.k, x) == lcs(r.k, y) == len(r.k)
    assert [r.s for r in rows[-3:]] == [0.0, 1.0, 0.5]
    assert rows[151].k == ["a", "c"]
    sequences.register(spark)
    assert spark.sql("SELECT path_similarity(array('a', 'b'), array('a', 'c'))").first()[0] == 0.5


def sequential(rows, critical, most=None, threshold=0.65):
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))
    ends = lambda p: p[-1] if p[-1] in critical else None
    seeds, out = [], {}
    for p, _ in rows:
        near = [(sim(p, s), -k, s) for k, s in enumerate(seeds) if ends(s) == ends(p)]
        best = max(near, key=lambda x: x[:2], default=None)
        if best and (best[0] >= threshold or (most and len(seeds) >= most)):
            out[tuple(p)] = tuple(best[2])
        else:
            seeds.append(p)
            out[tuple(p)] = tuple(p)
    return out


@pytest.mark.parametrize(("seed", "most"), [(1, None), (2, None), (3, 3), (4, 1)])
def test_clusters_equal_the_sequential_definition(spark, seed, most):
    rng = random.Random(seed)
    paths = {tuple(rng.choice("abcd") for _ in range(rng.randint(2, 7))) for _ in range(60)}
    rows = [(list(p), rng.randint(1, 9)) for p in sorted(paths)]
    df = spark.createDataFrame([("x", p, n, 1, 10) for p, n in rows], VARIANTS)
    got = archetypes.members(df, ["d"], most=most).collect()
    path_of = {r["rank"]: tuple(r.path) for r in got}
    assert {tuple(r.path): path_of[r.seed] for r in got} == sequential(rows, ["d"], most)


def test_candidates_of_pairs_are_no_rows_of_an_exchange(spark, monkeypatch):
    """Against all pairs, of paths that share several tokens; the plan groups no pairs."""
    monkeypatch.setattr(archetypes, "MET_AT_ONCE", 3)
    rng = random.Random(7)
    paths = sorted({tuple(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(80)})
    rows = archetypes.ranked(spark.createDataFrame([("x", list(p), 1, 1, 10) for p in paths], VARIANTS), ["c"])
    found = archetypes.pairs(rows)
    expected = {(i + 1, j + 1): sim(p, q) for (i, p), (j, q) in itertools.combinations(enumerate(paths), 2) if (p[-1] == "c") == (q[-1] == "c") and sim(p, q) >= archetypes.THRESHOLD}
    got = found.collect()
    assert len(got) == len(expected) > 100 and {(r.i, r.j): r.sim for r in got} == expected
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [app_id" in plan and ", i#" not in "".join(line for line in plan.splitlines() if "Aggregate" in line)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_golden_archetypes(spark):
    rows = [("x", ["home", "cart", "payment_method"], 100, 5, 10), ("x", ["home", "search", "cart", "payment_method"], 50, 5, 10), ("x", ["account_home", "help_center"], 30, 5, 10)]
    found = archetypes.archetypes(archetypes.members(spark.createDataFrame(rows, VARIANTS))).orderBy("archetype_id").collect()
    assert [(r.archetype_id, r.n_sessions) for r in found] == [("aj_001", 150), ("aj_002", 30)]
    assert found[0].backbone == ["home", "cart", "payment_method"]
    ends = [("x", ["home", "account_home", e], n, 1, 1) for e, n in (("order_history", 500), ("account_delete", 2), ("data_export", 5))]
    df = spark.createDataFrame(ends, VARIANTS)
    assert archetypes.members(df).select("seed").distinct().count() == 1
    assert archetypes.members(df, ["account_delete", "data_export"]).select("seed").distinct().count() == 3
    assert archetypes.members(df, ["account_delete"], most=1).select("seed").distinct().count() == 2


def test_outcomes_of_paths(spark):
    df = spark.createDataFrame([(p,) for p in (["a", "order_confirmation"], ["a", "payment_failure"], ["cart"], ["home"])], "p array<string>")
    assert [r[0] for r in df.select(archetypes.outcome(F.col("p"))).collect()] == ["completed", "failed", "abandoned", "exploratory"]


def suite(spark):
    refs = [("x", "t1", s, "high", i, 0) for i, s in enumerate(["home", "home", "cart", "pay"])] + [("x", "t2", "home", "low", 1, 0), ("x", "t3", "old", "high", 1, 0), ("x", "t3", "gone", "high", 2, 0), ("x", "keep_t4", "old", "high", 1, 0), ("x", "keep_t4", "gone", "medium", 2, 0)]
    return spark.createDataFrame(refs, "app_id string, test_id string, screen_id string, confidence string, line int, ord int")


def test_coverage_and_findings(spark):
    refs = suite(spark)
    paths = coverage.test_paths(refs)
    assert {r.test_id: r.path for r in paths.collect()} == {"t1": ["home", "cart", "pay"], "t3": ["old", "gone"], "keep_t4": ["old", "gone"]}
    tested = coverage.tested_transitions(paths)
    edges = spark.createDataFrame([("x", "home", "cart", 90), ("x", "cart", "pay", 10), ("x", "home", "del", 9), ("x", "del", "home", 1)], "app_id string, source string, target string, weight long")
    journeys = spark.createDataFrame([("x", "j1", ["home", "cart", "pay"], 100, 9.0), ("x", "j2", ["home", "del"], 2, 5.0), ("x", "j3", ["home", "cart", "home"], 50, 1.0)], "app_id string, journey_id string, path array<string>, n_sessions long, score double")
    covered = coverage.journey_coverage(journeys, tested)
    assert {r.journey_id: (r.coverage, r.missing) for r in covered.collect()} == {"j1": (1.0, []), "j2": (0.0, ["home > del"]), "j3": (0.5, ["cart > home"])}
    rows = coverage.transition_coverage(edges, tested)
    tests = refs.select("app_id", "test_id").distinct().withColumn("language", F.lit("java"))
    total = coverage.summary(rows, covered, tests, paths).first()
    assert (total.n_transitions, total.n_covered, total.covered_pct, total.unmapped_tests) == (4, 2, 50.0, 1)
    assert total.weighted_pct == pytest.approx(100 * 100 / 110)
    found = gaps.journey_gaps(journeys, covered, ["del"])
    assert {(r.subject, r.severity) for r in found.collect()} == {("j2", "critical"), ("j3", "medium")}
    assert gaps.transition_gaps(rows, covered, ["del"]).count() == 0  # the journey names it already
    assert [(r.subject, r.severity) for r in gaps.transition_gaps(rows, covered.where("journey_id <> 'j2'"), ["del"]).collect()] == [("home > del", "high")]
    dead = gaps.dead_tests(gaps.reachability(tested, edges), [("keep_*", "kept for a reason that is long")])
    assert {(r.subject, r.kind) for r in dead.collect()} == {("t3", "obsolete"), ("keep_t4", "protected_retained")}
    assert [r.test_id for r in gaps.deletable(dead, ["t3"], []).collect()] == ["t3"] and gaps.deletable(dead, [], []).count() == 0
    with pytest.raises(Exception, match="protected test"):
        gaps.guarded(dead.select("app_id", F.col("subject").alias("test_id")), [("re:^keep", "r")]).collect()
    everything = found.unionByName(dead).unionByName(gaps.unmapped(tests, paths))
    assert gaps.ordered(everything).orderBy("place").first().subject == "j2"
    assert {(r.measure, r.label): r.n for r in gaps.tallies(everything).collect()}["kind", "stale"] == 0
    assert {r.priority for r in gaps.tickets(everything).collect()} == {"Highest", "Medium"}
    facts = coverage.test_facts(refs, refs.where("screen_id = 'cart'").select("app_id", "test_id", "screen_id"))
    assert [(r.subject, r.detail) for r in gaps.assertion_gaps(facts, ["pay", "cart"]).collect()] == [("t1", "pay")]


def test_tests_of_journeys_are_counted_without_their_pairs(spark):
    """Against plain sets; coverage itself holds no list of tests, which each journey would repeat."""
    rng = random.Random(5)
    walk = lambda: [rng.choice("abcd") for _ in range(rng.randint(1, 5))]
    paths = spark.createDataFrame([("x", f"t{i}", walk()) for i in range(60)], "app_id string, test_id string, path array<string>")
    journeys = spark.createDataFrame([("x", f"j{i}", walk(), i, float(i)) for i in range(40)], "app_id string, journey_id string, path array<string>, n_sessions long, score double")
    tested = coverage.tested_transitions(paths)
    steps = lambda path: set(itertools.pairwise(path))
    tests = {r.test_id: steps(r.path) for r in paths.collect()}
    wanted = {r.journey_id: {t for t, s in tests.items() if s & steps(r.path)} for r in journeys.collect()}
    assert {(r.journey_id, r.test_id) for r in coverage.covering_tests(journeys, tested).collect()} == {(j, t) for j, ts in wanted.items() for t in ts}
    counted = coverage.covering_counts(journeys, tested, met_at_once=3).collect()
    assert {r.journey_id: r.n_tests for r in counted} == {j: len(ts) for j, ts in wanted.items() if ts} and len(counted) < 40
    over = {r.subject: r.detail for r in gaps.over_tested(journeys, tested).collect()}
    assert over == {j: f"{len(ts)} tests" for j, ts in wanted.items() if len(ts) >= 3 and int(j[1:]) < 19} and over
    assert not [f.name for f in coverage.journey_coverage(journeys, tested).schema if f.name == "tests"]


XML = """<hierarchy><android.widget.FrameLayout class="android.widget.FrameLayout">{}</android.widget.FrameLayout></hierarchy>"""
NODE = '<node class="android.widget.Button" content-desc="{}" resource-id="app:id/{}" text="{}" clickable="true"/>'


def test_dumps_locators_and_healing(spark, tmp_path):
    dumps = {("1", "cart"): [("buy", "b", "Buy"), ("", "dup", "A"), ("", "dup", "B")], ("2", "cart"): [("buy_now", "b", "Buy"), ("", "dup", "A"), ("", "dup", "B")], ("1", "old"): [("x", "x", "X")], ("2", "fresh"): [("y", "y", "Y")]}
    for (version, screen), nodes in dumps.items():
        (tmp_path / version).mkdir(exist_ok=True)
        (tmp_path / version / f"{screen}.xml").write_text(XML.format("".join(NODE.format(*n) for n in nodes)))
    elements = screens.read_dumps(spark, str(tmp_path)).withColumn("app_id", F.lit("x"))
    assert elements.where("app_version = '1' AND screen_id = 'cart'").count() == 4
    assert {r.xpath_positional for r in elements.where("screen_id = 'old'").collect()} == {"/android.widget.FrameLayout[1]", "/android.widget.FrameLayout[1]/android.widget.Button[1]"}
    ranked = screens.candidates(elements)
    dup = ranked.where("value = 'app:id/dup' AND app_version = '1'").first()
    assert (dup.matches, dup.usable) == (2, False) and dup.stability == pytest.approx(0.8 / 3)
    best = {(r.screen_id, r.doc_pos): r.value for r in screens.best(ranked).where("app_version = '1'").collect()}
    assert best["cart", 1] == "buy" and best["cart", 0] is None
    healed = {(r.screen_id, r.value): r.status for r in screens.healed(screens.own_claims(elements, "1"), elements, "1", "2").collect()}
    assert healed["cart", "buy"] == "repaired" and ("old", "x") not in healed
    matches = {(r.screen_a, r.screen_b): r.status for r in screens.matched_screens(screens.fingerprints(elements), "1", "2").collect()}
    assert matches["old", None] == "not_captured" and matches[None, "fresh"] == "new"
    assert screens.fingerprints(elements).where("screen_id = 'cart'").select("digest").distinct().count() == 2
    names = [r.role for r in screens.roles(elements).where("screen_id = 'cart' AND app_version = '1'").orderBy("doc_pos").collect()]
    assert len(set(names)) == 4 and names[1] == "buy"
    (tmp_path / "1" / "bad.xml").write_text("<oops>")
    with pytest.raises(Exception, match="malformed dump"):
        screens.read_dumps(spark, str(tmp_path)).collect()


def test_outcome_report_and_tuning(spark):
    origins = ["uncovered_gap"] * 5 + ["covered_but_missed"] * 4 + ["unknown_journey"] + ["out_of_scope"] * 2
    journeys = spark.createDataFrame([("x", "covered", 1.0), ("x", "open", 0.5)], "app_id string, journey_id string, coverage double")
    name = {"uncovered_gap": "open", "covered_but_missed": "covered", "unknown_journey": "nobody", "out_of_scope": None}
    defects = spark.createDataFrame([("x", i, name[o]) for i, o in enumerate(origins)], "app_id string, defect_id int, journey_id string")
    found = outcomes.attributed(defects, journeys)
    assert sorted(r.origin for r in found.collect()) == sorted(origins)
    closed = [("x", "j", "t", True)] * 6 + [("x", "j", "t", False)] * 2 + [("x", "j", None, None)] * 3
    row = outcomes.outcome_report(found, spark.createDataFrame(closed, "app_id string, journey_id string, closed_by_test string, caused_defect boolean")).first()
    assert (row.true_positives, row.false_positives, row.unresolved, row.false_negatives) == (6, 2, 3, 5)
    assert (round(row["precision"], 3), round(row.recall, 3)) == (0.75, 0.545)
    rates = spark.createDataFrame([("x", c, 18, r) for c, r in zip(outcomes.COMPONENTS, (0.556, 0.889, 0.333, 1.0), strict=True)], "app_id string, component string, n long, hit_rate double")
    moved = {r.component: round(r.delta, 4) for r in outcomes.weight_proposal(rates, archetypes.WEIGHTS).collect()}
    assert moved == {"frequency": -0.0277, "business_value": 0.0389, "risk": -0.05, "exposure": 0.05}
    thin = outcomes.weight_proposal(rates.withColumn("n", F.lit(9)), archetypes.WEIGHTS)
    assert all(r.proposed == r.weight for r in thin.collect())


def test_run_verdicts(spark):
    rows = [("x", t, p, ok, True, 1.0) for t, oks in (("a", (1, 1, 1)), ("b", (0, 0, 0)), ("c", (1, 0, 1)), ("d", (1, 1))) for p, ok in enumerate(map(bool, oks))] + [("x", "e", 1, True, False, None)]
    df = spark.createDataFrame(rows, "app_id string, test_name string, profile int, passed boolean, executed boolean, duration_s double")
    assert {r.test_name: r.verdict for r in outcomes.run_verdicts(df).collect()} == {"a": "validated", "b": "failed", "c": "flaky", "d": "unvalidated", "e": "unvalidated"}
    assert gates.verdicts(gates.run_gate(outcomes.run_verdicts(df))).first().passed


def test_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([("x", "1", 5.0, 2.0, "n")], "app_id string, release_version string, total_test_count double, flaky_test_pct double, notes string")
    path = str(tmp_path / "s")
    outcomes.save_snapshots(rows, path)
    with pytest.raises(Exception, match="snapshot exists"):
        outcomes.save_snapshots(rows, path)
    assert outcomes.load_snapshots(spark, path).count() == 1
    outcomes.with_checksum(rows.withColumn("release_version", F.lit("2"))).withColumn("total_test_count", F.lit(9.0)).write.mode("append").parquet(path)
    with pytest.raises(Exception, match="damaged snapshot"):
        outcomes.load_snapshots(spark, path).collect()
    after = rows.withColumns({"total_test_count": F.lit(6.0), "flaky_test_pct": F.lit(3.0)})
    delta = {r.metric: (r.delta_pct, r.improved) for r in outcomes.baseline_delta(rows, after).collect()}
    assert delta == {"total_test_count": (20.0, True), "flaky_test_pct": (50.0, False)}
    with pytest.raises(Exception, match="no counterpart"):
        outcomes.baseline_delta(rows, after.withColumn("app_id", F.lit("y"))).collect()


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab*./[]?", max_size=8))
def test_registry_patterns_compile(pattern):
    import re

    assert re.compile(gaps.registry_pattern(pattern))


def test_entry_points(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
    rows = entry.entry(spark)
    assert {"path", "n_sessions", "share"} <= set(rows.columns) and rows.count() > 0


def test_findings_cut_sessions_once_for_each_table(spark, monkeypatch):
    from trailmark.plans import journeys, testing

    made, steps = [], journeys.steps
    monkeypatch.setattr(journeys, "steps", lambda *args: made.append(args) or steps(*args))
    assert testing.findings(spark, "/root/testdata/sf0.001").count() > 0
    assert len(made) == 3
