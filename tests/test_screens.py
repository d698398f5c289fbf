"""Screen claims, locator matching and healing against plain loops."""

import random

from pyspark.sql import functions as F

from trailmark.operators import screens

ELEMENT = "app_id string, app_version string, screen_id string, doc_pos int, element_type string, resource_id string, accessibility_id string, text string, label string, clickable boolean, xpath_positional string"


def build(rng, version, names):
    rows, pos = [], 0
    for name in names:
        for _ in range(rng.randint(1, 4)):
            pos += 1
            ident = rng.choice([None, *(f"id{i}" for i in range(6))])
            rows.append(("a", version, name, pos, rng.choice(["x.Button", "x.Text"]), None, ident, rng.choice([None, "One", "two", "Three"]), None, True, f"/n[{pos}]"))
    return rows


def in_turn(pairs, before, after):
    """The claims one screen after another."""
    claimed, out = set(), []
    for a in sorted(before):
        own = pairs.get((a, a), 0.0) if a in after else None
        if own is not None and own >= screens.SAME_SCREEN:
            claimed.add(a)
            out.append((a, a, "matched"))
            continue
        free = sorted((-pairs.get((a, b), 0.0), b) for b in after if b not in claimed)
        if free and -free[0][0] >= screens.SAME_SCREEN:
            claimed.add(free[0][1])
            out.append((a, free[0][1], "renamed"))
        elif own is not None:
            claimed.add(a)
            out.append((a, a, "changed"))
        else:
            out.append((a, None, "not_captured"))
    return sorted(map(str, out + [(None, b, "new") for b in after if b not in claimed]))


def test_claims_by_rounds_equal_claims_in_turn(spark):
    for seed in range(3):
        rng = random.Random(seed)
        names = [f"s{i:02d}" for i in range(14)]
        before, after = rng.sample(names, 11), rng.sample(names, 11)
        rows = spark.createDataFrame(build(rng, "1", before) + build(rng, "2", after), ELEMENT)
        prints = screens.fingerprints(rows)
        pairs = {(r.screen_a, r.screen_b): r.similarity for r in screens.screen_pairs(prints, "1", "2").collect()}
        got = sorted(str((r.screen_a, r.screen_b, r.status)) for r in screens.matched_screens(prints, "1", "2").collect())
        assert got == in_turn(pairs, before, after)


def test_a_changed_screen_claims_its_own_name(spark):
    look = {"aa": [("1", f"a{i}") for i in range(4)], "bb": [("1", f"b{i}") for i in range(4)]}
    rows = [("a", "1", s, i, "x.Text", None, ident, None, None, False, None) for s, ids in look.items() for i, (_, ident) in enumerate(ids)]
    rows += [("a", "2", "aa", i, "x.Text", None, f"b{i}", None, None, False, None) for i in range(4)]
    got = {(r.screen_a, r.screen_b, r.status) for r in screens.matched_screens(screens.fingerprints(spark.createDataFrame(rows, ELEMENT)), "1", "2").collect()}
    assert got == {("aa", "aa", "changed"), ("bb", None, "not_captured")}


def element(version, pos, screen="s", kind="android.widget.Button", resource=None, ident=None, text=None, label=None, clickable=True):
    return ("a", version, screen, pos, kind, resource, ident, text, label, clickable, f"/n[{pos}]")


def test_locators_match_by_their_strategy(spark):
    rows = spark.createDataFrame([element("1", 0, resource="com.app.beta:id/x"), element("1", 1, resource="com.app:id/y", text="Go"), element("1", 2, ident="i", label="Go")], ELEMENT)
    button = "//android.widget.Button"
    claims = [("p", "resource_id", "com.app:id/x", 1), ("p", "resource_id", "y", 1), ("p", "semantic_xpath", f'{button}[@text="Go"]', 1), ("p", "semantic_xpath", f'{button}[@label="Go"]', 1), ("p", "semantic_xpath", button, 1), ("p", "accessibility_id", "I", 0), ("p", "class_chain", "i", 0), ("p", "positional_xpath", "/n[2]", 1)]
    df = spark.createDataFrame([("a", "s", f"{i}", *c[1:3]) for i, c in enumerate(claims)] + [("a", "unseen", "u", "accessibility_id", "i")], "app_id string, screen_id string, role string, strategy string, value string")
    got = {r.role: (r.found, r.status) for r in screens.verified_claims(df, rows).collect()}
    assert got.pop("u") == (None, "unverified")
    assert {k: v[0] for k, v in got.items()} == {str(i): c[3] for i, c in enumerate(claims)} | {"4": 1}
    two = spark.createDataFrame([element("1", 0, ident="i"), element("1", 1, ident="i")], ELEMENT)
    roles = spark.createDataFrame([("a", "s", r, "accessibility_id", "i") for r in ("LINE_ITEM", "totals", "buy")], df.schema)
    assert {r.role: r.status for r in screens.verified_claims(roles, two).collect()} == {"LINE_ITEM": "fine", "totals": "fine", "buy": "ambiguous"}


def test_healing_of_claims(spark):
    was = [element("1", 0, resource="com.app:id/go", text="Sign in"), element("1", 1, ident="gone", text="Bye"), element("1", 2, ident="twice"), element("1", 3, ident="lower", text="Terms"), element("1", 4, screen="lost", ident="x")]
    now = [element("2", 0, resource="com.app.beta:id/go2", text="Sign  In"), element("2", 1, ident="twice"), element("2", 2, ident="twice"), element("2", 3, text="TERMS")]
    rows = spark.createDataFrame(was + now, ELEMENT)
    claims = [("s", "go", "resource_id", "com.app:id/go"), ("s", "bye", "accessibility_id", "gone"), ("s", "two", "accessibility_id", "twice"), ("s", "terms", "accessibility_id", "lower"), ("s", "never", "accessibility_id", "never"), ("lost", "x", "accessibility_id", "x")]
    df = spark.createDataFrame([("a", *c) for c in claims], "app_id string, screen_id string, role string, strategy string, value string")
    out = screens.healed(df, rows, "1", "2")
    got = {r.role: (r.status, r.new_strategy, r.confidence) for r in out.collect()}
    assert got == {"go": ("repaired", "resource_id", 0.45), "bye": ("unrepairable", None, None), "two": ("ambiguous", None, None), "terms": ("review", "semantic_xpath", 0.45), "never": ("not_in_baseline", None, None)}
    total = screens.survival(out).where("strategy = '(all)'").first()
    assert (total.n, total.survived_pct, total.n_repaired, total.n_review, total.n_unrepairable) == (5, 0.0, 1, 1, 3)


def test_elements_without_a_candidate_are_told(spark):
    rows = spark.createDataFrame([element("1", 0, ident="i"), element("1", 1)], ELEMENT).withColumn("xpath_positional", F.when(F.col("doc_pos") == 0, F.col("xpath_positional")))
    assert {r.doc_pos: r.diagnosis for r in screens.best(screens.candidates(rows), rows).collect()} == {0: None, 1: "no candidate"}
