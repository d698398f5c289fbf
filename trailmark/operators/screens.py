"""Screens and locators across releases.

``elements``: (app_id, app_version, screen_id, doc_pos, parent_pos, depth, element_type,
resource_id, accessibility_id, text, label, clickable, enabled, displayed, xpath_positional).
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.functions.cutting import cut

SCREEN = ("app_id", "app_version", "screen_id")
ELEMENT_DDL = "file string, doc_pos int, parent_pos int, depth int, element_type string, resource_id string, accessibility_id string, text string, label string, clickable boolean, enabled boolean, displayed boolean, xpath_positional string"
# How stable each strategy is, and what a repair needs.
STABILITY = {"accessibility_id": 1.00, "resource_id": 0.80, "semantic_xpath": 0.55, "class_chain": 0.45, "positional_xpath": 0.15, "coordinates": 0.00}
USABLE = 0.5
MIN_REPAIR = 0.45
SAME_SCREEN = 0.55
# Names of roles that stand for many elements.
MANY = "s$|item|row|cell|card|entry|option|tile|chip"


def parse_dump(content: bytes) -> Iterator[tuple]:
    """Elements of one hierarchy dump, Android or iOS, in document order."""
    root = ElementTree.fromstring(content)
    tops = list(root) if root.tag == "hierarchy" else [root]
    stack = [(e, -1, 0, f"/{e.get('class') or e.get('type') or e.tag}[{i + 1}]") for i, e in reversed(list(enumerate(tops)))]
    at = 0
    yes = lambda e, *names: next((e.get(n) == "true" for n in names if e.get(n) is not None), True)
    while stack:
        e, parent, depth, path = stack.pop()
        kind = e.get("class") or e.get("type") or e.tag
        yield at, parent, depth, kind, e.get("resource-id") or None, e.get("content-desc") or e.get("name") or None, e.get("text") or e.get("value") or None, e.get("label") or None, e.get("clickable") == "true", yes(e, "enabled"), yes(e, "displayed", "visible"), path
        seen: dict[str, int] = {}
        children = []
        for child in e:
            name = child.get("class") or child.get("type") or child.tag
            seen[name] = seen.get(name, 0) + 1
            children.append((child, at, depth + 1, f"{path}/{name}[{seen[name]}]"))
        stack.extend(reversed(children))
        at += 1


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in ELEMENT_DDL.split(", ")]
    for batch in batches:
        for file, content in zip(batch["file"], batch["content"], strict=True):
            try:
                rows = [(file, *r) for r in parse_dump(bytes(content))]
            except ElementTree.ParseError as e:
                raise ValueError(f"malformed dump {file}: {e}") from e
            yield pd.DataFrame(rows, columns=names)


def parse_dumps(dumps: DataFrame) -> DataFrame:
    """Element rows of dumps (file, content)."""
    return dumps.select("file", F.col("content").cast("binary").alias("content")).mapInPandas(_parse, ELEMENT_DDL)


def read_dumps(spark: SparkSession, folder: str) -> DataFrame:
    """Elements of ``<folder>/<version>/<screen>.xml``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", True).load(folder)
    rows = parse_dumps(files.select(F.col("path").alias("file"), "content"))
    part = F.split("file", "/")
    return rows.withColumns({"app_version": F.element_at(part, -2), "screen_id": F.regexp_replace(F.element_at(part, -1), r"\.xml$", "")})


def short_type(kind: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(kind, r"\."), -1), "^XCUIElementType", "")


def short_id(resource: Column) -> Column:
    """What follows the first slash; empty without one."""
    return F.element_at(F.split(F.when(F.contains(resource, F.lit("/")), resource).otherwise(F.concat(resource, F.lit("/"))), "/", 2), -1)


def plain_text(text: Column) -> Column:
    """Blanks folded, lower case, 60 characters."""
    return F.left(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), F.lit(60))


def semantic_xpath(elements: DataFrame) -> Column:
    """The element's type with its text, else its label, else alone."""
    kind = F.concat(F.lit("//"), "element_type")
    label = F.col("label") if "label" in elements.columns else F.lit(None).cast("string")
    by = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(kind, F.lit(f'[@{name}="'), value, F.lit('"]')))
    return F.coalesce(by("text", F.col("text")), by("label", label), kind)


def summary(elements: DataFrame) -> DataFrame:
    """Elements of each screen, interactive and identifiable ones."""
    return elements.groupBy(*SCREEN).agg(F.count("*").alias("n_elements"), F.count_if("clickable").alias("n_interactive"), F.count("accessibility_id").alias("n_accessibility"), F.count("resource_id").alias("n_resource"))


def candidates(elements: DataFrame) -> DataFrame:
    """Up to four locators of each element with how often they match on the screen, and stability,
    which ambiguity divides (P19, P21, L5)."""

    def one(strategy: str, value: Column) -> Column:
        return F.struct(F.lit(strategy).alias("strategy"), value.alias("value"))

    semantic = semantic_xpath(elements)
    anchored = F.when(F.endswith(semantic, F.lit("]")), semantic)
    listed = F.array(one("accessibility_id", F.col("accessibility_id")), one("resource_id", F.col("resource_id")), one("semantic_xpath", anchored), one("positional_xpath", F.col("xpath_positional")))
    rows = elements.select(*SCREEN, "doc_pos", F.explode(F.filter(listed, lambda x: F.coalesce(x["value"], F.lit("")) != "")).alias("l")).select(*SCREEN, "doc_pos", "l.*")
    matches = F.count("*").over(W.partitionBy(*SCREEN, "strategy", "value"))
    return with_stability(rows.withColumn("matches", matches))


def with_stability(locators: DataFrame) -> DataFrame:
    base = F.coalesce(F.create_map(*[F.lit(x) for item in STABILITY.items() for x in item])[F.col("strategy")], F.lit(0.0))
    ambiguous = F.when(F.col("matches") == 0, F.lit(0.0)).when(F.col("matches") == 1, base).otherwise(base / (1 + F.col("matches")))
    return locators.withColumns({"stability": ambiguous, "usable": (F.col("matches") == 1) & (base >= USABLE)})


def best(candidate_rows: DataFrame, elements: DataFrame | None = None) -> DataFrame:
    """Each element's candidates ranked, the first usable one, and why there is none.
    With ``elements`` those without any candidate are told too."""
    ranked = W.partitionBy(*SCREEN, "doc_pos").orderBy(F.desc("stability"), "matches", "value")
    rows = candidate_rows.withColumn("place", F.row_number().over(ranked))
    grouped = rows.groupBy(*SCREEN, "doc_pos").agg(
        F.min_by(F.struct("strategy", "value"), F.when(F.col("usable"), F.col("place"))).alias("best"),
        F.count_if("usable").alias("n_usable"),
        F.count_if(F.col("matches") == 1).alias("n_unique"),
    )
    if elements is not None:
        grouped = elements.select(*SCREEN, "doc_pos").join(grouped, [*SCREEN, "doc_pos"], "left")
    reason = F.when(F.col("n_usable") > 0, F.lit(None)).when(F.col("n_unique").isNull(), "no candidate").when(F.col("n_unique") == 0, "all ambiguous").otherwise("only fragile")
    return grouped.select(*SCREEN, "doc_pos", "best.*", F.coalesce("n_usable", F.lit(0)).alias("n_usable"), reason.alias("diagnosis"))


def roles(elements: DataFrame) -> DataFrame:
    """A name for each element that is unique on its screen."""
    options = {"accessibility_id": F.nullif("accessibility_id", F.lit("")), "resource_id": F.nullif(short_id(F.col("resource_id")), F.lit("")), "text": F.nullif("text", F.lit(""))}
    rows = elements
    for name, value in options.items():
        rows = rows.withColumn(f"__{name}", F.when(F.count(value).over(W.partitionBy(*SCREEN, value)) == 1, value))
    base = F.lower(F.regexp_replace(F.coalesce(*[F.col(f"__{n}") for n in options], short_type(F.col("element_type"))), "[^A-Za-z0-9]+", "_"))
    nth = F.row_number().over(W.partitionBy(*SCREEN, "__role").orderBy("doc_pos"))
    named = rows.withColumn("__role", base).withColumn("role", F.when(nth > 1, F.concat("__role", F.lit("_"), nth.cast("string"))).otherwise(F.col("__role")))
    return named.drop("__role", *[f"__{n}" for n in options])


def fingerprints(elements: DataFrame) -> DataFrame:
    """Accessibility ids, texts and counted types of each screen, with a digest of ids and types (L1)."""
    types = elements.groupBy(*SCREEN, short_type(F.col("element_type")).alias("t")).agg(F.count("*").alias("n"))
    counted = types.groupBy(*SCREEN).agg(F.array_sort(F.collect_list(F.struct("t", "n"))).alias("types"))
    sets = elements.groupBy(*SCREEN).agg(F.array_sort(F.collect_set("accessibility_id")).alias("ids"), F.array_sort(F.collect_set(F.nullif(plain_text(F.col("text")), F.lit("")))).alias("texts"))
    rows = sets.join(counted, list(SCREEN))
    listed = F.concat(F.array_join("ids", ","), F.lit("|"), F.array_join(F.transform("types", lambda x: F.concat(x["t"], F.lit(":"), x["n"].cast("string"))), ","))
    return rows.withColumn("digest", F.left(F.sha2(listed, 256), F.lit(16)))


def _jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def _bag(a: Column, b: Column) -> Column:
    names = F.array_union(F.transform(a, lambda x: x["t"]), F.transform(b, lambda x: x["t"]))
    ma, mb = F.map_from_entries(a), F.map_from_entries(b)
    n = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0).cast("long"))
    total = lambda f: F.aggregate(names, F.lit(0).cast("long"), lambda acc, k: acc + f(n(ma, k), n(mb, k)))
    return F.when(F.size(names) == 0, F.lit(1.0)).otherwise(total(F.least) / total(F.greatest))


def screen_pairs(fingerprint_rows: DataFrame, before: str, after: str) -> DataFrame:
    """(app_id, screen, other, similarity) of two builds' screens that share an id, a text or the
    name, or both have no ids (L2). Others stay below what counts as the same screen, as their
    disjoint ids weigh more than half."""
    sides = []
    for version, name in ((before, "a"), (after, "b")):
        side = fingerprint_rows.where(F.col("app_version") == version)
        sides.append(side.select("app_id", F.col("screen_id").alias(f"screen_{name}"), F.col("ids").alias(f"ids_{name}"), F.col("texts").alias(f"texts_{name}"), F.col("types").alias(f"types_{name}")))
    keyed = []
    for side, name in zip(sides, "ab", strict=True):
        marks = F.concat(F.transform(f"ids_{name}", lambda x: F.concat(F.lit("i:"), x)), F.transform(f"texts_{name}", lambda x: F.concat(F.lit("t:"), x)), F.array(F.concat(F.lit("s:"), f"screen_{name}")), F.when(F.size(f"ids_{name}") == 0, F.array(F.lit("no ids"))).otherwise(F.array().cast("array<string>")))
        keyed.append(side.select("app_id", f"screen_{name}", F.explode(marks).alias("mark")))
    met = keyed[0].join(keyed[1], ["app_id", "mark"]).select("app_id", "screen_a", "screen_b").distinct()
    rows = met.join(sides[0], ["app_id", "screen_a"]).join(sides[1], ["app_id", "screen_b"])
    value = _jaccard(F.col("ids_a"), F.col("ids_b")) * 0.55 + _bag(F.col("types_a"), F.col("types_b")) * 0.25 + _jaccard(F.col("texts_a"), F.col("texts_b")) * 0.20
    return rows.select("app_id", "screen_a", "screen_b", F.round(value, 4).alias("similarity"))


def _claims(options: DataFrame, floating: DataFrame, direct: DataFrame) -> DataFrame:
    """(app_id, screen_a, screen_b, similarity) of the claims of screens that don't match their own
    name, taken one screen after another in the order of their names.

    A screen takes the most similar screen that no earlier one has claimed, and without one its own
    name, if that is still there. The rounds give the same: a screen decides as soon as its best
    free option is no undecided earlier screen's option or name, or when none is left. The first
    undecided one always decides. ``options``: (app_id, screen_a, screen_b, similarity);
    ``floating``: (app_id, screen_a, own_score), the score null without a screen of that name;
    ``direct``: (app_id, screen_b) that match by name.
    """
    claims = cut(direct.select("app_id", F.col("screen_b").alias("screen_a"), "screen_b", F.lit(None).cast("double").alias("similarity"), F.lit(True).alias("by_name")), "claims")
    left, done = cut(floating, "floating"), None
    while not left.isEmpty():
        first = claims.groupBy("app_id", "screen_b").agg(F.min("screen_a").alias("first"))
        free = options.join(left.select("app_id", "screen_a"), ["app_id", "screen_a"]).join(first, ["app_id", "screen_b"], "left").where("first IS NULL OR first >= screen_a").drop("first")
        free = cut(free, "free")
        wanted = free.select("app_id", "screen_b", "screen_a").union(left.where("own_score IS NOT NULL").select("app_id", F.col("screen_a").alias("screen_b"), "screen_a"))
        turn = wanted.groupBy("app_id", "screen_b").agg(F.min("screen_a").alias("turn"))
        top = free.groupBy("app_id", "screen_a").agg(F.min_by(F.struct("screen_b", "similarity"), F.struct(-F.col("similarity"), "screen_b")).alias("t")).select("app_id", "screen_a", "t.*")
        taken = top.join(turn, ["app_id", "screen_b"]).where("turn = screen_a").select("app_id", "screen_a", "screen_b", "similarity")
        none = left.join(top.select("app_id", "screen_a"), ["app_id", "screen_a"], "left_anti")
        none = none.select("app_id", "screen_a", F.when(F.col("own_score").isNotNull(), F.col("screen_a")).alias("screen_b"), F.col("own_score").alias("similarity"))
        now = cut(taken.union(none).withColumn("by_name", F.lit(False)), "claims")
        claims = claims.union(now.where("screen_b IS NOT NULL"))
        done = now if done is None else done.union(now)
        left = cut(left.join(now.select("app_id", "screen_a"), ["app_id", "screen_a"], "left_anti"), "floating")
    return (claims.limit(0) if done is None else done).drop("by_name")


def matched_screens(fingerprint_rows: DataFrame, before: str, after: str) -> DataFrame:
    """Screens of two builds as matched, renamed, changed, not_captured or new (L3).

    ``similarity`` is that of the two screens; it is null for screens of one build alone, whose
    nearest neighbour would take all pairs.
    """
    pairs = cut(screen_pairs(fingerprint_rows, before, after), "screen-pairs")
    like = pairs.where(F.col("similarity") >= SAME_SCREEN)
    matched = like.where("screen_a = screen_b")
    own = pairs.where("screen_a = screen_b").select("app_id", "screen_a", F.col("similarity").alias("own_score"))
    old = fingerprint_rows.where(F.col("app_version") == before).select("app_id", F.col("screen_id").alias("screen_a"))
    new = fingerprint_rows.where(F.col("app_version") == after).select("app_id", F.col("screen_id").alias("screen_b"))
    floating = old.join(matched, ["app_id", "screen_a"], "left_anti").join(own, ["app_id", "screen_a"], "left")
    claimed = _claims(like.where("screen_a <> screen_b"), floating, matched)
    status = F.when(F.col("screen_b").isNull(), "not_captured").when(F.col("screen_a") == F.col("screen_b"), "changed").otherwise("renamed")
    found = matched.select("app_id", "screen_a", "screen_b", F.lit("matched").alias("status"), "similarity").unionByName(claimed.withColumn("status", status))
    seen = found.where("screen_b IS NOT NULL").select("app_id", "screen_b")
    nothing = F.lit(None)
    fresh = new.join(seen, ["app_id", "screen_b"], "left_anti").select("app_id", nothing.cast("string").alias("screen_a"), "screen_b", F.lit("new").alias("status"), nothing.cast("double").alias("similarity"))
    return found.unionByName(fresh)


def identity_stability(matched_rows: DataFrame) -> DataFrame:
    """Share of comparable screens (all but those not captured) that kept their identity, under
    their name or another, in per cent (L4)."""
    comparable = matched_rows.where("status <> 'not_captured'")
    kept = F.count_if(F.col("status").isin("matched", "renamed"))
    return comparable.groupBy("app_id").agg(F.count("*").alias("n_comparable"), F.round(kept * 100 / F.count("*"), 1).alias("stability_pct"))


def merged_locators(locators: DataFrame) -> DataFrame:
    """Locators of several sources with roles folded: roles that share a unique locator of a screen
    are one, named by the first source (L8). ``locators``: app_id, screen_id, source, source_ord,
    role, strategy, value, matches; the result has ``sources``, all that gave a locator."""
    first = W.partitionBy("app_id", "screen_id", "strategy", "value").orderBy("source_ord", "role")
    unique = locators.where("matches = 1").withColumn("owner", F.first("role").over(first))
    owner = unique.where("owner <> role").groupBy("app_id", "screen_id", "role").agg(F.min_by("owner", F.struct("source_ord", "owner")).alias("owner"))
    joined = locators.join(owner, ["app_id", "screen_id", "role"], "left").withColumn("role", F.coalesce("owner", "role"))
    return joined.groupBy("app_id", "screen_id", "role", "strategy", "value").agg(F.min_by("matches", "source_ord").alias("matches"), F.array_sort(F.collect_set("source")).alias("sources"))


def match_keys(strategy: Column, value: Column) -> Column:
    """What a locator looks for in ``element_keys``: an id also by its part after the last slash."""
    one = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("key"))
    found = F.when(strategy == "accessibility_id", F.array(one("accessibility_id", value)))
    found = found.when(strategy == "resource_id", F.array(one("resource_id", value), one("short_id", F.element_at(F.split(value, "/"), -1))))
    for xpath in ("semantic_xpath", "positional_xpath"):
        found = found.when(strategy == xpath, F.array(one(xpath, value)))
    return found


def element_keys(elements: DataFrame) -> DataFrame:
    """An index of elements: (screen, doc_pos, kind, key) of all that a locator can match."""
    kinds = {"accessibility_id": F.col("accessibility_id"), "resource_id": F.col("resource_id"), "short_id": short_id(F.nullif("resource_id", F.lit(""))), "semantic_xpath": semantic_xpath(elements), "positional_xpath": F.col("xpath_positional")}
    listed = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in kinds.items()]), lambda x: x["key"].isNotNull())
    return elements.select(*SCREEN, "doc_pos", F.explode(listed).alias("k")).select(*SCREEN, "doc_pos", "k.*")


def locator_matches(claims: DataFrame, elements: DataFrame) -> DataFrame:
    """Claims (app_id, screen_id, role, strategy, value) with ``found``, the elements of one build
    that they match, and ``at``, the first of these; null on screens without a dump."""
    claim = ["app_id", "screen_id", "role", "strategy", "value"]
    wanted = claims.select(*claim, F.explode(match_keys(F.col("strategy"), F.col("value"))).alias("k")).select(*claim, "k.*")
    met = wanted.join(element_keys(elements), ["app_id", "screen_id", "kind", "key"]).select(*claim, "doc_pos").distinct()
    counted = met.groupBy(*claim).agg(F.count("*").alias("found"), F.min("doc_pos").alias("at"))
    dumped = elements.select("app_id", "screen_id").distinct().withColumn("dumped", F.lit(True))
    rows = claims.select(*claim).distinct().join(dumped, ["app_id", "screen_id"], "left").join(counted, claim, "left")
    return rows.withColumn("found", F.when(F.col("dumped"), F.coalesce("found", F.lit(0)))).drop("dumped")


def verified_claims(claims: DataFrame, elements: DataFrame) -> DataFrame:
    """Claimed locators with the matches that a build's dumps show (L9): missing, ambiguous (roles
    that stand for many elements may match several), fine, or unverified without a dump."""
    rows = locator_matches(claims, elements)
    status = F.when(F.col("found").isNull(), "unverified").when(F.col("found") == 0, "missing").when((F.col("found") > 1) & ~F.lower("role").rlike(MANY), "ambiguous").otherwise("fine")
    return rows.withColumn("status", status).drop("at")


def screen_resolution(element_best: DataFrame) -> DataFrame:
    """Elements with a usable locator on each screen, by strategy, and why others have none."""
    done = F.col("n_usable") > 0
    why = lambda name, reason: F.count_if(F.col("diagnosis") == reason).alias(name)
    mix = [F.count_if(F.col("strategy") == x).alias(x) for x in STABILITY]
    grouped = element_best.groupBy(*SCREEN).agg(
        F.count("*").alias("n_elements"), F.count_if(done).alias("n_resolved"), F.round(F.count_if(done) / F.count("*"), 3).alias("rate"), *mix, why("n_no_candidate", "no candidate"), why("n_ambiguous", "all ambiguous"), why("n_fragile", "only fragile")
    )
    return grouped.withColumn("strategy_mix", F.struct(*STABILITY)).drop(*STABILITY)


def source_resolution(locators: DataFrame, declared: DataFrame) -> DataFrame:
    """Each declared screen with the sources that reached it, its roles and those with a usable
    locator, by strategy, and a diagnosis of screens that no source reached (L8b). ``locators`` as
    of ``merged_locators``; ``declared``: app_id, screen_id."""
    rated = with_stability(locators)
    role = ["app_id", "screen_id", "role"]
    rank = F.struct(-F.col("stability"), "matches", "value")
    roles_ = rated.groupBy(*role).agg(F.min_by("strategy", F.when(F.col("usable"), rank)).alias("strategy"), F.flatten(F.collect_list("sources")).alias("sources"), F.count_if(F.col("matches") == 1).alias("n_unique"))
    found = F.col("strategy").isNotNull()
    by_screen = roles_.groupBy("app_id", "screen_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.count("*").alias("n_roles"), F.count_if(found).alias("n_resolved"),
        *[F.count_if(F.col("strategy") == x).alias(x) for x in STABILITY], F.count_if(~found & (F.col("n_unique") == 0)).alias("n_ambiguous"), F.count_if(~found & (F.col("n_unique") > 0)).alias("n_fragile"),
    )
    rows = declared.select("app_id", "screen_id").distinct().join(by_screen, ["app_id", "screen_id"], "left").na.fill(0)
    rate = F.coalesce(F.round(F.try_divide("n_resolved", "n_roles"), 3), F.lit(0.0))
    diagnosis = F.when(F.col("n_roles") == 0, "no source reached the screen").when(F.col("n_resolved") == F.col("n_roles"), F.lit(None)).otherwise("unresolved roles")
    mixed = F.struct(*[F.col(x) for x in STABILITY])
    return rows.withColumns({"sources": F.coalesce("sources", F.array().cast("array<string>")), "rate": rate, "strategy_mix": mixed, "diagnosis": diagnosis}).drop(*STABILITY)


def journey_resolution(journeys: DataFrame, resolvable: DataFrame) -> DataFrame:
    """Steps of each journey on screens with a usable locator; executable if all are.
    ``resolvable``: (app_id, screen_id)."""
    steps = journeys.select("app_id", "journey_id", F.explode("path").alias("screen_id"))
    seen = steps.join(resolvable.select("app_id", "screen_id").distinct().withColumn("ok", F.lit(True)), ["app_id", "screen_id"], "left")
    return seen.groupBy("app_id", "journey_id").agg(F.count("*").alias("n_steps"), F.count("ok").alias("n_resolved"), (F.count("ok") / F.count("*")).alias("ratio"), (F.count("ok") == F.count("*")).alias("executable"))


def blocking_screens(journeys: DataFrame, resolvable: DataFrame) -> DataFrame:
    """Screens without a usable locator by the journeys they block."""
    steps = journeys.select("app_id", "journey_id", F.explode("path").alias("screen_id")).distinct()
    return steps.join(resolvable.select("app_id", "screen_id").distinct(), ["app_id", "screen_id"], "left_anti").groupBy("app_id", "screen_id").agg(F.count("*").alias("n_journeys"))


def element_similarity(a: str, b: str) -> Column:
    """Likeness of two elements of one screen, whose columns carry the prefixes a and b."""
    said = lambda x: F.coalesce(x, F.lit(""))
    score = lambda same, w: F.when(same, w).otherwise(0.0)
    equal = lambda f, c: f(said(F.col(f"{a}{c}"))) == f(said(F.col(f"{b}{c}")))
    id_a = short_id(said(F.col(f"{a}resource_id")))
    parts = [
        score(equal(lambda x: x, "accessibility_id") & (said(F.col(f"{a}accessibility_id")) != ""), 0.45),
        score(equal(plain_text, "text") & (said(F.col(f"{a}text")) != ""), 0.25),
        score(equal(short_type, "element_type"), 0.15),
        score((id_a == short_id(said(F.col(f"{b}resource_id")))) & (id_a != ""), 0.10),
        score(F.col(f"{a}clickable") == F.col(f"{b}clickable"), 0.05),
    ]
    return F.round(sum(parts[1:], parts[0]), 4)


_COMPARED = ("accessibility_id", "text", "element_type", "resource_id", "clickable")


def own_claims(elements: DataFrame, version: str) -> DataFrame:
    """The best locator of each element of a build, as a claim with its place as the role."""
    chosen = best(candidates(elements.where(F.col("app_version") == version))).where("strategy IS NOT NULL")
    return chosen.select("app_id", "screen_id", F.col("doc_pos").cast("string").alias("role"), "strategy", "value")


def healed(claims: DataFrame, elements: DataFrame, before: str, after: str) -> DataFrame:
    """Claimed locators (app_id, screen_id, role, strategy, value) of screens that both builds
    captured, and what became of them in the later one (L12): fine, ambiguous, not_in_baseline,
    repaired (to review if the strategy is weaker), or unrepairable, with the repair's confidence.

    Claims meet elements by keys. A lost one's element is compared with those of the later build
    that share its accessibility id or its plain text, as nothing else reaches the confidence that
    a repair needs.
    """
    of = lambda v: elements.where(F.col("app_version") == v)
    claim = ["app_id", "screen_id", "role", "strategy", "value"]
    both = of(before).select("app_id", "screen_id").distinct().join(of(after).select("app_id", "screen_id").distinct(), ["app_id", "screen_id"])
    asked = claims.join(both, ["app_id", "screen_id"], "left_semi")
    was = locator_matches(asked, of(before)).select(*claim, F.col("at").alias("a_doc_pos"))
    rows = locator_matches(asked, of(after)).drop("at").join(was, claim)
    text = F.concat(F.lit("text:"), plain_text(F.coalesce("text", F.lit(""))))
    named = F.when(F.coalesce("accessibility_id", F.lit("")) != "", F.concat(F.lit("id:"), "accessibility_id"))
    told = F.when(F.coalesce("text", F.lit("")) != "", text)

    def side(v: str, p: str, marks: Column) -> DataFrame:
        return of(v).select("app_id", "screen_id", F.col("doc_pos").alias(f"{p}doc_pos"), *[F.col(c).alias(f"{p}{c}") for c in _COMPARED], F.explode(F.array_compact(marks)).alias("mark"))

    lost = rows.where("found = 0 AND a_doc_pos IS NOT NULL").select("app_id", "screen_id", "a_doc_pos").distinct()
    met = lost.join(side(before, "a_", F.array(named, told)), ["app_id", "screen_id", "a_doc_pos"]).join(side(after, "b_", F.array(named, text)), ["app_id", "screen_id", "mark"])
    scored = met.dropDuplicates(["app_id", "screen_id", "a_doc_pos", "b_doc_pos"]).withColumn("confidence", element_similarity("a_", "b_")).where(F.col("confidence") >= MIN_REPAIR)
    top = scored.groupBy("app_id", "screen_id", "a_doc_pos").agg(F.max_by(F.struct("b_doc_pos", "confidence"), F.struct("confidence", -F.col("b_doc_pos"))).alias("t")).select("app_id", "screen_id", "a_doc_pos", "t.*")
    chosen = best(candidates(of(after))).where("strategy IS NOT NULL")
    repair = chosen.select("app_id", "screen_id", F.col("doc_pos").alias("b_doc_pos"), F.col("strategy").alias("new_strategy"), F.col("value").alias("new_value"))
    out = rows.join(top.join(repair, ["app_id", "screen_id", "b_doc_pos"], "left"), ["app_id", "screen_id", "a_doc_pos"], "left")
    level = F.create_map(*[F.lit(x) for item in STABILITY.items() for x in item])
    weaker = level[F.col("new_strategy")] < level[F.col("strategy")]
    status = F.when(F.col("found") == 1, "fine").when(F.col("found") > 1, "ambiguous").when(F.col("a_doc_pos").isNull(), "not_in_baseline").when(F.col("new_value").isNull(), "unrepairable").when(weaker, "review").otherwise("repaired")
    out = out.withColumn("status", status)
    lost = F.col("found") == 0
    return out.select(*claim, "found", "status", *[F.when(lost, F.col(c)).alias(c) for c in ("new_strategy", "new_value", "confidence")])


def survival(healed_rows: DataFrame) -> DataFrame:
    """How each strategy's locators came through, and all together (L13): what has no repair is
    ``n_unrepairable``, ambiguous ones and those unknown to the baseline too."""
    count = lambda *names: F.count_if(F.col("status").isin(*names))
    figures = [
        F.count("*").alias("n"), F.round(count("fine") * 100 / F.count("*"), 1).alias("survived_pct"), count("repaired").alias("n_repaired"), count("review").alias("n_review"),
        count("unrepairable", "ambiguous", "not_in_baseline").alias("n_unrepairable"),
    ]
    total = healed_rows.groupBy("app_id").agg(*figures).withColumn("strategy", F.lit("(all)"))
    return healed_rows.groupBy("app_id", "strategy").agg(*figures).unionByName(total)
