"""Clustering of variants into archetypes, their scores and names.

The clustering is the sequential one: variants by falling count, each joins the most similar
earlier seed or becomes a seed. Its seeds are the first maximal independent set of the graph of
similar pairs, so they are found in rounds over all variants at once: a variant with an earlier
seed beside it is a member; one whose earlier neighbours are all members is a seed. Each round is
a table in the shared folder, and the rounds end as the first undecided variant always decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.functions.cutting import cut
from trailmark.functions.ranking import numbered, with_totals
from trailmark.functions.sequences import common_backbone, position_masks, similarity

THRESHOLD = 0.65
#: Listed variants of one token and length that meet in one task.
MET_AT_ONCE = 1000
#: Members of an archetype that one round of the fold takes.
FOLDED_AT_ONCE = 64
OPEN = "(open)"
# Markers of a path's outcome by its last screen, tried in this order.
OUTCOMES = {
    "failed": ("failure", "error", "declined", "rejected"),
    "completed": ("confirmation", "success", "complete", "thank"),
    "abandoned": ("cart", "payment_method", "delivery_address", "order_review", "checkout"),
}
WEIGHTS = {"frequency": 0.30, "business_value": 0.30, "risk": 0.25, "exposure": 0.15}


def ranked(variant_rows: DataFrame, critical: list[str]) -> DataFrame:
    """Variants with rank, and ``ends``: a critical last screen, or a mark that all others share.
    Variants may merge just if their ends are equal (C4)."""
    last = F.element_at("path", -1)
    ends = F.when(last.isin(critical), last).otherwise(F.lit(OPEN)) if critical else F.lit(OPEN)
    rows = numbered(variant_rows, ["app_id"], [F.desc("n_sessions"), "path"], "rank")
    return rows.withColumns({"ends": ends, "masks": position_masks(F.col("path"))})


def _tokens(path: Column) -> Column:
    """Each screen with its number of earlier occurrences, so that a bag becomes a set."""
    earlier = F.transform(path, lambda s, i: F.struct(s.alias("s"), F.size(F.filter(F.slice(path, 1, i), lambda x: x == s)).alias("n")))
    return F.transform(earlier, lambda x: F.concat_ws("#", x["s"], x["n"].cast("string")))


def pairs(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(app_id, i, j, sim) of pairs i < j that may merge and reach the threshold.

    Similar paths share screens: with the tokens of a path in a fixed order, rare ones first, two
    paths that reach the threshold share one among the first n - ceil(t n) + 1 of each (prefix
    filter), so candidates meet in an equi-join and none is lost. They meet by length class too,
    where a pair's classes are equal or neighbours, and what follows a shared token must leave room for
    the overlap they need. The variants of a frequent token are dealt out by salt on one side and
    copied to the salts on the other, so no task gets all of its pairs.

    Only the first token that two prefixes share counts, where their paths are compared at once: a
    candidate is never a row of an exchange, and a task holds the listed paths of a token, not the pairs.
    """
    t = F.lit(threshold)
    tokens = rows.select("app_id", "rank", F.size("path").alias("n"), F.explode(_tokens(F.col("path"))).alias("token"))
    often = tokens.groupBy("app_id", "token").agg(F.count("*").alias("c"))
    rare = F.transform(F.array_sort(F.collect_list(F.struct("c", "token"))), lambda x: x["token"])
    prefixes = tokens.join(often, ["app_id", "token"]).groupBy("app_id", "rank", "n").agg(rare.alias("tokens"))
    prefixes = prefixes.withColumn("tokens", F.slice("tokens", F.lit(1), (F.col("n") - F.ceil(F.col("n") * t) + 1).cast("int")))
    # Rounded down after a small step, so that lengths in the ratio of the threshold never lie two classes apart.
    prefixes = prefixes.withColumn("class", F.floor(F.ln("n") / -F.ln(t) + F.lit(1e-9)))
    listed = rows.join(prefixes, ["app_id", "rank"]).select("app_id", "ends", "class", "rank", "n", "path", "masks", "tokens", F.posexplode("tokens").alias("before", "token"))
    listed = cut(listed.withColumn("tokens", F.slice("tokens", F.lit(1), F.col("before"))), "listed")
    key = ["app_id", "ends", "token", "class"]
    crowds = listed.groupBy(*key).agg(F.ceil(F.count("*") / MET_AT_ONCE).alias("salts"))
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("n", "before", "tokens", "path")]
    a = listed.join(crowds, key).select(*key, F.pmod(F.xxhash64("rank"), "salts").alias("salt"), F.col("rank").alias("i"), F.col("masks").alias("masks_i"), *side("i"))
    # A given number of partitions, as few bytes make many pairs and adaptive execution would join them in one task.
    a = a.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key, "salt")
    near_classes = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.col("class") + d)).alias("class")
    b = listed.select("app_id", "ends", "token", near_classes, F.col("rank").alias("j"), *side("j")).join(crowds, key)
    b = b.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    # The shared token itself and what follows it in both.
    room = F.least(F.col("n_i") - F.col("before_i"), F.col("n_j") - F.col("before_j"))
    near = (F.least("n_i", "n_j") >= t * F.greatest("n_i", "n_j")) & (room >= t * F.greatest("n_i", "n_j"))
    met = a.join(b, [*key, "salt"]).where((F.col("i") < F.col("j")) & near & ~F.arrays_overlap("tokens_i", "tokens_j"))
    # In a generator, so that a similarity is computed once for its value and its test.
    scored = F.struct("app_id", "i", "j", similarity(F.col("path_j"), F.col("path_i"), F.col("masks_i")).alias("sim"))
    return met.select(F.inline(F.array(scored))).where(F.col("sim") >= threshold)


def seeds(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(app_id, rank) of the seeds of the sequential clustering."""
    state = cut(rows.select("app_id", "rank", F.lit("open").alias("status")), "seeds")
    while not state.where("status = 'open'").isEmpty():
        earlier = links.join(state.select("app_id", F.col("rank").alias("i"), F.col("status").alias("of")), ["app_id", "i"])
        seen = earlier.groupBy("app_id", F.col("j").alias("rank")).agg(F.bool_or(F.col("of") == "seed").alias("by_seed"), F.bool_and(F.col("of") == "member").alias("all_members"))
        status = F.when(F.col("status") != "open", F.col("status")).when(F.col("by_seed"), "member").when(F.coalesce("all_members", F.lit(True)), "seed").otherwise("open")
        state = cut(state.join(seen, ["app_id", "rank"], "left").select("app_id", "rank", status.alias("status")), "seeds")
    return state.where("status = 'seed'").select("app_id", "rank")


def members(variant_rows: DataFrame, critical: list[str] = (), threshold: float = THRESHOLD, most: int | None = None) -> DataFrame:
    """Variants with ``seed``, the rank of their archetype's seed.

    With ``most``, variants after that many seeds join the nearest seed whose ends are equal
    however unlike it is (C5); without one they still become seeds.
    """
    rows = cut(ranked(variant_rows, list(critical)), "ranked")
    links = cut(pairs(rows, threshold), "similar")
    chosen = seeds(rows, links)
    best = F.max_by("i", F.struct("sim", -F.col("i"))).alias("seed")
    joined = links.join(chosen.withColumnRenamed("rank", "i"), ["app_id", "i"]).groupBy("app_id", F.col("j").alias("rank")).agg(best)
    if most is not None:
        nth = chosen.withColumn("nth", F.row_number().over(W.partitionBy("app_id").orderBy("rank"))).where(F.col("nth") == most)
        late = rows.join(nth.select("app_id", F.col("rank").alias("full_at")), "app_id").where(F.col("rank") > F.col("full_at"))
        early = chosen.join(rows, ["app_id", "rank"]).join(nth.select("app_id", F.col("rank").alias("full_at")), "app_id").where(F.col("rank") <= F.col("full_at"))
        opening = late.join(early, ["app_id", "ends"], "left_anti").groupBy("app_id", "ends").agg(F.min("rank").alias("rank"))
        held = early.select("app_id", "ends", "rank").union(opening.select("app_id", "ends", "rank"))
        held = held.join(rows.select("app_id", "rank", F.col("path").alias("path_i"), F.col("masks").alias("masks_i")), ["app_id", "rank"]).withColumnRenamed("rank", "i")
        near = late.join(held, ["app_id", "ends"]).where(F.col("i") < F.col("rank")).withColumn("sim", similarity(F.col("path"), F.col("path_i"), F.col("masks_i")))
        placed = near.groupBy("app_id", "rank").agg(best)
        joined = joined.join(late, ["app_id", "rank"], "left_anti").unionByName(placed)
        chosen = chosen.join(late, ["app_id", "rank"], "left_anti").unionByName(opening.select("app_id", "rank"))
    own = joined.join(chosen, ["app_id", "rank"], "left_anti").unionByName(chosen.select("app_id", "rank", F.col("rank").alias("seed")))
    return rows.join(own, ["app_id", "rank"]).drop("masks")


def archetypes(member_rows: DataFrame) -> DataFrame:
    """One row for each archetype: sessions, users (summed over variants, so a user can count
    twice, as the reports define it), variants, mean duration, the seed's path, screens,
    backbone, id (by falling sessions, then creation)."""
    key = ["app_id", "seed"]
    grouped = member_rows.groupBy(*key).agg(
        F.sum("n_sessions").alias("n_sessions"),
        F.sum("n_users").alias("n_users"),
        F.count("*").alias("n_variants"),
        (F.sum("total_us") / F.sum("n_sessions") / 1e6).alias("mean_duration_s"),
        F.min_by("path", "rank").alias("representative"),
    )
    seen = member_rows.select(*key, F.explode("path").alias("screen")).groupBy(*key).agg(F.array_sort(F.collect_set("screen")).alias("screens"))
    rows = numbered(grouped.join(seen, key), ["app_id"], [F.desc("n_sessions"), "seed"], "nth")
    named_ = rows.withColumn("archetype_id", F.format_string("aj_%03d", "nth")).drop("nth")
    return named_.join(backbones(member_rows), key)


def backbones(member_rows: DataFrame, at_once: int = FOLDED_AT_ONCE) -> DataFrame:
    """(app_id, seed, backbone): the members' common backbone, folded in the order of their ranks.

    Each round takes the next ``at_once`` members of every archetype whose backbone isn't empty yet,
    so no row holds all paths of an archetype, and most archetypes end early.
    """
    key = ["app_id", "seed"]
    rows = cut(numbered(member_rows.select(*key, "rank", "path"), key, ["rank"], "nth"), "members")
    state, done = cut(rows.where("nth = 1").select(*key, F.col("path").alias("backbone")), "backbones"), None
    first = 2
    while True:
        part = rows.where(F.col("nth").between(first, first + at_once - 1)).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "path"))), lambda x: x["path"]).alias("paths"))
        joined = state.join(part, key, "left")
        ended = F.col("paths").isNull() | (F.size("backbone") == 0)
        ready = joined.where(ended).select(*key, "backbone")
        done = ready if done is None else done.union(ready)
        going = joined.where(~ended).select(*key, common_backbone(F.concat(F.array("backbone"), "paths")).alias("backbone"))
        state, first = cut(going, "backbones"), first + at_once
        if state.isEmpty():
            return done


def compression(archetype_rows: DataFrame, target_pct: float = 95.0, top: int = 10) -> DataFrame:
    """Variants for each archetype, archetypes that reach a share, share of the top ones."""
    shared = with_totals(archetype_rows, ["app_id"], total=F.sum("n_sessions")).withColumn("share", F.round(F.col("n_sessions") * 100 / F.col("total"), 2))
    # Shares have two places, so their sums are exact as decimals.
    curve = numbered(shared, ["app_id"], [F.desc("n_sessions"), "archetype_id"], "nth", {"reached": F.col("share").cast("decimal(10,2)")})
    return curve.groupBy("app_id").agg(
        (F.sum("n_variants") / F.count("*")).alias("compression"),
        F.count("*").alias("n_archetypes"),
        F.min(F.when(F.col("reached") >= target_pct, F.col("nth"))).alias("n_needed"),
        F.sum(F.when(F.col("nth") <= top, F.col("share"))).alias("top_pct"),
    )


def scores(archetype_rows: DataFrame, risk_by_screen: DataFrame, monetary: DataFrame, screens: DataFrame, coverage: DataFrame | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Score components from 0 to 1, their weighted sum x 100, and the rank.

    ``monetary``: (app_id, archetype_id, monetary); ``screens``: (app_id, screen_id, value,
    critical); ``coverage``: (app_id, archetype_id, coverage), missing ones count as untested;
    ``weights``: one column for each component by app_id, the default elsewhere.
    """
    walked = archetype_rows.select("app_id", "archetype_id", F.explode("screens").alias("screen_id"))
    by_screen = walked.join(risk_by_screen, ["app_id", "screen_id"], "left").join(screens, ["app_id", "screen_id"], "left")
    facts = by_screen.groupBy("app_id", "archetype_id").agg(
        F.coalesce(F.sum("n_signals"), F.lit(0)).alias("signals"), F.coalesce(F.max("value"), F.lit(0.0)).alias("value"), F.coalesce(F.bool_or("critical"), F.lit(False)).alias("critical")
    )
    rows = archetype_rows.join(facts, ["app_id", "archetype_id"]).join(monetary, ["app_id", "archetype_id"], "left")
    if coverage is not None:
        rows = rows.join(coverage, ["app_id", "archetype_id"], "left")
    else:
        rows = rows.withColumn("coverage", F.lit(None).cast("double"))

    money = F.coalesce(F.col("monetary").cast("double"), F.lit(0.0))
    measured = {"frequency": F.ln(F.lit(1) + F.col("n_sessions")), "risk": F.col("signals").cast("double"), "business_value": money}
    rows = with_totals(rows, ["app_id"], **{f"most_{c}": F.max(x) for c, x in measured.items()})
    relative = {c: F.coalesce(F.try_divide(x, F.col(f"most_{c}")), F.lit(0.0)) for c, x in measured.items()}
    screen_value = F.least(F.lit(1.0), F.col("value") + F.when(F.col("critical"), 0.5).otherwise(0.0))
    relative["business_value"] = F.greatest(relative["business_value"], screen_value)
    rows = rows.withColumns(relative | {"exposure": 1 - F.coalesce("coverage", F.lit(0.0))}).drop(*[f"most_{c}" for c in measured])
    own = {c: F.lit(w) for c, w in WEIGHTS.items()}
    if weights is not None:
        rows = rows.join(weights.select("app_id", *[F.col(c).alias(f"w_{c}") for c in WEIGHTS]), "app_id", "left")
        own = {c: F.coalesce(f"w_{c}", F.lit(w)) for c, w in WEIGHTS.items()}
    total = sum(own.values(), F.lit(0.0))
    score = sum((F.col(c) * w / total for c, w in own.items()), F.lit(0.0)) * 100
    rows = rows.withColumn("score", score).drop(*[f"w_{c}" for c in WEIGHTS])
    return numbered(rows, ["app_id"], [F.desc("score"), "archetype_id"], "rank")


def outcome(path: Column) -> Column:
    """completed, failed, abandoned or exploratory, by markers in the last screen."""
    last = F.lower(F.element_at(path, -1))
    value = F.lit("exploratory")
    for name, markers in reversed(OUTCOMES.items()):
        value = F.when(last.rlike("|".join(markers)), name).otherwise(value)
    return value


def named(rows: DataFrame, screens: DataFrame) -> DataFrame:
    """Rows with ``representative`` get outcome, name, and the domains they span (three at most)."""
    ends = screens.select("app_id", "screen_id", "display_name", "domain")
    walked = rows.select("app_id", "archetype_id", F.posexplode("representative").alias("at", "screen_id")).join(ends, ["app_id", "screen_id"], "left")
    title = F.coalesce("display_name", F.initcap(F.regexp_replace("screen_id", "_", " ")))
    facts = walked.groupBy("app_id", "archetype_id").agg(
        F.min_by(title, "at").alias("first_name"),
        F.max_by(title, "at").alias("last_name"),
        F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("domain").isNotNull(), F.struct("at", "domain")))), lambda x: x["domain"])), 1, 3).alias("domains"),
    )
    joined = rows.join(facts, ["app_id", "archetype_id"]).withColumn("outcome", outcome(F.col("representative")))
    return joined.withColumn("name", F.concat("first_name", F.lit(" to "), "last_name", F.lit(" ("), "outcome", F.lit(")")))


def catalogue(scored: DataFrame) -> DataFrame:
    """The journey catalogue (K11), a row for each scored and named archetype."""
    money = F.coalesce(F.col("monetary").cast("double"), F.lit(0.0))
    return with_totals(scored, ["app_id"], total=F.sum("n_sessions")).select(
        "app_id", F.col("archetype_id").alias("journey_id"), "rank", "name", F.round("score", 2).alias("score"), F.col("representative").alias("sequence"), "backbone", F.col("n_sessions").alias("sessions"),
        F.round(F.col("n_sessions") * 100 / F.col("total"), 2).alias("session_share_pct"), F.col("n_users").alias("users"), F.col("n_variants").alias("variants"), "mean_duration_s", F.round(money, 2).alias("monetary_total"),
        F.col("signals").alias("risk_events"), F.struct(*[F.round(c, 4).alias(c) for c in WEIGHTS]).alias("components"), "terminal_screens",
    )


def terminal_screens(member_rows: DataFrame) -> DataFrame:
    """(app_id, seed, terminal_screens): last screens of an archetype's variants with their sessions,
    most first."""
    ends = member_rows.groupBy("app_id", "seed", F.element_at("path", -1).alias("screen_id")).agg(F.sum("n_sessions").alias("n"))
    falling = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "screen_id", "n")))
    return ends.groupBy("app_id", "seed").agg(F.transform(falling, lambda x: F.struct(x["screen_id"].alias("screen_id"), x["n"].alias("n_sessions"))).alias("terminal_screens"))


def save_catalogue(rows: DataFrame, path: str) -> None:
    """Write a catalogue as JSON lines by app, in place of what these apps had."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False).partitionBy("app_id").json(path)
