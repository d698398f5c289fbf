"""Coverage of production transitions and journeys by a test suite.

``refs``: (app_id, test_id, screen_id, confidence, line, ord). ``tests``: (app_id, test_id,
language, file_path). ``edges``: production transitions with weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.functions.parsing import suite_strategy
from trailmark.operators.graph import transitions

#: Sets of pairs of tests that one task of a pair takes.
MET_AT_ONCE = 1000


def test_paths(refs: DataFrame) -> DataFrame:
    """(app_id, test_id, path): sure references in order, repetitions collapsed (G1)."""
    by_place = W.partitionBy("app_id", "test_id").orderBy("line", "ord")
    sure = refs.where("confidence <> 'low'").withColumn("before", F.lag("screen_id").over(by_place))
    kept = sure.where("before IS NULL OR before <> screen_id")
    step = F.struct("line", "ord", "screen_id")
    return kept.groupBy("app_id", "test_id").agg(F.transform(F.array_sort(F.collect_list(step)), lambda x: x["screen_id"]).alias("path"))


def test_facts(refs: DataFrame, assertions: DataFrame) -> DataFrame:
    """Screens that a test covers, asserts and only may touch, and its weakest confidence (G1)."""
    level = F.when(F.col("confidence") == "low", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    walked = refs.groupBy("app_id", "test_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("confidence") != "low", F.col("screen_id")))).alias("covered"),
        F.array_sort(F.collect_set(F.when(F.col("confidence") == "low", F.col("screen_id")))).alias("uncertain"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.min(level) + 1).alias("weakest"),
    )
    asserted = assertions.groupBy("app_id", "test_id").agg(F.array_sort(F.collect_set("screen_id")).alias("asserted"))
    return walked.join(asserted, ["app_id", "test_id"], "left").withColumn("asserted", F.coalesce("asserted", F.array().cast("array<string>")))


def tested_transitions(paths: DataFrame) -> DataFrame:
    """(app_id, source, target, test_id), each once."""
    return transitions(paths, "app_id", "test_id").select("app_id", "source", "target", "test_id").distinct()


def transition_coverage(edges: DataFrame, tested: DataFrame) -> DataFrame:
    """Production transitions with their covering tests."""
    by_edge = tested.groupBy("app_id", "source", "target").agg(F.count("*").alias("n_tests"))
    return edges.join(by_edge, ["app_id", "source", "target"], "left").na.fill(0, ["n_tests"])


def journey_coverage(journeys: DataFrame, tested: DataFrame) -> DataFrame:
    """(app_id, journey_id, n_pairs, n_covered, coverage, missing) of each representative path;
    repeated pairs count again (J5). ``journeys``: (app_id, journey_id, path)."""
    pairs = transitions(journeys, "app_id", "journey_id")
    walked = tested.select("app_id", "source", "target").distinct().withColumn("seen", F.lit(1))
    seen = pairs.join(walked, ["app_id", "source", "target"], "left")
    label = F.struct("position", F.concat_ws(" > ", "source", "target").alias("pair"))
    return seen.groupBy("app_id", "journey_id").agg(
        F.count("*").alias("n_pairs"),
        F.count("seen").alias("n_covered"),
        (F.count("seen") / F.count("*")).alias("coverage"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("seen").isNull(), label))), lambda x: x["pair"]).alias("missing"),
    )


def covering_tests(journeys: DataFrame, tested: DataFrame) -> DataFrame:
    """(app_id, journey_id, test_id), each once: the tests that walk a pair of a journey."""
    pairs = transitions(journeys, "app_id", "journey_id").select("app_id", "journey_id", "source", "target").distinct()
    return pairs.join(tested, ["app_id", "source", "target"]).select("app_id", "journey_id", "test_id").distinct()


def _pair_sets(pairs: DataFrame, name: str) -> DataFrame:
    """(app_id, name, held): the set of pairs of each journey or test, in order."""
    return pairs.groupBy("app_id", name).agg(F.array_sort(F.collect_set(F.struct("source", "target"))).alias("held"))


def covering_counts(journeys: DataFrame, tested: DataFrame, met_at_once: int = MET_AT_ONCE) -> DataFrame:
    """(app_id, journey_id, n_tests): how many rows of ``covering_tests`` a journey has, if any.

    Journeys and tests that walk the same set of pairs are one, with their number, and sets meet at
    the first pair they share, so a meeting is summed up where it is found and never a row of an
    exchange. The tests' sets of a pair are dealt out by salt, to which those of the journeys are copied.
    """
    by_journey = _pair_sets(transitions(journeys, "app_id", "journey_id"), "journey_id").withColumnRenamed("held", "mine")
    wanted = by_journey.select("app_id", "mine").distinct()
    sets = _pair_sets(tested, "test_id").groupBy("app_id", "held").agg(F.count("*").alias("n"))
    theirs = sets.select("app_id", "held", "n", F.explode("held").alias("pair"))
    salts = theirs.groupBy("app_id", "pair").agg(F.ceil(F.count("*") / met_at_once).alias("salts"))
    theirs = theirs.join(salts, ["app_id", "pair"]).withColumn("salt", F.pmod(F.xxhash64("held"), "salts")).drop("salts")
    mine = wanted.select("app_id", "mine", F.explode("mine").alias("pair")).join(salts, ["app_id", "pair"])
    mine = mine.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    met = mine.join(theirs, ["app_id", "pair", "salt"]).where(F.array_min(F.array_intersect("mine", "held")) == F.col("pair"))
    counts = met.groupBy("app_id", "mine").agg(F.sum("n").alias("n_tests"))
    return by_journey.join(counts, ["app_id", "mine"]).select("app_id", "journey_id", "n_tests")


def summary(transition_rows: DataFrame, journey_rows: DataFrame, tests: DataFrame, paths: DataFrame) -> DataFrame:
    """Transitions covered, plain and by traffic; journeys covered in full or not; unmapped tests."""
    hit = F.col("n_tests") > 0
    a = transition_rows.groupBy("app_id").agg(
        F.count("*").alias("n_transitions"), F.count_if(hit).alias("n_covered"), (F.count_if(hit) * 100 / F.count("*")).alias("covered_pct"), F.coalesce(F.try_divide(F.sum(F.when(hit, F.col("weight")).otherwise(0)) * 100, F.sum("weight")), F.lit(0.0)).alias("weighted_pct")
    )
    b = journey_rows.groupBy("app_id").agg(F.count_if(F.col("coverage") == 1).alias("journeys_full"), F.count_if(F.col("coverage") == 0).alias("journeys_none"))
    mapped = paths.select("app_id", "test_id")
    c = tests.join(mapped, ["app_id", "test_id"], "left_anti").groupBy("app_id").agg(F.count("*").alias("unmapped_tests"))
    return a.join(b, "app_id", "left").join(c, "app_id", "left").na.fill(0)


def screen_tests(facts: DataFrame) -> DataFrame:
    """The tests that touch each screen (G3); ``facts`` as of ``test_facts``."""
    touched = facts.select("app_id", "test_id", F.explode("covered").alias("screen_id"))
    return touched.groupBy("app_id", "screen_id").agg(F.count("*").alias("n_tests"), F.array_sort(F.collect_set("test_id")).alias("tests"))


def redundancy(tested: DataFrame) -> DataFrame:
    """How many tests walk each tested transition."""
    return tested.groupBy("app_id", "source", "target").agg(F.count("*").alias("n_tests"))


def suite_quality(files: DataFrame, page_objects: DataFrame, locators: DataFrame) -> DataFrame:
    """Files scanned and the share that parsed, page objects and bound ones, and the locators by
    strategy, as (app_id, measure, label, value) (G2).

    ``files``: (app_id, file, parsed); ``page_objects``: (app_id, page_object, screen_id, null if it
    isn't bound); ``locators``: (app_id, value).
    """
    one = lambda rows, measure, label, value: rows.agg(value.cast("double").alias("value")).select("app_id", F.lit(measure).alias("measure"), label.alias("label"), "value")
    by_file, by_object = files.groupBy("app_id"), page_objects.groupBy("app_id")
    mix = locators.groupBy("app_id", suite_strategy(F.col("value")).alias("strategy"))
    parts = [
        one(by_file, "files", F.lit("scanned"), F.count("*")),
        one(by_file, "files", F.lit("parse_rate_pct"), F.round(F.count_if("parsed") * 100 / F.count("*"), 1)),
        one(by_object, "page_objects", F.lit("all"), F.count("*")),
        one(by_object, "page_objects", F.lit("bound"), F.count("screen_id")),
        one(mix, "locators", F.col("strategy"), F.count("*")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def suite_summary(tests: DataFrame, paths: DataFrame, refs: DataFrame) -> DataFrame:
    """Tests, mapped ones, by language, and references by confidence, as (app_id, measure, label, n)."""
    mapped = tests.join(paths.select("app_id", "test_id"), ["app_id", "test_id"], "left_semi")
    parts = [
        tests.groupBy("app_id").agg(F.count("*").alias("n")).select("app_id", F.lit("tests").alias("measure"), F.lit("all").alias("label"), "n"),
        mapped.groupBy("app_id").agg(F.count("*").alias("n")).select("app_id", F.lit("tests").alias("measure"), F.lit("mapped").alias("label"), "n"),
        tests.groupBy("app_id", "language").agg(F.count("*").alias("n")).select("app_id", F.lit("language").alias("measure"), F.col("language").alias("label"), "n"),
        refs.groupBy("app_id", "confidence").agg(F.count("*").alias("n")).select("app_id", F.lit("confidence").alias("measure"), F.col("confidence").alias("label"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
