"""Mixing sources to target weights by Poisson replication.

Each source gets a repetition rate, its target share of the output divided by its share of the
input. Each document is repeated as often as the Poisson distribution with that rate says at a
point that a hash of doc_id and seed picks (the distribution function is inverted), so a run is
reproducible on any cluster and needs no coordination. Copies are then dealt out and ordered by
another hash, a global shuffle. Only DataFrame functions run here.

Shares are of UTF-8 bytes. Without given weights a source weighs the square root of its bytes,
which lifts small sources. The table of sources is broadcast up to ``MOST_SOURCES`` of them and
joined by shuffle beyond.

Defined results: rows with a null source are a source of their own; a null text has no bytes; a
source without bytes, or not among given weights, has rate zero; rows that repeat a doc_id are
repeated alike; a null doc_id is hashed as an empty string; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.shared import cut, let

SEED = "mix-1"
MOST_SOURCES = 10_000
#: A larger rate is a sum of several draws of at most this one, as exp(-rate) must not vanish.
MOST_RATE = 500


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(source, n_docs, n_bytes, weight, rate) of each source; the output has ``epochs`` x the input bytes."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return rates_of(docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(size).alias("n_bytes")), weights, epochs)


def rates_of(stats: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """The rates of sources (source, n_docs, n_bytes); products of weights and bytes don't fit a long."""
    if weights is None:
        weight = F.round(F.sqrt("n_bytes") * 1000)
    else:
        known = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, round(v * 1_000_000))])
        weight = F.when(F.col("n_bytes") > 0, F.coalesce(known[F.coalesce("source", F.lit(""))], F.lit(0))).otherwise(0)
    stats = stats.withColumn("weight", weight.cast("long"))
    total = stats.agg(F.sum("n_bytes").alias("all_bytes"), F.sum("weight").alias("all_weight"))
    weight, all_bytes, all_weight, n_bytes = (F.col(c).cast("decimal(20,0)") for c in ("weight", "all_bytes", "all_weight", "n_bytes"))
    rate = (weight * all_bytes).cast("double") * F.lit(float(epochs)) / (all_weight * n_bytes).cast("double")
    live = (F.col("n_bytes") > 0) & (F.col("all_weight") > 0)
    return stats.join(F.broadcast(total)).select("source", "n_docs", "n_bytes", "weight", F.when(live, rate).otherwise(F.lit(0.0)).alias("rate"))


def _steps(rate: Column) -> Column:
    """The Poisson distribution function at 0, 1, 2, ... up to where it is 1 in double precision."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 25).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def add(state, k):
        p = state["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, add, lambda s: s["cdf"])


def _uniform(*parts: Column) -> Column:
    """A number from 0 to 1 (52 bits) from a hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """``docs`` as a struct column ``row``, once for each copy, with doc_id, source, copies (of
    the document), copy (from 1) and shuffle_key, in the order of shuffle_key."""
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_RATE)).cast("int")
    table = cut(rates(docs, weights, epochs).where("rate > 0"), "rates")
    table = table.select(F.col("source").alias("of_source"), draws.alias("draws"), _steps(F.col("rate") / draws).alias("steps"))
    if table.count() <= MOST_SOURCES:
        table = F.broadcast(table)
    key = F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))

    def drawn(acc, j):
        return acc + let(_uniform(F.lit(seed), key, j.cast("string")), lambda u: F.size(F.filter("steps", lambda c: c < u)))

    rows = docs.select(F.struct("*").alias("row")).join(table, F.col("row.source").eqNullSafe(F.col("of_source")))
    counted = rows.select("row", F.aggregate(F.sequence(F.lit(1), F.col("draws")), F.lit(0), drawn).alias("copies")).where("copies > 0")
    copies = counted.select("row", F.col("copies").cast("long").alias("copies"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))).alias("copy"))
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), key, F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    keyed = copies.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "copies", "copy", place.alias("shuffle_key"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The documents repeated to their sources' target weights and shuffled, with their own columns."""
    return replicate(docs, **parameters).select("row.*")
