"""Source divergence audit: how the sources of a language differ in their words, ranked by cells.

A word's share in a group depends only on how often it occurs there, and its divergence from
another group only on the two counts. So words are counted once, grouped into cells of equal
counts, and the divergence is evaluated for each cell instead of each word. For the list of a
group's words, cells with equal values are merged, ranked by cumulated multiplicity, and only the
words of the cells that reach the list are expanded. A pair of sources adds up cells of words that
both have, and corrects the sums of the one-sided cells, which need no join of words.

All arithmetic is on integers; products that pass 63 bits are decimals.

Defined results: null texts, languages and sources are empty strings; each row is a document,
repeated ones too; a language without kept words has pairs of value 0 and no words; an empty table
gives an empty result; other columns are ignored. Ties are ordered by UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.llm.shared import cut

#: Over UTF-8 bytes, of which ``bytes.lower`` changes A to Z only.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Words that a task holds before it gives out its counts.
MOST_HELD = 300_000
LEAST_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
GROUP = ("lang", "source")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", *GROUP)])


def share(count: str, denominator: str) -> Column:
    """1 + floor(SCALE * (count + 1) / denominator), exact."""
    return F.expr(f"1 + CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + 1 AS DECIMAL(19, 0)) div CAST({denominator} AS DECIMAL(19, 0))")


def divergence(p: str, q: str) -> Column:
    """floor((p - q)^2 / q); both are at most SCALE + 1, so the square is a long."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, n_docs): a task's words with their occurrences and documents, given
    out whenever ``MOST_HELD`` of them are held."""
    names = ["lang", "source", "term", "n", "n_docs"]
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def given():
        for (lang, source), (n, n_docs) in held.items():
            size = len(n)
            columns = pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([n_docs[t] for t in n], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns), names)
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, n_docs = held.setdefault((lang, source), (Counter(), Counter()))
            found = Counter(TERM.findall(text.lower()))
            n.update(found)
            n_docs.update(found.keys())
        if sum(len(n) for n, _ in held.values()) > MOST_HELD:
            yield from given()
    yield from given()


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, lang_n, sources): the words of at least ``least_docs`` documents of a language,
    with their occurrences in it and, as a sorted array, in each source that has them."""
    texts = _plain(docs).select(*GROUP, F.col("text").cast("binary").alias("text"))
    rows = texts.mapInArrow(_counts, "lang string, source string, term binary, n long, n_docs long")
    counted = rows.groupBy(*GROUP, F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    by_term = counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("n_docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("sources"))
    return by_term.where(F.col("n_docs") >= least_docs).drop("n_docs")


def groups(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Each occurring (lang, source) with n_kept (the language's words), n_held (those that the
    source has), and the denominators of its own shares and of the language's."""
    langs = terms.groupBy("lang").agg(F.count("*").alias("n_kept"), F.sum("lang_n").alias("lang_total"))
    held = terms.select("lang", F.explode("sources").alias("s")).groupBy("lang", F.col("s.source").alias("source")).agg(F.count("*").alias("n_held"), F.sum("s.n").alias("total"))
    found = _plain(docs).select(*GROUP).distinct().join(langs, "lang", "left").join(held, list(GROUP), "left").na.fill(0)
    return found.select(*GROUP, "n_kept", "n_held", (F.col("total") + F.col("n_kept")).alias("den"), (F.col("lang_total") + F.col("n_kept")).alias("lang_den"))


def pair_values(terms: DataFrame, group_rows: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a language's sources.

    With f(x, y) the value of a word with count x in the source and y in the other, the sum over
    all kept words is that of f(x, 0) over the source's words, f(0, y) over the other's and f(0, 0)
    over as many as are left, corrected by f(x, y) - f(x, 0) - f(0, y) + f(0, 0) over shared words.
    """
    a = group_rows.select("lang", "source", "n_kept", F.col("n_held").alias("held_a"), F.col("den").alias("den_a"))
    b = group_rows.select("lang", F.col("source").alias("item"), F.col("n_held").alias("held_b"), F.col("den").alias("den_b"))
    pairs = a.join(b, "lang").where("source <> item")
    held = terms.select("lang", F.explode("sources").alias("s")).groupBy("lang", F.col("s.source").alias("source"), F.col("s.n").alias("n")).agg(F.count("*").alias("m"))
    first = terms.select("lang", "sources", F.posexplode("sources").alias("at", "s"))
    both = first.select("lang", "s", F.explode(F.expr("slice(sources, at + 2, size(sources))")).alias("t"))
    joint = both.groupBy("lang", F.col("s.source").alias("source"), F.col("t.source").alias("item"), F.col("s.n").alias("x"), F.col("t.n").alias("y")).agg(F.count("*").alias("m"))
    joint = joint.unionByName(joint.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("y").alias("x"), F.col("x").alias("y"), "m"))

    def valued(cells: DataFrame, x: str, y: str) -> DataFrame:
        """Cells with p and q of their counts and of 0."""
        return cells.withColumns({"p": share(x, "den_a"), "q": share(y, "den_b"), "p0": share("0", "den_a"), "q0": share("0", "den_b")})

    def part(cells: DataFrame, value: Column) -> DataFrame:
        exact = F.col("m").cast("decimal(19,0)") * value.cast("decimal(19,0)")
        return cells.groupBy("lang", "source", "item").agg(F.sum(exact).alias("value"))

    key = ["lang", "source"]
    kept = pairs.where("n_kept > 0")
    shared = valued(joint.join(kept, [*key, "item"]), "x", "y")
    mine = valued(kept.join(held.withColumnRenamed("n", "x"), key), "x", "0")
    theirs = valued(kept.join(held.select("lang", F.col("source").alias("item"), F.col("n").alias("y"), "m"), ["lang", "item"]), "0", "y")
    rest = valued(kept.withColumn("m", F.col("n_kept") - F.col("held_a") - F.col("held_b")), "0", "0")
    correction = divergence("p", "q") - divergence("p", "q0") - divergence("p0", "q") + divergence("p0", "q0")
    parts = part(shared, correction)
    for cells in (mine, theirs, rest):
        parts = parts.unionByName(part(cells, divergence("p", "q")))
    none = pairs.select("lang", "source", "item", F.lit(0).cast("decimal(38,0)").alias("value"))
    return parts.unionByName(none).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def top_terms(terms: DataFrame, group_rows: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank) of the ``top`` words that a source has more often than its
    language has."""
    counts = terms.select("lang", "term", "lang_n", F.explode("sources").alias("s")).select("lang", "s.source", "term", "s.n", "lang_n")
    cells = counts.groupBy(*GROUP, "n", "lang_n").agg(F.count("*").alias("m"))
    rated = cells.join(group_rows, list(GROUP)).withColumns({"p": share("n", "den"), "q": share("lang_n", "lang_den")}).where("p > q").withColumn("value", divergence("p", "q"))
    rated = cut(rated.select(*GROUP, "n", "lang_n", "m", "value"), "cells")
    # A value has at least one word, so no list needs more than ``top`` values; the limit acts
    # before the shuffle, and the running sum sees at most ``top`` rows of a group.
    falling = W.partitionBy(*GROUP).orderBy(F.desc("value"))
    values = rated.groupBy(*GROUP, "value").agg(F.sum("m").alias("m")).withColumn("nth", F.row_number().over(falling)).where(F.col("nth") <= top)
    before = F.sum("m").over(falling.rowsBetween(W.unboundedPreceding, 0)) - F.col("m")
    reached = values.withColumn("before", before).where(F.col("before") < top).select(*GROUP, "value")
    chosen = rated.join(reached, [*GROUP, "value"]).select(*GROUP, "n", "lang_n", "value")
    place = F.row_number().over(W.partitionBy(*GROUP).orderBy(F.desc("value"), "term"))
    listed = counts.join(chosen, [*GROUP, "n", "lang_n"]).withColumn("rank", place).where(F.col("rank") <= top)
    return listed.select(*GROUP, F.col("term").alias("item"), "value", "rank")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` compares a source with each other one
    of its language, part ``term`` lists the words it has more often than the language."""
    terms = cut(term_counts(docs, least_docs), "terms")
    group_rows = cut(groups(docs, terms), "groups")
    pairs = pair_values(terms, group_rows).withColumn("rank", F.row_number().over(W.partitionBy(*GROUP).orderBy(F.desc("value"), "item")))
    words = top_terms(terms, group_rows, top)
    columns = [*GROUP, "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(words.withColumn("part", F.lit("term")).select(*columns))
