"""Quality rules as a ledger: every rule is evaluated once, and failures are kept as bits.

``ledger`` measures each document and sets bit i of ``fail_bits`` if rule i fails. A policy is a
versioned set of rules, that is a mask: ``judge`` keeps what has no bit of it, and ``ablation``
shows what each rule adds, from the counts of the distinct bit patterns alone, so policies are
compared without reading a text again. Only DataFrame functions run here.

Defined results: a null text is empty, has no words and fails ``few_words``; repeated rows are
each judged; an empty table gives an empty ledger; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.shared import WHITE, let, words_of

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rules in the order of their bits: name, and the condition (SQL over the measurements) of failure.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "repeated_lines": "100 * n_dup_lines > 60 * n_lines",
    "capitals": "2 * n_capitals > word_chars",
    "many_words": "n_words > 1000000",
}
BASE_RULES = ("few_words", "repeated_words")
#: Versioned policies. A version never changes; a new one is added.
#: ``web-2`` keeps long texts, whose length alone is no fault.
POLICIES = {"base-1": BASE_RULES, "web-1": tuple(RULES), "web-2": tuple(r for r in RULES if r != "many_words")}
POLICY = "web-2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")


def mask(rules) -> int:
    """The bits of some rules."""
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeat_words(words: Column) -> Column:
    """How many words lie in a three-word window that the text has twice or more.

    The windows' hashes are sorted with their places; neighbours with equal hashes are repeats,
    and each repeat adds the words up to the next one, three at most.
    """

    def windows(w):
        places = F.sequence(F.lit(0), F.size(w) - 3)
        return F.sort_array(F.transform(places, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))))

    def repeats(s):
        def same(x, j):
            return F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))

    def covered(p):
        steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    found = let(words, lambda w: let(windows(w), lambda s: let(repeats(s), covered)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(found).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` as a struct column ``row``, with the measurements and ``fail_bits``."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    bare = F.translate(text, WHITE, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    measured = (
        docs.select(F.struct("*").alias("row"))
        .select("row", words_of(text).alias("words"), lines.alias("lines"), bare.alias("bare"))
        .select(
            "row",
            F.size("words").cast("long").alias("n_words"),
            F.length("bare").cast("long").alias("word_chars"),
            _count(F.col("bare"), SYMBOLS).cast("long").alias("n_symbols"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            _repeat_words(F.col("words")).alias("n_repeat_words"),
            _count(F.col("bare"), CAPITALS).cast("long").alias("n_capitals"),
        )
    )
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    fail_bits = bits[0]
    for bit in bits[1:]:
        fail_bits = fail_bits.bitwiseOR(bit)
    return measured.withColumn("fail_bits", fail_bits)


def judge(entries: DataFrame, policy: str = POLICY) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy."""

    def none(rules):
        return F.col("fail_bits").bitwiseAND(F.lit(mask(rules))) == 0

    return entries.withColumn("base_failed", ~none(BASE_RULES)).withColumn("kept", none(BASE_RULES) & none(POLICIES[policy]))


def ablation(entries: DataFrame, policy: str = POLICY) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail nothing else, and that would
    be kept without it. Works on the counts of the distinct bit patterns."""
    patterns = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    names = POLICIES[policy]
    all_bits = mask(names)
    per_rule = patterns.select("fail_bits", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).alias("bit")) for r in names])).alias("r"))
    failing = F.col("fail_bits").bitwiseAND(F.lit(all_bits))
    return per_rule.groupBy("r.rule").agg(
        F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failing"),
        F.sum(F.when(failing == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
        F.sum(F.when(failing.bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def keep_good(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """The documents that pass a policy, with their own columns."""
    return judge(ledger(docs), policy).where("kept").select("row.*")
