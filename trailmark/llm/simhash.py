"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through pigeonhole blocks.

Two fingerprints that differ in at most ``distance`` bits, cut into ``blocks`` blocks, agree on
at least ``blocks - distance`` of them. Each choice of that many blocks is one table: rows that
agree on these blocks meet under one key, and the Hamming distance is then verified. With 7
blocks and 4 bits a key holds 27 bits or more, so unrelated fingerprints rarely meet; take more
blocks for corpora far beyond 10**9 distinct fingerprints.

Equal fingerprints are one node from the start, so exact copies never form pairs. Inside a key,
a breadth-first walk emits one link for each node it reaches, not all pairs. A key with more than
``hot_bucket`` fingerprints isn't held in memory: its fingerprints are linked through the values
within half the distance of each (two fingerprints at most 4 bits apart share a value at most 2
bits from both, and two that share one are at most 4 apart), which is a plain grouped minimum.

``similar`` and ``keep_one`` are for word shingles of a given Jaccard similarity (five words, 0.8
by default). At 0.8 a tenth to a sixth of a fingerprint's bits differ, so tables keyed by its bits must be
many and short, and unrelated texts meet in them in numbers that grow with the square of the corpus. These
take fingerprints of 256 bits over the distinct shingles, and tables keyed by sampled shingles instead: each
takes ``TABLE_BITS`` of a text's ``MINIMA`` min-wise hashes, which unrelated texts hardly ever share. Pairs
that meet in one of ``TABLES`` tables are candidates if the Hamming distance of their fingerprints is one of that
similarity; texts that a first comparison leaves open take 2048 bits, as do those near to many texts that are not quite
similar. Whole sets of shingles then decide, so no pair below the similarity is linked. Of pairs at 0.8 itself
some 97 in 100 meet by the binomial estimate (the tests measure it), of closer ones more. A key of a table is a list for ``shared.linked``, at
any size, and the tables are as many at any size.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; rows
with a repeated doc_id are all returned; a null doc_id never becomes a component_id while the
component holds another id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.shared import components, cut, ends, linked, shared_lists

SEED = 42
SHINGLE = 4
DISTANCE = 4
BLOCKS = 7
HOT_BUCKET = 20_000
SIMILARITY = 0.8
WIDE_SHINGLE = 5
WIDE_BITS = 256
#: Bits of the fingerprints of texts that stay open after their first comparison.
FINE_BITS = 2048
#: Min-wise hashes of a text; tables; and how many of the hashes each table takes.
MINIMA = 40
TABLES = 50
TABLE_BITS = 8
_CHUNK = 255 * 128
_LANES = np.uint64(0x0101010101010101)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: Odd numbers: one for each min-wise hash.
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """Hashes of the word shingles of one UTF-8 text, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits. Eight bits are counted at a time, one in
    each byte of a word, in sums of at most 255 hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i : i + _CHUNK]
        edges = np.arange(0, len(part), 255)
        for bit in range(8):
            sums = np.add.reduceat((part >> np.uint64(bit)) & _LANES, edges)
            counts[bit::8] += sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one UTF-8 text as an unsigned number."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    return int.from_bytes(np.packbits(_bit_counts(hashes) * 2 > len(hashes), bitorder="little").tobytes(), "little")


def wide_fingerprint(text: bytes | None, shingle: int = WIDE_SHINGLE, bits: int = WIDE_BITS) -> bytes:
    """Fingerprint of ``bits`` bits over the distinct shingles of one UTF-8 text."""
    return _wide(np.unique(shingle_hashes(text, shingle)), bits)


def _wide(hashes: np.ndarray, bits: int) -> bytes:
    if not len(hashes):
        return bytes(bits // 8)
    out = []
    for k in range(bits // 64):
        x = hashes + np.uint64((k + 1) * int(_MIX[0]) % (1 << 64))
        for shift, factor in ((30, _MIX[1]), (27, _MIX[2])):
            x = (x ^ (x >> np.uint64(shift))) * factor
        out.append(np.packbits(_bit_counts(x ^ (x >> np.uint64(31))) * 2 > len(hashes), bitorder="little").tobytes())
    return b"".join(out)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(_fingerprints, "doc_id long, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """The bits of each choice of ``blocks - distance`` blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _walk(fps: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """One link for each fingerprint that a breadth-first walk reaches from another."""
    left = fps
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= distance
            queue.extend(reached := left[near])
            left = left[~near]
            for x in reached:
                yield int(x), int(at)


def _link_blocks(batches: Iterator[pa.RecordBatch], distance: int, hot_bucket: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, then fp: links of each key; members of a hot key as (fp, null)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held_key, held, hot = None, [], False

    def emit(pairs):
        a, b = np.array(pairs, np.uint64).reshape(-1, 2).T.copy().view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    def emit_hot(fps):
        return pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.nulls(len(fps), pa.int64())], schema=schema)

    for batch in batches:
        keys = batch.column(0).to_numpy()
        fps = batch.column(1).to_numpy().view(np.uint64)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
        pairs = []
        for i in np.flatnonzero((ends - starts > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1)):
            part, key = fps[starts[i] : ends[i]], keys[starts[i]]
            if held_key is not None and key != held_key:
                if not hot:
                    pairs += _walk(np.concatenate(held), distance)
                held, hot = [], False
            held_key = key
            if hot:
                yield emit_hot(part)
                continue
            held.append(part)
            if sum(map(len, held)) > hot_bucket:
                yield emit_hot(np.concatenate(held))
                held, hot = [], True
        if pairs:
            yield emit(pairs)
    if held and (pairs := list(_walk(np.concatenate(held), distance))):
        yield emit(pairs)


def links(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Links (a, b) that connect every two distinct fingerprints of ``nodes`` (fp) within ``distance``,
    an even number, as hot keys are linked through the values half-way."""
    if distance % 2:
        raise ValueError("the distance must be even")
    masks = block_masks(blocks, distance)
    keys = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)]))
    keyed = nodes.select(keys.alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp")
    found = cut(keyed.mapInArrow(lambda it: _link_blocks(it, distance, hot_bucket), "a long, b long"), "links")
    near = [0] + [sum(1 << b for b in c) for k in range(1, distance // 2 + 1) for c in combinations(range(64), k)]
    middles = found.where("b is null").select("a").distinct().select("a", F.explode(F.transform(F.array(*map(F.lit, map(_signed, near))), lambda m: F.col("a").bitwiseXOR(m))).alias("mid"))
    hubs = middles.groupBy("mid").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    cold = found.where("b is not null")
    if found.where("b is null").isEmpty():
        return cold
    return cold.union(middles.join(hubs, "mid").select("a", "b").where("a <> b").distinct())


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of at most ``distance`` bits reach.
    """
    prints = cut(fingerprints(docs), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(nodes.select("fp"), distance, blocks, hot_bucket))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = cut(named, "rooted")
    lowest = cut(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "lowest")
    of_print = cut(named.join(lowest, "root").select("fp", "component_id"), "components")
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def distance_of(similarity: float, bits: int = WIDE_BITS, deviations: float = 2.5) -> int:
    """Bits that fingerprints of shingle sets with this Jaccard similarity differ in, on the average
    and two and a half (or so many) standard deviations more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The min-wise hashes of a set of hashes; of none, zeros."""
    out = np.zeros(MINIMA, np.uint64)
    for i in range(0, len(hashes), _CHUNK):
        low = (_FACTORS[:, None] * hashes[None, i : i + _CHUNK]).min(axis=1)
        out = low if i == 0 else np.minimum(out, low)
    return out


def _keys(low: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """For each table one number of the minima that it takes."""
    x = (low[chosen] * _FACTORS[: chosen.shape[1]]).sum(axis=1) + np.arange(1, len(chosen) + 1, dtype=np.uint64) * _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    return (x ^ (x >> np.uint64(27))) * _MIX[2]


def _wide_fingerprints(batches: Iterator[pa.RecordBatch], shingle: int, bits: int, tables: int, of: int) -> Iterator[pa.RecordBatch]:
    chosen = table_bits(tables, of)
    for batch in batches:
        sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)]
        words = np.frombuffer(b"".join(_wide(x, bits) for x in sets), np.int64).reshape(batch.num_rows, -1)
        keys = pa.array([_keys(minima(x), chosen).view(np.int64) for x in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *map(pa.array, words.T), keys], ["doc_id", "h", *_words(bits), "keys"])


def _words(bits: int) -> list[str]:
    return [f"w{i}" for i in range(bits // 64)]


def table_bits(tables: int = TABLES, of: int = TABLE_BITS, minima: int = MINIMA) -> np.ndarray:
    """The minima of each table: a fixed choice that takes all about equally often."""
    rng, deck, out = np.random.default_rng(SEED), [], []
    for _ in range(tables):
        if len(deck) < of:
            deck = deck + [x for x in rng.permutation(minima).tolist() if x not in deck]
        out.append(sorted(deck[:of]))
        deck = deck[of:]
    return np.array(out)


def _tokens(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "tokens"])


def _fine(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = np.frombuffer(b"".join(wide_fingerprint(t.as_py(), shingle, FINE_BITS) for t in batch.column(1)), np.int64).reshape(batch.num_rows, -1)
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, words.T)], ["node", *_words(FINE_BITS)])


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of each of ``nodes``, from its ``first`` document (doc_id and h, the text's hash).

    What is wanted is the smaller side at any size, so it is hashed and the texts aren't sorted."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    wanted = cut(nodes.select("node", F.col("first.doc_id").alias("of"), F.col("first.h").alias("of_h")), "wanted")
    chosen = texts.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h"))).select("node", "text")
    return chosen.groupBy("node").agg(F.first("text").alias("text"))


def whole_sets(texts: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """(node, tokens): the shingle hashes of each node of ``pairs``, made again from its text."""
    wanted = texts.join(cut(ends(pairs), "ends"), "node", "left_semi").select("node", "text")
    return wanted.mapInArrow(lambda it: _tokens(it, shingle), "node long, tokens array<long>")


def overlap_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose whole ``sets`` (node, tokens) are similar."""
    a, b = (sets.select(F.col("node").alias(x), F.col("tokens").alias(f"tokens_{x}")) for x in "ab")
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    near = 100 * both >= percent * (F.size("tokens_a") + F.size("tokens_b") - both)
    return pairs.join(a, "a").join(b, "b").where(near).select("a", "b")


def similar(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE, tables: int = TABLES, of: int = TABLE_BITS) -> DataFrame:
    """One row for each document: doc_id, h (hash of its text), component_id (smallest doc_id
    that links of Jaccard ``similarity``, in whole per cent, or more reach; null without one) and lead: whether it is
    the row of its component that stays."""
    distance, percent, words = distance_of(similarity), round(100 * similarity), _words(WIDE_BITS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("h"))
    schema = "doc_id long, h long, " + ", ".join(f"{w} long" for w in words) + ", keys array<long>"
    prints = cut(texts.mapInArrow(lambda it: _wide_fingerprints(it, shingle, WIDE_BITS, tables, of), schema).withColumn("node", F.xxhash64(*words)), "wide-fingerprints")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    first = F.min(order).alias("first")
    nodes = cut(prints.groupBy("node").agg(first, *[F.first(w).alias(w) for w in words], F.min_by("keys", order).alias("keys")), "nodes")
    listed = shared_lists(nodes.select("node", F.explode("keys").alias("token")))
    lists = cut(listed.join(nodes.select("node", *words), "node"), "lists")
    # The texts of all candidates are sought once, for every round.
    held = cut(texts_of(docs, nodes.join(lists.select("node").distinct(), "node", "left_semi")), "texts")

    def fits(words=words, distance=distance):
        differ = [F.bit_count(F.col(w).bitwiseXOR(F.col(f"hub_{w}"))) for w in words]
        return sum(differ[1:], differ[0]) <= distance

    def finer(nodes: DataFrame):
        """Longer fingerprints, so pairs that are not quite similar are few."""
        fine = _words(FINE_BITS)
        found = held.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(lambda it: _fine(it, shingle), "node long, " + ", ".join(f"{w} long" for w in fine))
        return found, fine, lambda: fits(fine, distance_of(similarity, FINE_BITS, 3))

    def verified(pairs: DataFrame) -> DataFrame:
        return overlap_links(pairs, cut(whole_sets(held, pairs, shingle), "sets"), percent)

    roots = components(linked(lists, words, fits, verified, None, finer))
    rows = prints.select("doc_id", "h", "node").join(roots, "node", "left").select("doc_id", "h", F.coalesce("root", "node").alias("root"))
    # The smallest doc_id of a component; without any, the smallest hash of a text.
    best = cut(rows.groupBy("root").agg(F.min("doc_id").alias("component_id"), first), "wide-lowest")
    return rows.join(best, "root").select("doc_id", "h", "component_id", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))).alias("lead"))


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """The documents without all but one of each component of ``similar``: that with the smallest
    doc_id stays, of rows that repeat it one.

    Rows without a doc_id go if their component has a numbered document, else one of them stays.
    """
    decided = similar(docs, **parameters).where("lead").groupBy(F.col("doc_id").alias("of"), F.col("h").alias("of_h")).agg(F.count("*").alias("n"))
    # Two tables, so Spark knows that of the repeated rows to be small and needn't shuffle the texts again.
    single, several = cut(decided.where("n = 1"), "stays"), cut(decided.where("n > 1"), "stays-once")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h"))
    once = rows.join(single, same, "left_semi")
    repeated = rows.join(several, same, "left_semi").dropDuplicates(["doc_id", "h"])
    return once.unionByName(repeated).select("row.*")
