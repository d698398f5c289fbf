"""N-gram Jaccard join: a size-aware heavy-light join of the documents' sets of word shingles.

Equal sets are one node from the start. Two sets of a and b shingles reach the similarity if they
share c(a, b) of them, the least c with 100 c >= percent (a + b - c).

*Light* sets, up to a boundary, emit their subsets of c shingles for every c that a partner can ask
for; two sets share such a subset just if they share c shingles, so nothing is verified. Among sets
that share one, the smallest is linked with all that it may be linked with, and these are all that
are linked at all: a larger set asks for more.

*Heavy* sets scan inverted lists, not of single shingles, which unrelated texts share in numbers that grow with
the corpus, but of parts. The hashes of a set are dealt out to one part more than the shingles in which it can differ from a
similar set, so two similar sets agree in a whole part, each of some eight shingles. Sizes fall into classes; a set
is dealt out by the number of parts of its own class, and by that of the class below if it may be similar to a set there.
An empty part is listed as any other, so no link is lost.

Lists are scanned in rounds: a hub of each list is compared with the list's other sets and leaves it; a
list whose sets lie in one component is done. Each round takes many times as many hubs, so a
group of near copies needs one round and no pairs among its members, and none of its links between
components is lost. Parity bits are conditions of that join, whole sets decide.

The boundary is the one of ``BOUNDARIES`` that costs least: subsets that light sets would emit,
against rows that heavy ones put through the lists' shuffles, over the histogram of sizes.

Defined results: a null text or one without words has the empty set and is linked with nothing; rows that repeat a
doc_id are all returned; a null doc_id never becomes a component_id while the component holds
another id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.shared import components, cut, linked, shared_lists
from trailmark.llm.simhash import overlap_links, shingle_hashes, texts_of, whole_sets

SHINGLE = 3
PERCENT = 90
BOUNDARIES = (0, 9, 19, 29, 39)
#: How much larger the sizes of a class are than those of the class below.
GROWTH = 1.25
#: Parity bits of a set, in words of 64.
WORDS = 4
_BITS = [f"b{i}" for i in range(WORDS)]
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@cache
def classes(most: int, percent: int) -> list[tuple[int, int]]:
    """(first size, parts) of each class of sizes up to that of ``most``. Sets similar to one of a class
    are in it or next to it, and differ from it in fewer shingles than it has parts."""
    out, first, after = [], 1, 2
    while first <= most:
        partner = 100 * (after - 1) // percent  # the largest that is similar to one of the class
        out.append((first, (after - 1 + partner) * (100 - percent) // (100 + percent) + 1))
        first, after = after, max(after + 1, int(after * GROWTH), partner + 1)
    return out


def dealt(n: int, percent: int) -> list[tuple[int, int]]:
    """(class, parts) of all classes that a set of n shingles is dealt out for."""
    known = classes(1 << n.bit_length(), percent)
    own = bisect([first for first, _ in known], n) - 1
    below = own > 0 and -(-percent * n // 100) < known[own][0]
    return [(k, known[k][1]) for k in ((own, own - 1) if below else (own,))]


def part_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """One number for each part of a set of hashes."""
    x = shingles.view(np.uint64)
    halves = (x & np.uint64(0xFFFFFFFF)).astype(float), (x >> np.uint64(32)).astype(float)
    out = []
    for k, parts in dealt(len(x), percent):
        at = (x % np.uint64(parts)).astype(np.int64)
        low, high = (np.bincount(at, h, parts).astype(np.uint64) for h in halves)  # sums of halves are exact
        key = (low + (high << np.uint64(32))) * _ODD + np.arange(k << 40, (k << 40) + parts, dtype=np.uint64) * _MIX
        key = (key ^ (key >> np.uint64(31))) * _MIX
        out.append(key ^ (key >> np.uint64(29)))
    return np.concatenate(out).view(np.int64)


def listed(n, percent: int):
    """The number of sizes of the subsets that a light set of n emits."""
    return n - -(-percent * n // 100) + 1


def _sets(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """doc_id, h, and of each text's set: node (its hash), n, its shingles if it may be light, its parity bits and
    the keys of its parts."""
    for batch in batches:
        sets = [np.sort(np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64)) for t in batch.column(2)]
        nodes = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None for s in sets]
        heads = [s if len(s) <= BOUNDARIES[-1] else s[:0] for s in sets]
        parity = np.array([np.packbits(np.bincount(s & (64 * WORDS - 1), minlength=64 * WORDS) & 1, bitorder="little") for s in sets], np.uint8).reshape(len(sets), -1).view(np.int64)
        keys = [part_keys(s, percent) if len(s) else s for s in sets]
        own = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(heads, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*own, *map(pa.array, parity.T), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "h", "node", "n", "head", *_BITS, "keys"])


@cache
def _chosen(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.int64).reshape(math.comb(n, k), k)


def n_subsets(n: int, percent: int) -> int:
    """How many subsets a light set of n emits."""
    return sum(len(_chosen(n, k)) for k in range(listed(n, percent)))


def _subsets(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(key, c, n, node) of each subset of c shingles; its key is the sum of its hashes."""
    for batch in batches:
        keys, sizes, ns, nodes = [], [], [], []
        for node, head in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            tokens = head.values.to_numpy().view(np.uint64) * _ODD
            for k in range(listed(len(tokens), percent)):
                found = tokens.sum() - tokens[_chosen(len(tokens), k)].sum(axis=1)
                keys.append(found ^ np.uint64((len(tokens) - k) * int(_ODD) % 2**64))
                sizes += [len(tokens) - k] * len(found)
                ns += [len(tokens)] * len(found)
                nodes += [node] * len(found)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64())], ["key", "c", "n", "node"])


def boundary(nodes: DataFrame, percent: int = PERCENT) -> int:
    """The size up to which sets are light."""
    counts = {r["n"]: r["m"] for r in nodes.where(F.col("n") <= BOUNDARIES[-1]).groupBy("n").agg(F.count("*").alias("m")).collect()}  # some forty rows

    def cost(most: int) -> float:
        light = sum(m * n_subsets(n, percent) for n, m in counts.items() if n <= most)
        return light + sum(m * 2 * sum(parts for _, parts in dealt(n, percent)) for n, m in counts.items() if n >= -(-percent * (most + 1) // 100))

    return min(BOUNDARIES, key=cost)


def light_links(nodes: DataFrame, most: int, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that connect all similar sets of up to ``most`` shingles."""
    keyed = nodes.where(F.col("n") <= most).select("node", "head").mapInArrow(lambda it: _subsets(it, percent), "key long, c int, n long, node long")
    hubs = keyed.groupBy("key").agg(F.min(F.struct("n", "node")).alias("hub"), F.count("*").alias("m")).where("m > 1")
    near = (F.col("node") != F.col("hub.node")) & (100 * F.col("c") >= percent * (F.col("n") + F.col("hub.n") - F.col("c")))
    return keyed.join(hubs.select("key", "hub"), "key").where(near).select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()


def inverted_lists(nodes: DataFrame) -> DataFrame:
    """(token, node, root): the parts that more than one of the sets has."""
    return shared_lists(nodes.select("node", F.explode("keys").alias("token")))


def heavy_links(docs: DataFrame, nodes: DataFrame, known: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Links (a, b), with those in ``known``, that connect all similar sets of ``nodes``."""
    lists = cut(inverted_lists(nodes).join(nodes.select("node", "n", *_BITS), "node"), "lists")
    # The texts of all candidates are sought once, for every round.
    held = cut(texts_of(docs, nodes.join(lists.select("node").distinct(), "node", "left_semi")), "texts")
    spread = 100 - percent, 100 + percent

    def fits():
        both = F.col("n") + F.col("hub_n")
        needed = F.ceil(percent * both / spread[1])  # shingles that both must have
        differ = [F.bit_count(F.col(b).bitwiseXOR(F.col(f"hub_{b}"))) for b in _BITS]
        return (needed <= F.least("n", "hub_n")) & (sum(differ[1:], differ[0]) * spread[1] <= both * spread[0])

    def verified(pairs: DataFrame) -> DataFrame:
        return overlap_links(pairs, cut(whole_sets(held, pairs, shingle), "sets"), percent)

    return linked(lists, ["n", *_BITS], fits, verified, known, None, False)


def near_copies(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, the smallest doc_id that links
    of a Jaccard similarity of ``percent`` or more reach, itself included."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    sets = cut(rows.mapInArrow(lambda it: _sets(it, shingle, percent), "doc_id long, h long, node long, n long, head array<long>, " + ", ".join(f"{b} long" for b in _BITS) + ", keys array<long>"), "shingles")
    # Of the rows of a set the one with the smallest doc_id, of those with none the smallest hash.
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("first")
    nodes = cut(sets.where("n > 0").groupBy("node", "n").agg(first, F.first("head").alias("head"), F.first("keys").alias("keys"), *[F.first(b).alias(b) for b in _BITS]), "nodes")
    most = boundary(nodes, percent)
    light = cut(light_links(nodes, most, percent), "light-links")
    heavy = nodes.where(F.col("n") >= -(-percent * (most + 1) // 100))
    roots = cut(components(heavy_links(docs, heavy, light, shingle, percent)), "roots")
    named = cut(nodes.select("node", "first.doc_id").join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root")), "named")
    lowest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = cut(named.join(lowest, "root").select("node", "component_id"), "components")
    numbered = sets.select("doc_id", "node", F.col("n").alias("n_shingles"))
    linked = numbered.where("node IS NOT NULL").join(of_node, "node").select("doc_id", "n_shingles", "component_id")
    return linked.union(numbered.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
