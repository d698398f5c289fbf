"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced jointly.

Documents with equal texts form a group. A group that fills more than ``1 / OWN`` of a shard in
bytes, tokens or rows is a cell of its own; the tail of smaller groups, too many for any list, is
gathered into cells by the hash of the text. Rows are numbered within their cells by range partitions
and offsets, so no task gets a whole group. A cell is cut into ranges of its numbers, units of at
most ``1 / FINE`` of a shard, so fully equal rows too are dealt out evenly. The number of units is bounded (three measures,
``OWN`` groups and ``FINE`` units for each shard, and the cells), so the packing itself is a loop
over a bounded list of sums on the driver, whatever the size of the corpus: in falling size each goes
to the shard whose residual capacity has the highest dot product with it. The law that holds is
``bytes``: sizes are near equal.

Slots count the rows of a shard from 0 without a gap: each unit has a range of its shard's slots.

Defined results: a null text counts as empty, alone of size 8; null doc_ids are placed like any
other; repeated rows get a slot each; an empty table gives an empty result; other columns pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.ranking import numbered
from trailmark.llm.shared import cut, words_of

SHARDS = 24
CELLS = 16_384
FINE = 64
OWN = 512
OVERHEAD = 8
SEED = 7
MEASURES = ("bytes", "tokens", "n")
#: What a measure counts in the dot product: bytes, tokens, rows.
WEIGHTS = (1.0, 0.25, 0.05)


def pack(cells: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each cell. ``cells``: a row of measures for each, as parts of the whole."""
    loads = cells * shards
    residual = np.ones((shards, cells.shape[1])) * WEIGHTS
    out = np.zeros(len(cells), np.int32)
    for i in np.lexsort((np.arange(len(cells)), -loads[:, 0])):
        out[i] = best = int(np.argmax(residual @ loads[i]))
        residual[best] -= loads[i] * WEIGHTS
    return out


def _celled(docs: DataFrame, shards: int, cells: int):
    """``docs`` as ``row``, with doc_id, size, the hash h of the text and its cell: one for each group
    above ``1 / OWN`` of a shard, the tail by the hash; the sums of the cells, and of all."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("row.text"), F.lit(""))
    own = docs.select(F.struct("*").alias("row"))
    sized = own.select("row", F.col("row.doc_id").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.xxhash64(text).alias("h"), F.crc32(text.cast("binary")).alias("text_crc32"))
    slim = own.select((F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.xxhash64(text).alias("h"), F.size(words_of(F.col("row.text"))).cast("long").alias("tokens"))
    groups = cut(slim.groupBy("h").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "groups")
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("n").alias("n")).first()
    share = F.greatest(*[F.col(c) / F.lit(float(max(total[c] or 0, 1))) for c in MEASURES])
    large = groups.where(share * shards * OWN > 1).select(F.col("h").alias("large")).orderBy("large").collect()  # at most three measures x OWN x shards
    table = spark.createDataFrame([(r["large"], cells + i) for i, r in enumerate(large)], "large long, own_cell int")

    def with_cell(df):
        joined = df.join(F.broadcast(table), F.col("h") == F.col("large"), "left")
        return joined.withColumn("cell", F.coalesce("own_cell", F.pmod(F.xxhash64("h"), F.lit(cells)).cast("int"))).drop("large", "own_cell")

    sums = with_cell(groups).groupBy("cell").agg(*[F.sum(c).alias(c) for c in MEASURES]).orderBy("cell").collect()
    return with_cell(sized), sums, total


def _placed(spark: SparkSession, sums: list, total, shards: int) -> DataFrame:
    """(of_cell, unit, units, n, shard, first_slot): the units of each cell, ranges of its rows. A
    cell has as many as it holds ``1 / FINE`` of a shard, and each is packed for itself."""
    parts = np.array([[r[c] / max(total[c] or 0, 1) for c in MEASURES] for r in sums]).reshape(-1, 3)
    units = np.maximum(1, np.ceil(parts.max(axis=1, initial=0) * shards * FINE)).astype(int)
    units = np.minimum(units, [max(1, r["n"]) for r in sums]) if len(sums) else units
    shard = pack(np.repeat(parts / units[:, None], units, axis=0), shards).tolist()
    used, placed, at = [0] * shards, [], 0
    for r, p in zip(sums, units.tolist(), strict=True):
        for u in range(p):
            s = shard[at]
            placed.append((r["cell"], u, p, r["n"], s, used[s]))
            used[s] += -(-(u + 1) * r["n"] // p) - -(-u * r["n"] // p)
            at += 1
    return spark.createDataFrame(placed, "of_cell int, unit long, units long, n long, shard int, first_slot long")


def shard(docs: DataFrame, shards: int = SHARDS, cells: int = CELLS) -> DataFrame:
    """``docs`` as a struct column ``row`` with doc_id, size, text_crc32, shard and slot."""
    rows, sums, total = _celled(docs, shards, cells)
    # Equal rows are told apart by a random number only, which is written with them.
    numbers = numbered(rows.withColumn("tie", F.rand(SEED)), ["cell"], ["h", "doc_id", "tie"], "nth")
    placed = _placed(docs.sparkSession, sums, total, shards)
    of_cell = placed.where("unit = 0").select(F.col("of_cell").alias("cell"), "units", "n")
    at = (F.col("nth") - 1).cast("long")
    unit = numbers.join(F.broadcast(of_cell), "cell").withColumn("at", at).withColumn("of", F.expr("at * units div n"))
    found = unit.join(F.broadcast(placed.drop("units", "n")), (F.col("cell") == F.col("of_cell")) & (F.col("of") == F.col("unit")))
    slot = F.expr("first_slot + at - (of * n + units - 1) div units")
    return found.select("row", "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_order(docs: DataFrame, **parameters) -> DataFrame:
    """The documents' own columns in a struct ``document`` beside shard and slot."""
    return shard(docs, **parameters).withColumnRenamed("row", "document")
