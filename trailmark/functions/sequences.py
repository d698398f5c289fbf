"""Similarity of paths by their longest common subsequence (C1, C2), in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MOST_BITS = 62


def position_masks(path: Column) -> Column:
    """Map from each screen of a path to the bits of its positions; compute it once for each path."""

    def mask(screen: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(path) - 1), F.lit(0).cast("long"), lambda m, i: F.when(F.get(path, i) == screen, m + F.pow(F.lit(2), i).cast("long")).otherwise(m))

    return F.when(F.size(path).between(1, MOST_BITS), F.map_from_entries(F.transform(F.array_distinct(path), lambda s: F.struct(s, mask(s)))))


def _by_bits(a: Column, masks: Column, size_b: Column) -> Column:
    """Bit-parallel length: one word operation for each screen of ``a``."""
    full = F.pow(F.lit(2), size_b).cast("long") - 1

    def step(v: Column, screen: Column) -> Column:
        m = F.coalesce(F.try_element_at(masks, screen), F.lit(0).cast("long"))
        return (v + v.bitwiseAND(m)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(full)

    return size_b - F.bit_count(F.aggregate(a, full, step))


def _by_rows(a: Column, b: Column) -> Column:
    """Row-wise dynamic programme, for paths that have more screens than a word has bits."""
    places = F.sequence(F.lit(0), F.size(b) - 1)

    def row(above: Column, screen: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            value = F.when(F.get(b, j) == screen, F.get(above, j) + 1).otherwise(F.greatest(F.get(above, j + 1), F.element_at(done, -1)))
            return F.array_append(done, value)

        return F.aggregate(places, F.array(F.lit(0)), cell)

    start = F.array_repeat(F.lit(0), F.size(b) + 1)
    return F.element_at(F.aggregate(a, start, row), -1)


def lcs_length(a: Column, b: Column, masks_b: Column | None = None) -> Column:
    """Length of the longest common subsequence of two arrays; null if one is null."""
    masks = position_masks(b) if masks_b is None else masks_b
    length = F.when(F.size(b) <= MOST_BITS, _by_bits(a, masks, F.size(b))).otherwise(_by_rows(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(length)


def similarity(a: Column, b: Column, masks_b: Column | None = None) -> Column:
    """Common subsequence over the longer length; 1 if both are empty, 0 if one is."""
    longer = F.greatest(F.size(a), F.size(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(lcs_length(a, b, masks_b) / longer)


def backbone(a: Column, b: Column) -> Column:
    """A longest common subsequence itself; at a tie that of the earlier row wins."""
    places = F.sequence(F.lit(0), F.size(b) - 1)
    nothing = F.slice(a, 1, 0)

    def row(above: Column, screen: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            up, left = F.get(above, j + 1), F.element_at(done, -1)
            value = F.when(F.get(b, j) == screen, F.array_append(F.get(above, j), screen)).otherwise(F.when(F.size(up) >= F.size(left), up).otherwise(left))
            return F.array_append(done, value)

        return F.aggregate(places, F.array(nothing), cell)

    found = F.element_at(F.aggregate(a, F.array_repeat(nothing, F.size(b) + 1), row), -1)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), nothing).otherwise(found)


def common_backbone(paths: Column) -> Column:
    """The backbone of several paths, folded in their order."""
    return F.aggregate(F.slice(paths, 2, F.greatest(F.size(paths), F.lit(1))), F.get(paths, F.lit(0)), lambda done, p: backbone(done, p))


def register(spark: SparkSession) -> None:
    """``path_similarity(a, b)`` for SQL, with the row-wise programme as a SQL function."""
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION path_similarity(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE RETURN
        CASE WHEN size(a) = 0 AND size(b) = 0 THEN 1.0 WHEN size(a) = 0 OR size(b) = 0 THEN 0.0 ELSE
        element_at(aggregate(a, array_repeat(0, size(b) + 1), (above, s) -> aggregate(sequence(0, size(b) - 1), array(0), (done, j) ->
          array_append(done, CASE WHEN b[j] = s THEN above[j] + 1 ELSE greatest(above[j + 1], element_at(done, -1)) END))), -1) / greatest(size(a), size(b)) END"""
    )
