"""Order over a whole group without one task for it: range partitions and offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.functions.cutting import cut


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with ``name``, their number from 1 in ``order`` within ``by``, and running ``sums``.

    Rows are dealt out by ranges of ``by`` and ``order``; each range numbers its own rows and adds
    what the ranges before it hold, of which there are at most as many as partitions. ``order`` must
    tell all rows of a group apart. The dealt rows are a table, as another attempt could deal them differently.
    """
    sums = sums or {}
    dealt = rows.withColumns({f"__{k}": v for k, v in sums.items()}).repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id())
    dealt = cut(dealt, "ranges")
    here = W.partitionBy(*by, "__part").orderBy(*order)
    counted = dealt.withColumn(name, F.row_number().over(here)).withColumns({k: F.sum(f"__{k}").over(here.rowsBetween(W.unboundedPreceding, 0)) for k in sums})
    before = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    held = dealt.groupBy(*by, "__part").agg(F.count("*").alias("__n"), *[F.sum(f"__{k}").alias(f"__sum_{k}") for k in sums])
    offsets = held.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__part").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"), *[F.sum(f"__sum_{k}").over(before).alias(f"__sum_{k}") for k in sums])
    same = F.col("__part") == F.col("__of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    joined = counted.join(offsets, same)
    totals = {name: (F.col(name) + F.col("__n")).cast("int")} | {k: F.col(k) + F.coalesce(f"__sum_{k}", F.lit(0)) for k in sums}
    return joined.withColumns(totals).select(*rows.columns, name, *sums)


def with_totals(rows: DataFrame, by: Sequence[str], **totals: Column) -> DataFrame:
    """``rows`` with aggregates of their group, which is summed up before it meets them."""
    found = rows.groupBy(*by).agg(*[v.alias(k) for k, v in totals.items()])
    return rows.join(found, list(by))
