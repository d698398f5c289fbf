"""Filter interaction audit: what each filter removes in each order, kept up to date by a stream.

The documents' files are a stream, read as available-now micro-batches. A row becomes the mask of
the filters it fails. Whether its text was seen with a smaller id can change with each file, so
state, keyed by small buckets of texts, holds for each text the smallest id and the counts of its rows by part. A smaller id
that arrives later retracts: the rows that held the minimum are subtracted with their old mask and
added with the duplicate's. The stream's output are signed counts by part and mask; their sums, at
most 32 masks for each part, are all that the 120 orders are computed from.

Rows of one text are combined within a task before they reach its state: the state sees one row for
each text, task and ``COMBINE`` texts, however hot the text. State is kept by the session's state store,
one small entry for each distinct text, and checkpointed to the shared folder; on a cluster set
``spark.sql.streaming.stateStore.providerClass`` to RocksDB's, which isn't bound by memory. The
counts of a micro-batch are a folder of their own, which a repeated attempt overwrites.

Defined results: a null text is empty; a row without doc_id is never a duplicate nor makes one; rows
with the same doc_id and text are not duplicates of each other; a null source is the part '';
several labels of a document hold together (any quality of 1 is good, any toxic of 1 is toxic); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.shared import new_path

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
LEAST_WORDS = 200
COMBINE = 50_000
#: Texts that share a state, on the average.
TEXTS = 16
NOT_CAPITAL = bytes(set(range(256)) - set(range(65, 91)))
MARKS = re.compile(rb"[#$%&*|]")
COUNT_DDL = "part string, mask int, good boolean, toxic boolean, n long"


def failures(text: bytes) -> int:
    """Mask of the filters A to D that a UTF-8 text fails; bit 0 is A."""
    words = text.split()
    points = len(text.decode("utf-8", "replace"))
    failed = len(words) < LEAST_WORDS, 100 * len(set(words)) < 50 * len(words), 100 * len(text.translate(None, NOT_CAPITAL)) > 2 * points, MARKS.search(text) is not None
    return sum(1 << i for i, x in enumerate(failed) if x)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x.as_py() or b"" for x in batch.column(2)]
        keys = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        masks = pa.array([failures(t) for t in texts], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys, masks], ["doc_id", "part", "key", "mask"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text of a task and, apart, for its rows without an id: the smallest id, the
    counts of the rows that have it, and those of the others, by part and labels."""
    schema = pa.schema([("key", pa.binary()), ("mask", pa.int32()), ("least", pa.int64()), ("at", pa.string()), ("over", pa.string())])

    def flush(held):
        rows = [(k, m, least, json.dumps([[*c, n] for c, n in at.items()]), json.dumps([[*c, n] for c, n in over.items()])) for (k, m, _), (least, at, over) in held.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    held: dict = {}
    for batch in batches:
        for doc_id, part, key, mask, good, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            group = held.setdefault((key, mask, doc_id is None), [doc_id, Counter(), Counter()])
            if doc_id is not None and doc_id < group[0]:
                group[0], group[1], group[2] = doc_id, Counter(), group[2] + group[1]
            group[1 if doc_id == group[0] else 2][part, good, toxic] += 1
        if len(held) >= COMBINE:
            yield flush(held)
            held = {}
    if held:
        yield flush(held)


def _settle(_, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Signed counts of one bucket's new rows, against each text's smallest id seen so far."""
    texts, out = json.loads(state.get[0]) if state.exists else {}, []

    def add(counts, mask, sign=1):
        out.extend((part, mask, good, toxic, sign * n) for part, good, toxic, n in counts)

    for frame in frames:
        for key, mask, doc_id, at, over in zip(frame["key"], frame["mask"], frame["least"], frame["at"], frame["over"], strict=True):
            key, mask, at = bytes(key).hex(), int(mask), json.loads(at)
            least, holders = texts.get(key, (None, []))
            add(json.loads(over), mask | DUPLICATE)
            if pd.isna(doc_id):
                add(at, mask)
            elif least is not None and doc_id > least:
                add(at, mask | DUPLICATE)
            else:
                if least is not None and doc_id < least:
                    add(holders, mask, -1)
                    add(holders, mask | DUPLICATE)
                    holders = []
                texts[key] = int(doc_id), holders + at
                add(at, mask)
    if texts:
        state.update((json.dumps(texts),))
    yield pd.DataFrame(out, columns=["part", "mask", "good", "toxic", "n"])


def mask_counts(spark: SparkSession, documents: str, labels: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """(part, mask, good, toxic, n): rows of the Parquet files in ``documents`` by the filters they
    fail. A micro-batch takes ``files_per_batch`` files, by default four for each core, so that
    each fills the cluster and their number is that of the input over the cluster's size."""
    schema = spark.read.parquet(documents).schema
    files = files_per_batch or 4 * spark.sparkContext.defaultParallelism
    # A file source takes a folder, or a glob, which a single file matches as well as a folder does.
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{documents[:-1]}[{documents[-1]}]")
    texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    # Rows without an id have no label; their own salts spread them over the join's partitions.
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("key", "part")).otherwise(F.lit(0).cast("long"))
    measured = texts.mapInArrow(_measure, "doc_id long, part string, key binary, mask int").withColumn("salt", salt)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumn("salt", F.lit(0).cast("long"))
    labelled = measured.join(known, ["doc_id", "salt"], "left").select("doc_id", "part", "key", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    combined = labelled.mapInArrow(_combine, "key binary, mask int, least long, at string, over string")
    # Metadata only; some texts share a state, as Spark hands each state to Python in a frame of its own.
    buckets = -(-spark.read.parquet(documents).count() // TEXTS) or 1
    keyed = combined.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    changes = keyed.groupBy("bucket").applyInPandasWithState(_settle, COUNT_DDL, "texts string", "append", "NoTimeout")
    out = new_path(spark, "filter-counts")

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    spark.createDataFrame([], COUNT_DDL).write.parquet(f"{out}/batch=-1")
    query = changes.writeStream.foreachBatch(write).option("checkpointLocation", new_path(spark, "filter-stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(COUNT_DDL).parquet(f"{out}/batch=*")
    return found.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")


def interactions(counts: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from the counts of masks alone.

    A document counts as removed by the first filter of an order that it fails. Over all orders,
    each of the k filters that it fails is first in 120 / k of them, which is its share of ``shapley``.
    """
    cells = counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(FILTERS))), " ")
    steps = by_part.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = "shiftleft(1, ascii(substr(filter_order, {}, 1)) - 65)"
    steps = steps.withColumns({"own": F.expr(bit.format("step")), "earlier": F.expr(f"aggregate(filter(sequence(1, {len(FILTERS)}), i -> i < step), 0, (a, i) -> a | {bit.format('i')})")})

    def total(condition: str, of: str = "c.n"):
        return F.expr(f"aggregate(cells, 0L, (a, c) -> a + IF({condition}, {of}, 0L))")

    removed = "(c.mask & own) != 0 AND (c.mask & earlier) = 0"
    return steps.select(
        "part", "filter_order", "step",
        total("(c.mask & (own | earlier)) = 0").alias("kept"), total(removed).alias("removed"), total("(c.mask & own) != 0 AND (c.mask & earlier) != 0").alias("redundant"), total("c.mask = own").alias("unique_fails"),
        total(removed, "c.good").alias("good_lost"), total(removed, "c.toxic").alias("toxic_lost"), total("(c.mask & own) != 0", "c.n * (120 div bit_count(c.mask))").alias("shapley"),
    )


def audit(spark: SparkSession, documents: str, labels: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """The interactions of the filters over all files of ``documents``."""
    return interactions(mask_counts(spark, documents, labels, files_per_batch))
