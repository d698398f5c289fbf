"""Very long texts, repeated rows, empty tables and clashing columns, for operators and pipeline."""

import random
import sys
from pathlib import Path

import pytest

from trailmark.llm import decontaminate, licenses, mixing, suffix_dedup

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
GRANT = "Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
ITEM = "what is the boiling point of liquid nitrogen at standard pressure measured in degrees of the kelvin scale answer seventy seven"
PASSAGE = "this very passage of more than fifty bytes stands at the end of both of the documents"


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(20000)]
    return " ".join(rng.choice(vocabulary) for _ in range(300_000))


@pytest.fixture(scope="module")
def docs(spark, long_text):
    rows = [(1, "A short one. " + PASSAGE, "en", "a", 0), (2, f"{long_text} {ITEM} {long_text[:900]} {PASSAGE}", "en", "b", 0), (3, None, None, None, None), (4, "", "en", "a", 0)]
    return spark.createDataFrame(rows, DOCS)


def test_the_end_of_a_very_long_text_counts(spark, docs, long_text):
    removed = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs, keep=False).collect()}
    size = len(f"{long_text} {ITEM} {long_text[:900]} {PASSAGE}")
    assert removed[2] == (size, len(PASSAGE) + 1, 1) and removed[1][1] == 0 and removed[3] == removed[4] == (0, 0, 0)
    benchmark = spark.createDataFrame([(7, ITEM), (8, "an unrelated question about the names of rivers that cross the old town and its seven hills")], "item_id long, text string")
    found = {r.doc_id: r.contaminated for r in decontaminate.leaks(docs, benchmark).collect()}
    assert found == {1: False, 2: True, 3: False, 4: False}
    placed = {r.doc_id: r.copies for r in mixing.replicate(docs).groupBy("doc_id").count().withColumnRenamed("count", "copies").collect()}
    assert set(placed) <= {1, 2, 3, 4}


def test_licence_at_the_end_of_a_very_long_text(spark, long_text):
    rows = spark.createDataFrame([(1, f"{long_text}.\n\n{GRANT}"), (2, long_text), (3, GRANT)], "doc_id long, text string")
    out = {r.doc_id: r.asDict() for r in licenses.scan(rows).collect()}
    assert set(out) == {1, 2, 3} and out[1]["sentence_ids"] == out[3]["sentence_ids"] != "" and out[2]["sentence_ids"] == ""


def test_repeated_rows_are_replicated_alike(spark):
    rows = [(i % 5, f"text {i % 5}", "en", "s", 0) for i in range(40)]
    counts = {}
    for r in mixing.replicate(spark.createDataFrame(rows, DOCS), epochs=3.0).collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert all(n % 8 == 0 for n in counts.values())


def pipeline_rows(spark, folder, rows, schema):
    import corpus_pipeline

    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(7, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert pipeline_rows(spark, tmp_path, [], DOCS).count() == 0


def test_pipeline_with_clashing_columns(spark, tmp_path):
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choices("abcdefghijklmno", k=rng.randint(3, 8))) for _ in range(120))
    names = ("row", "size", "shard", "slot", "copies", "kept", "label", "id", "__id", "__text", "fp", "words", "law")
    schema = DOCS + "".join(f", {n} string" for n in names)
    rows = [(i, text(), "en", f"s{i % 2}", 0, *(f"{n}{i}" for n in names)) for i in range(30)]
    rows.append((30, text() + " " + ITEM, "en", "s0", 0, *names))
    out = pipeline_rows(spark, tmp_path, rows, schema)
    found = out.collect()
    assert {"row", "__id", "__text", "label"} <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    assert found and 30 not in {r.doc_id for r in found} and all(r["row"] == f"row{r.doc_id}" and r["__id"] == f"__id{r.doc_id}" for r in found)
