"""SimHash and suffix dedup against brute force, with nulls, ties, repetitions, empty tables."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from trailmark.llm import jaccard, shared, simhash, suffix_dedup

DOCS = "doc_id long, text string, fp string"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def texts(n=60):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 200)))
        rows.append((i, text))
        if i % 4 == 0:
            parts = text.split()
            parts[rng.randrange(len(parts))] = "zz"
            rows.append((1000 - i, " ".join(parts)))
        if i % 6 == 0:
            rows.append((2000 + i, text.upper()))
    return rows + [(3000, None), (3001, ""), (3002, " \n\t"), (3003, "Ab"), (3003, "Ab"), (None, rows[0][1]), (3004, "x" * 100_000)]


@pytest.mark.parametrize("hot_bucket", [20_000, 2])
def test_near_duplicates_equal_brute_force(spark, hot_bucket):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], DOCS)
    got = simhash.near_duplicates(docs, hot_bucket=hot_bucket).collect()
    assert len(got) == len(rows)
    prints = {t: brute_fingerprint(t) for _, t in rows}
    of = brute_components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    lowest = {}
    for i, t in rows:
        if i is not None:
            lowest[of[prints[t]]] = min(i, lowest.get(of[prints[t]], i))
    want = sorted((str(i), f"{prints[t]:016x}", lowest[of[prints[t]]]) for i, t in rows)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


def test_dense_ball_of_fingerprints_is_one_component(spark):
    """Many fingerprints near one another, through cold keys and through hot ones."""
    rng = np.random.default_rng(0)
    center = int(rng.integers(1 << 62))
    fps = sorted({center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (150, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 20)})
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = {n: r for n, r in brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 4).items()}
    for hot_bucket in (20_000, 10):
        found = simhash.links(nodes, hot_bucket=hot_bucket).collect()
        assert all((r.a ^ r.b).bit_count() <= 4 for r in found)
        assert len(found) < 40 * len(fps) or hot_bucket == 10
        got = {r.node: r.root for r in shared.components(simhash.links(nodes, hot_bucket=hot_bucket)).collect()}
        assert {n: got.get(n, n) for n in fps} == want


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5000, 5000)], "a long, b long")
    got = {r.node: r.root for r in shared.components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_wide_bits_are_those_of_plain_counting():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert simhash._bit_counts(hashes).tolist() == [sum(int(h) >> b & 1 for h in hashes) for b in range(64)]
    text = " ".join(f"w{i % 97}" for i in range(400)).encode()
    assert simhash.fingerprint(text) == brute_fingerprint(text.decode())
    once, twice = (simhash.wide_fingerprint(" ".join(["a b c d e"] * n).encode()) for n in (3, 9))
    assert once == twice and simhash.wide_fingerprint(b" \t") == bytes(32)
    assert all(len(set(x)) == simhash.TABLE_BITS for x in simhash.table_bits().tolist()) and np.bincount(simhash.table_bits().ravel()).min() >= 10
    with pytest.raises(ValueError, match="even"):
        simhash.links(None, distance=3)


def test_similar_pairs_by_bands(spark):
    """Of pairs in each band of similarity from 0.8 at least nine in ten are linked, of others none."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    rows, pairs = [], []
    for i in range(700):
        parts = [rng.choice(words) for _ in range(rng.randint(150, 400))]
        rows.append((2 * i, " ".join(parts)))
        for at in rng.sample(range(len(parts)), rng.randint(len(parts) // 60, len(parts) // 35) if i % 3 else rng.randint(0, len(parts) // 25)):
            parts[at] = f"changed{at}"
        rows.append((2 * i + 1, " ".join(parts)))
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        pairs.append((2 * i, len(a & b) / len(a | b)))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], DOCS)
    got = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    linked = {i: got[i + 1] == i for i, _ in pairs}
    assert all(c in (i, i - 1) for i, c in got.items())  # no unrelated texts
    for low, high in ((0.8, 0.82), (0.82, 0.85), (0.85, 0.9), (0.9, 1.01)):
        band = [linked[i] for i, j in pairs if low <= j < high]
        assert len(band) > 25 and np.mean(band) >= 0.9, (low, len(band), np.mean(band))
    assert not any(linked[i] for i, j in pairs if j < 0.8)


def test_large_group_of_near_copies(spark):
    """A group of near copies is one component."""
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
    rows = []
    for i in range(400):
        parts = list(base)
        parts[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in simhash.similar(docs).collect()} == {0}
    assert [r.doc_id for r in simhash.keep_one(docs).collect()] == [0]


def test_keep_one_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "A B C D E F", "y"), (2, "A B C D E F", "y"), (3, "other words here now", "z"), (None, "lonely text of its own kind", "n")], DOCS)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
    empty = docs.where("FALSE")
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_one(empty).collect() == []
    assert suffix_dedup.remove_repeats(empty).collect() == []


def brute_removal(rows, length=50):
    first, data = {}, [(1 << 63 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(i, first.get(b[p : p + length], i))
    out = []
    for (i, b), (doc, _) in zip(data, rows, strict=True):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((str(doc), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out)


@pytest.mark.parametrize(("hot_anchor", "batch"), [(4096, 10_000), (4, 10_000), (4, 7), (4096, 7)])
def test_removal_equals_brute_force(spark, hot_anchor, batch):
    rng = random.Random(5)
    text = lambda n, letters="abcdeé \n": "".join(rng.choice(letters) for _ in range(n))
    base = [text(n) for n in (400, 80, 50, 49, 200)]
    rows = [(i, text(30) + base[1] + base[4] + text(30)) for i in range(40)] + [(100 + i, base[0]) for i in range(5)]
    rows += [(200, None), (201, ""), (202, "a" * 400), (203, "a" * 300 + "b" * 90), (204, "xy" * 200), (205, "xy" * 150 + base[0]), (None, base[0]), (None, base[0][3:300] + "q")]
    rows += [(206, base[4] + base[1] + base[4]), (206, base[4]), (206, base[4]), (207, base[0][:60] * 12), (208, "z" + base[0][:60] * 30), (209, base[2]), (210, base[3]), (211, base[3] + base[2])]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, tag string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = suffix_dedup.remove_repeats(docs, hot_anchor=hot_anchor).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got) == brute_removal(rows)


@pytest.mark.parametrize("batch", [7, 10_000])
def test_anchors_of_more_segments_than_are_held(spark, batch):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base, rows = [text(n) for n in (30, 45, 60, 90)], []
    for i in range(120):
        rows.append((i, text(rng.randint(0, 20)) + rng.choice(base) + rng.choice("xyz") * rng.randint(1, 20) + rng.choice(base) + text(rng.randint(0, 20))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for hot, held in ((2, 5), (2, 1000), (10, 40)):
            got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot_anchor=hot, most_held=held).collect()
            assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got) == brute_removal(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_worker_holds_few_strings_at_once():
    """Hot segments of many texts in one Arrow batch come out in batches of bounded size."""
    n, text = 3000, bytes(random.Random(9).choices(b"abcdefgh ", k=180))
    marks = [[{"kind": 3, "anchor": 0, "place": p, "n": 60} for p in (0, 60)]] * n
    columns = [pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int64()), pa.array([text] * n, pa.binary()), pa.array(marks, pa.list_(pa.struct([("kind", pa.int8()), ("anchor", pa.int64()), ("place", pa.int64()), ("n", pa.int32())])))]
    batch = pa.RecordBatch.from_arrays(columns, ["doc", "tag", "text", "marks"])
    rows = [b.num_rows for b in suffix_dedup._cut_strings(iter([batch]), 50)]
    assert sum(rows) == 120 * n and max(rows) < 70_000


def test_segments_that_share_only_their_anchor_are_not_cut(spark, monkeypatch):
    rng, seen, cut_of = random.Random(10), [], suffix_dedup.cut
    monkeypatch.setattr(suffix_dedup, "cut", lambda df, name: seen.append(df.where("kind > 1").count()) or cut_of(df, name))
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    common = [text(20) for _ in range(20)]
    rows = [(i, "".join(text(40) + c for c in common)) for i in range(20)]
    assert {r.n_removed for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}
    assert seen[0] < 60  # by chance


def test_other_lengths(spark):
    rows = [(1, "abcdefghij" * 9), (2, "x" + "abcdefghij" * 9), (3, "abcdefghij" * 4)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=40, keep=False).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == [x[:5] for x in brute_removal(rows, 40)]
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=20)


def brute_factors(suffixes, group, doc):
    """For each suffix the longest common prefix with one of a smaller document of its group."""

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    return [max((common(s, u) for u, h, e in zip(suffixes, group, doc, strict=True) if h == g and e < d), default=0) for s, g, d in zip(suffixes, group, doc, strict=True)]


def test_longest_previous_factors():
    rng = random.Random(7)
    for _ in range(40):
        n = rng.randint(1, 40)
        suffixes = ["".join(rng.choice("ab\0") for _ in range(rng.randint(20, 60))) for _ in range(n)]
        suffixes = [rng.choice(suffixes)[: rng.randint(10, 60)] + "b" * rng.randint(10, 20) for _ in range(n)]
        group, doc = [rng.randint(0, 2) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        size = np.array([len(x) for x in suffixes])
        got = suffix_dedup.suffix_factors(np.frombuffer("".join(suffixes).encode(), np.uint8), np.cumsum(size) - size, size, np.array(group), np.array(doc), 20)
        want = brute_factors(suffixes, group, doc)
        assert [x if x >= 20 else 0 for x in got] == [x if x >= 20 else 0 for x in want]
    order = sorted(range(50), key=lambda i: i * 7 % 50)
    lcp = np.array([0] + [rng.randint(0, 5) for _ in order[1:]])
    want = [max([min(lcp[min(i, j) + 1 : max(i, j) + 1]) for j in range(50) if order[j] < order[i]], default=0) for i in range(50)]
    assert suffix_dedup.longest_previous_factors(lcp, np.array(order)).tolist() == want


def test_many_rows_without_doc_id(spark):
    """Such rows are told apart by their texts, whatever their number, and one very long text is cut right."""
    rng = random.Random(8)
    shared = "".join(rng.choice("abcdefg ") for _ in range(70))
    rows = [(1, shared), (2, "x" * 1_000_000 + shared)] + [(None, f"{i} {shared} {i * 7}") for i in range(3000)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep=True).collect()
    assert sorted(bytes(r.kept).decode() for r in got if r.doc_id is None) == sorted(f"{i}  {i * 7}" for i in range(3000))
    assert [(r.n_removed, r.n_spans) for r in got if r.doc_id == 2] == [(70, 1)]


def listed(spark, monkeypatch, module, find, n_words):
    """How many rows unrelated texts put into the lists that ``module`` scans."""
    rng, seen, linked = random.Random(21), [], module.linked
    monkeypatch.setattr(module, "linked", lambda lists, *rest: seen.append(lists.count()) or linked(lists, *rest))
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n_words)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=60))) for i in range(1500)], "doc_id long, text string")
    assert all(r.component_id == r.doc_id for r in find(docs).collect())
    return seen


def test_unrelated_texts_share_no_table(spark, monkeypatch):
    assert listed(spark, monkeypatch, simhash, simhash.similar, 3000) == [0]


def test_unrelated_sets_share_no_list(spark, monkeypatch):
    assert listed(spark, monkeypatch, jaccard, jaccard.near_copies, 60) == [0]  # most of their shingles are in several


def test_two_nodes_of_many_lists_meet_once(spark, monkeypatch):
    rows, seen, meetings = [], [], shared.meetings
    monkeypatch.setattr(shared, "meetings", lambda *of: seen.append(meetings(*of).count()) or meetings(*of))
    monkeypatch.setattr(shared, "KNOWN_LISTS", 8)
    sets = {node: {t for t in range(90) if (node * 7 + t * t) % 3} for node in range(40)}
    lists = spark.createDataFrame([(t, node) for node, ts in sets.items() for t in ts], "token long, node long").withColumn("root", F.col("node"))

    def none_similar(pairs):
        rows.extend((r.a, r.b) for r in pairs.collect())
        return pairs.where("FALSE")

    assert shared.linked(lists, [], lambda: F.lit(True), none_similar).collect() == []
    assert sorted(rows) == [(a, b) for a in range(40) for b in range(a + 1, 40) if sets[a] & sets[b]]
    assert sum(seen) == len(rows)


def test_tags_only_where_doc_ids_repeat(spark, monkeypatch):
    seen, cut_of = [], suffix_dedup.cut
    monkeypatch.setattr(suffix_dedup, "cut", lambda df, name: seen.append(df.agg(F.max(F.shiftright("place", 32))).first()[0]) or cut_of(df, name))
    rows = [(1, "abcdefghij" * 9), (2, "x" + "abcdefghij" * 9), (3, "other " * 20)]
    for more in ([], [(2, "y" + "abcdefghij" * 9)]):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string")
        got = suffix_dedup.remove_repeats(docs).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got) == brute_removal(rows + more)
    assert seen[0] == 0 < seen[1]
