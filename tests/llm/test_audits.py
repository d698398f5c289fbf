"""The Jaccard join, the filter audit and the divergence audit against plain loops; mended edges."""

import random
import re
import time
from collections import Counter
from itertools import combinations, permutations

from pyspark.sql import functions as F

from trailmark.llm import divergence, filter_audit, jaccard, licenses, pii, quality_model, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ", node string, token string, root string, part string, key string, mask string, n string, term string, item string, rank string, hub string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def clashing(spark, rows):
    return spark.createDataFrame([(*r, *(["x"] * 11)) for r in rows], DOCS + CLASHING)


def near_texts(rng, n):
    """Short, long and middling texts, copies with few changes, equal ones, chains, blanks and nulls."""
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(400)]
    texts = [None, "", " \n", "one", "ONE", "one two", "one two three"]
    for size in (3, 5, 9, 11, 12, 14, 19, 20, 21, 25, 30, 39, 41, 60, 120):
        base = [rng.choice(words) for _ in range(size + 2)]
        for _ in range(n):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 1, 2))):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice(([], [rng.choice(words)], [copy[at], rng.choice(words)]))
            texts.append(" ".join(copy))
    passage = " ".join(rng.choice(words) for _ in range(50))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.choice((3, 30, 60)))) for _ in range(3 * n)]
    return texts


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute_components(rows):
    sets = [shingle_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(filter(lambda x: x is not None, (least.get(find(i)), r[0])), default=None)
    return sorted(str((r[0], len(sets[i]), least[find(i)])) for i, r in enumerate(rows))


def test_jaccard_join_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    texts = near_texts(rng, 6)
    ids = rng.sample(range(1000), len(texts))
    rows = [(i, t, None, None, 0) for i, t in zip(ids, texts, strict=True)] + [(None, texts[20], None, None, 0), (None, "all alone", None, None, 0), (ids[30], texts[30], None, None, 0), (ids[31], texts[40], None, None, 0)]
    docs, want = clashing(spark, rows), brute_components(rows)
    assert sorted(str(tuple(r)) for r in jaccard.near_copies(docs).collect()) == want
    for only in (0, 39):
        monkeypatch.setattr(jaccard, "boundary", lambda *_, only=only: only)
        assert sorted(str(tuple(r)) for r in jaccard.near_copies(docs).collect()) == want
    assert jaccard.near_copies(docs.where("FALSE")).collect() == []


def test_a_large_group_of_near_copies_takes_few_pairs(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:100], f"x{i}", *base[100:]]), None, None, 0) for i in range(300)]
    nodes = {r.component_id for r in jaccard.near_copies(spark.createDataFrame(rows, DOCS)).collect()}
    assert nodes == {0}


def test_boundary_goes_by_cost(spark):
    sizes = lambda n, m: spark.createDataFrame([(n, i) for i in range(m)], "n long, node long")
    assert jaccard.boundary(sizes(9, 50)) >= 9 and jaccard.boundary(sizes(38, 50)) < 39
    assert jaccard.n_subsets(9, 90) == 1 and jaccard.n_subsets(10, 90) == 11 and jaccard.n_subsets(20, 90) == 211


def brute_audit(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    least, masks = {}, []
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, text, _, source, _ in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least[t])
        masks.append((source or "", {"ABCDE"[k] for k in range(5) if fails[k]}, i in good, i in toxic))
    out = []
    for part in {m[0] for m in masks}:
        mine = [m for m in masks if m[0] == part]
        first = Counter(next(x for x in o if x in m[1]) for o in permutations("ABCDE") for m in mine if m[1])
        for o in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(o, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                fails = [m for m in mine if f in m[1]]
                out.append((part, "".join(o), step, len(left), len(gone), len(fails) - len(gone), sum(m[1] == {f} for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone), first[f]))
    return sorted(map(str, out))


def test_filter_audit_retracts_across_files(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", "short one", "Has # mark", " ".join(f"w{i}" for i in range(250)), "WORD " * 300, " ".join(f"W{i} & x" for i in range(120)), " ".join(f"é{i}" for i in range(210))]
    rows = [(rng.randrange(40), rng.choice(texts), None, rng.choice(["a", "b", None]), 0) for _ in range(60)] + [(None, "short one", None, "a", 0), (None, None, None, None, 0)]
    rows.sort(key=lambda r: -(r[0] or 99))  # smaller ids arrive in later files
    for i in range(0, len(rows), 8):
        clashing(spark, rows[i : i + 8]).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
        time.sleep(0.01)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in [*range(0, 40, 2), 4, 4, None]]
    found = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute_audit(rows, [x for x in labels if x[0] is not None])
    for files in (1, 100):
        got = filter_audit.audit(spark, str(tmp_path / "docs"), found, files_per_batch=files).collect()
        assert sorted(str(tuple(r)) for r in got) == want


def test_filter_audit_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "docs"))
    assert filter_audit.audit(spark, str(tmp_path / "docs"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def brute_divergence(rows):
    docs = [((r[2] or ""), (r[3] or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t in df if df[t] >= 3]

        def shares(group, kept=kept):
            n = Counter(t for d in group for t in d[2])
            den = sum(n[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (n[t] + 1) // den for t in kept}, n

        whole = shares(mine)[0]
        of = {s: shares([d for d in mine if d[1] == s]) for s in {d[1] for d in mine}}
        for s, (p, n) in of.items():
            pair = [(x, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)) for x, (q, _) in of.items() if x != s]
            term = [(t, (p[t] - whole[t]) ** 2 // whole[t]) for t in kept if n[t] and p[t] > whole[t]]
            for part, items, top in (("pair", pair, None), ("term", term, 200)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:top]
                out += [(lang, s, part, x, v, i) for i, (x, v) in enumerate(ranked, 1)]
    return sorted(map(str, out))


def test_divergence_equals_word_by_word(spark):
    rng = random.Random(6)
    vocabulary = [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)] + ["Éa", "éa", "ß", "日本", "\U0001f600"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = [(i, " ".join(rng.choices(vocabulary[k % 3 * 20 :], weights[k % 3 * 20 :], k=rng.randint(0, 80))).replace("ta", "TA") + "9_x", rng.choice(["en", "fr", None]), f"s{k % 3}", 0) for k, i in enumerate(range(150))]
    rows += [(0, None, "xx", "a", 0), (1, "", "xx", None, 0), (2, "once", "xx", "b", 0), rows[0], rows[0]]
    got = divergence.audit(clashing(spark, rows))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_divergence(rows)
    assert divergence.audit(clashing(spark, [])).collect() == []


def test_short_lists_keep_ties_in_byte_order(spark):
    rows = [(i, " ".join(f"w{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(30)), "en", "a", 0) for i in range(4)] + [(9, "other words", "en", "b", 0)]
    terms = divergence.term_counts(spark.createDataFrame(rows, DOCS))
    got = divergence.top_terms(terms, divergence.groups(spark.createDataFrame(rows, DOCS), terms), top=5).where("source = 'a'").orderBy("rank").collect()
    assert [(r.item, r["rank"]) for r in got] in ([], [("waa", 1), ("wab", 2), ("wac", 3), ("wad", 4), ("wae", 5)])


def test_fully_equal_rows_are_dealt_evenly(spark):
    rows = [(7, "the very same text", "en", "s", 0)] * 600 + [(i, f"text number {i} " * 3, "en", "s", 0) for i in range(600)]
    got = sharding.shard(spark.createDataFrame(rows, DOCS), shards=6).collect()
    sizes, slots = Counter(), Counter()
    for r in got:
        sizes[r.shard] += r["size"]
        slots[r.shard] += 1
    assert len(got) == 1200 and max(sizes.values()) < 1.05 * min(sizes.values())
    assert {(r.shard, r.slot) for r in got} == {(s, i) for s, n in slots.items() for i in range(n)}


def test_token_scan_is_linear(spark):
    text = "-eyJaaaaaaaaaaaa" * 250_000
    began = time.time()
    docs = spark.createDataFrame([(1, text + " a@b.cd"), (2, "x eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    assert got[1].n_email == 1 and "secret" in got[2].spans and time.time() - began < 60


def test_no_labels_no_scores(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (2, None, None, None, None)], DOCS)
    for labels in ([], [(1, 1, 0)]):
        got = quality_model.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert sorted(r.doc_id for r in got) == [1, 2] and all(r.score is None and r.kept is None for r in got)


def test_reserved_rights_beside_a_licence_claim_nothing(spark):
    rows = [(1, "All rights reserved.\n\nLicensed under the MIT License."), (2, "All rights reserved.")]
    got = {r.doc_id: r.licences for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("n", F.lit(1)).collect()}
    assert got[2] == "Proprietary" and "Proprietary" not in got[1].split(",") and got[1]
