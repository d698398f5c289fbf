"""Benchmark decontamination by latent semantic retrieval.

1. *Statistics.* Document frequencies of the benchmark's words are counted over all documents.
2. *Index.* A randomised SVD of the TF-IDF passages (all items of a block, and ``FIT_WINDOWS``
   windows at most of each of at most ``FIT_DOCS`` documents picked by a hash, a bounded sample) gives the latent space of ``RANK``
   dimensions: each pass over the passages adds up A'(A W) by partition. Items weigh as much as
   the sample together.
3. *Candidates.* Every document is cut into windows of about the items' lengths, a quarter of a
   window apart. All windows are folded into the latent space and compared with all items of that
   length; nothing is sorted out before.
   Items that this search could miss don't depend on it: every stretch with enough of such an
   item's words, counted exactly, is a candidate. These are items shorter than any window, faint
   items, which the latent space keeps less than ``FAINT`` of, and light items, whose words are so frequent (or which are
   themselves leaked so widely) that a few other words in a window hide them from the cosine.
4. *Checks.* The longest common subsequence of words between a candidate and its item, in
   stretches a quarter longer than the item, must cover 0.8 of the item; from 0.6 on it is a
   paraphrase if the item's answer (its last sentence) is there too, to at least 0.9.

Items are the stated query set. They are on the driver, and each block of ``BLOCK_ITEMS`` is held
by every task; a row goes through all blocks in one pass and never meets another row, so the
number of blocks doesn't change a result.

Defined results: words are lower-cased (A-Z), ASCII punctuation divides them; a null or empty
text is clean; items with fewer than ``MIN_WORDS`` words, null ones too, match nothing; repeated
items each count, repeated documents are each judged; an empty benchmark leaves all documents
clean; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.shared import cut

MIN_WORDS = 5
COSINE = 0.45
LCS = 0.8
PARAPHRASE = 0.6
ANSWER = 0.9
FIT_DOCS = 500
BLOCK_ITEMS = 500
FIT_WINDOWS = 256
RANK = 160
FAINT = 0.85
OVERSAMPLE = 16
POWER = 2
#: An item is light if the words of a paraphrase in a window weigh, on the average, less than this
#: beside other words: what a window a quarter of a step off holds of it then misses the cosine.
_SHARE = PARAPHRASE * 7 / 8
LIGHT = ((1 - _SHARE) / (_SHARE**2 / COSINE**2 - _SHARE)) ** 0.5
SEED = 20240101
_WIDTHS = (16, 24, 32, 44, 64, 92, 128, 180, 256, 364, 512, 724, 1024)
#: Windows start and end at multiples of this many words.
_CHUNK = 4
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 58 <= c < 97 or 123 <= c < 128 else c for c in range(256))
_ROWS = 1024
_PIECE = 1 << 12


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def answer_of(text: str) -> list[bytes]:
    """Words of the last sentence that has any."""
    parts = [words(p.encode()) for p in re.split(r"[.!?\n]+", text)]
    return next((p for p in reversed(parts) if p), [])


def width_of(n: int) -> int:
    """The window for items of n words: the largest width that isn't longer, if any."""
    return max(w for w in _WIDTHS if w <= max(n, _WIDTHS[0]))


class Lcs:
    """Longest common subsequence with fixed words, bit-parallel."""

    def __init__(self, item: list[bytes]):
        self.n, self.full, self.places = len(item), (1 << len(item)) - 1, {}
        for i, w in enumerate(item):
            self.places[w] = self.places.get(w, 0) | 1 << i

    def masks(self, found: list[bytes]) -> list[int]:
        """The places of each word in the fixed ones."""
        get = self.places.get
        return [get(w, 0) for w in found]

    def length(self, masks: list[int]) -> int:
        v = self.full
        for m in masks:
            if m:
                u = v & m
                v = (v + u | v - u) & self.full
        return self.n - v.bit_count()


@dataclass
class Index:
    """What every task holds of a block of items."""

    ids: list[int]
    item_words: list[list[bytes]]
    answers: list[list[bytes]]
    vocabulary: dict[bytes, int]
    idf: np.ndarray  # the last entry is that of all other words
    latent: np.ndarray | None = None  # the items in the latent space, of length one
    space: np.ndarray | None = None  # what each word adds to a window there
    #: For each width its items, and what each word adds to a window's product with each of them
    #: there (other words nothing): folding a window and multiplying it is adding these up.
    classes: list[tuple[int, np.ndarray, np.ndarray]] | None = None
    exact: np.ndarray | None = None  # the items that are in no class


def _columns(batch: pa.RecordBatch):
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def _document_counts(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """(term, n) of the vocabulary, and the number of documents as term -1."""
    known, counts, docs = vocabulary.value, {}, 0
    for batch in batches:
        for _, text in _columns(batch):
            docs += 1
            for w in known.keys() & set(words(text)):
                counts[known[w]] = counts.get(known[w], 0) + 1
    counts[-1] = docs
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])


def _dense(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows over the vocabulary of the windows [start, end) of ``ids``."""
    n = ends - starts
    row = np.repeat(np.arange(len(n)), n)
    term = ids[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    out = np.zeros((len(n), len(idf)), np.float32)
    np.add.at(out, (row, term), idf[term])
    return out[:, :-1]


def _windows(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows of documents that lie one after another, about a quarter of
    a window apart."""
    step = width // (4 * _CHUNK) * _CHUNK
    n = np.maximum(1, -(-(sizes - width) // step) + 1) * (sizes >= MIN_WORDS)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), n)
    starts = first[owner] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step
    return starts, np.minimum(starts + width, (first + sizes)[owner])


def _passages(batches: Iterator[pa.RecordBatch], vocabulary, width: int) -> Iterator[pa.RecordBatch]:
    """At most ``FIT_WINDOWS`` windows of each document, as terms of the vocabulary."""
    known = vocabulary.value
    for batch in batches:
        for _, text in _columns(batch):
            ids = np.array([known.get(w, len(known)) for w in words(text)], np.int32)
            starts, ends = _windows(np.array([len(ids)]), width)
            if len(starts) > FIT_WINDOWS:
                spread = np.linspace(0, len(starts) - 1, FIT_WINDOWS).astype(int)
                starts, ends = starts[spread], ends[spread]
            if len(starts):
                yield pa.RecordBatch.from_arrays([pa.array([ids[s:e] for s, e in zip(starts, ends, strict=True)], pa.list_(pa.int32())), pa.array(np.ones(len(starts)))], ["terms", "weight"])


def _products(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """The partition's part of A'(A W), in slices of terms."""
    idf, basis = held.value
    total = np.zeros(basis.shape)
    for batch in batches:
        weight = batch.column(1).to_numpy()
        terms = [np.asarray(t.as_py(), np.int64) for t in batch.column(0)]
        for i in range(0, len(terms), _ROWS):
            part = terms[i : i + _ROWS]
            sizes = np.array([len(t) for t in part])
            rows = _dense(np.concatenate(part), np.cumsum(sizes) - sizes, np.cumsum(sizes), idf) * weight[i : i + _ROWS, None].astype(np.float32)
            total += rows.T @ (rows @ basis)
    for i in range(0, len(total), 256):
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i : i + 256].tobytes()], pa.binary())], ["slice", "part"])


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in table.column("part"))
    return pa.table({"slice": table.column("slice")[:1], "part": pa.array([total.tobytes()], pa.binary())})


def randomised_svd(passages: DataFrame, idf: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors (terms x rank) of the TF-IDF rows of ``passages`` (terms,
    weight): a random basis is multiplied by A'A a few times, orthonormal in between."""
    spark, width = passages.sparkSession, min(rank + OVERSAMPLE, len(idf) - 1)
    basis = np.random.default_rng(SEED).standard_normal((len(idf) - 1, width))
    for _ in range(POWER + 1):
        held = spark.sparkContext.broadcast((idf, basis.astype(np.float32)))
        parts = passages.mapInArrow(lambda it, held=held: _products(it, held), "slice int, part binary")
        rows = parts.groupBy("slice").applyInArrow(_added, "slice int, part binary").orderBy("slice").collect()
        product = np.concatenate([np.frombuffer(r["part"]).reshape(-1, width) for r in rows])
        basis, scale, _ = np.linalg.svd(product, full_matrices=False)
    return basis[:, :rank][:, scale[:rank] > 1e-9 * max(scale[0], 1e-300)].astype(np.float32)


def fit_sample(texts: DataFrame, n_docs: int, most: int = FIT_DOCS) -> DataFrame:
    """At most ``most`` texts, picked by a hash over its whole range (twice as many are expected
    below the limit, of which the smallest hashes are taken)."""
    order = F.xxhash64("doc_id", F.xxhash64("text"))
    limit = min((1 << 63) - 1, -(1 << 63) + (2 * most << 64) // max(n_docs, 1))
    return cut(texts.where(order <= F.lit(limit)).orderBy(order).limit(most).select("doc_id", "text"), "fit-texts")


def word_counts(texts: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """Document frequencies of the vocabulary over all documents, and their number."""
    held = texts.sparkSession.sparkContext.broadcast(vocabulary)
    counted = texts.mapInArrow(lambda it: _document_counts(it, held), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(vocabulary) + 1)
    for r in counted:
        df[r["term"]] = r["n"]
    return df[:-1], int(df[-1])


def word_weights(vocabulary: dict[bytes, int], df: np.ndarray, n_docs: int) -> tuple[dict[bytes, float], float]:
    """The weight of each word, which is positive, and what a word of a document weighs on the
    (quadratic) average."""
    idf = np.log((1 + n_docs) / (1 + df)) + 0.1
    return dict(zip(vocabulary, idf.tolist(), strict=True)), float(np.sqrt((df * idf**2).sum() / max(1, df.sum())))


def build_index(sample: DataFrame, items: list[tuple[int, str]], idf_of: dict[bytes, float], usual: float, rank: int = RANK, keep_space: bool = False) -> Index:
    """The index of a block of items, fitted on them and on the texts of ``sample``; ``usual`` is
    the average weight of a document's words."""
    spark = sample.sparkSession
    token = [words(t.encode()) for _, t in items]
    vocabulary = {w: i for i, w in enumerate(sorted({w for t in token for w in t}))}
    idf = np.array([idf_of[w] for w in vocabulary] + [0.0])
    idf[-1] = idf[:-1].mean()
    index = Index([i for i, _ in items], token, [answer_of(t) for _, t in items], vocabulary, idf.astype(np.float32))
    width = width_of(int(np.median([len(t) for t in token])))
    held = spark.sparkContext.broadcast(vocabulary)
    passages = cut(sample.mapInArrow(lambda it: _passages(it, held, width), "terms array<int>, weight double"), "passages")
    weight = max(1.0, passages.count() / len(items)) ** 0.5
    own = spark.createDataFrame([([vocabulary[w] for w in t], weight) for t in token], "terms array<int>, weight double")
    space = randomised_svd(passages.union(own), index.idf, rank)
    sizes = np.array([len(t) for t in token])
    flat, begin = np.array([vocabulary[w] for t in token for w in t]), np.cumsum(sizes) - sizes
    index.space = space * index.idf[:-1, None]
    latent = np.add.reduceat(index.space[flat], begin)
    square = np.array([sum((index.idf[vocabulary[w]] * c) ** 2 for w, c in Counter(t).items()) for t in token])
    kept = np.linalg.norm(latent, axis=1)
    index.latent = latent / np.maximum(kept, 1e-9)[:, None]
    light = np.sqrt(square) < LIGHT * usual * np.sqrt(sizes)
    hidden = light | (kept < FAINT * np.sqrt(square)) | (sizes < _WIDTHS[0])
    widths = np.array([width_of(n) for n in sizes])
    index.exact = np.flatnonzero(hidden)
    index.classes = []
    for w in np.unique(widths[~hidden]):
        of_width = np.flatnonzero((widths == w) & ~hidden)
        index.classes.append((int(w), of_width, np.vstack((index.space @ index.latent[of_width].T, np.zeros((1, len(of_width)), np.float32)))))
    index.space = index.space if keep_space else None
    return index


def candidates(index: Index, ids: np.ndarray, sizes: np.ndarray, cosine: float) -> Iterator[tuple[int, int, int, float]]:
    """(start, end, item, cosine) of all windows near an item in the latent space; ``ids`` are the
    words of documents of these ``sizes``, one after another.

    The cosine takes a window's words as different ones, so it is the real one or more.
    """
    mass = np.concatenate(([0], np.cumsum(index.idf[ids].astype(np.float64) ** 2)))
    # Documents are padded to whole chunks with a word that adds nothing.
    chunks = -(-sizes // _CHUNK)
    first, first_chunk = np.cumsum(sizes) - sizes, np.cumsum(chunks) - chunks
    padded = np.full(chunks.sum() * _CHUNK, len(index.vocabulary), np.int64)
    padded[np.arange(len(ids)) + np.repeat(first_chunk * _CHUNK - first, sizes)] = ids
    for width, items, adds in index.classes:
        starts, ends = _windows(sizes, width)
        owner = np.searchsorted(first, starts, side="right") - 1
        low, high = (first_chunk[owner] + -(-(x - first[owner]) // _CHUNK) for x in (starts, ends))
        least = (cosine * np.sqrt(np.maximum(mass[ends] - mass[starts], 1e-9))).astype(np.float32)
        for at in range(0, chunks.sum(), _PIECE):
            part = padded[at * _CHUNK : (at + _PIECE) * _CHUNK + _WIDTHS[-1]]
            total = np.zeros((len(part) // _CHUNK + 1, len(items)), np.float32)
            for k in range(_CHUNK):
                total[1:] += adds[part[k::_CHUNK]]
            np.cumsum(total, axis=0, out=total)
            a, b = np.searchsorted(low, (at, at + _PIECE))
            near = total[high[a:b] - at]
            near -= total[low[a:b] - at]
            for row, item in zip(*np.nonzero(near >= least[a:b, None]), strict=True):
                yield int(starts[a + row]), int(ends[a + row]), int(items[item]), float(near[row, item] * cosine / least[a + row])


def stretches(index: Index, ids: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, end, item) of all stretches of documents that hold enough words of an item of no
    class to pass its check; those that overlap are one."""
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    of_item = np.zeros(len(index.idf), bool)
    for item in index.exact:
        n = len(index.item_words[item])
        size, least = -(-5 * n // 4), int(np.ceil(PARAPHRASE * n))
        terms = [index.vocabulary[w] for w in index.item_words[item]]
        of_item[terms] = True
        count = np.concatenate(([0], np.cumsum(of_item[ids], dtype=np.int32), np.zeros(size, np.int32)))
        of_item[terms] = False
        count[len(ids) + 1 :] = count[len(ids)]
        start = np.flatnonzero(count[size : size + len(ids)] - count[: len(ids)] >= least)
        upto = bounds[np.searchsorted(bounds, start, side="right")]
        end = np.minimum(start + size, upto)
        enough = count[end] - count[start] >= least
        start, end, upto = start[enough], end[enough], upto[enough]
        if len(start):
            first = np.flatnonzero(np.append(True, (start[1:] > end[:-1]) | (upto[1:] != upto[:-1])))
            last = np.append(first[1:], len(start)) - 1
            yield from zip(start[first].tolist(), end[last].tolist(), [int(item)] * len(first), strict=True)


def check(found: list[bytes], item: list[bytes], lcs: Lcs, answer: list[bytes]) -> tuple[float, bool]:
    """Best cover of the item by a common subsequence with a stretch of ``found`` (zero where it
    is less than a paraphrase's); whether the paraphrase's answer is in that stretch."""
    n = len(item)
    size, step = -(-5 * n // 4), max(1, n // 8)
    masks, least = lcs.masks(found), math.ceil(PARAPHRASE * n)
    if lcs.length(masks) < least:
        return 0.0, False
    best, at = 0, 0
    starts = range(0, max(1, len(found) - size + step), step)
    for k in range(0, len(starts), 4):
        # What four stretches have together bounds each of them.
        if lcs.length(masks[starts[k] : starts[k] + size + 3 * step]) < max(least, best + 1):
            continue
        for i in starts[k : k + 4]:
            if (got := lcs.length(masks[i : i + size])) > best:
                best, at = got, i
        if best == n:
            break
    cover = best / n
    there = False
    if answer and PARAPHRASE <= cover < LCS:
        last = Lcs(answer)
        there = last.length(last.masks(found[at : at + size])) >= ANSWER * len(answer)
    return cover, there


def _judge(batches: Iterator[pa.RecordBatch], held, cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows (row, text, item_ids, cover) with what the items of a block add to the last two."""
    index: Index = held.value
    known, other = index.vocabulary, len(index.vocabulary)
    checks = [Lcs(t) for t in index.item_words]
    for batch in batches:
        matches: list[dict[int, float]] = [{} for _ in range(batch.num_rows)]
        texts = batch.column(1).to_pylist()
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (size == 0 or size < 1 << 20):
                size += len(texts[upto] or b"")
                upto += 1
            tokens = [words(t) for t in texts[at:upto]]
            sizes = np.array([len(t) for t in tokens])
            bounds = [0, *np.cumsum(sizes).tolist()]
            flat = [w for t in tokens for w in t]
            seen: dict[tuple[int, int], int] = {}
            if flat:
                coded = np.array([known.get(w, other) for w in flat], np.int64)
                for start, end, item, _ in candidates(index, coded, sizes, cosine):
                    doc = bisect.bisect_right(bounds, start) - 1
                    n = len(index.item_words[item])
                    if matches[at + doc].get(item, 0) >= 1 or seen.get((doc, item), -1) >= end:
                        continue
                    low, high = max(bounds[doc], start - n), min(bounds[doc + 1], end + n)
                    seen[doc, item] = high - n // 2
                    cover, paraphrase = check(flat[low:high], index.item_words[item], checks[item], index.answers[item])
                    if cover >= LCS or paraphrase:
                        matches[at + doc][item] = max(cover, matches[at + doc].get(item, 0))
                for start, end, item in stretches(index, coded, sizes):
                    doc = bisect.bisect_right(bounds, start) - 1
                    cover, paraphrase = check(flat[start:end], index.item_words[item], checks[item], index.answers[item])
                    if cover >= LCS or paraphrase:
                        matches[at + doc][item] = max(cover, matches[at + doc].get(item, 0))
            at = upto
        found = [sorted({*before, *(index.ids[k] for k in m)}) for before, m in zip(batch.column(2).to_pylist(), matches, strict=True)]
        best = [max(m.values(), default=before) for before, m in zip(batch.column(3).to_pylist(), matches, strict=True)]
        best = np.maximum(best, batch.column(3).to_numpy()) if len(best) else best
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64())), pa.array(best, pa.float64())], ["row", "text", "item_ids", "cover"])


def _items(benchmark: DataFrame) -> list[tuple[int, str]]:
    """The items with enough words. All are on the driver: the benchmark is the stated query set."""
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator()
    return [(r["item_id"], r["text"]) for r in rows if len(words(r["text"].encode())) >= MIN_WORDS]


def _judged(docs: DataFrame, benchmark: DataFrame, cosine: float, block_items: int) -> DataFrame:
    """Every row of ``docs`` as a struct ``row``, with item_ids and cover."""
    text = F.col("text").cast("binary").alias("text")
    judged = docs.select(F.struct("*").alias("row"), text, F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("cover"))
    items = _items(benchmark)
    if items:
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, t in items for w in words(t.encode())}))}
        df, n_docs = word_counts(texts, vocabulary)
        idf_of, usual = word_weights(vocabulary, df, n_docs)
        sample = fit_sample(texts, n_docs)
        schema = judged.schema
        for i in range(0, len(items), block_items):
            held = docs.sparkSession.sparkContext.broadcast(build_index(sample, items[i : i + block_items], idf_of, usual))
            judged = judged.mapInArrow(lambda it, held=held: _judge(it, held, cosine), schema)
    return judged


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row for each document: doc_id, contaminated, item_ids (those it leaks), cover (of the
    best one by the common subsequence)."""
    judged = _judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, cosine, block_items)
    return judged.select("row.doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "cover")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The documents without those that leak an item, with their own columns."""
    return _judged(docs, benchmark, cosine, block_items).where(F.size("item_ids") == 0).select("row.*")
