"""Quality classifier by co-training of two views.

The *text view* sees hashed words and word endings, immediate repetitions and the share of
distinct words. The *metadata view* sees language, source, declared length and the layout (lines,
symbols, capitals, digits, repeated lines). ``views`` computes both for all documents. Each view
is a logistic regression fitted on a bounded, hash-chosen sample of labelled documents. Then, for
some rounds, Spark scores every unlabelled document with both; the most confident labels of each
view, out of all unlabelled documents, go to the other view's training set. On held-out labels
each view is calibrated, a regression combines the calibrated views, and Spark scores all
documents.

Bounds, parameters of ``fit``: ``most_labelled`` labelled documents (others are left out by the
order of a hash of doc_id) and ``exchanged`` pseudo-labels a view and round. Everything else
covers all rows.

Defined results: a null text is empty; null or new languages and sources share hashed columns;
several labels of one document count as their mean, rounded; null labels are ignored; of rows
that repeat a doc_id one trains; equal scores count as one document in the exchange; without
labels of both classes ``fit`` raises ValueError and ``classify`` gives null scores; repeated documents are each scored; an empty
table of documents gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.shared import cut

MOST_LABELLED = 3000
EXCHANGED = 100
ROUNDS = 4
CONFIDENT = 1.0
THRESHOLD = 0.5
DIMS = 1024
_EXTRA = 3
_LANGS, _SOURCES, _LAYOUT = 16, 64, 8
_SYMBOLS = b"#*$%&|<>!=_~^{}[]@\\/"
_CAPITALS = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MOST_WORDS = 500_000


class Words:
    """Hashed columns of words: that of the word and that of its last three bytes. Remembers
    words up to a bound, then starts anew."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def columns(self, words: list[bytes]) -> np.ndarray:
        """For each word, both columns in one number."""
        known, out = self.known, []
        if len(known) > _MOST_WORDS:
            known.clear()
        for w in words:
            at = known.get(w)
            if at is None:
                at = known[w] = (zlib.crc32(w.lower()) % (DIMS // 2)) * DIMS + DIMS // 2 + zlib.crc32(w[-3:]) % (DIMS // 2)
            out.append(at)
        return np.array(out, np.int64)


def text_view(text: bytes, hashed: Words) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the text view; a row has length one, but for the last columns."""
    both = hashed.columns(text.split())
    n = len(both)
    if not n:
        return np.array([DIMS]), np.ones(1, np.float32)
    column, count = np.unique(np.concatenate((both // DIMS, both % DIMS)), return_counts=True)
    value = np.sqrt(count)
    value /= np.linalg.norm(value)
    extra = [1.0, (both[1:] == both[:-1]).mean() if n > 1 else 0.0, len(np.unique(both)) / n]
    return np.concatenate((column, DIMS + np.arange(_EXTRA))), np.concatenate((value, extra)).astype(np.float32)


def metadata_view(text: bytes, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Row of the metadata view."""
    out = np.zeros(_LAYOUT + _LANGS + _SOURCES, np.float32)
    n = max(1, len(text))
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip()]
    out[:_LAYOUT] = (
        np.log1p(max(n_chars or 0, 0)),
        np.log1p(len(text)),
        np.log1p(n / len(lines)),
        (len(text) - len(text.translate(None, _SYMBOLS))) / n,
        (len(text) - len(text.translate(None, _CAPITALS))) / n,
        (len(text) - len(text.translate(None, _DIGITS))) / n,
        1 - len(set(full)) / max(1, len(full)),
        1.0,
    )
    out[_LAYOUT + zlib.crc32((lang or "").encode()) % _LANGS] = 1
    out[_LAYOUT + _LANGS + zlib.crc32((source or "").encode()) % _SOURCES] = 1
    return out


@dataclass
class Regression:
    """Logistic regression on scaled columns."""

    weights: np.ndarray
    center: np.ndarray
    scale: np.ndarray

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.center) / self.scale) @ self.weights[:-1] + self.weights[-1]


def _fit(rows: np.ndarray, labels: np.ndarray, scaled: bool, ridge: float = 1e-3, steps: int = 150) -> Regression:
    """Accelerated gradient descent; classes weigh alike."""
    center = rows.mean(axis=0) if scaled else np.zeros(rows.shape[1], np.float32)
    scale = np.maximum(rows.std(axis=0), 1e-3) if scaled else np.ones(rows.shape[1], np.float32)
    x = np.column_stack(((rows - center) / scale, np.ones(len(rows)))).astype(np.float32)
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())).astype(np.float32)
    labels = labels.astype(np.float32)
    # A few products estimate the largest curvature, which gives the step.
    v = np.ones(x.shape[1], np.float32)
    for _ in range(8):
        v = x.T @ (share * (x @ (v / np.linalg.norm(v))))
    rate = np.float32(1 / (0.25 * np.linalg.norm(v) * 1.2 + ridge))
    w = ahead = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - rate * (x.T @ (share * (p - labels)) + np.float32(ridge) * ahead)
        ahead, w = new + np.float32(k / (k + 3)) * (new - w), new
    return Regression(w, center, scale)


@dataclass
class Model:
    """Both views, the calibration of each (slope and bias of its logit) and the regression that
    combines the calibrated logits."""

    text: Regression
    metadata: Regression
    calibration: np.ndarray
    combined: np.ndarray

    def score(self, text_logit: np.ndarray, metadata_logit: np.ndarray) -> np.ndarray:
        both = np.column_stack((_line(text_logit, self.calibration[0]), _line(metadata_logit, self.calibration[1]), np.ones(len(text_logit))))
        return 1 / (1 + np.exp(-np.clip(both @ self.combined, -30, 30)))


def _line(logit: np.ndarray, line: np.ndarray) -> np.ndarray:
    return np.clip(logit, -20, 20) * line[0] + line[1]


def _flat(model: Regression) -> np.ndarray:
    """The weights of a scaled regression as those of its plain columns, the bias last."""
    slope = model.weights[:-1] / model.scale
    return np.append(slope, model.weights[-1] - slope @ model.center)


_VIEWS = "doc_id long, columns binary, vals binary, metadata binary"


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashed = Words()
    for batch in batches:
        columns, values, metadata = [], [], []
        for text, lang, source, n_chars in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            c, v = text_view(text, hashed)
            columns.append(c.astype(np.int16).tobytes())
            values.append(v.astype(np.float16).tobytes())
            metadata.append(metadata_view(text, lang, source, n_chars).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(4), *(pa.array(x, pa.binary()) for x in (columns, values, metadata))], ["doc_id", "columns", "vals", "metadata"])


def views(docs: DataFrame) -> DataFrame:
    """Both views of each document: doc_id, columns and vals of the text view, metadata."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(text.alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"), F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(_views, _VIEWS)


def _logits(batch: pa.RecordBatch, text: Regression, metadata: Regression) -> tuple[np.ndarray, np.ndarray]:
    """Logits of both views for a batch of ``views``."""
    if not batch.num_rows:
        return np.zeros(0), np.zeros(0)
    columns = batch.column(1).to_pylist()
    at = np.cumsum([0, *(len(c) // 2 for c in columns)])[:-1]
    products = text.weights[np.frombuffer(b"".join(columns), np.int16)] * np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float16)
    layout = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.float32).reshape(batch.num_rows, -1)
    return np.add.reduceat(products.astype(np.float64), at) + text.weights[-1], metadata.logits(layout).astype(np.float64)


def _both_logits(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, _logits(batch, *held.value))], ["doc_id", "text", "metadata"])


def _rows_of(table: DataFrame, ids: list[int]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Ids, text rows and metadata rows of some documents of ``views``, one row for each id."""
    chosen = table.sparkSession.createDataFrame([(i,) for i in ids], "wanted long")
    rows = table.join(F.broadcast(chosen), F.col("doc_id") == F.col("wanted"))  # as many ids as a bound of ``fit``
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("columns", "vals", "metadata")).alias("row")).orderBy("doc_id").collect()
    content = np.zeros((len(rows), DIMS + _EXTRA), np.float32)
    for i, r in enumerate(rows):
        content[i, np.frombuffer(r["row"]["columns"], np.int16)] = np.frombuffer(r["row"]["vals"], np.float16)
    metadata = [np.frombuffer(r["row"]["metadata"], np.float32) for r in rows]
    return [r["doc_id"] for r in rows], content, np.array(metadata, np.float32).reshape(len(rows), -1)


def confident(scored: DataFrame, view: str, n_low: int, n_high: int) -> dict[int, float]:
    """The surest labels of a view out of all rows of ``scored`` (doc_id, text, metadata): at most
    the lowest ``n_low`` logits as 0 and the highest ``n_high`` as 1, none nearer than ``CONFIDENT``."""
    low = scored.where(F.col(view) < -CONFIDENT).orderBy(view, "doc_id").limit(n_low).select("doc_id").collect()
    high = scored.where(F.col(view) > CONFIDENT).orderBy(F.desc(view), "doc_id").limit(n_high).select("doc_id").collect()
    return {r["doc_id"]: 0.0 for r in low} | {r["doc_id"]: 1.0 for r in high}


class NoModel(ValueError):
    """The labels don't have both classes."""


def _labelled(table: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, float]]:
    """All labels (marked, label), and those of at most ``most`` documents of ``views``."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("marked")).agg(F.round(F.avg("quality")).cast("int").alias("label"))
    marks = cut(marks, "marks")
    there = table.select("doc_id").where("doc_id IS NOT NULL").distinct().join(marks, F.col("doc_id") == F.col("marked"))
    return marks, {r["marked"]: float(r["label"]) for r in there.orderBy(F.xxhash64("marked", F.lit("sample"))).limit(most).collect()}


def fit_views(table: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, exchanged: int = EXCHANGED, rounds: int = ROUNDS) -> Model:
    """Co-train on a table of ``views``."""
    marks, label_of = _labelled(table, labels, most_labelled)
    if len(set(label_of.values())) < 2:
        raise NoModel("labels of both classes are needed")
    ids, *rows = _rows_of(table, list(label_of))
    label = np.array([label_of[i] for i in ids])
    shuffled = np.random.default_rng(len(label)).permutation(len(label))
    held, train = np.array_split(shuffled, [max(2, len(shuffled) // 4)])
    if len(set(label[train])) < 2 or len(set(label[held])) < 2:
        held = train = shuffled
    share = float((label[train] == 1).mean())
    counts = max(1, int(exchanged * (1 - share))), max(1, int(exchanged * share))
    taught = [[(rows[k][train], label[train])] for k in range(2)]
    used: list[set[int]] = [set(), set()]
    for turn in range(rounds + 1):
        models = [_fit(np.concatenate([x for x, _ in taught[k]]), np.concatenate([y for _, y in taught[k]]), scaled=k == 1) for k in range(2)]
        if turn == rounds:
            break
        shared = table.sparkSession.sparkContext.broadcast(models)
        scored = table.mapInArrow(lambda it, shared=shared: _both_logits(it, shared), "doc_id long, text double, metadata double")
        # One row for equal scores, as copies of one text would fill the list.
        free = scored.where("doc_id IS NOT NULL").join(marks, F.col("doc_id") == F.col("marked"), "left_anti").groupBy("text", "metadata").agg(F.min("doc_id").alias("doc_id"))
        free = cut(free, "unlabelled")
        for k, view in enumerate(("text", "metadata")):
            fresh = free.where(~F.col("doc_id").isin(sorted(used[1 - k]))) if used[1 - k] else free  # at most rounds x exchanged ids
            found = confident(fresh, view, *counts)
            used[1 - k] |= set(found)
            if found:
                own, *features = _rows_of(table, list(found))
                taught[1 - k].append((features[1 - k], np.array([found[i] for i in own])))
    first, second = (held[::2], held[1::2]) if len(held) >= 100 and len(set(label[held[::2]])) == len(set(label[held[1::2]])) == 2 else (held, held)
    logits = [np.clip(m.logits(r), -20, 20) for m, r in zip(models, rows, strict=True)]
    calibration = np.array([_flat(_fit(x[first, None].astype(np.float32), label[first], scaled=True, ridge=1e-2)) for x in logits])
    both = np.column_stack([_line(x[second], c) for x, c in zip(logits, calibration, strict=True)])
    return Model(*models, calibration, _flat(_fit(both.astype(np.float32), label[second], scaled=True, ridge=1e-2)))


def _score(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    model = held.value
    for batch in batches:
        content, layout = _logits(batch, model.text, model.metadata)
        score = model.score(content, layout)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.astype(np.float64)) for x in (content, layout, score)), pa.array(score >= THRESHOLD)], ["doc_id", "text_logit", "metadata_logit", "score", "kept"])


def score_views(table: DataFrame, model: Model) -> DataFrame:
    held = table.sparkSession.sparkContext.broadcast(model)
    return table.mapInArrow(lambda it: _score(it, held), "doc_id long, text_logit double, metadata_logit double, score double, kept boolean")


def fit(docs: DataFrame, labels: DataFrame, **parameters) -> Model:
    """Co-train both views."""
    return fit_views(cut(views(docs), "views"), labels, **parameters)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each document: doc_id, both logits, score (probability of good quality), kept."""
    return score_views(views(docs), model)


def classify(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """``score`` of all documents by a model fitted on them; the views are computed once. Without
    labels of both classes there is no model: scores and decisions are null."""
    table = cut(views(docs), "views")
    try:
        model = fit_views(table, labels, **parameters)
    except NoModel:
        nothing = F.lit(None)
        return table.select("doc_id", *[nothing.cast("double").alias(c) for c in ("text_logit", "metadata_logit", "score")], nothing.cast("boolean").alias("kept"))
    return score_views(table, model)
