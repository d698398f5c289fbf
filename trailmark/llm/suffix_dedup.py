"""Removal of repeated byte strings through suffix order and longest-previous-factor arrays.

A byte goes if a ``length``-byte string (50 by default) that covers it also starts in a document
with a smaller doc_id. The longest previous factor (LPF) of a suffix is the longest prefix that
also starts in a smaller document. In suffix order it is the larger of the common prefixes with
the previous smaller and the next smaller position (``longest_previous_factors``), and every
removal is an LPF of at least ``length``. The suffixes of a whole corpus don't fit one array, so
they are first dealt out by content, such that equal strings always meet:

1. *Anchors.* The smallest hash among the short grams of a string is its anchor; equal strings
   have equal anchors. Neighbouring strings mostly share one, so a text becomes a list of
   segments (anchor, sides, name, place), one for about 20 bytes. The name is a digest of the segment's
   bytes: equal names are neighbours in the order of the group, with the whole segment as common
   prefix. Each batch of texts has such an order of its own, and segments that it decides travel
   on under a key of their own, so a passage that a third of all documents share leaves a task
   under its anchor only once a batch.
2. *Named segments* meet under their anchor, are ordered by name, and their LPFs decide.
3. *Different segments of one anchor* (the rims of passages and of edits) can only share a string
   if some 20 bytes before the anchor's gram, or after it, are equal; 12 bits of each are the
   segment's sides. Those that are equal on a side are cut from their
   texts, and the suffixes that start in them are put in suffix order byte by byte, but for those
   whose first ``length`` bytes have a digest that no other document of the group has. The common
   prefixes of neighbours give the LPFs. Segments of hot sides are cut into single strings,
   which are dealt out by their own digests.
4. Covered places are merged for each document and cut from its bytes.

Whatever a task reads, its Python worker holds a few megabytes of texts, segments or strings (and a
whole text, if that is longer) beside the current Arrow batch. The shuffle of segments is dropped as
soon as their marks are a table.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; strings never
cross documents and are judged on the input; repeated rows with the same doc_id don't remove
each other (their texts are told apart by 31 bits of a hash, a tag that is zero in tables without such rows), nor do rows without a doc_id, which
counts as larger than every number (93 bits); a doc_id of 2**62 or more raises; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.shared import cut

LENGTH = 50
GRAM = 12
LONGEST_RUN = 63
BATCH_BYTES = 4 << 20
PIECE_BYTES = 1 << 18
HOT_ANCHOR = 2048
#: So many different segments of an anchor are gathered to find its hot sides; of more, all strings are hot.
MOST_HELD = 1 << 14
#: Rows that are Python objects at once, and single strings.
_ROWS, _STRINGS = 256, 1 << 16
#: Rows whose suffixes are put in order at once, with what is held of the last route.
_ORDERED = 2048
#: Document numbers from here on are rows without a doc_id; none is smaller than another.
_NO_ID = 1 << 62
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))
_COLD, _HOT = 2, 3
#: Anchors are 40 bits, which take less room in the shuffle; two that collide are one group. Below them are the
#: sides of a segment: 12 bits of what precedes its anchor's gram and 12 of what follows it, zero where no string of
#: the segment reaches that far. Segments in which the gram is repeated have no sides, all 24 bits are one.
_ANCHOR_BITS = ~0xFFFFFF
_SIDE_BITS = 12
_NO_SIDES = 0xFFFFFF


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the short grams that start at each byte."""
    wide = data.astype(np.uint64)
    for size in (1, 2, 4):
        wide = wide[:-size] | (wide[size:] << np.uint64(8 * size))
    x = (wide[: 8 - GRAM] * _M1) ^ (wide[GRAM - 8 :] * _M2)
    x ^= x >> np.uint64(32)
    x *= _M3
    return x ^ (x >> np.uint64(29))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def segments(data: bytes, bounds: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Segments of the documents that ``bounds`` (n + 1 offsets) cut ``data`` into.

    Returns anchor, digest, document index, start in the data, number of strings, sides; a segment
    with n strings covers n + length - 1 bytes.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty, empty
    hashes = _gram_hashes(np.frombuffer(data, np.uint8))
    anchors = _sliding_min(hashes, length - GRAM + 1)
    inside = np.zeros(len(anchors) + 1, bool)
    rise = np.zeros(len(anchors) + 1, np.int32)
    has = np.diff(bounds) >= length
    np.add.at(rise, bounds[:-1][has], 1)
    np.add.at(rise, bounds[1:][has] - length + 1, -1)
    inside[:-1] = np.cumsum(rise)[:-1] > 0
    first = inside[:-1].copy()
    first[1:] &= (anchors[1:] != anchors[:-1]) | ~inside[:-2]
    first[bounds[:-1][has]] = True
    starts = np.flatnonzero(first)
    stops = np.flatnonzero(~inside)
    ends = np.minimum(np.append(starts[1:], len(anchors)), stops[np.searchsorted(stops, starts)])
    if (ends - starts > LONGEST_RUN).any():
        parts = -(-(ends - starts) // LONGEST_RUN)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        ends = np.repeat(ends, parts)
        starts = np.repeat(starts, parts) + step * LONGEST_RUN
        ends = np.minimum(ends, starts + LONGEST_RUN)
    digest = xxhash.xxh64_intdigest
    digests = np.fromiter((digest(data[s:e]) for s, e in zip(starts.tolist(), (ends + (length - 1)).tolist(), strict=True)), np.uint64, len(starts))
    owner = np.searchsorted(bounds, starts, side="right") - 1
    return anchors[starts], digests, owner, starts, ends - starts, _sides(hashes, anchors[starts], starts, ends, length)


def _sides(hashes: np.ndarray, anchor: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """What segments have beside the first gram that is their anchor.

    Each string holds that gram and, by its place in the string, ``reach`` bytes before it or as
    many after it (or more). So two segments of an anchor that have a string in common are equal
    there before, or after.
    """
    span = length - GRAM
    reach, out = span // 2, np.empty(len(starts), np.int64)
    for i in range(0, len(starts), 1 << 13):
        s, e, a = (x[i : i + (1 << 13)] for x in (starts, ends, anchor))
        gram = s + (hashes[s[:, None] + np.arange(span + 1)] == a[:, None]).argmax(axis=1)
        sides = []
        for there, way in ((gram - s >= reach, -1), (gram - (e - 1) < reach, 1)):
            far, near = (hashes[np.clip(gram + way * by, 0, len(hashes) - 1)] for by in (reach, min(reach, GRAM)))
            x = ((far * _M2) ^ near) * _M3 >> np.uint64(64 - _SIDE_BITS)
            sides.append(np.where(there, np.clip(x.astype(np.int64), 1, (1 << _SIDE_BITS) - 2), 0))
        out[i : i + (1 << 13)] = np.where(gram < e - 1, _NO_SIDES, sides[0] << _SIDE_BITS | sides[1])
    return out


_SEGMENT = pa.schema([("anchor", pa.int64()), ("what", pa.int64()), ("doc", pa.int64()), ("place", pa.int64())])
_MARK = pa.schema([("kind", pa.int8()), ("anchor", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("n", pa.int32())])
_STRING = pa.schema([("route", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("n", pa.int32()), ("bytes", pa.binary())])
_COVERED = pa.schema([("doc", pa.int64()), ("place", pa.int64()), ("n", pa.int32())])


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.int8(): "tinyint", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the sorted columns differs from the row before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _first_of(new: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row the value of the first row of its group."""
    return values[new][np.cumsum(new) - 1]


def longest_previous_factors(lcp: np.ndarray, doc: np.ndarray, least: int = 1) -> np.ndarray:
    """LPF of each suffix of an array in suffix order: the longest prefix that also starts in a
    smaller document.

    ``lcp`` holds the common prefix with the suffix before, 0 where a group starts; ``doc`` the
    documents. From each side, the nearest position of a smaller document is found by jumping from
    a position to that position's own candidate, while the smallest common prefix passed is kept;
    a search ends where that falls below ``least``, so smaller factors may come out as less.
    """

    def one_side(lcp, doc):
        at, reach = np.arange(len(doc)) - 1, lcp.astype(np.int64)
        looking = np.flatnonzero(reach >= least)
        looking = looking[doc[at[looking]] >= doc[looking]]
        while len(looking):
            via = at[looking]
            low, back = np.minimum(reach[looking], reach[via]), at[via]
            reach[looking], at[looking] = low, back
            looking = looking[low >= least]
            looking = looking[doc[at[looking]] >= doc[looking]]
        return reach

    left = one_side(lcp, doc)
    right = one_side(np.concatenate((lcp[:1] * 0, lcp[:0:-1])), doc[::-1])[::-1]
    return np.maximum(left, right)


def _named_factors(anchor: np.ndarray, what: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """LPFs of segments sorted by anchor, name, document; those of different names count as none."""
    lcp = np.where(_starts(anchor, what), 0, (what & 63) + (length - 1))
    return longest_previous_factors(lcp, rank, length)


def _salt(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys that spread rows which need to meet no other."""
    x = (doc.astype(np.int64).view(np.uint64) * _M1) ^ (place.astype(np.int64).view(np.uint64) * _M2)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(doc, tag, text) lists of about ``most`` bytes."""
    docs, tags, texts, size = [], [], [], 0
    for batch in _slices(batches, _ROWS):
        for doc, tag, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            docs.append(doc)
            tags.append(tag)
            texts.append(text)
            size += len(text)
            if size >= most:
                yield docs, tags, texts
                docs, tags, texts, size = [], [], [], 0
    if docs:
        yield docs, tags, texts


def _anchor(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Segments of the texts. A segment that a smaller document of the batch has comes as decided,
    under a key of its own.

    ``what`` is the name: 57 bits of the digest and 6 bits of the number of strings. For decided
    rows the 6 bits are zero and the number stands above them.
    """
    for docs, tags, texts in _gathered(batches, BATCH_BYTES):
        found, at = [], 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (size == 0 or size < PIECE_BYTES):
                size += len(texts[upto])
                upto += 1
            bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts[at:upto]])))
            anchor, digest, owner, start, n, sides = segments(b"".join(texts[at:upto]), bounds, length)
            found.append((anchor, digest, owner + at, start - bounds[owner], n, sides))
            at = upto
        anchor, digest, owner, start, n, sides = (np.concatenate(c) for c in zip(*found, strict=True))
        if not len(anchor):
            continue
        doc, tag = np.array(docs, np.int64)[owner], np.array(tags, np.int64)[owner]
        what = ((digest >> np.uint64(7)) << np.uint64(6) | n.astype(np.uint64)).view(np.int64)
        anchor, place = (anchor * _M1).view(np.int64) & _ANCHOR_BITS, tag << 32 | start
        order = np.lexsort((doc, what, anchor))
        decided = np.zeros(len(order), bool)
        decided[order] = _named_factors(anchor[order], what[order], np.minimum(doc, _NO_ID)[order], length) >= length
        yield _batch(_SEGMENT, (anchor | sides)[~decided], what[~decided], doc[~decided], place[~decided])
        if decided.any():
            own, s, e = owner[decided], start[decided], (start + n)[decided]
            first = np.append(True, (own[1:] != own[:-1]) | (s[1:] != e[:-1]))
            last = np.append(first[1:], True)
            doc, place = doc[decided][first], place[decided][first]
            yield _batch(_SEGMENT, _salt(doc, place) & _ANCHOR_BITS, (e[last] - s[first]) << 6, doc, place)


def _meet(batches: Iterator[pa.RecordBatch], hot_anchor: int, most_held: int, length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, what, doc. Marks: covered segments (kind 1), and those of the smallest documents that
    are different from another of the anchor but equal on a side (2 under that side's key, or 3 if it is hot)."""

    def split(anchor, what, doc, place, sides):
        """Covered rows, then rows that represent a segment."""
        rep = _named_factors(anchor, what, np.minimum(doc, _NO_ID), length) < length
        covered = _batch(_MARK, np.full((~rep).sum(), 1), anchor[~rep], doc[~rep], place[~rep], what[~rep] & 63)
        return covered, tuple(c[rep] for c in (anchor, what, doc, place, sides))

    def several(key, what, doc):
        """Of rows sorted by key and what: those of keys with different segments of different documents, and those
        of hot keys."""
        new = _starts(key)
        group, at = np.cumsum(new) - 1, np.flatnonzero(new)
        kinds, rank = np.bincount(group, _starts(key, what)), np.minimum(doc, _NO_ID)
        use = (kinds > 1) & (np.minimum.reduceat(rank, at) < np.maximum.reduceat(rank, at))
        return use[group], (kinds > hot_anchor)[group]

    def mixed(anchor, what, doc, place, sides, hot_at):
        out, new = [], _starts(anchor)
        use, hot = several(anchor, what, doc)
        here = anchor == hot_at if hot_at is not None else np.zeros(len(anchor), bool)
        alike = np.logical_or.reduceat(sides == _NO_SIDES, np.flatnonzero(new))[np.cumsum(new) - 1] | here
        use, hot = use | here, hot | here
        out.append((np.where(hot, _HOT, _COLD), anchor, np.arange(len(anchor)), use & alike))
        apart, any_hot = np.flatnonzero(use & ~alike), np.zeros(len(anchor), bool)
        for side, low in enumerate((_SIDE_BITS, 0)):
            rows = apart[(sides[apart] >> low) & ((1 << _SIDE_BITS) - 1) > 0]
            if len(rows):
                key = _salt(anchor[rows], ((sides[rows] >> low) & ((1 << _SIDE_BITS) - 1)) << 1 | side) & _ANCHOR_BITS
                order = np.lexsort((what[rows], key))
                key, rows = key[order], rows[order]
                use, hot = several(key, what[rows], doc[rows])
                any_hot[rows[use & hot]] = True
                out.append((np.full(len(rows), _COLD), key, rows, use & ~hot))
        out.append((np.full(len(anchor), _HOT), anchor, np.arange(len(anchor)), any_hot))
        kind, key, rows = (np.concatenate([o[i][o[3]] for o in out]) for i in range(3))
        return _batch(_MARK, kind, key, doc[rows], place[rows], what[rows] & 63)

    held, hot_at, sent = None, None, 0
    for batch in batches:
        rows = [batch.column(i).to_numpy() for i in range(4)]
        decided = rows[1] & 63 == 0
        if decided.any():
            a, w, d, p = (c[decided] for c in rows)
            yield _batch(_MARK, np.ones(len(a)), a, d, p, w >> 6)
            rows = [c[~decided] for c in rows]
        if not len(rows[0]):
            continue
        rows = [rows[0] & _ANCHOR_BITS, *rows[1:], rows[0] & ~_ANCHOR_BITS]
        if held is not None:
            rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
        cut_at = np.searchsorted(rows[0], rows[0][-1])
        covered, reps = split(*rows)
        yield covered
        skip, last = sent, reps[0] == rows[0][-1]
        whole = tuple(c[skip:][~last[skip:]] for c in reps)
        if len(whole[0]):
            yield mixed(*whole, hot_at)
        if cut_at:
            hot_at = None
            skip = 0
        tail = tuple(c[last] for c in reps)
        if hot_at is not None or _starts(tail[1]).sum() > most_held:
            hot_at = rows[0][-1]
            fresh = tuple(c[skip:] for c in tail)
            if len(fresh[0]):
                yield mixed(*fresh, hot_at)
            held, sent = tuple(c[-1:] for c in tail), 1
        else:
            held, sent = tail, 0
    if held is not None and len(held[0]) > sent:
        yield mixed(*held, hot_at)


def _cut_strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of marked segments; strings of hot anchors one by one, and of equal ones among
    ``_STRINGS`` only those of the smallest document, the others as covered (bytes null)."""

    def single(hot):
        lead: dict[bytes, int] = {}
        for string, doc, _ in hot:
            lead[string] = min(doc, _NO_ID, lead.get(string, doc))
        out, done = [], []
        for string, doc, place in hot:
            if lead[string] == min(doc, _NO_ID):
                out.append((xxhash.xxh64_intdigest(string) - (1 << 63), doc, place, 1, string))
            else:
                done.append((doc, place))
        if out:
            yield _batch(_STRING, *zip(*out, strict=True))
        if done:
            doc, place = np.array(done, np.int64).T
            yield _batch(_STRING, _salt(doc, place), doc, place, np.ones(len(doc), np.int32), [None] * len(doc))

    out, hot = [], []
    for batch in _slices(batches, _ROWS):
        for doc, tag, text, marks in zip(*(batch.column(i) for i in range(4)), strict=True):
            doc, tag, text, marks = doc.as_py(), tag.as_py(), text.as_py(), marks.values
            kind, anchor, place, n = (marks.field(i).to_numpy() for i in range(4))
            for k, a, p, m in zip(kind.tolist(), anchor.tolist(), place.tolist(), n.tolist(), strict=True):
                start = p & 0xFFFFFFFF
                if k == _COLD:
                    out.append((a, doc, p, m, text[start : start + m + length - 1]))
                else:
                    hot += [(text[i : i + length], doc, tag << 32 | i) for i in range(start, start + m)]
                if len(hot) >= _STRINGS:
                    yield from single(hot)
                    hot = []
                if len(out) >= _STRINGS:
                    yield _batch(_STRING, *zip(*out, strict=True))
                    out = []
    if out:
        yield _batch(_STRING, *zip(*out, strict=True))
    yield from single(hot)


def _windows_digest(data: np.ndarray, length: int) -> np.ndarray:
    """A polynomial digest of the ``length`` bytes from each position on."""
    power = np.cumprod(np.full(len(data), _M1), dtype=np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * power, dtype=np.uint64)))
    inverse = np.uint64(pow(int(_M1), -1, 1 << 64))
    back = np.cumprod(np.full(len(data) - length + 1, inverse), dtype=np.uint64)
    x = (total[length:] - total[:-length]) * back
    return x ^ (x >> np.uint64(32))


def suffix_factors(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """LPFs, within groups, of the suffixes of ``data`` that begin at ``start`` and have ``size``
    bytes (``length`` at least, ``length`` + ``LONGEST_RUN`` at most); below ``length`` they may be less.

    Suffixes are put in suffix order, of equal ones the smaller documents first; the common
    prefixes of neighbours give the factors.
    """
    width = -(-(length + LONGEST_RUN) // 8) * 8
    padded = np.concatenate((data, np.zeros(width, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[start]
    rows[np.arange(width) >= size[:, None]] = 0
    order = np.lexsort((doc, size, *rows.view(">u8").astype(np.uint64).T[::-1], group))
    rows, size = rows[order], size[order]
    differ = np.ones((len(order), width + 1), bool)
    differ[1:, :width] = rows[1:] != rows[:-1]
    lcp = np.minimum(differ.argmax(axis=1), size)
    lcp[1:] = np.minimum(lcp[1:], size[:-1])
    lcp[_starts(group[order])] = 0
    out = np.zeros(len(order), np.int64)
    out[order] = longest_previous_factors(lcp, doc[order], length)
    return out


def _suffix_order(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by route, then doc: the runs of places whose factors reach ``length``."""

    def settle(route, doc, place, n, data):
        if len(route) < 2:
            return None
        blob = np.frombuffer(b"".join(data), np.uint8)
        rank, n = np.minimum(doc, _NO_ID), n.astype(np.int64)
        at = np.cumsum(n + (length - 1)) - (n + (length - 1))
        row = np.repeat(np.arange(len(n)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = at[row] + offset
        digest = _windows_digest(blob, length)[start] ^ (route[row].astype(np.int64).view(np.uint64) * _M3)
        order = np.argsort(digest, kind="stable")
        first = _starts(digest[order])
        begin, of_run = np.flatnonzero(first), np.cumsum(first) - 1
        ranks = rank[row][order]
        several = np.minimum.reduceat(ranks, begin) < np.maximum.reduceat(ranks, begin)
        use = np.sort(order[several[of_run]])
        if not len(use):
            return None
        size = (n + (length - 1))[row[use]] - offset[use]
        use = use[suffix_factors(blob, start[use], size, route[row[use]], rank[row[use]], length) >= length]
        if not len(use):
            return None
        first = np.append(True, (row[use][1:] != row[use][:-1]) | (use[1:] != use[:-1] + 1))
        runs = np.diff(np.append(np.flatnonzero(first), len(use)))
        return _batch(_COVERED, doc[row[use]][first], (place[row[use]] + offset[use])[first], runs)

    held = None
    for batch in _slices(batches, _ORDERED):
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        ready = np.array([x is None for x in rows[4]], bool)
        if ready.any():
            yield _batch(_COVERED, *(c[ready] for c in rows[1:4]))
            rows = [c[~ready] for c in rows]
        if not len(rows[0]):
            continue
        if held is not None:
            rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
        cut_at = np.searchsorted(rows[0], rows[0][-1])
        done = settle(*(c[:cut_at] for c in rows))
        if done is not None:
            yield done
        held = [c[cut_at:] for c in rows]
        if len(held[0]) > 1 and len(set(held[4])) == 1:  # a hot string: only its smallest document is needed on
            done = settle(*held)
            if done is not None:
                yield done
            held = [c[:1] for c in held]
    if held is not None:
        done = settle(*held)
        if done is not None:
            yield done


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals; touching ones join."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.append(True, start[1:] > reach[:-1])
    return start[first], reach[np.append(first[1:], True)]


_SPANS = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))


def _merge(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Covered places sorted by doc and place: one row for each text with its merged spans."""
    held = None

    def spans(doc, place, n):
        start, tag = place & 0xFFFFFFFF, place >> 32
        low, high, own, tags = [], [], [], []
        at = np.flatnonzero(_starts(doc, tag))
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(doc)], strict=True):
            s, e = merged(start[a:b], start[a:b] + n[a:b] + (length - 1))
            low.append(s)
            high.append(e)
            own.append(doc[a])
            tags.append(tag[a])
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in low])))
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (low, high)], fields=list(_SPANS.value_type))
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(tags, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs, type=_SPANS)], ["doc", "tag", "spans"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy().astype(np.int64) for i in range(3)]
        if held is not None:
            rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
        last = (rows[0] == rows[0][-1]) & (rows[1] >> 32 == rows[1][-1] >> 32)
        whole = [c[~last] for c in rows]
        if len(whole[0]):
            yield spans(*whole)
        doc, place, n = (c[last] for c in rows)
        low, high = merged(place, place + n)  # keeps what is held as short as the text's own spans
        held = [np.full(len(low), doc[0]), low, high - low]
    if held is not None:
        yield spans(*held)


def _removed(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, _ROWS):
        out = []
        for doc, text, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            kept, gone, spans = text, 0, []
            if cuts.is_valid:
                low, high = (cuts.values.field(i).to_numpy() for i in range(2))
                gone, spans = int((high - low).sum()), list(zip(low.tolist(), high.tolist(), strict=True))
                edges = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((None if doc >= _NO_ID else doc, len(text), gone, len(spans), hashlib.sha256(kept).hexdigest(), kept if keep else None))
        if out:
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string(), pa.binary()], strict=True)], names)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go when it is written; else they stay until the driver happens to
    collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot_anchor: int = HOT_ANCHOR, keep: bool = True, most_held: int = MOST_HELD) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept
    bytes (null unless ``keep``)."""
    if length < GRAM + 16:
        raise ValueError(f"length must be at least {GRAM + 16}")
    text, doc_id = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("long")
    # Without repeated doc_ids no text needs a tag, and zeros take no room in the shuffles of segments. A literal
    # zero would be folded out of the keys of one join, and the joins would no longer share an exchange.
    repeated = not docs.groupBy(doc_id).count().where("count > 1").isEmpty()
    tag = F.xxhash64(text).bitwiseAND(0x7FFFFFFF if repeated else 0)
    no_id = F.xxhash64(F.lit("no id"), text).bitwiseAND(_NO_ID - 1).bitwiseOR(F.lit(_NO_ID))
    texts = docs.select(
        F.coalesce(F.when(doc_id >= _NO_ID, F.raise_error(F.lit("a doc_id of 2**62 or more")).cast("long")), doc_id, no_id).alias("doc"),  # never null, so both joins share an exchange
        tag.alias("tag"),
        text.cast("binary").alias("text"),
    )
    anchor = F.shiftright("anchor", 2 * _SIDE_BITS)
    dealt = texts.mapInArrow(lambda it: _anchor(it, length), _ddl(_SEGMENT)).repartition(anchor).sortWithinPartitions(anchor, "what", "doc")
    with _shuffles_dropped(docs.sparkSession):
        marks = cut(dealt.mapInArrow(lambda it: _meet(it, hot_anchor, most_held, length), _ddl(_MARK)), "marks")
    marks = marks.withColumn("tag", F.shiftright("place", 32))
    wanted = marks.where("kind > 1").groupBy("doc", "tag").agg(F.collect_list(F.struct("kind", "anchor", "place", "n")).alias("marks"))
    strings = texts.join(wanted, ["doc", "tag"]).select("doc", "tag", "text", "marks").mapInArrow(lambda it: _cut_strings(it, length), _ddl(_STRING))
    found = strings.repartition("route").sortWithinPartitions("route", "doc").mapInArrow(lambda it: _suffix_order(it, length), _ddl(_COVERED))
    covered = marks.where("kind = 1").select("doc", "place", "n").union(found)
    by_text = covered.repartition("doc", F.shiftright("place", 32)).sortWithinPartitions("doc", "place")
    spans = by_text.mapInArrow(lambda it: _merge(it, length), "doc long, tag long, spans array<struct<low: long, high: long>>")
    return texts.join(spans, ["doc", "tag"], "left").select("doc", "text", "spans").mapInArrow(
        lambda it: _removed(it, keep), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
