"""WARC archives of pages with a two-level capture index.

``write_archives`` writes one WARC/1.1 record for each page through Spark's text sink, whose line
separator is the record separator, so lost tasks are committed again like any Spark output. Of
equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest page_id is a response
record, the others are revisit records that refer to it and carry no payload.

``build_index`` reads the archives and sorts capture lines by reversed-host URL key over the whole
cluster. Lines are put in compressed blocks, and the sparse directory has the first key of each
block. Its size is bounded: blocks grow before it has more than ``MOST_BLOCKS`` rows, so every
task can hold it. ``lookup`` binary-searches the directory, then the lines of a block, and reads
just the byte range of each record from its archive (any store that Arrow's file systems reach).

Defined results: null html is an empty payload; a null url has the empty key; a null page_id is a
record without an id and never refers or is referred to; repeated rows have a record each, all of
them responses if they tie for the smallest page_id; empty tables give an empty archive and
index; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.shared import cut, new_path

REVISIT_BYTES = 100
BLOCK_LINES = 3000
MOST_BLOCKS = 200_000
#: Repeated payloads up to this number (about 100 bytes each) are broadcast, more are joined by shuffle.
MOST_REPEATED = 100_000
ARCHIVE_RECORDS = 2000
CHUNK = 1 << 18
CAPTURED = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def _header(name: str, value: Column) -> Column:
    """One header line; none for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, captured: str = CAPTURED) -> DataFrame:
    """Column ``value``: the WARC record of each page without the final separator."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace("url", r"[\r\n]", "%20").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    same = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "first")
    same = cut(same, "same")
    if same.limit(MOST_REPEATED + 1).count() <= MOST_REPEATED:
        same = F.broadcast(same)
    rows = rows.join(same, F.col("digest") == F.col("of"), "left")
    revisit = (F.col("page_id") > F.col("first")) | (F.col("page_id").isNull() & F.col("first").isNotNull())
    typed = rows.withColumn("revisit", F.coalesce(revisit, F.lit(False)))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html")))
    urn = F.concat(F.lit("<urn:trailmark:page:"), F.col("page_id").cast("string"), F.lit(">"))
    of = F.when(F.col("revisit"), F.concat(F.lit("<urn:trailmark:page:"), F.col("first").cast("string"), F.lit(">")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _header("WARC-Record-ID", urn),
        _header("WARC-Target-URI", F.col("url")),
        F.lit(f"WARC-Date: {captured}\r\n"),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        _header("WARC-Profile", F.when(F.col("revisit"), PROFILE)),
        _header("WARC-Refers-To", of),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
    )
    length = F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit(END))
    return typed.withColumn("block", block).select(F.concat(head, length, F.col("block")).alias("value"))


def write_archives(pages: DataFrame, folder: str, archive_records: int = ARCHIVE_RECORDS) -> None:
    """Write the archives of ``pages`` into ``folder``, ``archive_records`` each at most."""
    records(pages).write.option("lineSep", END).option("maxRecordsPerFile", archive_records).text(folder)


def _encoded(url: str) -> str:
    """Blanks and control characters percent-encoded, as lines of blocks are divided by them."""
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url)


def url_key(url: str | None) -> str:
    """Reversed-host key: ``http://www.example.com:80/a?b`` gives ``com,example,www:80)/a?b``."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^#]*)", url or "")
    if not m:
        return _encoded((url or "").partition("#")[0])
    host = ",".join(reversed(m[1].lower().split(".")))
    return _encoded(f"{host}{m[2] or ''}){m[3] or '/'}")


def _parse(data: bytes, at: int) -> tuple[dict[str, str], int, int]:
    """Headers of the record at an offset, start of its block, and its end with the separator."""
    block = data.index(b"\r\n\r\n", at) + 4
    lines = data[at : block - 4].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at byte {at}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, block, block + int(headers["Content-Length"]) + 4


def _page(urn: str | None) -> int | None:
    return int(urn[:-1].rpartition(":")[2]) if urn else None


def capture_key(url: str | None, page_id: int | None) -> str:
    """What capture lines are sorted and found by: URL key, then page_id."""
    return f"{url_key(url)} {'-' if page_id is None else f'{page_id:020d}'}"


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Capture lines of archives: only headers are read, ``CHUNK`` bytes at a time."""
    for batch in batches:
        for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as stream:
                at, held, first, out = 0, b"", 0, []
                while at < size:
                    if at >= first + len(held):
                        held, first = stream.read_at(CHUNK, at), at
                    while held.find(b"\r\n\r\n", at - first) < 0:
                        more = stream.read_at(CHUNK, first + len(held))
                        if not more:
                            raise ValueError(f"no end of the header at byte {at} of {path}")
                        held = held[at - first :] + more
                        first = at
                    headers, _, end = _parse(held, at - first)
                    end += first
                    key = capture_key(headers.get("WARC-Target-URI"), _page(headers.get("WARC-Record-ID")))
                    out.append((key, json.dumps({"file": path, "offset": at, "length": end - at - 4})))
                    at = end
                    if len(out) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["key", "capture"])
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["key", "capture"])


def _blocks(batches: Iterator[pa.RecordBatch], lines: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str, str]] = []

    def block(rows):
        data = zlib.compress("\n".join(f"{k}\t{c}" for k, c in rows).encode())
        return pa.RecordBatch.from_arrays([pa.array([rows[0][0]]), pa.array([len(rows)], pa.int32()), pa.array([data], pa.binary())], ["first_key", "n", "data"])

    for batch in batches:
        held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        while len(held) >= lines:
            yield block(held[:lines])
            held = held[lines:]
    if held:
        yield block(held)


def build_index(spark: SparkSession, archives: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """The blocks of capture lines of all archives, in key order: block, first_key, n, data.

    ``block`` numbers them; equal keys may go on in the next block. Without data it's the directory.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(archives).select("path", "length")
    captures = cut(files.mapInArrow(_captures, "key string, capture string"), "captures")
    lines = max(block_lines, -(-captures.count() // MOST_BLOCKS))
    ordered = captures.repartitionByRange("key", F.xxhash64("capture")).sortWithinPartitions("key", "capture")
    blocks = cut(ordered.mapInArrow(lambda it: _blocks(it, lines), "first_key string, n int, data binary"), "blocks")
    return blocks.withColumn("block", F.xxhash64("first_key", "data"))


def _find(batches: Iterator[pa.RecordBatch], keys) -> Iterator[pa.RecordBatch]:
    """(key, block) for each block that can hold a key, by binary search of the directory."""
    first, block = keys.value
    for batch in batches:
        out = []
        for key in batch.column(0).to_pylist():
            low, high = max(0, bisect.bisect_left(first, key) - 1), bisect.bisect_right(first, key)
            out += [(key, block[i]) for i in range(low, high)]
        if out:
            k, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(b, pa.int64())], ["key", "block"])


def _open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for wanted, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lines = [x.split("\t", 1) for x in zlib.decompress(data).decode().split("\n")]
            keys, out = [x[0] for x in lines], []
            for key in wanted:
                low, high = bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)
                for i in range(low, high):
                    at = json.loads(lines[i][1])
                    out.append((at["file"], at["offset"], at["length"]))
            if out:
                file, offset, length = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], ["file", "offset", "length"])


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        for file, ranges in groupby(rows, key=lambda r: r[0]):
            store, path = fs.FileSystem.from_uri(file)
            out = []
            with store.open_input_file(path) as stream:
                for _, offset, length in ranges:
                    stream.seek(offset)
                    data = stream.read(length)
                    headers, block, _ = _parse(data, 0)
                    start = data.index(b"\r\n\r\n", block) + 4
                    size = int(re.search(rb"Content-Length: ([0-9]+)", data[block:start])[1])
                    digest, payload = headers["WARC-Payload-Digest"].removeprefix("sha256:"), None
                    if headers["WARC-Type"] == "response":
                        payload = data[start:]
                        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"damaged payload in {file} at byte {offset}")
                    out.append((_page(headers.get("WARC-Record-ID")), size, digest, headers["WARC-Type"], _page(headers.get("WARC-Refers-To")), payload))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def locate(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Where the captures of distinct keys (column ``key``, see ``capture_key``) lie: file, offset, length."""
    spark = keys.sparkSession
    directory = index.select("first_key", "block").orderBy("first_key").collect()  # at most MOST_BLOCKS rows and one for each task
    held = spark.sparkContext.broadcast(([r["first_key"] for r in directory], [r["block"] for r in directory]))
    found = keys.select("key").distinct().mapInArrow(lambda it: _find(it, held), "key string, block long")
    wanted = found.groupBy("block").agg(F.collect_list("key").alias("wanted"))
    return index.join(wanted, "block").select("wanted", "data").mapInArrow(_open_blocks, "file string, offset long, length long")


def read(captures: DataFrame) -> DataFrame:
    """The records at these places: page_id, payload_bytes, payload_digest, record_type, refers_to,
    payload (null for revisits)."""
    ranges = captures.repartition("file").sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(_read_ranges, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def lookup(keys: DataFrame, index: DataFrame) -> DataFrame:
    """The records of distinct keys, as ``read`` gives them."""
    return read(locate(keys, index))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [capture_key(u, p) for u, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], ["key"])


def page_keys(pages: DataFrame) -> DataFrame:
    """The capture keys of pages."""
    return pages.select(F.regexp_replace("url", r"[\r\n]", "%20").alias("url"), F.col("page_id").cast("long").alias("page_id")).mapInArrow(_keys, "key string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives of ``pages`` into the shared folder, index them, and look every page up;
    fails if one isn't found."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    write_archives(pages, folder)
    captures = cut(locate(page_keys(pages), build_index(spark, folder)), "located")
    if (found := captures.count()) != (wanted := pages.count()):
        raise ValueError(f"{found} captures were found of {wanted} pages")
    return read(captures)
