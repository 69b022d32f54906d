"""Repeated lines, found in a range-partitioned order of line hashes.

Hashes of line keys are range-partitioned together with document and position,
so a line that a third of all documents hold spreads over many tasks. Each
partition is sorted and streamed; a key's first row in the order is its
occurrence in the largest document, which stays. A key that continues in the
next partition is settled by a summary of the first and last key of every
partition: two rows a partition, whatever the data. What returns to a document
is not text but a compressed bitmap of the lines it keeps.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RowBuffer, packed, record_batch, rows_of, text_bytes, unpacked, with_checkpoints

MIN_POINTS = 20
MIN_DOCUMENTS = 3

_LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("version", pa.int64()), ("position", pa.int64())])
_LINES_DDL = "h1 bigint, h2 bigint, doc_id bigint, version bigint, position bigint"
_DROPPED = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("position", pa.int64())])
_EDGES = pa.schema([("part", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("docs", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def line_key(line: bytes, points: int) -> bytes | None:
    """The line without outer blanks and in lower case (ASCII only), or None if it is too short."""
    key = line.strip().lower()
    if len(key) < points or (len(key) < 4 * points and len(key.decode("utf-8", "replace")) < points):
        return None
    return key


def _version() -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _version().alias("version"), text_bytes().alias("text"))


def line_hashes(docs: DataFrame, points: int = MIN_POINTS) -> DataFrame:
    """A row for each line long enough to be judged, of documents with an id."""

    def run(batches):
        for batch in batches:
            out = RowBuffer(_LINES, 1 << 16)
            for doc_id, version, text in rows_of(iter([batch]), "doc_id", "version", "text"):
                for position, line in enumerate((text or b"").split(b"\n")):
                    if (key := line_key(line, points)) is not None:
                        h = xxhash.xxh3_128_intdigest(key)
                        if out.add(_signed(h >> 64), _signed(h & ((1 << 64) - 1)), doc_id, version, position):
                            yield from out.flush()
            yield from out.flush()

    return _narrow(docs.where("doc_id is not null")).mapInArrow(run, _LINES_DDL)


def _key_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(starts of key runs, columns) of each batch; a run may go on in the next."""
    for batch in batches:
        if batch.num_rows:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            h1, h2 = columns[:2]
            yield np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))), columns


def _partition_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last key of this partition, with their documents."""
    first = last = None
    for starts, (h1, h2, doc, _, _) in _key_runs(batches):
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(h1)], strict=True):
            if 0 < a and b < len(h1):
                continue  # inside the batch: neither first nor last so far
            key, run = (int(h1[a]), int(h2[a])), doc[a:b]
            docs = 1 + np.count_nonzero(run[1:] != run[:-1])
            if last and last[0] == key:
                last[1] += int(docs) - int(last[3] == run[0])
                last[3] = int(run[-1])
            else:
                if last and first is None:
                    first = last
                last = [key, int(docs), int(run[0]), int(run[-1])]
    if last is not None:
        part = TaskContext.get().partitionId()
        rows = [r for r in (first, last) if r is not None]
        yield record_batch(_EDGES, [[part] * len(rows), *([r[0][i] for r in rows] for i in (0, 1)), *([r[i] for r in rows] for i in (1, 2, 3))])


def _spanning_keys(ends: list) -> dict[tuple[int, int], tuple[int, int]]:
    """(documents, largest document) of the keys that several partitions hold.

    ``ends`` has two rows a partition at most, in partition order, so a key's
    pieces follow one another; a document cut by a border counts once.
    """
    found: dict = {}
    for row in sorted(ends, key=lambda r: r["part"]):
        key = (row["h1"], row["h2"])
        if key in found:
            pieces, docs, largest, last = found[key]
            found[key] = (pieces + 1, docs + row["docs"] - (last == row["first"]), largest, row["last"])
        else:
            found[key] = (1, row["docs"], row["first"], row["last"])
    return {key: (docs, largest) for key, (pieces, docs, largest, _) in found.items() if pieces > 1}


def dropped_lines(docs: DataFrame, points: int = MIN_POINTS, documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc_id, version, position) of every line to drop."""
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc(), F.col("version"), F.col("position")]
    with_checkpoints(docs.sparkSession)
    dealt = line_hashes(docs, points).repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    ends = dealt.mapInArrow(_partition_ends, "part int, h1 bigint, h2 bigint, docs bigint, first bigint, last bigint").collect()
    spanning = _spanning_keys(ends)

    def run(batches):
        key, settled, waiting, seen, survivor, last = None, False, [], 0, None, None
        out = RowBuffer(_DROPPED, 1 << 14)
        for starts, (h1, h2, doc, version, position) in _key_runs(batches):
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(h1)], strict=True):
                if 0 < a and b < len(h1) and b - a < documents:
                    key = None
                    continue  # a whole run with too few rows
                if (now := (int(h1[a]), int(h2[a]))) != key:
                    key, waiting, last = now, [], None
                    settled = now in spanning
                    seen, survivor = spanning.get(now, (0, int(doc[a])))
                if not settled:
                    seen += 1 + int(np.count_nonzero(np.diff(doc[a:b]))) - int(last == doc[a])
                    last = doc[b - 1]
                elif seen < documents:
                    continue
                # Rows wait only until enough documents are seen: one document's lines fewer at most.
                gone = doc[a:b] != survivor
                waiting.append([c[a:b][gone].tolist() for c in (doc, version, position)])
                if seen >= documents:
                    for columns in waiting:
                        for values in zip(*columns, strict=True):
                            if out.add(*values):
                                yield from out.flush()
                    waiting = []
        yield from out.flush()

    return dealt.mapInArrow(run, "doc_id bigint, version bigint, position bigint")


def pack_bitmap(dropped: list[int]) -> bytes:
    """Keep bits of the lines up to the last dropped one, compressed; lines beyond stay."""
    keep = np.ones(max(dropped) // 8 * 8 + 8, np.uint8)  # whole bytes
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def kept_mask(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Whether each line stays."""
    mask = np.ones(n_lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines].astype(bool)
        mask[: len(bits)] = bits
    return mask


_BITMAPS = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("bitmap", pa.binary())])


def keep_bitmaps(docs: DataFrame, points: int = MIN_POINTS, documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc_id, version, bitmap) of the documents that lose a line.

    Rows of one document arrive sorted in one task and are streamed; a bitmap
    is as long as its document has lines.
    """

    def run(batches):
        out, key, positions = RowBuffer(_BITMAPS), None, []
        for doc_id, version, position in rows_of(batches, "doc_id", "version", "position"):
            if (doc_id, version) != key:
                if key is not None and out.add(*key, pack_bitmap(positions)):
                    yield from out.flush()
                key, positions = (doc_id, version), []
            positions.append(position)
        if key is not None:
            out.add(*key, pack_bitmap(positions))
        yield from out.flush()

    dropped = dropped_lines(docs, points, documents).repartition("doc_id", "version")
    return dropped.sortWithinPartitions("doc_id", "version").mapInArrow(run, "doc_id bigint, version bigint, bitmap binary")


def _with_bitmaps(docs: DataFrame, points: int, documents: int) -> DataFrame:
    """Packed rows of ``docs`` with the bitmap of their lines in ``_bitmap``; null where all stay."""
    bitmaps = keep_bitmaps(docs, points, documents).select(
        F.col("doc_id").alias("_doc"), F.col("version").alias("_version"), F.col("bitmap").alias("_bitmap")
    )
    left = packed(docs, _doc=F.col("doc_id").cast("bigint"), _version=_version())
    return left.join(bitmaps, ["_doc", "_version"], "left")


def _kept(text: bytes, mask: np.ndarray) -> bytes:
    return b"\n".join([line for line, stays in zip(text.split(b"\n"), mask.tolist(), strict=True) if stays])


def drop_repeated_lines(docs: DataFrame, points: int = MIN_POINTS, documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; all rows and columns stay."""

    @F.pandas_udf("string")
    def shortened(text: pd.Series, bitmap: pd.Series) -> pd.Series:
        def one(t: bytes, m: bytes):
            if m is None:
                return None
            data = bytes(t)
            return _kept(data, kept_mask(m, data.count(b"\n") + 1)).decode("utf-8", "replace")

        return pd.Series([one(t, m) for t, m in zip(text, bitmap, strict=True)], dtype=object)

    marked = _with_bitmaps(docs, points, documents)
    loses = F.col("_bitmap").isNotNull()
    text = F.col("_row.text")
    only = F.when(loses, F.coalesce(text, F.lit("")).cast("binary"))
    short = marked.withColumn("_short", shortened(only, "_bitmap"))
    return unpacked(short, docs.columns, text=F.when(loses, F.col("_short")).otherwise(text))


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])


def line_digest(docs: DataFrame, points: int = MIN_POINTS, documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row of ``docs`` (doc_id, text).

    Null and empty texts are one empty line. A row without doc_id keeps all
    its lines and counts for no key. Rows of one doc_id are one document.
    Other columns are ignored.
    """

    def run(batches):
        out = RowBuffer(_DIGEST)
        for doc_id, text, bitmap in rows_of(batches, "doc_id", "text", "_bitmap"):
            text = text or b""
            mask = kept_mask(bitmap, text.count(b"\n") + 1)
            kept = _kept(text, mask) if bitmap is not None else text
            if out.add(doc_id, len(mask), len(mask) - int(mask.sum()), hashlib.sha256(kept).hexdigest()):
                yield from out.flush()
        yield from out.flush()

    marked = _with_bitmaps(docs.select("doc_id", "text"), points, documents)
    narrow = marked.select(F.col("_doc").alias("doc_id"), text_bytes("_row.text").alias("text"), "_bitmap")
    return narrow.mapInArrow(run, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")
