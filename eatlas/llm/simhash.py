"""SimHash near duplicates by a Gray-order hierarchical index.

A fingerprint has 64 bits in six blocks. Two fingerprints that differ in at
most two bits agree on at least four whole blocks, so each of the 15 choices
of four blocks is a root pattern: fingerprints that share its bits meet in one
shard. Within a shard they are sorted by Gray rank, which keeps equal leading
bits together; bits shared by neighbours are factored into the upper nodes of
a tree, and a search adds up differences from the top and drops a whole
subtree once more than two bits differ.

A shard holds distinct fingerprints of at most 22 free bits, so its size is
bounded by 2**22 whatever the data; copies were folded before, and a
fingerprint has at most 2,080 others within two bits. Shards report a spanning
forest, not pairs.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import materialize
from .common import RowBuffer, packed, record_batch, rows_of, text_bytes, unpacked
from .components import components

MAX_DIFFERENCE = 2
_BLOCKS = (11, 11, 11, 11, 10, 10)
_KEPT = 4
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_PIECE = 1 << 20
_FRONTIER = 1 << 20


def word_runs(text: bytes, size: int) -> Iterator[list[bytes]]:
    """Words of a text, a bounded piece at a time; pieces overlap by ``size`` - 1 words."""
    carry: list[bytes] = []
    start = 0
    while start < len(text):
        end = start + _PIECE
        cut = _BLANK.search(text, end) if end < len(text) else None
        end = cut.start() if cut else len(text)
        words = carry + text[start:end].lower().split()
        start = end
        if len(words) >= size or start >= len(text):
            yield words
            carry = words[len(words) - size + 1 :] if size > 1 else []
        else:
            carry = words


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """64-bit SimHash of the ``size``-word shingles, repeats included."""
    ones, total = np.zeros(64, np.int64), 0
    digest = xxhash.xxh64_digest
    for words in word_runs(text or b"", size):
        n = len(words)
        if n < size:
            # Fewer words than a shingle: the whole sequence, if nothing was hashed before.
            if n and not total:
                total = 1
                ones += np.unpackbits(np.frombuffer(digest(b" ".join(words), 42), np.uint8))
            continue
        line = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: n - size + 1].tolist()
        hashed = b"".join([digest(line[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)])
        bits = np.unpackbits(np.frombuffer(hashed, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(starts)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _version() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, version, fp) of every document; a null or empty text has fingerprint 0.

    ``version`` is a hash of the text, which tells rows of one doc_id apart.
    """

    def run(batches):
        out = RowBuffer(_FINGERPRINTS)
        for doc_id, version, text in rows_of(batches, "doc_id", "version", "text"):
            value = fingerprint(text, size)
            if out.add(doc_id, version, value - (1 << 64) if value >> 63 else value):
                yield from out.flush()
        yield from out.flush()

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _version().alias("version"), text_bytes().alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, version bigint, fp bigint")


def _patterns() -> list[tuple[list[tuple[int, int]], int]]:
    """For each choice of kept blocks: (shift, width) of all blocks, kept ones first, and the free bits."""
    ends = list(itertools.accumulate(_BLOCKS))
    blocks = [(64 - e, w) for e, w in zip(ends, _BLOCKS, strict=True)]
    tables = []
    for kept in itertools.combinations(range(len(blocks)), _KEPT):
        order = [*kept, *(i for i in range(len(blocks)) if i not in kept)]
        tables.append(([blocks[i] for i in order], sum(_BLOCKS[i] for i in order[_KEPT:])))
    return tables


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Position of each code in Gray order."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


_SHARDED = pa.schema([("root", pa.int32()), ("prefix", pa.int64()), ("rank", pa.int64()), ("rep", pa.int64())])


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = _patterns()
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for root, (blocks, free) in enumerate(tables):
            code = np.zeros(len(fp), np.uint64)
            for shift, width in blocks:
                part = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                code = (code << np.uint64(width)) | part
            rank = gray_rank(code)
            prefix = (rank >> np.uint64(free)).view(np.int64)
            yield record_batch(_SHARDED, [np.full(len(fp), root, np.int32), prefix, rank.view(np.int64), batch.column(1)])


class _Level:
    """Nodes of one tree level: the node's bits, and where its children start."""

    def __init__(self, bits: np.ndarray, first: np.ndarray):
        self.bits, self.first = bits, first


def _tree(group: np.ndarray, code: np.ndarray, free: np.ndarray) -> tuple[list[_Level], list[tuple[int, int]]]:
    """Levels below the roots for rows in Gray order, and each level's (shift, width)."""
    most = int(free.max()) if len(free) else 0
    cuts, shift = [], most
    while shift > 0:
        width = min(6, shift)
        shift -= width
        cuts.append((shift, width))
    changed = np.ones(len(code), bool)
    changed[1:] = group[1:] != group[:-1]
    starts = [np.flatnonzero(changed)]
    for shift, width in cuts:
        part = code >> np.uint64(shift)
        changed[1:] |= part[1:] != part[:-1]
        starts.append(np.flatnonzero(changed))
    levels = []
    for above, below, (shift, width) in zip(starts[:-1], starts[1:], cuts, strict=True):
        bits = (code[below] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        levels.append(_Level(bits, np.append(np.searchsorted(below, above), len(below))))
    return levels, cuts


def near_pairs(group: np.ndarray, code: np.ndarray, free: np.ndarray, most: int = MAX_DIFFERENCE) -> Iterator[tuple]:
    """Pairs of rows (i < j) of one group whose codes differ in at most ``most`` bits.

    Rows come by group and, within it, in Gray order; codes of a group are
    distinct and share all but the ``free`` low bits.
    """
    levels, cuts = _tree(group, code, free)
    if not levels:
        return
    root = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1
    sizes = np.diff(levels[0].first)[root]
    block = np.cumsum(sizes) // _FRONTIER
    for queries in np.split(np.arange(len(code)), np.flatnonzero(np.diff(block)) + 1):
        stack = [(0, queries, root[queries], np.zeros(len(queries), np.uint8))]
        while stack:
            depth, rows, nodes, apart = stack.pop()
            level, (shift, width) = levels[depth], cuts[depth]
            count = level.first[nodes + 1] - level.first[nodes]
            if len(rows) > 1 and int(count.sum()) > 4 * _FRONTIER:
                half = len(rows) // 2
                stack += [(depth, rows[:half], nodes[:half], apart[:half]), (depth, rows[half:], nodes[half:], apart[half:])]
                continue
            rows, apart = np.repeat(rows, count), np.repeat(apart, count)
            offset = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
            nodes = np.repeat(level.first[nodes], count) + offset
            own = (code[rows] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            apart = apart + np.bitwise_count(own ^ level.bits[nodes])
            near = apart <= most
            rows, nodes, apart = rows[near], nodes[near], apart[near]
            if depth + 1 < len(levels):
                stack.append((depth + 1, rows, nodes, apart))
            else:
                half = rows < nodes
                yield rows[half], nodes[half]


def spanning(size: int, pairs: Iterator[tuple]) -> np.ndarray:
    """Smallest row connected with each row by ``pairs`` (i < j)."""
    label = np.arange(size)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label = up
    return label


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of shards that arrive sorted by root and Gray rank."""
    free_bits = np.array([free for _, free in _patterns()], np.int64)
    pending: list[list[np.ndarray]] = []

    def linked(columns):
        root, prefix, rank, rep = columns
        new = np.append(True, (root[1:] != root[:-1]) | (prefix[1:] != prefix[:-1]))
        group = np.cumsum(new) - 1
        crowd = np.bincount(group)[group] > 1
        root, rank, rep, group = root[crowd], rank[crowd].view(np.uint64), rep[crowd], group[crowd]
        if not len(rank):
            return
        code = rank ^ (rank >> np.uint64(1))
        label = spanning(len(code), near_pairs(group, code, free_bits[root]))
        moved = np.flatnonzero(label != np.arange(len(label)))
        yield record_batch(_LINKS, [rep[moved], rep[label[moved]]])

    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if not len(now[0]):
            continue
        # Rows before the batch's last shard end whatever is pending; the last shard may go on.
        last = np.count_nonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        ended = pending and (pending[-1][0][-1] != now[0][-1] or pending[-1][1][-1] != now[1][-1])
        if last or ended:
            pending.append([c[:last] for c in now])
            yield from linked([np.concatenate(c) for c in zip(*pending, strict=True)])
            pending = []
        pending.append([c[last:] for c in now])
    if pending:
        yield from linked([np.concatenate(c) for c in zip(*pending, strict=True)])


def near_links(classes: DataFrame) -> DataFrame:
    """(a, b): links that span all ``classes`` (fp, rep; fp distinct) at ``MAX_DIFFERENCE`` or fewer differing bits."""
    sharded = classes.select("fp", "rep").mapInArrow(_shard, "root int, prefix bigint, rank bigint, rep bigint")
    return sharded.repartition("root", "prefix").sortWithinPartitions("root", "rank").mapInArrow(_link, "a bigint, b bigint")


def _grouped(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, version, fp, component_id) of every row."""
    stored = materialize(fingerprints(docs, size))
    classes = materialize(stored.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(near_links(classes.where("rep is not null")))
    named = classes.join(found, classes.rep == found.node, "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return stored.join(named, "fp")


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text).

    Fingerprints link at two or fewer differing bits; ``component_id`` is the
    smallest doc_id reachable. Empty and null texts share fingerprint 0. A row
    without doc_id gets its fingerprint and the component of that fingerprint,
    but never names one (null if only such rows share it). Repeated rows come
    back as often as they went in. Other columns are ignored.
    """
    return _grouped(docs, size).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, size: int = 3) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, that of the smallest doc_id; all columns stay.

    Rows without doc_id stay. Of rows that share doc_id and text one stays.
    """
    groups = _grouped(docs.where("doc_id is not null"), size)
    kept = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "version")).alias("_kept"))
    kept = kept.select(F.col("_kept.doc_id").alias("_doc"), F.col("_kept.version").alias("_version"))
    known = packed(docs.where("doc_id is not null"), _doc=F.col("doc_id").cast("bigint"), _version=_version())
    chosen = known.join(kept, ["_doc", "_version"]).dropDuplicates(["_doc", "_version"])
    return unpacked(chosen, docs.columns).unionByName(docs.where("doc_id is null"))
