"""Repeated byte strings, found by two-stage suffix sorting in content buckets.

A string of ``span`` bytes has an anchor: the 24-byte gram with the smallest
hash among its first grams. Equal strings have equal anchors at equal offsets,
so the anchor's gram is the bucket in which all copies of a string meet.

1. Batches of documents report the hashes of their anchors, once each; a part
   of the hash space answers which hashes occur in two documents or more.
   Nothing else can repeat.
2. Batches send the bytes around those anchors (snippets: a run of string
   starts with one anchor), each distinct snippet once with its smallest doc_id,
   to the part of its anchor. The part sorts the suffixes: those smaller than
   their successor directly, all others by a scan over the buckets of first
   bytes, which places each suffix when its successor is met. Neighbours in that
   order with a common prefix of ``span`` bytes are copies, and a class of copies
   has a smallest doc_id. The answer to a snippet is one bit per start: whether
   a smaller document than the batch's own smallest holds that string.
3. Batches mark the bytes that flagged starts cover.

A string that a third of all documents hold is one entry per batch. Strings that
begin in a passage and run on into text of their own have the passage's anchors
but are all different; an anchor that occurs more than ``CROWDED`` times is
therefore split: its strings are sent one by one, each to the part of its own
hash, where equal ones meet as before. Batches and parts hold about
``BATCH_BYTES`` of text but for an entry a batch of each string that all share.
The texts are shuffled once; the three steps read the same exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, record_batch, text_bytes

SPAN = 50
# Text of a batch, and about the text whose anchors meet in one part.
BATCH_BYTES = 8 << 20
# Occurrences of an anchor whose strings one part takes together.
CROWDED = 40_000

_GRAM = 24
_WINDOW = 35
_SLICE = 1 << 17
_POSITION = np.uint64((1 << 20) - 1)
_LOW_BITS = 39
_NO_ID = np.iinfo(np.int64).max
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, first byte highest."""
    n = len(data) - 7
    out = np.empty(n, np.uint64)
    for offset in range(min(8, n)):
        count = (n - offset + 7) // 8
        out[offset::8] = data[offset : offset + 8 * count].view(">u8")
    return out


class Batch:
    """Texts end to end, each followed by one byte 0xFF, which UTF-8 does not have."""

    def __init__(self, rows: pa.Table | pa.RecordBatch):
        ids = rows.column("doc_id").to_pylist()
        texts = [t or b"" for t in rows.column("text").to_pylist()]
        # The same order in every step, however the rows arrive.
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids = [ids[i] for i in order]
        self.rank = np.array([_NO_ID if i is None else i for i in self.ids], np.int64)
        self.length = np.array([len(texts[i]) for i in order], np.int64)
        self.begin = np.cumsum(self.length + 1) - self.length - 1
        self.size = int((self.length + 1).sum())
        self.bytes = b"".join(part for i in order for part in (texts[i], b"\xff")) + b"\xff" * 128
        self.data = np.frombuffer(self.bytes, np.uint8)


class Runs(NamedTuple):
    """Runs of string starts with one anchor: first start, number of starts, anchor hash."""

    start: np.ndarray
    count: np.ndarray
    hash: np.ndarray


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    reach, least = 1, keys
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    return np.minimum(least[: len(least) - (width - reach)], least[width - reach :]) if width > reach else least


def anchor_runs(batch: Batch, span: int) -> Runs:
    """All string starts of the batch, by anchor; strings stay inside their text."""
    width = min(_WINDOW, span - _GRAM + 1)
    edges = np.zeros(batch.size + 1, np.int8)
    long = batch.length >= span
    edges[batch.begin[long]] += 1
    edges[batch.begin[long] + batch.length[long] - span + 1] -= 1
    inside = np.cumsum(edges, dtype=np.int8).astype(bool)
    found = []
    for a in range(0, batch.size, _SLICE):
        b = min(a + _SLICE, batch.size)
        valid = inside[a:b]
        if not valid.any():
            continue
        grams = b - a + width - 1
        word = loads(batch.data[a : b + width + _GRAM + 8])
        mixed = word[:grams] * _MIX[0]
        mixed ^= word[8 : grams + 8] * _MIX[1]
        mixed ^= mixed >> np.uint64(31)
        mixed += word[16 : grams + 16] * _MIX[1]
        mixed ^= mixed >> np.uint64(29)
        mixed *= _MIX[2]
        mixed ^= mixed >> np.uint64(32)
        # The smallest hash, the leftmost of equal ones.
        key = (mixed & ~_POSITION) | np.arange(grams, dtype=np.uint64)
        anchor = (_sliding_least(key, width) & _POSITION).astype(np.int32)
        new = np.ones(b - a, bool)
        new[1:] = anchor[1:] != anchor[:-1]
        new[1:] |= ~valid[:-1]
        breaks = np.flatnonzero(new | ~valid)
        ends = np.append(breaks[1:], b - a)
        real = valid[breaks]
        start = breaks[real]
        found.append((start + a, ends[real] - start, mixed[anchor[start]]))
    if not found:
        return Runs(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    start, count, least = (np.concatenate(c) for c in zip(*found, strict=True))
    # Smallest hashes crowd together; mixed once more they spread over the parts.
    spread = least * _MIX[0]
    return Runs(start, count, spread ^ (spread >> np.uint64(32)))


def bucket_keys(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each hash, and the low bits that tell hashes of a part apart."""
    part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return part, hashes & np.uint64((1 << _LOW_BITS) - 1)


def pack5(values: np.ndarray) -> bytes:
    """Numbers below 2**40 as five bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack5(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.uint64)


def _by_part(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Slices of equal values of a sorted array."""
    if len(part):
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
        for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
            yield int(part[a]), slice(a, b)


# --- step 1: which anchors occur in two documents ------------------------------------

_ANCHORS = pa.schema([("part", pa.int64()), ("batch", pa.int64()), ("hashes", pa.binary()), ("more", pa.binary())])


def batch_anchors(batch: Batch, span: int, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
    """For each part, the batch's distinct anchors; the lowest bit says whether two documents here have it.

    Beside them stand (place in the list, further occurrences) of those that occur again.
    """
    runs = anchor_runs(batch, span)
    rank = batch.rank[np.searchsorted(batch.begin, runs.start, "right") - 1]
    order = np.argsort(runs.hash)
    hashes, rank = runs.hash[order], rank[order]
    if not len(hashes):
        return
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    further = np.diff(np.append(first, len(hashes))) - 1
    several = np.minimum.reduceat(rank, first) != np.maximum.reduceat(rank, first)
    part, low = bucket_keys(hashes[first], parts)  # in order of the parts already
    values = (low << np.uint64(1)) | several.astype(np.uint64)
    for number, where in _by_part(part):
        again = np.flatnonzero(further[where])
        yield number, pack5(values[where]), np.column_stack([again, further[where][again]]).astype("<u4").tobytes()


def repeated_anchors(batches: list[int], blobs: list[bytes], more: list[bytes], crowded: int) -> Iterator[tuple[int, bytes]]:
    """For each batch, those of its anchors in this part that two documents have; the lowest bit marks crowded ones."""
    values = [unpack5(b) for b in blobs]
    owner = np.repeat(np.arange(len(values)), [len(v) for v in values])
    flat = np.concatenate(values)
    occurrences = np.ones(len(flat), np.int64)
    ahead = 0
    for found, extra in zip(values, more, strict=True):
        place, further = np.frombuffer(extra, "<u4").reshape(-1, 2).T
        occurrences[ahead + place] += further
        ahead += len(found)
    order = np.argsort(flat >> np.uint64(1), kind="stable")
    low, several = flat[order] >> np.uint64(1), (flat[order] & np.uint64(1)).astype(bool)
    first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    size = np.diff(np.append(first, len(low)))
    repeated = np.repeat((size > 1) | np.logical_or.reduceat(several, first), size)
    marked = (low << np.uint64(1)) | np.repeat(np.add.reduceat(occurrences[order], first) > crowded, size).astype(np.uint64)
    marked, owner = marked[repeated], owner[order][repeated]
    by_owner = np.argsort(owner, kind="stable")
    for number, where in _by_part(owner[by_owner]):
        yield batches[number], pack5(marked[by_owner][where])


# --- step 2: snippets, and their suffixes in order -------------------------------------


def rising(data: np.ndarray, depth: int) -> np.ndarray:
    """Whether the suffix at each position is smaller than its successor.

    Decided by the next different byte; ``depth`` equal bytes count as smaller,
    which keeps the order right as far as ``depth``.
    """
    n = len(data)
    where = np.arange(n, dtype=np.int32)
    change = np.where(np.append(data[1:] != data[:-1], True), where, np.int32(n))
    change = np.minimum.accumulate(change[::-1])[::-1]
    following = data[np.minimum(change + 1, n - 1)]
    return (following > data) | (change - where >= depth - 1)


def sorted_directly(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``at`` by the bytes that follow, at least ``depth`` of them."""
    if not len(at):
        return at
    # Refine groups of equal words, eight bytes a round; single ones are done.
    order = np.argsort(words[at], kind="stable")
    at = at[order]
    tied = np.arange(len(at))
    group = np.cumsum(np.append(False, words[at][1:] != words[at][:-1]))
    for offset in range(8, depth, 8):
        several = np.bincount(group)[group] > 1
        tied, group = tied[several], group[several]
        if not len(tied):
            break
        word = words[at[tied] + offset]
        order = np.lexsort((word, group))
        at[tied] = at[tied[order]]
        group, word = group[order], word[order]
        group = np.cumsum(np.append(False, (group[1:] != group[:-1]) | (word[1:] != word[:-1])))
    return at


def two_stage_order(data: np.ndarray, words: np.ndarray, active: np.ndarray, depth: int) -> np.ndarray:
    """Active suffixes in order of their first ``depth`` bytes.

    Suffixes smaller than their successor are sorted directly. Each of the
    others follows from its successor, which must be active too: scanning the
    buckets of first bytes in order, the predecessor of every suffix met that
    starts with a larger byte (or the same, if it is not smaller than its
    successor) is the next one of its own bucket.
    """
    small = rising(data, depth)
    direct = sorted_directly(words, np.flatnonzero(active & small), depth)
    heads = np.searchsorted(data[direct], np.arange(257))
    placed: list[list[np.ndarray]] = [[] for _ in range(256)]
    result = []
    for byte in range(256):
        induced = placed[byte]
        new = np.concatenate(induced) if induced else direct[:0]
        bucket = [new]
        while len(new):
            before = new - 1
            new = before[active[before] & ~small[before] & (data[before] == byte)]
            bucket.append(new)
        full = np.concatenate([*bucket, direct[heads[byte] : heads[byte + 1]]])
        placed[byte] = []
        if not len(full):
            continue
        result.append(full)
        before = full - 1
        before = before[active[before] & (data[before] > byte)]
        head = data[before]
        order = np.argsort(head, kind="stable")
        before, head = before[order], head[order]
        for number, where in _by_part(head):
            placed[number].append(before[where])
    return np.concatenate(result) if result else direct


def equal_to_previous(words: np.ndarray, order: np.ndarray, span: int) -> np.ndarray:
    """Whether each suffix shares its first ``span`` bytes with the one before it."""
    same = np.ones(len(order), bool)
    same[:1] = False
    for offset in range(0, span, 8):
        here = words[order + offset]
        if span - offset < 8:
            here = here >> np.uint64(8 * (8 - (span - offset)))
        same[1:] &= here[1:] == here[:-1]
    return same


_SNIPPETS = pa.schema(
    [("part", pa.int64()), ("batch", pa.int64()), ("number", pa.binary()), ("starts", pa.binary()), ("length", pa.binary()), ("least", pa.binary()), ("content", pa.binary())]
)


class Snippets(NamedTuple):
    """Runs whose anchor repeats, and the batch's distinct snippets."""

    runs: Runs
    rank: np.ndarray  # of each run's document
    number: np.ndarray  # of each run's snippet
    least: np.ndarray  # smallest document of each snippet
    content: list[bytes]  # number of starts as one byte, then the bytes
    part: np.ndarray  # of each snippet


def batch_snippets(batch: Batch, span: int, parts: int, repeated: np.ndarray) -> Snippets:
    """``repeated``: sorted keys (part, low bits, crowded) of anchors that two documents have."""
    runs = anchor_runs(batch, span)
    part, low = bucket_keys(runs.hash, parts)
    key = (part << np.uint64(_LOW_BITS)) | low
    if len(repeated):
        at = np.minimum(np.searchsorted(repeated >> np.uint64(1), key), len(repeated) - 1)
        hit = repeated[at] >> np.uint64(1) == key
        split = (repeated[at] & np.uint64(1)).astype(bool)[hit]
    else:
        hit, split = np.zeros(len(key), bool), np.zeros(0, bool)
    start, count, anchor = (c[hit] for c in runs)
    # Runs of crowded anchors become as many runs of one start.
    copies = np.where(split, count, 1)
    offset = np.arange(int(copies.sum())) - np.repeat(np.cumsum(copies) - copies, copies)
    split = np.repeat(split, copies)
    runs = Runs(np.repeat(start, copies) + offset, np.where(split, 1, np.repeat(count, copies)), np.repeat(anchor, copies))
    part = np.repeat(part[hit].astype(np.int64), copies)
    doc = np.searchsorted(batch.begin, runs.start, "right") - 1
    ends = np.flatnonzero(rising(batch.data, span))
    seed = ends[np.searchsorted(ends, runs.start + runs.count - 1)]
    # A string by itself ends where it ends: equal ones are equal snippets.
    stop = np.where(split, runs.start + span, np.minimum(seed + span, (batch.begin + batch.length)[doc]))
    sizes = [bytes([i]) for i in range(256)]
    numbers: dict[bytes, int] = {}
    data = batch.bytes
    number = np.fromiter(
        (
            numbers.setdefault(sizes[n] + data[a:b], len(numbers))
            for a, b, n in zip(runs.start.tolist(), stop.tolist(), runs.count.tolist(), strict=True)
        ),
        np.int64,
        len(runs.start),
    )
    for i in np.flatnonzero(split).tolist():
        a = int(runs.start[i])
        part[i] = xxhash.xxh3_64_intdigest(data[a : a + span]) % parts
    least = np.full(len(numbers), _NO_ID, np.int64)
    np.minimum.at(least, number, batch.rank[doc])
    own_part = np.zeros(len(numbers), np.int64)
    own_part[number] = part
    return Snippets(runs, batch.rank[doc], number, least, list(numbers), own_part)


def snippet_rows(found: Snippets) -> Iterator[tuple]:
    order = np.argsort(found.part, kind="stable")
    for part, where in _by_part(found.part[order]):
        chosen = order[where]
        content = [found.content[i] for i in chosen.tolist()]
        yield (
            part,
            chosen.astype("<u4").tobytes(),
            bytes(c[0] for c in content),
            np.array([len(c) - 1 for c in content], "<u4").tobytes(),
            found.least[chosen].astype("<i8").tobytes(),
            zstandard.compress(b"".join(c[1:] for c in content), 3),
        )


def flagged_starts(rows: list[dict], span: int) -> Iterator[tuple[int, bytes, bytes]]:
    """For each batch: numbers of snippets, and a bit for each start that a smaller document has too."""
    # Distinct snippets over all batches, with their smallest document.
    known: dict[tuple[int, bytes], int] = {}
    entry_owner, entry_number, entry_least, entry_known = [], [], [], []
    for owner, row in enumerate(rows):
        ends = np.cumsum(np.frombuffer(row["length"], "<u4").astype(np.int64)).tolist()
        content, starts = zstandard.decompress(row["content"]), row["starts"]
        at, mine = 0, []
        for end, count in zip(ends, starts, strict=True):
            mine.append(known.setdefault((count, content[at:end]), len(known)))
            at = end
        entry_known.append(np.array(mine, np.int64))
        entry_number.append(np.frombuffer(row["number"], "<u4"))
        entry_least.append(np.frombuffer(row["least"], "<i8"))
        entry_owner.append(np.full(len(mine), owner))
    entry_owner, entry_number, entry_least, entry_known = map(
        np.concatenate, (entry_owner, entry_number, entry_least, entry_known)
    )
    least = np.full(len(known), _NO_ID, np.int64)
    np.minimum.at(least, entry_known, entry_least)
    count = np.array([k[0] for k in known], np.int64)
    length = np.array([len(k[1]) for k in known], np.int64)
    begin = np.cumsum(length + 1) - length
    raw = b"\xff" + b"".join(part for k in known for part in (k[1], b"\xff")) + b"\xff" * (span + 16)
    del known
    data = np.frombuffer(raw, np.uint8)
    words = loads(data)

    def marked(upto: np.ndarray) -> np.ndarray:
        edges = np.zeros(len(data) + 1, np.int8)
        edges[begin] += 1
        np.add.at(edges, upto, -1)
        return np.cumsum(edges[:-1], dtype=np.int8).astype(bool)

    # Starts, and what follows the last one up to the next suffix that is sorted directly.
    ends = np.flatnonzero(rising(data, span))
    seed = ends[np.searchsorted(ends, begin + count - 1)]
    order = two_stage_order(data, words, marked(seed + 1), span)
    order = order[marked(begin + count)[order]]
    same = equal_to_previous(words, order, span)
    first = np.flatnonzero(~same)
    owner = np.searchsorted(begin, order, "right") - 1
    smallest = np.minimum.reduceat(least[owner], first)
    overall = np.full(len(data), _NO_ID, np.int64)
    overall[order] = np.repeat(smallest, np.diff(np.append(first, len(order))))
    # Back to the snippets as the batches know them.
    width = count[entry_known]
    ahead = np.cumsum(width) - width
    offset = np.arange(int(width.sum())) - np.repeat(ahead, width)
    smaller = overall[np.repeat(begin[entry_known], width) + offset] < np.repeat(entry_least, width)
    mask = np.add.reduceat(smaller.astype(np.uint64) << offset.astype(np.uint64), ahead)
    some = mask != 0
    entry_owner, entry_number, mask = entry_owner[some], entry_number[some], mask[some]
    for number, where in _by_part(entry_owner):
        yield rows[number]["batch"], entry_number[where].tobytes(), mask[where].astype("<u8").tobytes()


# --- step 3: bytes to remove -------------------------------------------------------------


def covered_bytes(batch: Batch, span: int, found: Snippets, masks: dict[int, int] | np.ndarray) -> np.ndarray:
    """Whether each byte of the batch goes."""
    starts = np.zeros(batch.size + 1, np.int32)
    every = found.rank > found.least[found.number]
    a, n = found.runs.start[every], found.runs.count[every]
    np.add.at(starts, a, 1)
    np.add.at(starts, a + n, -1)
    flagged = np.cumsum(starts[:-1]) > 0
    rest = ~every
    bits = masks[found.number[rest]]
    at = found.runs.start[rest]
    while (some := bits != 0).any():
        at, bits = at[some], bits[some]
        flagged[at[(bits & np.uint64(1)).astype(bool)]] = True
        at, bits = at + 1, bits >> np.uint64(1)
    total = np.cumsum(flagged, dtype=np.int32)
    total[span:] -= total[:-span].copy()
    return total > 0


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_REPLIES = pa.schema([("batch", pa.int64()), ("part", pa.int64()), ("hashes", pa.binary()), ("number", pa.binary()), ("mask", pa.binary())])
_REPLIES_DDL = "batch bigint, part bigint, hashes binary, number binary, mask binary"


def _tabled(schema: pa.Schema, rows: Iterator[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.Table.from_batches([record_batch(schema, [list(c) for c in columns])])


def _repeated_keys(replies: pa.Table) -> np.ndarray:
    """Sorted keys (part, low bits, crowded); the part's number fills the bits above."""
    rows = [
        (np.uint64(part) << np.uint64(_LOW_BITS + 1)) | unpack5(blob)
        for part, blob in zip(replies.column("part").to_pylist(), replies.column("hashes").to_pylist(), strict=True)
        if blob is not None
    ]
    return np.sort(np.concatenate(rows)) if rows else np.zeros(0, np.uint64)


def _masks(replies: pa.Table, snippets: int) -> np.ndarray:
    masks = np.zeros(snippets, np.uint64)
    for number, mask in zip(replies.column("number").to_pylist(), replies.column("mask").to_pylist(), strict=True):
        if number is not None:
            masks[np.frombuffer(number, "<u4")] = np.frombuffer(mask, "<u8")
    return masks


class _Steps:
    """The three steps as functions of Arrow tables."""

    def __init__(self, span: int, parts: int, crowded: int):
        self.span, self.parts, self.crowded = span, parts, crowded

    def anchors(self, rows: pa.Table) -> pa.Table:
        number = rows.column("batch")[0].as_py()
        return _tabled(_ANCHORS, ((part, number, *blobs) for part, *blobs in batch_anchors(Batch(rows), self.span, self.parts)))

    def repeated(self, rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        found = repeated_anchors(*(rows.column(c).to_pylist() for c in ("batch", "hashes", "more")), self.crowded)
        return _tabled(_REPLIES, ((batch, part, blob, None, None) for batch, blob in found))

    def snippets(self, rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows or not replies.num_rows:
            return _SNIPPETS.empty_table()
        number = rows.column("batch")[0].as_py()
        found = batch_snippets(Batch(rows), self.span, self.parts, _repeated_keys(replies))
        return _tabled(_SNIPPETS, ((part, number, *rest) for part, *rest in snippet_rows(found)))

    def flags(self, rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        found = flagged_starts(rows.to_pylist(), self.span)
        return _tabled(_REPLIES, ((batch, part, None, number, mask) for batch, number, mask in found))

    def digest(self, rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _DIGEST.empty_table()
        batch = Batch(rows)
        found = batch_snippets(batch, self.span, self.parts, _repeated_keys(replies))
        covered = covered_bytes(batch, self.span, found, _masks(replies, len(found.least)))
        edges = np.append(covered[:1], covered[1:] & ~covered[:-1])
        before = np.append(0, np.cumsum(covered, dtype=np.int64))
        spans = np.append(0, np.cumsum(edges, dtype=np.int64))
        out = []
        for doc_id, a, n in zip(batch.ids, batch.begin.tolist(), batch.length.tolist(), strict=True):
            gone = int(before[a + n] - before[a])
            kept = batch.data[a : a + n][~covered[a : a + n]].tobytes() if gone else batch.bytes[a : a + n]
            out.append((doc_id, n, gone, int(spans[a + n] - spans[a]), hashlib.sha256(kept).hexdigest()))
        return _tabled(_DIGEST, iter(out))


def span_digest(docs: DataFrame, span: int = SPAN, batch_bytes: int = BATCH_BYTES, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs`` (doc_id, text).

    A byte goes if a string of ``span`` bytes around it also starts in a
    document with a smaller doc_id. ``span`` is at least 24. Null and empty
    texts have no bytes. A row without doc_id counts as larger than all others.
    Rows of one doc_id do not remove each other's text. Other columns are
    ignored. A text of any length is one piece of its batch. ``crowded`` is the
    number of occurrences above which the strings of an anchor are dealt out
    one by one.
    """
    if span < _GRAM:
        raise ValueError(f"span must be at least {_GRAM}")
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
    parts = blocks_for(narrow, F.octet_length("text"), batch_bytes)
    steps = _Steps(span, parts, crowded)
    batch = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(parts))
    batches = narrow.select(batch.alias("batch"), "doc_id", "text").repartition(parts, "batch")
    anchors = batches.groupBy("batch").applyInArrow(lambda rows: steps.anchors(rows), "part bigint, batch bigint, hashes binary, more binary")
    repeated = anchors.groupBy("part").applyInArrow(lambda rows: steps.repeated(rows), _REPLIES_DDL)
    snippets = batches.groupBy("batch").cogroup(repeated.groupBy("batch")).applyInArrow(
        lambda rows, replies: steps.snippets(rows, replies),
        "part bigint, batch bigint, number binary, starts binary, length binary, least binary, content binary",
    )
    flags = snippets.groupBy("part").applyInArrow(lambda rows: steps.flags(rows), _REPLIES_DDL)
    replies = repeated.unionByName(flags)
    return batches.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(
        lambda rows, replies: steps.digest(rows, replies),
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )
