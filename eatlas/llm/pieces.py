"""Sampled segmentations of text into the pieces of a SentencePiece model.

A text is a lattice of pieces. Its segmentations are sampled with probability
proportional to the product of their pieces' weights: a forward pass adds up the
weights of all paths to each position, and a backward pass draws the last piece
of each position in turn. Draws come from a counter-based generator keyed by the
row, the unit's number in the text and the step, so a row gets the same pieces
wherever and whenever it is encoded.

No piece goes on after a blank that follows other text, so the lattice falls
into units (blanks and the word after them), which are independent. Equal units
of a batch share their forward pass; all of a batch's units are filtered and
sampled together, one position or step at a time.

The model has merge ranks instead of probabilities; by Zipf's law a piece of rank
r weighs 1 / (r + 2). Characters without a piece are spelt in byte pieces, and so
is the model's blank sign where a text has it, which keeps decoding lossless.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, rows_of, text_bytes

SEED = 42
TEMPERATURE = 1.0
# Text encoded at a time; longer texts are encoded in segments of this size.
BATCH_CHARS = 1 << 20

_BLANK = "▁"
_CODES = np.uint64(1 << 21)


_FREE = np.uint64((1 << 64) - 1)


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (size.bit_length() - 1))


def _hashed(keys: np.ndarray, values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in a table at least four times as large, each at its slot or the next free one after it."""
    size = 1 << (4 * len(keys)).bit_length()
    slots, found = np.full(size + len(keys), _FREE), np.zeros(size + len(keys), np.int32)
    for key, slot, value in zip(keys, _slot(keys, size).tolist(), values, strict=True):
        while slots[slot] != _FREE:
            slot += 1
        slots[slot], found[slot] = key, value
    return slots, found


class Vocabulary:
    """Pieces of a model as a trie over code points."""

    def __init__(self, path: str, temperature: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        rank = np.array([min(-model.get_score(i), size) for i in range(size)])
        self.weight = -np.log(rank + 2) * temperature
        self.byte_id = np.zeros(256, np.int32)
        self.spelling = [b""] * size
        normal = []
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_id[int(name[3:-1], 16)] = i
                self.spelling[i] = bytes([int(name[3:-1], 16)])
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                normal.append((name.replace(_BLANK, " "), i))
                self.spelling[i] = normal[-1][0].encode()
        # A byte is less likely than any piece.
        self.byte_weight = float(-np.log(size + 2) * temperature)
        states, edges, ends = {"": 0}, {}, {0: -1}
        for name, i in normal:
            for n in range(1, len(name) + 1):
                state = states.setdefault(name[:n], len(states))
                edges[states[name[: n - 1]], ord(name[n - 1])] = state
            ends[states[name]] = i
        self.slots, self.next = _hashed(np.array([s * int(_CODES) + c for s, c in edges], np.uint64), list(edges.values()))
        self.piece = np.array([ends.get(s, -1) for s in range(len(states))], np.int32)
        self.size = 1 << (4 * len(edges)).bit_length()
        self.longest = max(len(name) for name, _ in normal)
        inner = {c for name, _ in normal for c in name.lstrip(" ")}
        if " " in inner:
            raise ValueError("a piece goes on after a blank; units are not independent")
        # A line feed that no piece holds is a unit of its own.
        self.units = re.compile(r" +[^ \n]*|\n|[^ \n]+" if "\n" not in inner else r" +[^ ]*|[^ ]+")

    def follow(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which states go on with their code point, and to which states."""
        keys = state.astype(np.uint64) * _CODES + codes
        slot = _slot(keys, self.size)
        there = self.slots[slot]
        lost = np.flatnonzero((there != keys) & (there != _FREE))
        while len(lost):
            slot[lost] += np.uint64(1)
            there[lost] = self.slots[slot[lost]]
            lost = lost[(there[lost] != keys[lost]) & (there[lost] != _FREE)]
        alive = there == keys
        return alive, self.next[slot[alive]]


@cache
def vocabulary(path: str, temperature: float = TEMPERATURE) -> Vocabulary:
    return Vocabulary(path, temperature)


class Lattice(NamedTuple):
    """Edges of all distinct units, sorted by the node they end in."""

    first: np.ndarray  # first node of each unit
    last: np.ndarray  # last node of each unit
    head: np.ndarray  # first edge of each node
    upto: np.ndarray  # cumulated chance of each edge within its end node
    start: np.ndarray  # node an edge starts from
    piece: np.ndarray  # piece of an edge, or minus the code point spelt in bytes


def _walk(vocab: Vocabulary, codes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, length, piece) of every piece found in the text."""
    at = np.arange(len(codes), dtype=np.int32)
    state = np.zeros(len(codes), np.int32)
    found: list[tuple] = []
    for length in range(1, vocab.longest + 1):
        fits = room[at] >= length
        at, state = at[fits], state[fits]
        alive, state = vocab.follow(state, codes[at + (length - 1)])
        at = at[alive]
        piece = vocab.piece[state]
        real = piece >= 0
        found.append((at[real], np.full(int(real.sum()), length, np.int32), piece[real]))
        if length == 1:
            lone = np.ones(len(codes), bool)
            lone[at[real]] = False
            spelt = np.flatnonzero(lone).astype(np.int32)
            found.append((spelt, np.ones(len(spelt), np.int32), -codes[spelt].astype(np.int32) - 1))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _utf8_length(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)


def lattice(vocab: Vocabulary, units: list[str]) -> Lattice:
    """Forward filtering of distinct units: the chance of each edge given the node it ends in."""
    codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, units), np.int32, len(units))
    begin = np.cumsum(size, dtype=np.int32) - size
    offset = np.arange(len(codes), dtype=np.int32) - np.repeat(begin, size)
    at, length, piece = _walk(vocab, codes, np.repeat(size, size) - offset)
    # A unit has one node more than characters.
    unit = np.repeat(np.arange(len(units), dtype=np.int32), size)
    start = at + unit[at]
    weight = vocab.weight[np.maximum(piece, 0)]
    spelt = np.flatnonzero(piece < 0)
    weight[spelt] = vocab.byte_weight * _utf8_length(-piece[spelt] - 1)
    level = (offset[at] + length).astype(np.uint16 if size.max(initial=0) < 1 << 16 else np.int32)
    order = np.argsort(start + length, kind="stable")
    start, piece, weight, level, end = start[order], piece[order], weight[order], level[order], (start + length)[order]
    first = begin + np.arange(len(units), dtype=np.int32)
    total = np.full(len(codes) + len(units), -np.inf)
    total[first] = 0.0
    by_level = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[by_level], np.arange(1, int(size.max(initial=0)) + 2))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        edges = by_level[a:b]
        nodes = end[edges]
        heads = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1]))
        total[nodes[heads]] = np.logaddexp.reduceat(total[start[edges]] + weight[edges], heads)
    chance = np.exp(total[start] + weight - total[end])
    heads = np.flatnonzero(np.append(True, end[1:] != end[:-1])) if len(end) else np.zeros(0, np.int64)
    tails = np.append(heads[1:], len(end))[: len(heads)]
    upto = np.cumsum(chance)
    upto -= np.repeat(upto[heads] - chance[heads], tails - heads)
    upto[tails - 1] = 1.0
    head = np.zeros(len(total), np.int32)
    head[end[heads]] = heads
    return Lattice(first, first + size, head, upto, start, piece)


def _uniform(key: np.ndarray, number: np.ndarray, step: int) -> np.ndarray:
    """A number in [0, 1) for each (row key, unit number) and step."""
    salt = (step + 1) * 0xD1B54A32D192ED03 % (1 << 64)
    x = key + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def sampled(found: Lattice, unit: np.ndarray, key: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backward sampling: (occurrence, edge) of every piece, in reading order."""
    node, active = found.last[unit], np.arange(len(unit))
    taken: list[tuple] = []
    step = 0
    while len(active):
        draw = _uniform(key[active], number[active], step)
        chosen = found.head[node]
        beyond = np.flatnonzero(draw >= found.upto[chosen])
        while len(beyond):  # at most as often as a node has edges
            chosen[beyond] += 1
            beyond = beyond[draw[beyond] >= found.upto[chosen[beyond]]]
        taken.append((active, chosen))
        node = found.start[chosen]
        rest = node > found.first[unit[active]]
        active, node = active[rest], node[rest]
        step += 1
    if not taken:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Later steps stand further left.
    occurrence = np.concatenate([o for o, _ in reversed(taken)])
    edge = np.concatenate([e for _, e in reversed(taken)])
    order = np.argsort(occurrence, kind="stable")
    return occurrence[order], edge[order]


def _spelt(vocab: Vocabulary, codes: np.ndarray) -> list[np.ndarray]:
    return [vocab.byte_id[list(chr(c).encode("utf-8", "surrogatepass"))] for c in codes.tolist()]


def encode(vocab: Vocabulary, texts: list[str], keys: np.ndarray, ahead: np.ndarray) -> list[np.ndarray]:
    """Piece ids of each text. ``ahead`` counts the units before the text, if it is a later segment."""
    split = [vocab.units.findall(t) for t in texts]
    count = np.array([len(units) for units in split], np.int64)
    flat = list(itertools.chain.from_iterable(split))
    numbers = {u: i for i, u in enumerate(dict.fromkeys(flat))}
    unit = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
    text = np.repeat(np.arange(len(texts)), count)
    number = np.arange(len(unit)) - np.repeat(np.cumsum(count) - count, count) + ahead[text]
    found = lattice(vocab, list(numbers))
    occurrence, edge = sampled(found, unit, keys[text], number)
    piece = found.piece[edge]
    owner = text[occurrence]
    spelt = np.flatnonzero(piece < 0)
    if len(spelt):
        parts = _spelt(vocab, -piece[spelt] - 1)
        length = np.ones(len(piece), np.int64)
        length[spelt] = [len(p) for p in parts]
        begin = np.cumsum(length) - length
        longer = np.repeat(piece, length)
        place = np.repeat(begin[spelt], length[spelt]) + np.concatenate([np.arange(len(p)) for p in parts])
        longer[place] = np.concatenate(parts)
        piece, owner = longer, np.repeat(owner, length)
    return np.split(piece.astype(np.int32), np.searchsorted(owner, np.arange(1, len(texts))))


def decode(vocab: Vocabulary, ids: list[int]) -> bytes:
    """UTF-8 text of piece ids, without the blank that encoding puts in front."""
    return b"".join(map(vocab.spelling.__getitem__, ids))[1:]


def segments(vocab: Vocabulary, text: str, most: int) -> Iterator[str]:
    """A text, with a blank in front, in segments of about ``most`` characters that end with a unit."""
    text = " " + text if text else ""
    start = 0
    while len(text) - start > most:
        found = vocab.units.match(text, start + most - 1)
        # From the middle of a unit to its end; blanks inside a run belong to the unit that follows.
        end = found.end() if found else len(text)
        yield text[start:end]
        start = end
    if start < len(text):
        yield text[start:]


_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("lossless", pa.bool_()), ("ids", pa.list_(pa.int32()))])


def encoded(docs: DataFrame, model: str, seed: int = SEED, temperature: float = TEMPERATURE, batch: int = BATCH_CHARS) -> DataFrame:
    """(doc_id, n_pieces, lossless, ids) of every row of ``docs`` (doc_id, text).

    ``ids`` is a sampled segmentation, the same at every run; ``lossless`` says
    that decoding it gives the text back. Null and empty texts have no pieces.
    Rows of one doc_id and text get the same pieces; rows without doc_id share
    a key. ``model`` is the path of the model file, at the same place on every
    machine. Other columns are ignored. No row moves between tasks.
    """

    def finished(vocab: Vocabulary, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        pieces: list[tuple[int, str, int]] = []
        for i, (_, _, text) in enumerate(rows):
            ahead = 0
            for part in segments(vocab, text, batch):
                pieces.append((i, part, ahead))
                ahead += len(vocab.units.findall(part)) if len(text) > batch else 0
        found: list[list[np.ndarray]] = [[] for _ in rows]
        at = 0
        while at < len(pieces):
            size, stop = 0, at
            while stop < len(pieces) and (stop == at or size + len(pieces[stop][1]) <= 2 * batch):
                size, stop = size + len(pieces[stop][1]), stop + 1
            group = pieces[at:stop]
            keys = np.array([rows[i][1] for i, _, _ in group], np.int64).view(np.uint64)
            ids = encode(vocab, [part for _, part, _ in group], keys, np.array([a for _, _, a in group], np.int64))
            for (i, _, _), own in zip(group, ids, strict=True):
                found[i].append(own)
            at = stop
        whole = [np.concatenate(f) if f else np.zeros(0, np.int32) for f in found]
        same = [decode(vocab, ids.tolist()) == text.encode() for ids, (_, _, text) in zip(whole, rows, strict=True)]
        lengths = np.array([len(ids) for ids in whole], np.int64)
        values = pa.array(np.concatenate(whole) if whole else np.zeros(0, np.int32), pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), values)
        yield record_batch(_ENCODED, [[r[0] for r in rows], lengths.tolist(), same, lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, rows, size = vocabulary(model, temperature), [], 0
        for doc_id, key, text in rows_of(batches, "doc_id", "key", "text"):
            text = (text or b"").decode("utf-8", "replace")
            rows.append((doc_id, key, text))
            size += len(text)
            if size >= batch:
                yield from finished(vocab, rows)
                rows, size = [], 0
        if rows:
            yield from finished(vocab, rows)

    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", F.lit(seed)).alias("key"), text_bytes().alias("text")
    )
    return narrow.mapInArrow(run, "doc_id bigint, n_pieces bigint, lossless boolean, ids array<int>")
