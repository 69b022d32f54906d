"""Runs: stretches of a document in which a sequence of words repeats at once.

A run with period q that starts at word i pairs the suffixes at i and i + q:
their common prefix is the run's length less q, and it can be extended neither
to the right (it is a longest common prefix) nor to the left (the words before
both differ). Runs are thus the maximal pairs (i, j) whose distance is at most
their common prefix, and nothing has to be extended afterwards.

Maximal pairs come from the tree of LCP intervals, whose lists of positions are
kept by the word to the left; an interval with one left word holds no pair. Of
an interval's positions only neighbours in the text are compared: if another
occurrence of the common prefix began between i and i + q, both distances would
be periods and, by the theorem of Fine and Wilf, q would not be the smallest.
Neighbours come from a linked list of each interval's positions; from the root
downwards the smaller child is taken out of its parent's list, so that a
position moves a logarithmic number of times.

A run of at least n words in two periods has a common prefix of at least n / 2
words, its gram. Only documents are sorted in which a gram comes back near
enough and after another word, and of their tree only the intervals of such
grams are visited. Suffixes are sorted by doubling, which also gives their
common prefixes. Documents stay in their tasks: there is no shuffle, and a task holds
the words of about ``BATCH_WORDS`` words, or of one document if it is longer.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RowBuffer, rows_of, text_bytes

SHORTEST = 12
BATCH_WORDS = 1 << 18
# Different words that a Python worker keeps numbers for.
REMEMBERED = 1 << 20

_NONE = np.empty((0, 3), np.int64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class _Texts:
    """Words of several documents one after the other, as numbers."""

    ids: np.ndarray
    begin: np.ndarray
    """First word of the document of each word."""
    end: np.ndarray
    """Word behind the last one of the document of each word."""


def _grams(texts: _Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, class) of the grams of ``size`` words that come back in their document, by class."""
    ids, n = texts.ids, len(texts.ids)
    if n < size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    where = np.flatnonzero(np.arange(n - size + 1) + size <= texts.end[: n - size + 1])
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _ODD
    mixed ^= mixed >> np.uint64(29)
    key = texts.begin.astype(np.uint64)[: n - size + 1] * np.uint64(0xD6E8FEB86659FD93)
    for k in range(size):
        key *= np.uint64(0xFF51AFD7ED558CCD)
        key += mixed[k : n - size + 1 + k]
        key ^= key >> np.uint64(32)
    key = key[where]
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    again = np.append(same, False) | np.append(False, same)
    if not again.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = where[order[again]]
    first = ~np.append(False, same)[again]
    # Equal hashes are held against the words themselves.
    a, b = found[1:][~first[1:]], found[:-1][~first[1:]]
    if not all((ids[a + k] == ids[b + k]).all() for k in range(size)) or not (texts.begin[a] == texts.begin[b]).all():
        rows = np.column_stack([texts.begin[found], *(ids[found + k] for k in range(size))])
        _, group, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        group = group.reshape(-1)
        again = count[group] > 1
        found, group = found[again], np.unique(group[again], return_inverse=True)[1]
        order = np.argsort(group, kind="stable")
        return found[order], group[order]
    return found, np.cumsum(first) - 1


def _starts(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, np.int64)


def _left(texts: _Texts, at: np.ndarray) -> np.ndarray:
    """The word to the left of each position; -1 at the start of a document."""
    return np.where(at > texts.begin[at], texts.ids[at - 1], -1)


def _may_start(texts: _Texts, at: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
    """The classes in which a run may begin: several left words, and a next occurrence near enough.

    The common prefix of two positions is at most the stretch of recurring
    grams that begins at the first one.
    """
    left, starts = _left(texts, at), _starts(group)
    several = np.minimum.reduceat(left, starts) != np.maximum.reduceat(left, starts)
    n = len(texts.ids)
    recurs = np.zeros(n + 1, bool)
    recurs[at] = True
    gaps = np.flatnonzero(~recurs)
    stretch = gaps[np.searchsorted(gaps, at)] - at + size - 1
    order = np.lexsort((at, group))
    distance = np.full(len(at), n + 1, np.int64)
    same = group[order[1:]] == group[order[:-1]]
    distance[order[:-1][same]] = (at[order[1:]] - at[order[:-1]])[same]
    return several & np.logical_or.reduceat(distance <= stretch, starts)


class _Suffixes:
    """All suffixes in order, document by document, and the common prefixes of neighbours.

    Words are ordered by their numbers; a suffix comes before its extensions.
    """

    def __init__(self, texts: _Texts):
        self.texts = texts
        self.levels = self._doubled()
        self.order = np.argsort(self.levels[-1])
        self.lcp = self._prefixes()

    def _doubled(self) -> list[np.ndarray]:
        """Ranks by the first 1, 2, 4, ... words, until all differ."""
        texts, m = self.texts, len(self.texts.ids)
        key = texts.begin * (int(texts.ids.max()) + 1) + texts.ids
        order = np.argsort(key)
        first = np.append(True, key[order[1:]] != key[order[:-1]])
        rank = np.empty(m, np.int64)
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(m), 0))
        levels, step = [rank.astype(np.int32)], 1
        active = order[~(first & np.append(first[1:], True))]
        while len(active):
            there = active + step
            follows = np.where(there < texts.end[active], rank[np.minimum(there, m - 1)] + 1, 0)
            sort = np.argsort(rank[active] * (m + 1) + follows)
            active, follows = active[sort], follows[sort]
            old = rank[active]
            new_class = np.append(True, old[1:] != old[:-1])
            new_group = new_class | np.append(True, follows[1:] != follows[:-1])
            place = np.arange(len(active))
            base = np.maximum.accumulate(np.where(new_class, place, 0))
            rank = rank.copy()
            rank[active] = old + np.maximum.accumulate(np.where(new_group, place, 0)) - base
            levels.append(rank.astype(np.int32))
            active = active[~(new_group & np.append(new_group[1:], True))]
            step *= 2
        return levels

    def _prefixes(self) -> np.ndarray:
        """Common prefix of each suffix and the next one in the order."""
        texts, last = self.texts, len(self.texts.ids) - 1
        a, b = self.order[:-1], self.order[1:]
        together = texts.begin[a] == texts.begin[b]
        end, i, j = texts.end[a], a, b
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            equal = together & (i < end) & (j < end) & (rank[np.minimum(i, last)] == rank[np.minimum(j, last)])
            i, j = i + (equal << k), j + (equal << k)
        return i - a


def _joins(lcp: list[int]) -> list[tuple[int, int, int, int]]:
    """LCP intervals bottom-up as joins of two neighbouring ones: (low, middle, high, common prefix)."""
    joins, open_intervals = [], []
    for i in range(len(lcp) + 1):
        low, following = i, lcp[i] if i < len(lcp) else -1
        while open_intervals and open_intervals[-1][1] >= following:
            before, depth = open_intervals.pop()
            joins.append((before, low, i + 1, depth))
            low = before
        open_intervals.append((low, following))
    return joins


def maximal_pairs(positions: list[int], lcp: list[int], left: list[int], shortest: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs that begin at ``positions``, which stand in suffix order.

    ``lcp`` are the common prefixes of neighbours and ``left`` the words before
    the positions.
    """
    n = len(positions)
    by_place = sorted(range(n), key=positions.__getitem__)
    after, before = [-1] * n, [-1] * n

    def linked(members: list[int]) -> None:
        last = -1
        for x in members:
            before[x], after[x] = last, -1
            if last >= 0:
                after[last] = x
            last = x

    linked(by_place)
    # Where the class of equal left words that stand together ends.
    until = list(range(1, n + 1))
    for i in range(n - 2, -1, -1):
        if left[i] == left[i + 1]:
            until[i] = until[i + 1]
    for low, middle, high, depth in reversed(_joins(lcp)):
        if until[low] >= high:
            continue  # one left word: no pair here or below
        small = range(low, middle) if middle - low <= high - middle else range(middle, high)
        members = sorted(small, key=positions.__getitem__) if len(small) > 1 else list(small)
        first, last = small.start, small.stop
        for x in members:
            for y in (before[x], after[x]):
                if y >= 0 and not first <= y < last and left[x] != left[y]:
                    start, period = min(positions[x], positions[y]), abs(positions[x] - positions[y])
                    if period <= depth and period + depth >= shortest:
                        yield start, period + depth, period
        for x in members:
            b, a = before[x], after[x]
            if b >= 0:
                after[b] = a
            if a >= 0:
                before[a] = b
        linked(members)


def find_runs(ids: np.ndarray, lengths: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least ``shortest`` words and two periods.

    ``ids`` are the words of documents of ``lengths`` words, one after the
    other; runs do not cross documents. Sorted by start, then period.
    """
    ends = np.cumsum(lengths)
    texts = _Texts(ids, np.repeat(ends - lengths, lengths), np.repeat(ends, lengths))
    size = max(1, (shortest + 1) // 2)
    at, group = _grams(texts, size)
    if not len(at):
        return _NONE
    may = _may_start(texts, at, group, size)
    if not may.any():
        return _NONE
    begins = np.zeros(len(ids), bool)
    begins[at[may[group]]] = True
    # The documents in which a run may begin, by themselves.
    chosen = np.flatnonzero(np.logical_or.reduceat(begins, (ends - lengths)[lengths > 0]))
    chosen = np.flatnonzero(lengths > 0)[chosen]
    within = np.repeat(np.isin(np.arange(len(lengths)), chosen), lengths)
    words, begins, lengths = np.flatnonzero(within), begins[within], lengths[chosen]
    ends = np.cumsum(lengths)
    texts = _Texts(ids[words], np.repeat(ends - lengths, lengths), np.repeat(ends, lengths))
    suffixes = _Suffixes(texts)
    positions, left = suffixes.order, _left(texts, suffixes.order)
    classes = np.concatenate([[0], 1 + np.flatnonzero(suffixes.lcp < size), [len(positions)]])
    useful = begins[positions[classes[:-1]]] & (np.diff(classes) > 1)
    found = []
    for low, high in zip(classes[:-1][useful].tolist(), classes[1:][useful].tolist(), strict=True):
        found += maximal_pairs(positions[low:high].tolist(), suffixes.lcp[low : high - 1].tolist(), left[low:high].tolist(), shortest)
    if not found:
        return _NONE
    rows = np.array(found, np.int64)
    rows[:, 0] = words[rows[:, 0]]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


Rewrite = Callable[[int | None, int], np.ndarray | None]


class Finder:
    """Runs of batches of texts; numbers of words are kept between batches."""

    def __init__(self, shortest: int = SHORTEST):
        self.shortest, self.numbers = shortest, defaultdict(itertools.count().__next__)

    def __call__(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Runs of each text, given by its words; starts count from the text's first word."""
        if len(self.numbers) > REMEMBERED:
            self.numbers = defaultdict(itertools.count().__next__)
        lengths = np.array([len(t) for t in texts], np.int64)
        ids = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(texts)), np.int64, int(lengths.sum()))
        runs = find_runs(ids, lengths, self.shortest)
        ends = np.cumsum(lengths)
        cut = np.searchsorted(runs[:, 0], ends)
        return [runs[a:b] - [first, 0, 0] for a, b, first in zip([0, *cut[:-1]], cut, (ends - lengths).tolist(), strict=True)]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def _batches(rows: Iterator[tuple], finder: Finder, rewrite: Rewrite | None) -> Iterator[tuple]:
    """(key, words, runs) of each (key, text) of ``rows``, many at a time."""

    def done() -> Iterator[tuple]:
        yield from zip(keys, texts, finder(texts), strict=True)

    keys, texts, size = [], [], 0
    for key, text in rows:
        words = (text or b"").split()
        if rewrite is not None and (chosen := rewrite(key, len(words))) is not None:
            words = [words[i] for i in chosen.tolist()]
        keys.append(key)
        texts.append(words)
        size += len(words)
        if size >= BATCH_WORDS or len(keys) >= 4096:
            yield from done()
            keys, texts, size = [], [], 0
    if keys:
        yield from done()


_RUNS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))


def runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, start, length, period) of every run of the texts of ``docs`` (doc_id, text).

    Words are what white space (ASCII) separates, numbered from 0; a run has
    at least ``shortest`` words and two periods. Null and empty texts have no
    runs; every row is a document of its own, also where ids are null or
    repeated. Other columns are ignored.
    """

    def run(batches):
        out, finder = RowBuffer(_RUNS), Finder(shortest)
        for doc_id, _, found in _batches(rows_of(batches, "doc_id", "text"), finder, None):
            for row in found.tolist():
                if out.add(doc_id, *row):
                    yield from out.flush()
        yield from out.flush()

    return _narrow(docs).mapInArrow(run, "doc_id bigint, start bigint, length bigint, period bigint")


def collapsed(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with every run cut down to its first period.

    Texts that lose words have the others joined by one blank; all other
    texts, all rows and all columns stay as they are. A text of any length is
    read whole, with about a hundred bytes of memory a word.
    """

    @F.pandas_udf("string")
    def short(text: pd.Series) -> pd.Series:
        finder = Finder(shortest)

        def one(i: int, words: list[bytes], found: np.ndarray):
            if not len(found):
                return bytes(text.iloc[i]).decode("utf-8", "replace") if text.iloc[i] is not None else None
            keep = kept_words(len(words), found)
            return b" ".join(itertools.compress(words, keep.tolist())).decode("utf-8", "replace")

        rows = ((i, None if t is None else bytes(t)) for i, t in enumerate(text))
        return pd.Series([one(*r) for r in _batches(rows, finder, None)], dtype=object)

    return docs.withColumn("text", short(text_bytes())) if docs.columns else docs


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which of a document's ``n`` words stands at each place once a repetition is planted.

    Documents whose id has a CRC-32 divisible by 10 repeat a stretch to their
    end; the others, and rows without id, stay as they are (None).
    """
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


_DIGEST = pa.schema(
    [("doc_id", pa.int64())]
    + [(name, pa.int64()) for name in ("n_runs", "start", "length", "period", "exponent_milli")]
    + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
)


def run_digest(docs: DataFrame, shortest: int = SHORTEST, rewrite: Rewrite | None = planted) -> DataFrame:
    """One row for every row of ``docs`` (doc_id, text): its runs, the longest one, and what is left without repetitions.

    (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256); the longest run goes by smallest start, then period, and
    is null without runs. ``rewrite`` tells by id and number of words which
    word stands where. Null and empty texts have no words; repeated rows and
    rows without id count each for itself; other columns are ignored. A text of
    any length is read whole, in one task.
    """

    def run(batches):
        out, finder = RowBuffer(_DIGEST), Finder(shortest)
        for doc_id, words, found in _batches(rows_of(batches, "doc_id", "text"), finder, rewrite):
            best = (None,) * 4
            if len(found):
                start, length, period = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist()
                best = (start, length, period, 1000 * length // period)
                words = itertools.compress(words, kept_words(len(words), found).tolist())
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in found.tolist())
            left = hashlib.sha256(b" ".join(words)).hexdigest()
            if out.add(doc_id, len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), left):
                yield from out.flush()
        yield from out.flush()

    ddl = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    return _narrow(docs).mapInArrow(run, ddl)
