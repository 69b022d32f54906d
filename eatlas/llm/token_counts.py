"""Token counts of whole texts, as the tokenizer library gives them.

A text of any length is encoded a chunk at a time. Neighbouring chunks overlap,
and both encodings come with offsets. They are spliced at a stable boundary: in
front of a single blank or line feed between two characters that are not white
space, or between a Japanese or Chinese letter and a full stop, comma, mark or
bracket of that script. The tokenizer's pattern always splits there, whatever
stands further left, so the two encodings agree from there on; that both have a
token boundary there is checked. An overlap without such a place, or where the
boundaries disagree, is widened until one is found or the text ends: a word of
any length is one piece for the tokenizer, and so it is here.

Within a chunk the pieces between stable boundaries are independent as well, so
the count of a piece is remembered for the next text that holds it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RowBuffer, rows_of, text_bytes

LIMIT = 1024
CHUNK = 1 << 16
OVERLAP = 256
# Pieces remembered by one Python worker; the memory is cleared when it is full.
REMEMBERED = 400_000

# White space of either Python or the tokenizer's pattern, and format characters
# that older Unicode versions counted as such: no boundary is claimed beside them.
_SPACE = r"[\s\u180e\u200b-\u200d\u2060\ufeff]"
_STABLE = re.compile(rf"(?<!{_SPACE})(?<!^) (?!{_SPACE})(?!$)")
# Kana and common ideographs, and what ends a run of them.
_SCRIPT = "[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]"
_SPLICE = re.compile(rf"(?<!{_SPACE})(?<!^)[ \n](?!{_SPACE})(?!$)|(?<={_SCRIPT})(?=[\u3001\u3002\u300c-\u300f\uff01\uff0c\uff1f])")
_UNSAFE = re.compile(rf" {_SPACE}|{_SPACE} ")


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def stable_boundary(text: str, start: int, end: int) -> int | None:
    """The first stable boundary in ``text[start:end]``, seen with its neighbours."""
    found = _SPLICE.search(text, max(start, 1), min(end + 1, len(text)))
    return found.start() if found and found.start() < end and found.start() + 1 < len(text) else None


def _pieces(text: str) -> list[str]:
    """Independent pieces of a text; all but the first are to be read with a blank in front."""
    if _UNSAFE.search(text) or text[:1] == " " or text[-1:] == " ":
        return _STABLE.split(text)
    return text.split(" ")


class Counter:
    """Token counts of texts by one tokenizer file."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.tokenizer, self.chunk, self.overlap = _tokenizer(path), chunk, overlap
        self.known: dict[str, int] = {}

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def short(self, texts: list[str]) -> list[int]:
        """Counts of texts of at most a chunk each, by their pieces."""
        split = [_pieces(t) for t in texts]
        firsts = self._encode([p[0] for p in split])
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        # set.difference(dict) goes over the keys of the smaller set only.
        new = list({piece for pieces in split for piece in pieces[1:]}.difference(known))
        known.update(zip(new, self._encode([" " + piece for piece in new]), strict=True))
        return [first + sum(map(known.__getitem__, pieces[1:])) for first, pieces in zip(firsts, split, strict=True)]

    def _boundaries(self, text: str, start: int, end: int) -> list[int]:
        """Where tokens of ``text[start:end]`` begin, as positions in the text."""
        encoding = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        return [start + a for a, _ in encoding.offsets]

    def long(self, text: str) -> int:
        """Count of a text of any length, spliced from overlapping chunks."""
        total, start, stop = 0, 0, 0
        while stop < len(text):
            stop, overlap = start + self.chunk, self.overlap
            while True:
                if stop + overlap >= len(text):
                    splice, stop = len(text), len(text)
                    tokens = self._boundaries(text, start, stop)
                    break
                splice = stable_boundary(text, stop, stop + overlap)
                if splice is not None:
                    tokens = self._boundaries(text, start, stop + overlap)
                    after = self._boundaries(text, stop, min(stop + 2 * overlap, len(text)))
                    if splice in tokens and splice in after:
                        stop = splice
                        break
                overlap *= 2
            total += sum(a < splice for a in tokens)
            start = splice
        return total

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        for i, n in zip(short, self.short([texts[i] for i in short]), strict=True):
            out[i] = n
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                out[i] = self.long(t)
        return out


@cache
def counter(path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Counter:
    return Counter(path, chunk, overlap)


_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text).

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers
    library, at the same place on every machine. A null text is empty and has
    no tokens. Rows without doc_id and repeated rows are counted like any
    other; other columns are ignored. No row moves between tasks.
    """

    def counted(out: RowBuffer, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        numbers = counter(tokenizer, chunk, overlap).counts([t.decode("utf-8", "replace") for _, t in rows])
        for (doc_id, text), n in zip(rows, numbers, strict=True):
            if out.add(doc_id, len(text), n, n > limit):
                yield from out.flush()

    def run(batches):
        out, rows, size = RowBuffer(_COUNTS), [], 0
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            rows.append((doc_id, text or b""))
            size += len(text or b"")
            if size > 1 << 20 or len(rows) >= 1024:
                yield from counted(out, rows)
                rows, size = [], 0
        if rows:
            yield from counted(out, rows)
        yield from out.flush()

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
