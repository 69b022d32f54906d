"""Text quality by a factorisation machine.

Features of a document are its hashed words (log counts, scaled to length one),
structure statistics of the text, their quantile bins, and the table's n_chars.
Every pair of features interacts through the product of two short factor
vectors; the sum over all pairs is half the difference between the square of
the factor sum and the sum of squares, so a score takes time linear in the
number of features.

The model is fitted on at most ``SAMPLE`` labelled documents, those with the
smallest hash of their id; the executors send their features, not their texts.
Scoring reads every whole text once and moves no row.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RowBuffer, rows_of, text_bytes
from .simhash import word_runs

# At most so many labelled documents are fitted on; so many hashed words, factors, bins, steps.
SAMPLE = 6000
WORDS = 1 << 13
FACTORS = 8
BINS = 8
STEPS = 300
BATCH = 256
RATE = 0.02
DECAY = 1e-4
SEED = 7
THRESHOLD = 0.3
FOLDS = 5

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#$%&*|<>{}[]=~^\\/_@+")] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?'\"()-")] = True
STATISTICS = 18


def features(text: bytes | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words, their values, and the statistics of a text; a null text is empty."""
    text = text or b""
    counts = np.zeros(WORDS, np.int64)
    n = distinct = repeats = 0
    for words in word_runs(text, 1):
        if not words:
            continue
        hashed = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        counts += np.bincount(hashed & np.uint32(WORDS - 1), minlength=WORDS)
        n += len(words)
        distinct += len(set(words))
        repeats += int(np.count_nonzero(hashed[1:] == hashed[:-1]))
    index = np.flatnonzero(counts)
    value = np.log1p(counts[index])
    if len(value):
        value /= np.sqrt((value * value).sum())
    size = len(text)
    used = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = used[65:91].sum() + used[97:123].sum()
    seen = max(size - int(used[9:14].sum() + used[32]), 1)
    full = [line for line in text.split(b"\n") if line]
    statistics = np.array(
        [
            np.log1p(n),
            np.log1p(size),
            seen / max(n, 1),
            distinct / max(n, 1),
            used[65:91].sum() / max(letters, 1),
            used[48:58].sum() / seen,
            used[_PUNCTUATION].sum() / seen,
            used[_SYMBOLS].sum() / seen,
            used[128:].sum() / seen,
            used[33] / seen,
            used[46] / max(n, 1),
            used[10] / max(n, 1),
            len(set(full)) / max(len(full), 1),
            repeats / max(n, 1),
            (counts.max() / n) if n else 0.0,
            letters / seen,
            np.log1p(max(n_chars or 0, 0)),
            float(n_chars is None),
        ]
    )
    return index, value, statistics


class Model(NamedTuple):
    """A fitted factorisation machine; its size does not depend on the data."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    edges: np.ndarray  # statistics x (BINS - 1)


def joined(model: Model, index: np.ndarray, value: np.ndarray, statistics: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All features of a document: hashed words, statistics, bins of statistics."""
    standard = np.clip((statistics - model.mean) / model.scale, -4, 4) / 4
    bins = (statistics[:, None] > model.edges).sum(axis=1)
    which = np.arange(STATISTICS)
    return (
        np.concatenate([index, WORDS + which, WORDS + STATISTICS + which * BINS + bins]),
        np.concatenate([value, standard, np.full(STATISTICS, 0.25)]),
    )


def score(model: Model, index: np.ndarray, value: np.ndarray) -> float:
    """Probability of good quality, in time linear in the number of features."""
    part = model.factor[index] * value[:, None]
    total = part.sum(axis=0)
    pairs = 0.5 * float((total * total).sum() - (part * part).sum())
    raw = model.bias + float(model.weight[index] @ value) + pairs
    return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Logistic loss by Adam over mini-batches, in a fixed pseudorandom order."""
    size = WORDS + STATISTICS * (1 + BINS)
    rng = np.random.default_rng(SEED)
    statistics = np.array([r[2] for r in rows]) if rows else np.zeros((1, STATISTICS))
    scale = statistics.std(axis=0)
    model = Model(
        0.0,
        np.zeros(size),
        rng.normal(0, 0.05, (size, FACTORS)),
        statistics.mean(axis=0),
        np.where(scale > 1e-9, scale, 1.0),
        np.quantile(statistics, np.arange(1, BINS) / BINS, axis=0).T,
    )
    if not rows:
        return model._replace(factor=np.zeros((size, FACTORS)))
    data = [joined(model, *r) for r in rows]
    share = np.clip(labels.mean(), 0.01, 0.99)
    bias, weight, factor = float(np.log(share / (1 - share))), model.weight, model.factor
    # First and second moments of the gradients.
    m = [np.zeros(1), np.zeros_like(weight), np.zeros_like(factor)]
    v = [np.zeros(1), np.zeros_like(weight), np.zeros_like(factor)]
    step = 0
    for _ in range(-(-STEPS * BATCH // max(len(data), BATCH))):
        order = rng.permutation(len(data))
        for a in range(0, len(order), BATCH):
            chosen = order[a : a + BATCH]
            index = np.concatenate([data[i][0] for i in chosen])
            value = np.concatenate([data[i][1] for i in chosen])
            length = np.array([len(data[i][0]) for i in chosen])
            begin = np.cumsum(length) - length
            row = np.repeat(np.arange(len(chosen)), length)
            part = factor[index] * value[:, None]
            total = np.add.reduceat(part, begin)
            pairs = 0.5 * ((total * total).sum(axis=1) - np.add.reduceat((part * part).sum(axis=1), begin))
            raw = bias + np.add.reduceat(weight[index] * value, begin) + pairs
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]) / len(chosen)
            by_entry = slope[row] * value
            used, place = np.unique(index, return_inverse=True)
            g_weight = np.bincount(place, by_entry, len(used)) + DECAY * weight[used]
            pull = by_entry[:, None] * (total[row] - part)
            g_factor = np.stack([np.bincount(place, pull[:, f], len(used)) for f in range(FACTORS)], axis=1)
            g_factor += DECAY * factor[used]
            step += 1
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, (where, gradient) in enumerate(((slice(None), np.array([slope.sum()])), (used, g_weight), (used, g_factor))):
                m[k][where] = 0.9 * m[k][where] + 0.1 * gradient
                v[k][where] = 0.999 * v[k][where] + 0.001 * gradient**2
                move = rate * m[k][where] / (np.sqrt(v[k][where]) + 1e-8)
                if k == 0:
                    bias -= float(move[0])
                elif k == 1:
                    weight[where] -= move
                else:
                    factor[where] -= move
    return model._replace(bias=bias, weight=weight, factor=factor)


_FEATURES = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("index", pa.list_(pa.int32())), ("value", pa.list_(pa.float64())), ("statistics", pa.list_(pa.float64()))])


def held_out() -> Column:
    """Whether a document belongs to the fold that no label is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def _narrow(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars") if "n_chars" in docs.columns else F.char_length("text")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text_bytes().alias("text"),
        n_chars.cast("bigint").alias("n_chars"),
        held_out().alias("held_out"),
    )


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of ``docs`` and ``labels`` (doc_id, quality), on at most ``sample`` labelled rows.

    Rows of the held-out fold, rows without a label or an id and labels of
    unknown documents are left out; several labels of a document count as
    their majority, and of rows that repeat a doc_id the longest text counts.
    Without any label the model scores 0.5 throughout.
    """
    known = labels.where("doc_id is not null and quality is not null").where(~held_out())
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    present = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    chosen = known.join(present, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # The sample has a fixed bound, and so has its broadcast.
    texts = _narrow(docs).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        out = RowBuffer(_FEATURES, 256)
        for doc_id, label, text, n_chars in rows_of(batches, "doc_id", "label", "text", "n_chars"):
            index, value, statistics = features(text, n_chars)
            if out.add(doc_id, label, index, value, statistics):
                yield from out.flush()
        yield from out.flush()

    ddl = "doc_id bigint, label int, index array<int>, value array<double>, statistics array<double>"
    found = texts.mapInArrow(run, ddl).toArrow().combine_chunks()
    ids, labels = found.column("doc_id").to_numpy(), found.column("label").to_numpy()
    lists = [_lists(found.column(c)) for c in ("index", "value", "statistics")]
    # Of equal ids the row with the largest statistics, whose order begins with the number of words.
    order = sorted(range(len(ids)), key=lambda i: (ids[i], tuple(lists[2][i])))
    last = [i for i, j in itertools.zip_longest(order, order[1:]) if j is None or ids[i] != ids[j]]
    return fit([tuple(c[i] for c in lists) for i in last], labels[last].astype(float))


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Rows of a list column as views of one array."""
    rows: list[np.ndarray] = []
    for chunk in column.chunks:
        values, offsets = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        rows += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return rows


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Empty and null texts are scored by their statistics; a row without doc_id
    is not held out; repeated rows get equal scores. Only text and n_chars
    enter a score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        out = RowBuffer(_SCORES)
        for doc_id, held, text, n_chars in rows_of(batches, "doc_id", "held_out", "text", "n_chars"):
            value = score(own, *joined(own, *features(text, n_chars)))
            if out.add(doc_id, held, value, int(value >= threshold)):
                yield from out.flush()
        yield from out.flush()

    return _narrow(docs).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that the model does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    @F.pandas_udf("double")
    def rated(text: pd.Series, n_chars: pd.Series) -> pd.Series:
        own = Model(*shared.value)
        return pd.Series(
            [
                score(own, *joined(own, *features(None if t is None else bytes(t), None if n != n or n is None else int(n))))
                for t, n in zip(text, n_chars, strict=True)
            ],
            dtype="float64",
        )

    n_chars = F.col("n_chars") if "n_chars" in docs.columns else F.char_length("text")
    return docs.where(rated(text_bytes(), n_chars.cast("bigint")) >= threshold)
