import random
import zlib

import numpy as np
import pytest

from eatlas.llm import quality

from .helpers import collected, documents


def corpus():
    rng = random.Random(3)
    words = ["the", "river", "runs", "under", "old", "stone", "bridge", "and", "people", "walk", "there", "slowly"]
    rows, labels = [], []
    for d in range(500):
        good = d % 3 != 0
        if good:
            text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 90))) + "."
        elif d % 2:
            text = "\n".join(["BUY NOW!!! $$$ &&&"] * rng.randint(3, 20))
        else:
            text = " ".join([rng.choice(words)] * rng.randint(20, 90))
        rows.append((d, text))
        labels.append((d, int(good)))
    return rows, labels


def test_learns_quality_without_held_out_labels(spark):
    rows, labels = corpus()
    docs = documents(spark, rows + [(900, None), (901, ""), (None, "no id"), rows[0]])
    # Wrong labels in the held-out fold must not matter; nor nulls, strangers and repeats.
    held = {d for d, _ in labels if zlib.crc32(str(d).encode()) % 5 == 0}
    wrong = [(d, 1 - q if d in held else q) for d, q in labels] + [(None, 1), (5, None), (7777, 0), labels[1], labels[1]]
    true = spark.createDataFrame(labels, "doc_id bigint, quality int")
    false = spark.createDataFrame(wrong, "doc_id bigint, quality int")
    model = quality.train(docs, true)
    other = quality.train(docs, false)
    assert all(np.array_equal(a, b) for a, b in zip(model, other, strict=True))
    got = {r["doc_id"]: r for r in quality.scored(docs, model).collect()}
    assert len(quality.scored(docs, model).collect()) == 504
    assert all(got[d]["held_out"] == (d in held) for d, _ in labels)
    assert np.mean([got[d]["predicted"] == q for d, q in labels if d in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert got[900]["held_out"] in (True, False) and not got[None]["held_out"]
    kept = collected(quality.accepted(docs, model), "doc_id")
    scores = collected(quality.scored(docs, model).where("predicted = 1"), "doc_id")
    assert kept == scores and 0 < len(kept) < 504
    assert quality.accepted(docs, model).columns == docs.columns


def test_without_labels_and_without_documents(spark):
    empty = spark.createDataFrame([], "doc_id bigint, quality int")
    docs = documents(spark, [(1, "a text"), (2, None)])
    model = quality.train(docs, empty)
    assert [r["score"] for r in quality.scored(docs, model).collect()] == [0.5, 0.5]
    assert quality.scored(documents(spark, []), model).count() == 0


def test_pairs_in_linear_time_equal_the_double_sum():
    rng = np.random.default_rng(1)
    model = quality.Model(0.3, rng.normal(size=20), rng.normal(0, 0.3, (20, 4)), *(np.zeros(1),) * 3)
    index, value = np.array([1, 4, 7, 19]), rng.normal(size=4)
    raw = 0.3 + model.weight[index] @ value
    for a in range(4):
        for b in range(a + 1, 4):
            raw += model.factor[index[a]] @ model.factor[index[b]] * value[a] * value[b]
    assert quality.score(model, index, value) == pytest.approx(1 / (1 + np.exp(-raw)))


def test_features_of_awkward_texts():
    for text in (None, b"", b"   ", b"\n", "é".encode() * 10, b"!" * 5000, b"word " * 300_000):
        index, value, statistics = quality.features(text, None)
        assert len(index) == len(value) and len(statistics) == quality.STATISTICS
        assert np.isfinite(statistics).all() and np.isfinite(value).all()
