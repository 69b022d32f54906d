import collections
import random

import numpy as np

from eatlas.llm import mixing

from .helpers import collected, documents


def brute_targets(sizes):
    """Fill up by rounds: sources that pass their bound stop, the rest share again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in stopped)
        open_ = [s for s in names if s not in stopped]
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in stopped else share[s] for s in names}
        stopped |= over


def rows_with_everything():
    rng = random.Random(4)
    rows = []
    for d in range(150):
        source = rng.choice(["hot", "hot", "hot", "a", "b", "é", "Z", None, ""])
        rows.append((d, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 300))), source))
    rows += [rows[0], (None, "without an id here", "a"), (200, None, "b"), (201, " \n\t", "void"), (202, "x\x0by\x1cz", "a")]
    return rows


def test_digest_reaches_targets(spark):
    rows = rows_with_everything()
    got = collected(mixing.mix_digest(documents(spark, rows), block=8, shard_slots=64), "doc_id", "size", "source_size", "target", "taken")
    again = mixing.mix_digest(documents(spark, rows).repartition(5), block=8, shard_slots=64)
    assert got == collected(again, "doc_id", "size", "source_size", "target", "taken")
    count = lambda t: len((t or "").encode().split())
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += count(text)
    targets = brute_targets(sizes)
    assert sorted((r[:3] for r in got), key=str) == sorted(((d, count(t), sizes[s]) for d, t, s in rows), key=str)
    by_id = {d: (t, s) for d, t, s in rows}
    taken = collections.Counter()
    for doc_id, size, source_size, target, words in got:
        text, source = by_id[doc_id]
        assert size == count(text) and source_size == sizes[source] and words <= 2 * size
        assert abs(target - targets[source]) <= 1e-9 * max(target, 1)
        taken[source] += words
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 8 + 0.02 * target


def test_documents_of_the_mix_hold_the_words_taken(spark):
    rows = [r for r in rows_with_everything() if r[0] is not None][:150]
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_digest(documents(spark, rows), block=8, shard_slots=64).collect()}
    mixed = mixing.mixed_documents(documents(spark, rows), block=8, shard_slots=64)
    assert mixed.columns == documents(spark, rows).columns
    words = collections.Counter()
    texts = {d: t for d, t, _ in rows}
    for row in mixed.collect():
        own = row["text"].split()
        words[row["doc_id"]] += len(own)
        assert all(part in texts[row["doc_id"]] for part in row["text"].split("\n"))
    assert {d: n for d, n in taken.items() if n} == dict(words)
    assert mixing.mix_digest(documents(spark, [])).count() == 0
    assert mixing.mixed_documents(documents(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix_digest(documents(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def test_permutations_are_permutations():
    for size in (1, 2, 3, 5, 64, 65, 1000):
        image = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, 77, np.uint64))
        assert sorted(image.tolist()) == list(range(size))
    one, two = (mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, k, np.uint64)) for k in (1, 2))
    assert (one != two).sum() > 900


def test_running_sums_over_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaab"), i, rng.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    from pyspark.sql import functions as F

    got = mixing.running_sums(df, ["g"], [F.col("o")], {"s": "v"}).collect()
    for g in "ab":
        total = 0
        for row in sorted((r for r in got if r["g"] == g), key=lambda r: r["o"]):
            assert row["s"] == total
            total += row["v"]
