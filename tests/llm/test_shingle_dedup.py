"""Near duplicates by five-word Jaccard similarity, against brute force over all pairs."""

import itertools
import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402

from pyspark.sql import functions as F

from eatlas.llm import shingle_dedup  # noqa: E402

from .helpers import Parts, collected, documents  # noqa: E402


def sets_of(text, size=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def alike(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def brute(rows):
    """The smallest doc_id of each group, and the pairs that link."""
    sets = {d: sets_of(t) for d, t in rows}
    parts, links = Parts(sets), []
    for a, b in itertools.combinations(sets, 2):
        if alike(sets[a], sets[b]) >= 0.8:
            parts.join(a, b)
            links.append((a, b))
    return sorted({parts.find(d) for d in sets}), links


def edited(rng, words, edits):
    words = list(words)
    for i in rng.sample(range(len(words)), edits):
        words[i] = f"new{rng.randrange(10**9)}"
    return words


def test_stage_equals_brute_force_jaccard(spark):
    rng = random.Random(5)
    rows, base = [], 1000
    for _ in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([40, 120, 300]))]
        for copy in range(6):
            # Edits from none to some beyond the limit; chains form in between.
            rows.append((base + copy, " ".join(edited(rng, words, rng.randrange(len(words) // 25 + 1)))))
        base += 10
    rows += [(1, "a b"), (2, "A  b"), (3, "a c"), (4, ""), (5, None), (6, " \n")]
    docs = spark.createDataFrame([(d, t, "s", 0) for d, t in rows], "doc_id bigint, text string, source string, n_chars bigint")
    want, links = brute(rows)
    sets = {d: sets_of(t) for d, t in rows}
    assert sum(alike(sets[a], sets[b]) < 0.95 for a, b in links) > 50
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    # Links are checked exactly, so nothing may go that brute force keeps; at most a missed pair may stay.
    assert set(want) <= set(got) and len(got) - len(want) <= 1
    assert {1, 3, 4} <= set(got) and not {2, 5, 6} & set(got)


def test_awkward_rows(spark):
    rng = random.Random(2)
    long = [f"l{rng.randrange(10**6)}" for _ in range(30000)]
    rows = [(7, "so it goes on and on"), (7, "so it goes on and on"), (7, "another text of this document"), (9, "So it goes  on and on")]
    rows += [(None, "so it goes on and on"), (None, None), (3, None), (4, " "), (5, " ".join(long)), (6, " ".join(edited(rng, long, 300)))]
    got = collected(shingle_dedup.one_of_each(documents(spark, rows)), "doc_id", "text")
    want = [(None, "so it goes on and on"), (None, None), (3, None), (5, " ".join(long)), (7, "another text of this document"), (7, "so it goes on and on")]
    assert got == sorted(want, key=str)
    assert shingle_dedup.one_of_each(documents(spark, rows)).columns == documents(spark, rows).columns
    assert shingle_dedup.one_of_each(documents(spark, [])).count() == 0


def test_a_dense_group_below_the_limit(spark):
    """Copies that meet in buckets but seldom link: what is compared in blocks is what brute force finds."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(220):
        copy = list(words)
        for k in rng.sample(range(150), rng.choice([1, 3, 6, 7])):
            copy[k] = f"n{rng.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    want, links = brute(rows)
    pairs = sum(alike(sets_of(a), sets_of(b)) >= 0.5 for (_, a), (_, b) in itertools.combinations(rows, 2))
    assert 1 < len(want) < 220 and 5 * len(links) < pairs
    got = sorted(r["doc_id"] for r in shingle_dedup.one_of_each(documents(spark, rows), block_nodes=16).collect())
    assert set(want) <= set(got) and len(got) - len(want) <= 1


def test_links_of_a_block():
    import numpy as np

    def row(name, component, *hashes):
        return name, component, np.array(hashes, np.uint64)

    inside = [row(b"a", b"a", 1, 2, 3, 4), row(b"b", b"b", 1, 2, 3, 4, 5), row(b"c", b"a", 1, 2, 3, 5), row(b"d", b"d", 9)]
    links = list(shingle_dedup._spanning_links([inside[1], inside[3]], inside, 0.8))
    assert links == [(b"b", b"a")]


def test_simhash_index_gives_candidates_of_its_own(spark, monkeypatch):
    """Without any shared band, copies in the index are still found, and its links are checked on whole sets."""
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, " ".join(f"v{i}" for i in range(400))), (4, "  ".join(words).upper())]
    real = shingle_dedup._sketches

    def apart(docs, size, similarity):
        return real(docs, size, similarity).withColumn("buckets", F.array(F.xxhash64("node")))

    monkeypatch.setattr(shingle_dedup, "_sketches", apart)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in shingle_dedup.one_of_each(docs).collect()) == [1, 3]
    monkeypatch.setattr(shingle_dedup, "near_links", lambda classes: classes.selectExpr("fp as a", "fp as b").crossJoin(classes.selectExpr("fp as c")).selectExpr("a", "c as b").where("a < b"))
    assert sorted(r["doc_id"] for r in shingle_dedup.one_of_each(docs).collect()) == [1, 3]
