import itertools
import math
import random

import numpy as np
import pytest

from eatlas.llm import embedding_dedup, neighbours

from .helpers import Parts, collected


def usable(vector):
    return vector is not None and len(vector) and all(x is not None and math.isfinite(x) for x in vector) and any(vector)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, links string, rep int")


def awkward(dim):
    one = [1.0] + [0.0] * (dim - 1)
    return [
        (901, None, 1),
        (902, [0.0] * dim, 1),
        (903, [float("nan")] + one[1:], 1),
        (904, [float("inf")] + one[1:], 1),
        (905, [None, *one[1:]], 1),
        (906, [], 1),
        (907, one, None),
        (908, one[:-1], 1),
        (None, one, 1),
    ]


def clustered(seed, n, dim, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    rows = []
    for i in rng.permutation(n).tolist():
        c = int(rng.integers(12))
        spread = float(rng.choice([0.0, 0.05, 0.12, 2.0]))
        vector = (centres[c] + spread * rng.standard_normal(dim)) * float(rng.choice([1.0, 3.0]))
        rows.append((i, np.float32(vector).tolist(), c % labels))
    return rows


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return a @ b / math.sqrt((a @ a) * (b @ b))


@pytest.mark.parametrize("block", [1024, 5])
def test_near_duplicates_equal_brute_force(spark, block):
    rows = clustered(1, 240, 16) + awkward(16)
    rows += rows[:2]  # repeated rows
    links = [0] * len(rows)
    parts = Parts(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        (a, x, p), (b, y, q) = rows[i], rows[j]
        if a is None or b is None or p is None or p != q or not usable(x) or not usable(y) or len(x) != len(y):
            continue
        if cosine(x, y) >= 0.98:
            links[i] += 1
            links[j] += 1
            parts.join(i, j)
    least = {}
    for i, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None:
            root = parts.find(i)
            least[root] = min(least.get(root, vec_id), vec_id)
    want = [(r[0], links[i], least.get(parts.find(i)), r[0] is not None and least[parts.find(i)] == r[0]) for i, r in enumerate(rows)]
    got = collected(embedding_dedup.near_duplicates(table(spark, rows), block=block), "vec_id", "n_links", "component_id", "kept")
    assert got == sorted(want, key=str)
    assert max(links) > 10


def test_near_duplicates_of_nothing(spark):
    assert embedding_dedup.near_duplicates(table(spark, [])).count() == 0
    assert collected(embedding_dedup.near_duplicates(table(spark, awkward(4)[:3])), "n_links") == [(0,)] * 3


def brute_nearest(rows, k):
    best = {}
    for vec_id, vector, _ in rows:
        if vec_id is not None and usable(vector) and len(vector) == 8:
            best[vec_id] = min(best.get(vec_id, vector), vector)
    ids = np.array(sorted(best))
    matrix = np.array([best[i] for i in ids], float)
    for i, vec_id in enumerate(ids.tolist()):
        if vec_id % 20 == 0:
            score = (matrix * matrix[i]).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)).tolist() if j != i][:k]
            yield vec_id, [(int(ids[j]), float(score[j])) for j in order]


def test_nearest_reach_recall_and_exact_scores(spark):
    rows = clustered(2, 1500, 8) + awkward(8)
    same = [(2000 + i, rows[0][1], 1) for i in range(60)]  # more copies than are indexed
    rows += same + [rows[3], rows[3]]
    got = {}
    for r in neighbours.nearest(table(spark, rows)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    want = dict(brute_nearest(rows, 20))
    assert set(got) == set(want)
    for query, near in want.items():
        found = sorted(got[query])
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(v, s) for _, v, s in found] == sorted(((v, s) for _, v, s in found), key=lambda x: (-x[1], x[0]))
        exact = dict(near)
        assert all(s == exact[v] for _, v, s in found if v in exact)
        hits += len(exact.keys() & {v for _, v, _ in found})
        total += 20
    assert hits / total >= 0.9


def test_all_candidates_if_fewer(spark):
    rng = random.Random(1)
    rows = [(i * 10, [rng.gauss(0, 1) for _ in range(8)], 0) for i in range(7)]
    rows = [(i, np.float32(v).tolist(), l) for i, v, l in rows]
    got = collected(neighbours.nearest(table(spark, rows)), "query_id", "rank", "vec_id", "score")
    want = [(q, r + 1, v, s) for q, near in brute_nearest(rows, 20) for r, (v, s) in enumerate(near)]
    assert got == sorted(want, key=str) and len(got) == 4 * 6
    assert neighbours.nearest(table(spark, [])).count() == 0
    assert neighbours.nearest(table(spark, rows[:1])).count() == 0


def test_every_vector_length_is_searched(spark):
    rng = np.random.default_rng(9)
    rows = [(i, np.float32(rng.standard_normal(8 if i % 3 else 5)).tolist(), 0) for i in range(0, 900, 5)]
    got = {}
    for r in neighbours.nearest(table(spark, rows)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    by_id = {i: v for i, v, _ in rows}
    assert set(got) == {i for i in by_id if i % 20 == 0}
    hits = total = 0
    for query, found in got.items():
        same = [i for i, v in by_id.items() if len(v) == len(by_id[query]) and i != query]
        exact = sorted(same, key=lambda i: (-float(np.dot(by_id[i], np.array(by_id[query], float))), i))[:20]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21)) and all(len(by_id[v]) == len(by_id[query]) for _, v, _ in found)
        hits, total = hits + len({v for _, v, _ in found} & set(exact)), total + 20
    assert hits / total >= 0.9


def test_nothing_but_unusable_vectors(spark):
    rows = [(20, None, 0), (40, [0.0] * 4, 0), (60, [float("nan")] * 4, 0), (7, [1.0] * 4, 0)]
    assert neighbours.nearest(table(spark, rows)).count() == 0
