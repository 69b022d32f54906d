import hashlib
import math
import random

import numpy as np
import pytest

from eatlas.llm import vector_codes

from .helpers import collected

COLUMNS = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, points string, length int")


def brute(rows, rounds=6):
    kept = []
    for vec_id, vector, label in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(4096 * float(np.float32(x))) for x in vector], label))
    coded = []
    for length in {len(v) for _, v, _ in kept}:
        mine = [r for r in kept if len(r[1]) == length]
        if not length or length % 8:
            coded += [(i, None, None, label, None) for i, _, label in mine]
            continue
        width, first = length // 8, {}
        for vec_id, v, _ in mine:
            first[vec_id] = min(first.get(vec_id, v), v)
        seeds = [first[i] for i in sorted(first, key=lambda i: (i is None, i or 0))[:16]]
        books = [[s[p * width : (p + 1) * width] for s in seeds] for p in range(8)]

        def choose(v):
            out = []
            for p in range(8):
                x = v[p * width : (p + 1) * width]
                out.append(min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p])))
            return out

        for _ in range(rounds):
            chosen = [choose(v) for _, v, _ in mine]
            for p in range(8):
                for e in range(len(seeds)):
                    of = [v[p * width : (p + 1) * width] for (_, v, _), c in zip(mine, chosen) if c[p][1] == e]
                    if of:
                        books[p][e] = [sum(x) // len(of) for x in zip(*of)]
            books = [list(map(list, b)) for b in books]
        digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
        for vec_id, v, label in mine:
            c = choose(v)
            coded.append((vec_id, "".join(f"{e:02x}" for _, e in c), sum(d for d, _ in c), label, digest))
    totals = {}
    for _, _, error, label, _ in coded:
        if error is not None:
            totals[label] = totals.get(label, 0) + error
    return sorted(((i, c, e, totals.get(label), d) for i, c, e, label, d in coded), key=str)


def rows_with_everything(seed, n=150, dim=16):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(9)]
    rows = []
    for i in rng.sample(range(-30, 600), n):
        centre, spread = rng.choice(centres), rng.choice([0, 0, 0.01, 0.2])
        rows.append((i, [float(np.float32(x + rng.gauss(0, spread))) for x in centre], rng.choice([0, 1, 2, None])))
    one = [0.5] * dim
    return rows + rows[:5] + [
        (rows[0][0], one, 7),  # one id, two vectors
        (None, one, None),
        (None, [-0.25] * dim, 1),
        (-100, [0.0] * dim, 1),
        (901, None, 1),
        (902, [float("nan")] + one[1:], 1),
        (903, [float("-inf")] + one[1:], 1),
        (904, [None, *one[1:]], 1),
        (905, [], 8),
        (906, [1.0, 2.0, 3.0], 9),
        (907, [0.125 * k for k in range(8)], 2),
        (908, [0.25 * k for k in range(8)], 2),
    ]


@pytest.mark.parametrize("block", [20, 4096])
def test_equal_to_brute_force(spark, block):
    rows = rows_with_everything(block)
    got = vector_codes.code_digest(table(spark, rows).repartition(3), block=block)
    assert collected(got, *COLUMNS) == brute(rows)


def test_fewer_vectors_than_entries(spark):
    rows = [(i, [i / 7] * 8, 0) for i in range(5)]
    assert collected(vector_codes.code_digest(table(spark, rows)), *COLUMNS) == brute(rows)


def test_nothing_to_code(spark):
    assert vector_codes.code_digest(table(spark, [])).count() == 0
    assert vector_codes.code_digest(table(spark, [(1, None, 1), (2, [float("nan")], 1)])).count() == 0


def test_too_large_components(spark):
    with pytest.raises(Exception, match="cannot be compared exactly"):
        vector_codes.code_digest(table(spark, [(1, [1e30] * 8, 1)])).count()


@pytest.mark.parametrize("n,width", [(1, 3), (5, 8), (33, 2), (900, 8), (3000, 4)])
def test_trees_own_what_is_nearest(n, width):
    rng = np.random.default_rng(n)
    centres = rng.integers(-3000, 3000, (10, width))
    for points in (rng.integers(-300, 300, (n, width)), rng.integers(-1, 2, (n, width)), centres[rng.integers(0, 10, n)] + rng.integers(-9, 9, (n, width))):
        tree = vector_codes.Tree.from_bytes(vector_codes.ball_tree(points).to_bytes())
        assert sorted(tree.order.tolist()) == list(range(n))
        dealt = points[tree.order]
        for low, high, radius, sums in zip(tree.low, tree.high, tree.radius, tree.sums, strict=True):
            ball = dealt[low:high]
            assert (ball.sum(axis=0) == sums).all()
            assert (((ball - sums / len(ball)) ** 2).sum(axis=1) <= radius**2 * (1 + 1e-9) + 1e-9).all()
        entries = points[rng.integers(0, n, 16)]
        for _ in range(3):
            codes, sums, counts, compared = vector_codes.assigned(tree, dealt, entries)
            want = vector_codes.nearest(dealt, entries).argmin(axis=1)
            assert (codes == want).all() and (counts == np.bincount(want, minlength=16)).all()
            assert all((sums[e] == dealt[want == e].sum(axis=0)).all() for e in range(16))
            entries = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], entries)
    # Well separated points are settled by whole balls.
    assert n < 900 or compared < n / 2
