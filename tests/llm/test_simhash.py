import itertools
import random

import numpy as np
import xxhash

from eatlas.llm import simhash
from eatlas.llm.components import components

from .helpers import Parts, collected, documents


def brute_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_brute_force_also_piecewise(monkeypatch):
    rng = random.Random(1)
    texts = ["", "one", "Two WORDS", "a b c", "É é x y", "a\x0bb\x1cc d\te"] + [
        " ".join(rng.choice(["a", "Bc", "def", "\n", "  "]) for _ in range(rng.randint(1, 80))) for _ in range(40)
    ]
    for piece in (1 << 20, 7):
        monkeypatch.setattr(simhash, "_PIECE", piece)
        for text in texts:
            assert simhash.fingerprint(text.encode()) == brute_fingerprint(text), (text, piece)
    assert simhash.fingerprint(None) == 0


def test_index_finds_all_pairs_within_two_bits():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, int(n), replace=False)) for n in rng.integers(0, 5, 240)]
    codes = np.unique(np.array([int(rng.choice(centres)) ^ f for f in flips] + [0, 1, 3, 7], np.uint64))
    # One group, all 64 bits free.
    ranks = simhash.gray_rank(codes)
    codes = codes[np.argsort(ranks)]
    found = set()
    for i, j in simhash.near_pairs(np.zeros(len(codes), np.int64), codes, np.full(len(codes), 64)):
        found |= set(zip(i.tolist(), j.tolist(), strict=True))
    pairs = itertools.combinations(range(len(codes)), 2)
    assert found == {(i, j) for i, j in pairs if int(codes[i] ^ codes[j]).bit_count() <= 2}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(1000 + i, t) for i, t in enumerate([None, "", " \n", "x", "X", "x y", None])]
    for i in range(120):
        base = random.Random(i % 9).choices(words, k=60)
        for _ in range(rng.randint(0, 2)):
            base[rng.randrange(60)] = rng.choice(words)
        rows.append((i - 20, " ".join(base)))
    rows += [rows[30], rows[30], (None, rows[31][1]), (None, "only here"), (7, "another text of an id that is there")]
    values = [(d, brute_fingerprint(t)) for d, t in rows]
    known = [(d, f) for d, f in values if d is not None]
    parts = Parts({f for _, f in values})
    for a, b in itertools.combinations({f for _, f in known}, 2):
        if (a ^ b).bit_count() <= 2:
            parts.join(a, b)
    least = {}
    for d, f in known:
        root = parts.find(f)
        least[root] = min(least.get(root, d), d)
    want = sorted(((d, f"{f:016x}", least.get(parts.find(f))) for d, f in values), key=str)
    got = collected(simhash.near_duplicates(documents(spark, rows)), "doc_id", "fingerprint", "component_id")
    # Rows of one doc_id with two fingerprints join their components.
    merged = [r for r in want if r[0] != 7]
    assert [r for r in got if r[0] != 7] == merged
    assert len({r[2] for r in want if r[2] is not None}) < len(want) - 20


def test_one_of_each_keeps_one_row_of_a_group(spark):
    text = "a b c d e f g"
    rows = [(5, text), (3, text), (3, text), (9, "quite another text here"), (None, text), (4, None), (2, "")]
    kept = simhash.one_of_each(documents(spark, rows))
    assert collected(kept, "doc_id", "text") == sorted([(3, text), (9, "quite another text here"), (None, text), (2, "")], key=str)
    assert kept.columns == documents(spark, rows).columns
    assert simhash.one_of_each(documents(spark, [])).count() == 0
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(200, 201), (201, 202), (202, 200)]
    edges += [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)] + [(7, 7), (None, 3), (500, None)]
    rng.shuffle(edges)
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    parts = Parts({n for e in real for n in e})
    for a, b in real:
        parts.join(a, b)
    got = collected(components(spark.createDataFrame(edges, "a bigint, b bigint")), "node", "component")
    assert got == sorted(((n, parts.find(n)) for n in parts.up), key=str)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
