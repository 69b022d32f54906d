import hashlib
import random
import zlib

import numpy as np
import pytest

from eatlas.llm import periodic_runs

from .helpers import collected, documents


def words_of(text):
    return (text or "").encode().split()


def brute(words, shortest=12):
    """Every maximal stretch of every period, less those of a smaller period."""
    n, found = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, end = i, j + q
            smaller = any(all(words[k] == words[k + p] for k in range(start, end - p)) for p in range(1, q))
            if end - start >= max(shortest, 2 * q) and not smaller:
                found.add((start, end - start, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rng):
    k, n = rng.choice([1, 2, 2, 3, 5, 50]), rng.choice([0, 1, 5, 11, 12, 13, 40, 90, 150])
    words = [b"w%d" % rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n > 20:
            a, p = rng.randrange(n - 10), rng.randint(1, 15)
            for i in range(a + p, min(n, a + rng.randint(2, 60))):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize("shortest", [2, 5, 12])
def test_runs_equal_brute_force(shortest):
    rng, found = random.Random(shortest), 0
    for _ in range(150):
        texts = [random_words(rng) for _ in range(rng.randint(1, 8))]
        for words, got in zip(texts, periodic_runs.Finder(shortest)(texts), strict=True):
            want = brute(words, shortest)
            assert [tuple(r) for r in got.tolist()] == want
            found += len(want)
    assert found > 200


def test_grams_with_equal_hashes(monkeypatch):
    """Were all hashes equal, grams would still be told apart."""
    rng = random.Random(3)
    texts = [random_words(rng) for _ in range(20)]
    want = [r.tolist() for r in periodic_runs.Finder()(texts)]
    monkeypatch.setattr(periodic_runs, "_ODD", np.uint64(0))
    assert [r.tolist() for r in periodic_runs.Finder()(texts)] == want


def rewritten(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    a, p = (h // 10) % n, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    words = rewritten(doc_id, words_of(text))
    runs = brute(words)
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        doc_id,
        len(runs),
        *longest,
        1000 * longest[1] // longest[2] if runs else None,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(left).hexdigest(),
    )


def everything():
    rng = random.Random(11)
    rows = [(d, " ".join(w.decode() for w in random_words(rng))) for d in range(-20, 180)]
    return rows + rows[:3] + [
        (None, "a b c " * 9),
        (None, None),
        (500, None),
        (501, ""),
        (502, " \t\r\n"),
        (503, "é ü\x0bß\x0c" * 7 + "\x1c    "),
        (504, "x " * 3000),  # long, of one word
        (505, " ".join(str(i % 700) for i in range(4000))),  # long, with a long period
    ]


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.mark.parametrize("batch", [7, 10000])
def test_digest_of_everything(spark, batch, monkeypatch):
    rows = everything()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = collected(periodic_runs.run_digest(documents(spark, rows)), *COLUMNS)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    slow = {504, 505}
    assert [r for r in got if r[0] not in slow] == sorted((digest(*r) for r in rows if r[0] not in slow), key=str)
    by_id = {r[0]: r for r in got}
    assert by_id[504][1:6] == (1, 0, 3000, 1, 3000000)
    assert by_id[505][1:6] == (1, 0, 4000, 700, 5714)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in got)


def test_runs_and_collapsed_texts(spark):
    rows = [(1, "so it goes " * 6 + "end"), (1, "so it goes " * 6 + "end"), (2, " two  blanks stay "), (3, None), (None, "a " * 12)]
    docs = documents(spark, rows)
    want = [(1, 0, 18, 3), (1, 0, 18, 3), (None, 0, 12, 1)]
    assert collected(periodic_runs.runs(docs), "doc_id", "start", "length", "period") == sorted(want, key=str)
    short = periodic_runs.collapsed(docs)
    assert short.columns == docs.columns
    want = [(1, "so it goes end", "v"), (1, "so it goes end", "v"), (2, " two  blanks stay ", "v"), (3, None, "v"), (None, "a", "v")]
    assert collected(short, "doc_id", "text", "version") == sorted(want, key=str)


def test_empty_table(spark):
    docs = documents(spark, [])
    assert periodic_runs.run_digest(docs).count() == periodic_runs.runs(docs).count() == periodic_runs.collapsed(docs).count() == 0
