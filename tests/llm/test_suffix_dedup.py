import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from eatlas.llm import suffix_dedup

from .helpers import collected, documents


def brute(rows, span):
    data = [(suffix_dedup._NO_ID if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, t in data:
        for i in range(len(t) - span + 1):
            first[t[i : i + span]] = min(d, first.get(t[i : i + span], d))
    out = []
    for (d, t), (doc_id, _) in zip(data, rows, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if first[t[i : i + span]] < d:
                gone[i : i + span] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, alphabet, span):
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 5, span, 3 * span, 200]))) for _ in range(6)]
    rows = []
    for d in rng.sample(range(-30, 60), 25):
        parts = []
        for _ in range(rng.randint(0, 4)):
            s = rng.choice(base)
            a, b = sorted((rng.randint(0, len(s)), rng.randint(0, len(s))))
            parts.append(s if rng.random() < 0.4 else s[a:b])
        rows.append((d, "".join(parts)))
    return rows + rows[:2] + [(rows[3][0], "x" + rows[4][1]), (None, rows[5][1]), (None, rows[6][1]), (99, None), (98, "")]


@pytest.mark.parametrize(("seed", "alphabet", "span"), [(1, "a", 50), (2, "ab", 50), (3, "the of and é日\n ", 50), (4, "abcdefgh", 24), (5, "xyzé", 33)])
def test_equal_to_brute_force(spark, seed, alphabet, span):
    rows = rows_of(seed, alphabet, span)
    got = suffix_dedup.span_digest(documents(spark, rows), span, batch_bytes=600)
    assert collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute(rows, span)


@pytest.mark.parametrize("crowded", [0, 2, 5])
def test_crowded_anchors_equal_brute_force(spark, crowded):
    for seed, alphabet, span in [(11, "ab", 50), (12, "the of and é\n ", 50), (13, "abcdefgh", 24)]:
        rows = rows_of(seed, alphabet, span)
        got = suffix_dedup.span_digest(documents(spark, rows), span, batch_bytes=600, crowded=crowded)
        assert collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute(rows, span)


def test_no_part_gets_all_strings_of_a_shared_passage(spark):
    """Documents that share a passage and go on in their own words."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    passage = " ".join(word() for _ in range(12))
    rows = [(d, " ".join([word() for _ in range(8)] + [passage] + [word() for _ in range(8)])) for d in range(2000)]
    got = suffix_dedup.span_digest(documents(spark, rows), batch_bytes=40_000, crowded=300)
    assert collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute(rows, 50)

    def largest(crowded):
        parts, held = 16, {}
        texts = pa.table({"doc_id": [d for d, _ in rows], "text": [t.encode() for _, t in rows]})
        batches = [suffix_dedup.Batch(texts.slice(a, 250)) for a in range(0, 2000, 250)]
        sent = {}
        for b, batch in enumerate(batches):
            for part, hashes, more in suffix_dedup.batch_anchors(batch, 50, parts):
                sent.setdefault(part, []).append((b, hashes, more))
        replies = {b: [] for b in range(len(batches))}
        for part, lists in sent.items():
            for b, blob in suffix_dedup.repeated_anchors(*map(list, zip(*lists)), crowded):
                replies[b].append((part, blob))
        for b, batch in enumerate(batches):
            keys = suffix_dedup._repeated_keys(pa.table({"part": [p for p, _ in replies[b]], "hashes": [h for _, h in replies[b]]}))
            found = suffix_dedup.batch_snippets(batch, 50, parts, keys)
            for part, content in zip(found.part.tolist(), found.content):
                held[part] = held.get(part, 0) + len(content)
        return max(held.values()), sum(held.values()) / parts

    most, mean = largest(300)
    assert most < 3 * mean
    assert largest(10**9)[0] > 3 * largest(10**9)[1]


def test_one_batch_and_empty_table(spark):
    rows = rows_of(9, "abc ", 50)
    got = suffix_dedup.span_digest(documents(spark, rows))
    assert collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute(rows, 50)
    assert suffix_dedup.span_digest(documents(spark, [])).count() == 0
    assert suffix_dedup.span_digest(documents(spark, [(1, None), (2, "")])).count() == 2
    with pytest.raises(ValueError):
        suffix_dedup.span_digest(documents(spark, []), 23)


def test_two_stage_order_sorts_suffixes():
    rng = random.Random(4)
    for depth in (24, 50):
        text = bytes(rng.choice(b"aabc") for _ in range(400)) + b"\xff" * 80
        data = np.frombuffer(text, np.uint8)
        active = np.zeros(len(data), bool)
        active[:400] = True
        order = suffix_dedup.two_stage_order(data, suffix_dedup.loads(data), active, depth)
        assert sorted(order.tolist()) == list(range(400))
        keys = [text[i : i + depth] for i in order.tolist()]
        assert keys == sorted(keys)


def test_packed_numbers_come_back():
    values = np.array([0, 1, 255, 256, (1 << 40) - 1], np.uint64)
    assert suffix_dedup.unpack5(suffix_dedup.pack5(values)).tolist() == values.tolist()
