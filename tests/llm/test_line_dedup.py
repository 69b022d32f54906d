import hashlib
import random

import pytest

from eatlas.llm import line_dedup

from .helpers import collected, documents


def key(line):
    k = line.strip(b"\x20\x09\x0a\x0b\x0c\x0d")
    k = bytes(c + 32 if 65 <= c <= 90 else c for c in k)
    return k if len(k.decode()) >= 20 else None


def brute(rows):
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").encode().split(b"\n"):
            if doc_id is not None and key(line) is not None:
                holders.setdefault(key(line), set()).add(doc_id)
    kept = []
    for doc_id, text in rows:
        lines = (text or "").encode().split(b"\n")
        stay = [
            line
            for line in lines
            if doc_id is None or key(line) is None or len(holders[key(line)]) < 3 or doc_id == max(holders[key(line)])
        ]
        kept.append((doc_id, len(lines), len(lines) - len(stay), b"\n".join(stay)))
    return kept


def rows_with_everything(seed):
    rng = random.Random(seed)
    pool = [f"Line number {i} that is long enough" for i in range(12)] + ["short", "", "éééééééééééééééééééé", "x" * 19, "y" * 20]
    rows = []
    for d in rng.sample(range(-50, 500), 60):
        lines = [rng.choice([" ", "\t", ""]) + rng.choice([str.upper, str])(rng.choice(pool)) + rng.choice(["", "\r"]) for _ in range(rng.randint(0, 9))]
        rows.append((d, "\n".join(lines)))
    # One line in most documents, some rows repeated, two texts of one id, rows without id or text.
    rows = [(d, t + "\nThis line stands in every document here") for d, t in rows]
    return rows + rows[:3] + [(rows[5][0], "This line stands in every document here\nand another"), (None, rows[0][1]), (1000, None), (1001, "")]


@pytest.mark.parametrize("partitions", [1, 4, 23])
def test_equal_to_brute_force(spark, partitions):
    rows = rows_with_everything(partitions)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        got = collected(line_dedup.line_digest(documents(spark, rows)), "doc_id", "n_lines", "n_dropped", "kept_sha256")
        text = collected(line_dedup.drop_repeated_lines(documents(spark, rows)), "doc_id", "text")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute(rows)
    assert got == sorted(((d, n, m, hashlib.sha256(t).hexdigest()) for d, n, m, t in want), key=str)
    changed = {id(r): t for r, (_, _, m, t) in zip(rows, want, strict=True) if m}
    assert text == sorted(((r[0], changed[id(r)].decode() if id(r) in changed else r[1]) for r in rows), key=str)


def test_empty_table(spark):
    assert line_dedup.line_digest(documents(spark, [])).count() == 0


def test_keys_over_partition_borders():
    end = dict(h1=1, h2=2)
    ends = [
        dict(part=0, docs=2, first=9, last=8, **end),
        dict(part=1, docs=3, first=8, last=5, **end),
        dict(part=2, docs=1, first=5, last=5, **end),
        dict(part=2, docs=1, first=7, last=7, h1=5, h2=5),
    ]
    assert line_dedup._spanning_keys(ends) == {(1, 2): (4, 9)}


def test_bitmaps_come_back():
    for dropped in ([0], [7], [8], [0, 3, 100], list(range(40))):
        mask = line_dedup.kept_mask(line_dedup.pack_bitmap(dropped), 120)
        assert [i for i in range(120) if not mask[i]] == dropped
    assert line_dedup.kept_mask(None, 3).all()
