"""Near duplicates by the Jaccard similarity of their word shingles.

Candidates come first from the SimHash index of ``simhash`` over the same
shingles, which joins copies and texts that differ little; every link is checked
on the whole sets of shingles. Texts at similarity 0.8 differ in some ten of 64
bits, and no choice of blocks that so many flips spare is long enough to tell
texts apart, so MinHash bands find what the index leaves apart.

Texts of equal sets are one node. Nodes that share a bucket (a band's hash) are
compared until the links join them: first each node with one centre of its
buckets, in rounds with other centres for as long as that settles many nodes,
which joins copies close to a centre with a pair a node; then, in the buckets
that still hold several components, every node outside the bucket's largest
component with all others. For that the nodes of a bucket are cut into blocks
of bounded size; a task gets a block of outside nodes and a block of all nodes,
counts what their sets have in common from one inverted list of the block, and
returns links that span what it found, so pairs are never rows. Two nodes of a
bucket stay apart only if they were compared, or if no chain of links joins
them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import materialize
from .common import RowBuffer, packed, record_batch, rows_of, text_bytes, unpacked
from .components import components
from .simhash import fingerprints, near_links, word_runs

# Of pairs at exactly the similarity wanted, the share that no band brings together.
MISSED = 0.001
_ROWS = 5
_STAR_ROUNDS = 2
_SLICE = 1 << 13
# A block holds about so many nodes and so many shingles.
BLOCK_NODES = 512
BLOCK_SHINGLES = 1 << 19


def bands_for(similarity: float) -> int:
    """Bands of ``_ROWS`` minima that miss a pair at ``similarity`` in at most a share ``MISSED`` of cases."""
    return max(1, math.ceil(math.log(MISSED) / math.log(1 - similarity**_ROWS))) if similarity < 1 else 1


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; of fewer words, of the whole sequence."""
    digest = xxhash.xxh64_digest
    found: list[np.ndarray] = []
    for words in word_runs(text or b"", size):
        if len(words) < size:
            if words and not found:
                found.append(np.frombuffer(digest(b" ".join(words), 42), np.uint64))
            continue
        hashed = b"".join([digest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)])
        found.append(np.unique(np.frombuffer(hashed, np.uint64)))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def _minima(hashes: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), _SLICE):
        mixed = hashes[start : start + _SLICE] * factors[:, None]
        mixed += terms[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    return least


_SKETCH = pa.schema(
    [("doc_id", pa.int64()), ("version", pa.int64()), ("node", pa.binary()), ("n", pa.int64()), ("buckets", pa.list_(pa.int64()))]
)


def _version() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _version().alias("version"), text_bytes().alias("text"))


def _sketches(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(doc_id, version, node, n, buckets): the hash and size of a text's set and a hash for each band."""
    bands = bands_for(similarity)

    def run(batches):
        rng = np.random.default_rng(7)
        factors = rng.integers(0, 1 << 63, bands * _ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
        terms = rng.integers(0, 1 << 63, bands * _ROWS, np.uint64) * np.uint64(2)
        out = RowBuffer(_SKETCH)
        for doc_id, version, text in rows_of(batches, "doc_id", "version", "text"):
            hashes = shingles(text, size)
            buckets = []
            if len(hashes):
                rows = _minima(hashes, factors, terms).reshape(bands, _ROWS)
                buckets = [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(rows)]
            if out.add(doc_id, version, xxhash.xxh128_digest(hashes.tobytes()), len(hashes), buckets):
                yield from out.flush()
        yield from out.flush()

    return _texts(docs).mapInArrow(run, "doc_id bigint, version bigint, node binary, n bigint, buckets array<bigint>")


_SET = pa.schema([("node", pa.binary()), ("hashes", pa.binary())])


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, hashes) of ``nodes`` (node, doc_id, version)."""

    def run(batches):
        out = RowBuffer(_SET, 64)
        for node, text in rows_of(batches, "node", "text"):
            if out.add(node, shingles(text, size).tobytes()):
                yield from out.flush()
        yield from out.flush()

    # Rows may repeat; one of them is read for a node.
    known = _texts(docs).join(nodes, ["doc_id", "version"]).dropDuplicates(["node"])
    return known.select("node", "text").mapInArrow(run, "node binary, hashes binary")


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets are at least ``similarity`` alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (batch.column(i) for i in range(4))
            alike = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                common = len(np.intersect1d(x, y, assume_unique=True))
                alike[i] = common / (len(x) + len(y) - common) >= similarity
            keep = pa.array(alike)
            yield record_batch(_LINKS, [a.filter(keep), b.filter(keep)])

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("hashes").alias("_b")), "b"
    )
    return both.select("a", "b", "_a", "_b").mapInArrow(run, "a binary, b binary")


def _named(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` (bucket, node, n) of buckets that hold several components, with their component."""
    named = members.join(components(links), "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low <> _high")
    return materialize(named.join(mixed.select("bucket"), "bucket", "left_semi"))


def _sizes_fit(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= F.floor(F.greatest(a, b) * (similarity - 1e-9))


def _marked(named: DataFrame) -> DataFrame:
    """``named`` with ``outside``: not in the largest component of its bucket."""
    held = named.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("_n"))
    largest = held.groupBy("bucket").agg(F.max(F.struct("_n", "component")).alias("_l")).select("bucket", F.col("_l.component").alias("_main"))
    return named.join(largest, "bucket").select("bucket", "node", "n", "component", (F.col("component") != F.col("_main")).alias("outside"))


_BLOCK = ["bucket", "outer", "inner"]


def _blocks(marked: DataFrame, nodes: int, shingled: int) -> DataFrame:
    """(bucket, outer, inner, outside, node, n, component): each outside node with every block of its bucket,
    and every node with each block of outside nodes."""

    def blocks(chosen: Column) -> Column:
        count = F.count(F.when(chosen, 1)) / nodes
        return F.greatest(F.lit(1), F.ceil(F.greatest(count, F.coalesce(F.sum(F.when(chosen, F.col("n"))), F.lit(0)) / shingled)))

    sizes = marked.groupBy("bucket").agg(
        blocks(F.col("outside")).cast("bigint").alias("_outer"), blocks(F.lit(True)).cast("bigint").alias("_inner")
    )
    dealt = marked.join(sizes, "bucket")
    h = F.xxhash64("node", F.lit("block"))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))
    outer = dealt.where("outside").select("bucket", F.pmod(h, "_outer").alias("outer"), every("_inner").alias("inner"), "outside", "node", "n", "component")
    inner = dealt.select(
        "bucket", every("_outer").alias("outer"), F.pmod(h, "_inner").alias("inner"), F.lit(False).alias("outside"), "node", "n", "component"
    )
    return outer.unionByName(inner.select(*outer.columns))


def _common(sets: list[np.ndarray], others: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each of ``sets`` the number of its hashes in each of ``others``."""
    every = np.concatenate(others)
    order = np.argsort(every, kind="stable")
    holder = np.repeat(np.arange(len(others)), [len(s) for s in others])[order]
    every = every[order]
    for one in sets:
        first, last = np.searchsorted(every, one), np.searchsorted(every, one, side="right")
        count = last - first
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        yield np.bincount(holder[at], minlength=len(others))


def _spanning_links(outside: list[tuple], inside: list[tuple], similarity: float) -> Iterator[tuple[bytes, bytes]]:
    """Links between rows (node, component, hashes) of both lists that join all that are alike, none twice joined."""
    up: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    sizes = np.array([len(h) for _, _, h in inside])
    for (node, component, hashes), common in zip(outside, _common([h for _, _, h in outside], [h for _, _, h in inside]), strict=True):
        for i in np.flatnonzero(common >= similarity * (sizes + len(hashes) - common)).tolist():
            a, b = find(component), find(inside[i][1])
            if a != b:
                up[a] = b
                yield node, inside[i][0]


def _block_links(blocks: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): spanning links of every block of ``blocks``."""

    def run(batches):
        out, key, outside, inside = RowBuffer(_LINKS, 1024), None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if outside and inside:
                for a, b in _spanning_links(outside, inside, similarity):
                    if out.add(a, b):
                        yield from out.flush()

        for *now, is_outside, node, component, hashes in rows_of(batches, *_BLOCK, "outside", "node", "component", "hashes"):
            if now != key:
                yield from done()
                key, outside, inside = now, [], []
            (outside if is_outside else inside).append((node, component, np.frombuffer(hashes, np.uint64)))
        yield from done()
        yield from out.flush()

    dealt = blocks.join(sets, "node").repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)
    return dealt.select(*_BLOCK, "outside", "node", "component", "hashes").mapInArrow(run, "a binary, b binary")


def _simhash_pairs(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(a, b): nodes joined by the SimHash index: those of one fingerprint with the first of them, and first ones of near fingerprints."""
    read = classes.where("n > 0").select("doc_id", "version", "node")
    # Rows may repeat; every one of a node has its shingles.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _version().alias("version"), "text")
    rows = texts.join(read.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
    stored = fingerprints(rows.select("doc_id", "text"), size).distinct().join(read, ["doc_id", "version"])
    marked = materialize(stored.select("node", "fp"))
    firsts = materialize(marked.groupBy("fp").agg(F.min("node").alias("first")))
    copies = marked.join(firsts, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = near_links(firsts.select("fp", F.col("fp").alias("rep")))
    first = lambda name: firsts.select(F.col("fp").alias(name), F.col("first").alias(f"_{name}"))
    return copies.unionByName(near.join(first("a"), "a").join(first("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def _links(docs: DataFrame, classes: DataFrame, size: int, similarity: float, block_nodes: int, block_shingles: int) -> DataFrame:
    """(a, b): links that join all nodes that share a bucket and are alike, or are joined by such nodes."""
    every = classes.select("node", "n", F.explode(F.array_distinct("buckets")).alias("bucket"))
    shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    members = materialize(every.join(shared.select("bucket"), "bucket", "left_semi").select("bucket", "node", "n"))
    close = materialize(_simhash_pairs(docs, classes, size))
    asked = members.select("node").union(close.select("a")).union(close.select("b")).distinct()
    candidates = classes.join(asked, "node", "left_semi").select("node", "doc_id", "version")
    sets = materialize(_sets(docs, candidates, size))
    links = materialize(_confirmed(close, sets, similarity))
    named, before, turn = _named(members, links), 0, 0
    while True:
        mark = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "component")
        centres = named.groupBy("bucket").agg(F.min(mark).alias("_c"))
        stars = named.join(centres, "bucket").where((F.col("component") != F.col("_c.component")) & _sizes_fit("n", "_c.n", similarity))
        pairs = stars.groupBy("node").agg(F.min("_c").alias("_c")).select(F.col("node").alias("a"), F.col("_c.node").alias("b"))
        links = materialize(links.unionByName(_confirmed(pairs, sets, similarity)))
        named, turn = _named(members, links), turn + 1
        marked = _marked(named)
        left = marked.where("outside").count()
        # Another centre is worth its round while it joins a good part of what is left.
        if not left or turn >= _STAR_ROUNDS and 2 * left > before:
            break
        before = left
    return links.unionByName(_block_links(_blocks(materialize(marked), block_nodes, block_shingles), sets, similarity))


def _grouped(docs: DataFrame, size: int, similarity: float, block_nodes: int, block_shingles: int) -> DataFrame:
    """(doc_id, version, component) of every node's smallest row."""
    if not 0 < similarity <= 1:
        raise ValueError("a similarity above 0 and up to 1 is needed")
    least = F.min(F.struct("doc_id", "version", "n", "buckets")).alias("_least")
    classes = materialize(_sketches(docs, size, similarity).groupBy("node").agg(least).select("node", "_least.*"))
    found = components(_links(docs, classes, size, similarity, block_nodes, block_shingles))
    return classes.join(found, "node", "left").select("doc_id", "version", F.coalesce("component", "node").alias("component"))


def one_of_each(
    docs: DataFrame, size: int = 5, similarity: float = 0.8, block_nodes: int = BLOCK_NODES, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, that of the smallest doc_id; all columns stay.

    Texts are near duplicates if the sets of their ``size``-word shingles (in
    lower case; the whole text if it has fewer words) have a Jaccard similarity
    of ``similarity`` or more, and a group holds all that such pairs join. Texts
    without words are alike. Links are exact; of the pairs at just the
    similarity a share of ``MISSED`` is not looked at. Rows without doc_id stay.
    Of rows that share doc_id and text one stays. A text of any length is read
    whole; its set of shingles, eight bytes each, travels in one piece.
    """
    groups = _grouped(docs.where("doc_id is not null"), size, similarity, block_nodes, block_shingles)
    kept = groups.groupBy("component").agg(F.min(F.struct("doc_id", "version")).alias("_kept"))
    kept = kept.select(F.col("_kept.doc_id").alias("_doc"), F.col("_kept.version").alias("_version"))
    known = packed(docs.where("doc_id is not null"), _doc=F.col("doc_id").cast("bigint"), _version=_version())
    chosen = known.join(kept, ["_doc", "_version"]).dropDuplicates(["_doc", "_version"])
    return unpacked(chosen, docs.columns).unionByName(docs.where("doc_id is null"))
