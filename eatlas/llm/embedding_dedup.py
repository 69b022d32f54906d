"""Near-duplicate embeddings by random-hyperplane signatures.

The sign of a vector against random hyperplanes is a bit; ``bits`` of them make
its signature in a table, and vectors of one label with equal signatures in
some table are compared exactly. Equal vectors are folded into classes first.

A bucket with many vectors is cut into blocks of ``BLOCK`` rows, and each pair
of blocks is a group of its own, so no task holds more than two blocks. Groups
report, per vector, a number of links and one link of a spanning forest, never
the pairs. A pair that meets in several tables counts in the first of them.
Buckets are counted on keys alone, and vectors are sent only into buckets that
hold two or more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import materialize
from .common import record_batch
from .components import components
from .simhash import spanning
from .vectors import as_doubles, matrices

SIMILARITY = 0.98
# Chance to miss a pair at exactly the similarity; rows that meet in a bucket by chance; rows of a block.
MISS = 0.001
CROWD = 16
LEAST_BITS = 16
BLOCK = 1024
SEED = 11


def tables_for(rows: int, similarity: float, miss: float = MISS) -> tuple[int, int]:
    """Bits that keep buckets of ``rows`` vectors near CROWD, and tables that keep misses below ``miss``."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(rows, 1) / CROWD)))
    agree = (1 - math.acos(similarity) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - agree)))


def signatures(vectors: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Signature of each vector in each table."""
    dim = vectors.shape[1]
    planes = np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


_SIGNED = pa.schema(
    [("label", pa.int64()), ("rep", pa.int64()), ("version", pa.int64()), ("copies", pa.int64()), ("vector", pa.binary()), ("signature", pa.list_(pa.int64()))]
)
_LINKED = pa.schema([("rep", pa.int64()), ("version", pa.int64()), ("links", pa.int64()), ("parent", pa.int64())])


def _linked(group: dict[str, list], similarity: float) -> tuple | None:
    """Links of one group of rows that share a bucket, or of one block with another."""
    matrix = np.frombuffer(b"".join(group["vector"]), np.float64).reshape(len(group["rep"]), -1)
    own, low, high = np.array(group["own"]), group["low"][0], group["high"][0]
    norm = np.sqrt((matrix * matrix).sum(axis=1))
    near = matrix @ matrix.T >= similarity * norm[:, None] * norm
    near &= np.triu(np.ones(near.shape, bool), 1)
    if low != high:
        near &= own[:, None] != own
    i, j = np.nonzero(near)
    if not len(i):
        return None
    seen = np.array(group["signature"])
    table = group["table"][0]
    first = ~(seen[i, :table] == seen[j, :table]).any(axis=1)
    copies = np.array(group["copies"])
    links = np.bincount(i[first], copies[j[first]], len(own)) + np.bincount(j[first], copies[i[first]], len(own))
    rep = np.array(group["rep"])
    # Rows by vec_id, so that a row's label is the smallest vec_id of its part.
    order = np.argsort(rep, kind="stable")
    place = np.empty(len(rep), np.int64)
    place[order] = np.arange(len(rep))
    a, b = place[i], place[j]
    parent = rep[order][spanning(len(rep), iter([(np.minimum(a, b), np.maximum(a, b))]))[place]]
    told = (links > 0) | (parent != rep)
    return rep[told], np.array(group["version"])[told], links.astype(np.int64)[told], parent[told]


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Vectors link if their labels are equal and not null and their cosine is at
    least ``similarity``; vectors of different lengths never do. Null, empty and
    zero vectors, those with null or non-finite components and rows without
    vec_id or label link with nothing and are their own component. Repeated
    rows are vectors that link with each other; rows of one vec_id share a
    component. ``kept`` is false without vec_id. Other columns are ignored.
    """
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("bigint").alias("label"),
        F.when(usable, as_doubles()).alias("vector"),
    )
    classes = materialize(
        rows.where("vector is not null").groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    )
    crowd = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(crowd, similarity)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, matrix in matrices(batch.column(0)):
                rest = batch.take(pa.array(at))
                found = signatures(matrix, bits, tables)
                yield record_batch(
                    _SIGNED,
                    [rest.column(1), rest.column(2), rest.column(3), rest.column(4), [v.tobytes() for v in matrix], found.tolist()],
                )

    version = F.xxhash64("label", "vector").alias("version")
    signed = materialize(
        classes.select("vector", "label", "rep", version, "copies").mapInArrow(
            sign, "label bigint, rep bigint, version bigint, copies bigint, vector binary, signature array<bigint>"
        )
    )
    # Buckets are found on keys alone; vectors follow only into those that hold another one.
    bucket = F.xxhash64("label", "length", "table", "value").alias("bucket")
    keys = signed.select("label", F.octet_length("vector").alias("length"), "rep", "version", F.posexplode("signature").alias("table", "value"))
    keys = keys.select("rep", "version", "label", "length", "table", "value", bucket)
    shared = keys.groupBy("bucket").count().where(F.col("count") > 1)
    blocks = shared.select("bucket", F.ceil(F.col("count") / block).alias("blocks"))
    own = F.pmod(F.xxhash64("rep", "version"), F.col("blocks")).alias("own")
    paired = keys.join(blocks, "bucket").select("*", own)
    paired = paired.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    key = ["bucket", "label", "length", "table", "value", "low", "high"]
    spread = paired.select(
        *key[:5], F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "version"
    )
    grouped = spread.join(signed.select("rep", "version", "copies", "vector", "signature"), ["rep", "version"]).select(
        *key, "own", "rep", "version", "copies", "vector", "signature"
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        last = None

        def settle():
            if sum(b.num_rows for b in pending) > 1:
                found = _linked(pa.Table.from_batches(pending).to_pydict(), similarity)
                if found is not None:
                    yield record_batch(_LINKED, list(found))

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(len(key))), strict=True))
            start = 0
            for i, now in enumerate(keys):
                if now != last:
                    if i > start:
                        pending.append(batch.slice(start, i - start))
                    yield from settle()
                    pending, start, last = [], i, now
            if len(keys) > start:
                pending.append(batch.slice(start))
        yield from settle()

    linked = materialize(
        grouped.repartition(*key).sortWithinPartitions(*key).mapInArrow(link, "rep bigint, version bigint, links bigint, parent bigint")
    )
    counts = linked.groupBy("rep", "version").agg(F.sum("links").alias("links"))
    found = components(linked.select(F.col("rep").alias("a"), F.col("parent").alias("b")))
    named = (
        classes.select("label", "vector", "rep", "copies", version)
        .join(counts, ["rep", "version"], "left")
        .join(found, F.col("rep") == F.col("node"), "left")
        .select(
            "label",
            "vector",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    joined = rows.join(named, ["label", "vector"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
