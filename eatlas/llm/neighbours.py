"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors are scaled by the largest norm and given one more component so that all
have length one; then the largest inner product is the smallest distance. In
each table three p-stable projections, cut into intervals of fixed width, name a
vector's bucket. A query visits the buckets of each table in the order of the
estimated chance to hold a neighbour: the projections of a query and of a
neighbour at cosine rho are jointly normal with correlation rho, so the chance
is a product of normal interval masses around rho times the query's projection.

How many buckets are visited is fitted: for at most ``SAMPLE_QUERIES`` queries
the exact neighbours among all rows are found in one pass, and the visits are
set so that ``TARGET`` of those pairs are met. Every row is indexed. Candidates
of all tables are merged and ranked by exact inner products.

Only the first k + 1 ids of equal vectors can be among k neighbours, so copies
beyond them are not indexed, and equal queries are answered once. Buckets are
grouped into blocks; a block with many rows is split by row, and queries come
in groups of bounded size, so every task holds a bounded part of both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.skew import materialize
from .common import record_batch
from .vectors import as_doubles, matrices

NEIGHBOURS = 20
TABLES = 4
FUNCTIONS = 3
INTERVALS = 9
WIDTH = 0.75
# Pairs of the sample to be met, and rows that a query visits at least.
TARGET = 0.96
LEAST_ROWS = 500
SAMPLE_QUERIES = 64
ROWS_PER_GROUP = 20_000
QUERIES_PER_GROUP = 5_000
SEED = 5

_BLOCK_CELLS = INTERVALS ** (FUNCTIONS - 1)
_CELLS = INTERVALS**FUNCTIONS
_erf = np.frompyfunc(math.erf, 1, 1)


class Hashing(NamedTuple):
    """Projections (dim + 1, TABLES * FUNCTIONS) and the inner borders of each one's intervals."""

    planes: np.ndarray
    borders: np.ndarray
    largest: float


def hashing(dim: int, largest: float, seed: int = SEED) -> Hashing:
    rng = np.random.default_rng([seed, dim])
    planes = rng.standard_normal((dim + 1, TABLES * FUNCTIONS))
    shift = rng.uniform(-WIDTH / 2, WIDTH / 2, TABLES * FUNCTIONS)
    inner = (np.arange(1, INTERVALS) - INTERVALS / 2) * WIDTH
    return Hashing(planes, inner + shift[:, None], largest)


def row_projections(h: Hashing, rows: np.ndarray) -> np.ndarray:
    scaled = rows / h.largest
    rest = np.sqrt(np.maximum(1 - (scaled * scaled).sum(axis=1), 0))
    return np.column_stack([scaled, rest]) @ h.planes


def query_projections(h: Hashing, queries: np.ndarray) -> np.ndarray:
    unit = queries / np.sqrt((queries * queries).sum(axis=1, keepdims=True))
    return unit @ h.planes[:-1]


def cells(h: Hashing, projections: np.ndarray) -> np.ndarray:
    """Bucket of each row in each table."""
    place = (projections[:, :, None] > h.borders).sum(axis=2).reshape(len(projections), TABLES, FUNCTIONS)
    return place @ (INTERVALS ** np.arange(FUNCTIONS - 1, -1, -1))


def bucket_chances(h: Hashing, projections: np.ndarray, rho: float) -> np.ndarray:
    """Estimated chance (query, table, bucket) that a neighbour at cosine ``rho`` falls there."""
    spread = math.sqrt(max(1 - rho * rho, 1e-6))
    z = (h.borders - rho * projections[:, :, None]) / (spread * math.sqrt(2))
    below = (1 + _erf(z).astype(float)) / 2
    edge = np.zeros((*below.shape[:2], 1))
    mass = np.diff(np.concatenate([edge, below, edge + 1], axis=2), axis=2).reshape(len(projections), TABLES, FUNCTIONS, INTERVALS)
    chance = mass[:, :, 0]
    for f in range(1, FUNCTIONS):
        chance = (chance[..., None] * mass[:, :, f, None, :]).reshape(len(projections), TABLES, -1)
    return chance


def visit_order(h: Hashing, projections: np.ndarray, rho: float, filled: np.ndarray) -> np.ndarray:
    """Buckets (query, table, rank) by falling chance, empty ones last."""
    chance = np.where(filled[None] > 0, bucket_chances(h, projections, rho), -1.0)
    return np.argsort(-chance, axis=2, kind="stable")


def visits(order: np.ndarray, filled: np.ndarray, fitted: int) -> np.ndarray:
    """Buckets each query visits per table: the fitted number, more if they hold too few rows."""
    sizes = np.take_along_axis(np.broadcast_to(filled[None], order.shape), order, axis=2).sum(axis=1)
    enough = (np.cumsum(sizes, axis=1) < LEAST_ROWS).sum(axis=1) + 1
    return np.minimum(np.maximum(enough, fitted), _CELLS)


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Places of each query's ``most`` best entries, ties to the smaller id."""
    order = np.lexsort((vec, -score, query))
    sorted_query = query[order]
    first = np.searchsorted(sorted_query, sorted_query)
    return order[np.arange(len(order)) - first < most]


def _exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products row by row, the same for equal rows wherever they stand."""
    return (np.ascontiguousarray(queries) * np.ascontiguousarray(rows)).sum(axis=1)


def top_of_block(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the ``most`` best rows of each query; a block of queries at a time."""
    found = []
    for a in range(0, len(queries), 512):
        part = queries[a : a + 512]
        rough = part @ rows.T
        if len(rows) > most:
            least = np.partition(rough, len(rows) - most, axis=1)[:, len(rows) - most]
            # Rough products of equal rows may differ in the last bits.
            q, r = np.nonzero(rough >= (least - 1e-9 * np.abs(least) - 1e-12)[:, None])
        else:
            q, r = np.divmod(np.arange(rough.size), len(rows))
        score = _exact(part[q], rows[r])
        keep = best(q, ids[r], score, most)
        found.append((q[keep] + a, r[keep], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


_FOUND = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_FOUND_DDL = "query bigint, vec_id bigint, score double"


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, every: int = 20, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for each row whose vec_id ``every`` divides.

    ``vectors`` has vec_id and embedding. Null, empty and zero vectors, those
    with null or non-finite components and rows without vec_id take no part.
    Vectors of different lengths have no product, so each length is searched by
    itself, with hashing of its own. Of rows that share a vec_id the smallest
    vector counts. All other rows are found if there are no more than
    ``neighbours``. Other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), as_doubles().alias("vector"))
    rows = materialize(rows.where("vec_id is not null and vector is not null").groupBy("vec_id").agg(F.min("vector").alias("vector")))
    asked = F.count_if(F.pmod("vec_id", F.lit(every)) == 0).alias("n")
    lengths = [r["length"] for r in rows.groupBy(F.size("vector").alias("length")).agg(asked).where("n > 0").orderBy("length").collect()]
    found = [_nearest_of_length(rows.where(F.size("vector") == length), length, every, neighbours) for length in lengths]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return reduce(DataFrame.unionByName, found)


def _nearest_of_length(rows: DataFrame, dim: int, every: int, neighbours: int) -> DataFrame:
    """:func:`nearest` for rows (vec_id, vector) of one length with at least one query."""
    most = neighbours + 1  # the query itself may be among them
    copies = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    index = materialize(rows.withColumn("_copy", copies).where(F.col("_copy") <= most).drop("_copy"))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = materialize(asked.groupBy("vector").agg(F.min("vec_id").alias("query")))
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    largest, n_queries = index.agg(F.max(F.sqrt(squares))).first()[0], queries.count()
    h = hashing(dim, largest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary()), ("cells", pa.list_(pa.int32()))])
        for batch in batches:
            for at, matrix in matrices(batch.column(1)):
                found = cells(h, row_projections(h, matrix))
                yield record_batch(schema, [batch.column(0).take(pa.array(at)), [v.tobytes() for v in matrix], found.tolist()])

    placed = materialize(index.select("vec_id", "vector").mapInArrow(place, "vec_id bigint, vector binary, cells array<int>"))
    by_table = placed.select("vec_id", "vector", F.posexplode("cells").alias("table", "cell"))
    # At most TABLES * INTERVALS ** FUNCTIONS counts, whatever the data.
    filled = np.zeros((TABLES, _CELLS), np.int64)
    for row in by_table.groupBy("table", "cell").count().collect():
        filled[row["table"], row["cell"]] = row["count"]
    rho, fitted = _fitted_visits(h, queries, index, filled, most)
    salts = np.maximum(1, -(-filled.reshape(TABLES, INTERVALS, _BLOCK_CELLS).sum(axis=2) // ROWS_PER_GROUP))
    query_groups = -(-n_queries // QUERIES_PER_GROUP)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("table", pa.int32()), ("block", pa.int32()), ("salt", pa.int32()), ("part", pa.int32()), ("query", pa.int64()), ("vector", pa.binary()), ("cells", pa.list_(pa.int32()))])
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                ids = some.column(0).to_pylist()
                (_, matrix), = matrices(some.column(1))
                order = visit_order(h, query_projections(h, matrix), rho, filled)
                count = visits(order, filled, fitted)
                out = [[] for _ in schema]
                for i, query in enumerate(ids):
                    for t in range(TABLES):
                        seen = order[i, t, : count[i]]
                        seen = seen[filled[t, seen] > 0]
                        for block in np.unique(seen // _BLOCK_CELLS).tolist():
                            own = seen[seen // _BLOCK_CELLS == block].tolist()
                            for salt in range(int(salts[t, block])):
                                for column, value in zip(out, (t, block, salt, query % query_groups, query, matrix[i].tobytes(), own), strict=True):
                                    column.append(value)
                yield record_batch(schema, out)

    probes = queries.select("query", "vector").mapInArrow(
        probe, "table int, block int, salt int, part int, query bigint, vector binary, cells array<int>"
    )
    salted = F.array(*[F.array(*[F.lit(int(s)) for s in line]) for line in salts])
    block = F.floor(F.col("cell") / _BLOCK_CELLS).cast("int")
    targets = by_table.withColumn("block", block).select(
        "table",
        "block",
        F.pmod(F.xxhash64("vec_id"), salted[F.col("table")][F.col("block")]).cast("int").alias("salt"),
        F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1))).alias("part"),
        "vec_id",
        "vector",
        "cell",
    )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        matrix, ids, own = _matrix(left.column("vector"), dim), left.column("vec_id").to_numpy(), left.column("cell").to_numpy()
        wanted, asking = _matrix(right.column("vector"), dim), right.column("query").to_numpy()
        lengths = np.array([len(c) for c in right.column("cells").to_pylist()])
        probed = np.concatenate([np.array(c, np.int64) for c in right.column("cells").to_pylist()])
        prober = np.repeat(np.arange(len(asking)), lengths)
        found: list[tuple] = []
        for cell in np.unique(probed).tolist():
            inside = np.flatnonzero(own == cell)
            if len(inside):
                q, r, score = top_of_block(wanted[prober[probed == cell]], matrix[inside], ids[inside], most)
                found.append((prober[probed == cell][q], inside[r], score))
        if not found:
            return _FOUND.empty_table()
        q, r, score = (np.concatenate(c) for c in zip(*found, strict=True))
        keep = best(q, ids[r], score, most)
        return pa.Table.from_batches([record_batch(_FOUND, [asking[q[keep]], ids[r[keep]], score[keep]])])

    key = ["table", "block", "salt", "part"]
    found = targets.groupBy(*key).cogroup(probes.groupBy(*key)).applyInArrow(lambda left, right: search(left, right), _FOUND_DDL)
    merged = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    nearest_first = [F.col("score").desc(), F.col("vec_id")]
    top = merged.withColumn("_n", F.row_number().over(W.partitionBy("query").orderBy(*nearest_first))).where(F.col("_n") <= most)
    members = asked.join(queries, "vector").select(F.col("vec_id").alias("query_id"), "query")
    answers = members.join(top, "query").where("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*nearest_first))
    return answers.withColumn("rank", rank).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")


def _fitted_visits(h: Hashing, queries: DataFrame, index: DataFrame, filled: np.ndarray, most: int) -> tuple[float, int]:
    """Cosine of a usual neighbour, and buckets to visit so that TARGET of the sample's pairs are met."""
    sample = queries.orderBy(F.xxhash64("query"), "query").limit(SAMPLE_QUERIES).collect()
    numbers = np.array([r["query"] for r in sample], np.int64)
    wanted = np.array([r["vector"] for r in sample])
    ddl = _FOUND_DDL + ", vector binary"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _FOUND.append(pa.field("vector", pa.binary()))
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            (_, matrix), = matrices(batch.column(1))
            q, r, score = top_of_block(wanted, matrix, ids, most)
            yield record_batch(schema, [numbers[q], ids[r], score, [matrix[i].tobytes() for i in r]])

    exact = index.select("vec_id", "vector").mapInArrow(scan, ddl).where("query <> vec_id")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id")))
    pairs = exact.withColumn("_n", rank).where(F.col("_n") < most).collect()
    if not pairs:
        return 0.0, 1
    at = {int(n): i for i, n in enumerate(numbers)}
    query = np.array([at[p["query"]] for p in pairs])
    rows = np.array([np.frombuffer(p["vector"], np.float64) for p in pairs])
    length = np.sqrt((wanted * wanted).sum(axis=1))
    cosine = np.array([p["score"] for p in pairs]) / (length[query] * h.largest)
    rho = float(np.clip(cosine.mean(), 0.0, 0.99))
    order = visit_order(h, query_projections(h, wanted), rho, filled)
    rank_of = np.argsort(order, axis=2)
    own = cells(h, row_projections(h, rows))
    met = np.min([rank_of[query, t, own[:, t]] for t in range(TABLES)], axis=0) + 1
    return rho, int(np.quantile(met, TARGET, method="higher"))
