"""Vectors as short codes: each part of a vector by the entry of a codebook nearest to it.

Vectors are whole numbers (components times a scale, rounded down) cut into
equal parts; each part position has a codebook of its own, improved in rounds
that average the parts of each entry. All figures are exact, so the result does
not depend on how the rows are dealt out.

A round does not compare every part with every entry. Blocks of vectors hold a
metric tree for each part position, an anchors hierarchy: anchors are spread
over a block's points, each stealing from the earlier ones only what half the
distance between them lets it; the balls around them are joined upwards, the
pair with the smallest joint ball first, and split downwards in the same way
(middle-out). Balls hold the sum and the number of their points. A ball inherits
its parent's list of entries and strikes off those that lie, for every point of
the ball, behind another one; a ball left with one entry is owned by it and adds
its cached sum. Only points of leaves that stay contested are compared, and
those in whole numbers.

Trees are built once and stored. A round sends the codebooks to the blocks and
brings back one sum for each entry and component, added up by Spark.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.skew import materialize
from .common import record_batch
from .vectors import matrices

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BLOCK = 4096
LEAF = 32


def _finite(embedding: str) -> Column:
    """The vector as doubles, or null if it is null or holds null or non-finite components."""
    values = F.col(embedding).cast("array<double>")
    return F.when(F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), values)


def _whole(matrix: np.ndarray, scale: int) -> np.ndarray:
    """Whole-numbered components; an error if exact sums of their squares could overflow."""
    with np.errstate(over="ignore"):
        scaled = np.floor(matrix * scale)
    most = min(math.isqrt((1 << 62) // max(matrix.shape[1], 1)) // 2, (1 << 31) - 1)
    if scaled.size and np.abs(scaled).max() > most:
        raise ValueError(f"components beyond {most / scale:g} cannot be compared exactly")
    return scaled.astype(np.int64)


class Tree:
    """Balls over points, which stand in ``order`` so that each ball's are neighbours.

    ``low`` and ``high`` are the ends of each ball in that order, ``left`` and
    ``right`` its children (-1 for a leaf), ``sums`` the sums of its points;
    all points lie within ``radius`` of their mean. Balls follow their parents.
    """

    def __init__(self, order, low, high, left, right, radius, sums):
        self.order, self.low, self.high, self.left, self.right, self.radius, self.sums = order, low, high, left, right, radius, sums
        self.counts = high - low

    def to_bytes(self) -> bytes:
        ints = np.concatenate([[len(self.low), self.sums.shape[1]], self.low, self.high, self.left, self.right, self.order]).astype("<i4")
        return self.sums.astype("<i8").tobytes() + self.radius.astype("<f8").tobytes() + ints.tobytes() + np.array([len(ints)], "<i4").tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> Tree:
        n = int(np.frombuffer(data, "<i4", 1, len(data) - 4)[0])
        ints = np.frombuffer(data, "<i4", n, len(data) - 4 - 4 * n)
        k, width = int(ints[0]), int(ints[1])
        low, high, left, right = (ints[2 + i * k : 2 + (i + 1) * k] for i in range(4))
        sums = np.frombuffer(data, "<i8", k * width).reshape(k, width)
        return Tree(ints[2 + 4 * k :], low, high, left, right, np.frombuffer(data, "<f8", k, 8 * k * width), sums)


def _anchors(points: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """The anchor that owns each point, and how many there are: at most ``most``, fewer if points coincide."""
    anchors = [0]
    owner = np.zeros(len(points), np.int64)
    distance = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    while len(anchors) < most:
        far = int(distance.argmax())
        if distance[far] == 0:
            break
        apart = np.sqrt(((points[anchors] - points[far]) ** 2).sum(axis=1))
        # A point nearer to its anchor than half the way to the new one stays.
        open_to = np.flatnonzero(distance > 0.4999 * apart[owner])
        new = np.sqrt(((points[open_to] - points[far]) ** 2).sum(axis=1))
        stolen = new < distance[open_to]
        owner[open_to[stolen]] = len(anchors)
        distance[open_to[stolen]] = new[stolen]
        distance[far] = 0.0
        anchors.append(far)
    return owner, len(anchors)


def _joined(means: np.ndarray, counts: np.ndarray, radii: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of balls to join, the smallest joint ball first; the i-th pair becomes ball len(means) + i."""
    k = len(counts)
    means, counts, radii = means.copy(), counts.astype(float), radii.copy()
    names = list(range(k))

    def joint(i: int) -> np.ndarray:
        apart = np.sqrt(((means - means[i]) ** 2).sum(axis=1))
        share = counts / (counts + counts[i])
        return np.maximum(apart * share + radii[i], apart * (1 - share) + radii)

    table = np.array([joint(i) for i in range(k)])
    np.fill_diagonal(table, np.inf)
    pairs = []
    for step in range(k - 1):
        i, j = divmod(int(table.argmin()), k)
        pairs.append((names[i], names[j]))
        radius = table[i, j]
        means[i] = (means[i] * counts[i] + means[j] * counts[j]) / (counts[i] + counts[j])
        counts[i] += counts[j]
        radii[i], names[i] = radius, k + step
        table[j, :] = table[:, j] = np.inf
        row = np.where(np.isinf(table[i]), np.inf, joint(i))
        row[i] = np.inf
        # Balls already joined into others are out for good.
        table[i, :] = table[:, i] = row
    return pairs


def ball_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Anchors hierarchy of whole-numbered points (at least one row)."""
    places = points.astype(np.float64)
    children: list[tuple[int, int]] = []
    members: list[np.ndarray | None] = []

    def ball(of: np.ndarray | None, left: int = -1, right: int = -1) -> int:
        children.append((left, right))
        members.append(of)
        return len(children) - 1

    def built(of: np.ndarray) -> int:
        if len(of) <= leaf:
            return ball(of)
        owner, k = _anchors(places[of], max(2, math.isqrt(len(of))))
        if k == 1:
            return ball(of)
        sort = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[sort], np.arange(1, k))
        groups = np.split(of[sort], cuts)
        means = np.array([places[g].mean(axis=0) for g in groups])
        radii = np.array([np.sqrt(((places[g] - m) ** 2).sum(axis=1).max()) for g, m in zip(groups, means, strict=True)])
        names = [built(g) for g in groups]
        for i, j in _joined(means, np.array([len(g) for g in groups]), radii):
            names.append(ball(None, names[i], names[j]))
        return names[-1]

    root = built(np.arange(len(points)))
    # Parents first, the points of each ball side by side.
    number, order, low, high, left, right = {}, [], [], [], [], []
    todo, size = [(root, -1, 0)], 0
    while todo:
        node, parent, side = todo.pop()
        number[node] = here = len(low)
        if parent >= 0:
            (left if side == 0 else right)[parent] = here
        low.append(size)
        high.append(-1)
        left.append(-1)
        right.append(-1)
        if children[node][0] >= 0:
            todo += [(children[node][1], here, 1), (children[node][0], here, 0)]
        else:
            order.append(members[node])
            size += len(members[node])
            high[here] = size
    for here in range(len(low) - 1, -1, -1):
        if left[here] >= 0:
            high[here] = high[right[here]]
    order = np.concatenate(order)
    low, high, left, right = (np.array(x, np.int64) for x in (low, high, left, right))
    total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order], axis=0)])
    sums = total[high] - total[low]
    means = sums / (high - low)[:, None]
    radius, sorted_places = np.zeros(len(low)), places[order]
    for here in range(len(low) - 1, -1, -1):
        away = sorted_places[low[here] : high[here]] - means[here]
        radius[here] = math.sqrt((away * away).sum(axis=1).max())
    return Tree(order, low, high, left, right, radius, sums)


def nearest(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of whole-numbered points to entries."""
    return (points * points).sum(axis=1)[:, None] - 2 * (points @ entries.T) + (entries * entries).sum(axis=1)[None, :]


def assigned(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry of each point, sums and numbers of the points of each entry, points compared one by one).

    Points go to the nearest entry, the first of several; ``points`` stand in
    the order of the tree.
    """
    k = len(entries)
    places = entries.astype(np.float64)
    apart = np.sqrt(((places[:, None] - places[None]) ** 2).sum(axis=2))
    first = np.array([int(np.flatnonzero((entries == e).all(axis=1))[0]) for e in entries]) == np.arange(k)
    codes = np.empty(len(points), np.int64)
    sums, counts = np.zeros((k, points.shape[1]), np.int64), np.zeros(k, np.int64)
    balls, lists = np.zeros(1, np.int64), first[None, :]
    contested, compared = [], 0
    while len(balls):
        means = tree.sums[balls] / tree.counts[balls][:, None]
        far = np.where(lists, ((means[:, None] - places[None]) ** 2).sum(axis=2), np.inf)
        best = far.argmin(axis=1)
        near = far[np.arange(len(balls)), best][:, None]
        # Behind the best entry for the whole ball, with room for rounding.
        room = 2 * tree.radius[balls][:, None] * apart[best] * (1 + 1e-9) + 1e-9 * (far + near + 1)
        lists = lists & ~(far - near > room)
        owned = lists.sum(axis=1) == 1
        np.add.at(sums, best[owned], tree.sums[balls[owned]])
        np.add.at(counts, best[owned], tree.counts[balls[owned]])
        for a, b, e in zip(tree.low[balls[owned]].tolist(), tree.high[balls[owned]].tolist(), best[owned].tolist(), strict=True):
            codes[a:b] = e
        inner = ~owned & (tree.left[balls] >= 0)
        leaves = ~owned & (tree.left[balls] < 0)
        contested += zip(tree.low[balls[leaves]].tolist(), tree.high[balls[leaves]].tolist(), lists[leaves], strict=True)
        balls = np.concatenate([tree.left[balls[inner]], tree.right[balls[inner]]])
        lists = np.concatenate([lists[inner], lists[inner]])
    if contested:
        at = np.concatenate([np.arange(a, b) for a, b, _ in contested])
        may = np.repeat(np.array([c for _, _, c in contested]), [b - a for a, b, _ in contested], axis=0)
        compared = len(at)
        codes[at] = np.where(may, nearest(points[at], entries), np.iinfo(np.int64).max).argmin(axis=1)
        np.add.at(sums, codes[at], points[at])
        counts += np.bincount(codes[at], minlength=k)
    return codes, sums, counts, compared


def _blocks(vectors: DataFrame, label: str, scale: int, parts: int, entries: int, block: int) -> DataFrame:
    """Rows (length, ids, labels, points, trees, seeds) of at most ``block`` vectors of one length.

    ``seeds`` are the vectors of the block's smallest ids. Vectors that cannot
    be cut into equal parts have no points, trees or seeds.
    """
    label_type = vectors.schema[label].dataType
    seed = pa.struct([("vec_id", pa.int64()), ("vector", pa.list_(pa.int64()))])
    schema = pa.schema(
        [("length", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(to_arrow_type(label_type)))]
        + [("points", pa.binary()), ("trees", pa.list_(pa.binary())), ("seeds", pa.list_(seed))]
    )
    ddl = f"length int, ids array<bigint>, labels array<{label_type.simpleString()}>, points binary, trees array<binary>, seeds array<struct<vec_id:bigint,vector:array<bigint>>>"

    def row(length: int, held: list[tuple]) -> pa.RecordBatch:
        ids = [i for part, _, _ in held for i in part]
        labels = pa.concat_arrays([x for _, x, _ in held])
        points, trees, seeds = None, [], []
        if length and length % parts == 0:
            matrix = np.concatenate([m for _, _, m in held])
            least: dict = {}
            for i, vec_id in enumerate(ids):
                least.setdefault(vec_id, []).append(i)
            for vec_id in sorted(least, key=lambda v: (v is None, v or 0))[:entries]:
                seeds.append({"vec_id": vec_id, "vector": min(matrix[i].tolist() for i in least[vec_id])})
            width = length // parts
            trees = [ball_tree(matrix[:, p * width : (p + 1) * width]).to_bytes() for p in range(parts)]
            points = matrix.astype("<i4").tobytes()
        lists = [pa.ListArray.from_arrays([0, len(labels)], labels)]
        return record_batch(schema, [[length], [ids], *lists, [points], [trees], [seeds]])

    def run(batches):
        held: dict[int, list] = {}
        sizes: dict[int, int] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                for rows, matrix in matrices(part.column(2)):
                    length = matrix.shape[1]
                    taken = part.take(pa.array(rows))
                    whole = _whole(matrix, scale) if length % parts == 0 else None
                    held.setdefault(length, []).append((taken.column(0).to_pylist(), taken.column(1), whole))
                    sizes[length] = sizes.get(length, 0) + len(rows)
                while sum(sizes.values()) >= block:
                    length = max(sizes, key=sizes.get)
                    yield row(length, held.pop(length))
                    del sizes[length]
        for length in sorted(held):
            yield row(length, held[length])

    return vectors.mapInArrow(run, ddl)


def _points(row: dict, parts: int) -> Iterator[tuple[Tree, np.ndarray]]:
    """The tree of each part position with the block's points in its order."""
    length = row["length"]
    matrix = np.frombuffer(row["points"], "<i4").reshape(-1, length).astype(np.int64)
    width = length // parts
    for p, data in enumerate(row["trees"]):
        tree = Tree.from_bytes(data)
        yield tree, matrix[tree.order, p * width : (p + 1) * width]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


Codebooks = dict[int, np.ndarray]
"""By vector length: components by part, entry and position."""

_SUMS = pa.schema([("length", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("position", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])


def _first_codebooks(blocks: DataFrame, parts: int, entries: int) -> Codebooks:
    """The vectors of the smallest ids; of rows with one id the smallest vector, rows without id last."""
    seeds = blocks.select("length", F.inline("seeds")).groupBy("length", "vec_id").agg(F.min("vector").alias("vector"))
    rank = F.row_number().over(W.partitionBy("length").orderBy(F.col("vec_id").asc_nulls_last()))
    books: dict[int, list] = {}
    for r in sorted(seeds.withColumn("rank", rank).where(F.col("rank") <= entries).collect(), key=lambda r: r["rank"]):
        books.setdefault(r["length"], []).append(r["vector"])
    return {n: np.array(v, np.int64).reshape(len(v), parts, -1).transpose(1, 0, 2) for n, v in books.items()}


def _improved(blocks: DataFrame, books: Codebooks, parts: int) -> Codebooks:
    """Entries as the rounded-down means of the parts nearest to them; unused entries stay."""

    def run(batches):
        sums = {n: (np.zeros(b.shape, np.int64), np.zeros(b.shape[:2], np.int64)) for n, b in books.items()}
        for row in _rows(batches):
            total, count = sums[row["length"]]
            for p, (tree, points) in enumerate(_points(row, parts)):
                _, s, c, _ = assigned(tree, points, books[row["length"]][p])
                total[p] += s
                count[p] += c
        for n, (total, count) in sums.items():
            at = np.nonzero(np.broadcast_to(count[:, :, None] > 0, total.shape))
            if len(at[0]):
                yield record_batch(_SUMS, [np.full(len(at[0]), n), *at, total[at], count[at[:2]]])

    found = blocks.where("points is not null").select("length", "points", "trees")
    found = found.mapInArrow(run, "length int, part int, entry int, position int, total bigint, n bigint")
    better = {n: b.copy() for n, b in books.items()}
    for r in found.groupBy("length", "part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        better[r["length"]][r["part"], r["entry"], r["position"]] = r["total"] // r["n"]
    return better


def codebooks_digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def _coded(blocks: DataFrame, books: Codebooks, parts: int) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of every vector."""
    label_type = blocks.schema["labels"].dataType.elementType
    schema = pa.schema([("vec_id", pa.int64()), ("label", to_arrow_type(label_type)), ("code", pa.string()), ("error", pa.int64()), ("codebooks_sha256", pa.string())])
    digests = {n: codebooks_digest(b) for n, b in books.items()}

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = {name: one.column(j)[0].as_py() for j, name in enumerate(batch.schema.names) if name not in ("ids", "labels")}
                ids, labels = one.column(1).flatten(), one.column(2).flatten()
                if row["points"] is None:
                    nothing = [None] * len(ids)
                    yield record_batch(schema, [ids, labels, nothing, nothing, nothing])
                    continue
                codes, error = np.empty((len(ids), parts), np.int64), np.zeros(len(ids), np.int64)
                for p, (tree, points) in enumerate(_points(row, parts)):
                    entries = books[row["length"]][p]
                    found = assigned(tree, points, entries)[0]
                    codes[tree.order, p] = found
                    error[tree.order] += ((points - entries[found]) ** 2).sum(axis=1)
                written = [bytes(c).hex() for c in codes.astype(np.uint8)]
                yield record_batch(schema, [ids, labels, written, error, [digests[row["length"]]] * len(ids)])

    narrow = blocks.select("length", "ids", "labels", "points", "trees")
    return narrow.mapInArrow(run, f"vec_id bigint, label {label_type.simpleString()}, code string, error bigint, codebooks_sha256 string")


def coded(
    vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK
) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of ``vectors`` (vec_id, embedding, label).

    Vectors that are null or hold null or non-finite components are dropped.
    Each vector length has codebooks of its own; a length that ``parts`` does
    not divide, or zero, has null code, error and codebooks. Codebooks start
    from the ``entries`` smallest ids; of rows that share one, the smallest
    vector counts, and rows without id count last, as one id. Repeated rows
    count each for itself in the means; other columns are ignored. Components
    of some thousands (``_whole``) are an error, since sums would not be exact.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's number is one byte")
    label_type = vectors.schema["label"].dataType
    typed = F.col("label") if not isinstance(label_type, T.NullType) else F.col("label").cast("int")
    narrow = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), typed.alias("label"), _finite("embedding").alias("embedding"))
    blocks = materialize(_blocks(narrow.where("embedding is not null"), "label", scale, parts, entries, block))
    books = _first_codebooks(blocks, parts, entries)
    for _ in range(rounds):
        books = _improved(blocks, books, parts)
    return _coded(blocks, books, parts)


def code_digest(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """:func:`coded` with ``label_error``, the error summed over equal labels (nulls together)."""
    rows = materialize(coded(vectors, block=block))
    totals = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = rows.alias("a").join(totals.alias("b"), F.col("a.label").eqNullSafe(F.col("b.label")))
    return joined.select("a.vec_id", "a.code", "a.error", "b.label_error", "a.codebooks_sha256")
