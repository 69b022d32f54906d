"""Stored snapshots of the places table that know what they hold.

Rows go by the leading bits of a hash of their id: each group of rows is a leaf
of a tree in which four bits lead to a node's sixteen children. Beside the rows
stand the digests of all nodes, sums over their rows, so that equal parts of two
snapshots are known without reading them: from the root downwards only children
of differing nodes are compared, and only rows of differing leaves are read from
both snapshots and joined. Snapshots of different sizes have trees of different
depth; they are compared down to the depth of the smaller one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import snapshot
from ..operators.skew import materialize

_BITS = 4
# Leading bits of the folder a row lies in.
_FOLDER_BITS = 8
ROWS_PER_LEAF = 1000
_DEEPEST = 10


def depth_for(rows: int, rows_per_leaf: int = ROWS_PER_LEAF) -> int:
    """Levels below the root until a leaf holds about ``rows_per_leaf`` rows."""
    depth = 0
    while rows > rows_per_leaf << (_BITS * depth) and depth < _DEEPEST:
        depth += 1
    return depth


def _leading(bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce("id", F.lit(""))), 64 - bits) if bits else F.lit(0).cast("bigint")


def _digests(rows: DataFrame, depth: int) -> DataFrame:
    """(level, node, rows, first, second, repeated) of every node with rows.

    A row counts by its compared fields. ``repeated`` counts the rows beyond the
    first of an id: they are compared with each other's last record, so that a
    leaf that has any is never taken as equal.
    """
    content = F.to_json(F.struct("id", *snapshot.compared_values()), {"ignoreNullFields": "false"})
    hashed = rows.select("node", "id", content.alias("_content"))
    total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    by_id = hashed.groupBy("node", "id").agg(
        F.count(F.lit(1)).alias("rows"), total("_content").alias("first"), total(F.lit(1), F.reverse("_content")).alias("second")
    )
    sums = [F.sum(c).alias(c) for c in ("rows", "first", "second")]
    leaves = materialize(by_id.groupBy("node").agg(*sums, (F.sum("rows") - F.count(F.lit(1))).alias("repeated")))
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    up = leaves.withColumn("level", levels).withColumn("node", F.expr(f"shiftright(node, {_BITS} * ({depth} - level))"))
    return up.groupBy("level", "node").agg(*sums, F.sum("repeated").alias("repeated"))


def write_snapshot(places: DataFrame, path: str, rows_per_leaf: int = ROWS_PER_LEAF) -> None:
    """Store ``places`` under ``path``: rows by folder and leaf, and the digests of the tree."""
    depth = depth_for(places.count(), rows_per_leaf)
    placed = places.withColumn("node", _leading(_BITS * depth)).withColumn("folder", _leading(_FOLDER_BITS))
    rows = placed.repartitionByRange("folder", "node", "ord").sortWithinPartitions("folder", "node")
    rows.write.partitionBy("folder").parquet(f"{path}/rows")
    form = places.sparkSession.range(1).select(F.lit(placed.schema.json()).alias("value"))
    form.coalesce(1).write.text(f"{path}/schema")
    stored = _rows(places.sparkSession, path)
    _digests(stored, depth).withColumn("depth", F.lit(depth)).coalesce(1).write.parquet(f"{path}/digests")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """Stored rows with their node and folder; a snapshot without rows has no files to tell its columns."""
    form = spark.read.text(f"{path}/schema").first()[0]
    return spark.read.schema(T.StructType.fromJson(json.loads(form))).parquet(f"{path}/rows")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path).drop("node", "folder")


def differing_leaves(spark: SparkSession, previous: str, current: str) -> tuple[DataFrame, int]:
    """(node) of the leaves that are not known to be equal, and their level."""
    old, new = (spark.read.parquet(f"{path}/digests") for path in (previous, current))
    depths = [df.agg(F.max("depth")).first()[0] for df in (old, new)]
    level = min([d for d in depths if d is not None], default=0)
    same = ["rows", "first", "second"]
    found = None
    for at in range(level + 1):
        a, b = (df.where(F.col("level") == at).select("node", *same, "repeated") for df in (old, new))
        if found is not None:
            above = found.withColumnRenamed("node", "_above")
            a, b = (df.join(above, F.expr(f"shiftright(node, {_BITS})") == F.col("_above"), "left_semi") for df in (a, b))
        both = a.alias("a").join(b.alias("b"), "node", "full")
        equal = F.lit(True)
        for c in same:
            equal = equal & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        repeats = F.coalesce("a.repeated", F.lit(0)) + F.coalesce("b.repeated", F.lit(0)) > 0
        found = materialize(both.where(~equal | repeats).select("node"))
    return found, level


def diff_stored(spark: SparkSession, previous: str, current: str) -> tuple[DataFrame, DataFrame]:
    """:func:`snapshot.diff` of two stored snapshots, and the rows of both that were compared for it.

    Rows of equal leaves are listed as unchanged from the current snapshot
    alone; folders without a differing leaf are not opened in the previous one.
    """
    leaves, level = differing_leaves(spark, previous, current)
    # At most 2 ** _FOLDER_BITS numbers.
    shift = _BITS * level - _FOLDER_BITS
    folder = F.shiftright("node", shift) if shift >= 0 else None
    opened = None if folder is None else [r[0] for r in leaves.select(folder.alias("f")).distinct().collect()]

    def rows(path: str, how: str) -> DataFrame:
        stored = _rows(spark, path)
        if how == "left_semi" and opened is not None:
            stored = stored.where(F.col("folder").isin(opened))
        at = _leading(_BITS * level)
        return stored.withColumn("_leaf", at).join(leaves.withColumnRenamed("node", "_leaf"), "_leaf", how).drop("_leaf", "node", "folder")

    old, new = rows(previous, "left_semi"), rows(current, "left_semi")
    changes = snapshot.diff(old, new)
    equal = rows(current, "left_anti").select(
        F.lit("unchanged").alias("change"), *[c for c in changes.columns if c not in ("change", "changed_fields")],
        F.array().cast("array<string>").alias("changed_fields"),
    )
    compared = old.select("id", F.lit("previous").alias("snapshot")).unionByName(new.select("id", F.lit("current").alias("snapshot")))
    return changes.unionByName(equal.select(*changes.columns)), compared
