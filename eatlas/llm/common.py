"""What the operators of this folder share."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import stored_folder

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text; Arrow hands them to Python without decoding."""
    return F.col(text).cast("binary")


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """Whole rows of ``docs`` in one column _row, so that no name clashes, beside ``columns``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(n) for n, c in columns.items()])


def unpacked(rows: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The columns ``names`` of _row, with those in ``changed`` replaced."""
    return rows.select(*[(changed[n] if n in changed else F.col("_row")[n]).alias(n) for n in names])


def blocks_for(df: DataFrame, amount: Column, per_block: int) -> int:
    """How many blocks of ``per_block`` hold the sum of ``amount``; at least one."""
    total = df.agg(F.sum(amount)).first()[0]
    return max(1, math.ceil((total or 0) / per_block))


def pylist(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, one small slice in Python at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield from zip(*(pylist(part, n) for n in names), strict=True)


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


class RowBuffer:
    """Collects output rows and hands them out as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, most: int = 4096):
        self.schema, self.most, self.columns = schema, most, [[] for _ in schema]

    def add(self, *values) -> bool:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)
        return len(self.columns[0]) >= self.most

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield record_batch(self.schema, self.columns)
            self.columns = [[] for _ in self.schema]


def with_checkpoints(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable: the cluster's folder, or our own where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{stored_folder(spark)}/checkpoints")
