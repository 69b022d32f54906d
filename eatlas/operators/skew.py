"""Expressions computed once, and stored tables that cut lineage.

Joins of many rows with one row per key are left to Spark: adaptive skew joins
split the partition of a hot key on the side of the many rows, at any number of
hot keys and without a list of them (see the README for the setting).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Whether the shuffles of a query are deleted when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns behind a generator, which the optimizer does not
    look through: filters on them do not make Spark compute them again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over the session's shuffle partitions.

    Small files of long or costly rows come in one or two scan tasks, and a
    small table is broadcast or its partitions joined, so that all work on its
    rows would fall to those few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the one the cluster names in
    ``spark.checkpoint.dir``, else the warehouse, which they share as well."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def stored_folder(spark: SparkSession) -> str:
    """Folder of what this application stores for itself; deleted when it ends."""
    path = f"{shared_folder(spark)}/eatlas/{spark.sparkContext.applicationId}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative jobs, and the result outlives lost executors.
    The shuffles it was made with are deleted at once, not when the driver
    happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{stored_folder(spark)}/{uuid.uuid4().hex}"
    kept = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if kept is None else spark.conf.set(_CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path)
