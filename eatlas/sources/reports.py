"""Report tables: every run is kept, the newest is the latest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(report: DataFrame, root: str, kind: str, run: str) -> None:
    """Append one run's report; runs sort by name (use UTC timestamps)."""
    path = f"{root}/{kind}/run={run}"
    report.write.mode("errorifexists").json(path)


def read_reports(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """All runs of a report, with their ``run``."""
    return spark.read.json(f"{root}/{kind}").withColumn("run", F.col("run").cast("string"))


def latest_report(spark: SparkSession, root: str, kind: str) -> DataFrame:
    rows = read_reports(spark, root, kind)
    newest = rows.agg(F.max("run").alias("run"))
    return rows.join(F.broadcast(newest), "run", "left_semi")
