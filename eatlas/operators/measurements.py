"""Summaries of measured routes and request latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .ranking import exact_at_ranks, nearest_rank
from .snapshot import _side_by_side


def route_samples(routes: DataFrame, times: str | None = None) -> DataFrame:
    """Estimated against actual driving time of landed routes.

    ``routes``: id, straight_meters, route_meters, route_seconds, and perhaps
    ``times``, how many routes a row stands for.
    """
    estimate = geo.driving_minutes(F.col("straight_meters"))
    actual = F.greatest(F.lit(1), F.ceil(F.col("route_seconds") / 60)).cast("bigint")
    return routes.select(
        "id",
        "straight_meters",
        F.floor(F.col("route_meters") + 0.5).cast("bigint").alias("route_meters"),
        geo.rounded(F.col("route_meters") / F.col("straight_meters"), 2).alias("multiplier"),
        estimate.alias("estimated_minutes"),
        actual.alias("actual_minutes"),
        (estimate - actual).alias("error_minutes"),
        *([] if times is None else [times]),
    )


def sample_counts(samples: DataFrame, times: str) -> DataFrame:
    """Samples that :func:`route_summary` cannot tell apart as one row, which counts as often as all of them."""
    return samples.groupBy("multiplier", "error_minutes").agg(F.sum(times).alias(times))


def route_summary(samples: DataFrame, times: str | None = None) -> DataFrame:
    """Error summary of travel estimates as one row; zeros without samples.

    A row counts as often as its column ``times`` says (default: once).
    """
    error, n = F.col("error_minutes"), F.lit(1) if times is None else F.col(times)
    zero = lambda c: F.coalesce(c, F.lit(0))
    mean = lambda c: F.sum(c * n) / F.sum(F.when(c.isNotNull(), n))
    count = lambda c: zero(F.sum(F.when(c, n))).cast("bigint")
    sums = samples.agg(
        count(F.lit(True)).alias("sample_count"),
        F.round(zero(mean(F.col("multiplier"))), 2).alias("mean_multiplier"),
        F.round(zero(mean(error)), 1).alias("mean_error"),
        F.round(zero(mean(F.abs(error))), 1).alias("mean_absolute_error"),
        zero(F.max(F.abs(error))).cast("bigint").alias("max_absolute_error"),
        count(error < 0).alias("underestimated"),
        count(F.abs(error) <= 2).alias("within_two_minutes"),
    )
    middle = exact_at_ranks(
        samples.select(F.abs(error).cast("double").alias("error"), n.alias("times")),
        [],
        "error",
        {
            "low": (0.5, F.floor((F.col("n") + 1) / 2).cast("bigint")),
            "high": (0.5, F.floor(F.col("n") / 2).cast("bigint") + 1),
        },
        "times",
    ).agg(F.max("low").alias("low"), F.max("high").alias("high"))
    median = middle.select(F.round(zero((F.col("low") + F.col("high")) / 2), 1).alias("median_absolute_error"))
    return _side_by_side(sums, median)


def latency_summary(requests: DataFrame, by: list[str], elapsed_seconds: float | None = None) -> DataFrame:
    """Request count, rate, volume and latency percentiles per group.

    ``requests``: latency, bytes and the ``by`` columns. Percentiles are exact
    nearest-rank values. The rate needs ``elapsed_seconds``.
    """
    sums = requests.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        (F.sum("bytes") / (1024 * 1024)).alias("megabytes"),
        F.avg("latency").alias("average"),
        F.max("latency").alias("maximum"),
    )
    if elapsed_seconds is not None:
        sums = sums.withColumn("requests_per_second", F.col("requests") / F.lit(float(elapsed_seconds)))
    ranks = {
        name: (ratio, nearest_rank(ratio, F.col("n")))
        for name, ratio in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
    }
    percentiles = exact_at_ranks(requests, by, "latency", ranks)
    return sums.join(percentiles, by, "left") if by else _side_by_side(sums, percentiles)
