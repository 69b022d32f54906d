"""Ranks, exact percentiles and samples that never sort one group in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import fixed_values as V
from ..functions import geo, sphere
from ..functions.verification import is_confirmed
from .skew import materialize
from .spatial import CELL, FINEST, own_cell, radius_join, with_vector


def distributed_row_number(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """1-based position within ``keys`` by ``order`` (a total order).

    The rows are range-partitioned on keys and order together, so a hot key
    spreads over many tasks; the positions in earlier partitions are added from
    a table with one row per key and partition.
    """
    stored = materialize(
        df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    )
    counts = stored.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*keys, "_part").orderBy(*order)
    ranked = stored.withColumn("_inside", F.row_number().over(inside))
    same = F.lit(True)
    for key in [*keys, "_part"]:
        same = same & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    return (
        ranked.alias("a")
        .join(offsets.alias("b"), same)
        .select(*[F.col(f"a.{c}") for c in df.columns], (F.col("_inside") + F.col("_before")).cast("bigint").alias(name))
    )


def evenly_spaced(df: DataFrame, order: str, count: int) -> DataFrame:
    """``count`` rows at even steps through the table in ``order``.

    ``order`` must be unique. All rows when there are no more than ``count``,
    the middle one for ``count=1``.
    """
    if count <= 0:
        return df.limit(0)
    ranked = distributed_row_number(df.select(order), [], [F.col(order)], "_pos")
    total = ranked.agg(F.count(F.lit(1)).alias("n"))
    if count == 1:
        picks = total.select(F.when(F.col("n") > 0, F.floor(F.col("n") / 2) + 1).alias("_pos"))
    else:
        even = F.transform(
            F.sequence(F.lit(0), F.lit(count - 1)),
            lambda i: F.floor(i * (F.col("n") - 1) / (count - 1) + 0.5) + 1,
        )
        every = F.sequence(F.lit(1).cast("bigint"), F.col("n"))
        picks = total.select(F.explode(F.when(F.col("n") <= count, F.when(F.col("n") > 0, every)).otherwise(even)).alias("_pos"))
    chosen = ranked.join(F.broadcast(picks.select(F.col("_pos").cast("bigint")).distinct()), "_pos", "left_semi")
    return df.join(chosen.select(order), order, "left_semi")


def nearest_rank(ratio: float, count: Column) -> Column:
    return F.greatest(F.lit(1), F.least(count, F.ceil(count * ratio))).cast("bigint")


def running_totals(df: DataFrame, keys: list[str], order: list[Column], value: str, upto: str, total: str) -> DataFrame:
    """Adds the sum of ``value`` up to each row of its group, by ``order``, and over the whole group.

    Range-partitioned on keys and order together, so a hot group spreads over
    many tasks; sums of other partitions come from a table with one row per key
    and partition.
    """
    stored = materialize(
        df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    )
    sums = stored.groupBy(*keys, "_part").agg(F.sum(value).alias("_s"))
    group = W.partitionBy(*keys)
    before = group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    others = sums.select(*keys, "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"), F.sum("_s").over(group).alias("_total"))
    inside = W.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = stored.withColumn("_inside", F.sum(value).over(inside))
    same = F.lit(True)
    for key in [*keys, "_part"]:
        same = same & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    return (
        summed.alias("a")
        .join(others.alias("b"), same)
        .select(*[F.col(f"a.{c}") for c in df.columns], (F.col("_inside") + F.col("_before")).alias(upto), F.col("_total").alias(total))
    )


def exact_at_ranks(
    df: DataFrame, by: list[str], value: str, ranks: dict[str, tuple[float, Column]], times: str | None = None
) -> DataFrame:
    """Exact values at given ranks per group, without sorting whole groups.

    ``ranks`` maps an output column to (ratio, 1-based rank from column ``n``,
    the group's number of values). Equal values are counted first, in one scan;
    the counts are summed in order over a range partitioning, and the first
    value whose sum reaches a rank is the one at it. A row may stand for
    several values, as many as its column ``times`` says.
    """
    one = F.lit(1) if times is None else F.col(times)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), one.alias("_times"))
    counts = rows.groupBy(*by, "_v").agg(F.sum("_times").alias("_c"))
    summed = running_totals(counts, by, [F.col("_v")], "_c", "_upto", "n")
    return summed.groupBy(*by).agg(
        *[F.min(F.when(F.col("_upto") >= rank, F.col("_v"))).alias(name) for name, (_, rank) in ranks.items()]
    )


def nearest_to_targets(
    places: DataFrame,
    latitude: float,
    longitude: float,
    targets: tuple[float, ...] = V.ROUTE_TARGET_METERS,
) -> DataFrame:
    """For each target distance the confirmed place closest to it, none twice.

    (target_meters, id, distance_meters); ties go to the smaller id. Earlier
    targets use up at most as many places as there are targets, so that many
    per target are enough to choose from.
    """
    if not 0 < len(targets) <= V.MAX_ROUTE_TARGETS or any(t <= 0 for t in targets):
        raise ValueError(f"1 to {V.MAX_ROUTE_TARGETS} positive targets are needed")
    distance = geo.distance_meters(F.lit(latitude), F.lit(longitude), F.col("latitude"), F.col("longitude"))
    measured = places.where(is_confirmed(F.col("place_id"), F.col("verification"))).select(
        "id", F.floor(distance + 0.5).cast("bigint").alias("distance_meters")
    )
    measured = measured.where(F.col("distance_meters").isNotNull())
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("meters")) for i, t in enumerate(targets)])
    options = measured.withColumn("t", F.explode(wanted))
    closest = W.partitionBy("t").orderBy(F.abs(F.col("distance_meters") - F.col("t.meters")), F.collate("id", "UNICODE"))
    short = options.withColumn("rank", F.row_number().over(closest)).where(F.col("rank") <= len(targets))
    found = short.groupBy("t").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id", "distance_meters"))).alias("options")
    )
    # Every target has a row, with no options if there is no place at all.
    every = places.sparkSession.range(1).select(F.explode(wanted).alias("t"))
    per_target = every.join(found, "t", "left").withColumn(
        "options", F.coalesce("options", F.array().cast("array<struct<rank:int,id:string,distance_meters:bigint>>"))
    )
    item = T.ArrayType(
        T.StructType(
            [
                T.StructField("target_meters", T.DoubleType()),
                T.StructField("id", T.StringType()),
                T.StructField("distance_meters", T.LongType()),
            ]
        )
    )

    def choose(chosen: Column, target: Column) -> Column:
        free = F.filter(target["options"], lambda o: ~F.exists(chosen, lambda c: c["id"] == o["id"]))
        pick = F.get(free, F.lit(0))
        return F.concat(
            chosen,
            F.array(
                F.struct(
                    target["t"]["meters"].alias("target_meters"),
                    F.coalesce(pick["id"], F.raise_error(F.lit("too few confirmed places for the targets")).cast("string")).alias("id"),
                    pick["distance_meters"].alias("distance_meters"),
                )
            ),
        )

    ordered = F.array_sort(F.collect_list(F.struct("t", "options")))
    picked = per_target.agg(F.aggregate(ordered, F.array().cast(item), choose).alias("picked"))
    return picked.select(F.inline("picked"))


def k_nearest(
    requests: DataFrame, places: DataFrame, k: int, key: str = "request_id", place: str = "id", spread: str = "ord"
) -> DataFrame:
    """The ``k`` places nearest to every request: (key, rank, place, distance_meters).

    Ties go to the smaller ``place``; a request has all places if there are
    fewer than ``k``. Rows without a position take no part; ``key`` and
    ``place`` are unique.

    A request's cell is widened, from a few metres to a face of the globe's
    cube, until it holds ``k`` places: they lie no farther than the cell is
    wide, so the nearest ones lie in that circle, and one radius join finds
    them. Where no face holds ``k``, the circle is the whole globe. Cells are
    counted once for all requests, and each task keeps ``k`` rows a request
    before they are shuffled.
    """
    if k <= 0:
        raise ValueError("at least one place is asked for")
    located = lambda df: df.where(geo.is_finite(F.col("latitude")) & geo.is_finite(F.col("longitude")))
    spots = materialize(located(places).select(place, spread, "latitude", "longitude"))
    asked = materialize(located(requests).select(key, "latitude", "longitude"))
    every = F.explode(F.sequence(F.lit(0), F.lit(FINEST)))
    across = F.expr("shiftleft(1L, _zoom)")
    celled = lambda df: own_cell(with_vector(df.select("latitude", "longitude", *([key] if key in df.columns else []))).withColumn("_zoom", every), across)
    cell = ["_zoom", *CELL]
    full = celled(spots).groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).drop("_n")
    zoomed = celled(asked).join(full, cell, "left_semi").groupBy(key).agg(F.max("_zoom").alias("_zoom"))
    side = math.pi / 2 * V.EARTH_RADIUS_METERS
    wide = F.lit(sphere.DIAMETER * side) / F.expr("shiftleft(1L, _zoom)") + 0.01
    reach = F.coalesce(F.least(wide, F.lit(2 * side)), F.lit(2 * side)) + 0.01
    circled = asked.join(zoomed, key, "left").select(key, "latitude", "longitude", reach.alias("radius_meters"))
    near = radius_join(circled, spots, spread=spread)
    order = W.partitionBy(key).orderBy("distance_meters", place)
    ranked = near.select(key, place, "distance_meters").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select(key, "rank", place, "distance_meters")


def merge_locations(places: DataFrame, addresses: DataFrame) -> DataFrame:
    """Search suggestions per query: places first, then addresses elsewhere.

    Inputs: query_id, rank (1-based), id, name, address, latitude, longitude.
    At most 5 places and 3 addresses enter; a place id counts once, an address
    only if no place or earlier address has its coordinates (5 decimals); at
    most 5 suggestions leave. A side that found nothing or failed is empty.
    """
    limited = lambda df, kind, limit: df.where(F.col("rank") <= limit).withColumn("kind", F.lit(kind))
    spot = F.struct(F.round("latitude", 5), F.round("longitude", 5))
    listed = limited(places, 0, V.LOCATION_RESULT_LIMIT).unionByName(
        limited(addresses, 1, V.LOCATION_ADDRESS_LIMIT)
    )
    order = ["kind", "rank"]
    keyed = listed.withColumn("spot", spot)
    same_id = W.partitionBy("query_id", "kind", "id").orderBy(*order)
    unique = keyed.withColumn("nth_id", F.row_number().over(same_id)).where(
        (F.col("kind") == 1) | (F.col("nth_id") == 1)
    )
    same_spot = W.partitionBy("query_id", "spot").orderBy(*order)
    free = unique.withColumn("nth_spot", F.row_number().over(same_spot)).where(
        (F.col("kind") == 0) | (F.col("nth_spot") == 1)
    )
    shown = W.partitionBy("query_id").orderBy(*order)
    return (
        free.withColumn("position", F.row_number().over(shown).cast("bigint"))
        .where(F.col("position") <= V.LOCATION_RESULT_LIMIT)
        .select("query_id", "position", "id", "name", "address", "latitude", "longitude")
    )


def failed_searches(failures: DataFrame) -> DataFrame:
    """Queries whose place and address search both failed: (query_id)."""
    return failures.groupBy("query_id").agg(F.count_distinct("side").alias("n")).where(F.col("n") > 1).select("query_id")
