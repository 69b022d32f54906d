"""Distance joins on a grid of cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import geo, sphere
from .skew import computed_once, materialize

# The finest cells of a radius join: 2**FINEST of them a side of a cube's face. A
# radius uses cells of twice that size as often as it takes to hold it.
FINEST = 16
# Requests and places of a cell that are compared at once.
ROWS_PER_BLOCK = 10_000
# Up to this straight distance, squared, on a globe of radius 1 (64 km) three terms of the arc's series are exact.
SHORT_SQUARED = 1e-4
# Metres that a distance from unit vectors may be off, with a wide margin, for coordinates of at most WIDEST degrees.
VECTOR_ERROR = 1e-7
WIDEST = 720.0

CELL = ("cell_face", "cell_i", "cell_j")
VECTOR = ("_x", "_y", "_z")


def with_vector(df: DataFrame) -> DataFrame:
    """``df`` with the unit vector of its latitude and longitude in the columns ``VECTOR``."""
    vector = sphere.unit_vector(F.col("latitude"), F.col("longitude"))
    return computed_once(df, **dict(zip(VECTOR, vector.values(), strict=True)))


def own_cell(df: DataFrame, across: Column) -> DataFrame:
    """Rows that have a vector, and the cell they lie in, on a grid of ``across`` cells a side."""
    found = computed_once(df, _cell=sphere.cell(*map(F.col, VECTOR), across))
    return found.select(*df.columns, *[F.col("_cell")[f].alias(c) for f, c in zip(("face", "i", "j"), CELL, strict=True)])


def covering_cells(df: DataFrame, radius: Column, across: Column) -> DataFrame:
    """One row for each cell that the circle around a row that has a vector may touch."""
    # Step by step, so that Spark compiles a few short expressions instead of one for all faces.
    seen = df.withColumn("_radius", radius).withColumn("_across", across).select("*", F.inline(sphere.faces(*map(F.col, VECTOR))))
    near = seen.where(F.col("_main") >= sphere.LEAST_MAIN - sphere.chord(F.col("_radius")))
    spans = computed_once(
        near,
        _i=sphere.span(F.col("_first"), F.col("_main"), F.col("_radius")),
        _j=sphere.span(F.col("_second"), F.col("_main"), F.col("_radius")),
    ).where("_i.low <= _i.high and _j.low <= _j.high")
    rows = spans.withColumn("cell_i", F.explode(sphere.index_range(F.col("_i"), F.col("_across"))))
    rows = rows.withColumn("cell_j", F.explode(sphere.index_range(F.col("_j"), F.col("_across"))))
    return rows.select(*df.columns, F.col("_face").alias("cell_face"), "cell_i", "cell_j")


def cell_join(asking: DataFrame, held: DataFrame, on: list[str]) -> DataFrame:
    """Rows of :func:`covering_cells` with the rows that lie in their cells.

    Spark takes the many cells of a row for one when it estimates sizes, so it
    would send tables to the driver and broadcast them that are far above its limit.
    """
    return asking.hint("merge").join(held.hint("merge"), on)


def _chord_squared() -> Column:
    """Squared straight distance of a request's and a place's vector."""
    apart = [F.col(c) - F.col(f"_q{c}") for c in VECTOR]
    return apart[0] * apart[0] + apart[1] * apart[1] + apart[2] * apart[2]


def _plain(latitude: str, longitude: str) -> Column:
    """Whether the unit vector of this row's position is as exact as ``VECTOR_ERROR`` says."""
    return (F.abs(latitude) <= WIDEST) & (F.abs(longitude) <= WIDEST)


def _rounded(distance: Column, squared: Column, plain: Column, decimals: int) -> Column:
    """``round(distance, decimals)``; the exact distance is computed only if the straight one does not decide it."""
    unit = 10.0**decimals
    arc = F.sqrt(squared) * (1 + squared * (1 / 24 + squared * (3 / 640)))
    # In units of the last decimal, and half a unit more.
    units = arc * (V.EARTH_RADIUS_METERS * unit) + 0.5
    whole = F.floor(units)
    decided = plain & (squared <= SHORT_SQUARED) & (units - whole).between(VECTOR_ERROR * unit, 1 - VECTOR_ERROR * unit)
    return F.when(decided, whole / F.lit(unit)).otherwise(F.round(distance, decimals))


def _level(radius: Column) -> Column:
    """How often the finest cell is doubled before it is as large as the radius."""
    cells = radius / (math.pi / 2 * V.EARTH_RADIUS_METERS / 2**FINEST)
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(cells, F.lit(1.0)))), F.lit(0)), F.lit(FINEST)).cast("int")


def _cells_across() -> Column:
    """Cells of this row's _level a side of a face."""
    return F.expr(f"shiftright({1 << FINEST}, _level)").cast("bigint")


def radius_join(
    requests: DataFrame,
    places: DataFrame,
    radius: str = "radius_meters",
    spread: str = "ord",
    rows_per_block: int = ROWS_PER_BLOCK,
    positions: DataFrame | None = None,
    decimals: int | None = None,
    apart: list[str] | None = None,
) -> DataFrame:
    """All (request, place) pairs with distance <= the request's radius.

    An equi-join on grid cells with the exact distance as residual. Each radius
    class has a grid of its own, so a request reaches about a dozen cells
    whatever its radius. Both sides need ``latitude`` and ``longitude``; the
    request's are renamed to ``request_latitude`` and ``request_longitude``.
    Requests or places without a position pair with nothing.

    Crowded cells are cut into blocks of requests and blocks of places, and
    each pair of blocks is joined by itself. ``positions`` (default:
    ``places``) may be any cheaper table with at least the same points to count
    places on. With ``decimals`` (6 at most) distances come rounded to them,
    which is far cheaper where there are many pairs. ``apart`` names columns of
    the requests that tell those of one position apart (default: all of them).
    """
    located = lambda df: df.where(geo.is_finite(F.col("latitude")) & geo.is_finite(F.col("longitude")))
    asked = located(requests).where((F.col(radius) >= 0) & geo.is_finite(F.col(radius))).withColumn("_level", _level(F.col(radius)))
    # At most FINEST + 1 levels.
    levels = [r["_level"] for r in asked.select("_level").distinct().collect()]
    # Vectors are made again behind the shuffle, which they would make half as large again.
    covered = covering_cells(with_vector(asked), F.col(radius), _cells_across()).drop(*VECTOR)
    wanted = covered.withColumnsRenamed({"latitude": "request_latitude", "longitude": "request_longitude"})
    every_level = F.explode(F.array(*[F.lit(n) for n in sorted(levels)]).cast("array<int>"))

    def gridded(df: DataFrame) -> DataFrame:
        return own_cell(with_vector(located(df)).withColumn("_level", every_level), _cells_across()).drop(*VECTOR)

    cell = ["_level", *CELL]
    stored = gridded(places)
    counted = stored if positions is None else gridded(positions.select("latitude", "longitude"))
    blocks = lambda df, name: (
        df.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / rows_per_block).cast("int").alias(name)).where(F.col(name) > 1)
    )
    # One row per rows_per_block rows at most; both sides read the same stored list, which Spark
    # broadcasts only if it is small.
    crowded = materialize(blocks(wanted, "_asking").join(blocks(counted, "_offering"), cell, "full"))
    one = F.lit(1)
    mine = lambda rows, n: F.pmod(F.xxhash64(*rows), F.coalesce(F.col(n), one)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), one) - 1))
    known = [c for c, kind in requests.dtypes if "map<" not in kind and c not in ("latitude", "longitude")] if apart is None else apart
    wanted = wanted.join(crowded, cell, "left").withColumn(
        "_a", mine([*known, "request_latitude", "request_longitude"], "_asking")
    ).withColumn("_o", all_of("_offering")).drop("_asking", "_offering")
    stored = stored.join(crowded, cell, "left").withColumn("_o", mine([spread], "_offering")).withColumn(
        "_a", all_of("_asking")
    ).drop("_asking", "_offering")
    distance = geo.distance_meters(
        F.col("request_latitude"), F.col("request_longitude"), F.col("latitude"), F.col("longitude")
    )
    # As many tasks as the session asks for: what a task compares does not follow from the size of its rows.
    # The keys are made where the optimizer does not look through: a constant part of a key would have
    # Spark shuffle again, into fewer tasks.
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = ["cell_face_i_j", "_block"]
    level, face, i, j = map(F.col, cell)
    bits = FINEST + 1

    def dealt(df: DataFrame) -> DataFrame:
        keyed = computed_once(
            df,
            cell_face_i_j=F.shiftleft(F.shiftleft((level * 6 + face).cast("bigint"), bits).bitwiseOR(i), bits).bitwiseOR(j),
            _block=F.shiftleft(F.col("_a").cast("bigint"), 32).bitwiseOR(F.col("_o").cast("bigint")),
        )
        return keyed.drop(*cell, "_a", "_o").repartition(tasks, *block)

    # A little more than the radius and a little less; only what lies between goes through the exact formula.
    straight = sphere.chord(F.col(radius))
    reach, inner = straight * (1 + 1e-9) + 1e-12, F.greatest(straight * (1 - 1e-9) - 1e-12, F.lit(0.0))
    place = ("request_latitude", "request_longitude")
    vector = {f"_q{c}": v for c, v in zip(VECTOR, sphere.unit_vector(*map(F.col, place)).values(), strict=True)}
    wanted = computed_once(
        dealt(wanted), **vector, _squared_chord=reach * reach, _squared_inner=F.when(_plain(*place), inner * inner).otherwise(-1.0)
    )
    stored = with_vector(dealt(stored)).withColumn("_plain", _plain("latitude", "longitude"))
    squared, plain = _chord_squared(), F.col("_plain")
    pairs = cell_join(wanted, stored, block).where(
        (squared <= F.col("_squared_chord")) & ((plain & (squared <= F.col("_squared_inner"))) | (distance <= F.col(radius)))
    )
    if decimals is not None:
        distance = _rounded(distance, squared, plain & (F.col("_squared_inner") >= 0), decimals)
    pairs = pairs.withColumn("distance_meters", distance)
    marks = ["_plain", "_squared_inner", "_squared_chord", *VECTOR, *[f"_q{c}" for c in VECTOR]]
    return pairs.drop(*block, *marks)


def nearby_pairs(nodes: DataFrame, keys: list[str], meters: float, carry: list[str]) -> DataFrame:
    """Pairs of ``nodes`` with equal ``keys`` at most ``meters`` apart.

    ``nodes`` needs ``rep`` (unique), ``latitude`` and ``longitude``; each pair
    comes once with ``left.rep < right.rep``, its columns suffixed _l and _r.
    """
    across = F.lit(sphere.cells_across(max(float(meters), 0.1)))
    columns = ["rep", "latitude", "longitude", *VECTOR, *carry]
    suffixed = lambda df, mark: df.select(
        *keys, *CELL, *[F.col(c).alias(f"{c}_{mark}") for c in columns]
    )
    placed = with_vector(nodes)
    left = suffixed(covering_cells(placed, F.lit(float(meters)), across), "l")
    right = suffixed(own_cell(placed, across), "r")
    distance = geo.distance_meters(
        F.col("latitude_l"), F.col("longitude_l"), F.col("latitude_r"), F.col("longitude_r")
    )
    marks = [f"{c}_{mark}" for c in VECTOR for mark in "lr"]
    return (
        cell_join(left, right, [*keys, *CELL])
        .where((F.col("rep_l") < F.col("rep_r")) & (distance <= meters))
        .drop(*CELL, *marks)
    )
