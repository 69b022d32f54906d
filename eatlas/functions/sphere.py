"""Cells on the globe without a seam and without poles, as Column expressions.

A cube stands around the globe; each of its six faces is a grid of n x n cells.
A point lies on the face of its largest coordinate, and its place on the face is
given by two angles, each between -45 and 45 degrees. An angle is the longitude
of a globe whose axis lies in the face, so the cells that a circle may touch
follow, face by face, from the two ranges of angles that the circle covers,
wherever it lies; cells of neighbouring faces come out of the same formula.

At the middle of a face a cell measures 90 / n degrees a side; elsewhere it is
a little smaller, and askew towards the corners of the cube.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V

_QUARTER = math.pi / 4
# Added to every range of angles: six millimetres on the ground, far above rounding.
_SLACK = 1e-9
# No cell is wider than this many times its side in the middle of a face.
DIAMETER = 1.64
# Axis, sign and the two other axes of each face.
_FACES = (("x", 1, "y", "z"), ("x", -1, "y", "z"), ("y", 1, "x", "z"), ("y", -1, "x", "z"), ("z", 1, "x", "y"), ("z", -1, "x", "y"))


def unit_vector(latitude: Column, longitude: Column) -> dict[str, Column]:
    """The point as ``x``, ``y`` and ``z`` on a globe of radius 1."""
    lat, lon = F.radians(latitude), F.radians(longitude)
    return {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}


def chord(meters: Column | float) -> Column:
    """Straight distance on a globe of radius 1 of two points ``meters`` apart; the longest one beyond half way round."""
    value = F.lit(float(meters)) if isinstance(meters, (int, float)) else meters
    return 2 * F.sin(F.least(value / (2 * V.EARTH_RADIUS_METERS), F.lit(math.pi / 2)))


def cells_across(meters: float) -> int:
    """Cells a side of a face if cells are to be ``meters`` wide in the middle."""
    return max(1, min(1 << 40, math.ceil(2 * _QUARTER * V.EARTH_RADIUS_METERS / meters)))


def _index(angle: Column, n: Column) -> Column:
    return F.least(F.greatest(F.floor((angle / (2 * _QUARTER) + 0.5) * n).cast("bigint"), F.lit(0).cast("bigint")), n - 1)


def cell(x: Column, y: Column, z: Column, n: Column) -> Column:
    """(face, i, j) of a point given by its unit vector, on a grid of ``n`` cells a side."""
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    by_x, by_y = (ax >= ay) & (ax >= az), ay >= az
    side = lambda c, face: F.when(c >= 0, face).otherwise(face + 1)
    face = F.when(by_x, side(x, 0)).when(by_y, side(y, 2)).otherwise(side(z, 4))
    largest = F.greatest(ax, ay, az)
    first = F.when(by_x, y).otherwise(x)
    second = F.when(~by_x & ~by_y, y).otherwise(z)
    n = n.cast("bigint")
    return F.struct(
        face.cast("int").alias("face"),
        _index(F.atan2(first, largest), n).alias("i"),
        _index(F.atan2(second, largest), n).alias("j"),
    )


def faces(x: Column, y: Column, z: Column) -> Column:
    """The point as each face sees it: an array of (_face, _main, _first, _second).

    ``_main`` points out of the face, ``_first`` and ``_second`` lie in it.
    Points of a face have a ``_main`` of at least ``LEAST_MAIN`` there.
    """
    axes = {"x": x, "y": y, "z": z}
    return F.array(
        *[
            F.struct(F.lit(face).alias("_face"), (axes[axis] * sign).alias("_main"), axes[first].alias("_first"), axes[second].alias("_second"))
            for face, (axis, sign, first, second) in enumerate(_FACES)
        ]
    )


# A little less than the main coordinate at a corner of the cube.
LEAST_MAIN = 0.5773


def span(other: Column, main: Column, meters: Column) -> Column:
    """(low, high): the range of one of a face's angles that a circle of ``meters`` covers, empty if low > high."""
    angle = meters / V.EARTH_RADIUS_METERS
    reach, across = F.sin(F.least(angle, F.lit(math.pi / 2))), F.sqrt(main * main + other * other)
    # A circle that holds the axis of the angle, or half the globe, covers all of it.
    half = F.when((angle >= math.pi / 2) | (reach >= across), F.lit(2 * math.pi)).otherwise(F.asin(F.least(reach / across, F.lit(1.0))) + _SLACK)
    middle = F.atan2(other, main)
    return F.struct(F.greatest(middle - half, F.lit(-_QUARTER)).alias("low"), F.least(middle + half, F.lit(_QUARTER)).alias("high"))


def index_range(span: Column, n: Column) -> Column:
    """The indexes of cells, on a grid of ``n`` cells a side, that a range of angles touches."""
    n = n.cast("bigint")
    return F.sequence(_index(span["low"], n), _index(span["high"], n))
