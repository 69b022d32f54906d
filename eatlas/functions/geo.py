"""Coordinates, distances, tiles and travel time as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V

# A little below the true metres per degree, so that boxes built from it are
# never too small for the distance formula.
METERS_PER_DEGREE = 111_190.0


def is_finite(value: Column) -> Column:
    return F.coalesce(F.abs(value) < float("inf"), F.lit(False))


def distance_meters(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; NULL when a coordinate is missing."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    raw = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.sin(half_lon) * F.sin(half_lon)
    share = F.when(raw > 1, F.lit(1.0)).otherwise(raw)
    return F.lit(2 * V.EARTH_RADIUS_METERS) * F.atan2(F.sqrt(share), F.sqrt(1 - share))


def rounded(value: Column, decimals: int) -> Column:
    """``round(value, decimals)``; decimal arithmetic is left to values near half a unit, and to huge ones."""
    unit = 10.0**decimals
    # In units of the last decimal, and half a unit more.
    units = value * unit + 0.5
    whole = F.floor(units)
    clear = (F.abs(units) < 1e9) & (units - whole).between(1e-6, 1 - 1e-6)
    return F.when(clear, whole / F.lit(unit)).otherwise(F.round(value, decimals))


def latitude_span(meters: Column) -> Column:
    return meters / METERS_PER_DEGREE


def longitude_span(latitude: Column, meters: Column) -> Column:
    """Degrees of longitude that cover ``meters`` anywhere in the box.

    Uses the cosine at the edge of the box that is nearer to a pole, where a
    degree of longitude is shortest.
    """
    edge = F.least(F.abs(latitude) + latitude_span(meters), F.lit(90.0))
    return latitude_span(meters) / F.greatest(F.cos(F.radians(edge)), F.lit(0.01))


def longitude_reach(latitude: Column, meters: Column) -> Column:
    """Like ``longitude_span``, and all longitudes for a circle close to a pole."""
    edge = F.abs(latitude) + latitude_span(meters)
    return F.when(edge > 89.0, F.lit(180.0)).otherwise(F.least(longitude_span(latitude, meters), F.lit(180.0)))


def tile_index(coordinate: Column, degrees: float = V.TILE_DEGREES, offset: float = V.TILE_OFFSET) -> Column:
    return F.floor((coordinate - offset) / degrees).cast("bigint")


def tile_key(latitude: Column, longitude: Column) -> Column:
    return F.concat_ws("_", tile_index(latitude).cast("string"), tile_index(longitude).cast("string"))


def parse_coordinate(value: Column, maximum: float) -> Column:
    """Degrees from a text in degrees or in 1e-7 degrees, else NULL."""
    number = value.try_cast("double")
    scaled = F.when(F.abs(number) > maximum, number / 10_000_000).otherwise(number)
    return F.when(is_finite(number) & (F.abs(scaled) <= maximum), scaled)


def in_bounds(latitude: Column, longitude: Column, lat_range=V.BOUNDS_LATITUDE, lon_range=V.BOUNDS_LONGITUDE) -> Column:
    return F.coalesce(latitude.between(*lat_range) & longitude.between(*lon_range), F.lit(False))


def meters_per_minute(mode: Column) -> Column:
    return F.when(mode == "walking", V.WALKING_METERS_PER_MINUTE).when(
        mode == "driving", V.DRIVING_METERS_PER_MINUTE
    )


def travel_limit_meters(mode: Column, time_limit: Column) -> Column:
    """Distance limit of a travel mode and a limit '10', '20' or 'wide'."""
    wide = F.when(mode == "walking", V.WALKING_WIDE_METERS).when(
        mode == "driving", V.DRIVING_WIDE_METERS
    )
    return F.when(time_limit == V.TIME_LIMIT_WIDE, wide).otherwise(
        meters_per_minute(mode) * time_limit.try_cast("double")
    )


def travel_minutes(meters: Column, mode: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(meters / meters_per_minute(mode)).cast("bigint"))


def driving_minutes(meters: Column) -> Column:
    return travel_minutes(meters, F.lit("driving"))
