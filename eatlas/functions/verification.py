"""What the verification of a place says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


def _is(verification: Column, status: str) -> Column:
    return F.coalesce(
        (verification["provider"] == V.VERIFICATION_PROVIDER) & (verification["status"] == status),
        F.lit(False),
    )


def has_place_id(place_id: Column) -> Column:
    return F.length(F.coalesce(place_id, F.lit(""))) > 0


def is_confirmed(place_id: Column, verification: Column) -> Column:
    """Place id present and the provider confirmed the match."""
    return has_place_id(place_id) & _is(verification, V.STATUS_CONFIRMED)


def is_checked_unverified(verification: Column) -> Column:
    return _is(verification, V.STATUS_UNVERIFIED)


def completeness(place_id: Column, place_url: Column, phone: Column, verification: Column, menus: Column) -> Column:
    """Score that picks the record a duplicate group keeps."""
    present = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    points = lambda test, value: F.when(test, value).otherwise(0)
    return (
        points(is_confirmed(place_id, verification), 10_000)
        + points(present(place_id), 1_000)
        + points(present(place_url), 300)
        + points(present(phone), 100)
        + F.least(F.coalesce(F.size(menus), F.lit(0)), F.lit(50))
    )
