"""Comparing two snapshots of the places table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.verification import is_checked_unverified, is_confirmed
from . import dedup

# Column of the places table behind each compared field.
_COLUMN_OF = {"kakaoPlaceId": "place_id", "kakaoPlaceUrl": "place_url", "placeVerification": "verification"}


def _comparable(field: str, prefix: str) -> Column:
    """A field as compared; when a place was checked is no difference."""
    value = F.col(f"{prefix}{_COLUMN_OF.get(field, field)}")
    if field != "placeVerification":
        return value
    parts = [value[p].alias(p) for p in ("provider", "status", "matched_by", "distance_meters")]
    return F.when(value.isNotNull(), F.struct(*parts))


def compared_values() -> list[Column]:
    """The compared fields of a place, as they are compared."""
    return [_comparable(f, "").alias(f) for f in V.COMPARED_FIELDS]


def last_by_id(places: DataFrame, rename: str = "") -> DataFrame:
    """The last record of every id, columns prefixed with ``rename``."""
    others = [c for c in places.columns if c not in ("id", "ord")]
    last = F.max_by(F.struct(*others), "ord").alias("_last")
    picked = places.groupBy("id").agg(last)
    return picked.select("id", *[F.col(f"_last.{c}").alias(f"{rename}{c}") for c in others])


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """One row per current or vanished record: what happened to it.

    (change, id, ord, name, address, place_id, changed_fields) with change
    ``added``, ``removed``, ``changed`` or ``unchanged``. A repeated id is
    compared once per current row, against the last previous record.
    """
    compared = sorted({_COLUMN_OF.get(f, f) for f in V.COMPARED_FIELDS})
    old = last_by_id(previous.select("id", "ord", *compared), "old_").withColumn("_known", F.lit(True))
    fields = F.array_compact(
        F.array(
            *[
                F.when(~_comparable(f, "old_").eqNullSafe(_comparable(f, "")), f)
                for f in V.COMPARED_FIELDS
            ]
        )
    )
    joined = current.join(old, "id", "left").withColumn("changed_fields", F.when(F.col("_known"), fields))
    change = (
        F.when(F.col("_known").isNull(), "added")
        .when(F.size("changed_fields") > 0, "changed")
        .otherwise("unchanged")
    )
    shown = ["id", "ord", "name", "address", "place_id"]
    now = joined.select(change.alias("change"), *shown, "changed_fields")
    gone = previous.join(current.select("id"), "id", "left_anti").select(
        F.lit("removed").alias("change"), *shown, F.lit(None).cast("array<string>").alias("changed_fields")
    )
    return now.unionByName(gone)


def change_list(changes: DataFrame, change: str, limit: int = V.CHANGE_LIST_LIMIT) -> DataFrame:
    """The first ``limit`` records of one kind of change, in order."""
    return changes.where(F.col("change") == change).orderBy("ord", "id").limit(limit)


def change_overflow(changes: DataFrame, limit: int = V.CHANGE_LIST_LIMIT) -> DataFrame:
    """How many records of each kind a change list leaves out: (change, hidden)."""
    counts = changes.where(F.col("change") != "unchanged").groupBy("change").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("change", F.greatest(F.col("n") - limit, F.lit(0)).cast("bigint").alias("hidden"))


def verification_counts(places: DataFrame, by: str | None = None) -> DataFrame:
    """(confirmed, failed, unchecked) counts."""
    confirmed = is_confirmed(F.col("place_id"), F.col("verification"))
    failed = ~confirmed & is_checked_unverified(F.col("verification"))
    return places.groupBy(*([by] if by else [])).agg(
        F.count_if(confirmed).alias("confirmed"),
        F.count_if(failed).alias("failed"),
        F.count_if(~confirmed & ~failed).alias("unchecked"),
    )


def operational_counts(places: DataFrame) -> DataFrame:
    """What a build of confirmed places would serve, as one row."""
    confirmed = is_confirmed(F.col("place_id"), F.col("verification"))
    totals = places.agg(
        F.count_if(confirmed).alias("eligible"), F.count_if(~confirmed).alias("excluded")
    )
    merged = dedup.confirmed_counts(places).select(
        F.col("groups").alias("duplicate_groups"), F.col("removed").alias("duplicates_removed"), F.col("kept").alias("final_candidates")
    )
    return _side_by_side(totals, merged)


def _side_by_side(*one_row: DataFrame) -> DataFrame:
    """One-row tables as one row."""
    result = one_row[0].withColumn("_one", F.lit(1))
    for other in one_row[1:]:
        result = result.join(F.broadcast(other.withColumn("_one", F.lit(1))), "_one")
    return result.drop("_one")


def _long(section: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """Two one-row tables as rows (section, metric, before, after)."""
    def melt(row: DataFrame, value: str) -> DataFrame:
        pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias(value)) for c in row.columns]
        return row.select(F.inline(F.array(*pairs)))

    return (
        melt(before, "before")
        .join(melt(after, "after"), "metric")
        .select(F.lit(section).alias("section"), "metric", "before", "after")
    )


def update_report(previous: DataFrame, current: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Numbers of an update report: (section, metric, before, after).

    The change counts stand under ``after``; ``before`` is NULL there.
    """
    changes = diff(previous, current) if changes is None else changes
    kinds = ("added", "removed", "changed", "unchanged")
    counts = changes.agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds])
    change_rows = counts.select(
        F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("after")) for k in kinds]))
    ).select(F.lit("changes").alias("section"), "metric", F.lit(None).cast("bigint").alias("before"), "after")
    total = lambda df: df.agg(F.count(F.lit(1)).alias("total"))
    return (
        _long("totals", total(previous), total(current))
        .unionByName(change_rows)
        .unionByName(_long("verification", verification_counts(previous), verification_counts(current)))
        .unionByName(_long("operational", operational_counts(previous), operational_counts(current)))
    )
