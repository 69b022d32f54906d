"""Schemas of the canonical places table and of the landed inputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MENUS = "array<struct<name:string,price:double>>"

# JSON form of a place, field names as the public files have them.
PLACE_JSON = (
    "id string, name string, category string, province string, district string, phone string,"
    " address string, latitude double, longitude double, menus array<struct<name:string,price:double>>,"
    " kakaoPlaceId string, kakaoPlaceUrl string,"
    " placeVerification struct<provider:string,status:string,matchedBy:string,distanceMeters:double,checkedAt:string>,"
    " geocoding string"
)

PLACE = (
    "ord bigint, id string, name string, category string, province string, district string, phone string,"
    " address string, latitude double, longitude double, menus array<struct<name:string,price:bigint>>,"
    " place_id string, place_url string,"
    " verification struct<provider:string,status:string,matched_by:string,distance_meters:double,checked_at:string>"
)

LEDGER = "id string, policy_version int, updated_at string"


def from_json_place(place: Column) -> list[Column]:
    """Canonical columns of a place struct in JSON form."""
    check = place["placeVerification"]
    blank = lambda c: F.nullif(c, F.lit(""))
    menus = F.transform(
        place["menus"],
        lambda m: F.struct(m["name"].alias("name"), F.floor(m["price"] + 0.5).cast("bigint").alias("price")),
    )
    return [
        *[place[c].alias(c) for c in ("id", "name", "category", "province", "district")],
        blank(place["phone"]).alias("phone"),
        *[place[c].alias(c) for c in ("address", "latitude", "longitude")],
        menus.alias("menus"),
        blank(place["kakaoPlaceId"]).alias("place_id"),
        blank(place["kakaoPlaceUrl"]).alias("place_url"),
        F.when(
            check.isNotNull(),
            F.struct(
                check["provider"].alias("provider"),
                check["status"].alias("status"),
                check["matchedBy"].alias("matched_by"),
                check["distanceMeters"].alias("distance_meters"),
                check["checkedAt"].alias("checked_at"),
            ),
        ).alias("verification"),
    ]


def to_json_place() -> list[Column]:
    """JSON form of a canonical place."""
    check = F.col("verification")
    return [
        *[F.col(c) for c in ("id", "name", "category", "province", "district", "phone", "address", "latitude", "longitude", "menus")],
        F.col("place_id").alias("kakaoPlaceId"),
        F.col("place_url").alias("kakaoPlaceUrl"),
        F.when(
            check.isNotNull(),
            F.struct(
                check["provider"].alias("provider"),
                check["status"].alias("status"),
                check["matched_by"].alias("matchedBy"),
                check["distance_meters"].alias("distanceMeters"),
                check["checked_at"].alias("checkedAt"),
            ),
        ).alias("placeVerification"),
    ]
