"""Matching places with the results of external place searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import geo, text
from ..functions.verification import is_confirmed
from .ranking import distributed_row_number
from .skew import spread


_HIT_COLUMNS = (
    "restaurant_id", "hit_id", "hit_ord", "place_name", "distance",
    "category_group_code", "road_address_name", "address_name", "place_url",
)


def judged_hits(
    places: DataFrame,
    hits: DataFrame,
    max_meters: float = V.PLACE_HIT_MAX_METERS,
    name_only_meters: float = V.PLACE_HIT_NAME_ONLY_METERS,
) -> DataFrame:
    """Every hit of a place of ``places``, and whether it ``fits``.

    (id, hit_id, hit_ord, place_url, distance_meters, exact, fits) beside the
    other columns of ``hits``. A hit fits if it has the place's name, is food
    or cafe, and has the exact address or lies within ``name_only_meters``.
    Neither side is shuffled for more than the join on the id, so ``hits`` may
    be a stream.
    """
    usable = hits.select(
        F.col("restaurant_id").alias("id"),
        *[c for c in hits.columns if c not in _HIT_COLUMNS],
        "hit_id",
        "hit_ord",
        "place_url",
        "category_group_code",
        F.col("distance").try_cast("double").alias("distance_meters"),
        text.name_key(text.clean_text(F.col("place_name"))).alias("hit_name"),
        text.home_address_key(text.clean_text(F.col("road_address_name"))).alias("hit_road"),
        text.home_address_key(text.clean_text(F.col("address_name"))).alias("hit_address"),
    )
    wanted = places.select(
        "id",
        text.name_key(text.clean_text(F.col("name"))).alias("own_name"),
        text.home_address_key(text.clean_text(F.col("address"))).alias("own_address"),
    )
    exact = (F.length("own_address") > 0) & (
        (F.col("hit_road") == F.col("own_address")) | (F.col("hit_address") == F.col("own_address"))
    )
    fits = (
        (F.col("distance_meters") <= max_meters)
        & F.col("category_group_code").isin(*V.FOOD_GROUP_CODES)
        & (F.col("hit_name") == F.col("own_name"))
        & (F.col("exact") | (F.col("distance_meters") <= name_only_meters))
    )
    judged = usable.join(wanted, ["id"], "inner").withColumn("exact", F.coalesce(exact, F.lit(False)))
    own = ("category_group_code", "hit_name", "hit_road", "hit_address", "own_name", "own_address")
    return judged.withColumn("fits", F.coalesce(fits, F.lit(False))).drop(*own)


def best_place_hits(
    places: DataFrame,
    hits: DataFrame,
    max_meters: float = V.PLACE_HIT_MAX_METERS,
    name_only_meters: float = V.PLACE_HIT_NAME_ONLY_METERS,
) -> DataFrame:
    """Best hit per place: same name, food or cafe, near enough.

    A hit needs the exact address, or to lie within ``name_only_meters``. Exact
    addresses win, then the distance, then the hit order. ``hits``:
    restaurant_id, hit_id, hit_ord, place_name, distance (text metres),
    category_group_code, road_address_name, address_name, place_url.
    """
    meters = F.col("distance").try_cast("double")
    usable = hits.select(
        F.col("restaurant_id").alias("id"),
        "hit_id",
        "hit_ord",
        "place_url",
        "category_group_code",
        meters.alias("distance_meters"),
        text.name_key(text.clean_text(F.col("place_name"))).alias("hit_name"),
        text.home_address_key(text.clean_text(F.col("road_address_name"))).alias("hit_road"),
        text.home_address_key(text.clean_text(F.col("address_name"))).alias("hit_address"),
    ).where(
        (F.col("distance_meters") <= max_meters)
        & F.col("category_group_code").isin(*V.FOOD_GROUP_CODES)
    )
    wanted = places.select(
        "id",
        text.name_key(text.clean_text(F.col("name"))).alias("own_name"),
        text.home_address_key(text.clean_text(F.col("address"))).alias("own_address"),
    )
    exact = (F.length("own_address") > 0) & (
        (F.col("hit_road") == F.col("own_address")) | (F.col("hit_address") == F.col("own_address"))
    )
    joined = (
        usable.join(wanted, ["id"], "inner")
        .withColumn("exact", exact)
        .where((F.col("hit_name") == F.col("own_name")) & (F.col("exact") | (F.col("distance_meters") <= name_only_meters)))
    )
    best = F.min(F.struct((~F.col("exact")).alias("inexact"), "distance_meters", "hit_ord", "hit_id", "place_url"))
    return (
        joined.groupBy("id")
        .agg(best.alias("best"))
        .select(
            "id",
            F.col("best.hit_id").alias("hit_id"),
            F.col("best.place_url").alias("hit_url"),
            F.when(F.col("best.inexact"), V.MATCHED_BY_COORDINATES).otherwise(V.MATCHED_BY_ADDRESS).alias("matched_by"),
            F.col("best.distance_meters").alias("distance_meters"),
        )
    )


def apply_matches(places: DataFrame, best: DataFrame, checked_at: str) -> DataFrame:
    """Places that were searched, confirmed by their best hit or unverified.

    Pass only the searched places; the others keep what they have.
    """
    found = F.col("_hit_id").isNotNull()
    hit = best.select(
        "id", F.col("hit_id").alias("_hit_id"), F.col("hit_url").alias("_hit_url"),
        F.col("matched_by").alias("_by"), F.col("distance_meters").alias("_meters"),
    )
    link = F.coalesce(
        text.blank_to_null(text.secure_url(F.col("_hit_url"))), F.concat(F.lit(V.MAP_LINK_PREFIX), "_hit_id")
    )
    check = F.struct(
        F.lit(V.VERIFICATION_PROVIDER).alias("provider"),
        F.when(found, V.STATUS_CONFIRMED).otherwise(V.STATUS_UNVERIFIED).alias("status"),
        F.when(found, F.col("_by")).alias("matched_by"),
        F.when(found, F.col("_meters")).alias("distance_meters"),
        F.lit(checked_at).alias("checked_at"),
    )
    return (
        places.join(hit, "id", "left")
        .withColumns(
            {
                "place_id": F.when(found, F.col("_hit_id")).otherwise(F.col("place_id")),
                "place_url": F.when(found, link).otherwise(F.col("place_url")),
                "verification": check,
            }
        )
        .select(*places.columns)
    )


def pending(places: DataFrame, ledger: DataFrame, policy_version: int = V.MATCH_POLICY_VERSION, limit: int | None = None) -> DataFrame:
    """Places not yet processed under the current policy, in order."""
    done = ledger.where(F.col("policy_version") == policy_version).select("id")
    rows = places.join(done, "id", "left_anti")
    return rows if limit is None else rows.orderBy("ord").limit(limit)


def ledger_rows(processed: DataFrame, policy_version: int = V.MATCH_POLICY_VERSION, updated_at: str | None = None) -> DataFrame:
    """Ledger entries to append after ``processed`` places were handled."""
    return processed.select(
        "id", F.lit(policy_version).alias("policy_version"), F.lit(updated_at).alias("updated_at")
    )


def search_plan(places: DataFrame) -> DataFrame:
    """Queries to send for each place, in the order to try them."""
    queries = text.search_queries(F.col("name"), F.col("province"))
    return places.select("id", F.posexplode(queries).alias("step", "search_text"))


def evaluate_local_hits(
    places: DataFrame,
    hits: DataFrame,
    max_meters: float = V.LOCAL_HIT_MAX_METERS,
    numeric_entities: bool = True,
) -> DataFrame:
    """Every local-search hit with the signals that speak for its place.

    ``hits``: restaurant_id, hit_ord, title (with markup), category, address,
    road_address, link, mapx, mapy.
    """
    clean = lambda c: text.clean_text(text.strip_markup(F.col(c), numeric_entities))
    # Cleaning is nearly all of the work.
    hits, places = spread(hits), spread(places.select("id", "name", "address", "latitude", "longitude"))
    cleaned = hits.select(
        F.col("restaurant_id").alias("id"),
        "hit_ord",
        clean("title").alias("hit_name"),
        clean("category").alias("hit_category"),
        clean("address").alias("hit_address"),
        clean("road_address").alias("hit_road_address"),
        "link",
        geo.parse_coordinate(F.col("mapy"), 90.0).alias("hit_latitude"),
        geo.parse_coordinate(F.col("mapx"), 180.0).alias("hit_longitude"),
        *[
            expression.alias(f"{column}_{part}")
            for column in ("address", "road_address")
            for part, expression in (
                ("key", text.region_address_key(text.clean_text(F.col(column)))),
                ("core", text.road_core(text.clean_text(F.col(column)))),
            )
        ],
    )
    own = places.select(
        "id",
        text.name_key(text.clean_text(F.col("name"))).alias("own_name"),
        text.region_address_key(text.clean_text(F.col("address"))).alias("own_key"),
        text.road_core(text.clean_text(F.col("address"))).alias("own_core"),
        F.col("latitude").alias("own_latitude"),
        F.col("longitude").alias("own_longitude"),
    )
    cleaned = cleaned.withColumn("hit_key", text.name_key(F.col("hit_name")))
    joined = cleaned.join(own, ["id"])
    meters = geo.distance_meters(
        F.col("own_latitude"), F.col("own_longitude"), F.col("hit_latitude"), F.col("hit_longitude")
    )
    same = lambda column: text.same_address(
        F.col("own_key"), F.col("own_core"), F.col(f"{column}_key"), F.col(f"{column}_core")
    )
    flagged = joined.withColumns(
        {
            "distance_meters": F.floor(meters + 0.5).cast("bigint"),
            "exact_name": F.col("hit_key") == F.col("own_name"),
            "address_match": same("road_address") | same("address"),
        }
    ).withColumn("coordinates_match", F.coalesce(F.col("distance_meters") <= max_meters, F.lit(False)))
    return flagged.withColumn(
        "strict_match", F.col("exact_name") & F.col("address_match") & F.col("coordinates_match")
    ).select(
        "id", "hit_ord", "hit_name", "hit_category", "hit_address", "hit_road_address", "link",
        "hit_latitude", "hit_longitude", "distance_meters",
        "exact_name", "address_match", "coordinates_match", "strict_match",
    )


def _hit_order() -> list[Column]:
    return [
        F.col("strict_match").desc(), F.col("exact_name").desc(), F.col("address_match").desc(),
        F.col("distance_meters").asc_nulls_last(), F.col("hit_ord").asc(),
    ]


def rank_local_hits(evaluated: DataFrame) -> DataFrame:
    """Hits with their ``rank`` per place, best first."""
    return distributed_row_number(evaluated, ["id"], _hit_order(), "rank")


def best_local_hits(evaluated: DataFrame) -> DataFrame:
    """Best strict hit per place."""
    best = F.min(
        F.struct(
            F.col("distance_meters").alias("distance_meters"), "hit_ord", "hit_name", "link"
        )
    )
    return (
        evaluated.where("strict_match").groupBy("id").agg(best.alias("best")).select("id", "best.*")
    )


def sample_status(samples: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Outcome of the cross-check per sampled place.

    (id, status, hit_count, probable_rename): a probable rename has no strict
    hit but one of another name at the same address and point.
    """
    renamed = ~F.col("exact_name") & F.col("address_match") & F.col("coordinates_match")
    per_place = evaluated.groupBy("id").agg(
        F.bool_or("strict_match").alias("strict"),
        F.bool_or(renamed).alias("renamed"),
        F.count(F.lit(1)).alias("hits"),
    )
    status = (
        F.when(F.col("strict"), "strict-match").when(F.col("hits") > 0, "no-strict-match").otherwise("no-result")
    )
    return samples.join(per_place, "id", "left").select(
        *[c for c in samples.columns if c in ("id", "source")],
        status.alias("status"),
        F.coalesce("hits", F.lit(0)).cast("bigint").alias("hit_count"),
        F.coalesce(~F.col("strict") & F.col("renamed"), F.lit(False)).alias("probable_rename"),
    )


def cross_check_summary(eligible: DataFrame, statuses: DataFrame, by: str | None = None) -> DataFrame:
    """Cross-check totals, per ``by`` column if given."""
    count = lambda value: F.count_if(F.col("status") == value)
    keys = [by] if by else []
    totals = eligible.groupBy(*keys).agg(F.count(F.lit(1)).alias("eligible_count"))
    sums = statuses.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        count("strict-match").alias("strict_match_count"),
        count("no-strict-match").alias("no_strict_match_count"),
        count("no-result").alias("no_result_count"),
        F.count_if("probable_rename").alias("probable_rename_count"),
    )
    if by:
        return totals.join(sums, by, "left")
    # Two one-row tables side by side.
    return totals.withColumn("_one", F.lit(1)).join(sums.withColumn("_one", F.lit(1)), "_one").drop("_one")


def unconfirmed(places: DataFrame) -> DataFrame:
    """Places a cross-check may sample from."""
    return places.where(~is_confirmed(F.col("place_id"), F.col("verification")))
