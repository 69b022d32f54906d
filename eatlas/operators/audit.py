"""Data-quality audit of the places table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import menus, text
from ..functions.verification import has_place_id, is_checked_unverified, is_confirmed
from . import dedup
from .skew import computed_once, materialize
from .snapshot import _side_by_side


def reference_columns() -> list[Column]:
    """How reports refer to a place."""
    return [F.col(c) for c in ("id", "name", "address", "category", "place_id")]


def count_by(df: DataFrame, key: Column, name: str) -> DataFrame:
    """(name, count), most frequent first, then by key."""
    return (
        df.groupBy(key.alias(name))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.collate(name, "UNICODE"))
    )


def duplicate_keys(df: DataFrame, key: Column) -> DataFrame:
    """Keys more than one row has: (key, count), most frequent first."""
    keyed = df.select(key.alias("key")).where(F.length("key") > 0)
    return (
        keyed.groupBy("key")
        .agg(F.count(F.lit(1)).alias("count"))
        .where(F.col("count") > 1)
        .orderBy(F.col("count").desc(), F.collate("key", "UNICODE"))
    )


def duplicate_key_members(df: DataFrame, key: Column, columns: list[Column], spread: str = "ord") -> DataFrame:
    """The rows behind ``duplicate_keys``, one row each (groups can be huge)."""
    keyed = df.select(key.alias("key"), F.col(spread).alias("_spread"), *columns).where(F.length("key") > 0)
    groups = (
        keyed.groupBy("key").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)
    )
    return keyed.join(groups, ["key"], "inner").drop("_spread")


def name_address(df_name: str = "name", df_address: str = "address") -> Column:
    """Key of equal name and address, '' when one of them is empty."""
    def joined(name: Column, address: Column) -> Column:
        both = (F.length(name) > 0) & (F.length(address) > 0)
        return F.when(both, F.concat_ws("|", name, address)).otherwise("")

    name, address = text.name_key(F.col(df_name)), text.address_key(F.col(df_address))
    return text.bound(F.struct(name.alias("n"), address.alias("a")), lambda k: joined(k["n"], k["a"]))


def side_menus(places: DataFrame, max_price: float = V.SIDE_MENU_MAX_PRICE) -> DataFrame:
    """Cheap menus that look like side charges, with the reason."""
    items = places.select(*reference_columns(), F.explode("menus").alias("m"))
    return (
        items.select(
            *reference_columns(),
            text.trim_space(F.col("m.name")).alias("menu_name"),
            F.col("m.price").alias("menu_price"),
            menus.side_menu_reason(F.col("m.name"), F.col("m.price"), max_price).alias("reason"),
        )
        .where(F.col("reason").isNotNull())
    )


def category_reviews(places: DataFrame) -> DataFrame:
    """Places whose words suggest another category, with the evidence."""
    rules = V.AUDIT_CATEGORY_RULES
    words = menus.audit_text(F.col("name"), F.col("menus"))
    texts = computed_once(places.select(*reference_columns(), "menus"), _text=words).drop("menus")
    suggested = computed_once(texts, suggested_category=menus.first_match(F.col("_text"), rules))
    reviewed = suggested.where(
        F.col("suggested_category").isNotNull() & ~F.col("category").eqNullSafe(F.col("suggested_category"))
    )
    return reviewed.select(
        *reference_columns(),
        "suggested_category",
        menus.first_evidence(F.col("_text"), rules).alias("evidence"),
    )


def category_changes(reviews: DataFrame) -> DataFrame:
    """(change, count) of suggested category changes."""
    return count_by(reviews, F.concat_ws(" -> ", "category", "suggested_category"), "change")


def groups_by_reason(groups: DataFrame) -> DataFrame:
    """(reason, count) of duplicate groups; a group counts for each reason."""
    return count_by(groups.select(F.explode("reasons").alias("reason")), F.col("reason"), "reason")


def summary(places: DataFrame, max_side_price: float = V.SIDE_MENU_MAX_PRICE) -> DataFrame:
    """All audit numbers of one places table as one row."""
    check, place_id = F.col("verification"), F.col("place_id")
    confirmed, with_id = is_confirmed(place_id, check), has_place_id(place_id)
    total = F.count(F.lit(1))
    counts = places.agg(
        total.alias("total_places"),
        F.count_if(with_id).alias("with_place_id"),
        F.count_if(confirmed).alias("confirmed"),
        F.count_if(~confirmed).alias("unconfirmed"),
        F.when(total == 0, 0.0).otherwise(F.round(F.count_if(confirmed) * 100 / total, 1)).alias("confirmed_rate"),
        F.count_if(with_id & check.isNull()).alias("legacy_place_ids"),
        F.count_if(is_checked_unverified(check)).alias("checked_unverified"),
        F.count_if(check.isNull()).alias("unchecked"),
    )
    sums = lambda df, prefix: df.agg(
        F.count(F.lit(1)).alias(f"{prefix}_groups"), F.coalesce(F.sum("count"), F.lit(0)).alias(f"{prefix}_records")
    )
    by_place = sums(duplicate_keys(places, text.trim_space(F.coalesce(place_id, F.lit("")))), "duplicate_place_id")
    by_address = sums(duplicate_keys(places, name_address()), "duplicate_name_address")
    merged = _merge_counts(dedup.resolve(places), "deduplicated", "dedup_groups", "removed_duplicates")
    verified = dedup.confirmed_counts(places).select(
        F.col("kept").alias("verified_candidates"), F.col("removed").alias("verified_removed")
    )
    sides = side_menus(places, max_side_price).agg(
        F.count(F.lit(1)).alias("side_menu_entries"), F.count_distinct("id").alias("places_with_side_menus")
    )
    reviews = category_reviews(places).agg(F.count(F.lit(1)).alias("category_reviews"))
    return _side_by_side(counts, by_place, by_address, merged, verified, sides, reviews)


def summaries(places: DataFrame, by: str = "source", max_side_price: float = V.SIDE_MENU_MAX_PRICE) -> DataFrame:
    """:func:`summary` of every value of ``by``, one row each, whatever their number.

    Duplicates are looked for within a value; ``ord`` must be unique over all.
    Places are read once: what the numbers go by is stored as one narrow row a
    place, with its keys and flags.
    """
    check, place_id = F.col("verification"), F.col("place_id")
    confirmed, with_id = is_confirmed(place_id, check), has_place_id(place_id)
    suggested = menus.first_match(F.col("_text"), V.AUDIT_CATEGORY_RULES)
    texts = computed_once(places, _text=menus.audit_text(F.col("name"), F.col("menus")))
    judged = computed_once(texts, _suggested=suggested)
    is_side = lambda m: menus.side_menu_reason(m["name"], m["price"], max_side_price).isNotNull()
    flags = materialize(
        judged.select(
            by,
            F.when(confirmed, place_id).alias("_sure_id"),
            with_id.alias("_with_id"),
            confirmed.alias("_confirmed"),
            (with_id & check.isNull()).alias("_legacy"),
            is_checked_unverified(check).alias("_failed"),
            check.isNull().alias("_unchecked"),
            text.trim_space(F.coalesce(place_id, F.lit(""))).alias("_place_key"),
            name_address().alias("_address_key"),
            F.size(F.filter(F.coalesce("menus", F.array().cast(places.schema["menus"].dataType)), is_side)).cast("bigint").alias("_sides"),
            (F.col("_suggested").isNotNull() & ~F.col("category").eqNullSafe(F.col("_suggested"))).alias("_review"),
        )
    )
    total = F.count(F.lit(1))
    counts = flags.groupBy(by).agg(
        total.alias("total_places"),
        F.count_if("_with_id").alias("with_place_id"),
        F.count_if("_confirmed").alias("confirmed"),
        F.count_if(~F.col("_confirmed")).alias("unconfirmed"),
        F.round(F.count_if("_confirmed") * 100 / total, 1).alias("confirmed_rate"),
        F.count_if("_legacy").alias("legacy_place_ids"),
        F.count_if("_failed").alias("checked_unverified"),
        F.count_if("_unchecked").alias("unchecked"),
        F.sum("_sides").alias("side_menu_entries"),
        F.count_if(F.col("_sides") > 0).alias("places_with_side_menus"),
        F.count_if("_review").alias("category_reviews"),
    )

    def repeated(key: str, prefix: str) -> DataFrame:
        groups = flags.where(F.length(key) > 0).groupBy(by, key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        return groups.groupBy(by).agg(F.count(F.lit(1)).alias(f"{prefix}_groups"), F.sum("_n").alias(f"{prefix}_records"))

    by_id = flags.where("_sure_id is not null").groupBy(by, "_sure_id").agg(F.count(F.lit(1)).alias("_n"))
    verified = by_id.groupBy(by).agg(F.count(F.lit(1)).alias("verified_candidates"), F.sum(F.col("_n") - 1).alias("verified_removed"))
    resolved = dedup.resolve(places, scope=by).join(places.select("ord", by), "ord")
    first = F.col("ord") == F.col("cluster")
    merged = resolved.groupBy(by).agg(
        F.count_if(first).alias("deduplicated"),
        F.count_if(first & (F.col("cluster_size") > 1)).alias("dedup_groups"),
        F.count_if(~first).alias("removed_duplicates"),
    )
    for part in (repeated("_place_key", "duplicate_place_id"), repeated("_address_key", "duplicate_name_address"), verified, merged):
        added = [c for c in part.columns if c != by]
        same = F.col(f"a.{by}").eqNullSafe(F.col(f"b.{by}"))
        counts = counts.alias("a").join(part.alias("b"), same, "left").select("a.*", *[F.coalesce(F.col(f"b.{c}"), F.lit(0)).alias(c) for c in added])
    return counts


def _merge_counts(resolved: DataFrame, kept: str, groups: str, removed: str) -> DataFrame:
    first = F.col("ord") == F.col("cluster")
    return resolved.agg(
        F.count_if(first).alias(kept),
        F.count_if(first & (F.col("cluster_size") > 1)).alias(groups),
        F.count_if(~first).alias(removed),
    )
