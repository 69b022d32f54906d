"""Raw source rows to canonical places, and refreshing a snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import geo, menus, rules, text
from .skew import computed_once, materialize, spread
from .snapshot import last_by_id

# Menu rows of one place that one task concatenates at a time.
_CHUNK_ROWS = 4096
# Longest word of the menu rules; longer texts keep this much at each end.
_EDGE = max(len(word) for _, pattern in V.MENU_KEY_RULES for word in pattern.split("|"))


def _price(raw: DataFrame, column: str, fix: Callable[[Column], Column]) -> Column:
    """Price from a column of numbers as they are, or of texts."""
    value = F.col(f"`{column}`")
    return text.parse_price(value, numeric=True) if text.is_number(raw, column) else text.parse_price(fix(value))


# --- Source A: one wide row per place ---------------------------------------------


def adapt_wide(raw: DataFrame, clean: bool = True) -> DataFrame:
    """Wide rows (up to four menu columns) to places without id or position.

    Rows without category, region, name, address or any priced menu are left
    out. ``clean=False`` skips normalisation for text that already had it.
    """
    fix = text.clean_text if clean else (lambda c: text.trim_space(F.coalesce(c, F.lit(""))))
    texts = {name: fix(F.col(f"`{column}`")) for name, column in V.WIDE_COLUMNS.items()}
    numbers = range(1, V.WIDE_MENU_COUNT + 1)
    cleaned = spread(raw).select(
        "ord",
        *[expression.alias(name) for name, expression in texts.items()],
        *[fix(F.col(f"`{V.WIDE_MENU_NAME.format(i)}`")).alias(f"_menu{i}") for i in numbers],
        *[_price(raw, V.WIDE_MENU_PRICE.format(i), fix).alias(f"_price{i}") for i in numbers],
    )
    slots = F.array(
        *[
            F.struct(F.col(f"_menu{i}").alias("name"), F.col(f"_price{i}").alias("price"))
            for i in numbers
        ]
    )
    named = cleaned.select(
        "ord",
        text.source_category(F.col("category")).alias("category"),
        *[text.blank_to_null(F.col(c)).alias(c) for c in ("province", "district", "name", "phone", "address")],
        slots.alias("_slots"),
    )
    complete = F.lit(True)
    for column in ("category", "province", "district", "name", "address"):
        complete = complete & F.col(column).isNotNull()
    priced = F.filter("_slots", lambda m: (F.length(m["name"]) > 0) & m["price"].isNotNull())
    keyed = computed_once(named.where(complete), _keyed=menus.keyed_menus(priced))
    adapted = keyed.where(F.size("_keyed") > 0).withColumn("menus", menus.first_menus(F.col("_keyed")))
    return adapted.drop("_slots", "_keyed")


def with_source_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "source_key", text.source_key(F.col("province"), F.col("district"), F.col("name"), F.col("address"))
    )


def last_per_key(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """The last row of each key, at the position of the first."""
    others = [c for c in rows.columns if c not in (key, order)]
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_last"), F.min(order).alias(order))
    return picked.select(*[F.col(c) if c in (key, order) else F.col(f"_last.{c}").alias(c) for c in rows.columns])


def _tier_keys(rows: DataFrame) -> DataFrame:
    """(ord, tier, key): match keys of every row, the strongest is tier 1."""
    columns = ("province", "district", "name", "address", "phone")
    parts = computed_once(
        spread(rows.select("ord", *columns)), parts=F.struct(*[text.name_key(F.col(c)).alias(c) for c in columns])
    ).select("ord", F.length(F.coalesce("phone", F.lit(""))).alias("_phone"), "parts.*")
    keys = (
        F.concat_ws("|", "province", "district", "name", "address"),
        F.concat_ws("|", "name", "address"),
        F.when(F.col("_phone") > 0, F.concat_ws("|", "province", "district", "name", "phone")),
        F.concat_ws("|", "province", "district", "name"),
    )
    tiers = [F.struct(F.lit(tier).alias("tier"), key.alias("key")) for tier, key in enumerate(keys, start=1)]
    return parts.select("ord", F.inline(F.array(*tiers))).where(F.col("key").isNotNull())


def find_existing(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing record of each row: (ord, existing_ord, tier).

    Four keys are tried in turn; a key shared by several existing records
    finds nothing. One shuffle serves all four: both sides are keyed by
    (tier, key), and the strongest hit is kept.
    """
    best = F.min(F.struct("tier", "existing_ord")).alias("best")
    return _tier_hits(rows, existing).groupBy("ord").agg(best).select("ord", "best.existing_ord", "best.tier")


def _tier_hits(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """(ord, tier, existing_ord): the one existing record that has a row's key, tier by tier."""
    known = (
        _tier_keys(existing)
        .groupBy("tier", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("existing_ord"))
        .where(F.col("n") == 1)
        .drop("n")
    )
    return _tier_keys(rows).join(known, ["tier", "key"], "inner").select("ord", "tier", "existing_ord")


def reused_records(found: DataFrame) -> DataFrame:
    """Existing records that several rows continue: (existing_ord, claims, first_ord, best_tier).

    ``found`` comes from :func:`find_existing`, which lets one old id live on in
    any number of new records; this is the check for it.
    """
    claims = found.groupBy("existing_ord").agg(
        F.count(F.lit(1)).alias("claims"), F.min("ord").alias("first_ord"), F.min("tier").alias("best_tier")
    )
    return claims.where(F.col("claims") > 1)


def continue_one_to_one(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """:func:`find_existing` with every existing record continued once at most: (ord, existing_ord, tier).

    Stronger keys go first: at each tier, the rows and records that are still
    free meet, and of the rows that claim one record the first has it; the
    others try their weaker keys. A key of a tier names one record only, so
    that is the same as going through all claims by tier and position one by
    one, in as many steps as there are tiers.
    """
    claims = materialize(_tier_hits(rows, existing))
    taken = claims.limit(0)
    for tier in (1, 2, 3, 4):
        free = claims.where(F.col("tier") == tier).join(taken.select("ord"), "ord", "left_anti")
        free = free.join(taken.select("existing_ord"), "existing_ord", "left_anti")
        won = free.groupBy("existing_ord").agg(F.min("ord").alias("ord")).withColumn("tier", F.lit(tier))
        taken = materialize(taken.unionByName(won.select(*taken.columns)))
    return taken.select("ord", "existing_ord", "tier")


_LOCATION = ("latitude", "longitude", "place_id", "place_url", "verification")


def locate(rows: DataFrame, existing: DataFrame, geocode_cache: DataFrame) -> DataFrame:
    """Rows with id and position from the existing record or the geocode cache.

    Adds ``origin``: preserved, geocoded or skipped (no position known). An
    existing record lends all its location fields, the cache only serves rows
    without one. ``rows`` are unique per source key (``last_per_key``);
    ``geocode_cache``: source_key and the location columns.
    """
    keyed = materialize(with_source_key(rows))
    hits = materialize(find_existing(keyed, existing).select("ord", "existing_ord"))
    old = existing.select(
        F.col("ord").alias("existing_ord"), F.col("id").alias("_id"), *[F.col(c).alias(f"_old_{c}") for c in _LOCATION]
    )
    cache = geocode_cache.select("source_key", F.lit(True).alias("_cached"), *[F.col(c).alias(f"_new_{c}") for c in _LOCATION])
    # Many rows may continue one record; source keys are unique on both sides.
    lent = hits.join(old, ["existing_ord"], "inner")
    joined = keyed.join(lent, "ord", "left").join(cache, "source_key", "left")
    is_old = F.col("_id").isNotNull()
    origin = F.when(is_old, "preserved").when(F.col("_cached"), "geocoded").otherwise("skipped")
    return joined.withColumns(
        {
            "origin": origin,
            "id": F.coalesce("_id", text.record_id(F.col("source_key"))),
            **{c: F.when(is_old, F.col(f"_old_{c}")).otherwise(F.col(f"_new_{c}")) for c in _LOCATION},
        }
    ).select(*rows.columns, "source_key", "origin", "id", *_LOCATION)


# --- Source B: a place table and a menu table -------------------------------------


def adapt_menu_rows(raw: DataFrame, clean: bool = True) -> DataFrame:
    """Usable menu rows: (rid, ord, name, key, price, region)."""
    fix = text.clean_text if clean else (lambda c: text.trim_space(F.coalesce(c, F.lit(""))))
    cleaned = spread(raw).select(
        F.col("menu_ord").alias("ord"),
        *[fix(F.col(c)).alias(n) for c, n in (("RSTR_ID", "rid"), ("MENU_NM", "name"), ("RGN_NM", "region"))],
        _price(raw, "MENU_PRC", fix).alias("price"),
    )
    keyed = computed_once(
        cleaned,
        fields=F.struct(
            "ord", "rid", "name", "region",
            "price",
            text.name_key(F.col("name")).alias("key"),
        ),
    ).select("fields.*")
    return keyed.where((F.length("rid") > 0) & menus.is_priced_meal_key(F.col("key"), F.col("price")))


def menu_words(usable: DataFrame) -> DataFrame:
    """Text to look for menu words in, per place: (rid, menu_hits, menu_text).

    Words may span two neighbouring menus, so order matters; a place may have
    any number of menu rows. Each chunk of rows is joined and tested on its
    own; of a long chunk only the ends go on to the place's text, which is all
    that words across chunks can touch.
    """
    chunks = usable.groupBy("rid", F.floor(F.col("ord") / _CHUNK_ROWS).alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "key"))), lambda m: m["key"]), "").alias("words")
    )
    long_text = F.length("words") > 2 * _EDGE
    ends = F.concat(F.substring("words", 1, _EDGE), F.lit("\u0001"), F.col("words").substr(F.length("words") - _EDGE + 1, F.lit(_EDGE)))
    hits = [
        F.bool_or(long_text & rules.matches(F.col("words"), pattern)).alias(label)
        for label, pattern in V.MENU_KEY_RULES
    ]
    edges = F.array_sort(F.collect_list(F.struct("chunk", F.when(long_text, ends).otherwise(F.col("words")).alias("words"))))
    return chunks.groupBy("rid").agg(
        F.struct(*hits).alias("menu_hits"),
        F.array_join(F.transform(edges, lambda c: c["words"]), "").alias("menu_text"),
    )


def _inferred_category() -> Column:
    kind = text.name_key(F.concat_ws(" ", "business_type", "license_type"))
    chain = None
    for label, pattern in V.MENU_KEY_RULES:
        found = F.col("menu_hits")[label] | rules.matches(F.col("menu_text"), pattern)
        chain = F.when(found, label) if chain is None else chain.when(found, label)
    return F.coalesce(rules.first_match(kind, V.BUSINESS_TYPE_RULES), chain, F.lit(V.OTHER_SOURCE_CATEGORY))


def adapt_normalized(raw_places: DataFrame, raw_menus: DataFrame, clean: bool = True) -> DataFrame:
    """Place rows joined with their menu rows to canonical places.

    Places without id, name, address, plausible position or usable menu are
    left out. Menus count once per (name, price) and are ordered by price.
    """
    fix = text.clean_text if clean else (lambda c: text.trim_space(F.coalesce(c, F.lit(""))))
    # Three aggregations read the cleaned menus.
    usable = materialize(adapt_menu_rows(raw_menus, clean))
    firsts = usable.groupBy("rid", "key", "price").agg(F.min(F.struct("ord", "name")).alias("first"))
    nested = firsts.groupBy("rid").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("price", F.col("first.ord").alias("ord"), F.col("first.name").alias("name")))),
            lambda m: F.struct(m["name"].alias("name"), m["price"].alias("price")),
        ).alias("menus"),
    )
    regions = usable.groupBy("rid").agg(F.min(F.struct("ord", "region"))["region"].alias("region"))
    per_place = nested.join(regions, "rid").join(menu_words(usable), "rid")
    branch = fix(F.col("BRNCH_NM"))
    cleaned = spread(raw_places).select(
        "ord",
        fix(F.col("RSTR_ID")).alias("rid"),
        text.trim_space(F.concat_ws(" ", text.blank_to_null(fix(F.col("RSTR_NM"))), text.blank_to_null(branch))).alias("name"),
        text.blank_to_null(fix(F.col("ROAD_NM_ADDR"))).alias("road"),
        text.blank_to_null(fix(F.col("LOTNO_ADDR"))).alias("lot"),
        F.col("RSTR_LAT").try_cast("double").alias("latitude"),
        F.col("RSTR_LOT").try_cast("double").alias("longitude"),
        text.blank_to_null(fix(F.col("RSTR_RPRS_TELNO"))).alias("phone"),
        fix(F.col("BIZ_CRTFCT_BZSTAT_NM")).alias("business_type"),
        fix(F.col("BIZ_LCPMT_NM")).alias("license_type"),
    ).withColumn("address", F.coalesce("road", "lot"))
    kept = cleaned.where(
        (F.length("rid") > 0)
        & (F.length("name") > 0)
        & F.col("address").isNotNull()
        & geo.in_bounds(F.col("latitude"), F.col("longitude"))
    )
    return kept.join(per_place, "rid").select(
        "ord",
        F.concat(F.lit(V.HOME_ID_PREFIX), "rid").alias("id"),
        "name",
        _inferred_category().alias("category"),
        F.lit(V.HOME_PROVINCE).alias("province"),
        text.find_district(F.col("address"), F.col("lot"), F.col("region")).alias("district"),
        "phone",
        "address",
        "latitude",
        "longitude",
        "menus",
    )


def preserve_verification(places: DataFrame, existing: DataFrame) -> DataFrame:
    """Place id, link and verification of the last existing record by id."""
    kept = ("place_id", "place_url", "verification")
    old = last_by_id(existing.select("id", "ord", *kept), "_old_")
    own = lambda c: F.col(c) if c in places.columns else F.lit(None)
    joined = places.join(old, "id", "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_old_{c}"), own(c)) for c in kept}).drop(
        *[f"_old_{c}" for c in kept]
    )


def transform_counts(fetched: int, located: DataFrame) -> DataFrame:
    """Counters of a refresh: fetched, normalized, preserved, geocoded, excluded."""
    by = lambda value: F.count_if(F.col("origin") == value)
    return located.agg(
        F.lit(fetched).cast("bigint").alias("fetched"),
        F.count(F.lit(1)).alias("normalized"),
        by("preserved").alias("preserved"),
        by("geocoded").alias("geocoded"),
        by("skipped").alias("excluded"),
    )
