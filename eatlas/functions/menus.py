"""Menu predicates and rule-based classification of places.

``menus`` is always an array of struct<name, price>. Predicates on one menu
take a cleaned name, so they also serve flat menu tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .rules import first_evidence, first_match, matches
from .text import bound, collapse_spaces, name_key, trim_space


def is_meal_name(name: Column) -> Column:
    """Is a menu of this name a meal of its own?"""
    return is_meal_text(collapse_spaces(F.coalesce(name, F.lit(""))))


def is_meal_text(text: Column) -> Column:
    """The meal test on a name whose blanks are already collapsed."""
    side = (
        matches(text, V.ACCESSORY_MENU)
        | matches(text, V.VAGUE_OR_CHILD_MENU)
        | matches(text, V.STANDALONE_SAUCE)
    )
    drink_only = matches(text, V.BEVERAGE_OR_ALCOHOL) & ~matches(text, V.MEAL_SIGNAL)
    return (F.length(text) > 0) & ~side & ~drink_only


def is_priced_meal(name: Column, price: Column) -> Column:
    """Source-B meal test: sensible price, no add-on or drink word."""
    return bound(name_key(name), lambda key: is_priced_meal_key(key, price))


def is_priced_meal_key(key: Column, price: Column) -> Column:
    """The source-B meal test on a name key."""
    return (
        price.between(*V.MEAL_PRICE_RANGE)
        & (F.length(key) > 0)
        & ~matches(key, V.ADD_ON_OR_DRINK)
    )


def meal_menus(menus: Column) -> Column:
    return F.filter(menus, lambda m: is_meal_name(m["name"]))


def affordable(meals: Column, budget: Column) -> Column:
    """Meal menus within budget, order kept."""
    return F.filter(meals, lambda m: m["price"] <= budget)


def flagged_menus(menus: Column) -> Column:
    """Menus with what the classification needs to know about each."""
    texts = F.transform(
        menus,
        lambda m: F.struct(
            m["name"].alias("name"),
            m["price"].alias("price"),
            collapse_spaces(F.coalesce(m["name"], F.lit(""))).alias("text"),
        ),
    )
    return F.transform(
        texts,
        lambda m: F.struct(
            m["name"].alias("name"),
            m["price"].alias("price"),
            is_meal_text(m["text"]).alias("is_meal"),
            matches(m["text"], V.CAFE_MENU).alias("is_cafe_item"),
            matches(m["text"], V.SUBSTANTIAL_MEAL).alias("is_substantial"),
            matches(m["text"], V.RETAIL_PRODUCT).alias("is_retail_item"),
        ),
    )


def flag_count(flagged: Column, flag: str) -> Column:
    return F.size(F.filter(flagged, lambda m: m[flag]))


def keyed_menus(menus: Column) -> Column:
    """Menus with the key that tells them apart."""
    return F.transform(
        menus,
        lambda m: F.struct(
            m["name"].alias("name"),
            m["price"].alias("price"),
            F.concat_ws("|", name_key(m["name"]), m["price"].cast("string")).alias("key"),
        ),
    )


def first_menus(keyed: Column) -> Column:
    """First menu of each key, order kept; ``keyed`` is a stored column."""
    keys = F.transform(keyed, lambda m: m["key"])
    firsts = F.filter(keyed, lambda m, i: F.array_position(keys, m["key"]) == i + 1)
    return F.transform(firsts, lambda m: F.struct(m["name"].alias("name"), m["price"].alias("price")))


def _menu_count(menus: Column, pattern: str) -> Column:
    return F.size(F.filter(menus, lambda m: matches(collapse_spaces(m["name"]), pattern)))


def cafe_decision(name: Column, menu_count: Column, cafe_count: Column, meal_count: Column) -> Column:
    """Cafe test from the menu counts (all BIGINT or INT columns)."""
    text = collapse_spaces(name)
    meal_business = matches(text, V.SUBSTANTIAL_BUSINESS_NAME)
    mostly_cafe = (menu_count > 0) & (cafe_count * 2 >= menu_count)
    dominant = ~meal_business & mostly_cafe & (meal_count * 4 <= menu_count)
    return (
        F.when(matches(text, V.BAKERY_NAME), False)
        .when(dominant, True)
        .when(meal_business | (meal_count > 0), False)
        .when(matches(text, V.CAFE_NAME), True)
        .otherwise(mostly_cafe)
    )


def is_cafe(name: Column, menus: Column) -> Column:
    return cafe_decision(
        name,
        F.size(menus),
        _menu_count(menus, V.CAFE_MENU),
        _menu_count(menus, V.SUBSTANTIAL_MEAL),
    )


def retail_decision(name: Column, menu_count: Column, retail_count: Column) -> Column:
    named = matches(collapse_spaces(name), V.NON_RESTAURANT_BUSINESS)
    return named | ((menu_count > 0) & (retail_count * 2 >= menu_count))


def is_retail(name: Column, menus: Column) -> Column:
    return retail_decision(name, F.size(menus), _menu_count(menus, V.RETAIL_PRODUCT))


def menu_text(menus: Column) -> Column:
    return collapse_spaces(F.array_join(F.transform(menus, lambda m: F.coalesce(m["name"], F.lit(""))), " "))


def curated_category(place_id: Column) -> Column:
    choice = None
    for key, label in V.CURATED_CATEGORIES.items():
        choice = F.when(place_id == key, label) if choice is None else choice.when(place_id == key, label)
    return choice


def display_category(category: Column, name: Column, menus: Column, place_id: Column) -> Column:
    """Category shown to users, NULL when a place fits none."""
    specific = F.when(category != V.OTHER_SOURCE_CATEGORY, category)
    return F.coalesce(
        curated_category(place_id),
        specific,
        first_match(collapse_spaces(name), V.BUSINESS_NAME_RULES),
        first_match(menu_text(menus), V.MENU_TEXT_RULES),
    )


def audit_text(name: Column, menus: Column) -> Column:
    names = F.array_join(F.transform(menus, lambda m: F.coalesce(m["name"], F.lit(""))), " ")
    return trim_space(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(names, F.lit(""))))


def side_menu_reason(name: Column, price: Column, max_price: float = V.SIDE_MENU_MAX_PRICE) -> Column:
    """Why a cheap menu looks like a side charge, else NULL."""
    text = trim_space(F.coalesce(name, F.lit("")))
    cheap = (F.length(text) > 0) & (price <= max_price)
    return F.when(cheap, first_match(text, V.SIDE_MENU_RULES))
