"""Flat menu tables to nested menu arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def menu_arrays(menus: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per place id with its menus as array<struct<name, price>>.

    ``order`` are the columns that give the array its order.
    """
    order = order or ["ord"]
    item = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], "name", "price")
    sorted_items = F.array_sort(F.collect_list(item))
    return menus.groupBy("id").agg(
        F.transform(
            sorted_items, lambda m: F.struct(m["name"].alias("name"), m["price"].alias("price"))
        ).alias("menus")
    )


def nest_menus(places: DataFrame, menus: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Places with their menus; a place without menus is dropped."""
    return places.join(menu_arrays(menus, order), "id")
