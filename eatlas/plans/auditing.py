"""Audits of several sources side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text
from ..operators import audit, dedup
from ..sources import reports


def stacked(sources: dict[str, DataFrame]) -> DataFrame:
    """The places of several sources in one table, with ``source``; ``ord`` is made unique and keeps the order of each source."""
    tables = [
        df.withColumn("ord", F.col("ord") * len(sources) + i).withColumn("source", F.lit(name))
        for i, (name, df) in enumerate(sources.items())
    ]
    return reduce(DataFrame.unionByName, tables)


def audit_sources(
    sources: dict[str, DataFrame],
    max_side_price: float = V.SIDE_MENU_MAX_PRICE,
    reports_root: str | None = None,
    run: str | None = None,
) -> DataFrame:
    """One summary row per source, in one job over all of them.

    With ``reports_root`` the rows are kept there as the audit report of
    ``run``, and come back from it; a run is never written twice.
    """
    if max_side_price < 0:
        raise ValueError("max_side_price must be >= 0")
    found = audit.summaries(stacked(sources), "source", max_side_price)
    if reports_root is None:
        return found
    if run is None:
        raise ValueError("a written report needs the name of its run")
    reports.write_report(found, reports_root, "audit", run)
    spark = found.sparkSession
    return reports.read_reports(spark, reports_root, "audit").where(F.col("run") == run).select(*found.columns)


def audit_details(places: DataFrame, max_side_price: float = V.SIDE_MENU_MAX_PRICE) -> dict[str, DataFrame]:
    """The tables behind a summary, by name."""
    resolved = dedup.resolve(places)
    groups = dedup.duplicate_groups(places, resolved)
    sides = audit.side_menus(places, max_side_price)
    reviews = audit.category_reviews(places)
    place_id = text.trim_space(F.coalesce("place_id", F.lit("")))
    return {
        "duplicate_place_ids": audit.duplicate_key_members(places, place_id, audit.reference_columns()),
        "duplicate_name_addresses": audit.duplicate_key_members(places, audit.name_address(), audit.reference_columns()),
        "duplicate_groups": groups,
        "duplicate_group_members": dedup.duplicate_members(places, resolved),
        "duplicate_groups_by_reason": audit.groups_by_reason(groups),
        "side_menus": sides,
        "side_menus_by_reason": audit.count_by(sides, F.col("reason"), "reason"),
        "category_reviews": reviews,
        "category_changes": audit.category_changes(reviews),
    }
