"""Refreshing a places table from a source, checked before anything is written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingest, quality, snapshot
from ..operators.skew import materialize


@dataclass
class Refresh:
    """The next snapshot, its update report, the counters and what was left out."""

    places: DataFrame
    report: DataFrame
    counts: DataFrame
    rejected: DataFrame


def refresh_wide(raw: DataFrame, previous: DataFrame, geocode_cache: DataFrame, clean: bool = True) -> Refresh:
    """Source A: adapt, keep the last row per key, reuse known positions."""
    adapted = ingest.with_source_key(ingest.adapt_wide(raw, clean))
    sources = ingest.last_per_key(adapted, "source_key").drop("source_key")
    located = materialize(ingest.locate(sources, previous, geocode_cache))
    places = located.where(F.col("origin") != "skipped").drop("origin", "source_key")
    quality.require_safe_size(places.count(), previous.count(), allow_empty=previous.isEmpty())
    return Refresh(
        places,
        snapshot.update_report(previous, places),
        ingest.transform_counts(raw.count(), located),
        located.where(F.col("origin") == "skipped"),
    )


def refresh_normalized(
    raw_places: DataFrame,
    raw_menus: DataFrame,
    previous: DataFrame,
    clean: bool = True,
    keep_verification: bool = True,
    file_import: bool = False,
) -> Refresh:
    """Source B: join places and menus, keep earlier verification by id."""
    if file_import:
        quality.require_import_size(places=raw_places, menus=raw_menus)
    adapted = ingest.adapt_normalized(raw_places, raw_menus, clean)
    known = previous if keep_verification else previous.limit(0)
    places = materialize(ingest.preserve_verification(adapted, known))
    fetched, kept = raw_places.count(), places.count()
    quality.require_safe_size(kept, previous.count())
    counts = places.sparkSession.range(1).select(
        F.lit(fetched).cast("bigint").alias("fetched"),
        F.lit(kept).cast("bigint").alias("normalized"),
        F.lit(max(0, fetched - kept)).cast("bigint").alias("excluded"),
    )
    rejected = raw_places.join(places.select("ord"), "ord", "left_anti")
    return Refresh(places, snapshot.update_report(previous, places), counts, rejected)
