"""Confirming places against landed search results, and the cross-check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions import fixed_values as V
from ..operators import matching, quality
from ..operators.ranking import evenly_spaced
from ..operators.skew import materialize


@dataclass
class Enrichment:
    places: DataFrame
    ledger: DataFrame


def enrich(
    places: DataFrame,
    hits: DataFrame,
    ledger: DataFrame,
    checked_at: str,
    policy_version: int = V.MATCH_POLICY_VERSION,
    limit: int | None = None,
) -> Enrichment:
    """Match the places the ledger lacks; returns all places and new entries.

    A place counts as processed whether or not a hit fits; a new policy
    version makes every place pending again.
    """
    todo = materialize(matching.pending(places, ledger, policy_version, limit))
    done = matching.apply_matches(todo, matching.best_place_hits(todo, hits), checked_at)
    untouched = places.join(todo.select("ord"), "ord", "left_anti").select(*places.columns)
    return Enrichment(untouched.unionByName(done), matching.ledger_rows(todo, policy_version, checked_at))


@dataclass
class CrossCheck:
    summary: DataFrame
    statuses: DataFrame
    ranked_hits: DataFrame


def cross_check(
    places: DataFrame,
    hits: DataFrame,
    sample_size: int = 10,
    ids: DataFrame | None = None,
    max_meters: float = V.LOCAL_HIT_MAX_METERS,
) -> CrossCheck:
    """Check an even sample (or given ids) of the unconfirmed places."""
    eligible = matching.unconfirmed(places)
    samples = evenly_spaced(eligible, "ord", sample_size) if ids is None else quality.require_ids(eligible, ids)
    samples = materialize(samples)
    evaluated = materialize(matching.evaluate_local_hits(samples, hits, max_meters))
    statuses = matching.sample_status(samples, evaluated)
    return CrossCheck(
        matching.cross_check_summary(eligible, statuses), statuses, matching.rank_local_hits(evaluated)
    )
