"""External matches, the cross-check and the enrichment ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import adapters
from ..functions import fixed_values as V
from ..operators import matching, ranking
from ..operators.skew import materialize, stored_folder
from ..streaming import enrichment
from .base import flat_places, query, sql_distance, sql_name_key
from .text import sql_home_key, sql_region_key, sql_road_core, sql_same_address

_BEST = f"""
asked as (
  select p.id, h.hit_id, h.hit_ord, h.place_url, try_cast(h.distance as double) as meters,
    ({sql_home_key('p.address')} <> '' and ({sql_home_key('h.road_address_name')} = {sql_home_key('p.address')} or {sql_home_key('h.address_name')} = {sql_home_key('p.address')})) as exact
  from place_hits h join places p on p.id = h.restaurant_id
  where {sql_name_key('h.place_name')} = {sql_name_key('p.name')} and h.category_group_code in ('FD6', 'CE7')),
fitting as (select *, row_number() over (partition by id order by exact desc, meters, hit_ord) as rn from asked where meters <= 500 and (exact or meters <= 150)),
best as (select id, hit_id, place_url, case when exact then 'name-address' else 'name-coordinates' end as matched_by, meters from fitting where rn = 1)"""


@query(
    "best_place_hits",
    adapters.ctes("places", "place_hits") + f",{_BEST}\nselect id, hit_id, matched_by, meters as distance_meters from best",
)
def best_place_hits(spark, sf_dir):
    """Best search hit of every place."""
    best = matching.best_place_hits(flat_places(spark, sf_dir), adapters.view(spark, sf_dir, "place_hits"))
    return best.select("id", "hit_id", "matched_by", "distance_meters")


@query(
    "applied_matches",
    adapters.ctes("places", "place_hits")
    + f""",{_BEST}
select p.id, coalesce(hit_id, p.place_id) as place_id,
  coalesce(replace(b.place_url, 'http:', 'https:'), 'https://map.kakao.com/link/map/' || p.place_id) as place_url,
  case when hit_id is null then 'unverified' else 'confirmed' end as status, matched_by, meters as distance_meters
from places p left join best b using (id)""",
)
def applied_matches(spark, sf_dir):
    """Every place with the outcome of its search."""
    places = flat_places(spark, sf_dir)
    best = matching.best_place_hits(places, adapters.view(spark, sf_dir, "place_hits"))
    done = matching.apply_matches(places, best, "2026-02-01T00:00:00.000Z")
    check = F.col("verification")
    return done.select(
        "id", "place_id", "place_url", check["status"].alias("status"), check["matched_by"].alias("matched_by"),
        check["distance_meters"].alias("distance_meters"),
    )


@query(
    "streamed_matches",
    adapters.ctes("places", "place_hits")
    + f""",{_BEST}
select p.id, hit_id, coalesce(hit_id, p.place_id) as place_id, case when hit_id is null then 'unverified' else 'confirmed' end as status, matched_by, meters as distance_meters
from places p left join best b using (id)""",
)
def streamed_matches(spark, sf_dir):
    """Outcomes of a stream over landed files that tear every place's hits apart, in two runs."""
    hits = adapters.view(spark, sf_dir, "place_hits")
    counted = hits.groupBy("restaurant_id").agg(F.count(F.lit(1)).alias("hit_count"))
    landed = materialize(hits.join(counted, "restaurant_id"))
    places = flat_places(spark, sf_dir)
    folder = f"{stored_folder(spark)}/stream-{uuid.uuid4().hex}"
    for turn in range(2):
        landed.where(F.pmod("hit_ord", F.lit(2)) == turn).repartition(4, "hit_ord").write.mode("append").json(f"{folder}/landed")
        stream = enrichment.enrich_complete_hits(
            spark, f"{folder}/landed", places, f"{folder}/out", f"{folder}/state", "2026-02-01T00:00:00.000Z", max_files_per_batch=3
        )
        stream.awaitTermination()
    check = F.col("verification")
    return enrichment.outcomes(spark, f"{folder}/out").select(
        "id", F.when(check["matched_by"].isNotNull(), F.col("place_id")).alias("hit_id"), "place_id",
        check["status"].alias("status"), check["matched_by"].alias("matched_by"), check["distance_meters"].alias("distance_meters"),
    )


_PLAIN_TITLE = "trim(regexp_replace(replace(h.title, '&amp;', '&'), '<[^>]*>', '', 'g'))"
_EVALUATED = f"""
keyed as (
  select p.id, h.hit_ord, {sql_name_key('p.name')} = {sql_name_key(_PLAIN_TITLE)} as exact_name,
    {sql_region_key('p.address')} as k, {sql_road_core('p.address')} as c, {sql_region_key('h.road_address')} as rk, {sql_road_core('h.road_address')} as rc,
    {sql_region_key('h.address')} as ak, {sql_road_core('h.address')} as ac,
    cast(floor({sql_distance('p.latitude', 'p.longitude', "cast(mapy as double) / 10000000", "cast(mapx as double) / 10000000")} + 0.5) as bigint) as distance_meters
  from local_hits h join places p on p.id = h.restaurant_id),
flagged as (
  select id, hit_ord, distance_meters, exact_name, {sql_same_address('k', 'c', 'rk', 'rc')} or {sql_same_address('k', 'c', 'ak', 'ac')} as address_match,
    distance_meters <= 150 as coordinates_match from keyed),
evaluated as (select *, exact_name and address_match and coordinates_match as strict_match from flagged)"""


def _evaluated(spark, sf_dir):
    hits = adapters.view(spark, sf_dir, "local_hits")
    return matching.evaluate_local_hits(flat_places(spark, sf_dir), hits)


@query(
    "ranked_local_hits",
    adapters.ctes("places", "local_hits")
    + f""",{_EVALUATED}
select *, row_number() over (partition by id order by strict_match desc, exact_name desc, address_match desc, distance_meters, hit_ord) as rank from evaluated""",
)
def ranked_local_hits(spark, sf_dir):
    """Local-search hits of every place, best first, with their signals."""
    ranked = matching.rank_local_hits(materialize(_evaluated(spark, sf_dir)))
    return ranked.select(
        "id", "hit_ord", "distance_meters", "exact_name", "address_match", "coordinates_match", "strict_match", "rank"
    )


@query(
    "best_local_hits",
    adapters.ctes("places", "local_hits")
    + f""",{_EVALUATED}
select id, arg_min(hit_ord, row(distance_meters, hit_ord)) as hit_ord, min(distance_meters) as distance_meters from evaluated where strict_match group by id""",
)
def best_local_hits(spark, sf_dir):
    """Best strict local-search hit of every place."""
    return matching.best_local_hits(_evaluated(spark, sf_dir)).select("id", "hit_ord", "distance_meters")


_STATUS = """,
eligible as (select id, province from places where not coalesce(place_id <> '' and status = 'confirmed', false)),
per_place as (select id, bool_or(strict_match) as strict, bool_or(not exact_name and address_match and coordinates_match) as renamed, count(*) as hits
  from evaluated group by id),
statuses as (
  select id, province, case when strict then 'strict-match' when hits > 0 then 'no-strict-match' else 'no-result' end as status,
    coalesce(hits, 0) as hit_count, coalesce(not strict and renamed, false) as probable_rename
  from eligible left join per_place using (id))"""


@query(
    "cross_check_status",
    adapters.ctes("places", "local_hits") + f",{_EVALUATED}{_STATUS}\nselect id, status, hit_count, probable_rename from statuses",
)
def cross_check_status(spark, sf_dir):
    """Cross-check outcome of every unconfirmed place."""
    eligible = matching.unconfirmed(flat_places(spark, sf_dir)).select("id")
    return matching.sample_status(eligible, _evaluated(spark, sf_dir))


@query(
    "cross_check_summary",
    adapters.ctes("places", "local_hits")
    + f""",{_EVALUATED}{_STATUS}
select province as source, count(*) as eligible_count, count(*) as sample_count, count(*) filter (status = 'strict-match') as strict_match_count,
  count(*) filter (status = 'no-strict-match') as no_strict_match_count, count(*) filter (status = 'no-result') as no_result_count,
  count(*) filter (probable_rename) as probable_rename_count from statuses group by province""",
)
def cross_check_summary(spark, sf_dir):
    """Cross-check totals, with the province in the role of the source."""
    eligible = matching.unconfirmed(flat_places(spark, sf_dir)).select("id", F.col("province").alias("source"))
    statuses = matching.sample_status(eligible, _evaluated(spark, sf_dir))
    return matching.cross_check_summary(eligible, statuses, "source")


@query(
    "pending_places",
    adapters.ctes("places")
    + """
select ord, id from places where ord not in (select user_id from events where value >= 5)""",
)
def pending_places(spark, sf_dir):
    """Places the ledger lacks under the current policy version."""
    events = adapters.table(spark, sf_dir, "events")
    version = F.when(F.col("value") >= 5, V.MATCH_POLICY_VERSION).otherwise(V.MATCH_POLICY_VERSION - 1)
    ledger = events.select(
        F.concat(F.lit("r"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("id"),
        version.alias("policy_version"),
    )
    return matching.pending(adapters.view(spark, sf_dir, "places"), ledger).select("ord", "id")


SAMPLE = 100


@query(
    "even_sample",
    adapters.ctes("places")
    + f""",
eligible as (select ord, id, row_number() over (order by ord) - 1 as pos, count(*) over () as n from places where not coalesce(place_id <> '' and status = 'confirmed', false)),
picks as (select floor(i * (n - 1) / ({SAMPLE} - 1) + 0.5) as pos from (select max(n) as n from eligible), (select unnest(range(0, {SAMPLE})) as i))
select ord, id from eligible where n <= {SAMPLE} or pos in (select pos from picks)""",
)
def even_sample(spark, sf_dir):
    """Evenly spaced sample of the unconfirmed places."""
    eligible = matching.unconfirmed(flat_places(spark, sf_dir))
    return ranking.evenly_spaced(eligible, "ord", SAMPLE).select("ord", "id")


@query(
    "location_suggestions",
    adapters.ctes("places", "place_hits")
    + """,
spots as (
  select restaurant_id as query_id, 0 as kind, row_number() over (partition by restaurant_id order by hit_ord desc) as rank, 'place-' || (h.hit_ord % 2) as sid, p.latitude, p.longitude
  from place_hits h join places p on p.ord = h.hit_ord
  union all
  select restaurant_id, 1, row_number() over (partition by restaurant_id order by hit_ord), 'address-' || p.latitude || '-' || p.longitude, p.latitude, p.longitude
  from place_hits h join places p on p.ord = h.hit_ord),
limited as (select * from spots where (kind = 0 and rank <= 5) or (kind = 1 and rank <= 3)),
by_id as (select *, row_number() over (partition by query_id, kind, sid order by rank) as nth_id from limited),
by_spot as (select *, row_number() over (partition by query_id, round(latitude, 5), round(longitude, 5) order by kind, rank) as nth_spot from by_id where kind = 1 or nth_id = 1),
shown as (select *, row_number() over (partition by query_id order by kind, rank) as position from by_spot where kind = 0 or nth_spot = 1)
select query_id, position, case when kind = 0 then sid else 'address' end as sid, round(latitude, 4) as latitude from shown where position <= 5""",
)
def location_suggestions(spark, sf_dir):
    """Place and address results of a location search, merged per query."""
    hits = adapters.view(spark, sf_dir, "place_hits").select(F.col("restaurant_id").alias("query_id"), "hit_ord")
    points = adapters.view(spark, sf_dir, "places").select(
        F.col("ord").alias("hit_ord"), "name", "address", "latitude", "longitude"
    )
    found = materialize(hits.join(points, "hit_ord"))
    ranked = lambda order: ranking.distributed_row_number(found, ["query_id"], [order], "rank")
    columns = ["query_id", "rank", "id", "name", "address", "latitude", "longitude"]
    places = ranked(F.col("hit_ord").desc()).withColumn(
        "id", F.concat(F.lit("place-"), (F.col("hit_ord") % 2).cast("string"))
    )
    addresses = ranked(F.col("hit_ord").asc()).withColumn("id", F.lit("address"))
    merged = ranking.merge_locations(places.select(*columns), addresses.select(*columns))
    return merged.select("query_id", "position", F.col("id").alias("sid"), F.round("latitude", 4).alias("latitude"))
