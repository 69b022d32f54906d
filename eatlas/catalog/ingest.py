"""Source adapters, record lookup and the two refresh jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters
from ..functions import fixed_values as V

from ..operators import ingest, quality
from ..operators.skew import materialize
from ..plans.refresh import refresh_normalized, refresh_wide
from .base import flat_places, menu_names, places, query, quoted, sql_match, sql_name_key
from .classification import sql_priced_meal


def _wide(spark, sf_dir):
    """Wide rows under the column names of the source."""
    rows = adapters.view(spark, sf_dir, "wide_rows")
    names = {new: old for old, new in V.WIDE_COLUMNS.items()}
    menus = {}
    for i in range(1, V.WIDE_MENU_COUNT + 1):
        menus[V.WIDE_MENU_NAME.format(i)] = f"menu{i}"
        menus[V.WIDE_MENU_PRICE.format(i)] = f"price{i}"
    return rows.select("ord", *[F.col(old).alias(new) for new, old in {**names, **menus}.items()])


_ADAPTED = f"""
slots as (
  select ord, unnest([1, 2, 3, 4]) as slot, unnest([menu1, menu2, menu3, menu4]) as menu,
    unnest([price1, price2, price3, price4]) as price_text from wide_rows),
priced as (
  select ord, slot, trim(menu) as menu, try_cast(regexp_extract(replace(price_text, ',', ''), '\\d+(?:\\.\\d+)?', 0) as double) as amount from slots),
kept as (select ord, slot, menu, cast(floor(amount + 0.5) as bigint) as price from priced where menu <> '' and amount > 0),
firsts as (select ord, {sql_name_key('menu')} as key, price, min(slot) as slot, arg_min(menu, slot) as menu from kept group by all),
adapted as (
  select w.ord, case when starts_with(category, '기타요식') then '기타요식업' else left(category, 2) end as category, province, district, name, phone, address,
    string_agg(f.menu || '=' || f.price, '|' order by f.slot) as menus, count(*) as menu_count
  from wide_rows w join firsts f using (ord) group by all),
keyed as (
  select *, {sql_name_key('province')} || '|' || {sql_name_key('district')} || '|' || {sql_name_key('name')} || '|' || {sql_name_key('address')} as source_key from adapted),
sources as (
  select source_key, min(ord) as ord, arg_max(menus, ord) as menus, arg_max(category, ord) as category, arg_max(province, ord) as province,
    arg_max(district, ord) as district, arg_max(name, ord) as name, arg_max(coalesce(phone, ''), ord) as phone, arg_max(address, ord) as address
  from keyed group by source_key)"""


def _priced():
    """Menus with their prices, as one flat text."""
    return F.array_join(F.transform("menus", lambda m: F.concat(m["name"], F.lit("="), m["price"].cast("string"))), "|")



@query(
    "adapted_wide_rows",
    adapters.ctes("wide_rows") + f",{_ADAPTED}\nselect ord, category, name, phone, address, menus from adapted",
)
def adapted_wide_rows(spark, sf_dir):
    """Usable wide rows with category, menus and prices."""
    adapted = ingest.adapt_wide(_wide(spark, sf_dir))
    return adapted.select("ord", "category", "name", "phone", "address", _priced().alias("menus"))


@query(
    "last_source_rows",
    adapters.ctes("wide_rows") + f",{_ADAPTED}\nselect ord, source_key, menus from sources",
)
def last_source_rows(spark, sf_dir):
    """The last wide row of each source key, at the first one's position."""
    adapted = ingest.with_source_key(ingest.adapt_wide(_wide(spark, sf_dir)))
    last = ingest.last_per_key(adapted, "source_key")
    return last.select("ord", "source_key", _priced().alias("menus"))


@query(
    "last_events",
    "select min(event_id) as event_id, user_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by user_id",
)
def last_events(spark, sf_dir):
    """The last event of every user, at the position of the first."""
    events = adapters.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return ingest.last_per_key(events, "user_id", "event_id")


def _sql_key(*columns: str) -> str:
    return " || '|' || ".join(sql_name_key(c) for c in columns)


_TIERS = (
    (1, _sql_key("province", "district", "name", "address")),
    (2, _sql_key("name", "address")),
    (3, f"case when coalesce(phone, '') <> '' then {_sql_key('province', 'district', 'name', 'phone')} end"),
    (4, _sql_key("province", "district", "name")),
)


def _lookup_sql(rows: str, existing: str) -> str:
    """CTEs up to ``located``: the existing record of every row of ``rows``."""
    asked = " union all ".join(f"select ord, {t} as tier, {k} as key from {rows}" for t, k in _TIERS)
    known = " union all ".join(f"select ord, {t} as tier, {k} as key from {existing}" for t, k in _TIERS)
    return f"""
asked as ({asked}),
known as (select tier, key, min(ord) as existing_ord from ({known}) where key is not null group by tier, key having count(*) = 1),
hits as (select a.ord, arg_min(existing_ord, a.tier) as existing_ord, min(a.tier) as tier from asked a join known k on a.tier = k.tier and a.key = k.key group by a.ord)"""


@query(
    "existing_records",
    adapters.ctes("wide_rows", "previous_places")
    + f",{_ADAPTED},{_lookup_sql('sources', 'previous_places')}\nselect ord, existing_ord, cast(tier as bigint) as tier from hits",
)
def existing_records(spark, sf_dir):
    """Record of the previous snapshot each source row continues."""
    adapted = ingest.with_source_key(ingest.adapt_wide(_wide(spark, sf_dir)))
    sources = materialize(ingest.last_per_key(adapted, "source_key"))
    found = ingest.find_existing(sources, adapters.view(spark, sf_dir, "previous_places"))
    return found.select("ord", "existing_ord", F.col("tier").cast("bigint").alias("tier"))


@query(
    "reused_records",
    adapters.ctes("wide_rows", "previous_places")
    + f""",{_ADAPTED},{_lookup_sql('adapted', 'previous_places')}
select existing_ord, count(*) as claims, min(ord) as first_ord, cast(min(tier) as bigint) as best_tier from hits group by existing_ord having count(*) > 1""",
)
def reused_records(spark, sf_dir):
    """Records of the previous snapshot that several source rows continue."""
    rows = materialize(ingest.adapt_wide(_wide(spark, sf_dir)))
    found = ingest.find_existing(rows, adapters.view(spark, sf_dir, "previous_places"))
    return ingest.reused_records(found).withColumn("best_tier", F.col("best_tier").cast("bigint"))


_ONE_TO_ONE = "claims as (select a.ord, a.tier, k.existing_ord from asked a join known k on a.tier = k.tier and a.key = k.key)," + ",".join(
    f"""
won{t} as (
  select min(ord) as ord, existing_ord, {t} as tier from claims where tier = {t}
  {"".join(f" and ord not in (select ord from won{u}) and existing_ord not in (select existing_ord from won{u})" for u in range(1, t))}
  group by existing_ord)"""
    for t in (1, 2, 3, 4)
)


@query(
    "continued_records",
    adapters.ctes("wide_rows", "previous_places")
    + f",{_ADAPTED},{_lookup_sql('adapted', 'previous_places').replace('hits as', 'best as')},{_ONE_TO_ONE}\n"
    + " union all ".join(f"select ord, existing_ord, cast(tier as bigint) as tier from won{t}" for t in (1, 2, 3, 4)),
)
def continued_records(spark, sf_dir):
    """The one source row that continues each record of the previous snapshot."""
    rows = materialize(ingest.adapt_wide(_wide(spark, sf_dir)))
    found = ingest.continue_one_to_one(rows, adapters.view(spark, sf_dir, "previous_places"))
    return found.select("ord", "existing_ord", F.col("tier").cast("bigint").alias("tier"))


def _previous(spark, sf_dir):
    """The previous snapshot in canonical columns."""
    rows = places(spark, sf_dir)
    known = adapters.view(spark, sf_dir, "previous_places").select("ord")
    columns = (
        "ord", "id", "name", "category", "province", "district", "phone", "address", "latitude", "longitude",
        "menus", "place_id", "place_url", "verification",
    )
    return rows.join(known, "ord", "left_semi").select(*columns)


def _cache(spark, sf_dir):
    """Geocode cache: positions of the places that are no first of a group."""
    rows = ingest.with_source_key(flat_places(spark, sf_dir)).where(F.col("phone").isNotNull())
    return rows.groupBy("source_key").agg(
        *[F.min(c).alias(c) for c in ("latitude", "longitude", "place_id", "place_url")],
        F.min_by("verification", "ord").alias("verification"),
    )


_LOCATED = f"""
cache as (
  select {_sql_key('province', 'district', 'name', 'address')} as source_key, min(latitude) as latitude, min(place_id) as place_id
  from places where phone is not null group by 1),
located as (
  select s.ord, s.source_key, s.menus, case when h.existing_ord is not null then 'preserved' when c.source_key is not null then 'geocoded' else 'skipped' end as origin,
    coalesce(p.id, substr(sha256(s.source_key), 1, 20)) as id,
    case when h.existing_ord is not null then p.latitude else c.latitude end as latitude,
    case when h.existing_ord is not null then p.place_id else c.place_id end as place_id
  from sources s left join hits h using (ord) left join previous_places p on p.ord = h.existing_ord left join cache c using (source_key))"""


@query(
    "refreshed_wide_places",
    adapters.ctes("wide_rows", "previous_places")
    + f",{_ADAPTED},{_lookup_sql('sources', 'previous_places')},{_LOCATED}\nselect ord, id, latitude, place_id, menus from located where origin <> 'skipped'",
)
def refreshed_wide_places(spark, sf_dir):
    """Source-A refresh: the next snapshot."""
    done = refresh_wide(_wide(spark, sf_dir), materialize(_previous(spark, sf_dir)), _cache(spark, sf_dir))
    return done.places.select("ord", "id", "latitude", "place_id", _priced().alias("menus"))


@query(
    "wide_refresh_counts",
    adapters.ctes("wide_rows", "previous_places")
    + f""",{_ADAPTED},{_lookup_sql('sources', 'previous_places')},{_LOCATED}
select (select count(*) from wide_rows) as fetched, count(*) as normalized, count(*) filter (origin = 'preserved') as preserved,
  count(*) filter (origin = 'geocoded') as geocoded, count(*) filter (origin = 'skipped') as excluded from located""",
)
def wide_refresh_counts(spark, sf_dir):
    """Source-A refresh: its counters."""
    raw = _wide(spark, sf_dir)
    sources = ingest.last_per_key(ingest.with_source_key(ingest.adapt_wide(raw)), "source_key").drop("source_key")
    located = ingest.locate(sources, materialize(_previous(spark, sf_dir)), _cache(spark, sf_dir))
    return ingest.transform_counts(raw.count(), located)


_MENU_KEY = sql_name_key("MENU_NM")
_MENU_PRICE = "cast(regexp_extract(MENU_PRC, '\\d+', 0) as bigint)"


def _menu_rule_sql() -> str:
    whens = " ".join(f"when {sql_match('menu_text', p)} then {quoted(label)}" for label, p in V.MENU_KEY_RULES)
    kinds = " ".join(f"when {sql_match('kind', p)} then {quoted(label)}" for label, p in V.BUSINESS_TYPE_RULES)
    return f"(case {kinds} {whens} else {quoted(V.OTHER_SOURCE_CATEGORY)} end)"


_NORMALIZED = f"""
usable as (
  select menu_ord, RSTR_ID, MENU_NM as name, {_MENU_KEY} as key, {_MENU_PRICE} as price, RGN_NM from raw_menus
  where {sql_priced_meal(_MENU_KEY, _MENU_PRICE)}),
menu_texts as (select RSTR_ID, string_agg(key, '' order by menu_ord, key) as menu_text, arg_min(RGN_NM, menu_ord) as region from usable group by RSTR_ID),
first_items as (select RSTR_ID, key, price, min(menu_ord) as menu_ord, arg_min(name, row(menu_ord, name)) as name from usable group by RSTR_ID, key, price),
item_lists as (select RSTR_ID, string_agg(name, '|' order by price, menu_ord, name) as menus, count(*) as menu_count from first_items group by RSTR_ID),
normalized as (
  select ord, 'incheon-' || RSTR_ID as id, RSTR_NM || (case when BRNCH_NM = '' then '' else ' ' || BRNCH_NM end) as name,
    coalesce(nullif(ROAD_NM_ADDR, ''), LOTNO_ADDR) as address, {sql_name_key("BIZ_CRTFCT_BZSTAT_NM || ' ' || BIZ_LCPMT_NM")} as kind, menu_text, menus, menu_count,
    coalesce(nullif(regexp_extract(coalesce(nullif(ROAD_NM_ADDR, ''), LOTNO_ADDR) || ' ' || LOTNO_ADDR || ' ' || region, {quoted(V.DISTRICTS)}, 1), ''), '인천') as district
  from raw_places join menu_texts using (RSTR_ID) join item_lists using (RSTR_ID)
  where cast(RSTR_LAT as double) between 36.8 and 38.2 and cast(RSTR_LOT as double) between 124 and 128)"""


def _raw_places(spark, sf_dir):
    rows = adapters.view(spark, sf_dir, "raw_places")
    return rows.toDF(*[c.upper() if c != "ord" else c for c in rows.columns])


def _raw_menus(spark, sf_dir):
    rows = adapters.view(spark, sf_dir, "raw_menus")
    return rows.toDF(*[c.upper() if c != "menu_ord" else c for c in rows.columns])


@query(
    "adapted_normalized_places",
    adapters.ctes("raw_places", "raw_menus")
    + f",{_NORMALIZED}\nselect id, name, address, district, {_menu_rule_sql()} as category, menus, menu_count from normalized",
)
def adapted_normalized_places(spark, sf_dir):
    """Place and menu tables of source B as canonical places."""
    adapted = ingest.adapt_normalized(_raw_places(spark, sf_dir), _raw_menus(spark, sf_dir))
    return adapted.select(
        "id", "name", "address", "district", "category", menu_names("menus").alias("menus"),
        F.size("menus").cast("bigint").alias("menu_count"),
    )


def _previous_home(spark, sf_dir):
    """The earlier snapshot of the second source, whole."""
    own = adapters.view(spark, sf_dir, "previous_home_places").select("ord", F.col("id").alias("_id"))
    return materialize(_previous(spark, sf_dir).join(own, "ord").withColumn("id", F.col("_id")).drop("_id"))


@query(
    "refreshed_normalized_places",
    adapters.ctes("raw_places", "raw_menus", "previous_home_places")
    + f""",{_NORMALIZED}
select n.id, n.name, p.place_id, p.status from normalized n left join previous_home_places p on n.id = p.id""",
)
def refreshed_normalized_places(spark, sf_dir):
    """Source-B refresh: the next snapshot with kept verification."""
    done = refresh_normalized(_raw_places(spark, sf_dir), _raw_menus(spark, sf_dir), _previous_home(spark, sf_dir))
    return done.places.select("id", "name", "place_id", F.col("verification.status").alias("status"))


@query(
    "refresh_gates",
    adapters.ctes("raw_places", "raw_menus", "previous_places", "previous_home_places")
    + f""",{_NORMALIZED},
sizes as (select 'own' as snapshot, count(*) as previous from previous_home_places union all select 'whole', count(*) from previous_places)
select snapshot, previous, (select count(*) from normalized) as kept, cast(floor(previous * 0.5) as bigint) as needed,
  (select count(*) from normalized) >= floor(previous * 0.5) as passed from sizes""",
)
def refresh_gates(spark, sf_dir):
    """Whether a source-B refresh may replace its own snapshot, and that it may not replace one of all places."""
    adapted = ingest.adapt_normalized(_raw_places(spark, sf_dir), _raw_menus(spark, sf_dir))
    kept = materialize(ingest.preserve_verification(adapted, _previous_home(spark, sf_dir)))
    snapshots = {"own": "previous_home_places", "whole": "previous_places"}
    rows = []
    for name, view in snapshots.items():
        gate = quality.gate_results(kept, adapters.view(spark, sf_dir, view).select("ord"), {}).where("gate = 'snapshot_size'")
        rows.append(gate.select(F.lit(name).alias("snapshot"), "value", "needed", "passed"))
    sizes = [adapters.view(spark, sf_dir, v).agg(F.count(F.lit(1)).alias("previous")).select(F.lit(n).alias("snapshot"), "previous") for n, v in snapshots.items()]
    return rows[0].unionByName(rows[1]).join(sizes[0].unionByName(sizes[1]), "snapshot").select(
        "snapshot", "previous", F.col("value").cast("bigint").alias("kept"), F.col("needed").cast("bigint").alias("needed"), "passed"
    )
