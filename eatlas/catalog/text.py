"""Text, address, price, coordinate and preference queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters
from ..functions import fixed_values as V
from ..functions import geo, preferences, text
from ..operators import matching
from ..operators.skew import spread
from .base import (
    SQL_LIMIT, flat_places, query, quoted, sql_address_key, sql_name_key, sql_spaces,
)


@query(
    "text_keys",
    f"""
select doc_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as cleaned, md5({sql_name_key('text')}) as name_key,
  md5({sql_address_key('text')}) as address_key, md5({sql_spaces('text')}) as collapsed
from documents""",
)
def text_keys(spark, sf_dir):
    """Clean text and its comparison keys, over whole documents."""
    docs = spread(adapters.table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = docs.select("doc_id", text.clean_text(F.col("text")).alias("text"))
    cleaned = F.col("text")
    return docs.select(
        "doc_id",
        F.md5(cleaned).alias("cleaned"),
        F.md5(text.name_key(cleaned)).alias("name_key"),
        F.md5(text.address_key(cleaned)).alias("address_key"),
        F.md5(text.collapse_spaces(cleaned)).alias("collapsed"),
    )


def _sql_markup(column: str) -> str:
    result = f"coalesce({column}, '')"
    for pattern, character in V.MARKUP_ENTITIES:
        result = f"regexp_replace({result}, {quoted(pattern)}, {quoted(character)}, 'g')"
    return f"regexp_replace(regexp_replace({result}, {quoted(V.MARKUP_TAG)}, '', 'g'), '^\\s+|\\s+$', '', 'g')"


@query(
    "strip_markup",
    f"""
select page_id, cast(length(t) as bigint) as characters, md5(t) as hash
from (select page_id, {_sql_markup('html')} as t from pages)""",
)
def strip_markup(spark, sf_dir):
    """Entities decoded, tags dropped, over whole pages."""
    pages = adapters.table(spark, sf_dir, "pages")
    stripped = pages.select("page_id", text.strip_markup(F.col("html")).alias("t"))
    return stripped.select("page_id", F.length("t").cast("bigint").alias("characters"), F.md5("t").alias("hash"))


def _sql_unbracketed(column: str) -> str:
    return f"regexp_replace(lower(coalesce({column}, '')), {quoted(V.PARENTHESES)}, '', 'g')"


def sql_region_key(column: str) -> str:
    result = _sql_unbracketed(column)
    for pattern, short in V.REGION_ALIASES:
        result = f"regexp_replace({result}, {quoted(pattern)}, {quoted(short)}, 'g')"
    return sql_address_key(result)


def sql_home_key(column: str) -> str:
    return sql_address_key(f"regexp_replace(lower(coalesce({column}, '')), {quoted(V.HOME_REGION_WORDS)}, '', 'g')")


def sql_road_core(column: str) -> str:
    plain = _sql_unbracketed(column)
    part = lambda i: f"regexp_extract({plain}, {quoted(V.ROAD_CORE)}, {i})"
    return sql_address_key(f"{part(1)} || {part(2)}")


def sql_same_address(lk: str, lc: str, rk: str, rc: str) -> str:
    return (
        f"({lk} <> '' and {rk} <> '' and ({lk} = {rk} or ({lc} <> '' and {lc} = {rc})"
        f" or (least(length({lk}), length({rk})) >= {V.MIN_PREFIX_ADDRESS_LENGTH}"
        f" and (starts_with({lk}, {rk}) or starts_with({rk}, {lk})))))"
    )


@query(
    "address_keys",
    adapters.ctes("places")
    + f"""
select id, {sql_address_key('address')} as plain_key, {sql_home_key('address')} as home_key,
  {sql_region_key('address')} as region_key, {sql_road_core('address')} as road_core
from places""",
)
def address_keys(spark, sf_dir):
    """The four address keys of every place."""
    address = F.col("address")
    return adapters.view(spark, sf_dir, "places").select(
        "id",
        text.address_key(address).alias("plain_key"),
        text.home_address_key(address).alias("home_key"),
        text.region_address_key(address).alias("region_key"),
        text.road_core(address).alias("road_core"),
    )


@query(
    "address_matches",
    adapters.ctes("places", "local_hits")
    + f""",
k as (select restaurant_id as id, hit_ord, {sql_region_key('p.address')} as lk, {sql_road_core('p.address')} as lc,
    {sql_region_key('h.road_address')} as rk, {sql_road_core('h.road_address')} as rc
  from local_hits h join places p on p.id = h.restaurant_id)
select id, hit_ord, {sql_same_address('lk', 'lc', 'rk', 'rc')} as compatible from k""",
)
def address_matches(spark, sf_dir):
    """Address compatibility of every place with its local-search hits."""
    places = adapters.view(spark, sf_dir, "places").select("id", "address")
    hits = adapters.view(spark, sf_dir, "local_hits").select(
        F.col("restaurant_id").alias("id"), "hit_ord", "road_address"
    )
    return hits.join(places, "id").select(
        "id", "hit_ord", text.addresses_compatible(F.col("address"), F.col("road_address")).alias("compatible")
    )


@query(
    "coordinates",
    adapters.ctes("local_hits")
    + """,
n as (select restaurant_id as id, hit_ord, try_cast(mapy as double) as y, try_cast(mapx as double) as x from local_hits),
c as (select id, hit_ord, case when abs(y) > 90 then y / 10000000 else y end as latitude,
    case when abs(x) > 180 then x / 10000000 else x end as longitude from n)
select id, hit_ord, round(latitude, 6) as latitude, round(longitude, 6) as longitude,
  latitude between 36.8 and 38.2 and longitude between 124 and 128 as in_bounds,
  cast(floor((latitude - 0.2) / 0.25) as bigint) || '_' || cast(floor((longitude - 0.2) / 0.25) as bigint) as tile
from c""",
)
def coordinates(spark, sf_dir):
    """Scaled coordinates of search hits, plausibility and tile."""
    hits = adapters.view(spark, sf_dir, "local_hits").select(
        F.col("restaurant_id").alias("id"),
        "hit_ord",
        geo.parse_coordinate(F.col("mapy"), 90.0).alias("latitude"),
        geo.parse_coordinate(F.col("mapx"), 180.0).alias("longitude"),
    )
    lat, lon = F.col("latitude"), F.col("longitude")
    return hits.select(
        "id", "hit_ord", F.round(lat, 6).alias("latitude"), F.round(lon, 6).alias("longitude"),
        geo.in_bounds(lat, lon).alias("in_bounds"), geo.tile_key(lat, lon).alias("tile"),
    )


@query(
    "travel_limits",
    adapters.ctes("requests")
    + f"""
select request_id, round({SQL_LIMIT.replace('cast(time_limit as double)', 'try_cast(time_limit as double)')}, 3) as limit_meters,
  cast(greatest(1, ceil(budget_meters / (case travel_mode when 'walking' then cast(4000 as double) / 60 else cast(24000 as double) / 60 end))) as bigint) as minutes
from (select *, cast(user_id * 37 as double) as budget_meters from requests)""",
)
def travel_limits(spark, sf_dir):
    """Distance limit of every request and the minutes some distance takes."""
    requests = adapters.view(spark, sf_dir, "requests")
    return requests.select(
        "request_id",
        F.round(geo.travel_limit_meters(F.col("travel_mode"), F.col("time_limit")), 3).alias("limit_meters"),
        geo.travel_minutes((F.col("user_id") * 37).cast("double"), F.col("travel_mode")).alias("minutes"),
    )


@query(
    "prices",
    adapters.ctes("wide_rows")
    + """,
t as (select ord, slot, regexp_extract(replace(coalesce(price, ''), ',', ''), '\\d+(?:\\.\\d+)?', 0) as found
  from (select ord, unnest([1, 2, 3, 4]) as slot, unnest([price1, price2, price3, price4]) as price from wide_rows))
select ord, cast(slot as bigint) as slot, case when try_cast(found as double) > 0 then cast(floor(try_cast(found as double) + 0.5) as bigint) end as price
from t""",
)
def prices(spark, sf_dir):
    """Prices read from the price texts of every wide row."""
    rows = adapters.view(spark, sf_dir, "wide_rows")
    slots = rows.select("ord", F.posexplode(F.array("price1", "price2", "price3", "price4")).alias("slot", "price"))
    return slots.select(
        "ord", (F.col("slot") + 1).cast("bigint").alias("slot"), text.parse_price(F.col("price")).alias("price")
    )


def sql_source_key() -> str:
    return " || '|' || ".join(sql_name_key(c) for c in ("province", "district", "name", "address"))


@query(
    "match_keys",
    adapters.ctes("places")
    + f"""
select id, {sql_source_key()} as source_key, substr(sha256({sql_source_key()}), 1, 20) as record_id,
  {sql_name_key('name')} || '|' || {sql_name_key('address')} as name_address_key,
  case when phone <> '' then {sql_name_key('province')} || '|' || {sql_name_key('district')} || '|' || {sql_name_key('name')} || '|' || {sql_name_key('phone')} end as phone_key,
  {sql_name_key('province')} || '|' || {sql_name_key('district')} || '|' || {sql_name_key('name')} as name_district_key
from places""",
)
def match_keys(spark, sf_dir):
    """The four match keys of every place and the id made from the first."""
    province, district, name, address = (F.col(c) for c in ("province", "district", "name", "address"))
    key = text.source_key(province, district, name, address)
    return adapters.view(spark, sf_dir, "places").select(
        "id",
        key.alias("source_key"),
        text.record_id(key).alias("record_id"),
        text.name_address_key(name, address).alias("name_address_key"),
        text.phone_key(province, district, name, F.col("phone")).alias("phone_key"),
        text.name_district_key(province, district, name).alias("name_district_key"),
    )


@query(
    "source_categories",
    adapters.ctes("wide_rows")
    + f""",
k as (select ord, category, address, {sql_name_key('category')} as key from wide_rows)
select ord, case when starts_with(key, '한식') then '한식' when starts_with(key, '중식') then '중식'
    when starts_with(key, '일식') then '일식' when starts_with(key, '양식') then '양식'
    when contains(key, '기타요식') or contains(key, '기타외식') or key = '카페' then '기타요식업' end as category,
  coalesce(nullif(regexp_extract(address, {quoted(V.DISTRICTS)}, 1), ''), '인천') as district
from k""",
)
def source_categories(spark, sf_dir):
    """Source category and district read from the texts of every wide row."""
    return adapters.view(spark, sf_dir, "wide_rows").select(
        "ord",
        text.source_category(F.col("category")).alias("category"),
        text.find_district(F.col("address")).alias("district"),
    )


@query(
    "search_plan",
    adapters.ctes("places")
    + """
select id, cast(0 as bigint) as step, name || ' ' || province as search_text from places
union all select id, cast(1 as bigint), name from places""",
)
def search_plan(spark, sf_dir):
    """Search texts to try for every place."""
    plan = matching.search_plan(adapters.view(spark, sf_dir, "places"))
    return plan.select("id", F.col("step").cast("bigint").alias("step"), "search_text")


@query(
    "map_links",
    adapters.ctes("places")
    + f"""
select id, coalesce(case when ord % 3 = 0 then 'https://place.example.org/' || cast(ord as varchar) end, {quoted(V.MAP_LINK_PREFIX)} || place_id, {quoted(V.MAP_SEARCH_PREFIX)} || replace(replace(url_encode(name || ' ' || district), '%28', '('), '%29', ')')) as link
from places""",
)
def map_links(spark, sf_dir):
    """Link of every place: its own page, id page or search page."""
    own = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("https://place.example.org/"), F.col("ord").cast("string")))
    return flat_places(spark, sf_dir).select(
        "id", text.map_link(own, F.col("place_id"), F.col("name"), F.col("district")).alias("link")
    )


# Saved preferences as users might have stored them, some of them broken.
_PREFERENCE_SQL = """
select request_id,
  (case when user_id % 11 = 10 then 'not json' when category is null then '{}' else
    '{"category":"' || (case when user_id % 7 = 6 then '분식' else category end) || '","budget":'
    || (case when budget > 1000000 then '"unlimited"' when user_id % 5 = 4 then '99000' else cast(cast(budget as bigint) as string) end)
    || ',"travelMode":"' || travel_mode || '","travelTimeLimit":'
    || (case when time_limit = 'wide' then '"wide"' when user_id % 9 = 8 then '"10"' else time_limit end) || '}' end) as stored
from requests"""


@query(
    "preferences",
    adapters.ctes("requests")
    + f""",
stored as ({_PREFERENCE_SQL}),
j as (select request_id, case when json_valid(stored) then stored end as v from stored),
f as (select request_id,
    case when json_extract_string(v, '$.category') in ('전체', {', '.join(quoted(c) for c in V.DISPLAY_CATEGORIES)}) then json_extract_string(v, '$.category') end as category,
    case when json_extract_string(v, '$.budget') = 'unlimited' then cast('Infinity' as double)
      when json_type(v, '$.budget') in ('UBIGINT', 'BIGINT', 'DOUBLE') and try_cast(json_extract_string(v, '$.budget') as double) in (10000, 15000, 20000)
      then cast(json_extract_string(v, '$.budget') as double) end as budget,
    case when json_extract_string(v, '$.travelMode') in ('walking', 'driving') then json_extract_string(v, '$.travelMode') end as travel_mode,
    case when json_extract_string(v, '$.travelTimeLimit') = 'wide' then 'wide'
      when json_type(v, '$.travelTimeLimit') in ('UBIGINT', 'BIGINT') and json_extract_string(v, '$.travelTimeLimit') in ('10', '20')
      then json_extract_string(v, '$.travelTimeLimit') end as time_limit
  from j)
select request_id, category, case when budget < 1000000 then cast(budget as bigint) end as budget, budget > 1000000 as unlimited, travel_mode, time_limit,
  '{{"category":' || coalesce('"' || category || '"', 'null') || ',"budget":' || (case when budget > 1000000 then '"unlimited"' else coalesce(cast(cast(budget as bigint) as string), 'null') end)
  || ',"travelMode":' || coalesce('"' || travel_mode || '"', 'null') || ',"travelTimeLimit":'
  || (case when time_limit = 'wide' then '"wide"' else coalesce(time_limit, 'null') end) || '}}' as saved_again
from f""".replace("cast(cast(budget as bigint) as string), 'null') end)\n  || ',\"travelMode\"", "cast(case when budget < 1000000 then cast(budget as bigint) end as string), 'null') end)\n  || ',\"travelMode\""),
)
def saved_preferences(spark, sf_dir):
    """Stored preferences parsed against the allowed values, and saved again."""
    requests = adapters.view(spark, sf_dir, "requests")
    stored = requests.select("request_id", F.expr(_stored_expression()).alias("stored"))
    parsed = stored.select("request_id", F.explode(F.array(preferences.parse_preferences(F.col("stored")))).alias("p")).select(
        "request_id", "p.*"
    )
    again = preferences.serialize_preferences(
        F.col("category"), F.col("budget"), F.col("travel_mode"), F.col("time_limit")
    )
    finite = F.col("budget") < float("inf")
    return parsed.select(
        "request_id",
        "category",
        F.when(finite, F.col("budget").cast("bigint")).alias("budget"),
        (F.col("budget") == float("inf")).alias("unlimited"),
        "travel_mode",
        "time_limit",
        again.alias("saved_again"),
    )


def _stored_expression() -> str:
    """The expression behind ``stored`` in the adapter SQL above."""
    return _PREFERENCE_SQL.split("select request_id,", 1)[1].rsplit(" as stored", 1)[0]
