"""Registry of queries with their SQL checks, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..functions import fixed_values as V
from ..operators.nesting import nest_menus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` is the same result as DuckDB SQL."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function

    return register


# --- Spark side -----------------------------------------------------------------


def verification(status: str = "status") -> Column:
    """Verification struct of a place from its flat status."""
    confirmed = F.col(status) == V.STATUS_CONFIRMED
    return F.when(
        F.col(status).isNotNull(),
        F.struct(
            F.lit(V.VERIFICATION_PROVIDER).alias("provider"),
            F.col(status).alias("status"),
            F.when(confirmed, V.MATCHED_BY_ADDRESS).alias("matched_by"),
            F.when(confirmed, (F.col("ord") % 140).cast("double")).alias("distance_meters"),
            F.lit("2026-01-01T00:00:00.000Z").alias("checked_at"),
        ),
    )


def flat_places(spark: SparkSession, sf_dir: str, view: str = "places") -> DataFrame:
    """Places of a view without their menus, in the canonical columns."""
    rows = adapters.view(spark, sf_dir, view)
    return rows.withColumns(
        {
            "place_url": F.concat(F.lit(V.MAP_LINK_PREFIX), "place_id"),
            "verification": verification(),
        }
    ).drop("status")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with nested menus in menu order."""
    return nest_menus(flat_places(spark, sf_dir), adapters.view(spark, sf_dir, "menus"))


def menu_names(column: str) -> Column:
    """Menu names of an array in order, as one flat text."""
    return F.array_join(F.transform(column, lambda m: m["name"]), "|")


# --- SQL side -------------------------------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _alternatives(pattern: str) -> list[str]:
    parts, depth, current, escaped, in_class = [], 0, "", False, False
    for character in pattern:
        if escaped:
            escaped = False
        elif character == "\\":
            escaped = True
        elif in_class:
            in_class = character != "]"
        elif character == "[":
            in_class = True
        elif character == "(":
            depth += 1
        elif character == ")":
            depth -= 1
        elif character == "|" and depth == 0:
            parts.append(current)
            current = ""
            continue
        current += character
    return [*parts, current]


def sql_match(text: str, pattern: str) -> str:
    """DuckDB test of a rule pattern. It has no look-ahead, so ``A(?!B)`` is
    tested as ``A`` on the text with every ``AB`` blanked out."""
    plain, tests = [], []
    for part in _alternatives(pattern):
        head, ahead, tail = part.partition("(?!")
        if ahead:
            followed = "|".join(head + rest for rest in tail.rstrip(")").split("|"))
            blanked = f"regexp_replace({text}, {quoted('(?i)' + followed)}, chr(1), 'g')"
            tests.append(f"regexp_matches({blanked}, {quoted('(?i)' + head)})")
        else:
            plain.append(part)
    if plain:
        tests.insert(0, f"regexp_matches({text}, {quoted('(?i)' + '|'.join(plain))})")
    return "(" + " or ".join(tests) + ")"


def sql_first_match(text: str, rules) -> str:
    whens = " ".join(f"when {sql_match(text, p)} then {quoted(label)}" for label, p in rules)
    return f"(case {whens} end)"


def sql_name_key(text: str) -> str:
    return (
        f"regexp_replace(regexp_replace(lower(coalesce({text}, '')), {quoted(V.COMPANY_MARKS)}, '', 'g'), "
        f"{quoted(V.KEY_DROP)}, '', 'g')"
    )


def sql_address_key(text: str) -> str:
    return f"regexp_replace(lower(coalesce({text}, '')), {quoted(V.KEY_DROP)}, '', 'g')"


def sql_spaces(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def sql_distance(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = (
        f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    )
    return f"({2 * V.EARTH_RADIUS_METERS} * atan2(sqrt({h}), sqrt(1 - {h})))"


def sql_meal(name: str) -> str:
    text = sql_spaces(name)
    return (
        f"({text} <> '' and not {sql_match(text, V.ACCESSORY_MENU)} and not {sql_match(text, V.VAGUE_OR_CHILD_MENU)}"
        f" and not {sql_match(text, V.STANDALONE_SAUCE)}"
        f" and (not {sql_match(text, V.BEVERAGE_OR_ALCOHOL)} or {sql_match(text, V.MEAL_SIGNAL)}))"
    )


def sql_classified() -> str:
    """CTEs menu_flags and classified over the adapter views."""
    curated = " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in V.CURATED_CATEGORIES.items())
    name = sql_spaces("p.name")
    item = sql_spaces("name")
    return f"""
menu_flags as (
  select id, ord, name, price, {sql_meal('name')} as meal, {sql_match(item, V.CAFE_MENU)} as cafe_item,
    {sql_match(item, V.SUBSTANTIAL_MEAL)} as meal_item, {sql_match(item, V.RETAIL_PRODUCT)} as retail_item
  from menus),
menu_sums as (
  select id, count(*) as n, count(*) filter (cafe_item) as cafes, count(*) filter (meal_item) as meals,
    count(*) filter (retail_item) as retails, string_agg(name, ' ' order by ord) as menu_text
  from menu_flags group by id),
classified as (
  select p.*, menu_text,
    (case when {sql_match(name, V.BAKERY_NAME)} then false
      when not {sql_match(name, V.SUBSTANTIAL_BUSINESS_NAME)} and cafes / n >= 0.5 and meals / n <= 0.25 then true
      when {sql_match(name, V.SUBSTANTIAL_BUSINESS_NAME)} or meals > 0 then false
      when {sql_match(name, V.CAFE_NAME)} then true else cafes / n >= 0.5 end) as is_cafe,
    ({sql_match(name, V.NON_RESTAURANT_BUSINESS)} or retails / n >= 0.5) as is_retail,
    coalesce(case place_id {curated} end, case when category <> {quoted(V.OTHER_SOURCE_CATEGORY)} then category end,
      {sql_first_match(name, V.BUSINESS_NAME_RULES)},
      {sql_first_match(sql_spaces('menu_text'), V.MENU_TEXT_RULES)}) as display_category
  from places p join menu_sums using (id))"""


SQL_LIMIT = f"""(case time_limit when 'wide' then (case travel_mode when 'walking' then {V.WALKING_WIDE_METERS} else {V.DRIVING_WIDE_METERS} end)
  else (case travel_mode when 'walking' then cast(4000 as double) / 60 else cast(24000 as double) / 60 end) * cast(time_limit as double) end)"""


def sql_found() -> str:
    """CTEs up to ``found``: the candidates of every ready request, by brute force."""
    distance = sql_distance("r.latitude", "r.longitude", "c.latitude", "c.longitude")
    return (
        adapters.ctes("places", "menus", "requests")
        + ","
        + sql_classified()
        + f""",
ready as (
  select *, {SQL_LIMIT.replace('cast(time_limit as double)', 'try_cast(time_limit as double)')} as radius from requests
  where latitude is not null and longitude is not null and category is not null and budget is not null
    and travel_mode is not null and time_limit is not null),
positions as (select distinct latitude, longitude from ready),
near as (
  select r.latitude as lat, r.longitude as lon, c.id, {distance} as distance
  from positions r join classified c on abs(c.latitude - r.latitude) <= 0.2
  where not is_cafe and not is_retail and display_category is not null),
pairs as (
  select r.request_id, r.user_id, r.budget, r.travel_mode, n.id, n.distance
  from ready r join near n on n.lat = r.latitude and n.lon = r.longitude and n.distance <= r.radius
  join classified c on c.id = n.id and (r.category = '전체' or r.category = c.display_category)),
found as (
  select p.request_id, p.user_id, p.travel_mode, p.id, p.distance, string_agg(m.name, '|' order by m.ord) as menu_list, count(*) as menu_count
  from pairs p join menu_flags m on m.id = p.id and m.meal and m.price <= p.budget
  group by p.request_id, p.user_id, p.travel_mode, p.id, p.distance)"""
    )
