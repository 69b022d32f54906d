"""Menu predicates, classifiers and schema checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters
from ..functions import fixed_values as V
from ..functions import menus as M
from ..functions.text import parse_price
from ..operators import quality
from ..operators import recommend as R
from .base import flat_places, places, query, sql_classified, sql_match, sql_meal, sql_name_key


@query(
    "meal_menus",
    adapters.ctes("menus") + f"\nselect id, ord, {sql_meal('name')} as is_meal from menus",
)
def meal_menus(spark, sf_dir):
    """Is each menu a meal of its own?"""
    rows = adapters.view(spark, sf_dir, "menus")
    return rows.select("id", "ord", M.is_meal_name(F.col("name")).alias("is_meal"))


_RAW_KEY = sql_name_key("MENU_NM")
_RAW_PRICE = "cast(floor(cast(regexp_extract(replace(MENU_PRC, ',', ''), '\\d+(?:\\.\\d+)?', 0) as double) + 0.5) as bigint)"


def sql_priced_meal(key: str, price: str) -> str:
    low, high = V.MEAL_PRICE_RANGE
    return f"({key} <> '' and {price} between {low} and {high} and not {sql_match(key, V.ADD_ON_OR_DRINK)})"


@query(
    "priced_meals",
    adapters.ctes("raw_menus")
    + f"\nselect menu_ord, {_RAW_PRICE} as price, {sql_priced_meal(_RAW_KEY, _RAW_PRICE)} as is_meal from raw_menus",
)
def priced_meals(spark, sf_dir):
    """Source-B meal test of each raw menu row."""
    rows = adapters.view(spark, sf_dir, "raw_menus")
    price = parse_price(F.col("MENU_PRC"))
    return rows.select("menu_ord", price.alias("price"), M.is_priced_meal(F.col("MENU_NM"), price).alias("is_meal"))


@query(
    "classification",
    adapters.ctes("places", "menus")
    + ","
    + sql_classified()
    + """
select id, display_category, is_cafe, is_retail, coalesce(n, 0) as meal_count, lowest as min_meal_price
from classified left join (select id, count(*) as n, min(price) as lowest from menu_flags where meal group by id) using (id)""",
)
def classification(spark, sf_dir):
    """Display category, cafe and retail decision, and meals of each place."""
    return R.classify(places(spark, sf_dir)).select(
        "id",
        "display_category",
        "is_cafe",
        "is_retail",
        F.size("meals").cast("bigint").alias("meal_count"),
        "min_meal_price",
    )


@query(
    "schema_errors",
    adapters.ctes("places", "menus")
    + """
select id, concat_ws(',', case when p.category = '기타요식업' then 'category' end, case when n is null then 'menus' end,
  case when status = 'confirmed' and member = 2 then 'verification.matched_by' end) as errors
from places p left join (select distinct id, 1 as n from menus) m using (id)
where p.category = '기타요식업' or n is null or (status = 'confirmed' and member = 2)""",
)
def schema_errors(spark, sf_dir):
    """Places that break the schema, once some are damaged on purpose."""
    rows = places(spark, sf_dir)
    everyone = flat_places(spark, sf_dir).join(rows.select("id", "menus"), "id", "left")
    check = F.col("verification")
    damaged = everyone.withColumns(
        {
            "category": F.when(F.col("category") == V.OTHER_SOURCE_CATEGORY, "기타").otherwise(F.col("category")),
            "verification": F.when(
                check.isNotNull(),
                check.withField(
                    "matched_by", F.when(F.col("member") != 2, check["matched_by"])
                ),
            ),
        }
    )
    _, bad = quality.split_valid(damaged)
    return bad.select("id", F.array_join("_errors", ",").alias("errors"))


@query(
    "confirmed_coverage",
    adapters.ctes("places")
    + """
select cast(count(*) as bigint) as total, cast(count(*) filter (status = 'confirmed' and place_id <> '') as bigint) as confirmed,
  round(count(*) filter (status = 'confirmed' and place_id <> '') / count(*), 6) as ratio from places""",
)
def confirmed_coverage(spark, sf_dir):
    """Share of confirmed places a build is gated on."""
    return quality.coverage(flat_places(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


_IDS = """ids as (select distinct 'r' || lpad(cast(user_id * 20 as string), 9, '0') as id from events)"""


@query("selected_places", adapters.ctes("places") + f",\n{_IDS}\nselect ord, p.id from places p join ids using (id)")
def selected_places(spark, sf_dir):
    """Places requested by id."""
    return quality.select_ids(adapters.view(spark, sf_dir, "places"), _requested(spark, sf_dir)).select("ord", "id")


@query("missing_places", adapters.ctes("places") + f",\n{_IDS}\nselect id from ids where id not in (select id from places)")
def missing_places(spark, sf_dir):
    """Requested ids no place has."""
    return quality.missing_ids(adapters.view(spark, sf_dir, "places"), _requested(spark, sf_dir))


def _requested(spark, sf_dir):
    users = adapters.table(spark, sf_dir, "events")
    number = (F.col("user_id") * 20).cast("string")
    return users.select(F.concat(F.lit("r"), F.lpad(number, 9, "0")).alias("id")).distinct()


@query(
    "gates",
    adapters.ctes("places", "raw_menus", "requests")
    + f""",
sums as (
  select (select count(*) from places) as n, (select count(*) from places where status = 'confirmed' and place_id <> '') as s,
    (select count(*) from raw_menus) as m, (select count(*) from nation) as c)
select 'confirmed_coverage' as gate, true as passed, cast(1 as double) as value, cast({V.MIN_CONFIRMED_COVERAGE} as double) as needed from sums
union all select 'snapshot_size', s >= floor(n * {V.MIN_SNAPSHOT_RATIO}) and s > 0, s, floor(n * {V.MIN_SNAPSHOT_RATIO}) from sums
union all select 'import_size:menus', m >= {V.MIN_IMPORT_ROWS}, m, {V.MIN_IMPORT_ROWS} from sums
union all select 'import_size:nations', c >= {V.MIN_IMPORT_ROWS}, c, {V.MIN_IMPORT_ROWS} from sums
union all select 'located:places', count(*) = 0, count(*), 0 from places where latitude is null or longitude is null
union all select 'located:requests', count(*) = 0, count(*), 0 from requests where latitude is null or longitude is null""",
)
def gates(spark, sf_dir):
    """Gates when only the confirmed places are left of a snapshot, for a long and a short import, and for positions that miss."""
    everyone = flat_places(spark, sf_dir)
    sure = quality.select_for_build(everyone, min_coverage=0.0)
    imports = {"menus": adapters.view(spark, sf_dir, "raw_menus"), "nations": adapters.table(spark, sf_dir, "nation")}
    located = quality.location_gate(everyone, "located:places").unionByName(
        quality.location_gate(adapters.view(spark, sf_dir, "requests"), "located:requests")
    )
    return quality.gate_results(sure, everyone, imports).unionByName(located)
