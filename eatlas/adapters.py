"""Places, menus, requests and search hits derived from the order tables.

Each view is plain SQL in the subset Spark and DuckDB share, so that a check
can run the same view on both. Every view covers its whole base tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "pages",
)

VIEWS: dict[str, str] = {}

# Three places per group of customers: m = 0 and 1 share name, address and
# point, m = 2 is the same name at another floor 33 m or about a kilometre away.
VIEWS["places"] = """
select 'r' || lpad(cast(c_custkey as string), 9, '0') as id, c_custkey as ord, b as grp, m as member,
  (case when m = 1 then '(주) ' else '' end) || (case b % 16 when 0 then '식당' when 1 then '한우갈비'
     when 2 then '카페 다정' when 3 then '행복포차' when 4 then '쌀국수집' when 5 then '소문난 분식'
     when 6 then '우리정육점' when 7 then '바다횟집' when 8 then '온누리' when 9 then '통닭마을'
     when 10 then '호텔뷔페' when 11 then '브런치룸' when 12 then '초밥하루' when 13 then '별다방'
     when 14 then '동네제과' else '참 좋은 집' end) || ' ' || cast(b as string) as name,
  (case b % 4 when 0 then '인천광역시' when 1 then '서울특별시' when 2 then '경기도' else '부산광역시' end) as province,
  (case b % 5 when 0 then '남동구' when 1 then '중구' when 2 then '연수구' when 3 then '부평구' else '서구' end) as district,
  (case b % 4 when 0 then '인천광역시' when 1 then '서울특별시' when 2 then '경기도' else '부산광역시' end)
    || (case b % 5 when 0 then ' 남동구' when 1 then ' 중구' when 2 then ' 연수구' when 3 then ' 부평구' else ' 서구' end)
    || ' 중앙로 ' || cast(b as string) || (case when m = 2 then ' 2층' else '' end) as address,
  (case c_mktsegment when 'AUTOMOBILE' then '한식' when 'BUILDING' then '중식' when 'FURNITURE' then '일식'
    when 'HOUSEHOLD' then '양식' else '기타요식업' end) as category,
  (case when c_custkey % 4 = 0 then null else '02-' || cast(c_custkey as string) end) as phone,
  cast(330000 + b * 7919 % 56000 + (case when m = 2 and b % 2 = 0 then 3 when m = 2 then 100 else 0 end) as double) / 10000 as latitude,
  cast(1260000 + b * 104729 % 50000 as double) / 10000 as longitude,
  (case when m = 0 then 'k' || cast(b as string) when m = 2 and b % 5 = 0 then 'x' || cast(b as string)
    when m = 2 and b % 7 = 0 then 'k' || cast(b as string) when m = 1 and b % 11 = 0 then 'k' || cast(b as string) end) as place_id,
  (case when m = 0 or (m = 2 and (b % 5 = 0 or b % 7 = 0)) then 'confirmed'
    when m = 2 and b % 13 = 0 then 'unverified' end) as status
from (select *, cast(floor(c_custkey / 3) as bigint) as b, c_custkey % 3 as m from customer) c
"""

# The same places, a third of the groups along the seam of longitudes and a third about the
# north pole. Third records lie across the seam or, in some groups, across the pole.
VIEWS["wrapped_places"] = """
select id, ord, grp, member, name, province, district, address, category, phone, place_id, status,
  (case grp % 3 when 0 then cast(330000 + grp * 7919 % 56000 as double) / 10000
    when 1 then cast(899999 - (case when grp % 10 = 0 then 0 else 4 * (grp % 499) end)
      - (case when member < 2 then 0 when grp % 2 = 0 then 2 else 100 end) as double) / 10000
    else latitude end) as latitude,
  (case grp % 3 when 0 then cast((case when member < 2 then 1799999 when grp % 2 = 0 then -1799998 else -1799800 end) as double) / 10000
    when 1 then cast((grp * 7919 + (case when member = 2 and grp % 10 = 0 then 1800 else 0 end)) % 3600 * 1000 - 1800000 as double) / 10000
    else longitude end) as longitude
from places
"""

VIEWS["menus"] = """
select 'r' || lpad(cast(o_custkey as string), 9, '0') as id, p_partkey as ord,
  split_part(p_name, ' ', 1) || ' ' || dish as name, cast(1000 + (p_partkey * 37 % 400) * 100 as bigint) as price
from (select distinct o_custkey, p_partkey, p_name,
        (cast(floor(o_custkey / 3) as bigint) + (case when p_partkey % 4 < 2 then 0 when p_partkey % 4 = 2 then 1 else 2 end)) % 16 as i
      from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey) x
join (values (0, '비빔밥'), (1, '아메리카노'), (2, '참치김밥'), (3, '치즈피자'), (4, '소주'), (5, '볶음밥 추가'),
  (6, '마라탕'), (7, '고추장 500g'), (8, '카페 라떼'), (9, '순대국'), (10, '라면 사리'), (11, '초밥 정식'),
  (12, '인절미 떡볶이'), (13, '상차림 비용'), (14, '짬뽕'), (15, '오미자차')) d(i2, dish) on x.i = d.i2
"""

VIEWS["requests"] = """
select event_id as request_id, user_id,
  (case when event_type = 'error' then null else cast(330000 + user_id * 7919 % 56000 as double) / 10000 end) as latitude,
  cast(1260000 + user_id * 104729 % 50000 as double) / 10000 as longitude,
  (case when event_type = 'signup' then null when user_id % 3 = 0 then '전체' when user_id % 3 = 1 then '한식' else '분식·간편식' end) as category,
  (case when value < 5 then cast(10000 as double) when value < 20 then cast(15000 as double)
    when value < 60 then cast(20000 as double) else cast('Infinity' as double) end) as budget,
  (case when event_id % 2 = 0 then 'driving' else 'walking' end) as travel_mode,
  (case when event_id % 3 = 0 then '10' when event_id % 3 = 1 then '20' else 'wide' end) as time_limit
from events
"""

# The earlier snapshot holds places of customers in debt-free standing; later
# some closed, some opened, and some changed their phone or their menus.
VIEWS["place_standing"] = """
select p.*, c_acctbal, c_nationkey from places p join customer on p.ord = c_custkey
"""
VIEWS["previous_places"] = """
select id, ord, name, province, district, address, category, phone, latitude, longitude, place_id, status,
  c_nationkey as menu_price
from place_standing where c_acctbal < 8500
"""
VIEWS["next_places"] = """
select id, ord, name, province, district, address, category,
  (case when c_acctbal < 1500 then '032-' || cast(ord as string) else phone end) as phone,
  latitude, longitude, place_id,
  (case when status is null and c_acctbal > 7000 then 'unverified' else status end) as status,
  c_nationkey + (case when c_acctbal between 3000 and 4000 then 1 else 0 end) as menu_price
from place_standing where c_acctbal >= 500
"""

# What the second source published before: places of its own area, under its own ids.
VIEWS["previous_home_places"] = """
select 'incheon-' || cast(ord as string) as id, ord, place_id, status
from previous_places where latitude between 36.8 and 38.2 and longitude between 124 and 128
"""

# Search results for every place: the members of its own group, as another
# provider would list them.
VIEWS["place_hits"] = """
select q.id as restaurant_id, h.place_key as hit_id, h.ord as hit_ord, h.name as place_name,
  cast(abs(q.ord - h.ord) * 110 + h.grp % 60 as string) as distance,
  (case when h.grp % 9 = 0 then 'CS2' when h.member = 1 then 'CE7' else 'FD6' end) as category_group_code,
  (case when h.grp % 3 = 0 then null else h.address end) as road_address_name, h.address as address_name,
  'http://place.map.kakao.com/' || cast(h.ord as string) as place_url
from places q join (select *, 'p' || cast(ord as string) as place_key from places) h on q.grp = h.grp
"""
VIEWS["local_hits"] = """
select q.id as restaurant_id, h.ord as hit_ord,
  '<b>' || h.name || '</b>' || (case when h.grp % 6 = 0 then ' &amp; 친구' else '' end) as title,
  '음식점&gt;' || h.category as category, h.address as address,
  replace(replace(h.address, '광역시', ''), '특별시', '') as road_address,
  'https://example.org/' || cast(h.ord as string) as link,
  cast(cast(round(h.longitude * 10000000) as bigint) as string) as mapx,
  cast(cast(round(h.latitude * 10000000) as bigint) as string) as mapy
from places q join places h on q.grp = h.grp and q.member <> h.member
"""

# Source-A rows: the dishes of an order's customer side by side.
VIEWS["wide_rows"] = """
select o_orderkey as ord, province, district, p.category || '업' as category, name, phone, address,
  max(case when l_linenumber = 1 then dish end) as menu1, max(case when l_linenumber = 1 then price end) as price1,
  max(case when l_linenumber = 2 then dish end) as menu2, max(case when l_linenumber = 2 then price end) as price2,
  max(case when l_linenumber = 3 then dish end) as menu3, max(case when l_linenumber = 3 then price end) as price3,
  max(case when l_linenumber = 4 then dish end) as menu4, max(case when l_linenumber = 4 then price end) as price4
from (select o_orderkey, o_custkey, l_linenumber,
        (case when l_quantity < 5 then '' else split_part(p_name, ' ', 2) || ' 정식' end) as dish,
        (case when l_quantity > 45 then '문의' else cast(cast(floor(l_extendedprice / 1000) as bigint) as string) || ',500원' end) as price
      from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey) x
join places p on p.ord = o_custkey
group by o_orderkey, province, district, p.category, name, phone, address
"""

# Source-B rows: one place table, one menu table.
VIEWS["raw_places"] = """
select cast(ord as string) as RSTR_ID, name as RSTR_NM,
  (case when member = 2 then '본점' else '' end) as BRNCH_NM,
  (case when grp % 6 = 5 then '' else address end) as ROAD_NM_ADDR, address as LOTNO_ADDR,
  cast(latitude as string) as RSTR_LAT, cast(longitude as string) as RSTR_LOT, coalesce(phone, '') as RSTR_RPRS_TELNO,
  (case when category = '기타요식업' then '' else category || ' 일반' end) as BIZ_CRTFCT_BZSTAT_NM,
  (case when grp % 10 = 0 then '일반음식점' else '' end) as BIZ_LCPMT_NM, ord
from places
"""
VIEWS["raw_menus"] = """
select cast(o_orderkey * 8 + l_linenumber as bigint) as menu_ord, cast(o_custkey as string) as RSTR_ID,
  split_part(p_name, ' ', 1) || ' ' || dish as MENU_NM,
  cast(1000 + p_partkey * 37 % 400 * 100 as string) || '원' as MENU_PRC, '인천 서구' as RGN_NM
from (select o_orderkey, o_custkey, l_linenumber, p_partkey, p_name, (o_custkey + p_partkey) % 8 as i
      from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey) x
join (values (0, '비빔밥'), (1, '콜라'), (2, '짬뽕'), (3, '치즈피자'), (4, '소주'), (5, '공기밥'),
  (6, '초밥'), (7, '국밥')) d(i2, dish) on x.i = d.i2
"""

DEPENDENCIES = {
    "places": (), "wrapped_places": ("places",), "menus": (), "requests": (),
    "place_standing": ("places",),
    "previous_places": ("place_standing",), "previous_home_places": ("previous_places",), "next_places": ("place_standing",),
    "place_hits": ("places",), "local_hits": ("places",), "wide_rows": ("places",),
    "raw_places": ("places",), "raw_menus": (),
}


def ordered(names: tuple[str, ...]) -> list[str]:
    """The named views and all they build on, in definition order."""
    needed: set[str] = set()

    def visit(name: str) -> None:
        if name not in needed:
            needed.add(name)
            for other in DEPENDENCIES[name]:
                visit(other)

    for name in names:
        visit(name)
    return [name for name in VIEWS if name in needed]


def ctes(*names: str) -> str:
    """``WITH`` clause that defines the named views over the base tables."""
    return "with " + ",\n".join(f"{name} as ({VIEWS[name].strip()})" for name in ordered(names))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One adapter view as a DataFrame over the parquet tables of ``sf_dir``."""
    body = ctes(name)
    used = [t for t in BASE_TABLES if re.search(rf"\b{t}\b", body)]
    tables = ",\n".join(f"{t} as (select * from parquet.`{sf_dir}/{t}.parquet`)" for t in used)
    return spark.sql(f"with {tables},\n{body[len('with '):]}\nselect * from {name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
