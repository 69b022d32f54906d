"""Readers: the given tables are written in a source's file form and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import adapters, schema
from ..functions import fixed_values as V
from ..operators.skew import stored_folder
from ..sources import readers
from .base import places, query


def _folder(spark) -> str:
    return f"{stored_folder(spark)}/files-{uuid.uuid4().hex}"


def _one_file_each(rows: DataFrame, path: str) -> str:
    """Texts of ``rows`` (part, value) as files, one a part."""
    rows.write.partitionBy("part").text(path)
    return path


@query(
    "json_places",
    adapters.ctes("places", "menus")
    + """
select p.id, p.name, p.address, nullif(p.phone, '') as phone, p.latitude, nullif(p.place_id, '') as place_id, p.status, coalesce(n, 0) as menu_count
from places p left join (select id, count(*) as n from menus group by id) using (id)""",
)
def json_places(spark, sf_dir):
    """Places written as JSON array files and read again."""
    rows = places(spark, sf_dir).select(F.struct(*schema.to_json_place()).alias("place"), F.col("ord"))
    arrays = rows.groupBy(F.floor(F.col("ord") / 500).alias("part")).agg(F.to_json(F.collect_list("place")).alias("value"))
    got = readers.read_places_json(spark, _one_file_each(arrays, _folder(spark)))
    return got.select(
        "id", "name", "address", "phone", "latitude", "place_id", F.col("verification.status").alias("status"),
        F.size("menus").cast("bigint").alias("menu_count"),
    )


def _as_csv(rows: DataFrame, headers: dict[str, str], path: str) -> str:
    known = {new: old for old, new in headers.items()}
    chosen = rows.select(*[F.col(c).alias(known[c]) for c in rows.columns if c in known])
    chosen.write.csv(path, header=True, quote='"', escape='"')
    return path


def _upper(rows: DataFrame) -> DataFrame:
    return rows.toDF(*[c.upper() for c in rows.columns])


@query(
    "csv_places",
    adapters.ctes("raw_places")
    + """
select row_number() over (order by cast(RSTR_ID as bigint)) - 1 as ord, RSTR_ID as id, RSTR_NM as name, nullif(ROAD_NM_ADDR, '') as road,
  LOTNO_ADDR as lot, nullif(RSTR_RPRS_TELNO, '') as phone from raw_places""",
)
def csv_places(spark, sf_dir):
    """Source-B place files read from CSV."""
    path = _as_csv(_upper(adapters.view(spark, sf_dir, "raw_places")), V.PLACE_FILE_HEADERS, _folder(spark))
    return readers.read_place_file(spark, path).select(
        "ord", F.col("RSTR_ID").alias("id"), F.col("RSTR_NM").alias("name"), F.col("ROAD_NM_ADDR").alias("road"),
        F.col("LOTNO_ADDR").alias("lot"), F.col("RSTR_RPRS_TELNO").alias("phone"),
    )


@query(
    "csv_menus",
    adapters.ctes("raw_menus")
    + """
select cast(menu_ord as varchar) as menu, RSTR_ID as place, MENU_NM as name, MENU_PRC as price from raw_menus""",
)
def csv_menus(spark, sf_dir):
    """Source-B menu files read from CSV."""
    rows = _upper(adapters.view(spark, sf_dir, "raw_menus")).withColumn("MENU_ID", F.col("MENU_ORD").cast("string"))
    path = _as_csv(rows, V.MENU_FILE_HEADERS, _folder(spark))
    return readers.read_menu_file(spark, path).select(
        F.col("MENU_ID").alias("menu"), F.col("RSTR_ID").alias("place"), F.col("MENU_NM").alias("name"), F.col("MENU_PRC").alias("price")
    )


@query(
    "landed_wide_pages",
    adapters.ctes("wide_rows") + "\nselect name, address, menu1, price1, menu4, price4 from wide_rows",
)
def landed_wide_pages(spark, sf_dir):
    """Source-A rows landed as API pages."""
    rows = adapters.view(spark, sf_dir, "wide_rows")
    named = {c: V.WIDE_COLUMNS[c] for c in V.WIDE_COLUMNS} | {
        f"{own}{i}": pattern.format(i)
        for own, pattern in (("menu", V.WIDE_MENU_NAME), ("price", V.WIDE_MENU_PRICE))
        for i in range(1, V.WIDE_MENU_COUNT + 1)
    }
    row = F.struct(*[F.col(c).alias(to) for c, to in named.items()])
    page = F.struct(F.collect_list(row).alias("data"), F.lit(rows.count()).alias("totalCount"))
    pages = rows.groupBy(F.floor(F.col("ord") / 4000).alias("part")).agg(F.to_json(page).alias("value"))
    got = readers.read_wide_pages(spark, _one_file_each(pages, _folder(spark)))
    return got.select(*[F.col(f"`{named[c]}`").alias(c) for c in ("name", "address", "menu1", "price1", "menu4", "price4")])


@query(
    "landed_body_pages",
    adapters.ctes("raw_menus") + "\nselect RSTR_ID as place, MENU_NM as name, MENU_PRC as price, RGN_NM as region from raw_menus",
)
def landed_body_pages(spark, sf_dir):
    """Source-B menus landed as API pages."""
    rows = _upper(adapters.view(spark, sf_dir, "raw_menus"))
    columns = ("RSTR_ID", "MENU_NM", "MENU_PRC", "RGN_NM")
    header = F.struct(F.lit("00").alias("resultCode"), F.lit(rows.count()).alias("totalCount"))
    page = F.struct(header.alias("header"), F.collect_list(F.struct(*columns)).alias("body"))
    pages = rows.groupBy(F.floor(F.col("MENU_ORD") / 4000).alias("part")).agg(F.to_json(page).alias("value"))
    got = readers.read_body_pages(spark, _one_file_each(pages, _folder(spark)), {c: c for c in columns}, "menu_ord")
    return got.select(*[F.col(c).alias(n) for c, n in zip(columns, ("place", "name", "price", "region"), strict=True)])
