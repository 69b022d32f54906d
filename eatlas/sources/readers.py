"""Reading places, source files and landed API pages."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import fixed_values as V
from ..functions import text
from ..operators.quality import QualityError
from ..operators.ranking import distributed_row_number


def if_exists(read) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Places stored as parquet; an empty table if there are none yet."""
    found = if_exists(lambda: spark.read.schema(schema.PLACE).parquet(path))
    return spark.createDataFrame([], schema.PLACE) if found is None else found


def read_places_json(spark: SparkSession, path: str) -> DataFrame:
    """Places from JSON array files, ``ord`` being the order in the files.

    A JSON array is one value, so each file is read by one task; keep large
    tables as parquet, where ``ord`` is stored.
    """
    found = if_exists(lambda: spark.read.text(path, wholetext=True))
    if found is None:
        return spark.createDataFrame([], schema.PLACE)
    items = F.from_json("value", f"array<struct<{_nested(schema.PLACE_JSON)}>>", {"mode": "FAILFAST"})
    rows = found.select(F.col("_metadata.file_path").alias("_file"), F.posexplode(items).alias("_pos", "_place"))
    numbered = distributed_row_number(rows, [], [F.col("_file"), F.col("_pos")], "ord")
    places = numbered.select((F.col("ord") - 1).alias("ord"), *schema.from_json_place(F.col("_place")))
    return with_clean_text(places)


def with_clean_text(places: DataFrame) -> DataFrame:
    """Places whose names, addresses and regions are in one Unicode form, as all comparisons expect."""
    fixed = {c: text.clean_text(F.col(c)) for c in ("name", "province", "district", "address")}
    # Menu names are normalised as one text, so that an array takes one call.
    names = text.nfkc(F.to_json(F.struct(F.transform("menus", lambda m: F.coalesce(m["name"], F.lit(""))).alias("n"))))
    clean = F.from_json(names, "n array<string>")["n"]
    menus = F.zip_with(
        "menus", clean, lambda m, n: F.struct(F.when(m["name"].isNotNull(), text.trim_space(n)).alias("name"), m["price"].alias("price"))
    )
    return places.withColumns(fixed | {"menus": menus})


def _nested(ddl: str) -> str:
    """A DDL column list as struct fields."""
    fields, depth, current = [], 0, ""
    for character in ddl + ",":
        depth += {"<": 1, ">": -1}.get(character, 0)
        if character == "," and depth == 0:
            name, kind = current.strip().split(" ", 1)
            fields.append(f"{name}:{kind}")
            current = ""
        else:
            current += character
    return ",".join(fields)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with quoted commas, quotes and line breaks; all columns text."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')


def rename_columns(rows: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Known columns under their new names; the others are left out."""
    return rows.select(*[F.col(f"`{old}`").alias(new) for old, new in headers.items() if old in rows.columns])


def read_place_file(spark: SparkSession, path: str) -> DataFrame:
    """Source-B place file, ordered by its place id."""
    rows = rename_columns(read_csv(spark, path), V.PLACE_FILE_HEADERS)
    return _by_number(rows, "RSTR_ID", "ord")


def read_menu_file(spark: SparkSession, path: str) -> DataFrame:
    """Source-B menu file, ordered by its menu id."""
    rows = rename_columns(read_csv(spark, path), V.MENU_FILE_HEADERS)
    return _by_number(rows, "MENU_ID", "menu_ord")


def _by_number(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``name``: position (from 0) by the number in ``column``, then its text; texts that are no numbers come last."""
    number = F.col(column).try_cast("bigint")
    numbered = distributed_row_number(rows, [], [number.asc_nulls_last(), F.col(column), F.xxhash64(*rows.columns)], name)
    return numbered.withColumn(name, F.col(name) - 1)


def _page_number() -> F.Column:
    """Number in the page file's name, such as ``page-12.json``."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)[^0-9]*$", 1).cast("bigint")


def read_wide_pages(spark: SparkSession, path: str) -> DataFrame:
    """Rows of landed source-A pages ``{"data": [...], "totalCount": n}``."""
    texts = [*V.WIDE_COLUMNS.values()]
    for i in range(1, V.WIDE_MENU_COUNT + 1):
        texts += [V.WIDE_MENU_NAME.format(i), V.WIDE_MENU_PRICE.format(i)]
    row = ",".join(f"`{t}`:string" for t in texts)
    pages = spark.read.schema(f"data array<struct<{row}>>, totalCount bigint").json(path, multiLine=True)
    if not pages.where(F.col("data").isNull()).isEmpty():
        raise QualityError("a page has no data array")
    rows = pages.select(_page_number().alias("_page"), F.col("_metadata.file_path").alias("_file"), F.posexplode("data").alias("_pos", "_row"))
    _require_complete(rows, pages.agg(F.max("totalCount").alias("total")))
    return _in_page_order(rows, "ord")


def read_body_pages(spark: SparkSession, path: str, headers: dict[str, str], order: str) -> DataFrame:
    """Rows of landed source-B pages ``{"header": {...}, "body": [...]}``."""
    row = ",".join(f"`{t}`:string" for t in headers.values())
    pages = spark.read.schema(
        f"header struct<resultCode:string,totalCount:bigint>, body array<struct<{row}>>"
    ).json(path, multiLine=True)
    bad = F.coalesce(F.col("header.resultCode") != "00", F.lit(True)) | F.col("body").isNull()
    if not pages.where(bad).isEmpty():
        raise QualityError("a page reports an error or has no body")
    rows = pages.select(_page_number().alias("_page"), F.col("_metadata.file_path").alias("_file"), F.posexplode("body").alias("_pos", "_row"))
    _require_complete(rows, pages.agg(F.max("header.totalCount").alias("total")))
    return _in_page_order(rows, order)


def _in_page_order(rows: DataFrame, name: str) -> DataFrame:
    """Rows with their position (from 0) by page number, file and place in the file."""
    numbered = distributed_row_number(rows, [], [F.col("_page"), F.col("_file"), F.col("_pos")], name)
    return numbered.select((F.col(name) - 1).alias(name), "_row.*")


def _require_complete(rows: DataFrame, total: DataFrame) -> None:
    announced, landed = total.first().total, rows.count()
    if announced is not None and landed < announced:
        raise QualityError(f"only {landed} of {announced} rows landed")
