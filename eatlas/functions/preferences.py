"""Saved request preferences: JSON text to columns and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import bound

_NUMBER_TYPES = r"^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"


def _text_field(value: Column, field: str) -> Column:
    """A JSON string field, NULL for other JSON types."""
    raw = F.try_variant_get(value, f"$.{field}", "variant")
    return F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(value, f"$.{field}", "string"))


def _number_field(value: Column, field: str) -> Column:
    raw = F.try_variant_get(value, f"$.{field}", "variant")
    return F.when(
        F.schema_of_variant(raw).rlike(_NUMBER_TYPES), F.try_variant_get(value, f"$.{field}", "double")
    )


def _allowed(value: Column, choices) -> Column:
    return F.when(value.isin(*choices), value)


def parse_preferences(text: Column) -> Column:
    """struct<category, budget, travel_mode, time_limit>; bad parts are NULL.

    The unlimited budget is +Infinity, a time limit is '10', '20' or 'wide'.
    """
    return bound(F.try_parse_json(text), _preferences)


def _preferences(value: Column) -> Column:
    budget = F.when(
        _text_field(value, "budget") == V.UNLIMITED_BUDGET_TEXT, F.lit(float("inf"))
    ).otherwise(_allowed(_number_field(value, "budget"), V.BUDGET_OPTIONS[:-1]))
    minutes = _allowed(_number_field(value, "travelTimeLimit"), [float(m) for m in V.TIME_LIMITS_MINUTES])
    wide = _allowed(_text_field(value, "travelTimeLimit"), [V.TIME_LIMIT_WIDE])
    return F.struct(
        _allowed(_text_field(value, "category"), (V.ALL_CATEGORIES, *V.DISPLAY_CATEGORIES)).alias("category"),
        budget.alias("budget"),
        _allowed(_text_field(value, "travelMode"), V.TRAVEL_MODES).alias("travel_mode"),
        F.coalesce(wide, minutes.cast("int").cast("string")).alias("time_limit"),
    )


def _json_text(value: Column) -> Column:
    """A column as a JSON value, ``null`` when missing."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    return F.coalesce(F.nullif(F.regexp_extract(wrapped, r'(?s)^\{"v":(.*)\}$', 1), F.lit("")), F.lit("null"))


def serialize_preferences(category: Column, budget: Column, travel_mode: Column, time_limit: Column) -> Column:
    budget_text = F.when(budget == float("inf"), F.lit(f'"{V.UNLIMITED_BUDGET_TEXT}"')).otherwise(
        _json_text(F.when(budget == F.floor(budget), budget.cast("bigint")).cast("bigint"))
    )
    limit_text = F.when(time_limit == V.TIME_LIMIT_WIDE, _json_text(time_limit)).otherwise(
        _json_text(time_limit.try_cast("int"))
    )
    return F.concat(
        F.lit('{"category":'), _json_text(category),
        F.lit(',"budget":'), budget_text,
        F.lit(',"travelMode":'), _json_text(travel_mode),
        F.lit(',"travelTimeLimit":'), limit_text,
        F.lit("}"),
    )
