"""Text, address, price and link expressions.

Everything here is a Column expression evaluated in the JVM, except the two
Arrow helpers ``nfkc`` and ``decode_numeric_entities``: Spark has no built-in
for either. Ingest runs them once; later steps work on cleaned columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as V

# White space as text trimming and collapsing understand it.
SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# Whole runs of dropped characters at once: the same keys, fewer replacements.
_DROP = V.KEY_DROP + "+"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the
    body mentions it."""
    return F.transform(F.array(value), body)[0]


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode compatibility normalisation of one text column."""
    return values.str.normalize("NFKC")


@F.pandas_udf(T.StringType())
def decode_numeric_entities(values: pd.Series) -> pd.Series:
    """Replace ``&#65;`` and ``&#x41;`` by the character they stand for.

    Numbers that stand for none stay as text. Two entities of a surrogate pair
    are one character; a single surrogate becomes U+FFFD.
    """

    def character(base: int) -> Callable[[re.Match], str]:
        def decoded(match: re.Match) -> str:
            code = int(match.group(1), base)
            return chr(code) if code <= 0x10FFFF else match.group(0)

        return decoded

    def whole(value: str) -> str:
        return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    decimal = values.str.replace(r"&#0*([0-9]{1,7});", character(10), regex=True)
    return decimal.str.replace(r"&#[xX]0*([0-9a-fA-F]{1,6});", character(16), regex=True).map(whole, na_action="ignore")


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def clean_text(text: Column) -> Column:
    """NFKC and trim; a missing value becomes the empty string."""
    return trim_space(nfkc(F.coalesce(text.cast("string"), F.lit(""))))


def is_number(df: DataFrame, column: str) -> bool:
    """Whether a column holds numbers, not texts."""
    return isinstance(df.schema[column].dataType, T.NumericType)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def collapse_spaces(text: Column) -> Column:
    """Runs of white space become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def name_key(name: Column) -> Column:
    """Comparison key of a business or menu name (cleaned text expected)."""
    unmarked = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), V.COMPANY_MARKS, "")
    return F.regexp_replace(unmarked, _DROP, "")


def address_key(address: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(address, F.lit(""))), _DROP, "")


def home_address_key(address: Column) -> Column:
    """Address key that ignores the home region's name."""
    lowered = F.lower(F.coalesce(address, F.lit("")))
    return F.regexp_replace(F.regexp_replace(lowered, V.HOME_REGION_WORDS, ""), _DROP, "")


def _without_parentheses(address: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(address, F.lit(""))), V.PARENTHESES, "")


def region_address_key(address: Column) -> Column:
    """Address key with long region names folded to their short form."""
    text = _without_parentheses(address)
    for pattern, short in V.REGION_ALIASES:
        text = F.regexp_replace(text, pattern, short)
    return address_key(text)


def road_core(address: Column) -> Column:
    """Road name plus building number, '' when the address has none."""
    text = _without_parentheses(address)
    pattern = V.ROAD_CORE.replace(r"\s", SPACE)
    return address_key(
        F.concat(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2))
    )


def same_address(left_key: Column, left_core: Column, right_key: Column, right_core: Column) -> Column:
    """Address compatibility from precomputed region keys and road cores."""
    present = (F.length(left_key) > 0) & (F.length(right_key) > 0)
    prefix = (F.least(F.length(left_key), F.length(right_key)) >= V.MIN_PREFIX_ADDRESS_LENGTH) & (
        left_key.startswith(right_key) | right_key.startswith(left_key)
    )
    core = (F.length(left_core) > 0) & (left_core == right_core)
    return present & ((left_key == right_key) | core | prefix)


def addresses_compatible(left: Column, right: Column) -> Column:
    return same_address(
        region_address_key(left), road_core(left), region_address_key(right), road_core(right)
    )


def strip_markup(text: Column, numeric_entities: bool = True) -> Column:
    """Decode entities, then drop tags, then trim.

    ``numeric_entities=False`` skips the Arrow step for sources known not to
    use them.
    """
    decoded = F.coalesce(text, F.lit(""))
    for pattern, character in V.MARKUP_ENTITIES:
        decoded = F.regexp_replace(decoded, pattern, character)
    if numeric_entities:
        # Only rows that have such an entity take the way through Python with their text.
        decoded = F.coalesce(decode_numeric_entities(F.when(decoded.contains("&#"), decoded)), decoded)
    return trim_space(F.regexp_replace(decoded, V.MARKUP_TAG, ""))


def parse_price(value: Column, numeric: bool = False) -> Column:
    """Whole price from a number or a text such as ``8,000원``; else NULL."""
    if numeric:
        amount = F.when(F.abs(value.cast("double")) < float("inf"), value.cast("double"))
    else:
        plain = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), ",", "")
        amount = F.regexp_extract(plain, r"\d+(?:\.\d+)?", 0).try_cast("double")
    return F.when(amount > 0, F.floor(amount + 0.5).cast("bigint"))


def source_category(category: Column) -> Column:
    """Source-A business type to one of the source categories, else NULL."""

    def choose(key: Column) -> Column:
        other = key == V.CATEGORY_OTHER_EXACT
        for word in V.CATEGORY_OTHER_WORDS:
            other = other | key.contains(word)
        starts = [F.when(key.startswith(word), F.lit(word)) for word in V.CATEGORY_PREFIXES]
        return F.coalesce(*starts, F.when(other, V.OTHER_SOURCE_CATEGORY))

    return bound(name_key(category), choose)


def find_district(*texts: Column) -> Column:
    joined = F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts])
    found = F.regexp_extract(joined, V.DISTRICTS, 1)
    return F.coalesce(blank_to_null(found), F.lit(V.DEFAULT_DISTRICT))


def _joined_keys(*parts: Column) -> Column:
    return F.concat_ws("|", *[name_key(part) for part in parts])


def source_key(province: Column, district: Column, name: Column, address: Column) -> Column:
    return _joined_keys(province, district, name, address)


def name_address_key(name: Column, address: Column) -> Column:
    return _joined_keys(name, address)


def phone_key(province: Column, district: Column, name: Column, phone: Column) -> Column:
    present = F.length(F.coalesce(phone, F.lit(""))) > 0
    return F.when(present, _joined_keys(province, district, name, phone))


def name_district_key(province: Column, district: Column, name: Column) -> Column:
    return _joined_keys(province, district, name)


def record_id(key: Column) -> Column:
    """Stable 20-character id of a source key."""
    return F.substring(F.sha2(key, 256), 1, 20)


def search_queries(name: Column, province: Column) -> Column:
    """Distinct non-empty search texts, most specific first."""
    filled = lambda c: blank_to_null(F.coalesce(c, F.lit("")))
    texts = F.array(F.concat_ws(" ", filled(name), filled(province)), F.coalesce(name, F.lit("")))
    return F.array_distinct(F.filter(texts, lambda t: F.length(t) > 0))


def secure_url(url: Column) -> Column:
    return F.regexp_replace(url, "^http:", "https:")


def url_component(text: Column) -> Column:
    """Percent-encoding of one URL component (form encoding put right)."""
    encoded = F.url_encode(text)
    for code, character in (
        (r"\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"),
    ):
        encoded = F.regexp_replace(encoded, code, character)
    return encoded


def map_link(url: Column, place_id: Column, name: Column, district: Column) -> Column:
    """Link of a place: its own page, its id page, else a search page."""
    return F.coalesce(
        url,
        F.concat(F.lit(V.MAP_LINK_PREFIX), blank_to_null(place_id)),
        F.concat(F.lit(V.MAP_SEARCH_PREFIX), url_component(F.concat_ws(" ", name, district))),
    )
