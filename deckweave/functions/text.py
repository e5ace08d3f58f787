"""Text helpers, all of them Column expressions."""

import json
from html.entities import html5
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deckweave.functions.numbers import fixed

# The assignment that carries the table in a captured page.
TABLE_MARKER = "var cardsjson = ["
TABLE_PATTERN = r"(?s)var cardsjson = (\[.*?\]);"

# Spark accepts single quotes unless told not to; browsers and the standard library do not.
STRICT_JSON = {"allowSingleQuotes": "false"}

# The address of the gainers and losers pages.
VARIATION_URL = "https://www.ligapokemon.com.br/?view=cards/variacao&show=%s&formato=&order=%d"


def embedded_json(page: Column | str, pattern: str = TABLE_PATTERN) -> Column:
    """Text of the first embedded table; ``''`` where the page has none."""
    return F.regexp_extract(page, pattern, 1)


def json_rows(text: Column, row: T.StructType) -> Column:
    """Parse a JSON array into typed rows; broken JSON gives null."""
    return F.from_json(text, T.ArrayType(row), STRICT_JSON)


def embedded_records(page: Column | str) -> Column:
    """The table embedded in a page with every field of its rows as a text, by name."""
    return F.from_json(embedded_json(page), "array<map<string, string>>", STRICT_JSON)


def last_entries(record: Column) -> Column:
    """A map with the last value of each key, as parsers of JSON objects give it.

    Maps from ``from_json`` keep all entries of a repeated key; those without one stay as they are.
    """
    keys, count = F.map_keys(record), F.size(F.map_keys(record))
    last = F.filter(
        F.map_entries(record),
        lambda entry, i: ~F.exists(F.slice(keys, i + 2, count), lambda later: later == entry["key"]),
    )
    return F.when(F.size(F.array_distinct(keys)) == count, record).otherwise(F.map_from_entries(last))


def embedded_rows(page: Column | str, row: T.StructType) -> Column:
    """Rows of the table embedded in a page, null where there is none or its JSON is broken.

    A ``];`` inside a string ends the match early and leaves broken JSON, so such a page has
    no rows; of several tables the first is taken.
    """
    return json_rows(embedded_json(page), row)


# What html.unescape takes for a reference: numbers, or a name of up to 32 characters.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_BUCKETS = 4096


def _name_table() -> Column:
    """The names of the standard library's table, in buckets by checksum, as one literal."""
    buckets: list[list[dict]] = [[] for _ in range(_BUCKETS)]
    for name, characters in html5.items():
        buckets[crc32(name.encode()) % _BUCKETS].append({"k": name, "v": characters})
    return F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<k: string, v: string>>>")


def _code_point(number: Column) -> Column:
    """The character of a number by the HTML standard: some stand for others, some for nothing."""
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    # Bytes of the Windows character set were once written as numbers.
    western = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))
    last = number.bitwiseAND(0xFFFF)
    nothing = (
        number.between(0x1, 0x8) | (number == 0xB) | number.between(0xE, 0x1F) | (number == 0x7F)
        | number.between(0xFDD0, 0xFDEF) | (last >= 0xFFFE)
    )
    return (
        F.when((number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), "\ufffd")
        .when(number.between(0x80, 0x9F), F.substring(F.lit(western), (number - 0x7F).cast("int"), F.lit(1)))
        .when(nothing, "")
        .otherwise(plain)
    )


def _resolved(reference: Column, names: Column) -> Column:
    """The text of one reference; one that means nothing stays as it is."""

    digits = F.regexp_extract(reference, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
    base = F.when(reference.rlike("^&#[xX]"), 16).otherwise(10)
    # No code point has more than seven digits.
    number = F.when(F.length(digits) > 7, F.lit(0x110000).cast("bigint")).otherwise(
        F.coalesce(
            F.when(base == 16, F.conv(F.concat(F.lit("0"), digits), 16, 10)).otherwise(F.concat(F.lit("0"), digits)).cast("bigint"),
            F.lit(0),
        )
    )
    name = F.substring(reference, F.lit(2), F.length(reference))

    def begun(n: Column) -> Column:
        """The reference with its first ``n`` letters as a name, null where they are none."""
        first = F.substring(name, F.lit(1), n)
        bucket = F.get(names, (F.crc32(F.encode(first, "UTF-8")) % _BUCKETS).cast("int"))
        known = F.get(F.filter(bucket, lambda e: e["k"] == first), F.lit(0))["v"]
        return F.when(n <= F.length(name), F.concat(known, F.substring(name, n + 1, F.length(name))))

    # Old names need no semicolon, and the longest that begins the reference counts; they have 2 to 6 letters.
    # The first that is known ends the search, which is the whole name for all but the oldest texts.
    known = F.coalesce(begun(F.length(name)), *[begun(F.lit(n)) for n in range(6, 1, -1)])
    return F.when(reference.startswith("&#"), _code_point(number)).otherwise(F.coalesce(known, reference))


def unescape_html(text: Column | str) -> Column:
    """Resolve HTML references as the standard library does; null stays null.

    Column expressions alone: the text is cut at its references, each is looked up, and the parts
    are put together again. Texts without ``&`` are passed on.
    """
    value = F.col(text) if isinstance(text, str) else text
    names = _name_table()
    gaps = F.split(value, _REFERENCE)
    found = F.transform(F.regexp_extract_all(value, F.lit(_REFERENCE), F.lit(0)), lambda r: _resolved(r, names))
    joined = F.array_join(F.flatten(F.zip_with(gaps, found, lambda g, r: F.array(g, F.coalesce(r, F.lit(""))))), "")
    return F.when(F.contains(value, F.lit("&")), joined).otherwise(value)


def percent_match(score: Column) -> Column:
    """``12.3% Match``, null where there is no score."""
    return F.concat(fixed(score * 100, 1), F.lit("% Match"))


def money_text(price: Column) -> Column:
    """``$1.50 (Market)``, null where there is no price."""
    return F.concat(F.lit("$"), fixed(price, 2), F.lit(" (Market)"))


def type_line(supertype: Column, subtypes: Column) -> Column:
    """``Supertype - first, second``; null where either is null.

    A null inside the array counts as an empty text, as it does when arrays are joined in the
    browser.
    """
    return F.concat(supertype, F.lit(" - "), F.array_join(subtypes, ", ", ""))


def number_line(number: Column, printed_total: Column) -> Column:
    """``4/102``."""
    return F.concat(number, F.lit("/"), printed_total.cast("string"))


def image_url(
    base: Column, quality: str = "low", extension: str = "png", template: str = "%s/%s.%s"
) -> Column:
    """Image address from quality and extension. The format is the catalogue's own, so it can
    be replaced."""
    return F.when(base.isNotNull(), F.format_string(template, base, F.lit(quality), F.lit(extension)))


def image_path(
    release_date: Column, set_id: Column, card_id: Column, quality: str = "low", extension: str = "png"
) -> Column:
    """``images/{release date}_{set}_{card}_{quality}.{extension}``."""
    stem = F.concat(release_date, F.lit("_"), set_id, F.lit("_"), card_id)
    return F.concat(F.lit("images/"), stem, F.lit(f"_{quality}.{extension}"))


def variation_url(variation: Column, period_code: Column) -> Column:
    """Address of a gainers or losers page."""
    return F.format_string(VARIATION_URL, variation, period_code)


def or_default(text: Column, default: str) -> Column:
    """The text, or a default where it is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def or_none(text: Column) -> Column:
    """The text, or null where it is null or empty."""
    return F.nullif(text, F.lit(""))


def leading_text(text: Column, length: int) -> Column:
    """First characters of a text, used in error reports (50 and 200)."""
    return F.substring(text, 1, length)


def url_parameter(url: Column | str, name: str) -> Column:
    """A parameter of an address; null where it is missing or the address is malformed."""
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))


def data_url_bytes(url: Column) -> Column:
    """Bytes of a base64 data URL."""
    return F.unbase64(F.substring_index(url, ",", -1))
