"""Captured pages: scan, acceptance, collections, variation views."""

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deckweave import schemas
from deckweave.functions import numbers, text

# The collections whose pages are captured.
COLLECTIONS = (
    "https://www.ligapokemon.com.br/?view=cards/search&card=edid=769%20ed=POR",
    "https://www.ligapokemon.com.br/?view=cards/search&card=edid=754%20ed=ASC",
    "https://www.ligapokemon.com.br/?view=cards/search&card=edid=738%20ed=PFL",
    "https://www.ligapokemon.com.br/?view=cards/search&card=edid=730%20ed=MEG",
    "https://www.ligapokemon.com.br/?view=cards/search&card=edid=722%20ed=WHT",
    "https://www.ligapokemon.com.br/?view=cards/search&card=edid=721%20ed=BLK",
    "https://www.ligapokemon.com.br/?view=cards/search&card=edid=706%20ed=DRI",
    "https://www.ligapokemon.com.br/?view=cards/search&card=edid=654%20ed=JTG",
    "https://www.ligapokemon.com.br/?view=cards/search&card=edid=649%20ed=PRE",
    "https://www.ligapokemon.com.br/?view=cards/search&card=edid=639%20ed=SSP",
    "https://www.ligapokemon.com.br/?view=cards/search&card=edid=633%20ed=SV8",
    "https://www.ligapokemon.com.br/?view=cards/search&card=edid=612%20ed=SCR",
)

# Fixed value: the error of a page that was refused.
STATUS_ERROR = "Response status code != 200"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages ``(url, status, html)`` from Parquet."""
    return spark.read.schema(schemas.CAPTURED_PAGE).parquet(path)


def accepted(pages: DataFrame) -> DataFrame:
    """Pages that answered with status 200."""
    return pages.where(F.col("status") == 200)


def rejected(pages: DataFrame) -> DataFrame:
    """The other pages, with an error text; a page without a status is rejected too."""
    failed = ~F.coalesce(F.col("status") == 200, F.lit(False))
    return pages.where(failed).withColumn("error", F.lit(STATUS_ERROR))


def has_card_content(page: Column | str) -> Column:
    """True where the page carries the card table or mentions a card in any case."""
    return F.contains(page, F.lit("cardsjson")) | F.contains(F.lower(page), F.lit("card"))


def collection_list(spark: SparkSession, urls: Iterable[str] = COLLECTIONS) -> DataFrame:
    """The collections to process, as a table of addresses.

    Made from Arrow, as a local relation whose size the planner knows; a table made from Python
    rows has no known size, and a join with it would shuffle the pages.
    """
    return spark.createDataFrame(pa.table({"url": pa.array(list(urls), pa.string())}))


def in_collections(rows: DataFrame, collections: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key is listed.

    The list is not hinted: Spark broadcasts it if its size allows and shuffles otherwise.
    """
    return rows.join(collections.select(key), key, "left_semi")


def pages_of_set(pages: DataFrame, url: str) -> DataFrame:
    """Captured page of one collection."""
    return pages.where(F.col("url") == url)


def variation_pages(
    pages: DataFrame, variation: str = "alta", period: str = "semana"
) -> DataFrame:
    """Gainers (``alta``) or losers (``queda``) pages of a period (``dia, semana, mes``)."""
    if period not in numbers.PERIOD_CODES:
        raise ValueError(f"unknown period: {period}")
    if variation not in numbers.VARIATIONS:
        raise ValueError(f"unknown variation: {variation}")
    code = str(numbers.PERIOD_CODES[period])
    return pages.where(
        (text.url_parameter("url", "show") == variation)
        & (text.url_parameter("url", "order") == code)
    )
