"""Market job: captured pages to rows, rows to clean rows, clean rows to a summary."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deckweave import schemas
from deckweave.functions import numbers, text
from deckweave.operators import frames
from deckweave.session import cut_lineage
from deckweave.sources import pages as page_source

# New names of the market fields. Both rarity codes become one column.
RENAMES = {
    "sSigla": "colecao",
    "id": "id",
    "sN": "num",
    "nEN": "nome_en",
    "nPT": "nome_pt",
    "p1a": "preco_min",
    "p1b": "preco_mean",
    "p1c": "preco_max",
    "iR": "num_raridade",
    "sP": "path_img",
    "dt": "date",
    "ed_sNome": "colecao_nome_en",
    "iRaridade": "num_raridade",
    "raridade": "raridade",
    "varianciaSemFormat": "preco_variacao",
    "sNomeIngles": "nome_en2",
    "sNomePortugues": "nome_pt2",
}

SUMMED = ("preco_min", "preco_mean", "preco_max")
MEANS = tuple(f"{name}_mean" for name in SUMMED)


def page_rows(pages: DataFrame, row: T.StructType = schemas.MARKET_ROW) -> DataFrame:
    """Rows of the tables embedded in pages, with their page's address, in one job.

    A byte search for the marker comes before the expression that decodes the page.
    """
    carrying = pages.where(F.contains("html", F.lit(text.TABLE_MARKER)))
    rows = carrying.select("url", F.inline(text.embedded_rows("html", row)))
    return rows.select(*[c for c in rows.columns if c != "url"], "url")


def market_rows(
    pages: DataFrame, collections: DataFrame | None = None, row: T.StructType = schemas.MARKET_ROW
) -> DataFrame:
    """Raw market rows of accepted pages, of all collections or of the listed ones.

    A page that carries the table passes ``has_card_content`` by that alone, so the test of the
    whole page in lower case is not made again.
    """
    good = page_source.accepted(pages)
    if collections is not None:
        good = page_source.in_collections(good, collections)
    return page_rows(good, row)


def raw_records(pages: DataFrame, collections: DataFrame | None = None) -> DataFrame:
    """Rows of the tables of accepted pages as ``url, record``, all their fields as texts by name.

    Of a repeated field the last value counts. Elements that are not objects spoil their table, as
    broken JSON does.
    """
    good = page_source.accepted(pages)
    if collections is not None:
        good = page_source.in_collections(good, collections)
    carrying = good.where(F.contains("html", F.lit(text.TABLE_MARKER)))
    # The outer form, as the other makes Spark parse each table again to see whether it is empty.
    records = carrying.select("url", F.explode_outer(text.embedded_records("html")).alias("record"))
    found = records.where(F.col("record").isNotNull())
    return found.select("url", text.last_entries(F.col("record")).alias("record"))


def raw_rows(pages: DataFrame, collections: DataFrame | None = None) -> DataFrame:
    """Market rows of accepted pages with all fields that any of them has, as texts, and ``url``.

    Fields of the declared row come first, the others in the order of their names, ``url`` is the
    page's. Names that differ only in case are columns of their own (``frames.distinct_names``:
    ``id``, ``ID_2``), as Spark takes them for one; declared names keep theirs. Pages are parsed once:
    their records are written, and names are found in the keys alone. There may be any number of
    names; the columns of a frame are in the driver by nature, ``raw_fields`` needs none.
    """
    records = cut_lineage(raw_records(pages, collections), "records")
    names = records.select(F.explode(F.map_keys("record")).alias("name")).distinct()
    found = {row.name for row in names.toLocalIterator()} - {"url"}
    known = [name for name in schemas.MARKET_ROW.fieldNames() if name in found]
    return frames.map_columns(records, "record", known + sorted(found - set(known)), "url")


def raw_fields(pages: DataFrame, collections: DataFrame | None = None) -> DataFrame:
    """The same in long form, ``url, row, field, value``, where names are data: one row a field.

    ``row`` tells the rows of one job apart and means nothing else.
    """
    records = raw_records(pages, collections).withColumn("row", F.monotonically_increasing_id())
    return records.select("url", "row", F.explode("record").alias("field", "value"))


def variation_rows(
    pages: DataFrame, variation: str = "alta", period: str = "semana"
) -> DataFrame:
    """Raw market rows of a gainers or losers view."""
    chosen = page_source.variation_pages(page_source.accepted(pages), variation, period)
    return page_rows(chosen)


def set_rows(pages: DataFrame, url: str) -> DataFrame:
    """Raw market rows of one collection's page."""
    return page_rows(page_source.pages_of_set(page_source.accepted(pages), url))


def market_clean(raw: DataFrame, date_pattern: str | None = None, lenient: bool = False) -> DataFrame:
    """Entities resolved, fields renamed and chosen, prices as numbers, dates without time."""
    names = set(RENAMES)
    # Fields that are dropped later are dropped first, so their texts are not unescaped.
    fields = raw.select(*[c for c in raw.columns if c in names or c in RENAMES.values()])
    clean = frames.map_texts_together(fields, text.unescape_html)
    clean = frames.keep_columns(frames.rename_present(clean, RENAMES), RENAMES.values())
    clean = frames.cast_columns(clean, frames.columns_matching(clean, "preco"), "double", lenient)
    return frames.to_dates(clean, ["date"], date_pattern) if "date" in clean.columns else clean


def partial_totals(market: DataFrame, *keys: str) -> DataFrame:
    """Counts, first date and sums by any keys, to be added up by ``collection_totals``.

    Used before a join that brings in the collection: rows of one key are then added up before
    the shuffle, and a key with a third of all rows crosses it as one row per task.
    """
    sums = [F.sum(numbers.nan_to_null(F.col(c))).alias(c) for c in SUMMED]
    return market.groupBy(*keys).agg(
        F.count("id").alias("num_cards"), F.min("date").alias("date"), *sums
    )


def add_totals(partial: DataFrame) -> DataFrame:
    """Totals per collection of partial totals. Null collections are dropped."""
    return (
        partial.where(F.col("colecao").isNotNull())
        .groupBy("colecao")
        .agg(
            F.sum("num_cards").alias("num_cards"),
            F.min("date").alias("date"),
            *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in SUMMED],
        )
    )


def collection_totals(market: DataFrame) -> DataFrame:
    """Per collection: cards with an id, first date, sums of the three prices.

    Null collections are dropped; null and NaN prices are skipped and a sum of none is 0.
    """
    named = market.where(F.col("colecao").isNotNull())
    totals = partial_totals(named, "colecao")
    return totals.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in SUMMED})


def by_newest(totals: DataFrame) -> DataFrame:
    """Collections by date, newest first, undated ones last, ties by name."""
    return totals.orderBy(F.desc_nulls_last("date"), "colecao")


def with_means(totals: DataFrame) -> DataFrame:
    """Sum over number of cards, for each price; null for a collection without cards."""
    cards = F.nullif(F.col("num_cards"), F.lit(0))
    return totals.withColumns({f"{c}_mean": F.col(c) / cards for c in SUMMED})


def rounded(df: DataFrame, digits: int = 1) -> DataFrame:
    """Every floating-point column rounded half to even."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: numbers.round_half_even(F.col(c), digits) for c in floats})


def summary_of(totals: DataFrame, digits: int | None = None) -> DataFrame:
    """Means and order for totals; rounded where digits are given."""
    summary = with_means(totals)
    return by_newest(summary if digits is None else rounded(summary, digits))


def collection_summary(market: DataFrame, digits: int | None = None) -> DataFrame:
    """Price summary of the collections, newest first."""
    return summary_of(collection_totals(market), digits)


def chart_rows(summary: DataFrame) -> DataFrame:
    """The columns of the bar chart: collection and three means."""
    return summary.select("colecao", *MEANS)
