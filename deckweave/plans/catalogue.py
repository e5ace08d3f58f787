"""Catalogue jobs: the flat card table, a page of cards, the card view."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckweave.functions import numbers, text
from deckweave.operators import frames, joins
from deckweave.sources import catalogue as card_source
from deckweave.sources import sets as set_source


def set_cards(sets: DataFrame) -> DataFrame:
    """One row per card brief of a set, as struct ``brief`` beside the set's scalar fields.

    Set fields are named ``set_*``. A set without cards gives no row.
    """
    fields = frames.scalar_fields(sets, prefix="set_")
    return sets.select(*frames.merged_record(fields), F.explode("cards").alias("brief"))


def with_full_card(briefs: DataFrame, card_details: DataFrame, even: bool | None = None) -> DataFrame:
    """Every brief with its card's full record as struct ``card``; briefs without one go.

    An equi-join on the card id. One card may be in very many sets: adaptive execution splits its
    partition where its skew join is on, else (or with ``even``) heavy cards are found by counting,
    their briefs dealt out by set and their details copied.
    """
    full = card_details.select(F.struct(*card_details.columns).alias("card"))
    if even is None:
        even = not joins.skew_join_is_on(briefs)
    if not even:
        return briefs.join(full, F.col("brief.id") == F.col("card.id"), "inner")
    apart = F.struct(*[c for c in briefs.columns if c != "brief"], "brief.id")
    return joins.join_even(briefs, full, F.col("brief.id"), F.col("card.id"), apart)


def catalogue_flat(
    sets: DataFrame,
    card_details: DataFrame,
    first: int | None = None,
    quality: str = "low",
    extension: str = "png",
    with_image_path: bool = False,
    even: bool | None = None,
) -> DataFrame:
    """One flat row per card of the listed sets.

    Set scalars as ``set_*``, then card scalars, ``image_url``, if wanted ``image_path``, and
    the variants' scalars as ``variants_*``. Nested fields vanish. A name met twice keeps its
    first place and its last value. All sets are taken, or the newest ``first``. ``even`` is that of
    ``with_full_card``.
    """
    if first is None:
        chosen = sets.where(F.col("serie.id") != set_source.EXCLUDED_SERIES)
    else:
        chosen = set_source.first_sets(set_source.set_listing(sets), first)
    joined = with_full_card(set_cards(chosen), card_details, even)
    set_fields = {c: F.col(c) for c in joined.columns if c not in ("brief", "card")}
    images: dict[str, Column] = {
        "image_url": text.image_url(F.col("card.image"), quality, extension)
    }
    if with_image_path:
        images["image_path"] = text.image_path(
            F.col("set_releaseDate").cast("string"),
            F.col("set_id").cast("string"),
            F.col("card.id").cast("string"),
            quality,
            extension,
        )
    cards = frames.scalar_fields(joined, "card")
    variants = {}
    if "variants" in card_details.columns:
        lifted = card_details.select("variants")
        variants = {
            name: F.col("card.variants").getField(name.removeprefix("variants_"))
            for name in frames.scalar_fields(lifted, "variants", "variants_")
        }
    return joined.select(*frames.merged_record(set_fields, cards, images, variants))


def catalogue_page(
    cards: DataFrame,
    condition: Column | None = None,
    page: int = 1,
    size: int = 5,
    fallback: DataFrame | None = None,
    order: str = "id",
) -> DataFrame:
    """One page of the cards under a condition, with the counts beside the rows.

    The condition reaches the scan. With a fallback, its rows are given whole where the page
    has none.
    """
    chosen = cards if condition is None else cards.where(condition)
    rows = frames.page_of(chosen, page, size, order)
    return rows if fallback is None else card_source.with_fallback(rows, fallback)


def catalogue_page_after(
    cards: DataFrame,
    last: dict | None = None,
    condition: Column | None = None,
    size: int = 5,
    order: Sequence[str] = ("id",),
) -> DataFrame:
    """The page of cards behind the row ``last``, in place of a page's number; the first one without it.

    The conditions on the cards and on the place reach the scan, and each task sends one page at
    most, however deep the page lies. ``last`` is ``frames.last_key`` of the page before.
    """
    chosen = cards if condition is None else cards.where(condition)
    return frames.page_after(chosen, last, size, order)


def card_view(cards: DataFrame, score: Column | None = None) -> DataFrame:
    """What a card's view shows, one text per part; parts that are absent are null."""
    price = numbers.preferred_price(F.col("tcgplayer.prices"))
    return cards.select(
        F.col("id"),
        F.col("images.large").alias("image"),
        text.percent_match(F.lit(None).cast("double") if score is None else score).alias("match"),
        F.col("name"),
        text.type_line(F.col("supertype"), F.col("subtypes")).alias("type_line"),
        text.number_line(F.col("number"), F.col("set.printedTotal")).alias("number_line"),
        text.or_none(F.col("set.images.symbol")).alias("set_symbol"),
        F.col("set.name").alias("set_name"),
        text.or_default(F.col("artist"), "Unknown").alias("artist"),
        text.or_default(F.col("rarity"), "Common").alias("rarity"),
        text.money_text(price).alias("price"),
    )
