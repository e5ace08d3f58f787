"""Set listing and card details."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXCLUDED_SERIES = "tcgp"


def set_listing(sets: DataFrame, excluded: str = EXCLUDED_SERIES) -> DataFrame:
    """Sets of every series but one, newest first. Sets without a series are left out."""
    return newest_first(sets.where(F.col("serie.id") != excluded))


def newest_first(sets: DataFrame) -> DataFrame:
    return sets.orderBy(F.desc_nulls_last("releaseDate"), "id")


def first_sets(sets: DataFrame, count: int) -> DataFrame:
    """The first sets of a listing; sort and limit become one top-k."""
    return sets.limit(count)


def card_detail(card_details: DataFrame, card_id: str) -> DataFrame:
    """Full record of one card."""
    return card_details.where(F.col("id") == card_id)
