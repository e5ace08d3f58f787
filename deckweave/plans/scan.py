"""Image jobs: build the index once, match query images against it."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckweave.functions.vectors import PLACEHOLDER_LENGTH, or_placeholder
from deckweave.operators import match as matching
from deckweave.operators.mapping import embed
from deckweave.session import cut_lineage

# The two answers for an image without a card.
NO_MATCH = "No matching card found."
FAILED = "Failed to scan image."


def build_index(
    cards: DataFrame,
    factory: Callable[[], Callable],
    image: Column | str,
    card_id: str = "id",
    order: str = "id",
    length: int = PLACEHOLDER_LENGTH,
) -> DataFrame:
    """Index ``(idx, card_id, embedding, error)`` of catalogue images.

    ``order`` is the column whose order settles ties. A card that cannot be embedded gets a
    vector of zeros, which no query matches. Write the result once and match from the copy.
    """
    made = cards.select(
        F.col(order).alias("idx"), F.col(card_id).alias("card_id"), embed(image, factory).alias("made")
    )
    return made.select(
        "idx",
        "card_id",
        or_placeholder(F.col("made.embedding"), length).alias("embedding"),
        F.col("made.error").alias("error"),
    )


def embed_queries(
    images: DataFrame, factory: Callable[[], Callable], image: Column | str, query_id: str
) -> DataFrame:
    """Query vectors ``(query_id, embedding, error)``; a failing image has no vector."""
    made = images.select(F.col(query_id).alias("query_id"), embed(image, factory).alias("made"))
    return made.select("query_id", "made.embedding", "made.error")


def match_images(
    images: DataFrame,
    index: DataFrame,
    factory: Callable[[], Callable],
    image: Column | str,
    query_id: str,
    threshold: float = matching.THRESHOLD,
) -> DataFrame:
    """Best card of every image, one row each:
    ``(query_id, idx, card_id, score, matched, error, message)``.

    ``message`` tells a failed image from one without a match. The index is written first, as it
    is read more than once and may come from a model; the model runs once per image and card.
    """
    queries = embed_queries(images, factory, image, query_id)
    index = cut_lineage(index.select("idx", "card_id", "embedding"), "index")
    return scan_results(queries, index, threshold)


def scan_results(
    queries: DataFrame,
    index: DataFrame,
    threshold: float = matching.THRESHOLD,
    small_bytes: int = matching.SMALL_INDEX_BYTES,
) -> DataFrame:
    """Results for query vectors ``(query_id, embedding, error)``, one row per query row.

    ``message`` says why there is no card; an image that failed spoils no other.
    """
    size = matching.index_bytes(index)
    if size <= min(small_bytes, matching.SMALL_INDEX_BYTES):
        found = matching.match_small_index(queries, index, threshold, ("error",), size)
    else:
        found = matching.match_large_index(queries, index, threshold, carry=("error",))
    return with_message(found)


def with_message(found: DataFrame) -> DataFrame:
    message = F.when(F.col("error").isNotNull(), FAILED).when(~F.col("matched"), NO_MATCH)
    return found.select(
        "query_id", "idx", "card_id", "score", "matched", "error", message.alias("message")
    )
