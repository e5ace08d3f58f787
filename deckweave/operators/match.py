"""Best match of query vectors in an index: exact cosine, top one, above a threshold.

Tables: ``queries(query_id, embedding, …)`` and ``index(idx, card_id, embedding)``, where
``idx`` orders the index and settles ties. Two physical forms give the same rows:

* ``match_small_index``: the index is measured, fits the bound, and goes to every worker. The
  queries are not shuffled at all; each Arrow batch is one matrix product.
* ``match_large_index``: the index is split into cells around pivots. The triangle inequality
  on angles tells which cells can hold a better vector, so a query visits only those (``cells``).

``match`` measures the index and chooses.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckweave.operators import nearest
from deckweave.operators.cells import BLOCK_BYTES, PIVOTS, CellIndex
from deckweave.operators.index import (
    SMALL_INDEX_BYTES,
    THRESHOLD,
    check_threshold,
    hit_type,
    index_bytes,
    without_placeholders,
)


def above(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Scores strictly above the threshold; null and NaN are not."""
    return scored.where(~F.isnan("score") & (F.col("score") > threshold))


def best_per_query(scored: DataFrame) -> DataFrame:
    """Top score per query of ``(query_id, idx, card_id, score)`` rows, ties to the first idx.

    An aggregation and not a window: map tasks send one row per query. Scores that are null,
    NaN or -1 and below never win.
    """
    valid = scored.where(~F.isnan("score") & (F.col("score") > -1))
    rank = F.struct((-F.col("score")).alias("order"), "idx", "card_id")
    best = valid.groupBy("query_id").agg(F.min(rank).alias("hit"))
    return best.select("query_id", "hit.idx", "hit.card_id", (-F.col("hit.order")).alias("score"))


def keep_unmatched(queries: DataFrame, best: DataFrame) -> DataFrame:
    """Every query once, with its best row or nulls, and whether it was matched."""
    joined = queries.select("query_id").join(best, "query_id", "left")
    return joined.withColumn("matched", F.col("card_id").isNotNull())


def with_card(matches: DataFrame, cards: DataFrame, key: str = "card_id") -> DataFrame:
    """Matches with the columns of their card; unmatched queries stay.

    Only rows with a card id are joined. The others, which may be most, get null columns where
    they are: in a join their null key would bring all of them into one task.
    """
    found = matches.where(F.col(key).isNotNull()).join(cards, key, "left")
    return found.unionByName(matches.where(F.col(key).isNull()), allowMissingColumns=True)


def match(
    queries: DataFrame,
    index: DataFrame,
    threshold: float = THRESHOLD,
    small_bytes: int = SMALL_INDEX_BYTES,
) -> DataFrame:
    """``(query_id, idx, card_id, score, matched)``, one row per query row, repeated ids or not."""
    index = index.select("idx", "card_id", "embedding")
    size = index_bytes(index)
    if size <= min(small_bytes, SMALL_INDEX_BYTES):
        return match_small_index(queries, index, threshold, size=size)
    return match_large_index(queries, index, threshold)


def hit_column(
    index: DataFrame, threshold: float = THRESHOLD, query: str = "embedding", size: int | None = None
) -> Column:
    """``struct<idx, card_id, score>`` of the best match of a vector column, for a small index.

    A map over rows, so it works on streams as on tables; other columns stay in the JVM. An index
    beyond ``SMALL_INDEX_BYTES`` is refused, as it would go to every worker.
    """
    check_threshold(threshold)
    index = index.select("idx", "card_id", "embedding")
    if size is None:
        size = index_bytes(index)
    if size > SMALL_INDEX_BYTES:
        raise ValueError(f"an index of {size} bytes is too large to send to every worker; use match")
    rows = nearest.IndexRows(without_placeholders(index).toArrow())
    shared: Broadcast = index.sparkSession.sparkContext.broadcast(rows)

    @F.arrow_udf(hit_type(index))
    def hit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            yield nearest.hits(shared.value, vectors, threshold)

    return hit(query)


def match_small_index(
    queries: DataFrame,
    index: DataFrame,
    threshold: float = THRESHOLD,
    carry: tuple[str, ...] = (),
    size: int | None = None,
) -> DataFrame:
    """Best match with the whole index at every worker; ``carry`` names columns to keep."""
    hits = queries.select("query_id", *carry, hit_column(index, threshold, size=size).alias("hit"))
    return hits.select(
        "query_id", *carry, "hit.idx", "hit.card_id", "hit.score", F.col("hit.score").isNotNull().alias("matched")
    )


def match_large_index(
    queries: DataFrame,
    index: DataFrame,
    threshold: float = THRESHOLD,
    pivots: int = PIVOTS,
    block_bytes: int = BLOCK_BYTES,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Best match with an index of any size. To search one index again, keep a ``CellIndex``."""
    return CellIndex(index, pivots, block_bytes).match(queries, threshold, carry)
