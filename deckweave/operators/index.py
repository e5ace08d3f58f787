"""The index table ``(idx, card_id, embedding)``: size, usable rows, copies."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deckweave.functions.vectors import is_placeholder

THRESHOLD = 0.15
SMALL_INDEX_BYTES = 128 << 20


def without_placeholders(index: DataFrame) -> DataFrame:
    """Index rows that can be matched: with a vector that is not all zeros."""
    return index.where(F.col("embedding").isNotNull() & ~is_placeholder(F.col("embedding")))


def index_bytes(index: DataFrame) -> int:
    """Size of the index with its ids, from one pass with partial sums."""
    kind = index.schema["embedding"].dataType.elementType
    width = 4 if isinstance(kind, T.FloatType) else 8
    size = F.coalesce(F.size("embedding"), F.lit(0)).cast("bigint") * width + 32
    for name in ("idx", "card_id"):
        size += F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0))
    return index.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def check_threshold(threshold: float) -> None:
    """From 0 up, a vector of length 0 never matches, and neither form has to look at it."""
    if threshold < 0:
        raise ValueError("the threshold must be 0 or more")


def hit_type(index: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("idx", index.schema["idx"].dataType),
            T.StructField("card_id", index.schema["card_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def usable(vectors: str) -> Column:
    """Not all zeros, and every element finite: only such vectors can score above 0."""
    infinity = F.lit(float("inf"))
    finite = F.forall(
        vectors, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < infinity), F.lit(False))
    )
    return finite & ~is_placeholder(F.col(vectors))


def collapse_copies(index: DataFrame) -> DataFrame:
    """One row per distinct vector, the first of its copies: later ones can only tie with it.

    Copies meet in map-side partial aggregates, so a third of the index being one vector costs
    no more than one row per task. The hash comes first in the key to keep comparisons short.
    """
    first = F.min(F.struct("idx", "card_id")).alias("first")
    return (
        index.groupBy(F.xxhash64("embedding").alias("key"), "embedding")
        .agg(first)
        .select("first.idx", "first.card_id", "embedding")
    )
