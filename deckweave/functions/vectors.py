"""Vector helpers on array columns. Arithmetic is in double, whatever the array holds."""

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER_LENGTH = 768


def reductions(query: Column, other: Column) -> Column:
    """Dot product and both squared lengths in one pass over the query's length.

    Elements of ``other`` beyond the query's length are ignored, also in its own length; where
    it is shorter the sums are null.
    """
    pairs = F.zip_with(
        query,
        F.slice(other, F.lit(1), F.size(query)),
        lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")),
    )
    start = F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"))
    return F.aggregate(
        pairs,
        start,
        lambda sums, pair: F.struct(
            (sums["dot"] + pair["x"] * pair["y"]).alias("dot"),
            (sums["xx"] + pair["x"] * pair["x"]).alias("xx"),
            (sums["yy"] + pair["y"] * pair["y"]).alias("yy"),
        ),
    )


def cosine(query: Column, other: Column) -> Column:
    """Cosine similarity; 0 where either length is 0.

    Null (too short a vector) and NaN (a NaN element) never win a match: callers drop them
    before comparing, because Spark ranks NaN above every number.
    """
    sums = reductions(query, other)
    lengths = F.sqrt(sums["xx"]) * F.sqrt(sums["yy"])
    flat = (sums["xx"] == 0) | (sums["yy"] == 0)
    return F.when(flat, F.lit(0.0)).otherwise(F.try_divide(sums["dot"], lengths))


def is_placeholder(vector: Column) -> Column:
    """True where every element is 0, also for an empty vector."""
    return F.forall(vector, lambda x: x == 0)


def or_placeholder(vector: Column, length: int = PLACEHOLDER_LENGTH) -> Column:
    """The vector, or zeros where embedding gave none."""
    return F.coalesce(vector, F.array_repeat(F.lit(0.0).cast("float"), length))
