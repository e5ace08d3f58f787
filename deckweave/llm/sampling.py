"""Bounded samples that do not depend on the order or partitions of a table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_by_hash(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The ``rows`` rows with the smallest hashes of ``keys``, all where there are fewer.

    A filter on the hash comes first and leaves about four times as many, so that each task sends
    few rows to the one that takes the first, however many tasks there are. A table of few distinct
    keys may give fewer rows.
    """
    step = max(1, df.count() // (4 * rows))
    code = F.xxhash64(*[F.col(f"`{key}`") for key in keys])
    few = df.where(F.pmod(code, F.lit(step)) == 0)
    return few.orderBy(code, *[F.col(f"`{key}`") for key in keys]).limit(rows)
