"""Connected components of links, as rounds of joins and minima; nothing is gathered on the driver."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckweave.session import cut_lineage


def _each(rows: DataFrame, *links: tuple[str, str]) -> DataFrame:
    """Links ``a, b`` of every row; one pass over the rows, where a union would read them once a link."""
    return rows.select(F.inline(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in links])))


def _pointed(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Link the neighbours of each node to the least of them and itself.

    ``both_ways``: larger neighbours only, looked at from both ends (large star); else all smaller
    ones, looked at from the larger end (small star).
    """
    if both_ways:
        seen = _each(edges, ("a", "b"), ("b", "a"))
    else:
        seen = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = seen.join(least, "a")
    if both_ways:
        made = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        made = _each(joined, ("b", "m"), ("a", "m"))
    return made.where(F.col("a") != F.col("b")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has at most one link, to a node without one.

    Links of a round lead to smaller nodes, so that stars are around least nodes and a further round
    changes none of them.
    """
    none = F.lit(None).cast(edges.schema["b"].dataType)
    ends = edges.select(F.inline(F.array(*[
        F.struct(F.col(node).alias("node"), to.alias("to")) for node, to in (("a", F.col("b")), ("b", none))
    ])))
    seen = ends.groupBy("node").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.max(F.col("to").isNull()).alias("reached"))
    further = (F.col("low") < F.col("high")) | (F.col("low").isNotNull() & F.col("reached"))
    return seen.where(further).agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows ``node, label`` for all ends of the links ``a, b``; the label is the least node reached.

    Null ends and links of a node with itself count for nothing. No links give no rows. A node with
    any number of links is looked at in partial minima; every round is written, so a lost executor
    costs one round.
    """
    edges = cut_lineage(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")
    while True:
        edges = cut_lineage(_pointed(_pointed(edges, True), False), "links")
        if _are_stars(edges):
            break
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(
        roots.select("node", F.col("node").alias("label"))
    )
