"""An equi-join that stays even where single keys hold many rows, without adaptive execution."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckweave.session import cut_lineage

#: A key is heavy from this share of a partition's fair part of all rows.
HEAVY_SHARE = 0.25


def skew_join_is_on(df: DataFrame) -> bool:
    """Whether adaptive execution splits skewed partitions itself."""
    conf = df.sparkSession.conf
    names = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return all(conf.get(name, "true") == "true" for name in names)


def heavy_keys(rows: DataFrame, key: Column, partitions: int, share: float = HEAVY_SHARE) -> DataFrame:
    """``key, salts`` of the keys with more than a share of a partition's rows, by exact counts.

    Counts add up in each task first. At most ``partitions / share`` keys can be heavy, whatever the
    size of the table, and their salts add up to less than twice as many. Null is no key.
    """
    keyed = rows.select(key.alias("key")).where(F.col("key").isNotNull())
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = keyed.agg(F.count(F.lit(1)).alias("n")).scalar()
    chunks = F.col("n") * partitions / (total * share)
    return counts.where(chunks > 1).select("key", F.ceil(chunks).alias("salts"))


def join_even(
    rows: DataFrame,
    details: DataFrame,
    key: Column,
    detail_key: Column,
    spread: Column,
    how: str = "inner",
    partitions: int | None = None,
) -> DataFrame:
    """``rows`` joined with ``details`` where the keys are equal; inner or left.

    Rows of a heavy key go to several partitions by ``spread``, which should differ between rows of one
    key and depend on nothing but the row, so that a repeated task deals out alike. The details of
    heavy keys are copied to each of these partitions. Every other key is joined as usual. The counts
    cost a pass over the keys; the table of heavy keys is bounded by the number of partitions and is
    broadcast. Null keys match nothing; in a left join they are spread as well.
    """
    if how not in ("inner", "left"):
        raise ValueError("rows can be joined inner or left")
    spark = rows.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    heavy = cut_lineage(heavy_keys(rows, key, partitions), "heavy")
    salted_rows, salted_details = _free("salt", rows, details), _free("other_salt", rows, details)
    row_heavy = F.broadcast(heavy.select(F.col("key").alias(_free("heavy", rows)), F.col("salts").alias(_free("salts", rows))))
    detail_heavy = F.broadcast(
        heavy.select(F.col("key").alias(_free("heavy", details)), F.col("salts").alias(_free("salts", details)))
    )
    code = F.xxhash64(spread)
    own = F.when(key.isNull(), F.pmod(code, F.lit(partitions))).otherwise(
        F.pmod(code, F.coalesce(F.col(_free("salts", rows)), F.lit(1)))
    )
    left = (
        rows.join(row_heavy, key == F.col(_free("heavy", rows)), "left")
        .withColumn(salted_rows, own)
        .drop(_free("heavy", rows), _free("salts", rows))
    )
    last = F.coalesce(F.col(_free("salts", details)), F.lit(1)) - 1
    right = (
        details.join(detail_heavy, detail_key == F.col(_free("heavy", details)), "left")
        .withColumn(salted_details, F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .drop(_free("heavy", details), _free("salts", details))
    )
    met = (key == detail_key) & (F.col(salted_rows) == F.col(salted_details))
    return left.join(right, met, how).drop(salted_rows, salted_details)


def _free(name: str, *frames: DataFrame) -> str:
    """The name, lengthened until no column of the frames has it."""
    taken = {column.lower() for frame in frames for column in frame.columns}
    while name in taken:
        name += "_"
    return name
