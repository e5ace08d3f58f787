"""Card catalogue: response envelopes and the fallback source."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckweave import schemas
from deckweave.functions.text import STRICT_JSON


def read_envelopes(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Response envelopes from JSON.

    A pretty-printed envelope needs ``multi_line``, which reads a file in one task and holds it
    (``read_large_envelopes`` doesn't); many envelopes in one file, one per line, are read in splits
    without it.
    """
    reader = spark.read.schema(schemas.ENVELOPE).options(**STRICT_JSON)
    return reader.option("multiLine", multi_line).json(path)


def read_large_envelopes(spark: SparkSession, path: str, indent: str = "  ") -> DataFrame:
    """Pieces of pretty-printed envelopes, ``file, card, rest``, a piece for each card of ``data``.

    The end of a card stands on a line of its own, two levels deep, and nothing else in an envelope
    looks like it: JSON strings hold no line ends. Spark's text reader splits files there, so a file
    of any size is read by many tasks and none holds more than a card at a time. ``indent`` is one
    level of it, as the file has it. ``card`` is the text of a card, null in pieces without one; what
    stands around cards is ``rest``. Cards whose text is broken have no fields, as in other forms.
    """
    level = 2 * indent
    pieces = spark.read.option("lineSep", f"\n{level}}}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value")
    )
    # The opening brace of a card stands on a line of its own as well.
    opening = f"(?s)^(.*?)(?:^|\n){level}(\\{{.*)$"
    held = F.regexp_extract("value", opening, 2)
    is_card = held != ""
    return pieces.select(
        "file",
        F.when(is_card, F.concat(held, F.lit("}"))).alias("card"),
        F.when(is_card, F.regexp_extract("value", opening, 1)).otherwise(F.col("value")).alias("rest"),
    )


def large_envelope_cards(pieces: DataFrame) -> DataFrame:
    """One row per card of ``read_large_envelopes``, with its fields."""
    cards = pieces.where(F.col("card").isNotNull())
    return cards.select(F.from_json("card", schemas.CARD, STRICT_JSON).alias("card")).select("card.*")


def large_envelope_pages(pieces: DataFrame, indent: str = "  ") -> DataFrame:
    """``file, page, pageSize, count, totalCount`` of each large envelope; null where it has none.

    Of a piece only the numbers one level deep are kept before the shuffle.
    """
    names = ("page", "pageSize", "count", "totalCount")
    number = lambda name: F.regexp_extract("rest", f'(?:^|\n){indent}"{name}"\\s*:\\s*([0-9]+)', 1)
    found = pieces.select("file", *[F.nullif(number(name), F.lit("")).cast("int").alias(name) for name in names])
    return found.groupBy("file").agg(*[F.max(name).alias(name) for name in names])


def parse_envelopes(responses: DataFrame, body: str = "body") -> DataFrame:
    """Response envelopes from a column of JSON texts; a broken text has no fields."""
    return responses.select(F.from_json(body, schemas.ENVELOPE, STRICT_JSON).alias("e")).select("e.*")


def envelope_cards(envelopes: DataFrame) -> DataFrame:
    """One row per card; an envelope without data, or with an empty list, gives none."""
    return envelopes.select(F.explode("data").alias("card")).select("card.*")


def envelope_pages(envelopes: DataFrame) -> DataFrame:
    """The counts beside the data: ``page, pageSize, count, totalCount``."""
    return envelopes.select("page", "pageSize", "count", "totalCount")


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The primary rows or, where there is not one, the fallback rows.

    The fallback is returned whole: conditions of the primary query do not apply to it. The
    test is an uncorrelated EXISTS, which stops at the first primary row.
    """
    return primary.unionByName(fallback.where(~primary.exists()), allowMissingColumns=True)


def with_fallback_on_failure(
    primary: DataFrame, fallback: DataFrame, outcome: DataFrame
) -> DataFrame:
    """The fallback rows where the request failed, else the primary rows, even if there are
    none.

    ``outcome`` is the request's row of ``resolve_attempts``; a request succeeded if an attempt
    ended it with status 2xx. An answer that ended nothing is a failure whatever its status, such
    as a page in place of JSON.
    """
    success = outcome.where(F.col("resolved") & F.col("status").between(200, 299))
    return primary.where(success.exists()).unionByName(
        fallback.where(~success.exists()), allowMissingColumns=True
    )
