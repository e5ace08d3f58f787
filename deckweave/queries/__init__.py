"""Registered queries: the operators on the test tables, each with SQL that checks it."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: str


REGISTERED: dict[str, Query] = {}


def query(operators: str, sql: str | None = None):
    """Register a function under its own name, with the operators it shows and its SQL."""

    def add(run):
        REGISTERED[run.__name__] = Query(run, sql, operators)
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def load() -> dict[str, Query]:
    """All queries, by name."""
    from deckweave.queries import catalogue, market, matching, outcomes  # noqa: F401

    return REGISTERED
