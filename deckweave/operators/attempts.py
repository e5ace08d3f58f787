"""Outcome of repeated attempts, as a table operation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckweave.functions.numbers import exponential_wait_ms


def classify_response(status: Column, content_type: Column | None = None) -> Column:
    """``ok``, ``client_error``, ``server_error``, ``error`` (no status) or ``not_json``.

    ``not_json`` is given only where a content type is passed, and then whatever the status;
    statuses in no class (1xx, 3xx) are ``other``.
    """
    kind = (
        F.when(status.isNull(), "error")
        .when(status.between(200, 299), "ok")
        .when(status.between(400, 499), "client_error")
        .when(status >= 500, "server_error")
        .otherwise("other")
    )
    if content_type is None:
        return kind
    is_json = F.coalesce(F.contains(content_type, F.lit("application/json")), F.lit(False))
    return F.when(status.isNull(), "error").when(is_json, kind).otherwise("not_json")


def ends_request(status: Column) -> Column:
    """Success and client errors end a request; all else is tried again."""
    return F.coalesce(status.between(200, 299) | status.between(400, 499), F.lit(False))


def ends_page_load(status: Column) -> Column:
    """Only success ends the loading of a page."""
    return F.coalesce(status.between(200, 299), F.lit(False))


def ends_catalogue_request(status: Column, content_type: Column) -> Column:
    """Only success with a JSON answer ends a request to the catalogue (two attempts at most)."""
    return classify_response(status, content_type) == "ok"


def resolve_attempts(
    attempts: DataFrame, limit: int = 3, terminal: Column | None = None
) -> DataFrame:
    """Outcome per key: the first terminal attempt among the first ``limit``, else the last
    failure.

    Gives ``(key, attempt, status, error, resolved)``. One aggregation with partial minima and
    maxima: each map task sends a single row per key, so a key with very many attempts is no
    hot spot and no key's attempts are sorted together.
    """
    if terminal is None:
        terminal = ends_request(F.col("status"))
    record = F.struct("attempt", "status", "error")
    outcome = (
        attempts.where(F.col("attempt") <= limit)
        .groupBy("key")
        .agg(
            F.min(F.when(terminal, record)).alias("ended"),
            F.max(F.when(~terminal, record)).alias("failed"),
        )
    )
    decided = F.coalesce("ended", "failed")
    return outcome.select(
        "key",
        decided["attempt"].alias("attempt"),
        decided["status"].alias("status"),
        decided["error"].alias("error"),
        F.col("ended").isNotNull().alias("resolved"),
    )


def with_wait(attempts: DataFrame, limit: int = 3, terminal: Column | None = None) -> DataFrame:
    """Attempts with ``wait_ms``, the pause after each failed attempt that is not the last."""
    if terminal is None:
        terminal = ends_request(F.col("status"))
    waits = ~terminal & (F.col("attempt") < limit)
    return attempts.withColumn("wait_ms", F.when(waits, exponential_wait_ms(F.col("attempt"))))
