"""Attempt and error queries: events and conversations as request attempts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from deckweave.functions import numbers, text
from deckweave.operators import attempts
from deckweave.operators.mapping import try_map
from deckweave.queries import query, table
from deckweave.sources import catalogue as card_source

LIMIT = 3


def _event_attempts(spark, folder):
    """Events of a user, in time order, as attempts; the type gives the status.

    The rank filter becomes a group limit on the map side, so no user's events are sorted whole
    in one task.
    """
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.col("event_type")
    status = (
        F.when(kind == "error", 503).when(kind == "click", 404).when(kind != "signup", 200)
    )
    return (
        table(spark, folder, "events")
        .select("user_id", "ts", "event_id", "event_type", F.row_number().over(order).alias("attempt"))
        .where(F.col("attempt") <= LIMIT)
        .select(F.col("user_id").alias("key"), "attempt", status.alias("status"), kind.alias("error"))
    )


_EVENT_ATTEMPTS = """
    WITH attempts AS (
        SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt,
               CASE event_type WHEN 'error' THEN 503 WHEN 'click' THEN 404 WHEN 'signup' THEN NULL
                    ELSE 200 END AS status,
               event_type AS error
        FROM events)
"""


def _resolved_sql(terminal: str, source: str = "attempts") -> str:
    return f"""
    , ranked AS (
        SELECT *, row_number() OVER (PARTITION BY key ORDER BY ({terminal}) DESC,
                   CASE WHEN {terminal} THEN attempt ELSE -attempt END) AS place,
               ({terminal}) AS resolved
        FROM {source} WHERE attempt <= 3)
    SELECT key, attempt, status, error, resolved FROM ranked WHERE place = 1"""


_ENDS = "coalesce(status BETWEEN 200 AND 299 OR status BETWEEN 400 AND 499, false)"


@query("E1 B16", _EVENT_ATTEMPTS + _resolved_sql(_ENDS))
def attempt_resolution(spark, folder):
    return attempts.resolve_attempts(_event_attempts(spark, folder), LIMIT)


@query(
    "E1",
    """
    WITH attempts AS (
        SELECT conv_id AS key, turn + 1 AS attempt,
               CASE role WHEN 'assistant' THEN 200 WHEN 'user' THEN 404 END AS status, role AS error
        FROM conversations)"""
    + _resolved_sql("coalesce(status BETWEEN 200 AND 299, false)"),
)
def page_load_resolution(spark, folder):
    role = F.col("role")
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("key"),
        (F.col("turn") + 1).alias("attempt"),
        F.when(role == "assistant", 200).when(role == "user", 404).alias("status"),
        role.alias("error"),
    )
    return attempts.resolve_attempts(rows, LIMIT, attempts.ends_page_load(F.col("status")))


@query(
    "B16",
    """
    SELECT l_orderkey, l_linenumber,
           CASE WHEN l_returnflag = 'R' THEN 'not_json'
                WHEN l_quantity < 10 THEN 'other'
                WHEN l_quantity < 20 THEN 'ok'
                WHEN l_quantity < 30 THEN 'other'
                WHEN l_quantity < 40 THEN 'client_error'
                ELSE 'server_error' END AS outcome
    FROM lineitem""",
)
def response_classes(spark, folder):
    status = (F.col("l_quantity") * 10 + 100).cast("int")
    kind = F.when(F.col("l_returnflag") != "R", "application/json; charset=utf-8")
    outcome = attempts.classify_response(status, kind)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", outcome.alias("outcome"))


@query(
    "H15",
    _EVENT_ATTEMPTS
    + f"""
    SELECT key, attempt,
           CASE WHEN NOT {_ENDS} AND attempt < 3 THEN least(1000.0 * pow(2, attempt - 1), 10000.0) END
               AS wait_ms
    FROM attempts WHERE attempt <= 3""",
)
def attempt_waits(spark, folder):
    return attempts.with_wait(_event_attempts(spark, folder), LIMIT).select("key", "attempt", "wait_ms")


@query(
    "H15",
    """
    SELECT l_orderkey, l_linenumber,
           least(1000.0 * pow(2, l_linenumber - 1), 10000.0) AS exponential,
           10 * l_linenumber AS linear, 5 + 3 * l_linenumber AS page
    FROM lineitem""",
)
def waiting_times(spark, folder):
    attempt = F.col("l_linenumber")
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        numbers.exponential_wait_ms(attempt).alias("exponential"),
        numbers.linear_wait_ms(attempt).alias("linear"),
        numbers.page_wait_seconds(attempt).alias("page"),
    )


@query(
    "H16",
    """
    SELECT doc_id, substring(text, 1, 50) AS short, substring(text, 1, 200) AS long FROM documents""",
)
def error_texts(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        text.leading_text(F.col("text"), 50).alias("short"),
        text.leading_text(F.col("text"), 200).alias("long"),
    )


def root_of_balance(balance: float) -> float:
    """A job that fails on some rows."""
    if balance < 0:
        raise ValueError("negative balance")
    return balance**0.5


@query(
    "J3",
    """
    SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 6) AS result,
           CASE WHEN c_acctbal < 0 THEN 'ValueError: negative balance' END AS error
    FROM customer""",
)
def error_map(spark, folder):
    done = try_map("c_acctbal", root_of_balance, "double")
    rows = table(spark, folder, "customer").select("c_custkey", done.alias("done"))
    return rows.select("c_custkey", F.round("done.result", 6).alias("result"), "done.error")


def successor(number: int | None) -> int | None:
    """A job on whole numbers of any size that fails on some rows."""
    if number is not None and number % 5 == 0:
        raise ValueError("multiple of five")
    return None if number is None else number + 1


_LARGE = 9007199254740993


@query(
    "J3",
    f"""
    WITH numbers AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN {_LARGE} + o_orderkey END AS n FROM orders)
    SELECT o_orderkey, CASE WHEN n % 5 <> 0 THEN n + 1 END AS result,
           CASE WHEN n % 5 = 0 THEN 'ValueError: multiple of five' END AS error
    FROM numbers""",
)
def error_map_integers(spark, folder):
    number = F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderkey").cast("bigint") + _LARGE)
    done = try_map(number, successor, "bigint")
    rows = table(spark, folder, "orders").select("o_orderkey", done.alias("done"))
    return rows.select("o_orderkey", "done.result", "done.error")


def _turns_as_requests(spark, folder):
    """Turns as requests to the catalogue: users get pages in place of JSON, assistants get JSON."""
    role = F.col("role")
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("key"),
        (F.col("turn") + 1).alias("attempt"),
        F.when(F.col("turn") % 3 != 2, 200).otherwise(503).alias("status"),
        role.alias("error"),
        F.when(role == "assistant", "application/json").otherwise("text/html").alias("content_type"),
    )


@query(
    "E1 B16",
    """
    WITH attempts AS (
        SELECT conv_id AS key, turn + 1 AS attempt, CASE WHEN turn % 3 <> 2 THEN 200 ELSE 503 END AS status,
               role AS error FROM conversations),
    first_two AS (SELECT * FROM attempts WHERE attempt <= 2)"""
    + _resolved_sql("status = 200 AND error = 'assistant'", "first_two"),
)
def catalogue_request_resolution(spark, folder):
    ends = attempts.ends_catalogue_request(F.col("status"), F.col("content_type"))
    return attempts.resolve_attempts(_turns_as_requests(spark, folder), 2, ends)


@query(
    "A12 E1",
    """
    WITH ended AS (
        SELECT 1 FROM conversations WHERE turn < 2 AND turn % 3 <> 2 AND role = 'nobody')
    SELECT c_custkey AS id, c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM ended)
    UNION ALL
    SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE NOT EXISTS (SELECT 1 FROM ended)""",
)
def fallback_failure_branch(spark, folder):
    """All requests of all conversations as one: each answered, none with JSON."""
    requests = _turns_as_requests(spark, folder).withColumn("content_type", F.lit("text/html"))
    ends = attempts.ends_catalogue_request(F.col("status"), F.col("content_type"))
    outcome = attempts.resolve_attempts(requests, 2, ends)
    primary = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    fallback = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return card_source.with_fallback_on_failure(primary, fallback, outcome)
