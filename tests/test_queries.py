"""Every registered query against its SQL on the smallest tables."""

import os
import re

import pytest
from oracle import connect, from_spark, from_sql

import __spark_entry__ as driver
from deckweave.queries import load

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(load()))
def test_query_equals_sql(spark, con, name):
    got = from_spark(driver.queries()[name](spark, FOLDER))
    sql = driver.oracle_sql().get(name)
    if sql is not None:
        assert got == from_sql(con, sql)


def test_every_operator_has_a_query():
    shown = set(" ".join(query.operators for query in load().values()).split())
    inventory = {"A": 12, "B": 17, "C": 8, "D": 5, "E": 1, "F": 4, "G": 2, "H": 17, "I": 1, "J": 3}
    expected = {f"{letter}{n}" for letter, count in inventory.items() for n in range(1, count + 1)}
    assert expected - shown == set() and shown - expected == set()


def test_names_are_plain():
    assert all(re.fullmatch(r"[a-z_]+", name) for name in load())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
