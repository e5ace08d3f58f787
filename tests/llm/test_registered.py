"""Registered queries of the subpackage against their SQL on the smallest tables."""

import pytest
from oracle import connect, from_spark, from_sql

import __spark_entry__ as driver
from deckweave.llm.queries import load
from deckweave.llm.sampling import sample_by_hash

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(name for name, query in load().items() if query.sql))
def test_query_equals_sql(spark, name):
    assert from_spark(driver.queries()[name](spark, FOLDER)) == from_sql(connect(FOLDER), driver.oracle_sql()[name])


def test_all_are_registered():
    names = {name.split("_")[0] for name in load()}
    assert names == {f"op{n}" for n in range(1, 14)}
    assert set(load()) | {"pipeline"} <= set(driver.queries())


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(10_000).toDF("id")
    one = [row.id for row in sample_by_hash(rows, 50, "id").collect()]
    many = [row.id for row in sample_by_hash(rows.repartition(9), 50, "id").collect()]
    assert one == many and len(set(one)) == 50
    assert sample_by_hash(rows.limit(7), 50, "id").count() == 7
    assert sample_by_hash(rows.limit(0), 50, "id").count() == 0
