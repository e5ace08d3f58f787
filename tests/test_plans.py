"""Shapes of plans: what is pushed down, what is shuffled, what is split."""

import re

import pytest
from pyspark.sql import functions as F

from deckweave.operators import joins
from deckweave.operators import match as matching
from deckweave import schemas
from deckweave.plans import catalogue, market
from deckweave.sources import catalogue as card_source
from deckweave.sources import pages as page_source
from deckweave.sources import sets as set_source


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def settings(spark):
    """Set session options for one test."""
    before = {}

    def use(**options):
        for name, value in options.items():
            key = "spark.sql." + name.replace("__", ".")
            before[key] = spark.conf.get(key)
            spark.conf.set(key, value)

    yield use
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Cards and pages as Parquet."""
    folder = tmp_path_factory.mktemp("stored")
    spark.createDataFrame([], schemas.CARD).write.parquet(str(folder / "cards"))
    spark.createDataFrame([], schemas.CAPTURED_PAGE).write.parquet(str(folder / "pages"))
    return (
        spark.read.schema(schemas.CARD).parquet(str(folder / "cards")),
        page_source.read_pages(spark, str(folder / "pages")),
    )


def test_page_condition_reaches_the_scan_and_the_page_is_a_top_k(stored):
    page = catalogue.catalogue_page(stored[0], F.col("set.id") == "base1", page=3)
    plan = plan_of(page.select("id", "name", "totalCount"))
    assert "TakeOrderedAndProject" in plan and "EqualTo(set.id,base1)" in plan
    scans = re.findall(r"ReadSchema: (\S+)", plan)
    assert "struct<set:struct<id:string>>" in scans
    assert "struct<id:string,name:string,set:struct<id:string>>" in scans


def test_card_view_reads_only_what_it_shows(stored):
    schema = re.search(r"ReadSchema: (\S+)", plan_of(catalogue.card_view(stored[0]))).group(1)
    assert "attacks" not in schema and "cardmarket" not in schema and "logo" not in schema


def test_market_rows_do_not_shuffle(spark, stored):
    plan = plan_of(market.market_rows(stored[1]))
    assert "Exchange" not in plan and "EqualTo(status,200)" in plan
    assert "StringContains(html,var cardsjson = [)" in plan
    listed = market.market_rows(stored[1], page_source.collection_list(spark))
    assert "hashpartitioning" not in plan_of(listed)


def test_cleaning_stays_in_columns(stored):
    plan = plan_of(market.market_clean(market.market_rows(stored[1])))
    assert "EvalPython" not in plan


def test_summary_adds_up_before_each_shuffle(spark):
    rows = spark.range(1).selectExpr(
        "id AS part", "'c' AS colecao", "id", "current_date() AS date", "1.0D AS preco_min",
        "1.0D AS preco_mean", "1.0D AS preco_max",
    )
    plan = plan_of(market.add_totals(market.partial_totals(rows, "part", "colecao")))
    assert plan.count("partial_sum(preco_min") >= 1 and "SortAggregate" not in plan


def test_newest_sets_are_a_top_k(spark):
    sets = spark.createDataFrame(
        [("s", "2024-01-01", ("x",))], "id string, releaseDate string, serie struct<id: string>"
    )
    assert "TakeOrderedAndProject" in plan_of(set_source.first_sets(set_source.set_listing(sets), 2))


def test_fallback_joins_nothing(spark):
    one = spark.range(3)
    plan = plan_of(card_source.with_fallback(one.where("id > 5"), one))
    assert "Join" not in plan and "Subquery" in plan


def test_hot_card_is_split_by_adaptive_execution(spark, settings, tmp_path):
    """One card in a third of all sets: its partition is read by several tasks."""
    settings(
        autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__advisoryPartitionSizeInBytes="20KB",
    )
    ids = spark.range(0, 60000, 1, 8)
    card = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).cast("string")
    sets = ids.select(
        F.col("id").cast("string").alias("id"),
        F.lit("2024-01-01").alias("releaseDate"),
        F.struct(F.lit("x").alias("id")).alias("serie"),
        F.array(F.struct(card.alias("id"))).alias("cards"),
    )
    details = spark.range(5000).select(
        F.col("id").cast("string").alias("id"), F.lit("i").alias("image"), F.lit("n").alias("name")
    )
    flat = catalogue.catalogue_flat(sets, details)
    flat.write.parquet(str(tmp_path / "flat"))
    rows = flat.collect()
    assert len(rows) == 60000
    assert "isSkew=true" in plan_of(flat) or "skew=true" in plan_of(flat)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_heavy_keys_are_dealt_out_by_counting(spark, settings, how):
    """One key in a third of all rows, null in a tenth, without adaptive execution."""
    settings(adaptive__enabled="false", autoBroadcastJoinThreshold="-1", shuffle__partitions="16")
    ids = spark.range(0, 120_000, 1, 8)
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 5000)
    rows = ids.select(F.col("id").alias("row"), key.alias("key"), F.lit("x").alias("salt"))
    details = spark.range(4000).select(F.col("id").alias("id"), F.concat(F.lit("n"), "id").alias("name"))
    joined = joins.join_even(rows, details, F.col("key"), F.col("id"), F.col("row"), how)
    assert joined.columns == ["row", "key", "salt", "id", "name"]
    tasks = joined.groupBy(F.spark_partition_id()).count().collect()
    sizes = sorted(row["count"] for row in tasks)
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
    plain = rows.join(details, F.col("key") == F.col("id"), how)
    assert joined.exceptAll(plain).count() == 0 and plain.exceptAll(joined).count() == 0
    assert joins.heavy_keys(rows, F.col("key"), 16).select("key").collect() == [(7,)]
    with pytest.raises(ValueError):
        joins.join_even(rows, details, F.col("key"), F.col("id"), F.col("row"), "right")


def test_full_cards_are_joined_evenly_where_nothing_splits_partitions(spark, settings):
    briefs = spark.range(100).select(F.col("id").alias("set_id"), F.struct(F.lit("a").alias("id")).alias("brief"))
    details = spark.createDataFrame([("a", "Ay"), ("b", "Bee")], "id string, name string")
    usual = catalogue.with_full_card(briefs, details)
    assert "sequence" not in plan_of(usual) and usual.count() == 100
    settings(adaptive__skewJoin__enabled="false")
    even = catalogue.with_full_card(briefs, details)
    assert "sequence" in plan_of(even) and even.exceptAll(usual).count() == 0 and even.count() == 100


def test_deep_page_is_a_top_k_of_its_size(stored):
    page = catalogue.catalogue_page_after(stored[0], {"name": "Mew", "id": "x9"}, F.col("set.id") == "base1", 5, ("name", "id"))
    plan = plan_of(page.select("id", "name"))
    assert "TakeOrderedAndProject(limit=5" in plan and "GreaterThanOrEqual(name,Mew)" in plan


def test_unmatched_rows_are_not_shuffled(spark):
    rows = "query_id bigint, card_id string, matched boolean"
    matches = spark.createDataFrame([(1, "a", True), (2, None, False)], rows)
    cards = spark.createDataFrame([("a", "Ay")], "card_id string, name string")
    named = matching.with_card(matches, cards)
    assert sorted(map(tuple, named.select("query_id", "card_id", "matched", "name").collect())) == [
        (1, "a", True, "Ay"), (2, None, False, None),
    ]
    joined = named._jdf.queryExecution().optimizedPlan().children().toList()
    plans = [joined.apply(i).toString() for i in range(joined.size())]
    assert len(plans) == 2 and "Join" in plans[0] and "isnotnull(card_id" in plans[0]
    assert "Join" not in plans[1] and "isnull(card_id" in plans[1]
