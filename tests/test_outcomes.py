import subprocess
import sys
from pathlib import Path

import pytest
import stubs
from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import functions as F
from stubs import Bytes, InLists, model, whole_number

from deckweave import schemas
from deckweave.operators import attempts
from deckweave.operators.mapping import embed, embed_rows, try_map

ROWS = [
    ("first", 1, 200, None),
    ("second", 1, 503, "HTTP 503"), ("second", 2, 200, None), ("second", 3, 404, "late"),
    ("client", 1, 404, "gone"), ("client", 2, 200, None),
    ("never", 1, 503, "one"), ("never", 2, 500, "two"), ("never", 3, 504, "three"),
    ("network", 1, None, "reset"), ("network", 2, 302, "moved"),
    ("too late", 1, 500, "a"), ("too late", 2, 500, "b"), ("too late", 3, 500, "c"), ("too late", 4, 200, None),
]


@pytest.fixture(scope="module")
def tried(spark):
    return spark.createDataFrame(ROWS, schemas.ATTEMPT)


def test_resolution(tried):
    rows = {r.key: tuple(r)[1:] for r in attempts.resolve_attempts(tried).collect()}
    assert rows == {
        "first": (1, 200, None, True),
        "second": (2, 200, None, True),
        "client": (1, 404, "gone", True),
        "never": (3, 504, "three", False),
        "network": (2, 302, "moved", False),
        "too late": (3, 500, "c", False),
    }


def test_page_loads_end_only_with_success(tried):
    rule = attempts.ends_page_load(F.col("status"))
    rows = {r.key: (r.attempt, r.resolved) for r in attempts.resolve_attempts(tried, 2, rule).collect()}
    assert rows["client"] == (2, True) and rows["second"] == (2, True) and rows["never"] == (2, False)


def test_waits(tried):
    rows = attempts.with_wait(tried).where("key in ('never', 'first', 'second')").orderBy("key", "attempt")
    assert [r.wait_ms for r in rows.collect()] == [None, 1000.0, 2000.0, None, 1000.0, None, None]


def test_classes(spark):
    df = spark.createDataFrame(
        [(200, "application/json"), (204, "text/html"), (404, "application/json; x"), (503, None),
         (500, "application/json"), (302, "application/json"), (None, "application/json")],
        "status int, kind string",
    )
    plain = [r[0] for r in df.select(attempts.classify_response(F.col("status"))).collect()]
    assert plain == ["ok", "ok", "client_error", "server_error", "server_error", "other", "error"]
    typed = [r[0] for r in df.select(attempts.classify_response(F.col("status"), F.col("kind"))).collect()]
    assert typed == ["ok", "not_json", "client_error", "not_json", "server_error", "other", "error"]


def test_hot_key_is_aggregated_before_the_shuffle(spark):
    hot = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"),
        (F.col("id") % 5 + 1).cast("int").alias("attempt"),
        F.lit(503).alias("status"),
        F.lit("e").alias("error"),
    )
    got = attempts.resolve_attempts(hot)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan
    assert got.where("key = 'hot'").first().attempt == 3


def test_try_map(spark):
    jobs = spark.createDataFrame([(1, "10"), (2, "ten"), (3, None), (4, "-4")], "job_id bigint, payload string")
    rows = jobs.select("job_id", try_map("payload", whole_number, "bigint").alias("done")).orderBy("job_id").collect()
    assert [(r.done.result, r.done.error) for r in rows] == [
        (10, None),
        (None, "ValueError: invalid literal for int() with base 10: 'ten'"),
        (None, "TypeError: no payload"),
        (-4, None),
    ]


def test_embed(spark):
    kinds = [b"data", b"list", b"array", b"text", b"other"]
    images = spark.createDataFrame([(i, bytearray(k)) for i, k in enumerate(kinds)], "id int, content binary")
    rows = images.select("id", embed("content", model).alias("made")).orderBy("id").collect()
    assert [r.made.embedding for r in rows] == [[1.0, 2.0], [3.5], [1.5, 2.5], None, None]
    assert [r.made.error for r in rows] == [
        None, None, None, "the model gave no vector", "RuntimeError: bad image",
    ]


def test_embed_in_lists(spark):
    contents = [b"a", b"bb", b"none", b"x", b"abcd"] * 40
    images = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "id int, content binary")
    one = images.select("id", embed("content", Bytes).alias("made")).orderBy("id").collect()
    many = images.select("id", embed("content", InLists).alias("made")).orderBy("id").collect()
    assert one == many and [r.made.error for r in many[:5]] == [None, None, "the model gave no vector", "OSError: broken image", None]


def test_try_map_gives_values_as_they_are(spark):
    numbers = spark.createDataFrame([(9007199254740993,), (None,), (5,)], "n bigint")
    rows = numbers.select(try_map("n", repr, "string").alias("done")).collect()
    assert [r.done.result for r in rows] == ["9007199254740993", "None", "5"]


def test_embedding_as_a_stage(spark):
    images = spark.createDataFrame([(1, bytearray(b"aab"), "k"), (2, bytearray(b"x"), None), (3, bytearray(b"none"), "l")], "id int, content binary, `a.b` string")
    for factory in (stubs.Bytes, stubs.InLists):
        rows = embed_rows(images, "content", factory)
        assert rows.columns == ["id", "a.b", "embedding", "error"]
        column = images.select("id", "`a.b`", embed("content", factory).alias("made")).select("id", "`a.b`", "made.*")
        assert rows.exceptAll(column).count() == 0 and rows.count() == 3
    with pytest.raises(ValueError):
        embed_rows(images.withColumn("error", F.lit(1)), "content", stubs.Bytes)


def test_profile_is_in_the_plan(spark):
    wanted = ResourceProfileBuilder().require(TaskResourceRequests().cpus(2).resource("gpu", 0.5)).build
    images = spark.createDataFrame([(1, bytearray(b"a"))], "id int, content binary")
    plan = embed_rows(images, "content", stubs.Bytes, wanted)._jdf.queryExecution().optimizedPlan().toString()
    assert "cpus, amount: 2.0" in plan and "gpu, amount: 0.5" in plan


PROFILE_JOB = """
import sys
sys.path[:0] = [{repo!r}, {tests!r}]
from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import SparkSession
import stubs
from deckweave.operators.mapping import embed_rows
from deckweave.session import ship_package

spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false").getOrCreate()
ship_package(spark)
spark.sparkContext.addPyFile({tests!r} + "/stubs.py")
wanted = ResourceProfileBuilder().require(TaskResourceRequests().cpus(2)).build
images = spark.range(6).selectExpr("id", "encode(concat('aab', id), 'UTF-8') AS content")
rows = embed_rows(images, "content", stubs.Bytes, wanted).orderBy("id").collect()
assert [list(r.embedding) for r in rows] == [[2.0, 1.0, 0.0, 0.0]] * 6
stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
used = {{stages.apply(i).resourceProfileId() for i in range(stages.size())}}
print("profiles", sorted(used), wanted.id)
spark.stop()
"""


def test_profile_is_on_the_stage(tmp_path):
    """In a session of its own, with an executor, as a local master takes no profile."""
    here = Path(__file__).resolve().parent
    script = tmp_path / "job.py"
    script.write_text(PROFILE_JOB.format(repo=str(here.parent), tests=str(here)))
    done = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=180, cwd=tmp_path)
    said = [line for line in done.stdout.splitlines() if line.startswith("profiles")]
    assert said, done.stderr[-2000:]
    used, wanted = said[0].removeprefix("profiles ").rsplit(" ", 1)
    assert int(wanted) in eval(used)
