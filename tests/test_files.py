import io
import json
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from deckweave.functions import text
from deckweave.session import cut_lineage, remove_scratch, scratch_path, shared_folder
from deckweave.sources import catalogue, files, image_files


def _written(path):
    return b"".join(p.read_bytes() for p in sorted(path.glob("*.csv")))


def test_csv_is_what_pandas_writes(spark, tmp_path):
    rows = [(1, 'say "hi"', True, 1.5), (2, "two\nlines, comma", False, None), (3, None, None, 0.25), (4, "", True, 2.0)]
    df = spark.createDataFrame(rows, "id int, text string, flag boolean, price double").coalesce(1)
    files.write_csv(df, str(tmp_path / "csv"), mark=True)
    frame = pd.DataFrame(rows, columns=df.columns)
    assert _written(tmp_path / "csv") == frame.to_csv(index=False).encode("utf-8-sig")
    back = files.read_csv(spark, str(tmp_path / "csv"), df.schema, multi_line=True)
    assert [tuple(r) for r in back.orderBy("id").collect()] == rows[:3] + [(4, None, True, 2.0)]


def test_csv_without_mark(spark, tmp_path):
    files.write_csv(spark.range(2).coalesce(1), str(tmp_path / "csv"))
    assert pd.read_csv(io.BytesIO(_written(tmp_path / "csv"))).id.tolist() == [0, 1]


def test_image_store(spark, tmp_path):
    images = spark.createDataFrame([("c1", bytearray(b"\x89PNG")), ("c2", bytearray(b""))], "id string, content binary")
    path = text.image_path(F.lit("2024-01-01"), F.lit("s1"), F.col("id"))
    files.write_images(images, str(tmp_path / "images"), path)
    rows = {r.image_path: bytes(r.content) for r in spark.read.parquet(str(tmp_path / "images")).collect()}
    assert rows == {"images/2024-01-01_s1_c1_low.png": b"\x89PNG", "images/2024-01-01_s1_c2_low.png": b""}


def test_read_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"no image")
    rows = files.read_images(spark, str(tmp_path), "*.png").collect()
    assert [(bytes(r.content), r.length) for r in rows] == [(b"abc", 3)]


def test_lineage_is_cut_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_folder(spark).rstrip("/") + "/deckweave/")
    written = cut_lineage(spark.range(5).withColumn("y", F.col("id") * 2), "numbers")
    assert "Range" not in written._jdf.queryExecution().analyzed().toString()
    assert written.agg(F.sum("y")).first()[0] == 20


def test_remove_scratch(spark):
    folder = Path(scratch_path(spark, "gone")).parent
    assert cut_lineage(spark.range(3), "gone").count() == 3 and folder.is_dir()
    remove_scratch(spark)
    assert not folder.exists()


def _tree(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_images_become_files_under_their_paths(spark, tmp_path):
    rows = [(f"images/s {i % 3}/c%20{i}_é.png", bytes([i]) * i, "x") for i in range(40)]
    images = spark.createDataFrame([(a, bytearray(b), c) for a, b, c in rows], "p string, content binary, path string")
    folder = tmp_path / "out"
    image_files.write_image_files(images.repartition(5), str(folder), F.col("p"))
    tree = _tree(folder)
    assert json.loads(tree.pop("_SUCCESS")) == {"files": 40, "bytes": sum(range(40))}
    assert tree == {path: content for path, content, _ in rows}
    back = {r.path: bytes(r.content) for r in image_files.read_image_files(spark, str(folder), "*.png").collect()}
    # Spark's reader of files leaves out empty ones.
    assert back == {path: content for path, content, _ in rows if content}
    # Written again with other bytes, files are replaced.
    image_files.write_image_files(images.where("p like '%1_é.png'").withColumn("content", F.lit(b"new")), str(folder), F.col("p"))
    assert _tree(folder)["images/s 1/c%201_é.png"] == b"new" and len(_tree(folder)) == 41


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    def broken(batches):
        for batch in batches:
            yield batch
        raise OSError("disk full")

    images = spark.range(10).select(F.concat(F.lit("a/"), "id").alias("p"), F.encode(F.lit("x"), "UTF-8").alias("content"))
    with pytest.raises(Exception, match="disk full"):
        checked = images.select("p", "content").coalesce(1)
        files_of = checked.select(F.col("p").alias("path"), "content").mapInArrow(broken, "path string, content binary")
        spark.dataSource.register(image_files.FileSource)
        files_of.write.format(image_files.FORMAT).mode("append").option("path", str(tmp_path / "out")).option("job", "j").save()
    assert _tree(tmp_path) == {}


def test_bad_paths_are_refused(spark, tmp_path):
    for paths in (["a", "a"], ["../a"], ["/a"], ["a//b"], [None], [""], ["a/."]):
        images = spark.createDataFrame([(p, bytearray(b"x")) for p in paths], "p string, content binary")
        with pytest.raises(ValueError):
            image_files.write_image_files(images, str(tmp_path), F.col("p"))
    image_files.write_image_files(images.limit(0), str(tmp_path / "none"), F.col("p"))
    assert _tree(tmp_path) == {"none/_SUCCESS": b'{"files": 0, "bytes": 0}'}


CARDS = [
    {"id": f"c{i}", "name": f'n{i} {{ "x" }} \\n    }},', "attacks": [{"name": "a", "cost": ["x", "y"]}] * (i % 3),
     "set": {"id": "s", "images": {"symbol": "u"}}} for i in range(300)
]


@pytest.mark.parametrize("indent, end", [(2, "\n"), (4, "\n"), ("\t", "\n"), (2, "\r\n")])
def test_large_envelopes_are_read_in_pieces(spark, tmp_path, indent, end):
    one = {"page": 1, "data": CARDS, "meta": {"deep": {"page": 99, "x": [{}]}, "list": [1]}, "count": 300, "totalCount": 1000}
    two = {"data": [], "page": 2, "pageSize": 250}
    (tmp_path / "in").mkdir()
    for name, envelope in (("one", one), ("two", two)):
        text = json.dumps(envelope, indent=indent).replace("\n", end)
        (tmp_path / "in" / f"{name}.json").write_bytes(text.encode())
    level = indent if isinstance(indent, str) else " " * indent
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        pieces = catalogue.read_large_envelopes(spark, str(tmp_path / "in"), level)
        assert pieces.rdd.getNumPartitions() > 8
        got = catalogue.large_envelope_cards(pieces)
        whole = catalogue.envelope_cards(catalogue.read_envelopes(spark, str(tmp_path / "in" / "one.json")))
        assert got.columns == whole.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect())) and got.count() == 300
        counts = {r.file[-8:]: tuple(r)[1:] for r in catalogue.large_envelope_pages(pieces, level).collect()}
        assert counts == {"one.json": (1, None, 300, 1000), "two.json": (2, 250, None, None)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
