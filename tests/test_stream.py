import pytest
from pyspark.sql import functions as F
from stubs import Bytes

from deckweave.operators import match as matching
from deckweave.plans import scan
from deckweave.session import cut_lineage
from deckweave.sources import files
from deckweave.streaming import sink as batches
from deckweave.streaming.scan import start_scan


CATALOGUE = {"c1": b"aaaa", "c2": b"bbbb", "c3": b"aabb", "c4": b"x", "c5": b"cc"}
ARRIVALS = {"q1.img": b"aab", "q2.img": b"abab", "q3.img": b"x", "q4.img": b"dddd", "q5.img": b"none"}
EXPECTED = {
    "q1.img": ("c3", True, None, None),
    "q2.img": ("c3", True, None, None),
    "q3.img": (None, False, "OSError: broken image", "Failed to scan image."),
    "q4.img": (None, False, None, "No matching card found."),
    "q5.img": (None, False, "the model gave no vector", "Failed to scan image."),
}


@pytest.fixture(scope="module")
def index(spark):
    cards = spark.createDataFrame(
        [(k, bytearray(v)) for k, v in CATALOGUE.items()], "id string, content binary"
    )
    return cut_lineage(scan.build_index(cards, Bytes, "content", length=4), "index")


def test_build_index(index):
    rows = {r.card_id: r for r in index.collect()}
    assert rows["c3"].embedding == [2.0, 2.0, 0.0, 0.0] and rows["c3"].error is None
    assert rows["c4"].embedding == [0.0] * 4 and rows["c4"].error == "OSError: broken image"


def _arrive(folder, names):
    for name in names:
        (folder / name).write_bytes(ARRIVALS[name])


def _results(spark, sink):
    rows = spark.read.parquet(sink).collect()
    return {r.query_id.rsplit("/", 1)[1]: (r.card_id, r.matched, r.error, r.message) for r in rows}, len(rows)


@pytest.mark.parametrize("small_bytes", [matching.SMALL_INDEX_BYTES, 0])
def test_images_are_matched_once_as_they_arrive(spark, index, tmp_path, small_bytes):
    inbox, sink, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    inbox.mkdir()

    def run():
        images = files.stream_images(spark, str(inbox), "*.img")
        start_scan(images, index, sink, log, Bytes, small_bytes=small_bytes).awaitTermination()

    _arrive(inbox, ["q1.img", "q3.img"])
    run()
    assert _results(spark, sink) == ({k: EXPECTED[k] for k in ("q1.img", "q3.img")}, 2)
    _arrive(inbox, ["q2.img", "q4.img", "q5.img"])
    run()
    run()
    assert _results(spark, sink) == (EXPECTED, 5)


@pytest.mark.parametrize("small_bytes", [matching.SMALL_INDEX_BYTES, 0])
def test_tables_give_what_streams_give(spark, index, tmp_path, monkeypatch, small_bytes):
    _arrive(tmp_path, ARRIVALS)
    images = files.read_images(spark, str(tmp_path), "*.img")
    monkeypatch.setattr(matching, "SMALL_INDEX_BYTES", small_bytes)
    if not small_bytes:
        monkeypatch.setattr(matching, "match_small_index", None)
    found = scan.match_images(images, index, Bytes, "content", "path")
    got = {r.query_id.rsplit("/", 1)[1]: (r.card_id, r.matched, r.error, r.message) for r in found.collect()}
    assert got == EXPECTED


@pytest.mark.parametrize("small_bytes", [matching.SMALL_INDEX_BYTES, 0])
def test_repeated_ids_of_a_stream(spark, index, tmp_path, small_bytes):
    source = tmp_path / "in"
    rows = [(7, [1.0, 0.0, 0.0, 0.0], None), (7, [0.0, 1.0, 0.0, 0.0], None), (7, None, "bad file"), (None, [1.0, 1.0, 0.0, 0.0], None)]
    schema = "query_id bigint, embedding array<float>, error string"
    spark.createDataFrame(rows, schema).write.parquet(str(source))
    arriving = spark.readStream.schema(schema).parquet(str(source))
    sink = str(tmp_path / "out")
    start_scan(arriving, index, sink, str(tmp_path / "log"), small_bytes=small_bytes).awaitTermination()
    found = spark.read.parquet(sink)
    assert found.columns == ["query_id", "idx", "card_id", "score", "matched", "error", "message", "batch"]
    got = sorted((str(r.query_id), str(r.card_id), str(r.error)) for r in found.collect())
    assert got == [("7", "None", "bad file"), ("7", "c1", "None"), ("7", "c2", "None"), ("None", "c3", "None")]


def test_a_vector_stream_needs_no_embedder(spark, index, tmp_path):
    source = tmp_path / "in"
    rows = [(1, [1.0, 0.0, 0.0, 0.0], None), (2, None, "bad file")]
    schema = "query_id bigint, embedding array<float>, error string"
    spark.createDataFrame(rows, schema).write.parquet(str(source))
    arriving = spark.readStream.schema(schema).parquet(str(source))
    start_scan(arriving, index, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("query_id", "card_id", "message")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "c1", None), (2, None, "Failed to scan image.")]


def test_stream_keeps_no_state(spark, index, tmp_path):
    images = files.stream_images(spark, str(tmp_path))
    queries = scan.embed_queries(images, Bytes, "content", "path")
    hit = matching.hit_column(index)
    plan = queries.select(F.col("query_id"), hit)._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def _files(folder):
    return [p for p in folder.rglob("*.parquet") if "_manifest" not in str(p)]


def test_lost_and_repeated_batches(spark, index, tmp_path, monkeypatch):
    """A batch whose entry is lost is written again; one whose stream forgot it is left out."""
    inbox, sink, log = tmp_path / "in", tmp_path / "out", tmp_path / "log"
    inbox.mkdir()

    def run(checkpoint=log):
        images = files.stream_images(spark, str(inbox), "*.img")
        start_scan(images, index, str(sink), str(checkpoint), Bytes).awaitTermination()

    def met():
        rows = batches.read_batches(spark, str(sink)).collect()
        return sorted(r.query_id.rsplit("/", 1)[1] for r in rows)

    with pytest.raises(ValueError):
        batches.read_batches(spark, str(sink))
    _arrive(inbox, ["q1.img"])
    run()
    _arrive(inbox, ["q2.img", "q3.img"])
    with monkeypatch.context() as patch:
        patch.setattr(batches, "_enter", lambda *a: 1 / 0)
        with pytest.raises(Exception):
            run()
    assert met() == ["q1.img"] and (sink / "batch=1").is_dir()
    run()
    assert met() == ["q1.img", "q2.img", "q3.img"]
    # The log of the last batch is gone: the stream repeats it.
    (log / "commits" / "1").unlink()
    (log / "commits" / ".1.crc").unlink(missing_ok=True)
    before = _files(sink)
    run()
    assert met() == ["q1.img", "q2.img", "q3.img"] and _files(sink) == before
    assert batches.write_batch(spark.range(1).toDF("query_id"), str(sink), 0) is False


def test_compaction_bounds_the_files(spark, index, tmp_path):
    inbox, sink, log = tmp_path / "in", tmp_path / "out", tmp_path / "log"
    inbox.mkdir()
    for i in range(11):
        (inbox / f"a{i:02d}.img").write_bytes(b"aab" if i % 2 else b"x")
        images = files.stream_images(spark, str(inbox), "*.img")
        start_scan(images, index, str(sink), str(log), Bytes, compact_every=3).awaitTermination()
        rows = batches.read_batches(spark, str(sink)).collect()
        assert sorted((r.query_id[-7:], r.batch) for r in rows) == [(f"a{k:02d}.img", k) for k in range(i + 1)]
        # Batches since the compaction before the last one, and a file for each segment.
        assert len(_files(sink)) <= 6 + (i + 1) // 3
    assert [(e.first, e.last) for e in batches.finished(spark, str(sink))] == [(0, 2), (3, 5), (6, 8), (9, 9), (10, 10)]
    # A batch that a segment holds is not written again, and a lost compaction changes nothing.
    assert batches.write_batch(spark.range(1).toDF("query_id"), str(sink), 4) is False
    spark.range(3).write.parquet(str(sink / "_segments" / "0-9-lost"))
    assert batches.read_batches(spark, str(sink)).count() == 11
    assert batches.compact(spark, str(sink)) == 2 and batches.read_batches(spark, str(sink)).count() == 11
