import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deckweave.functions import vectors
from deckweave.operators import cells as cells_module
from deckweave.operators import match as matching
from deckweave.operators import nearest
from deckweave.operators.cells import BLOCKS, CellIndex
from deckweave.session import cut_lineage

_vector4 = st.lists(st.floats(-100, 100, width=32), min_size=4, max_size=4)

INDEX = "idx bigint, card_id string, embedding array<float>"
QUERIES = "query_id bigint, embedding array<float>"
NAN = float("nan")


def _score(a, b):
    """Cosine over the query's length, element by element; None where it can never win."""
    dot = aa = bb = 0.0
    for i, x in enumerate(a):
        x = NAN if x is None else float(np.float32(x))
        y = NAN if i >= len(b) or b[i] is None else float(np.float32(b[i]))
        dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
    one, two = math.sqrt(aa), math.sqrt(bb)
    if one == 0 or two == 0:
        return 0.0
    score = dot / (one * two)
    return None if math.isnan(score) else score


def brute(queries, index, threshold=0.15):
    found = {}
    for query_id, a in queries:
        best, place = -1.0, None
        for idx, card_id, b in sorted(index, key=lambda row: row[0]):
            if a is None or b is None or all(v == 0 for v in b):
                continue
            score = _score(a, b)
            if score is not None and score > best:
                best, place = score, (idx, card_id)
        matched = place is not None and best > threshold
        found[query_id] = (*place, best, True) if matched else (None, None, None, False)
    return found


def rows_of(df):
    rows = {r.query_id: (r.idx, r.card_id, r.score, r.matched) for r in df.collect()}
    return rows


CASES_INDEX = [
    (0, "zero", [0.0, 0.0, 0.0]),
    (1, "x", [1.0, 0.0, 0.0]),
    (2, "x again", [1.0, 0.0, 0.0]),
    (3, "x longer", [2.0, 0.0, 0.0, 9.0]),
    (4, "y", [0.0, 1.0, 0.0]),
    (5, "short", [1.0, 1.0]),
    (6, "nan", [NAN, 1.0, 1.0]),
    (7, "nan beyond", [0.0, 0.0, 1.0, NAN]),
    (8, "null", None),
    (9, "zero start", [0.0, 0.0, 0.0, 1.0]),
    (10, "null element", [None, 1.0, 1.0]),
    (11, "empty", []),
    (12, "infinite", [float("inf"), 1.0, 1.0]),
    (13, "diagonal", [3.0, 3.0, 3.0]),
]
CASES_QUERIES = [
    (1, [1.0, 0.0, 0.0]),
    (2, [0.0, 5.0, 0.0]),
    (3, [0.0, 0.0, 0.0]),
    (4, [-1.0, -1.0, -1.0]),
    (5, None),
    (6, [NAN, 1.0, 0.0]),
    (7, [1.0, 1.0]),
    (8, [1.0, 1.0, 1.0]),
    (9, [0.0, 0.0, 1.0]),
    (10, []),
    (11, [0.0, 0.0, 0.0, 2.0]),
    (12, [1.0] * 9),
    (13, [None, 1.0, 0.0]),
]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame(CASES_QUERIES, QUERIES), spark.createDataFrame(CASES_INDEX, INDEX)


def test_small_index_cases(cases):
    got = rows_of(matching.match(*cases))
    assert got == brute(CASES_QUERIES, CASES_INDEX)
    assert got[1][:2] == (1, "x") and got[11][1] == "zero start" and got[9][1] == "nan beyond"


def test_large_index_cases(cases):
    got = rows_of(matching.match_large_index(*cases, block_bytes=64))
    assert got == brute(CASES_QUERIES, CASES_INDEX)


def test_score_of_exactly_the_threshold_is_no_match(spark):
    index = [(1, "a", [1.0, 0.0])]
    queries = [(1, [3.0, 4.0]), (2, [0.61, 0.79])]
    frames = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(index, INDEX)
    for form in (matching.match_small_index, matching.match_large_index):
        got = rows_of(form(*frames, threshold=0.6))
        assert got == brute(queries, index, 0.6)
        assert not got[1][3] and got[2][3]


def test_negative_thresholds_are_refused(cases):
    for form in (matching.match_small_index, matching.match_large_index):
        with pytest.raises(ValueError):
            form(*cases, threshold=-0.1)


def _random_tables(seed, length=6, queries=150, index=400):
    """Clustered vectors; a third of the index and of the queries is one and the same vector."""
    random = np.random.default_rng(seed)
    centres = random.normal(size=(8, length))
    near = lambda: centres[random.integers(8)] + random.normal(scale=0.2, size=length)
    hot = near()
    rows = [
        (i, f"card {i}", [float(np.float32(v)) for v in (hot if i % 3 == 0 else near())])
        for i in range(index)
    ]
    asked = [
        (i, [float(np.float32(v)) for v in (hot * 2 if i % 3 == 0 else near())]) for i in range(queries)
    ]
    return asked, rows


@pytest.mark.parametrize("threshold", [0.15, 0.97])
def test_both_forms_equal_brute_force(spark, threshold):
    queries, index = _random_tables(1)
    frames = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(index, INDEX)
    expected = brute(queries, index, threshold)
    assert rows_of(matching.match(*frames, threshold)) == expected
    # Blocks of 20 vectors: crowded cells, several blocks per cell and groups per block.
    large = matching.match_large_index(*frames, threshold, pivots=7, block_bytes=20 * 8 * 6)
    assert rows_of(large) == expected
    assert {row[3] for row in expected.values()} == ({True} if threshold < 0.5 else {True, False})


def test_large_index_of_equal_directions(spark):
    """Vectors that differ only in length tie: the first wins, whatever block it is in."""
    index = [(i, f"c{i}", [float(100 - i), float(100 - i), 0.0]) for i in range(90)]
    index += [(100 + i, "far", [0.0, 0.0, float(i + 1)]) for i in range(30)]
    queries = [(i, [float(i + 1), float(i + 1), 0.0]) for i in range(40)]
    frames = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(index, INDEX)
    got = rows_of(matching.match_large_index(*frames, pivots=3, block_bytes=10 * 8 * 3))
    assert got == brute(queries, index)


def test_two_hundred_lengths_in_one_plan(spark):
    """Queries of 200 lengths over an index of many: one search, equal to comparing all pairs."""
    random = np.random.default_rng(9)
    vector = lambda n: [float(np.float32(v)) for v in random.normal(size=n)]
    index = [(i, f"c{i}", vector(int(random.integers(1, 230)))) for i in range(150)]
    index += [(900 + i, "long", index[149][2]) for i in range(5)]
    queries = [(n, vector(n)) for n in range(1, 201)] + [(300, vector(400)), (301, None), (302, [])]
    frames = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(index, INDEX)
    for threshold in (0.0, 0.3):
        found = matching.match_large_index(*frames, threshold, pivots=3, block_bytes=40 * 8 * 6)
        assert rows_of(found) == brute(queries, index, threshold)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and plan.count("Union") == 1


def test_later_queries_bring_lengths(spark):
    index = [(i, f"c{i}", [float(i % 7 + 1), float(i % 3), 1.0, float(i % 5)]) for i in range(60)]
    cells = CellIndex(spark.createDataFrame(index, INDEX), pivots=4, block_bytes=256)
    for length in (2, 4, 3, 2):
        queries = [(i, [1.0, float(i), 0.5, 2.0][:length]) for i in range(20)]
        assert rows_of(cells.match(spark.createDataFrame(queries, QUERIES))) == brute(queries, index)
    mixed = [(i, [1.0, float(i), 0.5, 2.0][: 2 + i % 3]) for i in range(20)] + [(30, None)]
    assert rows_of(cells.match(spark.createDataFrame(mixed, QUERIES))) == brute(mixed, index)
    assert len(cells._made) == 3


def _scattered(spark, count, lengths=(8,), seed=4):
    """Vectors without any structure, as queries of ids that repeat and as an index."""
    random = np.random.default_rng(seed)
    rows = [(i, f"c{i}", random.normal(size=lengths[i % len(lengths)]).astype(np.float32).tolist()) for i in range(count)]
    index = spark.createDataFrame(rows, INDEX)
    queries = index.select((F.col("idx") % 10).alias("query_id"), F.reverse("embedding").alias("embedding"), "idx")
    return queries, index


def _all_rows(df):
    return sorted(df.select("row", "query_id", "card_id", "score", "matched").collect())


def test_blocks_grow_with_the_index(spark):
    """Four times the vectors are not four times the blocks that a query visits."""
    for count in (1000, 4000):
        queries, index = _scattered(spark, count)
        cells = CellIndex(index, pivots=16, block_bytes=4 * 8 * 8)
        found = cells.match(queries.withColumnRenamed("idx", "row"), 0.15, ("row",))
        expected = matching.match_small_index(queries.withColumnRenamed("idx", "row"), index, 0.15, ("row",))
        assert _all_rows(found) == _all_rows(expected)
        assert BLOCKS <= cells._made[0].blocks <= 2 * BLOCKS + 1


def test_visits_of_repeated_ids_stay_few(spark, monkeypatch):
    """Every id on many rows: no row of queries is sent to more than the bounded number of blocks."""
    written = {}

    def kept(df, name):
        written[name] = cut_lineage(df, name)
        return written[name]

    monkeypatch.setattr(cells_module, "cut_lineage", kept)
    queries, index = _scattered(spark, 3000)
    zeros = F.transform("embedding", lambda x: F.lit(0).cast("float"))
    index = index.withColumn("embedding", F.when(F.col("idx") % 7 == 0, zeros).otherwise(F.col("embedding")))
    found = matching.match_large_index(queries.drop("idx"), index, pivots=16, block_bytes=4 * 8 * 8)
    small = matching.match_small_index(queries.drop("idx"), index)
    plain = lambda df: sorted(tuple((v is not None, v) for v in row) for row in df.collect())
    assert plain(found) == plain(small)
    most = written["routes"].agg(F.max(F.size("to.blocks"))).first()[0]
    assert 1 <= most <= 2 * BLOCKS + 1


def test_blocks_of_every_length_grow_with_the_index(spark):
    """Queries of two lengths over vectors of both: blocks are few for each length."""
    queries, index = _scattered(spark, 3000, lengths=(8, 4, 8))
    cells = CellIndex(index, pivots=16, block_bytes=4 * 8 * 8)
    found = cells.match(queries.withColumnRenamed("idx", "row"), 0.15, ("row",))
    expected = matching.match_small_index(queries.withColumnRenamed("idx", "row"), index, 0.15, ("row",))
    assert _all_rows(found) == _all_rows(expected)
    made = cells._made[0]
    assert sorted(made.cells) == [4, 8] and all(own.parts.sum() <= 2 * BLOCKS + 1 for own in made.cells.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(_vector4, min_size=1, max_size=9), st.lists(_vector4, min_size=1, max_size=9))
def test_quantised_bounds_hold(queries, index):
    q, x = np.array(queries, np.float32), np.array(index, np.float32)
    low, high = nearest.best_bounds(nearest.quantised(q), nearest.quantised(x))
    best = (nearest.unit_rows(q) @ nearest.unit_rows(x).T).max(axis=1)
    assert (low <= best).all() and (best <= high).all() and (high - low < 0.2).all()


def test_quantised_vectors_are_a_byte_per_element():
    random = np.random.default_rng(3)
    matrix = random.normal(size=(50, 64)) * 10.0 ** random.integers(-5, 6, size=(50, 1))
    codes, scales, errors = nearest.quantised(matrix)
    assert codes.dtype == np.int8 and codes.nbytes * 8 == matrix.nbytes
    rest = nearest.unit_rows(matrix) - codes * scales[:, None].astype(float)
    sizes = np.linalg.norm(rest, axis=1)
    assert np.allclose(sizes, errors) and (sizes <= errors).all() and errors.max() < 0.02
    rows = pa.array(nearest.packed(codes, scales, errors), pa.binary())
    for part in (rows, rows.slice(7, 20)):
        first = part.offset
        for one, two in zip(nearest.unpacked(part), (codes, scales, errors)):
            assert (one == two[first : first + len(part)]).all()
    assert not nearest.quantised(np.zeros((1, 3)))[0].any()


def test_index_order_may_be_text(spark):
    index = spark.createDataFrame(
        [("b", "second", [1.0, 0.0]), ("a", "first", [2.0, 0.0])],
        "idx string, card_id string, embedding array<double>",
    )
    queries = spark.createDataFrame([(1, [1.0, 0.0])], QUERIES)
    for form in (matching.match_small_index, matching.match_large_index):
        assert rows_of(form(queries, index))[1][:2] == ("a", "first")


def test_empty_tables(spark, cases):
    queries, index = cases
    for form in (matching.match_small_index, matching.match_large_index):
        none = rows_of(form(queries, index.where("false")))
        assert set(none.values()) == {(None, None, None, False)} and len(none) == len(CASES_QUERIES)
        assert rows_of(form(queries.where("false"), index)) == {}


def test_match_chooses_by_measured_size(spark, cases, monkeypatch):
    queries, index = cases
    chosen = []
    monkeypatch.setattr(matching, "match_small_index", lambda *a, **k: chosen.append("small"))
    monkeypatch.setattr(matching, "match_large_index", lambda *a, **k: chosen.append("large"))
    size = matching.index_bytes(index)
    matching.match(queries, index, small_bytes=size)
    matching.match(queries, index, small_bytes=size - 1)
    assert chosen == ["small", "large"]


def test_small_index_does_not_shuffle(spark, cases):
    plan = matching.match(*cases)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


def test_scored_rows(spark):
    scored = spark.createDataFrame(
        [
            (1, 5, "e", 0.5), (1, 2, "b", 0.5), (1, 3, "n", NAN), (1, 4, "z", None),
            (2, 1, "a", -1.0), (3, 1, "a", 0.15), (4, 1, "a", 0.1500001),
        ],
        "query_id bigint, idx int, card_id string, score double",
    )
    best = matching.best_per_query(scored)
    assert sorted(tuple(r) for r in best.collect()) == [
        (1, 2, "b", 0.5), (3, 1, "a", 0.15), (4, 1, "a", 0.1500001),
    ]
    above = matching.above(best)
    queries = spark.range(1, 6).toDF("query_id")
    kept = sorted(tuple(r) for r in matching.keep_unmatched(queries, above).select("query_id", "card_id", "matched").collect())
    assert kept == [(1, "b", True), (2, None, False), (3, None, False), (4, "a", True), (5, None, False)]
    cards = spark.createDataFrame([("b", "Bee")], "card_id string, name string")
    named = matching.with_card(matching.keep_unmatched(queries, above), cards)
    assert {r.query_id: r.name for r in named.collect()} == {1: "Bee", 2: None, 3: None, 4: None, 5: None}


def test_cosine_column(spark):
    pairs = [(a, b) for _, a in CASES_QUERIES for _, _, b in CASES_INDEX if a is not None and b is not None]
    df = spark.createDataFrame(pairs, "a array<float>, b array<float>")
    for row in df.select("a", "b", vectors.cosine(F.col("a"), F.col("b")).alias("s")).collect():
        expected = _score(row.a, row.b)
        got = None if row.s is None or math.isnan(row.s) else row.s
        assert got == expected, row


def test_placeholders(spark):
    df = spark.createDataFrame([([0.0, -0.0],), ([0.0, NAN],), ([],), ([0.0, 1.0],), (None,)], "v array<float>")
    rows = df.select(vectors.is_placeholder(F.col("v")), vectors.or_placeholder(F.col("v"), 3)).collect()
    assert [r[0] for r in rows] == [True, False, True, False, None]
    assert rows[4][1] == [0.0, 0.0, 0.0]
    assert matching.without_placeholders(df.withColumnRenamed("v", "embedding")).count() == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(_vector4, min_size=1, max_size=12), st.lists(_vector4, min_size=1, max_size=12))
def test_first_best_is_the_brute_force_answer(queries, index):
    q, x = np.array(queries, np.float32), np.array(index, np.float32)
    rows, scores = nearest.first_best(q, x, 0.15)
    for at, a in enumerate(q):
        best, place = 0.15, -1
        for i, b in enumerate(x):
            score = _score(a, b)
            if score is not None and score > best:
                best, place = score, i
        assert rows[at] == place
        assert place < 0 or scores[at] == best


@pytest.mark.parametrize("spread", [0.0, 1e-9, 1e-7, 1e-5, 1e-2])
def test_first_best_among_near_copies(spread):
    """Many vectors closer to each other than single precision can tell apart."""
    random = np.random.default_rng(7)
    base = random.normal(size=24)
    index = base + spread * random.normal(size=(5000, 24))
    queries = base + spread * random.normal(size=(40, 24))
    rows, scores = nearest.first_best(queries, index, 0.15)
    for at, query in enumerate(queries):
        exact = nearest.exact_scores(np.broadcast_to(query, index.shape), index)
        assert rows[at] == exact.argmax() and scores[at] == exact.max()


@settings(max_examples=60, deadline=None)
@given(_vector4, _vector4)
def test_cosine_is_symmetric_and_bounded(a, b):
    one, two = np.array([a]), np.array([b])
    left, right = nearest.exact_scores(one, two)[0], nearest.exact_scores(two, one)[0]
    assert left == right and abs(left) <= 1 + 1e-12


def test_index_rows_hold_the_vectors_once():
    """Searching takes little memory beside the index, whose vectors are in order and without nulls."""
    random = np.random.default_rng(5)
    matrix = random.normal(size=(40000, 64)).astype(np.float32)
    matrix[100:200] = matrix[7]
    matrix[300] = NAN
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(matrix.ravel()), 64).cast(pa.list_(pa.float32()))
    ids = pa.array(range(len(matrix)))
    index = nearest.IndexRows(pa.table({"idx": ids, "card_id": ids, "embedding": vectors}))
    asked = pa.array([matrix[i, :n].tolist() for i in (150, 7, 1234) for n in (64, 32)])
    tracemalloc.start()
    rows, scores = index.search(asked, 0.15)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows.tolist() == [7, 7, 7, 7, 1234, 1234] and (scores > 0.999).all()
    assert peak < matrix.nbytes


def test_ties_between_lengths_go_to_the_first_row():
    vectors = [[0.0, 1.0, 5.0], [1.0, 0.0], [1.0, 0.0, 7.0], [0.0, 1.0], [1.0, 0.0, NAN]]
    for order in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [2, 3, 0, 4, 1]):
        held = [vectors[i] for i in order]
        ids = pa.array(range(len(held)))
        index = nearest.IndexRows(pa.table({"idx": ids, "card_id": ids, "embedding": pa.array(held)}))
        rows, _ = index.search(pa.array([[2.0, 0.0], [0.0, 3.0], [1.0, 0.0, 7.0], [-1.0, -1.0]]), 0.15)
        alike = [min(k for k, v in enumerate(held) if v[:2] == two) for two in ([1.0, 0.0], [0.0, 1.0])]
        assert rows.tolist() == [*alike, order.index(2), -1]
