"""An index of any size, split into cells once and searched many times.

The join of two sets of vectors on nearest neighbours by Voronoi cells (Lu et al., VLDB 2012), with
angles as the metric and vectors quantised to a byte per element on the way (as vector files do, Weber
et al., VLDB 1998). A query visits the cells that may hold something as good as what it knows already,
by the triangle inequality, with quantised vectors on both sides. Neighbouring cells travel together
as a block, so that the visits of a query do not grow with the index. That bounds the best score in each
block from both sides; only blocks whose upper bound reaches the best lower bound are scored exactly.
Nothing is approximate, and no pair of vectors leaves a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deckweave.operators import nearest
from deckweave.operators.index import (
    SMALL_INDEX_BYTES,
    THRESHOLD,
    check_threshold,
    collapse_copies,
    hit_type,
    usable,
    without_placeholders,
)
from deckweave.session import cut_lineage, lasting_tables

BLOCK_BYTES = 64 << 20
# Blocks grow with the index, up to BLOCK_BYTES each, before there are more than about twice as many of a length.
BLOCKS = 32
PIVOTS = 1024
ROWS_PER_PIVOT = 32
# Pivots of all lengths together, as a multiple of those of one length.
LENGTH_PIVOTS = 16
RINGS = 64
MERGED_RINGS = 8
SUB_BLOCKS = 1 << 24
# A table with a row per block is broadcast up to this number of blocks, 16 bytes each.
BROADCAST_BLOCKS = 1 << 20

# Angles come from arccos of rounded cosines; near 0 that loses half of the digits.
_ANGLE_SLACK = 1e-6
_SCORE_SLACK = 1e-9

# Elements of the matrix of bounds (queries × cells) held at a time.
_BOUND_ELEMENTS = 1 << 20


def _merged_rings(rings: list[tuple], block_rows: int) -> list[list[tuple]]:
    """Neighbouring rings of a pivot together until they fill a block.

    ``rings`` are ``(ring, low, high, rows)``, at most pivots × rings of them. A cell spans few
    rings even where it stays small: a wide cell has a weak bound and every query visits it.
    """
    cells: list[list[tuple]] = []
    rows = 0
    for ring in sorted(rings):
        band = ring[0] // MERGED_RINGS
        same_band = cells and cells[-1][0][0] // MERGED_RINGS == band
        if same_band and rows < block_rows:
            cells[-1].append(ring)
            rows += ring[3]
        else:
            cells.append([ring])
            rows = ring[3]
    return cells


def _near_each_other(pivots: np.ndarray) -> np.ndarray:
    """The pivots, scaled to length 1, in an order where neighbours have the same one of the first few nearest."""
    few = pivots[: math.isqrt(len(pivots))]
    return pivots[np.argsort((pivots @ few.T).argmax(axis=1), kind="stable")]


def _grouped(cells: list[list[tuple]], block_rows: int) -> list[list[list[tuple]]]:
    """Neighbouring cells together as long as they fit a block; one that is larger stays alone."""
    groups: list[list[list[tuple]]] = []
    rows = 0
    for cell in cells:
        own = sum(ring[3] for ring in cell)
        if groups and rows + own <= block_rows:
            groups[-1].append(cell)
            rows += own
        else:
            groups.append([cell])
            rows = own
    return groups


class _Cells:
    """Cells around the pivots of one length: for each, the range of angles of its vectors.

    ``known`` are vectors of the index, of which the best gives a first bound to a query.
    """

    def __init__(self, pivots: np.ndarray, known: np.ndarray, first: int):
        self.pivots = _near_each_other(nearest.unit_rows(pivots))
        self.known = nearest.unit_rows(known)
        # Number of the first pivot among those of all lengths.
        self.first = first
        self.fill([], 1)

    def fill(self, groups: list[list[list[tuple]]], block_rows: int) -> None:
        cells = [cell for group in groups for cell in group]
        self.low = np.array([c[0][1] for c in cells], dtype=np.float64)
        self.high = np.array([c[-1][2] for c in cells], dtype=np.float64)
        self.owner = np.array([c[0][0] for c in cells], dtype=np.int64) // RINGS - self.first
        # A group is named by its first ring; its cells follow each other.
        self.group = np.array([g[0][0][0] for g in groups], dtype=np.int64)
        self.starts = np.cumsum([0] + [len(g) for g in groups], dtype=np.int64)[:-1]
        self.parts = np.array(
            [math.ceil(sum(ring[3] for cell in g for ring in cell) / block_rows) for g in groups], dtype=np.int64
        )
        self.step = max(1, _BOUND_ELEMENTS // max(1, len(cells), len(self.known)))

    def rings(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ring of each vector (nearest pivot and band of angles) and its angle to the pivot."""
        ring, angle = _angle_rings(self.pivots, matrix)
        return ring + self.first * RINGS, angle

    def visits(self, queries: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
        """For each query the blocks that may hold a vector as good as the best one known."""
        for low in range(0, len(queries), self.step):
            units = nearest.unit_rows(queries[low : low + self.step])
            angles = np.arccos(np.clip(units @ self.pivots.T, -1.0, 1.0))[:, self.owner]
            gaps = np.maximum(np.maximum(angles - self.high, self.low - angles), 0.0)
            bound = np.cos(np.maximum(gaps - _ANGLE_SLACK, 0.0))
            reached = np.maximum((units @ self.known.T).max(axis=1, initial=-1.0), threshold) - _SCORE_SLACK
            inside = bound >= reached[:, None]
            for row in np.logical_or.reduceat(inside, self.starts, axis=1) if len(self.starts) else inside:
                chosen = np.flatnonzero(row)
                parts = self.parts[chosen]
                ends = np.cumsum(parts)
                yield np.repeat(self.group[chosen] * SUB_BLOCKS, parts) + (
                    np.arange(int(parts.sum())) - np.repeat(ends - parts, parts)
                )


def _angle_rings(pivots: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ring of each vector (nearest pivot and band of angles) and its angle to the pivot.

    Pivots come scaled to length 1.
    """
    cosines = np.clip(nearest.unit_rows(matrix) @ pivots.T, -1.0, 1.0)
    owner = cosines.argmax(axis=1)
    angle = np.arccos(cosines[np.arange(len(owner)), owner])
    ring = np.minimum((angle * (RINGS / math.pi)).astype(np.int64), RINGS - 1)
    return owner * RINGS + ring, angle


@dataclass(frozen=True)
class _Blocks:
    """The index for queries of some lengths: its vectors by block, and the cells by length."""

    rows: DataFrame
    cells: dict[int, _Cells]
    pivots: int
    blocks: int
    block_bytes: int


class CellIndex:
    """Index vectors in cells, made for the lengths of the queries that come.

    The cells live as long as this object, so a stream makes them once and not per batch. Cells hold
    about ``block_bytes`` at most, and so do blocks of a small index; those of a larger one grow with
    it, up to ``BLOCK_BYTES``.
    """

    def __init__(self, index: DataFrame, pivots: int = PIVOTS, block_bytes: int = BLOCK_BYTES):
        self.index = index.select("idx", "card_id", "embedding")
        self.pivots = pivots
        self.block_bytes = block_bytes
        self._made: list[_Blocks] = []

    def match(
        self, queries: DataFrame, threshold: float = THRESHOLD, carry: tuple[str, ...] = ()
    ) -> DataFrame:
        """``(query_id, …, idx, card_id, score, matched)``, one row per query row.

        The queries are written first, each row with a key of its own, so that ids may repeat or be
        null and a model that makes the vectors runs once. ``carry`` names columns to keep. Each
        length of query cuts the index differently; all lengths are searched in one job, their cells
        and blocks numbered through.
        """
        check_threshold(threshold)
        who = F.struct("query_id", *carry).alias("who")
        keyed = queries.select(F.monotonically_increasing_id().alias("row"), who, "embedding")
        written = cut_lineage(keyed, "asked")
        # One row per length of vector, not per query: n lengths take n² / 2 elements of queries.
        sizes = written.where(F.size("embedding") > 0).select(F.size("embedding")).distinct()
        held = {length for made in self._made for length in made.cells}
        new = sorted({row[0] for row in sizes.collect()} - held)
        if new:
            with lasting_tables():
                self._made.append(self._cut(new))
        none = written.select("row", "who", F.lit(None).cast(hit_type(self.index)).alias("hit"))
        if not self._made:  # no query has a vector
            return _top(none)
        found = _search(written, self._all(), threshold)
        return _top(none.unionByName(found, allowMissingColumns=True))

    def _all(self) -> _Blocks:
        """What was made so far as one; more than one only where later batches brought new lengths."""
        return _Blocks(
            reduce(DataFrame.unionByName, [made.rows for made in self._made]),
            {length: cells for made in self._made for length, cells in made.cells.items()},
            sum(made.pivots for made in self._made),
            sum(made.blocks for made in self._made),
            max(made.block_bytes for made in self._made),
        )

    def _cut(self, lengths: list[int]) -> _Blocks:
        """Cells for some lengths. An index vector stands in those of each length that it has elements for."""
        first = sum(made.pivots for made in self._made)
        cells = self._cells(lengths, first)
        fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.size("embedding"))
        cut = (
            without_placeholders(self.index)
            .select("idx", "card_id", "embedding", F.explode(fitting).alias("length"))
            .select("idx", "card_id", F.slice("embedding", 1, F.col("length")).alias("embedding"))
            .where(usable("embedding"))
        )
        placed = _placed(cut, cells)
        # At most pivots × rings rows, whatever the size of the index.
        summary = placed.groupBy("ring").agg(
            F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("rows")
        )
        rings = sorted(tuple(row) for row in summary.collect())
        of_length = {
            length: [r for r in rings if own.first <= r[0] // RINGS < own.first + len(own.pivots)] for length, own in cells.items()
        }
        most = max(8 * length * sum(ring[3] for ring in own) for length, own in of_length.items())
        block_bytes = max(self.block_bytes, min(BLOCK_BYTES, most // BLOCKS))
        merged = []
        for length, own in cells.items():
            cell_rows, block_rows = (max(1, size // (8 * length)) for size in (self.block_bytes, block_bytes))
            groups = _grouped(_merged_rings(of_length[length], cell_rows), block_rows)
            own.fill(groups, block_rows)
            merged += [
                (ring[0], int(name), int(parts))
                for group, name, parts in zip(groups, own.group, own.parts) for cell in group for ring in cell
            ]
        spark = cut.sparkSession
        columns = list(zip(*merged)) or [(), (), ()]
        group_of_ring = spark.createDataFrame(
            pa.table({name: pa.array(values, pa.int64()) for name, values in zip(("ring", "group", "parts"), columns)})
        )
        part = F.pmod(F.xxhash64("idx"), "parts")
        rows = placed.join(F.broadcast(group_of_ring), "ring").select(
            (F.col("group") * SUB_BLOCKS + part).alias("block"), "idx", "card_id", "embedding", "quantised"
        )
        return _Blocks(
            rows, cells, sum(len(own.pivots) for own in cells.values()),
            sum(int(own.parts.sum()) for own in cells.values()), block_bytes,
        )

    def _cells(self, lengths: list[int], first: int) -> dict[int, _Cells]:
        """Pivots of each length: distinct index vectors in hash order, bounded in number and bytes.

        One sample serves all lengths. A filter on the hash comes first and leaves about four times
        as many, so tasks send few vectors however many they are. A length of which the sample has no
        vector gets the first axis, which bounds no query, but parts the index as any direction does.
        """
        rows = self.index.count()
        wanted = math.ceil(rows / ROWS_PER_PIVOT)
        count = max(1, min(self.pivots, wanted, SMALL_INDEX_BYTES // (16 * lengths[-1])))
        # Vectors kept for all lengths together are bounded in bytes.
        each = max(1, min(count, LENGTH_PIVOTS * self.pivots // len(lengths), SMALL_INDEX_BYTES // (16 * sum(lengths))))
        cut = without_placeholders(self.index).select("idx", F.slice("embedding", 1, lengths[-1]).alias("embedding"))
        few = cut.where(F.pmod(F.xxhash64("idx"), F.lit(max(1, rows // (4 * count)))) == 0)
        sample = few.orderBy(F.xxhash64("idx"), "idx").limit(2 * count).select("embedding").toArrow()
        if sample.num_rows == 0:  # few usable vectors among many rows
            sample = cut.orderBy("idx").limit(count).select("embedding").toArrow()
        by_length = nearest.matrices(nearest.one_chunk(sample["embedding"]))
        cells = {}
        for length in lengths:
            parts = [matrix[:, :length].astype(np.float64) for size, (_, matrix) in sorted(by_length.items()) if size >= length]
            vectors = np.concatenate([np.zeros((0, length)), *parts])
            vectors = vectors[np.isfinite(vectors).all(axis=1) & vectors.any(axis=1)]
            firsts = np.sort(np.unique(vectors, axis=0, return_index=True)[1])[: 2 * each]
            known = vectors[firsts]
            pivots = known[:each] if len(known) else np.eye(1, length)
            cells[length] = _Cells(pivots, known, first)
            first += len(pivots)
        return cells


def _quantised(vectors: pa.Array, rows: int) -> pa.Array:
    """A column of vectors of any lengths, quantised, a bounded number of rows at a time."""
    made: list[bytes] = [b""] * len(vectors)
    for at, matrix in nearest.matrices(vectors).values():
        for low in range(0, len(at), rows):
            found = nearest.packed(*nearest.quantised(matrix[low : low + rows]))
            for row, code in zip(at[low : low + rows].tolist(), found):
                made[row] = code
    return pa.array(made, pa.binary())


def _placed(index: DataFrame, cells: dict[int, _Cells]) -> DataFrame:
    """Distinct index vectors with ring, angle and quantised form, written to the shared folder."""
    shared_cells = index.sparkSession.sparkContext.broadcast(cells)
    kind = T.StructType(
        [T.StructField("ring", T.LongType()), T.StructField("angle", T.DoubleType()), T.StructField("quantised", T.BinaryType())]
    )

    @F.arrow_udf(kind)
    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            rings, angles = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
            for length, (at, matrix) in nearest.matrices(vectors).items():
                for low in range(0, len(at), nearest.QUERY_STEP):
                    own = at[low : low + nearest.QUERY_STEP]
                    rings[own], angles[own] = shared_cells.value[length].rings(matrix[low : low + nearest.QUERY_STEP])
            yield pa.StructArray.from_arrays(
                [pa.array(rings), pa.array(angles), _quantised(vectors, nearest.QUERY_STEP)],
                names=["ring", "angle", "quantised"],
            )

    distinct = collapse_copies(index).withColumn("at", place("embedding"))
    return cut_lineage(distinct.select("idx", "card_id", "embedding", "at.*"), "cells")


def _search(written: DataFrame, blocks: _Blocks, threshold: float) -> DataFrame:
    """Best hits ``(row, hit)`` of usable queries in the blocks that may hold them."""
    spark = written.sparkSession
    shared_cells = spark.sparkContext.broadcast(blocks.cells)
    kind = T.StructType(
        [T.StructField("blocks", T.ArrayType(T.LongType())), T.StructField("quantised", T.BinaryType())]
    )

    @F.arrow_udf(kind)
    def route(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            lists: list = [None] * len(vectors)
            for length, (at, matrix) in nearest.matrices(vectors).items():
                for row, chosen in zip(at.tolist(), shared_cells.value[length].visits(matrix, threshold)):
                    lists[row] = chosen
            yield pa.StructArray.from_arrays(
                [pa.array(lists, pa.list_(pa.int64())), _quantised(vectors, nearest.QUERY_STEP)],
                names=["blocks", "quantised"],
            )

    asked = written.where((F.size("embedding") > 0) & usable("embedding"))
    routed = cut_lineage(asked.select("row", F.size("embedding").alias("length"), route("embedding").alias("to")), "routes")
    visits = routed.select("row", "length", "to.quantised", F.explode("to.blocks").alias("block"))
    bounds = _bounds(visits, blocks)
    # As many entries for a query as its list of blocks had.
    best = bounds.groupBy("row").agg(
        F.max("length").alias("length"), F.max("low").alias("low"),
        F.collect_list("block").alias("blocks"), F.collect_list("high").alias("highs"),
    )
    least = F.greatest(F.col("low"), F.lit(threshold)) - _SCORE_SLACK
    # Both lists are in the same order, and neither has nulls.
    open_blocks = F.filter("blocks", lambda block, i: F.get("highs", i) >= least)
    chosen = cut_lineage(
        best.select("row", "length", open_blocks.alias("blocks")).where(F.size("blocks") > 0), "visits"
    )
    exact = written.join(chosen, "row").select("row", "embedding", F.explode("blocks").alias("block"))
    counted = chosen.select("length", F.explode("blocks").alias("block"))
    return _score(exact, counted, blocks, threshold)


def _crowded(visits: DataFrame, blocks: _Blocks) -> DataFrame:
    """Into how many groups the visits of a block go, so that no group grows with the data.

    One row per block, from partial counts; broadcast where blocks are few enough.
    """
    queries = F.count(F.lit(1)) * F.max("length") * 8
    crowded = visits.groupBy("block").agg(F.ceil(queries / blocks.block_bytes).alias("shares"))
    return F.broadcast(crowded) if blocks.blocks <= BROADCAST_BLOCKS else crowded


def _dealt(visits: DataFrame, blocks: _Blocks, crowded: DataFrame, asked: list[str], held: list[str]):
    """Visits, and the blocks that they go to, grouped by block and share."""
    left = visits.join(crowded, "block").select(
        "block", F.pmod(F.xxhash64("row"), "shares").alias("share"), "row", *asked
    )
    share = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("share")
    right = blocks.rows.select("block", *held).join(crowded, "block").select("block", share, *held)
    return left.groupBy("block", "share").cogroup(right.groupBy("block", "share"))


def _bounds(visits: DataFrame, blocks: _Blocks) -> DataFrame:
    """``row, length, block, low, high`` for every visit: bounds on the best score in the block.

    Vectors cross the shuffle as a byte per element.
    """

    def numbers(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return nearest.unpacked(nearest.one_chunk(rows["quantised"]))

    def bounded(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not (asked.num_rows and held.num_rows):  # a share without visits, or a part without vectors
            return none
        queries = numbers(asked)
        low, high = nearest.best_bounds(queries, numbers(held))
        length = np.full(len(low), queries[0].shape[1], np.int32)
        return pa.table({"row": asked["row"], "length": length, "block": asked["block"], "low": low, "high": high})

    fields = [("row", pa.int64()), ("length", pa.int32()), ("block", pa.int64()), ("low", pa.float64()), ("high", pa.float64())]
    none = pa.schema(fields).empty_table()
    crowded = _crowded(visits, blocks)
    groups = _dealt(visits, blocks, crowded, ["quantised"], ["quantised"])
    return groups.applyInArrow(bounded, "row bigint, length int, block bigint, low double, high double")


def _score(exact: DataFrame, counted: DataFrame, blocks: _Blocks, threshold: float) -> DataFrame:
    """``row, hit`` for every visit in ``exact``: the best row of the block, by exact scores."""

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        vectors = nearest.one_chunk(asked["embedding"])
        found = nearest.hits(nearest.IndexRows(held, copies=False), vectors, threshold)
        return pa.table({"row": asked["row"], "hit": found})

    hit = T.StructType([blocks.rows.schema["idx"], blocks.rows.schema["card_id"], T.StructField("score", T.DoubleType())])
    groups = _dealt(exact, blocks, _crowded(counted, blocks), ["embedding"], ["idx", "card_id", "embedding"])
    return groups.applyInArrow(best, T.StructType([exact.schema["row"], T.StructField("hit", hit)]))


def _top(best: DataFrame) -> DataFrame:
    """The best hit of every query row; rows that only have null hits are unmatched."""
    rank = F.when(
        F.col("hit.score").isNotNull(),
        F.struct(
            (-F.col("hit.score")).alias("order"),
            F.col("hit.idx").alias("idx"),
            F.col("hit.card_id").alias("card_id"),
        ),
    )
    return (
        best.groupBy("row")
        .agg(F.min(rank).alias("top"), F.first("who", ignorenulls=True).alias("who"))
        .select(
            "who.*",
            "top.idx",
            "top.card_id",
            (-F.col("top.order")).alias("score"),
            F.col("top").isNotNull().alias("matched"),
        )
    )
