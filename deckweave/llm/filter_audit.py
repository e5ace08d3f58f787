"""What each filter removes, in every order in which five filters may be applied, by part of a corpus.

Documents are counted once by part and by which filters they fail. The counts of a part are a tensor
of 2 x 2 x 2 x 2 x 2 cells, an axis per filter with "passes" and "fails". Every number asked for is a
contraction of it: along each axis the documents that pass, those that fail, or all of them.
"""

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckweave.llm.arrow import map_rows, typed
from deckweave.session import cut_lineage

FILTERS = "ABCDE"
#: Parts whose tensors are contracted together in a task.
PARTS = 64

_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A (few words), B (few distinct words), C (capitals) and D (symbols).

    Null counts as the empty text, which fails A alone.
    """
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, "[\\x20\\x09-\\x0D]+"), lambda word: word != "")
    sizes = F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("distinct"))
    # One struct, so that the words are made once.
    few = F.transform(F.array(sizes), lambda s: F.array(s["n"] < 200, 100 * s["distinct"] < 50 * s["n"]))[0]
    capitals = F.length(F.regexp_replace(whole, "[^A-Z]+", ""))
    return [few[0], few[1], 100 * capitals > 2 * F.length(whole), whole.rlike("[#$%&*|]")]


def _selectors() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """For each order and step: the order, the step's axis, and what is selected along each axis.

    ``before`` passes the filters of earlier steps and takes all of later ones; the step's own axis
    is left open, as all.
    """
    orders = ["".join(order) for order in permutations(FILTERS)]
    axis = np.array([FILTERS.index(name) for order in orders for name in order])
    before = np.array([
        [_PASS if order.index(name) < step else _ALL for name in FILTERS]
        for order in orders
        for step in range(len(FILTERS))
    ])
    others = np.array([[_ALL if k == own else _PASS for k in range(len(FILTERS))] for own in axis])
    return orders, axis, before, others


def _with_axis(selected: np.ndarray, axis: np.ndarray, what: tuple[int, int]) -> np.ndarray:
    chosen = selected.copy()
    chosen[np.arange(len(axis)), axis] = what
    return chosen


def _contract(tensors: np.ndarray, selected: np.ndarray) -> np.ndarray:
    """Sums of the selected cells: tensors (part, count, 2, 2, 2, 2, 2), selectors (step, axis, 2)."""
    return np.einsum("pmabcde,sa,sb,sc,sd,se->psm", tensors, *selected.transpose(1, 0, 2))


def contractions(tensors: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each part (rows) and each order and step (columns).

    ``tensors`` holds three counts a part: all documents, good ones and toxic ones.
    """
    orders, axis, before, others = _selectors()
    lost = _contract(tensors, _with_axis(before, axis, _FAIL))
    removed = lost[:, :, 0]
    alone = _with_axis(np.ones_like(before), axis, _FAIL)
    shares = np.zeros((len(tensors), len(FILTERS)), np.int64)
    for k in range(len(FILTERS)):
        shares[:, k] = removed[:, axis == k].sum(axis=1)
    return {
        "kept": _contract(tensors, _with_axis(before, axis, _PASS))[:, :, 0],
        "removed": removed,
        "redundant": _contract(tensors, alone)[:, :, 0] - removed,
        "unique_fails": _contract(tensors, _with_axis(others, axis, _FAIL))[:, :, 0],
        "good_lost": lost[:, :, 1],
        "toxic_lost": lost[:, :, 2],
        "shapley": shares[:, axis],
    }


def audit(counts: DataFrame) -> DataFrame:
    """Every order and step of the filters, from rows ``part, code, n, good, toxic``.

    Bit ``k`` of ``code`` is set where filter ``k`` fails; rows of the same part and code are added
    up. A part has 600 rows, ``part, filter_order, step`` and the counts. No row gives no part.
    """
    held = counts.groupBy("part", "code").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("n", "good", "toxic")])
    # At most 32 rows a part.
    cells = held.groupBy("part").agg(F.collect_list(F.struct("code", "n", "good", "toxic")).alias("cells"))

    def rows(part):
        tensors = np.zeros((len(part), 3, 2 ** len(FILTERS)), np.int64)
        for i, (_, found) in enumerate(part):
            for cell in found:
                tensors[i, :, cell["code"]] = cell["n"], cell["good"], cell["toxic"]
        # Bit 0 changes fastest, so the last axis is that of the first filter.
        shaped = tensors.reshape(len(part), 3, *[2] * len(FILTERS)).transpose(0, 1, *range(len(FILTERS) + 1, 1, -1))
        values = contractions(np.ascontiguousarray(shaped))
        orders = _selectors()[0]
        return [
            (name, order, step + 1, *[int(values[c][i, len(FILTERS) * o + step]) for c in _COUNTS])
            for i, (name, _) in enumerate(part)
            for o, order in enumerate(orders)
            for step in range(len(FILTERS))
        ]

    fields = [pa.field("part", pa.string()), pa.field("filter_order", pa.string()), pa.field("step", pa.int32())]
    fields += [pa.field(name, pa.int64()) for name in _COUNTS]
    schema = "part string, filter_order string, step int, " + ", ".join(f"{name} bigint" for name in _COUNTS)
    return map_rows(cells, rows, fields, schema, step=PARTS)


def with_failures(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source"
) -> DataFrame:
    """Rows ``part, code, good, toxic``, one for each row of ``docs``.

    E, a copy of a text with a smaller id anywhere in the table, is decided by the least id of each
    text's SHA-256, so that a text with thousands of copies meets as one row a task. A null text is
    the empty text and a null part the empty string. Rows with a null id are copies of nothing and
    have no copies; rows with the same id don't make each other fail; several labels of one id count
    as one that holds what any of them says. Other columns are not carried.
    """
    named = docs.select(
        typed(docs, doc_id, "bigint").alias("doc_id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    failed = text_failures(F.col("text"))
    code = sum(((F.when(fails, 1 << k).otherwise(0)) for k, fails in enumerate(failed)), F.lit(0))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    seen = cut_lineage(named.select("doc_id", "part", code.alias("code"), digest.alias("digest")), "failures")
    known = seen.where(F.col("doc_id").isNotNull())
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    copy = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    judged = known.join(firsts, ["digest", "doc_id"], "left").join(marks, "doc_id", "left").select(
        "part",
        (F.col("code") + copy).alias("code"),
        F.coalesce("good", F.lit(0)).alias("good"),
        F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )
    # Null keys would all meet in one task of a join.
    others = seen.where(F.col("doc_id").isNull()).select("part", "code", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return judged.unionByName(others)


def audit_documents(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source"
) -> DataFrame:
    """``audit`` of the five filters over ``docs``: 600 rows for each part that has a document.

    Counts add up in each task first, so a part with a third of all rows is 32 rows a task. Very
    long texts are split into words within their row. An empty table gives no row.
    """
    rows = with_failures(docs, labels, text, doc_id, part)
    counts = rows.groupBy("part", "code").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")
    )
    return audit(counts)
