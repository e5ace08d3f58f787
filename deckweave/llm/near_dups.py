"""Near duplicates by ProbMinHash sketches of word shingles, bands, exact verification and classes.

The similarity is the probability Jaccard of the texts' shingles weighted by how often they occur;
where no shingle repeats it is the Jaccard similarity of the two sets.

Texts with the same words are one text from the start. Texts that share a bucket of equal bands are
candidates; chains of such texts are clusters, each of which is compared once, whatever number of
buckets its texts share. A cluster is dealt out in blocks of bounded number and bytes, and each pair
of blocks is a group of its own: a matrix product of the group's shingles bounds all similarities,
those that may reach the threshold are computed exactly, and the group answers with links that
connect its similar texts, never with its pairs.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckweave.llm import arrow
from deckweave.llm.components import connected_components
from deckweave.llm.decontaminate import words_of
from deckweave.llm.pieces import Store
from deckweave.session import cut_lineage

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: A pair at the threshold is missed by all bands with a probability of (1 - 0.8**6)**32, 6 in 100,000.
BANDS = 32
BAND_ROWS = 6
#: Rows and characters of a sketching step, so that a worker's memory does not grow with the texts' lengths;
#: a longer text is a step of its own.
SKETCH_ROWS = 1024
SKETCH_CHARS = 1 << 20
#: Words of each of the two generations of a worker's store; results do not depend on it.
STORE_WORDS = 100_000
#: Texts and characters of a block of a cluster; a group is two blocks at most.
BLOCK_TEXTS = 1024
BLOCK_CHARS = 8 << 20
#: Candidates up to which their two numbers each are broadcast to the texts; beyond, texts are shuffled.
BROADCAST_NODES = 2_000_000
#: Shingles of a step of the matrix product.
STEP_SHINGLES = 4096

_G = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of the public SplitMix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _words() -> Store:
    return Store(lambda word: xxhash.xxh64_intdigest(word.encode()), STORE_WORDS)


def shingles(words: str, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of a text of words parted by blanks, ascending, and their numbers.

    A text of fewer words, but not none, is one shingle.
    """
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    parts = words.split(" ")
    codes = np.fromiter(map(_words().__getitem__, parts), np.uint64, len(parts))
    size = min(size, len(codes))
    made = np.full(len(codes) - size + 1, np.uint64(size))
    for k in range(size):
        made = _mix(made * _G + codes[k : len(codes) - size + 1 + k])
    return np.unique(made, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets; 0 where one is empty.

    The sum over common elements of 1 / sum_j max(a_j / a_i, b_j / b_i). With r_j = a_j / b_j the
    inner sum splits at r_j = r_i, so both parts come from running sums in the order of r.
    """
    (x, n), (y, m) = a, b
    if not len(x) or not len(y):
        return 0.0
    common, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    p, q = n[i].astype(float), m[j].astype(float)
    if p.max() == 1 and q.max() == 1 and n.max() == 1 and m.max() == 1:
        return len(common) / (len(x) + len(y) - len(common))
    order = np.argsort(p / q, kind="stable")
    p, q = p[order], q[order]
    only_x, only_y = n.sum() - p.sum(), m.sum() - q.sum()
    # Elements with a larger ratio count by a, the others by b.
    upper = p[::-1].cumsum()[::-1] - p
    lower = q.cumsum()
    return float(np.sum(1.0 / ((only_x + upper) / p + (only_y + lower) / q)))


def sketches(texts: list[tuple[np.ndarray, np.ndarray]], size: int = BANDS * BAND_ROWS) -> np.ndarray:
    """ProbMinHash sketches of weighted sets, a row of element hashes each.

    Each element has a Poisson process of its weight's rate, whose arrivals fall on components at
    random; a component keeps the element that came first. Two sketches agree in a component with
    the probability Jaccard of their sets. An element stops when its next arrival is later than the
    last first arrival of all components. All texts go step by step together.
    """
    docs = np.repeat(np.arange(len(texts)), [len(x) for x, _ in texts])
    first = np.full((len(texts), size), np.inf)
    kept = np.zeros((len(texts), size), np.uint64)
    if not len(docs):
        return kept
    element = np.concatenate([x for x, _ in texts])
    weight = np.concatenate([n for _, n in texts]).astype(float)
    time, state = np.zeros(len(docs)), element.copy()
    flat_first, flat_kept = first.reshape(-1), kept.reshape(-1)
    while len(docs):
        state += _G
        code = _mix(state)
        time += -np.log1p(-(code >> np.uint64(11)).astype(float) / (1 << 53)) / weight
        place = docs * size + (_mix(code ^ _G) % np.uint64(size)).astype(np.int64)
        better = np.flatnonzero(time < flat_first[place])
        better = better[np.argsort(-time[better], kind="stable")]  # the earliest is written last
        flat_first[place[better]] = time[better]
        flat_kept[place[better]] = element[better]
        live = np.flatnonzero(time < first.max(axis=1)[docs])
        docs, element, weight, time, state = docs[live], element[live], weight[live], time[live], state[live]
    return kept


def bands(sketch: np.ndarray, count: int = BANDS) -> np.ndarray:
    """A hash for each band of each sketch, different between places of bands."""
    rows = sketch.reshape(len(sketch), count, -1)
    made = np.broadcast_to(np.arange(count, dtype=np.uint64) * _G, rows.shape[:2]).copy()
    for k in range(rows.shape[2]):
        made = _mix(made + _G * rows[:, :, k])
    return made.view(np.int64)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with two hashes of what makes rows copies, and the words.

    That is the words, or the text itself where it has none; null and empty texts have no hashes.
    """
    value = F.col(f"`{text}`").cast("string")
    words = F.array_join(words_of(value), " ")
    return docs.withColumn("nd_words", words).withColumns({
        f"nd_k{k}": F.when(F.length(value) > 0, F.xxhash64(F.lit(k), F.when(F.length("nd_words") > 0, F.col("nd_words")).otherwise(value)))
        for k in (1, 2)
    })


def steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of texts in its second column, cut where a step has its number of rows or of characters."""
    first, chars = 0, 0
    for at, size in enumerate(pc.utf8_length(batch.column(1)).to_pylist()):
        if at > first and (at - first >= SKETCH_ROWS or chars + size > SKETCH_CHARS):
            yield batch.slice(first, at - first)
            first, chars = at, 0
        chars += size
    if batch.num_rows:
        yield batch.slice(first)


def _sketched(nodes: DataFrame) -> DataFrame:
    """Rows ``bucket, node``, one for each band of each text with words."""

    def run(batches):
        for batch in batches:
            for part in steps(batch):
                made = bands(sketches([shingles(words) for words in part.column(1).to_pylist()]))
                node = np.repeat(np.array(part.column(0).to_pylist(), np.int64), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(made.reshape(-1)), pa.array(node)], names=["bucket", "node"])

    return nodes.where(F.length("words") > 0).select("node", "words").mapInArrow(run, "bucket bigint, node bigint")


def shared_mass(texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each pair of weighted sets, the share of the first one's weight on common elements."""
    count = len(texts)
    total = np.zeros((count, count), np.float32)
    owner = np.repeat(np.arange(count), [len(x) for x, _ in texts])
    if not len(owner):
        return total
    weight = np.concatenate([n / n.sum() for _, n in texts if len(n)]).astype(np.float32)
    names, code, often = np.unique(np.concatenate([x for x, _ in texts]), return_inverse=True, return_counts=True)
    # An element of one set alone is common to none.
    place = np.cumsum(often > 1) - 1
    used = often[code] > 1
    owner, weight, code = owner[used], weight[used], place[code[used]]
    order = np.argsort(code, kind="stable")
    owner, weight, code = owner[order], weight[order], code[order]
    for low in range(0, int((often > 1).sum()), STEP_SHINGLES):
        first, last = np.searchsorted(code, [low, low + STEP_SHINGLES])
        there = np.zeros((count, STEP_SHINGLES), np.float32)
        there[owner[first:last], code[first:last] - low] = weight[first:last]
        total += there @ (there > 0).astype(np.float32).T
    return total


def similar_links(texts: list[tuple[np.ndarray, np.ndarray]], side: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links that connect all texts which chains of similar pairs connect.

    Pairs on one side count only if all texts are on one side. The similarity of two sets is at
    most the weight of either on their common elements, so only pairs that reach the threshold by
    that are computed, and of those none that earlier links connect.
    """
    mass = shared_mass(texts)
    able = np.triu(np.minimum(mass, mass.T) >= threshold - 1e-4, 1)
    if side.min() != side.max():
        able &= side[:, None] != side[None, :]
    first, second = np.nonzero(able)
    order = np.argsort(-mass[first, second], kind="stable")
    root = list(range(len(texts)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i, j in zip(first[order].tolist(), second[order].tolist()):
        a, b = find(i), find(j)
        if a != b and similarity(texts[i], texts[j]) >= threshold:
            root[max(a, b)] = min(a, b)
            links.append((i, j))
    return links


def _links(clusters: DataFrame, threshold: float) -> DataFrame:
    """Links ``a, b`` between similar texts from rows ``cluster, node, words``."""
    sizes = clusters.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum(F.length("words")) / BLOCK_CHARS)).alias("blocks")
    )
    # Only clusters of several blocks are looked up, of which there are few, so that no texts of a large
    # cluster are brought together for their number.
    large = cut_lineage(sizes.where("blocks > 1"), "large")
    known = F.broadcast(large) if large.count() <= BROADCAST_NODES else large
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    dealt = (
        clusters.join(known, "cluster", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint")))
        .select("cluster", "node", "words", own.alias("own"), F.explode(every).alias("other"))
        .select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "words", "own")
    )

    def compare(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_pylist()
        texts = [shingles(words) for words in group.column("words").to_pylist()]
        found = similar_links(texts, np.array(group.column("own").to_pylist()), threshold)
        return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.int64()), "b": pa.array([nodes[j] for _, j in found], pa.int64())})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def _classes(nodes: DataFrame, threshold: float) -> DataFrame:
    """Rows ``node, label`` of all texts that are in a class with another one."""
    buckets = cut_lineage(_sketched(nodes), "bands")
    # A chain through the least text of each bucket holds the bucket's texts together.
    least = buckets.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last")
    chains = buckets.join(least.select("bucket", "a"), "bucket").select("a", F.col("node").alias("b"))
    candidates = cut_lineage(connected_components(chains), "candidates")
    few = candidates.count() <= BROADCAST_NODES
    clusters = cut_lineage(
        nodes.join(F.broadcast(candidates) if few else candidates, "node").select(F.col("label").alias("cluster"), "node", "words"), "clusters"
    )
    return connected_components(_links(clusters, threshold))


def _nodes(keyed: DataFrame, doc_id: str) -> DataFrame:
    """Rows ``node, nd_k1, nd_k2, first_id, words``: the distinct texts."""
    return cut_lineage(
        keyed.where(F.col("nd_k1").isNotNull())
        .groupBy("nd_k1", "nd_k2")
        .agg(F.min(f"`{doc_id}`").alias("first_id"), F.first("nd_words").alias("words"))
        .withColumn("node", F.monotonically_increasing_id()),
        "texts",
    )


def _class_ids(keyed: DataFrame, doc_id: str, threshold: float) -> DataFrame:
    """Rows ``nd_k1, nd_k2, first_id, class_id, stays`` of the distinct texts.

    The class id is the least id in it; one text of the class, with that id, stays.
    """
    nodes = _nodes(keyed, doc_id)
    named = nodes.join(_classes(nodes, threshold), "node", "left").select(
        "nd_k1", "nd_k2", "first_id", "node", F.coalesce("label", "node").alias("label")
    )
    order = F.struct(F.col("first_id").isNull().alias("none"), "first_id", "node")
    least = named.groupBy("label").agg(F.min(order).alias("least"))
    return cut_lineage(
        named.join(least, "label").select(
            "nd_k1", "nd_k2", "first_id", F.col("least.first_id").alias("class_id"),
            (F.col("node") == F.col("least.node")).alias("stays"),
        ),
        "classes",
    )


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Rows ``doc_id, class_id``, one for each row of ``docs`` in any order.

    Rows are in one class if a chain of texts links them, each similar to the next; the class id is
    the least id in it. Texts with the same words are copies. A null or empty text, and one without
    words that has no exact copy, is alone and its own class. Repeated rows stay; where all ids of
    a class are null, so is its id. Other columns are not read.
    """
    keyed = _keyed(docs.select(arrow.typed(docs, doc_id, "bigint"), arrow.typed(docs, text, "string")), text).drop(text)
    classes = _class_ids(keyed, doc_id, threshold).select("nd_k1", "nd_k2", "class_id")
    found = keyed.drop("nd_words").join(classes, ["nd_k1", "nd_k2"], "left")
    alone = F.col("nd_k1").isNull()
    return found.select(doc_id, F.when(alone, F.col(f"`{doc_id}`")).otherwise(F.col("class_id")).alias("class_id"))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class: that with the least id, whole and with its columns as they were.

    Of repeated rows with that id one stays. Null and empty texts all stay.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    plain = docs.select(row, arrow.typed(docs, doc_id, "bigint").alias("id"), arrow.typed(docs, text, "string").alias("text"))
    keyed = _keyed(plain, "text").drop("text")
    classes = _class_ids(keyed.drop("row"), "id", threshold)
    # By hashes and id together, no group of copies is one key.
    kept = classes.where("stays").select("nd_k1", "nd_k2", F.coalesce("first_id", F.lit(-1)).alias("nd_id"))
    rows = keyed.drop("nd_words").withColumn("nd_id", F.coalesce("id", F.lit(-1)))
    chosen = rows.where(F.col("nd_k1").isNotNull()).join(kept, ["nd_k1", "nd_k2", "nd_id"], "left_semi")
    single = chosen.dropDuplicates(["nd_k1", "nd_k2", "nd_id"])
    return single.unionByName(rows.where(F.col("nd_k1").isNull())).select("row.*")
