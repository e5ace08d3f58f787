"""Benchmark decontamination: a hash set of benchmark word windows against all windows of the texts.

Only DataFrame functions run on the main path. Windows are looked up by hash and every hit is then
compared word by word, so the result is exact.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckweave.session import cut_lineage

#: Words of a window.
WINDOW = 10
#: Bounds of the benchmark's windows that are broadcast at once: their number and the bytes of their words.
#: More are looked up in several passes over the texts; rows of the result are the same.
BROADCAST_WINDOWS = 500_000
BROADCAST_BYTES = 64 << 20

#: Characters that are no word characters after lower-casing, and before it.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAPS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to the given ones that ``df`` does not have."""
    taken, made = {name.lower() for name in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        made.append(name)
    return made


def words_of(text: Column) -> Column:
    """Lower-cased words (A-Z only); none for null."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.octet_length(whole) == F.char_length(whole)
    lowered = F.when(plain, F.lower(whole)).otherwise(F.translate(whole, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, GAPS), "")


def _window_hash(hashes: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(hashes, at + k) for k in range(size)])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Rows ``key, size, words, items``: the distinct windows of all items and the items of each.

    An item with fewer words than a window, but not none, is one window. Items without an id give
    windows without items.
    """
    words, hashes = F.col("words"), F.col("hashes")
    cut = (
        benchmark.select(F.col(f"`{item_id}`").alias("item"), words_of(F.col(f"`{text}`")).alias("words"))
        .where(F.size(words) > 0)
        .withColumn("size", F.least(F.size(words), F.lit(window)))
        .withColumn("at", F.explode(F.sequence(F.lit(0), F.size(words) - F.col("size"))))
        .select("item", "size", F.slice(words, F.col("at") + 1, F.col("size")).alias("words"))
    )
    return (
        cut.groupBy("size", "words")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .withColumn("hashes", F.transform(words, lambda w: F.xxhash64(w)))
        .withColumn(
            "key",
            reduce(
                lambda rest, k: F.when(F.col("size") == k, _window_hash(hashes, F.lit(0), k)).otherwise(rest),
                range(1, window),
                _window_hash(hashes, F.lit(0), window),
            ),
        )
        .select("key", "size", "words", "items")
    )


def _windowed(rows: DataFrame, row: str | None, lengths: list[int]) -> DataFrame:
    """``id, words``, the row, and ``keys``: the hashes of all windows of a row as one list.

    Lists of hashes are a step of their own: a place is then made from them in the same generated code
    that looks it up, and the words beside it are not copied for each.
    """
    n, hashes = F.size("words"), F.col("hashes")

    def keys(size: int) -> Column:
        at_all = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at_all, lambda at: F.when(at <= n - size, _window_hash(hashes, at, size)))

    # Each row ends with a mark of its own, so that rows without hits are kept through the join.
    mark = F.xxhash64(F.lit("mark"), F.col("id"))
    kept = ["id", "words"] if row is None else ["id", "words", row]
    made = rows.withColumn("words", words_of(F.col("text"))).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    return made.select(*kept, F.concat(*[keys(size) for size in lengths], F.array(mark)).alias("keys"))


def _found(windowed: DataFrame, windows: DataFrame, lengths: list[int], row: str | None = "row") -> DataFrame:
    """Per ``id`` what the broadcast windows find: ``n_words, spans, items``, and the row."""
    words, n = F.col("words"), F.size("words")
    kept = [c for c in windowed.columns if c != "keys"]
    # The outer form, though no list is empty: for the other one Spark tests that first, below the
    # steps that make the list, with all their expressions written out in one.
    placed = (
        windowed.select(*kept, F.posexplode_outer("keys").alias("place", "key"))
        .where(F.col("key").isNotNull())
        .withColumn("last", F.col("place") == n * len(lengths))
    )
    table = windows.select(
        "key", F.col("size").alias("w_size"), F.col("words").alias("w_words"), F.col("items").alias("w_items")
    )
    at = F.col("place") % F.greatest(n, F.lit(1))
    same = F.slice(words, at + 1, F.col("w_size")) == F.col("w_words")
    whole = [] if row is None else [F.when(F.col("last"), F.col(row)).alias("row")]
    joined = (
        placed.join(F.broadcast(table), "key", "left")
        .where(F.col("last") | F.col("w_size").isNotNull())
        .select(
            "id", *whole,
            F.when(F.col("last"), n).alias("n_words"),
            F.when(~F.col("last") & same, F.struct(at.alias("from"), F.col("w_size").alias("size"))).alias("span"),
            F.when(~F.col("last") & same, F.col("w_items")).alias("items"),
        )
    )
    first = [] if row is None else [F.first("row", ignorenulls=True).alias("row")]
    return joined.groupBy("id").agg(
        *first,
        F.max("n_words").cast("bigint").alias("n_words"),
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def _found_in_parts(rows: DataFrame, windows: DataFrame, lengths: list[int], parts: int) -> DataFrame:
    """The same for windows beyond the bound: one pass over the texts for each part of them.

    Each part is broadcast, so no window of a text is shuffled and no common passage makes a hot key.
    Rows are written with their ids first, and only what is found is put together by id.
    """
    stored, table = cut_lineage(rows, "texts"), cut_lineage(windows, "windows")
    one_part = lambda k: table.where(F.pmod("key", F.lit(parts)) == k)
    passes = [_found(_windowed(stored, None, lengths), one_part(k), lengths, None) for k in range(parts)]
    found = reduce(DataFrame.unionByName, passes).groupBy("id").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return stored.select("id", "row").join(found, "id")


def find_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
    benchmark_text: str = "text", item_id: str = "item_id", keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) in one struct ``row``, with what was found.

    Further columns: ``n_words``, ``spans`` (array of word positions ``from, size`` of occurring
    windows, in order), ``n_hit`` (words inside any of them), ``items`` (sorted ids). One row for
    each row of ``docs``, also where ids repeat or are null; a null or empty text has no words and
    no hits. An empty benchmark finds nothing, an empty table gives an empty table.
    """
    windows = benchmark_windows(benchmark, window, benchmark_text, item_id)
    known = windows.groupBy("size").agg(
        F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("words", " "))).alias("bytes")
    )
    sizes = known.orderBy("size").collect()  # at most one row for each size of a window
    parts = max(1, math.ceil(sum(r.n for r in sizes) / BROADCAST_WINDOWS), math.ceil(sum(r.bytes for r in sizes) / BROADCAST_BYTES))
    fits, lengths = parts == 1, [row["size"] for row in sizes]
    whole = F.struct(*[F.col(f"`{name}`") for name in (docs.columns if keep is None else keep)])
    rows = docs.select(whole.alias("row"), F.col(f"`{text}`").alias("text")).withColumn("id", F.monotonically_increasing_id())
    if fits:
        grouped = _found(_windowed(rows, "row", lengths), windows, lengths)
    else:
        grouped = _found_in_parts(rows, windows, lengths, parts)
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def covered(done: Column, span: Column) -> Column:
        end = F.greatest(done["end"], span["from"] + span["size"])
        return F.struct(end.alias("end"), (done["n"] + end - F.greatest(done["end"], F.least(span["from"], end))).alias("n"))

    return grouped.select(
        "row", "n_words", "spans", F.aggregate("spans", start, covered, lambda done: done["n"]).alias("n_hit"), "items"
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW,
    text: str = "text", benchmark_text: str = "text", item_id: str = "item_id",
) -> DataFrame:
    """``docs`` without contamination, all columns as they were.

    ``remove="documents"`` drops every row with a hit; ``remove="spans"`` keeps the rows and takes
    the words of all hits out of their texts, each with the gap before it. Rows without a hit, null
    and empty texts stay as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove}")
    found = find_hits(docs, benchmark, window, text, benchmark_text, item_id)
    if remove == "documents":
        return found.where(F.col("n_hit") == 0).select("row.*")
    value, spans = F.col(f"row.`{text}`"), F.col("spans")
    pieces = (
        found.withColumn("parts", F.array_remove(F.split(value, GAPS_ANY_CASE), ""))
        .withColumn("gaps", F.split(value, WORD_ANY_CASE))
        .withColumn(
            "left",
            F.transform(
                F.col("parts"),
                lambda part, i: F.when(
                    F.exists(spans, lambda s: (i >= s["from"]) & (i < s["from"] + s["size"])), F.lit("")
                ).otherwise(F.concat(F.get("gaps", i), part)),
            ),
        )
    )
    rest = F.concat(F.array_join("left", ""), F.element_at("gaps", -1))
    return pieces.withColumn("clean", F.when(F.col("n_hit") > 0, rest).otherwise(value)).select(
        *[(F.col("clean") if name == text else F.col(f"row.`{name}`")).alias(name) for name in docs.columns]
    )


def hit_digests(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of all documents."""
    found = find_hits(docs.select(doc_id, "text"), benchmark, keep=[doc_id])
    names = F.sort_array(F.transform("items", lambda item: item.cast("string")))
    return found.select(
        F.col(f"row.{doc_id}").alias(doc_id), "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
