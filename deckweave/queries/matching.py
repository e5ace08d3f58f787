"""Vector queries: embeddings and texts as card images."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from deckweave.functions import text, vectors
from deckweave.operators import match as matching
from deckweave.operators.mapping import embed, embed_rows
from deckweave.plans import scan
from deckweave.queries import query, table
from deckweave.session import scratch_path
from deckweave.sources import image_files as files
from deckweave.streaming.scan import start_scan
from deckweave.streaming.sink import read_batches

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _index(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("idx"), F.col("vec_id").alias("card_id"), "embedding"
    )


def _photos(spark, folder, share: float):
    """Every index vector disturbed by its own reversal, as query vectors."""
    disturbed = F.zip_with(
        "embedding", F.reverse("embedding"), lambda x, y: x.cast("double") + y.cast("double") * share
    )
    rows = table(spark, folder, "embeddings")
    return rows.select(F.col("vec_id").alias("query_id"), disturbed.alias("embedding"))


def _match_sql(vector: str, threshold: float) -> str:
    return f"""
    WITH queries AS (SELECT vec_id AS query_id, {vector} AS v FROM embeddings),
    cards AS (SELECT vec_id AS idx, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
              WHERE list_max(list_transform(embedding, lambda x: abs(x))) > 0),
    scored AS (SELECT query_id, idx, list_cosine_similarity(queries.v, cards.v) AS score
               FROM queries CROSS JOIN cards),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) AS place
               FROM scored),
    best AS (SELECT query_id, idx, score FROM ranked WHERE place = 1 AND score > {threshold})
    SELECT q.query_id, b.idx AS card_id, round(b.score, 6) AS score, b.idx IS NOT NULL AS matched
    FROM queries q LEFT JOIN best b ON q.query_id = b.query_id"""


_REVERSED = "CAST(list_reverse(embedding) AS DOUBLE[])"
_DISTURBED = (
    "list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), "
    "lambda p: p[1] + 0.5 * p[2])"
)


def _result(matches):
    return matches.select("query_id", "card_id", F.round("score", 6).alias("score"), "matched")


@query("C4 H3 D3 B13 C6", _match_sql(_DISTURBED, 0.15))
def best_match(spark, folder):
    return _result(matching.match(_photos(spark, folder, 0.5), _index(spark, folder)))


@query("C4 D3 B13 C6", _match_sql(_REVERSED, 0.4))
def best_match_threshold(spark, folder):
    queries = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.reverse("embedding").alias("embedding")
    )
    return _result(matching.match(queries, _index(spark, folder), threshold=0.4))


@query("C4 H3 D3 B13 C6", _match_sql(_DISTURBED, 0.15))
def best_match_large_index(spark, folder):
    # Small blocks, so that tables of this size already have many.
    queries, index = _photos(spark, folder, 0.5), _index(spark, folder)
    return _result(matching.match_large_index(queries, index, pivots=16, block_bytes=1 << 17))


# Every query id stands on many rows, and every seventh vector of the index is a placeholder.
_REPEATED = (
    _match_sql(_DISTURBED, 0.15)
    .replace("SELECT vec_id AS query_id,", "SELECT vec_id, vec_id % 10 AS query_id,")
    .replace("> 0),", "> 0 AND vec_id % 7 <> 0),")
    .replace("SELECT query_id, idx, list_cosine", "SELECT vec_id, query_id, idx, list_cosine")
    .replace("PARTITION BY query_id", "PARTITION BY vec_id")
    .replace("SELECT query_id, idx, score FROM ranked", "SELECT vec_id, idx, score FROM ranked")
    .replace("ON q.query_id = b.query_id", "ON q.vec_id = b.vec_id")
)


def _repeated(spark, folder):
    zeros = F.transform("embedding", lambda x: F.lit(0).cast("float"))
    index = _index(spark, folder).withColumn("embedding", F.when(F.col("idx") % 7 == 0, zeros).otherwise(F.col("embedding")))
    return _photos(spark, folder, 0.5).withColumn("query_id", F.col("query_id") % 10), index


@query("C4 C6 D3 B12", _REPEATED)
def match_repeated_ids(spark, folder):
    return _result(matching.match(*_repeated(spark, folder)))


@query("C4 C6 D3 B12", _REPEATED)
def match_repeated_ids_large(spark, folder):
    return _result(matching.match_large_index(*_repeated(spark, folder), pivots=16, block_bytes=1 << 17))


def _mixed_sql() -> str:
    """Queries of 64 and 32 elements over vectors of 64 and 128, with placeholders of 768 zeros between."""
    return f"""
    WITH queries AS (SELECT vec_id AS query_id, CASE WHEN vec_id % 3 = 0 THEN ({_DISTURBED})[1:32] ELSE {_DISTURBED} END AS v FROM embeddings),
    cards AS (SELECT vec_id AS idx, CASE WHEN vec_id % 5 = 0 THEN list_concat(CAST(embedding AS DOUBLE[]), {_REVERSED})
                                         ELSE CAST(embedding AS DOUBLE[]) END AS v
              FROM embeddings WHERE vec_id % 7 <> 0),
    scored AS (SELECT query_id, idx, list_cosine_similarity(q.v, c.v[1:len(q.v)]) AS score FROM queries q CROSS JOIN cards c),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) AS place FROM scored),
    best AS (SELECT query_id, idx, score FROM ranked WHERE place = 1 AND score > 0.15)
    SELECT q.query_id, b.idx AS card_id, round(b.score, 6) AS score, b.idx IS NOT NULL AS matched
    FROM queries q LEFT JOIN best b ON q.query_id = b.query_id"""


def _mixed(spark, folder):
    made = F.when(F.col("idx") % 5 == 0, F.concat("embedding", F.reverse("embedding"))).otherwise(F.col("embedding"))
    index = _index(spark, folder).withColumn("embedding", vectors.or_placeholder(F.when(F.col("idx") % 7 != 0, made)))
    short = F.when(F.col("query_id") % 3 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    return _photos(spark, folder, 0.5).withColumn("embedding", short), index


@query("C4 H3 D3 B12 H17 C6", _mixed_sql())
def match_mixed_lengths(spark, folder):
    return _result(matching.match(*_mixed(spark, folder)))


@query("C4 H3 D3 B12 H17 C6", _mixed_sql())
def match_mixed_lengths_large(spark, folder):
    return _result(matching.match_large_index(*_mixed(spark, folder), pivots=16, block_bytes=1 << 17))


@query(
    "C5 C6",
    _match_sql(_REVERSED, 0.4).replace("SELECT q.query_id,", "SELECT q.query_id, e.label,")
    + " LEFT JOIN embeddings e ON e.vec_id = b.idx",
)
def matched_cards(spark, folder):
    queries = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.reverse("embedding").alias("embedding")
    )
    matches = _result(matching.match(queries, _index(spark, folder), threshold=0.4))
    cards = table(spark, folder, "embeddings").select(F.col("vec_id").alias("card_id"), "label")
    return matching.with_card(matches, cards)


@query(
    "H3 D4",
    f"""
    SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_REVERSED}), 6) AS score,
           round(list_dot_product(CAST(embedding AS DOUBLE[]), {_REVERSED}), 6) AS dot,
           round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS norm
    FROM embeddings""",
)
def cosine_rows(spark, folder):
    one, two = F.col("embedding"), F.reverse("embedding")
    sums = vectors.reductions(one, two)
    return table(spark, folder, "embeddings").select(
        "vec_id",
        F.round(vectors.cosine(one, two), 6).alias("score"),
        F.round(sums["dot"], 6).alias("dot"),
        F.round(sums["xx"], 6).alias("norm"),
    )


@query(
    "H17 B12",
    """
    SELECT vec_id, CASE WHEN label = 0 THEN 768 ELSE len(embedding) END AS length,
           label = 0 AS placeholder
    FROM embeddings""",
)
def placeholders(spark, folder):
    made = vectors.or_placeholder(F.when(F.col("label") != 0, F.col("embedding")))
    return table(spark, folder, "embeddings").select(
        "vec_id",
        F.size(made).alias("length"),
        vectors.is_placeholder(made).alias("placeholder"),
    )


@query(
    "D3 B13",
    """
    WITH ranked AS (
        SELECT l_orderkey AS query_id, l_partkey AS idx, l_suppkey AS card_id, l_discount AS score,
               row_number() OVER (PARTITION BY l_orderkey
                                  ORDER BY l_discount DESC, l_partkey, l_suppkey) AS place
        FROM lineitem)
    SELECT query_id, idx, card_id, score FROM ranked WHERE place = 1 AND score > 0.05""",
)
def best_per_query(spark, folder):
    scored = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("query_id"),
        F.col("l_partkey").alias("idx"),
        F.col("l_suppkey").alias("card_id"),
        F.col("l_discount").alias("score"),
    )
    return matching.above(matching.best_per_query(scored), 0.05)


class LetterCounts:
    """Embedder for checks: how often each letter occurs in a text's bytes."""

    def __init__(self):
        self.codes = [ord(letter) for letter in LETTERS]

    def __call__(self, content: bytes) -> list[float]:
        return [float(content.count(code)) for code in self.codes]


def _count_sql(column: str, letter: str) -> str:
    return f"(length({column}) - length(replace({column}, '{letter}', '')))"


_COUNTS = ", ".join(f"{_count_sql('text', letter)} AS {letter}" for letter in LETTERS)
_VECTOR = "[" + ", ".join(f"CAST({_count_sql('text', c)} AS DOUBLE)" for c in LETTERS) + "]"


@query("J1", f"SELECT doc_id, {_COUNTS}, md5(text) AS digest FROM documents")
def embedding_stage(spark, folder):
    """The embedding as a stage of its own, which a resource profile can be given to."""
    rows = table(spark, folder, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"), F.md5("text").alias("digest"))
    made = embed_rows(rows, "content", LetterCounts)
    return made.select("doc_id", *[F.col("embedding")[i].cast("bigint").alias(c) for i, c in enumerate(LETTERS)], "digest")


@query("J1", f"SELECT doc_id, {_COUNTS} FROM documents")
def embed_texts(spark, folder):
    made = embed(F.encode("text", "UTF-8"), LetterCounts)["embedding"]
    rows = table(spark, folder, "documents").select("doc_id", made.alias("v"))
    return rows.select("doc_id", *[F.col("v")[i].cast("bigint").alias(c) for i, c in enumerate(LETTERS)])


@query(
    "J1 H17 B12 C4 H3 D3 B13 C6",
    f"""
    WITH queries AS (SELECT item_id AS query_id, {_VECTOR} AS v FROM benchmark),
    cards AS (SELECT doc_id AS idx, {_VECTOR} AS v FROM documents),
    lengths AS (SELECT idx, v, sqrt(list_dot_product(v, v)) AS length FROM cards),
    scored AS (SELECT query_id, idx,
                      list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * c.length) AS score
               FROM queries q CROSS JOIN lengths c WHERE c.length > 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) AS place
               FROM scored),
    best AS (SELECT query_id, idx, score FROM ranked WHERE place = 1 AND score > 0.15)
    SELECT q.query_id, b.idx AS card_id, round(b.score, 6) AS score, b.idx IS NOT NULL AS matched
    FROM queries q LEFT JOIN best b ON q.query_id = b.query_id""",
)
def embed_and_match(spark, folder):
    cards = table(spark, folder, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    index = scan.build_index(cards, LetterCounts, "content", "doc_id", "doc_id", len(LETTERS))
    images = table(spark, folder, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("content"))
    return _result(scan.match_images(images, index, LetterCounts, "content", "item_id"))


@query(
    "J1 A11",
    """
    SELECT doc_id, strlen(text) AS bytes, md5(text) AS digest FROM documents""",
)
def data_urls(spark, folder):
    url = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("text", "UTF-8")))
    rows = table(spark, folder, "documents").select("doc_id", text.data_url_bytes(url).alias("content"))
    return rows.select("doc_id", F.length("content").alias("bytes"), F.md5("content").alias("digest"))


_IMAGE_PATH = "'images/2024-01-01_' || (page_id % 7) || '_' || page_id || '_low.png'"


@query("A11", f"SELECT {_IMAGE_PATH} AS path, strlen(html) AS length, md5(html) AS digest FROM pages")
def images_as_files(spark, folder):
    """Pages as image files, one each, and read back."""
    path = text.image_path(F.lit("2024-01-01"), (F.col("page_id") % 7).cast("string"), F.col("page_id").cast("string"))
    images = table(spark, folder, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    target = scratch_path(spark, "image-files")
    files.write_image_files(images, target, path)
    back = files.read_image_files(spark, target, "*.png")
    return back.select("path", "length", F.md5("content").alias("digest"))


@query("I1", _match_sql(_REVERSED, 0.4).replace("b.idx IS NOT NULL AS matched", """b.idx IS NOT NULL AS matched,
           CASE WHEN b.idx IS NULL THEN 'No matching card found.' END AS message"""))
def stream_match(spark, folder):
    schema = table(spark, folder, "embeddings").schema
    # One file or a folder of files; the brackets make it a pattern, as a stream reads no single file.
    path = f"{folder.rstrip('/')}/embeddings.parque[t]"
    arriving = spark.readStream.schema(schema).parquet(path)
    queries = arriving.select(
        F.col("vec_id").alias("query_id"),
        F.reverse("embedding").alias("embedding"),
        F.lit(None).cast(T.StringType()).alias("error"),
    )
    sink = scratch_path(spark, "scans")
    started = start_scan(
        queries, _index(spark, folder), sink, scratch_path(spark, "scan-log"), threshold=0.4
    )
    started.awaitTermination()
    results = read_batches(spark, sink)
    return results.select(
        "query_id", "card_id", F.round("score", 6).alias("score"), "matched", "message"
    )
