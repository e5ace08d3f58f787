"""Match on arrival: every image of a stream once, against a fixed index.

Stateless: no watermark, no aggregation over the stream.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from deckweave.operators import match as matching
from deckweave.operators.cells import CellIndex
from deckweave.plans.scan import embed_queries, with_message
from deckweave.session import cut_lineage, passing_tables
from deckweave.streaming import sink as batches


def start_scan(
    images: DataFrame,
    index: DataFrame,
    sink: str,
    checkpoint: str,
    factory: Callable[[], Callable] | None = None,
    image: Column | str = "content",
    query_id: str = "path",
    threshold: float = matching.THRESHOLD,
    small_bytes: int = matching.SMALL_INDEX_BYTES,
    once: bool = True,
    compact_every: int | None = None,
) -> StreamingQuery:
    """Start the stream of images into a Parquet sink.

    With a factory the images are embedded first; without one the stream already holds
    ``(query_id, embedding, error)``. Each batch has its own folder of the sink and is listed there
    when it is finished (``sink``): a lost batch is written again, a repeated one left out.
    ``sink.read_batches`` reads the listed ones, with ``batch`` as a column. With ``compact_every``,
    each so many batches become few files; then only ``read_batches`` reads all rows. The index is
    written once and measured: a small one goes to every worker, a large one is cut into cells
    once. Rows and layout are the same for both. Tables written on the way are deleted with their
    batch. Every result row carries its query id. ``once`` stops when the files that are there are
    done.
    """
    queries = images if factory is None else embed_queries(images, factory, image, query_id)
    stored = cut_lineage(index.select("idx", "card_id", "embedding"), "index")
    size = matching.index_bytes(stored)
    if size <= min(small_bytes, matching.SMALL_INDEX_BYTES):
        hit = matching.hit_column(stored, threshold, size=size)

        def matched(batch: DataFrame) -> DataFrame:
            found = batch.select("query_id", "error", hit.alias("hit"))
            return found.select(
                "query_id", "hit.idx", "hit.card_id", "hit.score",
                F.col("hit.score").isNotNull().alias("matched"), "error",
            )

    else:
        cells = CellIndex(stored)

        def matched(batch: DataFrame) -> DataFrame:
            return cells.match(batch, threshold, ("error",))

    def write_batch(batch: DataFrame, number: int) -> None:
        with passing_tables():
            result = with_message(matched(batch.select("query_id", "embedding", "error")))
            batches.write_batch(result, sink, number)
            if compact_every and (number + 1) % compact_every == 0:
                batches.compact(batch.sparkSession, sink)

    writer = queries.writeStream.foreachBatch(write_batch)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
