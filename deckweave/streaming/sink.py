"""The sink of a stream in batches: a list of finished batches, read through it, and compaction.

Below a folder:

``batch=N/``      rows of a batch, as Parquet
``_manifest/``    an entry for each finished batch and each segment: first and last batch, folder, schema
``_segments/``    rows of several finished batches in few files, with their ``batch`` as a column

A batch is finished when its entry stands, which is written after its rows. A batch that is lost before
that is written again in whole, and one that is repeated after it is left out: a repeated batch has the
same input. What no entry names is not read.
"""

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deckweave.session import delete_folder, folder_bytes, folder_exists

#: Bytes of a file that compaction aims at.
FILE_BYTES = 128 << 20

_ENTRY = "first bigint, last bigint, folder string, schema string"


def _listed(spark: SparkSession, sink: str) -> list:
    """All entries; one for each batch since the last compaction and one for each segment."""
    folder = f"{sink.rstrip('/')}/_manifest"
    if not folder_exists(spark, folder):
        return []
    return spark.read.schema(_ENTRY).option("recursiveFileLookup", True).json(folder).collect()


def _is_segment(entry) -> bool:
    return "/_segments/" in entry.folder


def _split(spark: SparkSession, sink: str) -> tuple[list, list, list]:
    """Entries of segments, of batches that none holds, and of batches that one holds."""
    listed = sorted(_listed(spark, sink), key=lambda entry: entry.first)
    segments = [entry for entry in listed if _is_segment(entry)]
    last = max((entry.last for entry in segments), default=-1)
    # Batches end in order, so that segments hold all up to the last one's end.
    batches = [entry for entry in listed if not _is_segment(entry)]
    return segments, [e for e in batches if e.first > last], [e for e in batches if e.first <= last]


def finished(spark: SparkSession, sink: str) -> list:
    """Entries of what is to be read, in order: segments, and batches that none holds."""
    segments, batches, _ = _split(spark, sink)
    return segments + batches


def _enter(spark: SparkSession, sink: str, name: str, entry: tuple) -> None:
    row = spark.createDataFrame([entry], _ENTRY).coalesce(1)
    row.write.mode("overwrite").json(f"{sink.rstrip('/')}/_manifest/{name}")


def write_batch(result: DataFrame, sink: str, number: int) -> bool:
    """Write a batch and enter it as finished; False for a batch that is finished already."""
    spark = result.sparkSession
    if any(entry.first <= number <= entry.last for entry in finished(spark, sink)):
        return False
    folder = f"{sink.rstrip('/')}/batch={number}"
    result.write.mode("overwrite").parquet(folder)
    _enter(spark, sink, f"b{number:012d}", (number, number, folder, result.schema.json()))
    return True


def read_batches(spark: SparkSession, sink: str) -> DataFrame:
    """Rows of all finished batches with their number as ``batch``, each once."""
    entries = finished(spark, sink)
    if not entries:
        raise ValueError(f"no batch is finished in {sink}")
    schema = T.StructType.fromJson(json.loads(entries[0].schema))
    names = schema.fieldNames()
    with_batch = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    parts = []
    segments = [entry.folder for entry in entries if _is_segment(entry)]
    if segments:
        parts.append(spark.read.schema(with_batch).parquet(*segments))
    batches = [entry.folder for entry in entries if not _is_segment(entry)]
    if batches:
        base = f"{sink.rstrip('/')}/"
        parts.append(spark.read.schema(with_batch).option("basePath", base).parquet(*batches))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.select(*[F.col(f"`{name}`") for name in names], "batch")


def compact(spark: SparkSession, sink: str, file_bytes: int = FILE_BYTES) -> int:
    """Bring the finished batches that no segment holds into one, in files of about ``file_bytes``.

    Each row is rewritten once. Readers that began before go on with the batches' own folders; the
    next compaction deletes those. Gives the number of batches. A compaction that is lost leaves a
    folder that no entry names, and the next one starts again.
    """
    base = sink.rstrip("/")
    _, batches, held = _split(spark, sink)
    for entry in held:
        delete_folder(spark, entry.folder)
        delete_folder(spark, f"{base}/_manifest/b{entry.first:012d}")
    if len(batches) < 2:
        return 0
    first, last = batches[0].first, batches[-1].last
    schema = T.StructType.fromJson(json.loads(batches[0].schema))
    with_batch = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    folders = [entry.folder for entry in batches]
    files = max(1, math.ceil(sum(folder_bytes(spark, folder) for folder in folders) / file_bytes))
    rows = spark.read.schema(with_batch).option("basePath", f"{base}/").parquet(*folders)
    folder = f"{base}/_segments/{first}-{last}-{uuid.uuid4().hex}"
    rows.repartition(files).write.parquet(folder)
    _enter(spark, sink, f"s{first:012d}", (first, last, folder, batches[0].schema))
    return len(batches)
