"""Binary rows as one file each, under their own paths, by a Python data source with task commits."""

import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "deckweave_files"


def _store(folder: str):
    """The store of a folder and its path there, for any address that Arrow knows."""
    from pyarrow.fs import FileSystem

    address = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return FileSystem.from_uri(address.replace("s3a://", "s3://", 1))


@dataclass
class _Written(WriterCommitMessage):
    files: int
    bytes: int


class _Writer(DataSourceArrowWriter):
    """Tasks write into a folder of their attempt and move its files in place when all are written."""

    def __init__(self, folder: str, job: str):
        self._folder, self._job = folder.rstrip("/"), job

    def _attempts(self, base: str) -> str:
        return f"{base}/_attempts-{self._job}"

    def write(self, batches: Iterator) -> WriterCommitMessage:
        store, base = _store(self._folder)
        context = TaskContext.get()
        own = f"{self._attempts(base)}/{context.partitionId()}-{context.taskAttemptId()}"
        names, size = [], 0
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                name, data = path.as_py(), content.as_buffer()
                temporary = f"{own}/{len(names)}"
                if not names:
                    store.create_dir(own, recursive=True)
                with store.open_output_stream(temporary) as out:
                    if data is not None:
                        out.write(data)
                        size += data.size
                names.append(name)
        made = set()
        for number, name in enumerate(names):
            target = f"{base}/{name}"
            parent = posixpath.dirname(target)
            if parent not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            store.move(f"{own}/{number}", target)
        return _Written(len(names), size)

    def commit(self, messages: list) -> None:
        store, base = _store(self._folder)
        self._drop_attempts(store, base)
        store.create_dir(base, recursive=True)
        total = {"files": sum(m.files for m in messages if m), "bytes": sum(m.bytes for m in messages if m)}
        with store.open_output_stream(f"{base}/_SUCCESS") as out:
            out.write(json.dumps(total).encode())

    def abort(self, messages: list) -> None:
        self._drop_attempts(*_store(self._folder))

    def _drop_attempts(self, store, base: str) -> None:
        from pyarrow.fs import FileType

        folder = self._attempts(base)
        if store.get_file_info(folder).type != FileType.NotFound:
            store.delete_dir(folder)


class FileSource(DataSource):
    """Write rows ``(path, content)`` as files below the folder of the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options["job"])


def _checked(files: DataFrame) -> None:
    """Refuse paths that are missing, leave the folder, or stand on several rows."""
    path = F.col("path")
    parts = F.split(path, "/")
    bad = path.isNull() | (path == "") | path.startswith("/") | F.exists(parts, lambda p: p.isin("", ".", ".."))
    wrong = files.where(bad).select(F.coalesce("path", F.lit("null")).alias("path")).first()
    if wrong is not None:
        raise ValueError(f"{wrong.path} is no path below the folder")
    twice = files.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if twice is not None:
        raise ValueError(f"{twice.path} stands on {twice.n} rows")


def write_image_files(images: DataFrame, folder: str, image_path: Column, content: str = "content") -> None:
    """Put the bytes of each row at its path below a folder, one file each; null as an empty file.

    Paths are checked first, in a pass that reads nothing else. A task's files come to their places
    when it has written all of them, so a lost attempt leaves none; ``_SUCCESS`` with the number of
    files and bytes stands when all tasks are done. Files that are there already are replaced. The
    folder is one that every executor reaches, by an address that Arrow knows (``file``, ``hdfs``,
    ``s3``, ``gs``). Millions of small files are slow to list: ``files.write_images`` keeps the bytes as rows.
    """
    import uuid

    spark = images.sparkSession
    files = images.select(image_path.cast("string").alias("path"), F.col(f"`{content}`").cast("binary").alias("content"))
    _checked(files.select("path"))
    spark.dataSource.register(FileSource)
    files.write.format(FORMAT).mode("append").option("path", folder).option("job", uuid.uuid4().hex).save()


def read_image_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files below a folder as ``(path, length, content)``, the path as it was given when writing.

    Folders and files whose names begin with ``_`` or ``.`` are not read.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    base = folder.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    # The scan gives whole addresses; names may hold characters that it escapes.
    full = F.col("path")
    return rows.select(F.substring_index(full, base, -1).alias("path"), "length", "content")
