"""Session settings and the shared folder for tables that cut a plan's lineage."""

import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("deckweave")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application.

    Not needed where the package is installed on the cluster or passed with ``--py-files``.
    """
    context = spark.sparkContext
    if getattr(context, "_deckweave_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="deckweave-")) / "deckweave.zip"
    with zipfile.ZipFile(archive, "w") as files:
        for source in sorted(root.rglob("*.py")):
            files.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._deckweave_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    Only where a session on one machine names none (tests) is a temporary folder made; executors
    elsewhere would write to disks of their own.
    """
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="deckweave-")
    return _own_folder


def _scratch_folder(spark: SparkSession) -> str:
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/deckweave/{application}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below a folder of this application."""
    return f"{_scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder.

    To be called when the results that were read from there are written elsewhere.
    """
    delete_folder(spark, _scratch_folder(spark))


def _path(spark: SparkSession, folder: str):
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(context._jsc.hadoopConfiguration())


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder with all in it, if it is there, in any store that Spark reaches."""
    path, store = _path(spark, folder)
    store.delete(path, True)


def folder_exists(spark: SparkSession, folder: str) -> bool:
    path, store = _path(spark, folder)
    return store.exists(path)


def folder_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of all files below a folder."""
    path, store = _path(spark, folder)
    return store.getContentSummary(path).getLength()


# Tables written inside the innermost ``passing_tables``, by thread of the driver.
_passing = threading.local()


@contextmanager
def passing_tables() -> Iterator[None]:
    """Delete what ``cut_lineage`` writes inside, at the end: for work whose result is stored by then."""
    outer, _passing.written = getattr(_passing, "written", None), []
    try:
        yield
    finally:
        for spark, path in _passing.written:
            delete_folder(spark, path)
        _passing.written = outer


@contextmanager
def lasting_tables() -> Iterator[None]:
    """Keep what ``cut_lineage`` writes inside, within ``passing_tables``: for what later work reuses."""
    outer, _passing.written = getattr(_passing, "written", None), None
    try:
        yield
    finally:
        _passing.written = outer


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and go on from the written copy.

    A lost executor then costs a re-read of its files and not a re-run of the stages before,
    and later readers prune columns of the Parquet files.
    """
    path = scratch_path(df.sparkSession, name)
    if getattr(_passing, "written", None) is not None:
        _passing.written.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
