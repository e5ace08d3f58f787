"""File sinks and sources: CSV, Parquet, images."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BYTE_ORDER_MARK = "\ufeff"


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def write_csv(df: DataFrame, path: str, mark: bool = False, mode: str = "errorifexists") -> None:
    """Write CSV with a header and quotes doubled, null and empty text both as nothing.

    ``mark`` puts a UTF-8 byte order mark before the header of each file, for spreadsheets;
    Spark has no option for it, so it is carried by the first column's name. Booleans are
    written ``True`` and ``False``.
    """
    flags = {f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)}
    names = {c: (BYTE_ORDER_MARK if mark and i == 0 else "") + c for i, c in enumerate(df.columns)}
    columns = [
        (F.initcap(_quoted(c).cast("string")) if c in flags else _quoted(c)).alias(names[c])
        for c in df.columns
    ]
    (
        df.select(*columns)
        .write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False
) -> DataFrame:
    """Read what ``write_csv`` wrote; fields are taken by position.

    Texts with line breaks need ``multi_line``, which reads a file in one task; without it files
    are read in splits.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )


def write_images(images: DataFrame, path: str, image_path: Column, mode: str = "errorifexists") -> None:
    """Keep image bytes as a binary column under their path name, in Parquet.

    One file per image would leave the file system with as many small files as there are cards.
    """
    images.withColumn("image_path", image_path).write.mode(mode).parquet(path)


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Image files as ``(path, modificationTime, length, content)``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def stream_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The same for files as they arrive in a folder."""
    probe = T.StructType(
        [
            T.StructField("path", T.StringType()),
            T.StructField("modificationTime", T.TimestampType()),
            T.StructField("length", T.LongType()),
            T.StructField("content", T.BinaryType()),
        ]
    )
    reader = spark.readStream.format("binaryFile").schema(probe)
    return reader.option("pathGlobFilter", pattern).load(path)
