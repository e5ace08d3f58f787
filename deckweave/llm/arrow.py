"""Arrow passes over texts whose Python memory is bounded by a few rows and not by the batch."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = 128


def typed(df: DataFrame, column: str, kind: str) -> Column:
    """A column in the one type that a pass expects, so that void and narrower columns also do."""
    return F.col(f"`{column}`").cast(kind).alias(column)


def map_rows(
    df: DataFrame, rows: Callable[[list[tuple]], list[tuple]], fields: list[pa.Field], schema: str, step: int = ROWS
) -> DataFrame:
    """``rows`` gets the next few input rows, up to ``step``, as tuples and returns any number of tuples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.schema(fields)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                made = rows(list(zip(*(part.column(i).to_pylist() for i in range(part.num_columns)))))
                if made:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(values, field.type) for values, field in zip(zip(*made), wanted)],
                        schema=wanted,
                    )

    return df.mapInArrow(run, schema)
