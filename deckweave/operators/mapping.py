"""Functions of the caller over rows: batch embedding and an error-tolerant map.

Both send one column to Python in Arrow batches; the other columns of the row stay in the JVM.
"""

from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# The model of this Python worker: the last one used, by its factory's serialised form.
_loaded: dict[str, Callable] = {}
# Images of one call of a model that takes many.
MODEL_BATCH = 64
NO_OUTPUT = "the model gave no vector"


_MADE = [T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())]


def _model(key: str, factory: Callable[[], Callable]) -> Callable:
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = factory()
    return _loaded[key]


def _vector_of(output: Any) -> np.ndarray | None:
    """The flat vector of a model's output: its ``data``, or the output itself if it is an array."""
    data = getattr(output, "data", None)
    if data is None or isinstance(data, memoryview):
        data = output if isinstance(output, (list, tuple, np.ndarray)) else None
    return None if data is None else np.asarray(data, dtype=np.float32).ravel()


def _outcome(model: Callable, image: Any) -> tuple[np.ndarray | None, str | None]:
    try:
        vector = _vector_of(model(image))
    except Exception as failure:
        return None, f"{type(failure).__name__}: {failure}"
    return vector, None if vector is not None else NO_OUTPUT


def _outcomes(model: Callable, images: list) -> list[tuple[np.ndarray | None, str | None]]:
    """Vector and error of each image, in one call where the model takes many."""
    many = getattr(model, "many", None)
    if many is not None:
        try:
            vectors = [_vector_of(output) for output in many(images)]
            if len(vectors) == len(images):
                return [(vector, None if vector is not None else NO_OUTPUT) for vector in vectors]
        except Exception:
            pass  # one image may have spoilt the call: they are tried one by one
    return [_outcome(model, image) for image in images]


def embed(content: Column | str, factory: Callable[[], Callable]) -> Column:
    """``struct<embedding: array<float>, error: string>`` of every image.

    ``factory`` gives a function from image to output. A Python worker calls it once and keeps its
    model until another factory is used. A model with a method ``many`` gets the images of a batch
    as lists of up to ``MODEL_BATCH`` and returns as many outputs; where that raises, its images
    are tried one by one.
    Where the function raises, or gives neither ``.data`` nor an array, there is no vector and
    the error says why; other rows are unaffected.
    """
    key = sha256(cloudpickle.dumps(factory)).hexdigest()

    @F.arrow_udf(T.StructType(_MADE))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(key, factory)
        for batch in batches:
            yield pa.StructArray.from_arrays(_embedded(model, batch), names=["embedding", "error"])

    return run(content)


def embed_rows(
    images: DataFrame, content: str, factory: Callable[[], Callable], profile: ResourceProfile | None = None
) -> DataFrame:
    """``images`` without ``content``, with ``embedding`` and ``error`` of it, as a stage that may have
    resources of its own.

    The same as ``embed`` but for the plan: a pass over all rows, whose tasks get the cores, graphics
    processors and memory of ``profile`` (``pyspark.resource.ResourceProfileBuilder``). Spark gives
    profiles on clusters only and refuses them on a local master. Columns that the rest of a job does
    not need are to be left out before, as all of them pass through Python here.
    """
    taken = {"embedding", "error"} & {c for c in images.columns if c != content}
    if taken:
        raise ValueError(f"the images have columns {sorted(taken)} already")
    key = sha256(cloudpickle.dumps(factory)).hexdigest()
    others = [c for c in images.columns if c != content]
    kind = T.StructType([*[images.schema[c] for c in others], *_MADE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(key, factory)
        for batch in batches:
            made = _embedded(model, batch.column(len(others)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*others, "embedding", "error"])

    # Plain names on the way, as a pass over rows finds its columns by name and dots mean fields there.
    order = [*others, content]
    quoted = [F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(order)]
    return images.select(*quoted).mapInArrow(run, kind, profile=profile)


def _embedded(model: Callable, images: pa.Array) -> list[pa.Array]:
    """Vectors and errors of some images, a few at a time."""
    vectors, errors = [], []
    for low in range(0, len(images), MODEL_BATCH):
        for vector, error in _outcomes(model, images.slice(low, MODEL_BATCH).to_pylist()):
            vectors.append(vector)
            errors.append(error)
    return [pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())]


def try_map(value: Column | str, function: Callable[[Any], Any], kind: str | T.DataType) -> Column:
    """``struct<result, error: string>`` of a function over one value per row.

    A row on which the function raises has a null result and its error; every input row gives
    one row. The function gets the value as it is, whatever stands in other rows: whole numbers
    of any size, ``None`` for null, dates as dates. Workers, time limits and retries of lost tasks
    are settings of Spark.
    """
    result = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
    both = T.StructType([T.StructField("result", result), T.StructField("error", T.StringType())])
    wanted = to_arrow_type(result)

    @F.arrow_udf(both)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            results, errors = [], []
            for item in batch.to_pylist():
                try:
                    results.append(function(item))
                    errors.append(None)
                except Exception as failure:
                    results.append(None)
                    errors.append(f"{type(failure).__name__}: {failure}")
            yield pa.StructArray.from_arrays(
                [pa.array(results, wanted), pa.array(errors, pa.string())], names=["result", "error"]
            )

    return run(value)
