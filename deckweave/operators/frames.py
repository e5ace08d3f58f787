"""Column-set operators driven by the schema, and unions of frames."""

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCALARS = (T.NumericType, T.StringType, T.BooleanType, T.NullType)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def distinct_names(names: Iterable[str]) -> dict[str, str]:
    """Column names that differ by more than case, for names that may not.

    The first of several spellings keeps its name, the next ones end in ``_2``, ``_3`` …, skipping
    what is taken by another name; an empty name is ``_``.
    """
    wanted = list(dict.fromkeys(names))
    fold = lambda name: name.upper().lower()
    firsts: dict[str, str] = {}
    for name in wanted:
        firsts.setdefault(fold(name or "_"), name)
    taken, given = set(firsts), {}
    counts: dict[str, int] = {}
    for name in wanted:
        base, folded = name or "_", fold(name or "_")
        if firsts[folded] == name:
            given[name] = base
            continue
        number = counts.get(folded, 1)
        while True:
            number += 1
            if fold(f"{base}_{number}") not in taken:
                break
        counts[folded] = number
        taken.add(fold(f"{base}_{number}"))
        given[name] = f"{base}_{number}"
    return given


def map_columns(df: DataFrame, record: str, names: Iterable[str], *keep: str) -> DataFrame:
    """Columns of a ``map<string, string>`` column by key, then the columns to ``keep``.

    A key is found by its exact spelling, and columns are named by ``distinct_names``, also apart
    from those to keep. The map becomes a variant whose keys are sorted, and one cast takes all columns
    out of it, so that a row costs its own entries and not entries times columns. Keys are unique.
    """
    named = distinct_names([*keep, *names])
    keys = [name for name in named if name not in keep]
    own = T.StructType([T.StructField(name, T.StringType()) for name in keys])
    final = T.StructType([T.StructField(named[name], T.StringType()) for name in keys])
    if not keys:
        return df.select(*map(_quoted, keep))
    held = "fields"
    while held in keep:
        held += "_"
    taken = F.to_variant_object(_quoted(record)).cast(own).cast(final).alias(held)
    return df.select(taken, *map(_quoted, keep)).select(F.col(f"{held}.*"), *map(_quoted, keep))


def with_source(df: DataFrame, url: Column | str, name: str = "url") -> DataFrame:
    """Keep the source address on every row; a plain string is a literal address."""
    return df.withColumn(name, F.lit(url) if isinstance(url, str) else url)


def rename_present(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename by map. Sources that are absent are ignored.

    Where several present columns get one name they become one column, the first non-null
    value in the order of the map, at the place of the first of them.
    """
    sources: dict[str, list[str]] = {}
    for column in df.columns:
        sources.setdefault(names.get(column, column), []).append(column)
    order = {source: place for place, source in enumerate(names)}
    selected = []
    for target, columns in sources.items():
        ranked = sorted(columns, key=lambda c: order.get(c, len(order)))
        selected.append(F.coalesce(*[_quoted(c) for c in ranked]).alias(target))
    return df.select(*selected)


def keep_columns(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Keep the columns whose name is wanted, in the order of the input."""
    allowed = set(wanted)
    return df.select(*[_quoted(c) for c in df.columns if c in allowed])


def columns_matching(df: DataFrame, pattern: str) -> list[str]:
    """Names of the columns in which the pattern is found."""
    return [c for c in df.columns if re.search(pattern, c)]


def cast_columns(
    df: DataFrame, names: Iterable[str], kind: str = "double", lenient: bool = False
) -> DataFrame:
    """Cast the named columns. Bad text is an error, or null where ``lenient`` is set."""
    return df.withColumns(
        {c: _quoted(c).try_cast(kind) if lenient else _quoted(c).cast(kind) for c in names}
    )


def to_dates(df: DataFrame, names: Iterable[str], pattern: str | None = None) -> DataFrame:
    """Drop the time of day. Texts in another form than ISO need a pattern."""
    return df.withColumns({c: F.to_date(_quoted(c), pattern) for c in names})


def map_text_columns(df: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """Apply a function to every string column and leave the others alone."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: change(_quoted(c)) for c in texts}) if texts else df


def map_texts_together(df: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """The same, with the function once in the plan, over an array of the columns.

    For expressions that are large themselves; a function in Python cannot stand there.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    held = "texts"
    while held.lower() in {c.lower() for c in df.columns}:
        held += "_"
    changed = df.withColumn(held, F.transform(F.array(*[_quoted(c) for c in texts]), change))
    return changed.select(
        *[F.get(held, F.lit(texts.index(c))).alias(c) if c in texts else _quoted(c) for c in df.columns]
    )


def scalar_fields(df: DataFrame, struct: str | None = None, prefix: str = "") -> dict[str, Column]:
    """Fields of scalar type, of the row or of one struct column, by prefixed name.

    Nested and array fields are left out; the declared type decides.
    """
    kind = df.schema if struct is None else df.schema[struct].dataType
    parent = None if struct is None else _quoted(struct)
    return {
        prefix + f.name: _quoted(f.name) if parent is None else parent.getField(f.name)
        for f in kind.fields
        if isinstance(f.dataType, _SCALARS)
    }


def merged_record(*parts: Mapping[str, Column]) -> list[Column]:
    """One row of several groups of columns.

    A repeated name keeps the place of its first mention and takes the last value.
    """
    merged: dict[str, Column] = {}
    for part in parts:
        merged.update(part)
    return [value.alias(name) for name, value in merged.items()]


def concat_frames(frames: Iterable[DataFrame]) -> DataFrame:
    """Put frames under each other by column name; absent columns are null, copies stay."""
    return reduce(lambda one, two: one.unionByName(two, allowMissingColumns=True), frames)


def flatten_rows(df: DataFrame, rows: str) -> DataFrame:
    """One row per struct of a nested list (or list of lists); copies stay."""
    nested = _quoted(rows)
    if isinstance(df.schema[rows].dataType.elementType, T.ArrayType):
        nested = F.flatten(nested)
    return df.select(F.inline(nested))


def row_count(df: DataFrame, name: str = "rows") -> DataFrame:
    """Number of rows, as a table of one row."""
    return df.agg(F.count(F.lit(1)).alias(name))


def page_of(df: DataFrame, page: int = 1, size: int = 5, order: str | Column = "id") -> DataFrame:
    """One page of rows with ``page, pageSize, count, totalCount`` beside them.

    The page is a top-k over the order column, not a sort of the table. The total is a scalar
    subquery with partial counts; it reads only the columns of the filters before it.
    """
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    total = row_count(df, "n").scalar()
    rows = df.orderBy(order).offset((page - 1) * size).limit(size)
    numbered = rows.select(
        "*", F.lit(page).alias("page"), F.lit(size).alias("pageSize"), total.alias("totalCount")
    )
    left = F.col("totalCount") - (page - 1) * size
    counted = F.greatest(F.lit(0), F.least(F.lit(size), left)).alias("count")
    return numbered.select(*rows.columns, "page", "pageSize", counted, "totalCount")


def page_after(df: DataFrame, last: Mapping | None = None, size: int = 5, order: Sequence[str] = ("id",)) -> DataFrame:
    """The ``size`` rows behind ``last`` in ascending order of some columns, nulls first.

    ``last`` has the values of the order columns in the last row of the page before; without it the
    first rows are given. The order has to tell rows apart: of rows that are equal in it those that
    did not fit on a page are not met again. Every page is a top-k of ``size`` rows under a condition
    that files with statistics are pruned by.
    """
    if size < 1:
        raise ValueError("size starts at 1")
    keys = list(order)
    if last is not None and set(last) != set(keys):
        raise ValueError(f"the last row has to have values for {keys} alone")
    chosen = df if last is None else df.where(_behind({name: last[name] for name in keys}))
    return chosen.orderBy(*[_quoted(name).asc_nulls_first() for name in keys]).limit(size)


def _behind(last: Mapping) -> Column:
    """Whether a row comes after the values, nulls first."""
    (name, value), *rest = last.items()
    column = _quoted(name)
    greater = column.isNotNull() if value is None else column > F.lit(value)
    if not rest:
        return greater
    equal = column.isNull() if value is None else column == F.lit(value)
    behind = greater | (equal & _behind(dict(rest)))
    # Implied by the other condition, and such that a scan can use it.
    return behind if value is None else (column >= F.lit(value)) & behind


def last_key(page: DataFrame, order: Sequence[str] = ("id",)) -> dict | None:
    """The values of the order columns in the last row of a page, null for an empty page.

    At most a page comes to the driver.
    """
    keys = list(order)
    row = page.select(*map(_quoted, keys)).orderBy(*[_quoted(name).desc_nulls_last() for name in keys]).first()
    return None if row is None else dict(zip(keys, row))


def page_counts(df: DataFrame, page: int = 1, size: int = 5) -> DataFrame:
    """``page, pageSize, count, totalCount`` of a page as one row, also of a page past the end."""
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    left = F.col("totalCount") - (page - 1) * size
    return row_count(df, "totalCount").select(
        F.lit(page).alias("page"),
        F.lit(size).alias("pageSize"),
        F.greatest(F.lit(0), F.least(F.lit(size), left)).alias("count"),
        "totalCount",
    )
