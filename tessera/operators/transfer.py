"""Rows on their way to the driver: Arrow batches where all types are plain, Spark's rows elsewhere."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ARROW = "spark.sql.execution.arrow.pyspark.enabled"
#: Types that Arrow and Spark's rows turn into the same values; times depend on zones, nested values on options.
PLAIN = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.DateType, T.DecimalType)


def plain(df: DataFrame) -> bool:
    return bool(df.columns) and all(isinstance(f.dataType, PLAIN) for f in df.schema.fields)


def fetched(df: DataFrame) -> pd.DataFrame:
    """All rows, as ``toPandas`` gives them."""
    if not plain(df):
        return df.toPandas()
    spark = df.sparkSession
    was = spark.conf.get(ARROW)
    spark.conf.set(ARROW, "true")
    try:
        return df.toPandas()
    finally:
        spark.conf.set(ARROW, was)


def pages(df: DataFrame, size: int) -> Iterator[pd.DataFrame]:
    """Pages of ``size`` rows, typed by their values; the driver holds a page and a partition's batches at a time."""
    if not plain(df):
        yield from _row_pages(df, size)
        return
    import pyarrow as pa

    def packed(batches):
        import pyarrow as pa

        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["b"])

    held, n = [], 0
    for row in df.mapInArrow(packed, "b binary").toLocalIterator():
        with pa.ipc.open_stream(bytes(row["b"])) as stream:
            held.append(stream.read_all())
        n += held[-1].num_rows
        if n >= size:
            whole = pa.concat_tables(held)
            full = n - n % size
            for at in range(0, full, size):
                yield _page(whole.slice(at, size), df.columns)
            held, n = [whole.slice(full)], n % size
    if n:
        yield _page(pa.concat_tables(held), df.columns)


def _page(table, names: list[str]) -> pd.DataFrame:
    """Whole numbers and fractions of 64 bits, and nulls alone as they are: the types that values have in Python."""

    def typed(column) -> pd.Series:
        if column.null_count == len(column):
            return pd.Series([None] * len(column), dtype=object)
        s = column.to_pandas()
        return s.astype({"i": "int64", "f": "float64"}[s.dtype.kind]) if s.dtype.kind in "if" else s

    out = pd.concat([typed(c) for c in table.columns], axis=1)
    out.columns = names
    return out


def _row_pages(df: DataFrame, size: int) -> Iterator[pd.DataFrame]:
    page = []
    for row in df.toLocalIterator():
        page.append(row)
        if len(page) == size:
            yield pd.DataFrame(page, columns=df.columns)
            page = []
    if page:
        yield pd.DataFrame(page, columns=df.columns)
