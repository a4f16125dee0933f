"""Sessions: readers of tables, queries, files and local data."""

from __future__ import annotations

import functools
import re
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import logic
from ..functions.typed import V, literal
from ..plans.frame import DataFrame, Index, Series, listed
from . import functions as udfs


def predicate(sdf, filters) -> Column | None:
    """DNF tuples (column, operator, value) as a condition that reaches the scan."""
    if not filters:
        return None
    if isinstance(filters[0], tuple):
        filters = [filters]

    def one(name, op, value) -> Column:
        c = F.col(f"`{name}`")
        match op.lower():
            case "in":
                return c.isin(list(value))
            case "not in":
                return ~c.isin(list(value))
            case "like":
                return c.like(value)
            case "==" | "=":
                return c == literal(value).col
            case "!=":
                return c != literal(value).col
            case _:
                return {"<": c < literal(value).col, "<=": c <= literal(value).col, ">": c > literal(value).col, ">=": c >= literal(value).col}[op]

    ands = [functools.reduce(lambda a, b: a & b, (one(*t) for t in group)) for group in filters]
    return functools.reduce(lambda a, b: a | b, ands)


class Session:
    _active: Session | None = None

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.active()
        Session._active = self

    @classmethod
    def active(cls) -> Session:
        if cls._active is None:
            cls(SparkSession.active())
        return cls._active

    def _framed(self, sdf, index_col=None, columns=None, filters=None, max_results=None) -> DataFrame:
        cond = predicate(sdf, filters)
        if cond is not None:
            sdf = sdf.where(cond)
        index = listed(index_col) if index_col is not None else []
        if columns is not None:
            sdf = sdf.select(*(f"`{c}`" for c in [*index, *(c for c in columns if c not in index)]))
        if max_results is not None:
            sdf = sdf.limit(max_results)
        return DataFrame.from_spark(sdf, index)

    # tables and queries -----------------------------------------------------------
    def read_table(self, name: str, index_col=None, columns=None, filters=None, max_results=None, version=None, timestamp=None):
        """A catalog table, or a folder of Parquet; versions where the format has them."""
        reader = self.spark.read
        if version is not None:
            reader = reader.option("versionAsOf", version)
        if timestamp is not None:
            reader = reader.option("timestampAsOf", timestamp)
        sdf = reader.parquet(name) if "/" in name else reader.table(name)
        return self._framed(sdf, index_col, columns, filters, max_results)

    def read_sql(self, query: str, index_col=None, columns=None, filters=None, max_results=None, **frames):
        """SQL text; ``{name}`` stands for a frame given by that name."""
        for name in set(re.findall(r"\{(\w+)\}", query)):
            value = frames[name]
            if isinstance(value, (DataFrame, Series)):
                view = f"frame_{uuid.uuid4().hex}"
                value.to_spark(index=True).createOrReplaceTempView(view)
                query = query.replace(f"{{{name}}}", view)
            else:
                query = query.replace(f"{{{name}}}", str(value))
        return self._framed(self.spark.sql(query), index_col, columns, filters, max_results)

    def read(self, query_or_table: str, **kwargs):
        return self.read_sql(query_or_table, **kwargs) if re.search(r"\s", query_or_table.strip()) else self.read_table(query_or_table, **kwargs)

    # files ----------------------------------------------------------------------------
    def read_parquet(self, path, index_col=None, columns=None, filters=None):
        return self._framed(self.spark.read.parquet(*listed(path)), index_col, columns, filters)

    def read_csv(self, path, sep=",", header=0, names=None, index_col=None, usecols=None, dtype=None, encoding="utf-8", schema=None, **options):
        reader = self.spark.read.option("sep", sep).option("header", header == 0 and names is None or header == 0).option("encoding", encoding).options(**options)
        sdf = reader.csv(path, schema=schema, inferSchema=schema is None)
        if names is not None:
            sdf = sdf.toDF(*names)
        for c, t in (dtype or {}).items():
            sdf = sdf.withColumn(c, logic.astype(V(F.col(f"`{c}`"), sdf.schema[c].dataType), t))
        return self._framed(sdf, index_col, usecols)

    def read_json(self, path, orient=None, dtype=None, encoding="utf-8", lines=True, schema=None, **_):
        return self._framed(self.spark.read.option("encoding", encoding).option("multiLine", not lines).json(path, schema=schema))

    def read_orc(self, path):
        return self._framed(self.spark.read.orc(path))

    def read_pickle(self, path, **_):
        return self.read_pandas(pd.read_pickle(path))

    def read_pandas(self, data, **_):
        """Local data, in its order and with its index."""
        if isinstance(data, pd.Index):
            return Index.from_frame(self.read_pandas(data.to_frame(index=False)))
        if isinstance(data, pd.Series):
            frame = self.read_pandas(data.to_frame("x" if data.name is None else data.name))
            return frame.iloc_column(0).rename(data.name)
        levels = data.index.nlevels
        flat = data.copy()
        flat.columns = [f"c{k}" for k in range(data.shape[1])]
        for k in range(levels):
            flat[f"i{k}"] = data.index.get_level_values(k)
        flat["o"] = range(len(data))
        table = pa.Table.from_pandas(flat.reset_index(drop=True), preserve_index=False)
        table = pa.table({n: c.cast(pa.timestamp("us", c.type.tz)) if pa.types.is_timestamp(c.type) else c.cast(pa.duration("us")) if pa.types.is_duration(c.type) else c.cast(pa.float64()) if pa.types.is_null(c.type) else c for n, c in zip(table.column_names, table.columns)})
        frame = DataFrame.from_spark(self.spark.createDataFrame(table), [f"i{k}" for k in range(levels)], "o")
        frame.rows.names = list(data.index.names)
        out = frame.drop(columns="o")
        out.columns = list(data.columns)
        return out

    def read_arrow(self, table: pa.Table):
        return self._framed(self.spark.createDataFrame(table))

    def from_glob_path(self, path: str, name="blob"):
        """A row for each file: a reference with its uri and details; contents stay where they are."""
        files = self.spark.read.format("binaryFile").load(path).drop("content")
        details = F.to_json(F.struct(F.col("length").alias("size"), F.col("modificationTime").alias("updated")))
        ref = F.struct(F.col("path").alias("uri"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("authorizer"), details.alias("details"))
        return DataFrame.from_spark(files.select(ref.alias(name)))

    # streams, functions, models ---------------------------------------------------------------
    def read_stream(self, path: str, schema=None, format: str = "parquet"):
        from ..streaming.frames import StreamingDataFrame

        schema = schema or self.spark.read.format(format).load(path).schema
        return StreamingDataFrame(self.spark.readStream.schema(schema).format(format).load(path))

    def udf(self, *args, **kwargs):
        return udfs.udf(*args, session=self.spark, **kwargs)

    remote_function = deploy_udf = deploy_remote_function = udf

    def read_function(self, name: str):
        return udfs.read_function(name)

    def read_model(self, path: str):
        from ..ml import load

        return load(path)

    def create_external_table(self, name: str, path: str, format: str = "parquet", replace=False, if_not_exists=False):
        if replace:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        if not (if_not_exists and self.spark.catalog.tableExists(name)):
            self.spark.catalog.createTable(name, path=path, source=format)
        return self.read_table(name)

    def load_data(self, name: str, path, format: str = "parquet", write_disposition="append", partition_by=(), cluster_by=(), **options):
        out = self.spark.read.format(format).options(**options).load(path)
        if cluster_by:
            out = out.sortWithinPartitions(*listed(cluster_by))
        writer = out.write.mode({"append": "append", "into": "append", "overwrite": "overwrite"}[write_disposition])
        (writer.partitionBy(*listed(partition_by)) if partition_by else writer).saveAsTable(name)
        return self.read_table(name)

    def close(self):
        Session._active = None
        self.spark.stop()
