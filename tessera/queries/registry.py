"""Registered queries: a name, a plan, and the same question in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import SparkSession

from ..plans.frame import DataFrame, Series
from ..sources.session import Session

QUERIES: dict[str, Callable[[SparkSession, str], SparkFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder as frames, keyed where they have a key."""

    KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"]}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.session = spark, folder, Session(spark)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return DataFrame.from_spark(self.spark.read.parquet(self.path(name)), None, self.KEYS[name])

    def indexed(self, name: str) -> DataFrame:
        return self.session.read_parquet(self.path(name), index_col=self.KEYS[name])


#: A rounded result with its name, parentheses nested up to four deep.
ROUNDED = re.compile(r"(round\((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*\)) AS ")


def query(name: str, sql: str | None = None):
    """Register a plan; in its SQL, rounded values lose the sign of zero, which Spark's rounding has not."""

    def add(f):
        def run(spark: SparkSession, folder: str) -> SparkFrame:
            out = f(Tables(spark, folder))
            return out.to_spark() if isinstance(out, (DataFrame, Series)) else out

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = ROUNDED.sub(r"\1 + 0 AS ", sql)
        return f

    return add
