"""Operators backed by a model: any function of texts that a backend offers.

A ``Backend`` turns prompts into texts and texts into vectors, batch by batch, where the
tasks run.  The one here needs no network: it answers by word overlap, so results are
repeatable; real models implement the same two methods.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import functions as F

from ..plans.frame import DataFrame, Series

WORDS = re.compile(r"\w+")


class Backend:
    """Hashed bag-of-words vectors; answers are the option nearest to the prompt, or the prompt's words."""

    size = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.size)
            for w in WORDS.findall((text or "").lower()):
                h = zlib.crc32(w.encode())
                v[h % self.size] += 1 if h >> 31 else -1
            out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
        return out

    def generate(self, prompts: list[str], options: list[str] | None = None) -> list[str]:
        if options:
            known = np.array(self.embed(options))
            return [options[int((known @ np.array(v)).argmax())] for v in self.embed(prompts)]
        return [" ".join(WORDS.findall(p or "")[:16]) for p in prompts]


DEFAULT = Backend()


def prompt(frame: DataFrame, instruction: str) -> Column:
    """``{column}`` in the instruction stands for the column's value."""
    parts = re.split(r"\{(\w+)\}", instruction)
    return F.concat(*(F.coalesce(frame[p].expr.cast("string"), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)))


def embed(text: Column, model: Backend = DEFAULT) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.embed(texts.tolist()))

    return run(text)


def generate(text: Column, kind: str = "string", model: Backend = DEFAULT, options: list[str] | None = None) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.generate(texts.tolist(), options))

    out = run(text)
    if kind == "boolean":
        return out == F.lit("true")
    if kind in ("bigint", "double"):
        return F.regexp_extract(out, r"-?\d+(\.\d+)?", 0).try_cast(kind)
    return out


def generate_bool(text: Column, model: Backend = DEFAULT) -> Column:
    return generate(text, "boolean", model, ["true", "false"])


def generate_int(text: Column, model: Backend = DEFAULT) -> Column:
    return generate(text, "bigint", model)


def generate_double(text: Column, model: Backend = DEFAULT) -> Column:
    return generate(text, "double", model)


if_ = generate_bool


def classify(text: Column, categories: list[str], model: Backend = DEFAULT) -> Column:
    return generate(text, "string", model, list(categories))


def score(text: Column, model: Backend = DEFAULT) -> Column:
    """Share of the prompt's weight on its first vector half, in 0..1: a stand-in for a rating."""
    return F.aggregate(F.slice(embed(text, model), 1, 32), F.lit(0.0), lambda a, v: a + v * v)


def generate_table(text: Column, schema: dict[str, str], model: Backend = DEFAULT) -> Column:
    return F.struct(*(generate(F.concat(text, F.lit(f" {n}")), t, model).alias(n) for n, t in schema.items()))


def forecast(df: SparkFrame, timestamp: str, value: str, ids: list[str], horizon: int = 10, confidence: float = 0.95) -> SparkFrame:
    """Holt's linear trend for each series: (ids, forecast_timestamp, forecast_value, bounds)."""
    from ..operators.trend import holt

    z = 1.959964 if confidence == 0.95 else float(np.sqrt(2) * _erfinv(confidence))
    return holt(df, timestamp, value, ids, horizon, z)


def _erfinv(p: float) -> float:
    a = 0.147
    ln = np.log(1 - p * p)
    return float(np.sqrt(np.sqrt((2 / (np.pi * a) + ln / 2) ** 2 - ln / a) - (2 / (np.pi * a) + ln / 2)))


class AIAccessor:
    """Model-backed verbs of a frame; ``most`` guards against calls nobody wants to pay for."""

    most = 1_000_000

    def __init__(self, frame: DataFrame):
        self._frame = frame

    def _guard(self, n: int):
        if n > self.most:
            raise ValueError(f"{n} model calls exceed the limit of {self.most}")

    def filter(self, instruction: str, model: Backend = DEFAULT):
        name = self._frame.rows.put(generate_bool(prompt(self._frame, instruction), model))[0]
        return self._frame._filtered(F.col(name))

    def map(self, instruction: str, model: Backend = DEFAULT, output_schema=None, output_column="ml_generate_text"):
        text = prompt(self._frame, instruction)
        cols = output_schema or {output_column: "string"}
        return self._frame._new([*self._frame._columns, *((n, generate(text, t, model)) for n, t in cols.items())])

    def classify(self, instruction: str, model: Backend = DEFAULT, labels=(), output_column="result"):
        return self._frame._new([*self._frame._columns, (output_column, classify(prompt(self._frame, instruction), list(labels), model))])

    def join(self, other: DataFrame, instruction: str, model: Backend = DEFAULT):
        """Pairs that the model accepts; the number of pairs is checked first."""
        self._guard(len(self._frame) * len(other))
        both = self._frame.merge(other, how="cross", suffixes=("_left", "_right"))
        return AIAccessor(both).filter(re.sub(r"\{(left|right)\.(\w+)\}", lambda m: "{" + (f"{m[2]}_{m[1]}" if f"{m[2]}_{m[1]}" in both else m[2]) + "}", instruction), model)

    def search(self, search_column: str, query: str, top_k: int, model: Backend = DEFAULT, score_column: str | None = None):
        q = F.array(*(F.lit(x) for x in model.embed([query])[0]))
        from ..functions.vector import cosine

        near = self._frame._new([*self._frame._columns, (score_column or "__score", 1 - cosine(embed(self._frame[search_column].expr, model), q))])._stored()
        out = near.sort_values(score_column or "__score", ascending=False).head(top_k)
        return out if score_column else out.drop(columns="__score")

    def sim_join(self, other: DataFrame, left_on: str, right_on: str, model: Backend = DEFAULT, top_k: int = 3, score_column: str | None = None, max_rows: int = 1000):
        """For each left row its most similar right rows, by exact search in blocks."""
        from ..operators.search import vector_search
        from .. import merge

        if (n := len(self._frame)) > max_rows:
            raise ValueError(f"{n} rows exceed the limit of {max_rows}")
        left, right = self._frame.with_positions()._stored(), other.with_positions()._stored()
        lk, rk = left.rows.index[0], right.rows.index[0]
        q = left.rows.sdf.select(F.col(lk).alias("__l"), embed(left[left_on].expr, model).alias("q"))
        b = right.rows.sdf.select(F.col(rk).alias("__r"), embed(right[right_on].expr, model).alias("v"))
        near = DataFrame.from_spark(vector_search(b, "v", "__r", q, "q", "__l", top_k))
        near = near._new([*((n, e) for n, e in near._columns if n != "distance"), (score_column or "__score", 1 - near._column("distance"))])
        out = merge(merge(near, left, "inner", left_on="__l", right_index=True), right, "inner", left_on="__r", right_index=True, suffixes=("", "_right"))
        return out.drop(columns=["__l", "__r", *([] if score_column else ["__score"])])

    def forecast(self, timestamp_column: str, data_column: str, id_columns=(), horizon: int = 10, confidence_level: float = 0.95, model=None):
        return DataFrame.from_spark(forecast(self._frame.to_spark(), timestamp_column, data_column, list(id_columns), horizon, confidence_level))


class Semantics(AIAccessor):
    """The same verbs under their older names, and aggregation, clustering and top-k."""

    def map(self, instruction: str, output_column: str, model: Backend = DEFAULT):
        return AIAccessor.map(self, instruction, model, output_column=output_column)

    def agg(self, instruction: str, model: Backend = DEFAULT, cluster_column: str | None = None, max_agg_rows: int = 10):
        """One answer for each cluster: answers of ``max_agg_rows`` rows at a time are themselves put together."""
        text = prompt(self._frame, instruction)
        key = self._frame[cluster_column].expr if cluster_column else F.lit(0)
        rows = self._frame.rows.sdf.select(key.alias("k"), text.alias("t"), F.xxhash64(text).alias("h"))
        while True:
            n = rows.groupBy("k").count().agg(F.max("count")).first()[0] or 0
            parts = max(1, -(-n // max_agg_rows))
            rows = rows.groupBy("k", F.pmod("h", F.lit(parts)).alias("p")).agg(F.array_join(F.sort_array(F.collect_list("t")), "\n").alias("t")).select("k", generate(F.col("t"), "string", model).alias("t"))
            if parts == 1:
                return rows.select(*([F.col("k").alias(cluster_column)] if cluster_column else []), F.col("t").alias("result"))
            rows = rows.withColumn("h", F.xxhash64("t"))

    def cluster_by(self, column: str, output_column: str, model: Backend = DEFAULT, n_clusters: int = 5):
        from ..ml import KMeans

        frame = self._frame
        vectors = frame._new([("v", embed(frame[column].expr, model))])._stored()
        return frame.assign(**{output_column: KMeans(n_clusters=n_clusters).fit(vectors).predict(vectors)["centroid_id"]})

    def top_k(self, instruction: str, model: Backend = DEFAULT, k: int = 10):
        """The ``k`` rows that score best under the instruction."""
        frame = self._frame._new([*self._frame._columns, ("__score", score(prompt(self._frame, instruction), model))])._stored()
        return frame.sort_values("__score", ascending=False).head(k).drop(columns="__score")


def top(series: Series, model: Backend = DEFAULT) -> Series:
    return series._new(embed(series.expr, model))
