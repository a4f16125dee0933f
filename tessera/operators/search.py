"""Nearest vectors by exact distance or through an inverted-file index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import DISTANCES


def _blocks(rows: list, vector: str, key: str):
    return [r[key] for r in rows], np.array([np.asarray(r[vector], np.float64) for r in rows])


def _distance(base: np.ndarray, q: np.ndarray, kind: str) -> np.ndarray:
    if kind == "COSINE":
        return 1 - (base @ q.T) / np.maximum(np.linalg.norm(base, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None], 1e-300)
    if kind == "DOT_PRODUCT":
        return -(base @ q.T)
    if kind == "MANHATTAN":
        return np.stack([np.abs(base - x).sum(1) for x in q], 1)
    return np.sqrt(np.maximum((base**2).sum(1)[:, None] + (q**2).sum(1)[None] - 2 * base @ q.T, 0))


def vector_search(base: DataFrame, vector: str, key: str, queries: DataFrame, query_vector: str, query_key: str, top_k: int = 10, distance: str = "COSINE", block: int = 1000, held_bytes: int = 256 << 20) -> DataFrame:
    """(query_key, key, distance): the ``top_k`` nearest rows of ``base`` for every query, exactly.

    Queries are broadcast, ``held_bytes`` of vectors at a time, each with one scan of the
    base; within a scan they go over the rows in blocks of a fixed size.  Each task keeps
    its own best ``top_k`` a query, and only those are shuffled.  Ties go to the smaller key.
    """
    context = base.sparkSession.sparkContext
    kinds = f"`{query_key}` {queries.schema[query_key].dataType.simpleString()}, `{key}` {base.schema[key].dataType.simpleString()}, distance double"
    empty = pd.DataFrame({query_key: pd.Series(dtype="object"), key: pd.Series(dtype="object"), "distance": pd.Series(dtype="float64")})

    def scan(blocks: list) -> DataFrame:
        sent = context.broadcast(blocks)

        def run(parts):
            best = [empty] * len(sent.value)
            for part in parts:
                part = part[part[vector].notna()]
                if not len(part):
                    continue
                rows, keys = np.array([np.asarray(x, np.float64) for x in part[vector]]), part[key].to_numpy()
                for k, (ids, q) in enumerate(sent.value):
                    d = _distance(rows, q, distance)
                    new = []
                    for j, i in enumerate(ids):
                        order = np.lexsort((keys, d[:, j]))[:top_k]
                        new.append(pd.DataFrame({query_key: i, key: keys[order], "distance": d[order, j]}))
                    best[k] = pd.concat([*([best[k]] if len(best[k]) else []), *new]).sort_values(["distance", key]).groupby(query_key, sort=False).head(top_k)
            yield from best

        return base.select(key, vector).mapInPandas(run, kinds)

    found, rows, blocks, held = None, [], [], 0
    for row in queries.select(F.col(query_key).alias("k"), F.col(query_vector).alias("v")).toLocalIterator():
        rows.append(row)
        if len(rows) == block:
            blocks.append(_blocks(rows, "v", "k"))
            held, rows = held + blocks[-1][1].nbytes, []
            if held >= held_bytes:
                part = scan(blocks)
                found, blocks, held = part if found is None else found.unionByName(part), [], 0
    if rows:
        blocks.append(_blocks(rows, "v", "k"))
    if blocks:
        part = scan(blocks)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return base.sparkSession.createDataFrame([], kinds)
    w = Window.partitionBy(query_key).orderBy("distance", key)
    return found.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= top_k).drop("__rank")


class VectorIndex:
    """Inverted lists around k-means centres fitted on a bounded sample; every row is listed."""

    def __init__(self, base: DataFrame, vector: str, key: str, lists: int = 32, sample: int = 20_000, seed: int = 1, distance: str = "EUCLIDEAN"):
        self.vector, self.key, self.distance = vector, key, distance
        some = base.select(vector).where(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.col(key), F.lit(seed))).limit(sample).toPandas()
        x = np.array([np.asarray(v, np.float64) for v in some[vector]])
        centres = x[np.random.default_rng(seed).choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(10):
            near = _distance(x, centres, "EUCLIDEAN").argmin(1)
            centres = np.array([x[near == k].mean(0) if (near == k).any() else centres[k] for k in range(len(centres))])
        self.centres = centres
        held = centres

        @F.pandas_udf("int")
        def nearest(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series(dtype="int32")
            return pd.Series(_distance(np.array([np.asarray(a, np.float64) for a in v]), held, "EUCLIDEAN").argmin(1).astype("int32"))

        self.rows = base.where(F.col(vector).isNotNull()).withColumn("__list", nearest(F.col(vector)))

    def search(self, queries: DataFrame, query_vector: str, query_key: str, top_k: int = 10, probes: int = 8) -> DataFrame:
        """As ``vector_search``, over the ``probes`` nearest lists of each query, by a join on the list."""
        held = self.centres

        @F.pandas_udf("array<int>")
        def near(v: pd.Series) -> pd.Series:
            d = _distance(np.array([np.asarray(a, np.float64) for a in v]), held, "EUCLIDEAN")
            return pd.Series(list(np.argsort(d, axis=1)[:, :probes].astype("int32")))

        q = queries.select(F.col(query_key), F.col(query_vector).alias("__q"), F.explode(near(F.col(query_vector))).alias("__list"))
        met = self.rows.join(q, "__list").withColumn("distance", DISTANCES[self.distance](F.col(self.vector), F.col("__q")))
        w = Window.partitionBy(query_key).orderBy("distance", self.key)
        return met.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= top_k).select(query_key, self.key, "distance")
