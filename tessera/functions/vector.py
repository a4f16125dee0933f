"""Distances of arrays, element by element inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a, b) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a, b) -> Column:
    return 1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def manhattan(a, b) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def euclidean(a, b) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))))


DISTANCES = {"COSINE": cosine, "EUCLIDEAN": euclidean, "MANHATTAN": manhattan, "DOT_PRODUCT": lambda a, b: -dot(a, b)}
