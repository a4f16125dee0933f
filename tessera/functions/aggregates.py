"""Aggregates by name, usable over groups and over windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import interval, micros
from .typed import V, number


def sum_(a: V) -> Column:
    if a.is_interval:
        return interval(F.coalesce(F.sum(micros(a)), F.lit(0)))
    zero = F.lit(0.0) if a.is_float else F.lit(0)
    return F.coalesce(F.sum(number(a)), zero)


def mean(a: V) -> Column:
    return F.avg(number(a))


def quantile(a: V, q: float) -> Column:
    return F.percentile(number(a), F.lit(q))


def approx_quartile(a: V, quartile: int) -> Column:
    return F.approx_percentile(number(a), quartile / 4)


def all_(a: V) -> Column:
    return F.coalesce(F.bool_and(a.col if a.is_bool else a.col != 0), F.lit(True))


def any_(a: V) -> Column:
    return F.coalesce(F.bool_or(a.col if a.is_bool else a.col != 0), F.lit(False))


def _moments(a: V) -> tuple[Column, Column]:
    x = number(a).cast("double")
    return x, F.count(x).cast("double")


def skew(a: V) -> Column:
    """Bias-corrected; null under three values."""
    x, n = _moments(a)
    return F.when(n >= 3, F.when(F.var_pop(x) == 0, 0.0).otherwise(F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))))


def kurt(a: V) -> Column:
    """Bias-corrected excess; null under four values."""
    x, n = _moments(a)
    part = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n >= 4, F.when(F.var_pop(x) == 0, 0.0).otherwise(part * ((n + 1) * F.kurtosis(x) + 6)))


BY_NAME = {
    "size": lambda a: F.count(F.lit(1)), "count": lambda a: F.count(a.col), "sum": sum_, "mean": mean, "min": lambda a: F.min(a.col), "max": lambda a: F.max(a.col),
    "median": lambda a: quantile(a, 0.5), "product": lambda a: F.coalesce(F.product(number(a)), F.lit(1.0)), "prod": lambda a: F.coalesce(F.product(number(a)), F.lit(1.0)),
    "std": lambda a: F.stddev_samp(number(a)), "var": lambda a: F.var_samp(number(a)), "popvar": lambda a: F.var_pop(number(a)), "all": all_, "any": any_,
    "nunique": lambda a: F.count_distinct(a.col), "skew": skew, "kurt": kurt, "kurtosis": kurt, "any_value": lambda a: F.any_value(a.col),
    "q1": lambda a: approx_quartile(a, 1), "q2": lambda a: approx_quartile(a, 2), "q3": lambda a: approx_quartile(a, 3),
}


def by_name(how) -> str:
    """The name of an aggregate given as a string or a function."""
    name = how if isinstance(how, str) else getattr(how, "__name__", str(how))
    name = {"amin": "min", "amax": "max", "len": "size", "average": "mean"}.get(name, name)
    if name not in BY_NAME:
        raise ValueError(f"no aggregate named {name!r}")
    return name


def aggregate(how, a: V) -> Column:
    return BY_NAME[by_name(how)](a)


def array_agg(a: V, order: list[Column]) -> Column:
    """Non-null values in row order."""
    item = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], a.col.alias("x"))
    return F.transform(F.sort_array(F.collect_list(F.when(a.col.isNotNull(), item))), lambda s: s["x"])


def string_agg(a: V, sep: str, order: list[Column]) -> Column:
    return F.coalesce(F.array_join(array_agg(a, order), sep), F.lit(""))


def approx_top_count(a: V, number_: int) -> Column:
    return F.call_function("approx_top_k", a.col, F.lit(number_))
