"""Arithmetic, powers, logarithms, trigonometry and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .typed import V, double, number

INF = float("inf")


def _nan() -> Column:
    return F.lit(float("nan"))


def micros(v: V) -> Column:
    """An interval's microseconds, from its parts: the session's time zone has no say in them."""
    part = lambda n: F.extract(F.lit(n), v.col)
    minutes = (part("DAY").cast("bigint") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return minutes * 60_000_000 + (part("SECOND") * 1_000_000).cast("bigint")


def interval(us: Column) -> Column:
    """Microseconds as an interval."""
    return F.make_dt_interval(secs=(us.cast("bigint").cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)"))


def epoch() -> Column:
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")


def time_micros(c: Column, kind: T.DataType) -> Column:
    """A time's microseconds since 1970; wall-clock times count as they read, in any time zone."""
    return F.unix_micros(c) if isinstance(kind, T.TimestampType) else micros(V(c.cast("timestamp_ntz") - epoch(), T.DayTimeIntervalType()))


def micros_time(us: Column, kind: T.DataType) -> Column:
    """The time of a kind that ``time_micros`` was taken of."""
    return F.timestamp_micros(us.cast("bigint")) if isinstance(kind, T.TimestampType) else (epoch() + interval(us)).cast(kind)


def stamp(v: V) -> Column:
    return v.col.cast("timestamp_ntz") if isinstance(v.type, T.DateType) else v.col


def add(a: V, b: V) -> Column:
    if a.is_string or b.is_string:
        return F.concat(a.col, b.col)
    if a.is_bool and b.is_bool:
        return a.col | b.col
    if a.is_time and b.is_interval or a.is_interval and b.is_time:
        return stamp(a) + stamp(b)
    return number(a) + number(b)


def sub(a: V, b: V) -> Column:
    if a.is_time or b.is_time:
        return stamp(a) - stamp(b)
    return number(a) - number(b)


def mul(a: V, b: V) -> Column:
    if a.is_bool and b.is_bool:
        return a.col & b.col
    if a.is_interval or b.is_interval:
        i, x = (a, b) if a.is_interval else (b, a)
        return interval(micros(i) * number(x))
    return number(a) * number(b)


def div(a: V, b: V) -> Column:
    if a.is_interval and not b.is_interval:
        return interval(micros(a) / double(b))
    x, y = (micros(a).cast("double"), micros(b).cast("double")) if a.is_interval else (double(a), double(b))
    by_zero = F.when(F.isnan(x) | (x == 0), _nan()).when(x > 0, F.lit(INF)).when(x < 0, F.lit(-INF))
    return F.when(y == 0, by_zero).otherwise(x / F.nullif(y, F.lit(0.0)))


def mod(a: V, b: V) -> Column:
    x, y = number(a), number(b)
    rest = x % F.nullif(y, F.lit(0).cast(b.type if not b.is_bool else "bigint"))
    signed = F.when((rest != 0) & ((rest < 0) != (y < 0)), rest + y).otherwise(rest)
    at_zero = x * 0 if not (a.is_float or b.is_float) else x * _nan()
    return F.when(y == 0, at_zero).otherwise(signed)


def floordiv(a: V, b: V) -> Column:
    if a.is_interval:
        if b.is_interval:
            return F.floor(micros(a) / F.nullif(micros(b), F.lit(0)))
        return interval(F.floor(micros(a) / F.nullif(double(b), F.lit(0.0))))
    x, y = number(a), number(b)
    if a.is_float or b.is_float:
        return F.when(y == 0, x * F.lit(INF)).otherwise(F.floor(double(a) / F.nullif(double(b), F.lit(0.0))).cast("double"))
    exact = F.call_function("div", x - mod(a, b), F.nullif(y, F.lit(0).cast("bigint")))
    return F.when(y == 0, x * 0).otherwise(exact)


def power(a: V, b: V) -> Column:
    x, y = double(a), double(b)
    raised = F.when((x < 0) & (y != F.floor(y)), _nan()).when((x == 0) & (y < 0), F.lit(INF)).otherwise(F.pow(x, y))
    if (a.is_int or a.is_bool) and (b.is_int or b.is_bool):
        fits = F.abs(raised) < 9.223372036854775e18
        return F.when(fits, raised.cast("decimal(38,0)").cast("bigint"))
    return raised


def divmod_(a: V, b: V) -> tuple[Column, Column]:
    return floordiv(a, b), mod(a, b)


def ln(a: V) -> Column:
    x = double(a)
    return F.when(x == 0, F.lit(-INF)).when(x < 0, _nan()).otherwise(F.ln(x))


def log10(a: V) -> Column:
    x = double(a)
    return F.when(x == 0, F.lit(-INF)).when(x < 0, _nan()).otherwise(F.log10(x))


def log1p(a: V) -> Column:
    x = double(a)
    return F.when(x == -1, F.lit(-INF)).when(x < -1, _nan()).otherwise(F.log1p(x))


def sqrt(a: V) -> Column:
    x = double(a)
    return F.when(x < 0, _nan()).otherwise(F.sqrt(x))


def arctanh(a: V) -> Column:
    x = double(a)
    return F.when(x == 1, F.lit(INF)).when(x == -1, F.lit(-INF)).when(F.abs(x) > 1, _nan()).otherwise(F.atanh(x))


def round_(a: V, digits: int = 0) -> Column:
    return F.round(a.col, digits).cast(a.type)


def neg(a: V) -> Column:
    return -number(a)


def abs_(a: V) -> Column:
    return F.abs(number(a))


def isfinite(a: V) -> Column:
    x = double(a)
    return ~(F.isnan(x) | (F.abs(x) == INF))


UNARY = {
    "sin": lambda a: F.sin(double(a)), "cos": lambda a: F.cos(double(a)), "tan": lambda a: F.tan(double(a)),
    "arcsin": lambda a: F.asin(double(a)), "arccos": lambda a: F.acos(double(a)), "arctan": lambda a: F.atan(double(a)),
    "sinh": lambda a: F.sinh(double(a)), "cosh": lambda a: F.cosh(double(a)), "tanh": lambda a: F.tanh(double(a)),
    "arcsinh": lambda a: F.asinh(double(a)), "arccosh": lambda a: F.when(double(a) < 1, _nan()).otherwise(F.acosh(double(a))), "arctanh": arctanh,
    "floor": lambda a: F.floor(double(a)).cast("double"), "ceil": lambda a: F.ceil(double(a)).cast("double"),
    "abs": abs_, "absolute": abs_, "positive": lambda a: a.col, "negative": neg,
    "exp": lambda a: F.exp(double(a)), "expm1": lambda a: F.expm1(double(a)), "log": ln, "log10": log10, "log1p": log1p, "sqrt": sqrt,
    "isnan": lambda a: F.isnan(double(a)), "isfinite": isfinite,
}

BINARY = {
    "add": add, "sub": sub, "mul": mul, "truediv": div, "floordiv": floordiv, "mod": mod, "pow": power,
    "arctan2": lambda a, b: F.atan2(double(a), double(b)),
}
