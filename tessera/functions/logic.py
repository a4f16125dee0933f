"""Comparison, boolean, null, cast, conditional and hash operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numeric import micros, micros_time, time_micros
from .typed import V, literal, number


def _pair(a: V, b: V) -> tuple[Column, Column]:
    if a.is_bool != b.is_bool and (a.is_number or b.is_number):
        return number(a), number(b)
    return a.col, b.col


def _compare(op: str):
    def run(a: V, b: V) -> Column:
        x, y = _pair(a, b)
        said = {"eq": x == y, "ne": x != y, "lt": x < y, "gt": x > y, "le": x <= y, "ge": x >= y}[op]
        nans = [F.isnan(v.col) for v in (a, b) if v.is_float]
        if not nans:
            return said
        any_nan = nans[0] if len(nans) == 1 else nans[0] | nans[1]
        # NaN compares false with everything, also with itself.
        return F.when(any_nan & x.isNotNull() & y.isNotNull(), F.lit(op == "ne")).otherwise(said)

    return run


eq, ne, lt, gt, le, ge = (_compare(k) for k in ("eq", "ne", "lt", "gt", "le", "ge"))


def eq_nulls_match(a: V, b: V) -> Column:
    return a.col.eqNullSafe(b.col)


def and_(a: V, b: V) -> Column:
    return a.col & b.col if a.is_bool or b.is_bool else a.col.bitwiseAND(b.col)


def or_(a: V, b: V) -> Column:
    return a.col | b.col if a.is_bool or b.is_bool else a.col.bitwiseOR(b.col)


def xor(a: V, b: V) -> Column:
    return (a.col & ~b.col) | (~a.col & b.col) if a.is_bool or b.is_bool else a.col.bitwiseXOR(b.col)


def invert(a: V) -> Column:
    return ~a.col if a.is_bool else F.bitwise_not(a.col)


def isnull(a: V) -> Column:
    return a.col.isNull() | F.isnan(a.col) if a.is_float else a.col.isNull()


def notnull(a: V) -> Column:
    return ~isnull(a)


def hash_(a: V) -> Column:
    return F.xxhash64(a.col)


#: Names of types that users may give, and Spark's.
NAMES = {
    "int64": "bigint", "Int64": "bigint", "int": "bigint", "int64[pyarrow]": "bigint", "float64": "double", "Float64": "double", "float": "double", "double": "double",
    "bool": "boolean", "boolean": "boolean", "string": "string", "str": "string", "string[pyarrow]": "string", "bytes": "binary", "binary[pyarrow]": "binary", "date32[day][pyarrow]": "date", "date": "date",
    "datetime64[ns]": "timestamp_ntz", "timestamp[us][pyarrow]": "timestamp_ntz", "timestamp[us, tz=UTC][pyarrow]": "timestamp", "timestamp": "timestamp", "decimal": "decimal(38,9)", "duration[us][pyarrow]": "interval day to second", "timedelta64[ns]": "interval day to second",
}


def type_of(name) -> T.DataType:
    if isinstance(name, T.DataType):
        return name
    if isinstance(name, type):
        name = name.__name__
    return T.DataType.fromDDL(NAMES.get(str(name), str(name)))


def astype(a: V, to, safe: bool = False) -> Column:
    to = type_of(to)
    if a.is_bool and isinstance(to, T.StringType):
        return F.initcap(a.col.cast("string"))
    if isinstance(to, T.BooleanType) and a.is_number:
        return a.col != 0
    if a.is_int and isinstance(to, (T.TimestampType, T.TimestampNTZType)):
        return micros_time(a.col, to)
    if isinstance(a.type, (T.TimestampType, T.TimestampNTZType)) and isinstance(to, T.LongType):
        return time_micros(a.col, a.type)
    if a.is_interval and isinstance(to, T.LongType):
        return micros(a)
    if a.is_float and isinstance(to, T.LongType) and not safe:
        return F.when(F.isnan(a.col), None).otherwise(a.col).cast(to)
    return a.col.try_cast(to) if safe else a.col.cast(to)


def isin(a: V, values: Sequence, match_nulls: bool = True) -> Column:
    """Never null: a null is in the values only if they hold one."""
    fit = [v for v in values if v is not None and v == v and (isinstance(v, str) == a.is_string)]
    has_null = any(v is None or v != v for v in values)
    found = F.coalesce(a.col.isin(fit), F.lit(False)) if fit else F.lit(False)
    return found | isnull(a) if has_null and match_nulls else found


def map_(a: V, mapping: Mapping, default: Column | None = None) -> Column:
    out = None
    for k, v in mapping.items():
        hit = a.col.isNull() if k is None else a.col == literal(k).col
        out = F.when(hit, literal(v).col) if out is None else out.when(hit, literal(v).col)
    other = a.col if default is None else default
    return other if out is None else out.otherwise(other)


def fillna(a: V, b: V) -> Column:
    return F.when(isnull(a), b.col).otherwise(a.col) if a.is_float else F.coalesce(a.col, b.col)


def maximum(a: V, b: V) -> Column:
    return F.when(a.col.isNull() | b.col.isNull() | (a.col < b.col), b.col + a.col * 0 if a.is_number and b.is_number else b.col).otherwise(a.col)


def minimum(a: V, b: V) -> Column:
    return F.when(a.col.isNull() | b.col.isNull() | (a.col > b.col), b.col + a.col * 0 if a.is_number and b.is_number else b.col).otherwise(a.col)


def where(a: V, cond: V, b: V) -> Column:
    return F.when(cond.col, a.col).otherwise(b.col)


def clip(a: V, lower: V | None = None, upper: V | None = None) -> Column:
    out = a.col
    if upper is not None and not isinstance(upper.type, T.NullType):
        out = F.when(upper.col.isNull(), F.lit(None)).otherwise(F.when(out > upper.col, upper.col).otherwise(out))
    if lower is not None and not isinstance(lower.type, T.NullType):
        out = F.when(lower.col.isNull(), F.lit(None)).otherwise(F.when(out < lower.col, lower.col).otherwise(out))
    return out


def case_when(cases: Sequence[tuple[V, V]], default: V | None = None) -> Column:
    mixed = {v.is_bool for _, v in cases} == {True, False}
    value = (lambda v: number(v)) if mixed else (lambda v: v.col)
    out = None
    for cond, v in cases:
        out = F.when(cond.col, value(v)) if out is None else out.when(cond.col, value(v))
    return out if default is None else out.otherwise(value(default))


BINARY = {"eq": eq, "ne": ne, "lt": lt, "gt": gt, "le": le, "ge": ge, "and": and_, "or": or_, "xor": xor, "maximum": maximum, "minimum": minimum, "eq_nulls_match": eq_nulls_match}
UNARY = {"invert": invert, "isnull": isnull, "notnull": notnull, "hash": hash_}
