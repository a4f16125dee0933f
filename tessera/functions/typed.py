"""A column with its Spark type."""

from __future__ import annotations

import datetime
import decimal
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)


class V(NamedTuple):
    col: Column
    type: T.DataType

    @property
    def is_bool(self) -> bool:
        return isinstance(self.type, T.BooleanType)

    @property
    def is_int(self) -> bool:
        return isinstance(self.type, INTEGRAL)

    @property
    def is_float(self) -> bool:
        return isinstance(self.type, FRACTIONAL)

    @property
    def is_number(self) -> bool:
        return self.is_int or self.is_float or isinstance(self.type, T.DecimalType)

    @property
    def is_string(self) -> bool:
        return isinstance(self.type, T.StringType)

    @property
    def is_time(self) -> bool:
        return isinstance(self.type, (T.DateType, T.TimestampType, T.TimestampNTZType))

    @property
    def is_interval(self) -> bool:
        return isinstance(self.type, T.DayTimeIntervalType)


def literal(value) -> V:
    """A Python value as a typed literal; numpy scalars and NaN included."""
    if isinstance(value, V):
        return value
    if value is None:
        return V(F.lit(None), T.NullType())
    if isinstance(value, np.generic):
        value = value.item()
    if isinstance(value, bool):
        return V(F.lit(value), T.BooleanType())
    if isinstance(value, int):
        return V(F.lit(value).cast("bigint"), T.LongType())
    if isinstance(value, float):
        return V(F.lit(value), T.DoubleType())
    if isinstance(value, str):
        return V(F.lit(value), T.StringType())
    if isinstance(value, (bytes, bytearray)):
        return V(F.lit(value), T.BinaryType())
    if isinstance(value, decimal.Decimal):
        return V(F.lit(value).cast("decimal(38,9)"), T.DecimalType(38, 9))
    if isinstance(value, datetime.datetime):
        # A wall-clock time goes as text: as a time it would pass through the machine's and the session's zones.
        return V(F.lit(value), T.TimestampType()) if value.tzinfo else V(F.lit(value.isoformat(" ")).cast("timestamp_ntz"), T.TimestampNTZType())
    if isinstance(value, datetime.date):
        return V(F.lit(value), T.DateType())
    if isinstance(value, datetime.timedelta):
        return V(F.lit(value), T.DayTimeIntervalType())
    raise TypeError(f"no Spark literal for {type(value).__name__}")


def number(v: V) -> Column:
    """Booleans count as 0 and 1."""
    return v.col.cast("bigint") if v.is_bool else v.col


def double(v: V) -> Column:
    return (v.col.cast("bigint") if v.is_bool else v.col).cast("double")
