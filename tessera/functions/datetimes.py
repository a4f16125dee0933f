"""Dates, timestamps, times of day and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numeric import interval, micros, micros_time, time_micros
from .typed import V

#: strftime directives and Spark's pattern letters.
FORMATS = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%j": "DDD",
    "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "E", "%Z": "z", "%z": "xx", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%D": "MM/dd/yy", "%R": "HH:mm", "%%": "%",
}


def pattern(directives: str) -> str:
    out, k, text = "", 0, ""
    while k < len(directives):
        two = directives[k : k + 2]
        if two in FORMATS:
            if text:
                out, text = out + "'" + text.replace("'", "''") + "'", ""
            out += FORMATS[two]
            k += 2
        else:
            if directives[k].isalpha():
                text += directives[k]
            else:
                if text:
                    out, text = out + "'" + text.replace("'", "''") + "'", ""
                out += directives[k]
            k += 1
    return out + ("'" + text.replace("'", "''") + "'" if text else "")


def _long(c: Column) -> Column:
    return c.cast("bigint")


PARTS = {
    "day": lambda a: _long(F.dayofmonth(a.col)), "month": lambda a: _long(F.month(a.col)), "year": lambda a: _long(F.year(a.col)), "quarter": lambda a: _long(F.quarter(a.col)),
    "dayofweek": lambda a: _long(F.weekday(a.col)), "day_of_week": lambda a: _long(F.weekday(a.col)), "weekday": lambda a: _long(F.weekday(a.col)),
    "dayofyear": lambda a: _long(F.dayofyear(a.col)), "day_of_year": lambda a: _long(F.dayofyear(a.col)),
    "hour": lambda a: _long(F.hour(a.col)), "minute": lambda a: _long(F.minute(a.col)), "second": lambda a: _long(F.second(a.col)),
    "date": lambda a: F.to_date(a.col), "time": lambda a: F.date_format(a.col, "HH:mm:ss.SSSSSS"), "normalize": lambda a: F.to_date(a.col).cast(a.type),
    "day_name": lambda a: F.date_format(a.col, "EEEE"), "iso_day": lambda a: _long(F.weekday(a.col) + 1), "iso_week": lambda a: _long(F.weekofyear(a.col)), "iso_year": lambda a: _long(F.extract(F.lit("YEAROFWEEK"), a.col)),
    "unix_seconds": lambda a: _long(F.floor(time_micros(a.col, a.type) / 1_000_000)), "unix_millis": lambda a: _long(F.floor(time_micros(a.col, a.type) / 1000)), "unix_micros": lambda a: time_micros(a.col, a.type),
    "days": lambda a: _long(F.floor(micros(a) / 86_400_000_000)), "seconds": lambda a: _long(F.floor(F.pmod(micros(a), F.lit(86_400_000_000)) / 1_000_000)), "microseconds": lambda a: _long(F.pmod(micros(a), F.lit(1_000_000))), "total_seconds": lambda a: micros(a) / 1_000_000,
}

UNITS = {"Y": "year", "YS": "year", "Q": "quarter", "QS": "quarter", "M": "month", "MS": "month", "W": "week", "D": "day", "h": "hour", "min": "minute", "s": "second", "ms": "millisecond", "us": "microsecond"}
#: Other names of units of numbers; as a frequency "M" is a month.
ALIASES = {"m": "min", "minute": "min", "minutes": "min", "second": "s", "seconds": "s", "hour": "h", "hours": "h", "H": "h", "d": "D", "day": "D", "days": "D", "milliseconds": "ms", "microseconds": "us"}
SECONDS = {"W": 604_800, "D": 86_400, "h": 3600, "min": 60, "s": 1, "ms": 1e-3, "us": 1e-6}


def floor_dt(a: V, freq: str) -> Column:
    """The start of the period; of wall-clock times by arithmetic, as truncation would take them for times of a zone."""
    if isinstance(a.type, T.TimestampType):
        return F.date_trunc(UNITS[freq], a.col)
    if freq in SECONDS:
        step, monday = int(SECONDS[freq] * 1_000_000), 3 * 86_400_000_000 * (freq == "W")
        us = time_micros(a.col, a.type) + monday
        return micros_time(us - F.pmod(us, F.lit(step)) - monday, T.TimestampNTZType())
    return F.trunc(F.to_date(a.col), UNITS[freq]).cast("timestamp_ntz")


def strftime(a: V, directives: str) -> Column:
    return F.date_format(a.col, pattern(directives))


def to_datetime(a: V, form: str | None = None, unit: str | None = None, utc: bool = False) -> Column:
    kind = "timestamp" if utc else "timestamp_ntz"
    if a.is_string:
        return (F.to_timestamp(a.col, pattern(form)) if form else F.to_timestamp(a.col)).cast(kind)
    if a.is_number:
        return micros_time(_micros_of(a, unit or "ns"), T.TimestampType() if utc else T.TimestampNTZType())
    return a.col.cast(kind)


def _micros_of(a: V, unit: str) -> Column:
    """Microseconds of a number of units; whole numbers stay whole."""
    if unit == "ns":
        return F.call_function("div", a.col - F.pmod(a.col, F.lit(1000)), F.lit(1000)) if a.is_int else F.floor(a.col / 1000)
    factor = round(SECONDS[ALIASES.get(unit, unit)] * 1_000_000)
    return a.col.cast("bigint") * factor if a.is_int else F.floor(a.col * factor)


def to_timedelta(a: V, unit: str = "us") -> Column:
    return interval(_micros_of(a, unit))


def date_diff(a: V, b: V) -> Column:
    return F.make_dt_interval(F.datediff(a.col, b.col))


def integer_label(a: V, seconds: float, first: Column) -> Column:
    """Number of the bin of fixed width; ``first`` is the micros at which bin 0 starts."""
    return F.floor((time_micros(a.col, a.type) - first) / F.lit(int(seconds * 1_000_000)))


def label_time(label: Column, seconds: float, first: Column, kind: T.DataType) -> Column:
    return micros_time(label * F.lit(int(seconds * 1_000_000)) + first, kind)
