"""Series to timestamps and intervals."""

from __future__ import annotations

from ..functions import datetimes
from ..plans.frame import Series


def to_datetime(arg: Series, utc: bool = False, format: str | None = None, unit: str | None = None) -> Series:
    return arg._new(datetimes.to_datetime(arg.v, format, unit, utc))


def to_timedelta(arg: Series, unit: str = "us") -> Series:
    return arg._new(datetimes.to_timedelta(arg.v, unit))
