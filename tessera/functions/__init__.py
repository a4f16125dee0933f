"""Scalar and aggregate operators as Spark columns.

Every function takes columns with their types (``V``) and gives a column, so plans stay
inside Catalyst and whole-stage code generation.  Null and NaN behave as in pandas with
nullable types: null spreads, division follows IEEE, modulo has the divisor's sign.
"""

from . import aggregates, datetimes, geo, logic, nested, numeric, strings, vector
from .typed import V, literal

__all__ = ["V", "aggregates", "datetimes", "geo", "literal", "logic", "nested", "numeric", "strings", "vector"]
