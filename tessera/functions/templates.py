"""SQL text with numbered places for columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.frame import Series


def sql_scalar(template: str, columns: list[Series]) -> Series:
    """``{0}``, ``{1}``... stand for the series given."""
    rows = columns[0].rows
    names = rows.put(*(c.expr for c in columns))
    return Series(rows, F.expr(template.format(*(f"`{n}`" for n in names))), None)
