"""A set of rows that several frames and series look at.

``Rows`` is a Spark DataFrame that only ever gains columns.  Everything derived row by
row from one ``Rows`` is an expression over it, so combining such values is a
projection; values of different ``Rows`` meet by a join of their indexes.  Order is a
list of columns, carried along only by name: nothing is sorted until a verb needs it.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.typed import V

_IDS = itertools.count()


def fresh(prefix: str = "c") -> str:
    return f"{prefix}__{next(_IDS)}"


class Rows:
    def __init__(self, sdf: SparkFrame, index: list[str], names: list, order: list[tuple[str, bool]] | None = None):
        self.sdf, self.index, self.names, self.order, self.positions = sdf, index, names, list(order or []), ""
        #: Counts of the values of a column, by its name and direction, once ranks have asked for them.
        self.tallies: dict[tuple[str, bool], tuple] = {}

    def put(self, *exprs: Column) -> list[str]:
        """Columns for expressions; later expressions may build on them (windows may not nest)."""
        made = {fresh(): e for e in exprs}
        self.sdf = self.sdf.withColumns(made)
        return list(made)

    def value(self, expr: Column) -> V:
        return V(expr, self.sdf.select(expr.alias("x")).schema[0].dataType)

    def total_order(self) -> list[str]:
        """Names of an order of all rows; without one, a hash of the row decides."""
        if not self.order:
            groupable = [c for c, t in self.sdf.dtypes if not t.startswith(("map", "variant"))]
            self.order = [(n, True) for n in self.put(F.xxhash64(*(F.col(c) for c in groupable)), F.xxhash64(F.lit(1), *(F.col(c) for c in groupable)))]
        return [n for n, _ in self.order]

    def sort_columns(self, reverse: bool = False) -> list[Column]:
        """Sort keys, nulls last in both directions (first when reversed)."""
        self.total_order()
        out = []
        for name, up in self.order:
            c = F.col(name)
            if reverse:
                out.append(c.desc_nulls_first() if up else c.asc_nulls_first())
            else:
                out.append(c.asc_nulls_last() if up else c.desc_nulls_last())
        return out

    def window(self, by: list[Column] | None = None, reverse: bool = False):
        spec = Window.partitionBy(*by) if by else Window.partitionBy()
        return spec.orderBy(*self.sort_columns(reverse))

    def offset(self) -> str:
        """A column of 0-based positions.

        Rows are range-partitioned by the order and numbered inside partitions; only the
        partitions' sizes meet on the driver, so no task sees all rows.
        """
        from ..operators.offsets import with_offset

        if self.order and self.order[0] == (self.positions, True):
            return self.positions
        self.positions = fresh("pos")
        self.sdf = with_offset(self.sdf, self.sort_columns(), self.positions)
        self.order = [(self.positions, True)]
        return self.positions

    def near(self, make: Callable[[WindowSpec], Column], before: int, after: int, width: int = 1 << 20) -> str:
        """A window column that looks at most ``before`` rows back and ``after`` rows on, over the global order.

        Positions fall into buckets of ``width`` rows; rows near a border are also given
        to the neighbour as context, so each bucket is windowed alone and no task sees
        more than ``width`` rows and their context.
        """
        pos, bucket, name = F.col(self.offset()), fresh("b"), fresh()
        held = F.explode(F.sequence(F.floor((pos - after) / width), F.floor((pos + before) / width)))
        spread = self.sdf.withColumn(bucket, held)
        made = spread.withColumn(name, make(Window.partitionBy(bucket).orderBy(pos)))
        self.sdf = made.where(F.col(bucket) == F.floor(pos / width)).drop(bucket)
        return name
