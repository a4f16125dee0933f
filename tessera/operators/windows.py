"""Ranks, rolling and expanding aggregates, interpolation, binning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import aggregates, logic
from ..functions.numeric import time_micros
from ..functions.typed import V, number
from ..plans.frame import DataFrame, Series
from ..plans.rows import fresh


def _tally(s: Series, ascending: bool) -> tuple[Series, str, str, str, int, int]:
    """A series with, for its value, the number of equal ones, of those before it, and of distinct ones before it; then the number of values, and of distinct ones.

    Values are counted before the shuffle; running counts over the ordered values come
    from partition totals; they go back by a join on the value, once for all ranks of a column.
    """
    from .offsets import tallied

    rows, said = s.rows, str(s.expr)[8:-2]
    known = (said, ascending) if said in rows.sdf.columns else None
    if known in rows.tallies:
        return rows.tallies[known]
    x = s if known else s._stored()
    v, n, below, dense = fresh(), fresh(), fresh(), fresh()
    counts = rows.sdf.where(~logic.isnull(x.v)).groupBy(x.expr.alias(v)).agg(F.count(F.lit(1)).alias(n))
    table, total, kinds = tallied(counts, [F.col(v).asc() if ascending else F.col(v).desc()], n, below, dense)
    rows.sdf = rows.sdf.join(table, x.expr == F.col(v), "left")
    found = (x, n, below, dense, total, kinds)
    if known:
        rows.tallies[known] = found
    return found


def _global_rank(s: Series, method: str, na_option: str, ascending: bool, pct: bool) -> Series:
    """Ranks over all rows from counts of distinct values."""
    x, n, below, dense, total, kinds = _tally(s, ascending)
    null = logic.isnull(x.v)
    nulls = x.rows.sdf.where(null).count() if na_option != "keep" else 0
    low, size = F.col(below) + 1 + (nulls if na_option == "top" else 0), F.col(n)
    span = {"min": lambda lo, k: lo, "max": lambda lo, k: lo + k - 1, "average": lambda lo, k: lo + (k - 1) / 2.0}
    top = kinds if method == "dense" else total + nulls
    if method == "dense":
        r = F.col(dense) + 1 + (1 if na_option == "top" and nulls else 0)
        at_null = F.lit(1 if na_option == "top" else kinds + 1)
        top += bool(nulls)
    else:
        r, at_null = span[method](low, size), span[method](F.lit(1 if na_option == "top" else total + 1), F.lit(nulls))
    out = F.when(null, F.lit(None) if na_option == "keep" else at_null).otherwise(r).cast("double")
    return x._new(out / F.lit(float(top or 1)) if pct else out)


def _first_rank(x: Series, order: list[Column], na_option: str, pct: bool) -> Series:
    """Ranks over all rows in which ties go by the order of the rows."""
    from .offsets import with_offset

    rows, at, null = x.rows, fresh(), logic.isnull(x.v)
    rows.sdf = with_offset(rows.sdf, [*order, *rows.sort_columns()], at)
    out = (F.col(at) + 1).cast("double")
    if pct:
        out = out / F.lit(float(rows.sdf.where(~null if na_option == "keep" else F.lit(True)).count() or 1))
    return x._new(F.when(null, None).otherwise(out) if na_option == "keep" else out)


def rank(s: Series, by: list[Column], method="average", na_option="keep", ascending=True, pct=False) -> Series:
    """Positions among the values, ties by method; always floating."""
    if not by and method != "first":
        return _global_rank(s, method, na_option, ascending, pct)
    x = s._stored()
    null = logic.isnull(x.v)
    key = x.expr.asc_nulls_last() if ascending else x.expr.desc_nulls_last()
    first = (F.when(null, 0).otherwise(1) if na_option == "top" else F.when(null, 1).otherwise(0)).asc()
    if not by:
        return _first_rank(x, [first, key], na_option, pct)
    w = Window.partitionBy(*by).orderBy(first, key)
    low = F.rank().over(w)
    size = F.count(F.lit(1)).over(Window.partitionBy(*by, null, x.expr))
    if method == "first":
        r = F.row_number().over(Window.partitionBy(*by).orderBy(first, key, *x.rows.sort_columns()))
    else:
        r = {"min": low, "max": low + size - 1, "average": low + (size - 1) / 2.0, "dense": F.dense_rank().over(w)}[method]
    if pct:
        top = F.max(F.col(x.rows.put(F.dense_rank().over(w))[0])).over(Window.partitionBy(*by)) if method == "dense" else F.count(F.lit(1) if na_option != "keep" else x.expr).over(Window.partitionBy(*by))
        r = F.col(x.rows.put(r.cast("double"))[0]) / top
    out = r.cast("double")
    return x._window(F.when(null, None).otherwise(out) if na_option == "keep" else out)


class Rolling:
    """Aggregates over a moving frame of rows, or of time if the window is a duration; ``None`` expands."""

    def __init__(self, frame: DataFrame, window, min_periods=None, closed="right", on=None, by=(), series=False):
        self.frame, self.series = frame, series
        rows = frame.rows
        self.by, self.reach, self.time = list(by), None, None
        self.whole = window is None and not self.by
        if window is None:
            self.least = 1 if min_periods is None else min_periods
            self.spec = rows.window(self.by).rowsBetween(Window.unboundedPreceding, 0)
        elif isinstance(window, int):
            self.least = window if min_periods is None else min_periods
            n = window
            low, high = {"right": (-(n - 1), 0), "left": (-n, -1), "both": (-n, 0), "neither": (-(n - 1), -1)}[closed or "right"]
            self.frame_, self.reach = (low, high), n
            self.spec = rows.window(self.by).rowsBetween(low, high)
        else:
            self.least = 1 if min_periods is None else min_periods
            us = int(pd.Timedelta(window).total_seconds() * 1_000_000)
            at = frame._column(on) if on is not None else F.col(rows.index[0])
            name = rows.put(time_micros(at, rows.value(at).type))[0]
            low, high = {"right": (-us + 1, 0), "left": (-us, -1), "both": (-us, 0), "neither": (-us + 1, -1)}[closed or "right"]
            self.spec = Window.partitionBy(*self.by).orderBy(name).rangeBetween(low, high)
            self.time, self.span, self.width = name, (low, high), us
        self.skip = {on}

    def agg(self, how):
        if isinstance(how, dict):
            return DataFrame(self.frame.rows, [(n, self._one(self.frame[n], f)) for n, f in how.items()])
        cols = [(s.name, self._one(s, how)) for s in self.frame._series() if s.name not in self.skip or s.name is None]
        out = DataFrame(self.frame.rows, cols)
        return out.iloc_column(0) if self.series else out

    aggregate = agg

    def _one(self, s: Series, how) -> Column:
        x = s._stored()
        v = V(x.expr, s.dtype)
        name = aggregates.by_name(how)
        found = F.sum(number(v)) if name == "sum" else aggregates.aggregate(name, v)
        n = F.count(x.expr)

        def kept(w):
            return n.over(w) if name == "count" else F.when(n.over(w) >= self.least, found.over(w))

        if self.whole and name in ("count", "sum", "mean", "min", "max", "var", "std", "popvar"):
            return self._so_far(v, name)
        if self.time and not self.by:
            return self._by_time(kept)
        if self.reach is not None and not self.by:
            return F.col(self.frame.rows.near(lambda w: kept(w.rowsBetween(*self.frame_)), self.reach, 0))
        return F.col(self.frame.rows.put(kept(self.spec))[0])

    def _by_time(self, kept) -> Column:
        """A frame of time over all rows: time falls into buckets of eight windows, and rows near a border are context of the next bucket, too."""
        rows, at, bucket, made = self.frame.rows, F.col(self.time), fresh(), fresh()
        width = 8 * max(1, self.width)
        own = F.floor(at / width)
        spread = rows.sdf.withColumn(bucket, F.explode_outer(F.sequence(own, F.floor((at + self.width) / width))))
        spec = Window.partitionBy(bucket).orderBy(self.time).rangeBetween(*self.span)
        rows.sdf = spread.withColumn(made, kept(spec)).where(F.col(bucket).eqNullSafe(own)).drop(bucket)
        return F.col(made)

    def _so_far(self, v: V, name: str) -> Column:
        """Expanding aggregates over all rows from partition totals."""
        from .offsets import running, running_moments

        rows = self.frame.rows
        rows.offset()
        if name in ("var", "std", "popvar"):
            made = fresh()
            rows.sdf = running_moments(rows.sdf, rows.sort_columns(), number(v), made)
            n = F.col(made)["n"]
            out = F.col(made)["m2"] / F.nullif(n - int(name != "popvar"), F.lit(0))
            return F.when(n >= self.least, F.sqrt(out) if name == "std" else out)

        def run(expr: Column, how: str) -> Column:
            made = fresh()
            rows.sdf = running(rows.sdf, rows.sort_columns(), expr, how, made, rows.sort_columns(reverse=True))
            return F.col(made)

        n = run(F.when(v.col.isNotNull(), 1).otherwise(0), "sum").cast("bigint")
        if name == "count":
            return n
        if name in ("sum", "mean"):
            total = run(F.coalesce(number(v), F.lit(0)), "sum")
            out = total if name == "sum" else total / F.nullif(n, F.lit(0))
        else:
            out = run(run(number(v), name), "last")
        return F.when(n >= self.least, out)


for _n in ("count", "sum", "mean", "var", "std", "max", "min"):
    setattr(Rolling, _n, lambda self, n=_n: self.agg(n))


def interpolate(s: Series, method: str = "linear") -> Series:
    """Gaps between known values filled in row order; forward beyond the last for linear and pad."""
    from .offsets import running

    x = s._stored()
    rows = x.rows
    p = rows.offset()
    known, before, after = F.when(~logic.isnull(x.v), F.struct(F.col(p).alias("p"), x.expr.cast("double").alias("x"))), fresh(), fresh()
    rows.sdf = running(rows.sdf, rows.sort_columns(), known, "last", before, rows.sort_columns(reverse=True))
    rows.sdf = running(rows.sdf, rows.sort_columns(reverse=True), known, "last", after, rows.sort_columns())
    b, a, here = F.col(before), F.col(after), F.col(p)
    gap = F.nullif(a["p"] - b["p"], F.lit(0))
    filled = {
        "linear": F.coalesce(b["x"] + (a["x"] - b["x"]) * (here - b["p"]) / gap, b["x"]),
        "nearest": F.when(here - b["p"] <= a["p"] - here, b["x"]).otherwise(a["x"]),
        "zero": F.when(a.isNotNull(), b["x"]), "pad": b["x"], "ffill": b["x"],
    }[{"values": "linear", "index": "linear"}.get(method, method)]
    return x._new(F.coalesce(F.when(~logic.isnull(x.v), x.expr.cast("double")), filled))


def cut(x: Series, bins, right: bool = True, labels=None) -> Series:
    """Bins of equal width, or between given edges; labels are intervals, numbers or given strings."""
    s = x._stored()
    v = number(s.v).cast("double")
    if isinstance(bins, int):
        low, high = s.rows.sdf.agg(F.min(v), F.max(v)).first()
        width = (high - low) / bins
        edges = [low + width * k for k in range(bins + 1)]
        pad = (high - low) * 0.001
        if right:
            edges[0] -= pad
        else:
            edges[-1] += pad
    else:
        edges = list(bins)
    out = None
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        inside = (v > a) & (v <= b) if right else (v >= a) & (v < b)
        if labels is False:
            label = F.lit(k).cast("bigint")
        elif labels is not None:
            label = F.lit(labels[k])
        else:
            label = F.struct(F.lit(float(a)).alias("left_exclusive" if right else "left_inclusive"), F.lit(float(b)).alias("right_inclusive" if right else "right_exclusive"))
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return s._new(out)


def qcut(x: Series, q, labels=False) -> Series:
    """Bins of equal counts by percent rank, from counts of distinct values; 0-based numbers."""
    s, _, below, _, total, _ = _tally(x, True)
    some = F.col(below) / F.lit(float(max(1, total - 1)))
    if isinstance(q, int):
        bin_ = F.greatest(F.ceil(some * q) - 1, F.lit(0)).cast("bigint")
    else:
        bin_ = None
        for k, (a, b) in enumerate(zip(q, q[1:])):
            inside = (some > a) & (some <= b) if k else (some >= a) & (some <= b)
            bin_ = F.when(inside, F.lit(k).cast("bigint")) if bin_ is None else bin_.when(inside, F.lit(k).cast("bigint"))
    return s._new(F.when(s.expr.isNotNull(), bin_))
