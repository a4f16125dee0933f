"""Joins, existence tests, concatenation and reindexing."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import functions as F

from ..plans.frame import DataFrame, Index, Series, _join, listed
from ..plans.rows import Rows, fresh


def merge(left: DataFrame, right: DataFrame, how="inner", on=None, left_on=None, right_on=None, left_index=False, right_index=False, sort=False, suffixes=("_x", "_y")) -> DataFrame:
    """Key join.  Null keys match each other, equal key names become one column, other clashes get suffixes."""
    if how == "cross":
        on_a = on_b = []
        shared = []
    else:
        if on is None and left_on is None and right_on is None and not (left_index or right_index):
            on = [c for c in left.columns if c in right.columns]
        on_a = listed(on if on is not None else left_on) if not left_index else []
        on_b = listed(on if on is not None else right_on) if not right_index else []
        shared = [a for a, b in zip(on_a, on_b) if a == b] if not (left_index or right_index) else []
    a, b = left._stored(), right._stored()
    ka = [F.col(i) for i in a.rows.index] if left_index else [a._column(n) for n in on_a]
    kb = [F.col(i) for i in b.rows.index] if right_index else [b._column(n) for n in on_b]
    rows, la, lb = _join(a.rows, b.rows, ka, kb, how, [None] * max(1, len(ka)))
    ca = dict(zip(a.columns, a.rows.sdf.columns[-len(a._columns) :])) if a._columns else {}
    cb = dict(zip(b.columns, b.rows.sdf.columns[-len(b._columns) :])) if b._columns else {}
    keys = dict(zip(on_a, rows.index)) if not left_index else {}
    out = []
    for n in a.columns:
        if n in shared:
            out.append((n, F.col(keys[n])))
        else:
            out.append((f"{n}{suffixes[0]}" if n in cb and n not in shared else n, F.col(la[ca[n]])))
    for n in b.columns:
        if n not in shared:
            out.append((f"{n}{suffixes[1]}" if n in ca else n, F.col(lb[cb[n]])))
    keep_index = left_index or right_index
    order = [(keys[n], True) for n in on_a if n in keys] + rows.order if sort and keys else rows.order
    return DataFrame(Rows(rows.sdf, rows.index if keep_index else [], (left.rows.names if left_index else right.rows.names) if keep_index else [], order), out)


def join(left: DataFrame, right: DataFrame, on=None, how="left", lsuffix="", rsuffix="") -> DataFrame:
    """Join on the indexes, or on a column of the left with the index of the right."""
    clash = set(left.columns) & set(right.columns)
    if clash and not (lsuffix or rsuffix):
        raise ValueError(f"columns overlap: {sorted(map(str, clash))}")
    a = left.rename(columns=lambda n: f"{n}{lsuffix}" if n in clash else n)
    b = right.rename(columns=lambda n: f"{n}{rsuffix}" if n in clash else n)
    if on is not None:
        return merge(a, b, how, left_on=on, right_index=True)
    return merge(a, b, how, left_index=True, right_index=True)


def isin(left: Series, right: Series) -> Series:
    """Whether each value is among the other's, by a join with its distinct values; never null.

    The join repeats no row, so the rows stay the same and gain a column.
    """
    name = left.rows.put(left.expr)[0]
    key, mark = fresh(), fresh()
    other = right.rows.sdf.select(right.expr.alias(key)).distinct().withColumn(mark, F.lit(True))
    left.rows.sdf = left.rows.sdf.join(other, F.col(name).eqNullSafe(F.col(key)), "left")
    return left._new(F.col(mark).isNotNull())


def semi(left: DataFrame, right: DataFrame, on, anti: bool = False) -> DataFrame:
    """Rows with (or without) a match; the right side is never repeated into the result."""
    on = listed(on)
    names = left.rows.put(*(left._column(n) for n in on))
    keys = [fresh() for _ in on]
    other = right.rows.sdf.select(*(right._column(n).alias(k) for n, k in zip(on, keys)))
    cond = functools.reduce(lambda x, y: x & y, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(names, keys)))
    sdf = left.rows.sdf.join(other, cond, "left_anti" if anti else "left_semi")
    return DataFrame(left._taken(sdf), left._columns)


def map_series(left: Series, mapping: Series) -> Series:
    """Values looked up in another series' index; of several for one label, any."""
    name = left.rows.put(left.expr)[0]
    key, value = fresh(), fresh()
    other = mapping.rows.sdf.groupBy(F.col(mapping.rows.index[0]).alias(key)).agg(F.any_value(mapping.expr).alias(value))
    left.rows.sdf = left.rows.sdf.join(other, F.col(name).eqNullSafe(F.col(key)), "left")
    return left._new(F.col(value))


def reindex(frame: DataFrame, labels) -> DataFrame:
    """Rows for the given labels in their order; absent ones are null."""
    from ..plans.frame import _local

    if isinstance(labels, Index):
        target = DataFrame(labels.rows, [("__key", F.col(labels.rows.index[0]))])
    else:
        target = _local(pd.DataFrame({"__key": list(labels)}))
    out = merge(target, frame, "left", left_on="__key", right_index=True)
    rows = out.rows
    index = rows.put(out._column("__key"))
    return DataFrame(Rows(rows.sdf, index, frame.rows.names, rows.order), [c for c in out._columns if c[0] != "__key"])


def concat(objs, axis=0, join="outer", ignore_index=False):
    """Rows one after another (by source, then order) or columns side by side by index."""
    objs = list(objs)
    if axis in (1, "columns"):
        frames = [o.to_frame() if isinstance(o, Series) else o for o in objs]
        out = frames[0]
        for f in frames[1:]:
            if f.rows is out.rows:
                out = out._new(out._columns + f._columns)
            else:
                a, b = out._stored(), f._stored()
                rows, la, lb = _join(a.rows, b.rows, [F.col(i) for i in a.rows.index], [F.col(i) for i in b.rows.index], join, a.rows.names)
                out = DataFrame(rows, [(n, F.col(la[c])) for n, c in zip(a.columns, a.rows.sdf.columns[-len(a._columns) :])] + [(n, F.col(lb[c])) for n, c in zip(b.columns, b.rows.sdf.columns[-len(b._columns) :])])
        return out
    series = all(isinstance(o, Series) for o in objs)
    frames = [o.to_frame("x") if isinstance(o, Series) else o for o in objs]
    labels = list(dict.fromkeys(c for f in frames for c in f.columns))
    if join == "inner":
        labels = [n for n in labels if all(n in f for f in frames)]
    levels = len(frames[0].rows.index)
    source, names, index = fresh("src"), [fresh() for _ in labels], [fresh("i") for _ in range(levels)]
    offsets = max(len(f.rows.order) for f in frames)
    order = [fresh("o") for _ in range(offsets)]
    parts = []
    for k, f in enumerate(frames):
        f.rows.total_order() if not f.rows.order and offsets else None
        sort = [F.col(c) if up else -F.col(c) for c, up in f.rows.order]
        parts.append(
            f.rows.sdf.select(
                F.lit(k).alias(source),
                *(s.alias(o) for s, o in zip(sort, order)),
                *(F.col(c).alias(i) for c, i in zip(f.rows.index, index)),
                *((f._column(n) if n in f else F.lit(None)).alias(c) for n, c in zip(labels, names)),
            )
        )
    sdf = functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    rows = Rows(sdf, [] if ignore_index else index, [] if ignore_index else frames[0].rows.names, [(source, True), *((o, True) for o in order)])
    out = DataFrame(rows, [(n, F.col(c)) for n, c in zip(labels, names)])
    return out["x"].rename(objs[0].name) if series else out


