"""Pivot, melt, stack, explode, dummies, crosstab, value counts, description."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import aggregates
from ..functions.typed import number
from ..plans.frame import DataFrame, Series, listed
from ..plans.rows import Rows, fresh


def _distinct(frame: DataFrame, expr, most: int = 10_000) -> list:
    """Values that become column labels; more than ``most`` of them is an error, not a silent cut."""
    got = [r[0] for r in frame.rows.sdf.select(expr.alias("x")).where("x IS NOT NULL").distinct().limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"over {most} distinct values cannot become columns")
    return sorted(got)


def pivot(frame: DataFrame, columns, index=None, values=None, how="any_value") -> DataFrame:
    """Values spread over columns: one hash aggregation by the index, masked by each label."""
    columns = listed(columns)
    index = listed(index) if index is not None else None
    values_given = values
    values = listed(values) if values is not None else [c for c in frame.columns if c not in columns and c not in (index or ())]
    label = frame._column(columns[0]) if len(columns) == 1 else F.struct(*(frame._column(c).alias(str(c)) for c in columns))
    labels = _distinct(frame, label)
    out = []
    for v in values:
        s = frame[v]
        for x in labels:
            hit = (label == F.lit(x)) if len(columns) == 1 else (label == F.struct(*(F.lit(y).alias(str(c)) for y, c in zip(x, columns))))
            masked = type(s.v)(F.when(hit, s.expr), s.dtype)
            agg = F.any_value(masked.col, True) if how == "any_value" else F.sum(number(masked)) if how == "sum" else aggregates.aggregate(how, masked)
            shown = x if len(columns) == 1 else tuple(x)
            out.append((shown if values_given is not None and not isinstance(values_given, list) else (v, shown), agg))
    from .grouping import GroupBy

    keys = [(n, frame._column(n)) for n in index] if index is not None else [(n, F.col(c)) for n, c in zip(frame.rows.names, frame.rows.index)]
    return GroupBy(frame, keys, True, True)._result(out)


def crosstab(index: Series, columns: Series, values: Series | None = None, aggfunc=None, rownames=None, colnames=None) -> DataFrame:
    frame = DataFrame(index.rows, [("r", index.expr), ("c", columns.expr), ("v", values.expr if values is not None else F.lit(1))])
    out = pivot(frame, "c", "r", "v", aggfunc or "count")
    out.rows.names[0] = rownames[0] if rownames else index.name
    return out if aggfunc not in (None, "count", "sum") else out.fillna(0)


def melt(frame: DataFrame, id_vars=None, value_vars=None, var_name="variable", value_name="value") -> DataFrame:
    """Columns to rows by one generator, without a shuffle."""
    ids = listed(id_vars) if id_vars is not None else []
    vars_ = listed(value_vars) if value_vars is not None else [c for c in frame.columns if c not in ids]
    frame.rows.total_order()
    kind = frame.rows.sdf.select(F.coalesce(*(frame._column(v) for v in vars_)).alias("x")).schema[0].dataType
    pos, name, value = fresh("o"), fresh(), fresh()
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("n"), frame._column(v).cast(kind).alias("x")) for k, v in enumerate(vars_)))
    exploded = fresh()
    sdf = frame.rows.sdf.withColumn(exploded, F.explode(pairs)).withColumns({pos: F.col(exploded)["k"], name: F.col(exploded)["n"], value: F.col(exploded)["x"]})
    return DataFrame(Rows(sdf, [], [], [(pos, True), *frame.rows.order]), [*((n, frame._column(n)) for n in ids), (var_name, F.col(name)), (value_name, F.col(value))])


def stack(frame: DataFrame) -> Series:
    """Columns become the innermost index level."""
    base = DataFrame(frame.rows, frame._columns)
    out = melt(base, None, list(frame.columns), "__col", "__val")
    name = out.rows.put(out._column("__col"))[0]
    rows = Rows(out.rows.sdf, [*frame.rows.index, name], [*frame.rows.names, None], [*frame.rows.order, out.rows.order[0]])
    return Series(rows, out._column("__val"), None)


def unstack(frame: DataFrame, level=-1, single=False) -> DataFrame:
    """An index level becomes columns."""
    k = frame._level(level) % len(frame.rows.index)
    key = F.col(frame.rows.index[k])
    flat = DataFrame(frame.rows, [("__key", key), *frame._columns])
    rest = [i for i in range(len(frame.rows.index)) if i != k]
    flat.__dict__["rows"] = Rows(frame.rows.sdf, [frame.rows.index[i] for i in rest], [frame.rows.names[i] for i in rest], frame.rows.order)
    return pivot(flat, "__key", None, "x" if single else list(frame.columns), "any_value")


def transpose(frame: DataFrame) -> DataFrame:
    """Labels of rows become columns; rows are as many as columns were."""
    long = stack(frame)
    key = long.rows.index[-1]
    order = {n: k for k, n in enumerate(frame.columns)}
    flat = DataFrame(Rows(long.rows.sdf, [key], [None], long.rows.order), [("__r", F.col(long.rows.index[0])), ("__v", long.expr)])
    out = pivot(flat, "__r", None, "__v", "any_value")
    rank = out.rows.put(F.element_at(F.create_map(*(F.lit(x) for kv in order.items() for x in kv)), F.col(out.rows.index[0])))[0]
    return DataFrame(Rows(out.rows.sdf, out.rows.index, [None], [(rank, True)]), out._columns)


def explode(frame: DataFrame, columns: list, ignore_index=False) -> DataFrame:
    """A row for each element; empty and null arrays keep one row with null."""
    frame.rows.total_order()
    at, names = fresh("o"), [fresh() for _ in columns]
    made = fresh()
    sdf = frame.rows.sdf.withColumns({n: frame._column(c) for c, n in zip(columns, names)})
    zipped = F.arrays_zip(*(F.col(n) for n in names))
    sdf = sdf.select("*", F.posexplode_outer(zipped).alias(at, made))
    new = {c: F.col(made)[n] for c, n in zip(columns, names)}
    out = DataFrame(Rows(sdf, frame.rows.index, frame.rows.names, [*frame.rows.order, (at, True)]), [(n, new.get(n, e)) for n, e in frame._columns])
    return out.reset_index(drop=True) if ignore_index else out


def get_dummies(data, prefix=None, prefix_sep="_", dummy_na=False, columns=None, drop_first=False, dtype=None) -> DataFrame:
    """A boolean column for each value of each string column (or of those given)."""
    frame = data.to_frame() if isinstance(data, Series) else data
    chosen = listed(columns) if columns is not None else [s.name for s in frame._series() if s.v.is_string or isinstance(data, Series)]
    out = [c for c in frame._columns if c[0] not in chosen]
    for k, n in enumerate(chosen):
        e = frame._column(n)
        values = _distinct(frame, e)[1 if drop_first else 0 :]
        p = prefix if isinstance(prefix, str) else prefix[k] if isinstance(prefix, (list, tuple)) else prefix[n] if prefix else None if isinstance(data, Series) else n
        label = lambda x: x if p is None else f"{p}{prefix_sep}{x}"  # noqa: B023,E731
        out += [(label(v), F.coalesce(e == F.lit(v), F.lit(False))) for v in values]
        if dummy_na:
            out.append((label("<NA>"), e.isNull()))
    return frame._new(out)


def value_counts(frame: DataFrame, subset=None, normalize=False, sort=True, ascending=False, dropna=True) -> Series:
    from .grouping import GroupBy

    cols = listed(subset) if subset is not None else list(frame.columns)
    out = GroupBy(frame, [(c, frame._column(c)) for c in cols], True, dropna)._result([("count", F.count(F.lit(1)))])
    if normalize:
        total = out.rows.sdf.agg(F.sum(out._column("count"))).first()[0] or 1
        out = out._new([("proportion", out._column("count") / F.lit(total))])
    label = out.columns[0]
    return out.sort_values(label, ascending=ascending)[label] if sort else out[label]


def mode(s: Series) -> Series:
    """Most frequent values in ascending order."""
    counts = value_counts(s.to_frame("x"), sort=False)
    key, = counts.rows.index
    n = counts.rows.put(counts.expr)[0]
    top = counts.rows.sdf.agg(F.max(n)).first()[0]
    sdf = counts.rows.sdf.where(F.col(n) == F.lit(top))
    return Series(Rows(sdf, [], [], [(key, True)]), F.col(key), s.name)


def describe(frame: DataFrame, include=None) -> DataFrame:
    """Counts, moments and approximate quartiles of numeric columns; counts and distinct values of others."""
    numeric = [s for s in frame._series() if s.v.is_number]
    parts = ["count", "mean", "std", "min", "q1", "q2", "q3", "max"] if numeric and include != "all" or not [s for s in frame._series() if not s.v.is_number] else ["count", "nunique"]
    cols = numeric if parts[1] == "mean" else frame._series()
    shown = {"q1": "25%", "q2": "50%", "q3": "75%"}
    sdf = frame.rows.sdf.agg(*(F.array(*(aggregates.aggregate(p, s.v).cast("double") for p in parts)).alias(f"s{k}") for k, s in enumerate(cols)))
    at, stat = fresh("o"), fresh("i")
    names = F.array(*(F.lit(shown.get(p, p)) for p in parts))
    sdf = sdf.select("*", F.posexplode(names).alias(at, stat))
    rows = Rows(sdf, [stat], [None], [(at, True)])
    return DataFrame(rows, [(s.name, F.get(F.col(f"s{k}"), F.col(at))) for k, s in enumerate(cols)])


def dot(left: DataFrame, right) -> DataFrame | Series:
    """Matrix product; the right side's rows are the left's columns, few enough to be literals."""
    if isinstance(right, Series):
        weights = right.to_dict()
        total = sum((number(left[n].v) * F.lit(w) for n, w in weights.items()), F.lit(0))
        return Series(left.rows, total, None)
    table: pd.DataFrame = right.to_pandas()
    return left._new([(c, sum((number(left[n].v) * F.lit(float(w) if isinstance(w, float) else int(w)) for n, w in table[c].items()), F.lit(0))) for c in table.columns])


