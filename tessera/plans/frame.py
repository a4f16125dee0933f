"""Lazy, labelled frames and series over Spark plans."""

from __future__ import annotations

import datetime
import functools
import re
from collections.abc import Callable, Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import aggregates, datetimes, logic, nested, numeric, strings
from ..functions.typed import V, literal, number
from .rows import Rows, fresh

Scalar = (str, int, float, bool, bytes, datetime.date, datetime.timedelta, np.generic, type(None))


def is_scalar(x) -> bool:
    return isinstance(x, Scalar)


def listed(x) -> list:
    return list(x) if isinstance(x, (list, tuple, set, pd.Index)) or (isinstance(x, Iterable) and not isinstance(x, (str, bytes, Series))) else [x]


class Common:
    """What frames and series share."""

    rows: Rows

    @property
    def session(self):
        return self.rows.sdf.sparkSession

    @property
    def index(self) -> Index:
        return Index(self.rows)

    def __len__(self) -> int:
        return self.rows.sdf.count()

    def pipe(self, func: Callable, *args, **kwargs):
        return func(self, *args, **kwargs)

    @property
    def empty(self) -> bool:
        return not self.rows.sdf.limit(1).count()

    def copy(self):
        return self

    def to_csv(self, path=None, sep=",", header=True, index=True, **_):
        if path is None:
            return self.to_pandas().to_csv(sep=sep, header=header, index=index)
        self.to_spark(index=index).write.mode("overwrite").csv(path, sep=sep, header=header)

    def to_json(self, path=None, orient=None, lines=False, index=True, **_):
        if path is None:
            return self.to_pandas().to_json(orient=orient, lines=lines)
        self.to_spark(index=index).write.mode("overwrite").json(path)

    def to_parquet(self, path, compression="snappy", index=True, **_):
        self.to_spark(index=index).write.mode("overwrite").option("compression", compression or "none").parquet(path)

    def to_orc(self, path, index=True, **_):
        self.to_spark(index=index).write.mode("overwrite").orc(path)

    def to_table(self, name: str, if_exists: str = "fail", index: bool = True, clustering_columns: Sequence[str] = ()):
        """Write to a catalog table: fail, replace or append."""
        mode = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}[if_exists]
        out = self.to_spark(index=index)
        if clustering_columns:
            out = out.sortWithinPartitions(*clustering_columns)
        out.write.mode(mode).format("parquet").saveAsTable(name)
        return name

    def to_pandas_batches(self, page_size: int = 10_000, max_results: int | None = None):
        """Pages of rows in order; the driver holds one page at a time."""
        from ..operators.transfer import pages

        out = self.to_spark(index=True, ordered=True)
        yield from pages(out.limit(max_results) if max_results else out, page_size)

    def to_arrow(self, ordered: bool = True):
        return self.to_spark(index=True, ordered=ordered).toArrow()

    def to_numpy(self, dtype=None, **_):
        return self.to_pandas().to_numpy(dtype=dtype)

    __array__ = to_numpy

    @property
    def values(self):
        return self.to_numpy()

    def explain(self, mode: str = "formatted") -> None:
        """Print the physical plan."""
        self.to_spark().explain(mode=mode)

    def __bool__(self):
        raise ValueError("the truth of rows is ambiguous: use empty, any() or all()")

    def to_pickle(self, path, **_):
        self.to_pandas().to_pickle(path)

    def to_html(self, *args, **kwargs):
        return self.to_pandas().to_html(*args, **kwargs)

    def to_latex(self, *args, **kwargs):
        return self.to_pandas().to_latex(*args, **kwargs)

    def to_string(self, *args, **kwargs):
        return self.to_pandas().to_string(*args, **kwargs)

    def to_markdown(self, *args, **kwargs):
        return self.to_pandas().to_markdown(*args, **kwargs)

    def to_excel(self, path, **kwargs):
        self.to_pandas().to_excel(path, **kwargs)

    def cache(self):
        self.rows.sdf = self.rows.sdf.persist()
        return self

    def _taken(self, sdf: SparkFrame, order=None) -> Rows:
        return Rows(sdf, self.rows.index, self.rows.names, self.rows.order if order is None else order)

    def __array_ufunc__(self, ufunc, method, *inputs, **_):
        name = {"add": "add", "subtract": "sub", "multiply": "mul", "divide": "truediv", "true_divide": "truediv", "floor_divide": "floordiv", "remainder": "mod", "power": "pow"}.get(ufunc.__name__, ufunc.__name__)
        if method != "__call__":
            return NotImplemented
        if len(inputs) == 1:
            return self._map_unary(name)
        flip = inputs[0] is not self
        other = inputs[0] if flip else inputs[1]
        return self._binary(name, other, flip)

    # arithmetic -----------------------------------------------------------
    def _map_unary(self, name):
        raise NotImplementedError

    def _binary(self, name, other, flip=False):
        raise NotImplementedError


def _install_operators(cls):
    names = ["add", "sub", "mul", "truediv", "floordiv", "mod", "pow"]
    for n in names:
        setattr(cls, n, lambda self, other, axis=None, n=n: self._binary(n, other))
        setattr(cls, "r" + n, lambda self, other, axis=None, n=n: self._binary(n, other, True))
        setattr(cls, f"__{n}__", lambda self, other, n=n: self._binary(n, other))
        setattr(cls, f"__r{n}__", lambda self, other, n=n: self._binary(n, other, True))
    for n in ("eq", "ne", "lt", "le", "gt", "ge"):
        setattr(cls, n, lambda self, other, axis=None, n=n: self._binary(n, other))
        setattr(cls, f"__{n}__", lambda self, other, n=n: self._binary(n, other))
    for n in ("and", "or", "xor"):
        setattr(cls, f"__{n}__", lambda self, other, n=n: self._binary(n, other))
        setattr(cls, f"__r{n}__", lambda self, other, n=n: self._binary(n, other, True))
    for alias, n in (("div", "truediv"), ("rdiv", "rtruediv"), ("subtract", "sub"), ("multiply", "mul")):
        setattr(cls, alias, getattr(cls, n))
    cls.__invert__ = lambda self: self._map_unary("invert")
    cls.__neg__ = lambda self: self._map_unary("negative")
    cls.__pos__ = lambda self: self._map_unary("positive")
    cls.__abs__ = cls.abs = lambda self: self._map_unary("abs")
    cls.isna = cls.isnull = lambda self: self._map_unary("isnull")
    cls.notna = cls.notnull = lambda self: self._map_unary("notnull")
    cls.__hash__ = object.__hash__
    return cls


UNARY = {**numeric.UNARY, **logic.UNARY}
BINARY = {**numeric.BINARY, **logic.BINARY}


def joined(left: Common, right: Common, how: str = "outer") -> tuple[Rows, dict[str, str], dict[str, str]]:
    """Rows of both sides that share an index label; and where each side's columns went.  Null labels match."""
    return _join(left.rows, right.rows, [F.col(c) for c in left.rows.index], [F.col(c) for c in right.rows.index], how, left.rows.names)


def _join(a: Rows, b: Rows, on_a: list[Column], on_b: list[Column], how: str, names: list):
    ka, kb = [fresh("k") for _ in on_a], [fresh("k") for _ in on_b]
    la = {c: fresh() for c in a.sdf.columns}
    lb = {c: fresh() for c in b.sdf.columns}
    left = a.sdf.select(*(k.alias(n) for k, n in zip(on_a, ka)), *(F.col(c).alias(n) for c, n in la.items()))
    right = b.sdf.select(*(k.alias(n) for k, n in zip(on_b, kb)), *(F.col(c).alias(n) for c, n in lb.items()))
    if how == "cross":
        sdf = left.crossJoin(right)
        index = []
    else:
        cond = functools.reduce(lambda x, y: x & y, (left[x].eqNullSafe(right[y]) for x, y in zip(ka, kb)))
        sdf = left.join(right, cond, {"outer": "full"}.get(how, how))
        index = [fresh("i") for _ in ka]
        first, second = (kb, ka) if how == "right" else (ka, kb)
        sdf = sdf.withColumns({i: F.coalesce(F.col(x), F.col(y)) for i, x, y in zip(index, first, second)})
    if how == "outer":
        order = [(i, True) for i in index]
    elif how == "right":
        order = [(lb[c], u) for c, u in b.order] + [(la[c], u) for c, u in a.order]
    else:
        order = [(la[c], u) for c, u in a.order] + [(lb[c], u) for c, u in b.order]
    return Rows(sdf, index, names, order), la, lb


@_install_operators
class Series(Common):
    def __init__(self, rows: Rows, expr: Column, name=None):
        self.rows, self.expr, self.name = rows, expr, name

    # plumbing -------------------------------------------------------------
    @functools.cached_property
    def v(self) -> V:
        return self.rows.value(self.expr)

    @property
    def dtype(self) -> T.DataType:
        return self.v.type

    dtypes = dtype

    def _new(self, expr: Column, name="__same") -> Series:
        return Series(self.rows, expr, self.name if name == "__same" else name)

    def _window(self, expr: Column) -> Series:
        return self._new(F.col(self.rows.put(expr)[0]))

    def _stored(self) -> Series:
        """The same values as a column, so that windows can be built on them."""
        return self._new(F.col(self.rows.put(self.expr)[0]))

    def _with(self, other) -> tuple[Series, V]:
        """Self and another value over the same rows."""
        if isinstance(other, Series):
            if other.rows is self.rows:
                return self, other.v
            a, b = self.rows.put(self.expr)[0], other.rows.put(other.expr)[0]
            rows, la, lb = joined(self, other)
            return Series(rows, F.col(la[a]), self.name), rows.value(F.col(lb[b]))
        return self, literal(other)

    def _map_unary(self, name):
        return self._new(UNARY[name](self.v))

    def _binary(self, name, other, flip=False):
        if isinstance(other, DataFrame):
            return other._binary(name, self, not flip)
        me, o = self._with(other)
        a, b = (o, me.v) if flip else (me.v, o)
        if name in ("eq", "ne") and isinstance(o.type, T.NullType):
            return me._new(me.expr.isNull() if name == "eq" else me.expr.isNotNull())
        keep = self.name if not isinstance(other, Series) or other.name == self.name else None
        return me._new(BINARY[name](a, b), keep)

    def to_frame(self, name=None) -> DataFrame:
        return DataFrame(self.rows, [(name if name is not None else self.name if self.name is not None else 0, self.expr)])

    def to_spark(self, index: bool = False, ordered: bool = False) -> SparkFrame:
        return self.to_frame().to_spark(index, ordered)

    def to_pandas(self, **_) -> pd.Series:
        out = self.to_frame(name="0" if self.name is None else None).to_pandas()
        return out.iloc[:, 0].rename(self.name)

    def to_dict(self, into=dict, **_):
        return self.to_pandas().to_dict(into=into)

    def tolist(self, **_) -> list:
        return self.to_pandas().tolist()

    to_list = tolist

    def __iter__(self):
        return iter(self.tolist())

    def items(self):
        return self.to_pandas().items()

    def keys(self):
        return self.index

    @property
    def shape(self):
        return (len(self),)

    @property
    def size(self):
        return len(self)

    ndim = 1

    @property
    def T(self):
        return self

    transpose = lambda self: self

    @property
    def hasnans(self) -> bool:
        return bool(self.isna().any())

    def item(self):
        values = self.head(2).tolist()
        if len(values) != 1:
            raise ValueError("can only convert a series of one value to a scalar")
        return values[0]

    def __contains__(self, key):
        return key in self.index

    def rename(self, index=None, **_):
        return self._new(self.expr, index)

    def rename_axis(self, mapper=None, **_):
        return Series(Rows(self.rows.sdf, self.rows.index, listed(mapper), self.rows.order), self.expr, self.name)

    # element-wise ---------------------------------------------------------
    def astype(self, dtype, errors: str = "raise"):
        return self._new(logic.astype(self.v, dtype, errors == "null"))

    def round(self, decimals: int = 0):
        return self._new(numeric.round_(self.v, decimals))

    def divmod(self, other):
        return self._binary("floordiv", other), self._binary("mod", other)

    def rdivmod(self, other):
        return self._binary("floordiv", other, True), self._binary("mod", other, True)

    def between(self, left, right, inclusive: str = "both"):
        low = self._binary("ge" if inclusive in ("both", "left") else "gt", left)
        return low & self._binary("le" if inclusive in ("both", "right") else "lt", right)

    def isin(self, values):
        if isinstance(values, Series):
            from ..operators.relational import isin

            return isin(self, values)
        return self._new(logic.isin(self.v, list(values)))

    def fillna(self, value):
        me, o = self._with(value)
        return me._new(logic.fillna(me.v, o))

    def combine_first(self, other):
        me, o = self._with(other)
        return me._new(logic.fillna(me.v, o))

    def where(self, cond, other=None):
        if callable(cond):
            cond = cond(self)
        me, c = self._with(cond)
        if isinstance(other, Series) and other.rows is not me.rows:
            return self.to_frame("a").assign(c=cond, o=other).pipe(lambda d: d["a"].where(d["c"], d["o"])).rename(self.name)
        o = other.v if isinstance(other, Series) else literal(other)
        return me._new(logic.where(me.v, c, o))

    def mask(self, cond, other=None):
        return self.where(~(cond(self) if callable(cond) else cond), other)

    def clip(self, lower=None, upper=None):
        return self._new(logic.clip(self.v, lower.v if isinstance(lower, Series) else literal(lower), upper.v if isinstance(upper, Series) else literal(upper)))

    def case_when(self, caselist):
        pairs = [(c.v, v.v if isinstance(v, Series) else literal(v)) for c, v in caselist]
        return self._new(logic.case_when(pairs, self.v))

    def replace(self, to_replace=None, value=None, regex: bool = False):
        if regex:
            return self._new(strings.replace(self.expr, to_replace, value, regex=True))
        mapping = to_replace if isinstance(to_replace, Mapping) else {k: value for k in listed(to_replace)}
        return self._new(logic.map_(self.v, mapping))

    def map(self, arg, na_action=None, **_):
        if isinstance(arg, Mapping):
            return self._new(logic.map_(self.v, arg, F.lit(None)))
        if isinstance(arg, Series):
            from ..operators.relational import map_series

            return map_series(self, arg)
        return self.apply(arg, na_action=na_action)

    def apply(self, func, by_row="compat", args=(), na_action=None, **_):
        """A registered function, or a Python one as an Arrow-batched UDF (its type from the annotation)."""
        if hasattr(func, "spark_udf"):
            called = func.spark_udf(self.expr, *(F.lit(a) for a in args))
            return self._new(F.when(self.expr.isNotNull(), called) if na_action == "ignore" else called)
        from ..sources.functions import udf

        return self.apply(udf(func), args=args, na_action=na_action)

    def combine(self, other, func):
        return func(self, other)

    def update(self, other):
        self.expr = other.combine_first(self).expr if other.rows is self.rows else self.expr

    # aggregates -----------------------------------------------------------
    def _one(self, expr: Column):
        return self.rows.sdf.agg(expr.alias("x")).first()[0]

    def agg(self, func):
        if isinstance(func, (list, tuple)):
            return self.to_frame().agg(list(func))[self.name]
        return self._one(aggregates.aggregate(func, self.v))

    aggregate = agg

    def quantile(self, q=0.5):
        if isinstance(q, (list, tuple)):
            got = self.rows.sdf.agg(F.percentile(number(self.v), F.array(*(F.lit(x) for x in q)))).first()[0]
            return pd.Series(got, index=list(q), name=self.name)
        return self._one(aggregates.quantile(self.v, q))

    def median(self, exact: bool = True):
        return self._one(aggregates.quantile(self.v, 0.5) if exact else aggregates.approx_quartile(self.v, 2))

    def nunique(self):
        return self._one(F.count_distinct(self.expr))

    def corr(self, other, method="pearson", min_periods=None):
        me, o = self._with(other)
        return me._one(F.corr(number(me.v).cast("double"), number(o).cast("double")))

    def cov(self, other):
        me, o = self._with(other)
        return me._one(F.covar_samp(number(me.v).cast("double"), number(o).cast("double")))

    def autocorr(self, lag: int = 1):
        return self.corr(self.shift(lag))

    def dot(self, other):
        return (self * other).sum()

    __matmul__ = __rmatmul__ = dot

    def __setitem__(self, key, value):
        """Values by label, on this series only."""
        hit = logic.isin(self.rows.value(F.col(self.rows.index[0])), listed(key))
        self.expr = logic.where(literal(value), V(hit, T.BooleanType()), V(self.expr, self.dtype))
        self.__dict__.pop("v", None)

    def to_xarray(self, **_):
        return self.to_pandas().to_xarray()

    def describe(self):
        return self.to_frame().describe().to_pandas()[self.name]

    def mode(self):
        from ..operators.reshape import mode

        return mode(self)

    def _first_at(self, key: Column):
        """Index of the row that is first by a key of the values, then in row order; nulls are passed over."""
        row = self.rows.sdf.where(self.expr.isNotNull()).orderBy(key, *self.rows.sort_columns()).select(self.rows.index[0]).first()
        return None if row is None else row[0]

    def idxmax(self):
        return self._first_at(self.expr.desc())

    def idxmin(self):
        return self._first_at(self.expr.asc())

    def argmax(self):
        pos = self.rows.offset()
        return self.rows.sdf.where(self.expr.isNotNull()).orderBy(self.expr.desc(), pos).select(pos).first()[0]

    def argmin(self):
        pos = self.rows.offset()
        return self.rows.sdf.where(self.expr.isNotNull()).orderBy(self.expr.asc(), pos).select(pos).first()[0]

    @property
    def is_unique(self) -> bool:
        return not self.rows.sdf.groupBy(self.expr.alias("x")).count().where("count > 1").limit(1).count()

    def _monotonic(self, up: bool) -> bool:
        x = self._stored()
        before = x.shift(1)
        bad = (x.expr < before.expr) if up else (x.expr > before.expr)
        return not self.rows.sdf.where(bad | x.expr.isNull()).limit(1).count()

    @property
    def is_monotonic_increasing(self) -> bool:
        return self._monotonic(True)

    @property
    def is_monotonic_decreasing(self) -> bool:
        return self._monotonic(False)

    def unique(self, keep_order: bool = True):
        return self.drop_duplicates().reset_index(drop=True) if keep_order else Series(Rows(self.rows.sdf.select(self.expr.alias(n := fresh())).distinct(), [], []), F.col(n), self.name)

    def value_counts(self, normalize=False, sort=True, ascending=False, dropna=True):
        from ..operators.reshape import value_counts

        return value_counts(self.to_frame(), None, normalize, sort, ascending, dropna)

    # windows ---------------------------------------------------------------
    def _running(self, how: str) -> Series:
        from ..operators.offsets import running

        name, me = fresh(), V(self.expr, self.dtype)
        self.rows.sdf = running(self.rows.sdf, self.rows.sort_columns(), number(me), how, name)
        return self._new(F.col(name))

    def cumsum(self):
        return self._running("sum")

    def cumprod(self):
        return self._running("prod")

    def cummin(self):
        return self._running("min")

    def cummax(self):
        return self._running("max")

    def shift(self, periods: int = 1):
        x = self._stored().expr
        if not periods:
            return self._new(x)
        if periods > 0:
            return self._new(F.col(self.rows.near(lambda w: F.lag(x, periods).over(w), periods, 0)))
        return self._new(F.col(self.rows.near(lambda w: F.lead(x, -periods).over(w), 0, -periods)))

    def diff(self, periods: int = 1):
        x = self._stored()
        before = x.shift(periods)
        return x._new(x.expr != before.expr) if self.v.is_bool else x - before

    def pct_change(self, periods: int = 1):
        x = self._stored()
        return x / x.shift(periods) - 1

    def _last(self, limit: int | None, back: bool) -> Series:
        """The nearest value before (or after) that is not null, itself included."""
        x = self._stored().expr
        if limit:
            frame = (0, limit) if back else (-limit, 0)
            pick = F.first if back else F.last
            return self._new(F.col(self.rows.near(lambda w: pick(x, ignorenulls=True).over(w.rowsBetween(*frame)), 0 if back else limit, limit if back else 0)))
        self.rows.offset()
        from ..operators.offsets import running

        name = fresh()
        self.rows.sdf = running(self.rows.sdf, self.rows.sort_columns(back), x, "last", name, self.rows.sort_columns(not back))
        return self._new(F.col(name))

    def ffill(self, limit: int | None = None):
        return self._last(limit, False)

    pad = ffill

    def bfill(self, limit: int | None = None):
        return self._last(limit, True)

    def interpolate(self, method: str = "linear"):
        from ..operators.windows import interpolate

        return interpolate(self, method)

    def rank(self, axis=0, method="average", numeric_only=False, na_option="keep", ascending=True, pct=False):
        from ..operators.windows import rank

        return rank(self, [], method, na_option, ascending, pct)

    def rolling(self, window, min_periods=None, closed="right"):
        from ..operators.windows import Rolling

        return Rolling(self.to_frame(), window, min_periods, closed, series=True)

    def expanding(self, min_periods: int = 1):
        from ..operators.windows import Rolling

        return Rolling(self.to_frame(), None, min_periods, "right", series=True)

    # rows --------------------------------------------------------------------
    def __getitem__(self, key):
        if isinstance(key, Series):
            return self.to_frame("x")[key]["x"].rename(self.name)
        if isinstance(key, slice):
            return self.iloc[key]
        return self.loc[key]

    @property
    def loc(self):
        return Loc(self)

    @property
    def iloc(self):
        return ILoc(self)

    at, iat = loc, iloc

    def get(self, key, default=None):
        try:
            return self[key]
        except KeyError:
            return default

    def _via(self, verb: str, *args, **kwargs) -> Series:
        return getattr(self.to_frame("x"), verb)(*args, **kwargs)["x"].rename(self.name)

    def head(self, n: int = 5):
        return self._via("head", n)

    def tail(self, n: int = 5):
        return self._via("tail", n)

    def peek(self, n: int = 5, **_):
        return self.to_frame().peek(n).iloc[:, 0]

    def sort_values(self, axis=0, inplace=False, ascending=True, kind=None, na_position="last"):
        return self._via("sort_values", "x", ascending=ascending, na_position=na_position)

    def sort_index(self, axis=0, inplace=False, ascending=True, na_position="last"):
        return self._via("sort_index", ascending=ascending, na_position=na_position)

    def nlargest(self, n=5, keep="first"):
        return self._via("nlargest", n, "x", keep)

    def nsmallest(self, n=5, keep="first"):
        return self._via("nsmallest", n, "x", keep)

    def dropna(self, **_):
        return self._via("dropna")

    def drop_duplicates(self, keep="first"):
        return self._via("drop_duplicates", None, keep)

    def duplicated(self, keep="first"):
        return self.to_frame("x").duplicated(keep=keep)

    def sample(self, n=None, frac=None, random_state=None, sort="random"):
        return self._via("sample", n, frac, random_state, sort)

    def explode(self, ignore_index=False):
        return self._via("explode", "x", ignore_index)

    def drop(self, labels=None, **kwargs):
        return self._via("drop", index=labels if labels is not None else kwargs.get("index"))

    def take(self, indices, axis=0, **_):
        return self._via("take", indices)

    def filter(self, items=None, like=None, regex=None, axis=0):
        return self._via("filter", items, like, regex, 0)

    def reindex(self, index=None, validate=None):
        return self._via("reindex", index=index)

    def reindex_like(self, other, validate=None):
        return self.reindex(other.index)

    def reset_index(self, level=None, name=None, drop=False, **_):
        frame = self.to_frame(name).reset_index(drop=drop)
        return frame.iloc_column(0).rename(self.name) if drop else frame

    def add_prefix(self, prefix, axis=None):
        return self._relabelled(lambda i: F.concat(F.lit(prefix), i.cast("string")))

    def add_suffix(self, suffix, axis=None):
        return self._relabelled(lambda i: F.concat(i.cast("string"), F.lit(suffix)))

    def _relabelled(self, f) -> Series:
        index = self.rows.put(*(f(F.col(i)) for i in self.rows.index))
        return Series(Rows(self.rows.sdf, index, self.rows.names, self.rows.order), self.expr, self.name)

    def equals(self, other) -> bool:
        return self.to_frame("x").equals(other.to_frame("x"))

    def first_valid_index(self):
        return self.to_frame().first_valid_index()

    def unstack(self, level=-1):
        from ..operators.reshape import unstack

        return unstack(self.to_frame("x"), level, single=True)

    def groupby(self, by=None, axis=0, level=None, as_index=True, dropna=True):
        frame = self.to_frame("x")
        if by is not None and isinstance(by, Series) and by.rows is self.rows:
            frame = DataFrame(self.rows, [("x", self.expr), ("by", by.expr)])
            return frame.groupby("by", dropna=dropna)["x"]._named(self.name, by.name)
        return frame.groupby(by, level=level, dropna=dropna)["x"]._named(self.name)

    def resample(self, rule, closed=None, label=None, level=None, origin="start_day"):
        return self.to_frame().resample(rule, closed=closed, label=label, level=level, origin=origin)[self.name]

    def swaplevel(self, i=-2, j=-1):
        return self._via("swaplevel", i, j)

    def reorder_levels(self, order, axis=0):
        return self._via("reorder_levels", order)

    def droplevel(self, level, axis=0):
        return self._via("droplevel", level)

    # accessors ---------------------------------------------------------------
    @property
    def str(self):
        from .accessors import StringMethods

        return StringMethods(self)

    @property
    def dt(self):
        from .accessors import DatetimeMethods

        return DatetimeMethods(self)

    @property
    def list(self):
        from .accessors import ListMethods

        return ListMethods(self)

    @property
    def struct(self):
        from .accessors import StructMethods

        return StructMethods(self)

    @property
    def geo(self):
        from .accessors import GeoMethods

        return GeoMethods(self)

    @property
    def blob(self):
        from .accessors import BlobMethods

        return BlobMethods(self)

    @property
    def plot(self):
        from .accessors import Plot

        return Plot(self)

    def __repr__(self) -> str:
        return repr(self.peek(10))


for _name in ("sum", "mean", "min", "max", "std", "var", "count", "prod", "product", "all", "any", "skew", "kurt", "kurtosis"):
    setattr(Series, _name, lambda self, *_, n=_name, **__: self.agg(n))


@_install_operators
class DataFrame(Common):
    def __init__(self, rows: Rows, columns: list[tuple[object, Column]]):
        self.__dict__.update(rows=rows, _columns=list(columns))

    @classmethod
    def from_spark(cls, sdf: SparkFrame, index=None, order=None) -> DataFrame:
        """A frame over a Spark DataFrame; ``index`` and ``order`` name columns of it."""
        index = [] if index is None else listed(index)
        rows = Rows(sdf, index, list(index), [(c, True) for c in (listed(order) if order is not None else index)])
        return cls(rows, [(c, F.col(f"`{c}`")) for c in sdf.columns if c not in index])

    from_dict = classmethod(lambda cls, data, orient="columns", dtype=None, columns=None, session=None: _local(pd.DataFrame.from_dict(data, orient=orient, dtype=dtype, columns=columns), session))
    from_records = classmethod(lambda cls, data, session=None, **kw: _local(pd.DataFrame.from_records(data, **kw), session))

    # plumbing ------------------------------------------------------------------
    @property
    def columns(self) -> pd.Index:
        return pd.Index([label for label, _ in self._columns])

    @columns.setter
    def columns(self, labels):
        self.__dict__["_columns"] = [(new, e) for new, (_, e) in zip(labels, self._columns, strict=True)]

    def _series(self) -> list[Series]:
        return [Series(self.rows, e, label) for label, e in self._columns]

    def _new(self, columns) -> DataFrame:
        return DataFrame(self.rows, columns)

    def _each(self, f: Callable[[Series], Series | Column]) -> DataFrame:
        out = []
        for s in self._series():
            got = f(s)
            out.append((s.name, got.expr if isinstance(got, Series) else got))
        return self._new(out)

    def _stored(self) -> DataFrame:
        names = self.rows.put(*(e for _, e in self._columns)) if self._columns else []
        return self._new([(label, F.col(n)) for (label, _), n in zip(self._columns, names)])

    def _flat(self) -> tuple[SparkFrame, list[str]]:
        """Only index, order and values, the values as plain columns."""
        names = [fresh() for _ in self._columns]
        keep = dict.fromkeys([*self.rows.index, *(c for c, _ in self.rows.order)])
        return self.rows.sdf.select(*(F.col(c) for c in keep), *(e.alias(n) for (_, e), n in zip(self._columns, names))), names

    def _filtered(self, cond: Column) -> DataFrame:
        return DataFrame(self._taken(self.rows.sdf.where(cond)), self._columns)

    def _column(self, label) -> Column:
        found = [e for n, e in self._columns if n == label]
        if not found:
            raise KeyError(label)
        return found[0]

    def iloc_column(self, k: int) -> Series:
        return self._series()[k]

    def to_spark(self, index: bool = False, ordered: bool = False) -> SparkFrame:
        sdf = self.rows.sdf
        if ordered and (self.rows.order or self.rows.index):
            sdf = sdf.orderBy(*self.rows.sort_columns())
        taken = [F.col(c).alias(str(n) if n is not None else f"index_{k}" if len(self.rows.index) > 1 else "index") for k, (c, n) in enumerate(zip(self.rows.index, self.rows.names))] if index else []
        return sdf.select(*taken, *(e.alias(n if isinstance(n, str) else "_".join(map(str, n)) if isinstance(n, tuple) else str(n)) for n, e in self._columns))

    @property
    def sql(self) -> str:
        return self.to_spark()._jdf.queryExecution().optimizedPlan().toString()

    def to_pandas(self, ordered: bool = True, max_download_size: int | None = None, sampling_method: str | None = None, random_state=None, **_) -> pd.DataFrame:
        from ..operators.transfer import fetched

        sdf, names = self._flat()
        if max_download_size is not None:
            sdf = fitting(sdf, max_download_size << 20, sampling_method, random_state)
        if ordered and self.rows.order:
            self_order = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in self.rows.order]
            sdf = sdf.orderBy(*self_order)
        out = fetched(sdf.select(*(F.col(c).alias(f"__i{k}") for k, c in enumerate(self.rows.index)), *names))
        if self.rows.index:
            out = out.set_index([f"__i{k}" for k in range(len(self.rows.index))])
            out.index.names = self.rows.names
        out.columns = self.columns
        return out

    @property
    def dtypes(self) -> pd.Series:
        return pd.Series({s.name: s.dtype for s in self._series()})

    @property
    def shape(self):
        return len(self), len(self._columns)

    @property
    def size(self):
        return len(self) * len(self._columns)

    ndim = 2

    @property
    def axes(self):
        return [self.index, self.columns]

    def keys(self):
        return self.columns

    def __iter__(self):
        return iter(self.columns)

    def __contains__(self, key):
        return key in self.columns

    def items(self):
        return ((s.name, s) for s in self._series())

    def iterrows(self):
        for page in self.to_pandas_batches():
            yield from page.iterrows()

    def itertuples(self, index=True, name="Pandas"):
        for page in self.to_pandas_batches():
            yield from page.itertuples(index=index, name=name)

    def memory_usage(self, index=True):
        width = {T.BooleanType: 1, T.DateType: 4}
        n = len(self)
        return pd.Series({s.name: n * width.get(type(s.dtype), 8) for s in self._series()})

    def info(self, **_):
        lines = [f"{len(self)} rows", *(f"{s.name}: {s.dtype.simpleString()}" for s in self._series())]
        print("\n".join(lines))

    def __repr__(self):
        return repr(self.peek(10))

    def select_dtypes(self, include=None, exclude=None):
        kinds = {"number": lambda v: v.is_number, "bool": lambda v: v.is_bool, "string": lambda v: v.is_string, "object": lambda v: v.is_string, "datetime": lambda v: v.is_time}
        has = lambda v, names: any(kinds[n](v) if n in kinds else v.type == logic.type_of(n) for n in listed(names))
        return self._new([(s.name, s.expr) for s in self._series() if (include is None or has(s.v, include)) and (exclude is None or not has(s.v, exclude))])

    # columns ---------------------------------------------------------------------
    def __getitem__(self, key):
        if isinstance(key, Series):
            if key.rows is self.rows:
                return self._filtered(key.expr)
            c = self.assign(**{"__cond": key})
            return c[c["__cond"]].drop(columns="__cond")
        if isinstance(key, slice):
            return self.iloc[key]
        if isinstance(key, (list, pd.Index)):
            return self._new([(k, self._column(k)) for k in key])
        return Series(self.rows, self._column(key), key)

    def __getattr__(self, key):
        if key.startswith("_"):
            raise AttributeError(key)
        try:
            return self[key]
        except KeyError:
            raise AttributeError(key) from None

    def __setattr__(self, key, value):
        if isinstance(getattr(type(self), key, None), property):
            object.__setattr__(self, key, value)
        else:
            self[key] = value

    def __setitem__(self, key, value):
        out = self.assign(**{key: value}) if isinstance(key, str) else self._assigned({key: value})
        self.__dict__.update(rows=out.rows, _columns=out._columns)

    def __delitem__(self, key):
        self.__dict__["_columns"] = self.drop(columns=key)._columns

    def get(self, key, default=None):
        return self[key] if key in self else default

    def assign(self, **values) -> DataFrame:
        return self._assigned(values)

    def _assigned(self, values: Mapping) -> DataFrame:
        out = self
        for label, value in values.items():
            if callable(value) and not isinstance(value, (Series, Deferred)):
                value = value(out)
            if isinstance(value, Deferred):
                value = value.bind(out)
            if isinstance(value, Series) and value.rows is not out.rows:
                flat = out._stored()
                side = value.rows.put(value.expr)[0]
                rows, la, lb = joined(flat, value, "left")
                out = DataFrame(rows, [(n, F.col(la[c])) for (n, e), c in zip(flat._columns, flat.rows.sdf.columns[-len(flat._columns) :])])
                expr = F.col(lb[side])
            else:
                expr = value.expr if isinstance(value, Series) else literal(value).col
            known = [n for n, _ in out._columns]
            out = out._new([(n, expr if n == label else e) for n, e in out._columns] + ([] if label in known else [(label, expr)]))
        return out

    def insert(self, loc, column, value, allow_duplicates=False):
        out = self._assigned({column: value})
        cols = [c for c in out._columns if c[0] != column]
        cols.insert(loc, next(c for c in out._columns if c[0] == column))
        self.__dict__.update(rows=out.rows, _columns=cols)

    def drop(self, labels=None, axis=0, index=None, columns=None, level=None, inplace=False):
        if labels is not None:
            index, columns = (labels, columns) if axis in (0, "index") else (index, labels)
        out = self
        if columns is not None:
            gone = set(listed(columns))
            if missing := gone - set(self.columns):
                raise KeyError(missing)
            out = out._new([c for c in out._columns if c[0] not in gone])
        if index is not None:
            at = out.rows.index[out._level(level) if level is not None else 0]
            keys = index.to_list() if isinstance(index, Index) else listed(index)
            out = out._filtered(~logic.isin(out.rows.value(F.col(at)), keys))
        return out

    def rename(self, columns=None, **_):
        f = columns if callable(columns) else lambda n: columns.get(n, n)
        return self._new([(f(n), e) for n, e in self._columns])

    def add_prefix(self, prefix, axis=None):
        return self.rename(columns=lambda n: f"{prefix}{n}")

    def add_suffix(self, suffix, axis=None):
        return self.rename(columns=lambda n: f"{n}{suffix}")

    def filter(self, items=None, like=None, regex=None, axis=1):
        test = (lambda n: n in items) if items is not None else (lambda n: like in str(n)) if like is not None else (lambda n: re.search(regex, str(n)))
        if axis in (1, "columns", None):
            return self._new([c for c in self._columns if test(c[0])])
        i = F.col(self.rows.index[0])
        return self._filtered(logic.isin(self.rows.value(i), items) if items is not None else i.cast("string").contains(like) if like is not None else i.cast("string").rlike(regex))

    def astype(self, dtype, errors="raise"):
        return self._each(lambda s: s.astype(dtype[s.name], errors) if isinstance(dtype, Mapping) and s.name in dtype else s if isinstance(dtype, Mapping) else s.astype(dtype, errors))

    # element-wise ------------------------------------------------------------------
    def _map_unary(self, name):
        return self._each(lambda s: s._map_unary(name))

    def _binary(self, name, other, flip=False):
        if is_scalar(other):
            return self._each(lambda s: s._binary(name, other, flip))
        if isinstance(other, DataFrame):
            labels = list(dict.fromkeys([*self.columns, *other.columns]))
            if other.rows is not self.rows:
                a, b = self._stored(), other._stored()
                rows, la, lb = joined(a, b)
                ca, cb = a.rows.sdf.columns[-len(a._columns) :], b.rows.sdf.columns[-len(b._columns) :]
                left, right = {n: F.col(la[c]) for n, c in zip(a.columns, ca)}, {n: F.col(lb[c]) for n, c in zip(b.columns, cb)}
            else:
                rows, left, right = self.rows, dict(self._columns), dict(other._columns)
            out = []
            for n in labels:
                if n in left and n in right:
                    x, y = rows.value(left[n]), rows.value(right[n])
                    out.append((n, BINARY[name](*((y, x) if flip else (x, y)))))
                else:
                    out.append((n, F.lit(None).cast("double")))
            return DataFrame(rows, out)
        if isinstance(other, Series):
            if other.rows is self.rows:
                return self._each(lambda s: s._binary(name, other, flip))
            joined_ = self.assign(__other=other)
            o = joined_["__other"]
            return joined_.drop(columns="__other")._each(lambda s: s._binary(name, o, flip))
        values = other.to_dict() if isinstance(other, pd.Series) else dict(zip(self.columns, other))
        return self._each(lambda s: s._binary(name, values[s.name], flip))

    def round(self, decimals=0):
        return self._each(lambda s: s if not s.v.is_number or isinstance(decimals, Mapping) and s.name not in decimals else s.round(decimals[s.name] if isinstance(decimals, Mapping) else decimals))

    def fillna(self, value):
        return self._each(lambda s: s.fillna(value[s.name]) if isinstance(value, Mapping) and s.name in value else s if isinstance(value, Mapping) or s.v.is_string != isinstance(value, str) else s.fillna(value))

    def replace(self, to_replace=None, value=None, regex=False):
        return self._each(lambda s: s.replace(to_replace, value, regex) if s.v.is_string == isinstance(listed(list(to_replace) if isinstance(to_replace, Mapping) else to_replace)[0], str) else s)

    def isin(self, values):
        return self._each(lambda s: s.isin(values[s.name]) if isinstance(values, Mapping) and s.name in values else s._new(F.lit(False)) if isinstance(values, Mapping) else s.isin(values))

    def where(self, cond, other=None):
        cond = cond(self) if callable(cond) else cond
        pick = lambda o, n: o[n] if isinstance(o, DataFrame) else o
        return self._each(lambda s: s.where(pick(cond, s.name), pick(other, s.name)))

    def mask(self, cond, other=None):
        return self.where(~(cond(self) if callable(cond) else cond), other)

    def map(self, func, na_action=None):
        return self._each(lambda s: s.map(func, na_action))

    applymap = map

    def apply(self, func, axis=0, args=(), **kwargs):
        if axis in (1, "columns"):
            from ..sources.functions import row_udf

            return Series(self.rows, row_udf(func, self, args), None)
        out = {s.name: func(s, *args, **kwargs) for s in self._series()}
        return self._new([(n, s.expr) for n, s in out.items()]) if all(isinstance(s, Series) for s in out.values()) else pd.Series(out)

    def combine(self, other, func, fill_value=None, overwrite=True, how="outer"):
        a, b = self.align(other)
        shared = [n for n in a.columns]
        fill = (lambda s: s) if fill_value is None else (lambda s: s.fillna(fill_value))
        return a._new([(n, func(fill(a[n]), fill(b[n])).expr) for n in shared])

    def combine_first(self, other):
        a, b = self.align(other)
        return a._new([(n, logic.fillna(a[n].v, b[n].v)) for n in a.columns])

    def update(self, other, join="left", overwrite=True, filter_func=None):
        a, b = self.align(other, join="left")
        pick = lambda n: (b[n].combine_first(a[n]) if overwrite else a[n].combine_first(b[n])).expr
        out = a._new([(n, pick(n) if n in other.columns else a._column(n)) for n in self.columns])
        self.__dict__.update(rows=out.rows, _columns=out._columns)

    def align(self, other, join="outer", axis=None):
        """Both frames over the same rows, with all columns."""
        labels = list(dict.fromkeys([*self.columns, *other.columns])) if join != "inner" else [n for n in self.columns if n in other.columns]
        if other.rows is self.rows:
            rows, left, right = self.rows, dict(self._columns), dict(other._columns)
        else:
            a, b = self._stored(), other._stored()
            rows, la, lb = joined(a, b, join)
            left = {n: F.col(la[c]) for n, c in zip(a.columns, a.rows.sdf.columns[-len(a._columns) :])}
            right = {n: F.col(lb[c]) for n, c in zip(b.columns, b.rows.sdf.columns[-len(b._columns) :])}
        kind = lambda n: rows.value(left.get(n, right.get(n))).type
        side = lambda d: DataFrame(rows, [(n, d[n] if n in d else F.lit(None).cast(kind(n))) for n in labels])
        return side(left), side(right)

    # rows ------------------------------------------------------------------------------
    @property
    def loc(self):
        return Loc(self)

    @property
    def iloc(self):
        return ILoc(self)

    @property
    def at(self):
        return Loc(self)

    @property
    def iat(self):
        return ILoc(self)

    def query(self, expr: str) -> DataFrame:
        from .expressions import evaluate

        return self[evaluate(self, expr)]

    def eval(self, expr: str):
        from .expressions import evaluate

        return evaluate(self, expr)

    def head(self, n: int = 5) -> DataFrame:
        self.rows.total_order()
        if n < 0:
            return self.iloc[:n]
        sdf = self.rows.sdf.orderBy(*self.rows.sort_columns()).limit(n)
        return DataFrame(self._taken(sdf), self._columns)

    def tail(self, n: int = 5) -> DataFrame:
        if n < 0:
            return self.iloc[-n:]
        sdf = self.rows.sdf.orderBy(*self.rows.sort_columns(reverse=True)).limit(n)
        return DataFrame(self._taken(sdf), self._columns)

    def peek(self, n: int = 5, **_) -> pd.DataFrame:
        return DataFrame(self._taken(self.rows.sdf.limit(n)), self._columns).to_pandas()

    def take(self, indices, axis=0, **_):
        if axis in (1, "columns"):
            return self._new([self._columns[k] for k in indices])
        pos = F.col(self.rows.offset())
        n = len(self) if any(k < 0 for k in indices) else 0
        return self._filtered(pos.isin([k if k >= 0 else n + k for k in indices]))

    def sort_values(self, by, inplace=False, ascending=True, kind=None, na_position="last"):
        by = listed(by)
        ups = listed(ascending) * (len(by) if not isinstance(ascending, (list, tuple)) else 1)
        keys, order = [], []
        for label, up in zip(by, ups):
            e = self._column(label)
            if na_position == "first":
                keys.append(e.isNotNull())
                order.append(True)
            keys.append(e)
            order.append(up)
        names = self.rows.put(*keys)
        base = self.rows.order
        return DataFrame(Rows(self.rows.sdf, self.rows.index, self.rows.names, [*zip(names, order), *base]), self._columns)

    def sort_index(self, axis=0, ascending=True, inplace=False, na_position="last"):
        if axis in (1, "columns"):
            return self._new(sorted(self._columns, key=lambda c: c[0], reverse=not ascending))
        keys = []
        for i in self.rows.index:
            if na_position == "first":
                keys.append((self.rows.put(F.col(i).isNotNull())[0], True))
            keys.append((i, ascending))
        return DataFrame(Rows(self.rows.sdf, self.rows.index, self.rows.names, [*keys, *self.rows.order]), self._columns)

    def nlargest(self, n, columns, keep="first"):
        return self._top(n, columns, keep, False)

    def nsmallest(self, n, columns, keep="first"):
        return self._top(n, columns, keep, True)

    def _top(self, n, columns, keep, up):
        columns = listed(columns)
        kept = self.dropna(subset=columns)
        if keep == "all":
            keys = [kept._column(c).asc() if up else kept._column(c).desc() for c in columns]
            edge = kept.rows.sdf.orderBy(*keys).limit(n).agg((F.max if up else F.min)(kept._column(columns[0]))).first()[0]
            return kept[kept[columns[0]]._binary("le" if up else "ge", edge)].sort_values(columns, ascending=up) if edge is not None else kept
        if keep == "last":
            rows = kept.rows
            rows.total_order()
            kept = DataFrame(Rows(rows.sdf, rows.index, rows.names, [(c, not u) for c, u in rows.order]), kept._columns)
        return kept.sort_values(columns, ascending=up).head(n)

    def dropna(self, axis=0, how="any", thresh=None, subset=None, inplace=False, ignore_index=False):
        cols = [s for s in self._series() if subset is None or s.name in listed(subset)]
        if axis in (1, "columns"):
            counts = self.rows.sdf.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(~logic.isnull(s.v), 1)).alias(f"c{k}") for k, s in enumerate(cols))).first()
            keep = {s.name for k, s in enumerate(cols) if (counts[f"c{k}"] >= thresh if thresh is not None else counts[f"c{k}"] == counts["n"] if how == "any" else counts[f"c{k}"] > 0)}
            return self._new([c for c in self._columns if c[0] in keep])
        flags = [(~logic.isnull(s.v)).cast("int") for s in cols]
        total = functools.reduce(lambda a, b: a + b, flags, F.lit(0))
        out = self._filtered(total >= (thresh if thresh is not None else len(cols) if how == "any" else 1))
        return out.reset_index(drop=True) if ignore_index else out

    def duplicated(self, subset=None, keep="first"):
        flat = self if subset is None else self[listed(subset)]
        by = [e for _, e in flat._columns]
        if keep is False:
            return Series(self.rows, F.col(self.rows.put(F.count(F.lit(1)).over(Window.partitionBy(*by)) > 1)[0]))
        w = self.rows.window(by, reverse=keep == "last")
        return Series(self.rows, F.col(self.rows.put(F.row_number().over(w) > 1)[0]))

    def drop_duplicates(self, subset=None, keep="first"):
        return self[~self.duplicated(subset, keep)]

    def sample(self, n=None, frac=None, random_state=None, sort="random"):
        """``n`` rows, or about ``frac`` of them, by a seeded hash of the row."""
        seed = 0 if random_state is None else random_state
        if frac is not None:
            return DataFrame(self._taken(self.rows.sdf.sample(fraction=frac, seed=seed)), self._columns)
        key = F.xxhash64(F.lit(seed), *(F.col(c) for c in self.rows.total_order()))
        sdf = self.rows.sdf.orderBy(key).limit(1 if n is None else n)
        return DataFrame(self._taken(sdf), self._columns)

    def explode(self, column, ignore_index=False):
        from ..operators.reshape import explode

        return explode(self, listed(column), ignore_index)

    # index ---------------------------------------------------------------------------------
    def _level(self, level) -> int:
        return self.rows.names.index(level) if level in self.rows.names else level

    def set_index(self, keys, append=False, drop=True):
        keys = listed(keys)
        names = self.rows.put(*(k.expr if isinstance(k, Series) else self._column(k) for k in keys))
        labels = [k.name if isinstance(k, Series) else k for k in keys]
        index, shown = (self.rows.index + names, self.rows.names + labels) if append else (names, labels)
        return DataFrame(Rows(self.rows.sdf, index, shown, self.rows.order), [c for c in self._columns if not drop or c[0] not in labels])

    def reset_index(self, level=None, drop=False, inplace=False, names=None, **_):
        """Index levels become columns; without ``level`` positions become the index once they are asked for."""
        levels = list(range(len(self.rows.index))) if level is None else [self._level(x) for x in listed(level)]
        shown = listed(names) if names is not None else [self.rows.names[k] if self.rows.names[k] is not None else ("index" if len(self.rows.index) == 1 else f"level_{k}") for k in levels]
        new = [] if drop else [(n, F.col(self.rows.index[k])) for k, n in zip(levels, shown)]
        rest = [k for k in range(len(self.rows.index)) if k not in levels]
        rows = Rows(self.rows.sdf, [self.rows.index[k] for k in rest], [self.rows.names[k] for k in rest], self.rows.order)
        return DataFrame(rows, new + self._columns)

    def with_positions(self) -> DataFrame:
        """The same frame, with 0-based positions as its index."""
        pos = self.rows.offset()
        return DataFrame(Rows(self.rows.sdf, [pos], [None], [(pos, True)]), self._columns)

    def rename_axis(self, mapper=None, **_):
        return DataFrame(Rows(self.rows.sdf, self.rows.index, listed(mapper), self.rows.order), self._columns)

    def reorder_levels(self, order, axis=0):
        ks = [self._level(x) for x in order]
        return DataFrame(Rows(self.rows.sdf, [self.rows.index[k] for k in ks], [self.rows.names[k] for k in ks], self.rows.order), self._columns)

    def swaplevel(self, i=-2, j=-1, axis=0):
        ks = list(range(len(self.rows.index)))
        i, j = self._level(i), self._level(j)
        ks[i], ks[j] = ks[j], ks[i]
        return self.reorder_levels([self.rows.names[k] if self.rows.names[k] is not None else k for k in ks])

    def droplevel(self, level, axis=0):
        gone = {self._level(x) % len(self.rows.index) for x in listed(level)}
        ks = [k for k in range(len(self.rows.index)) if k not in gone]
        return DataFrame(Rows(self.rows.sdf, [self.rows.index[k] for k in ks], [self.rows.names[k] for k in ks], self.rows.order), self._columns)

    def reindex(self, labels=None, index=None, columns=None, axis=0, validate=None):
        if axis in (1, "columns"):
            columns, labels = labels, None
        out = self
        if columns is not None:
            out = out._new([(n, out._column(n) if n in out else F.lit(None).cast("double")) for n in columns])
        index = labels if index is None else index
        if index is not None:
            from ..operators.relational import reindex

            out = reindex(out, index)
        return out

    def reindex_like(self, other, validate=None):
        return self.reindex(index=other.index, columns=list(other.columns))

    def equals(self, other) -> bool:
        """Same columns and the same multiset of rows with the same index."""
        if list(self.columns) != list(other.columns) or [str(t) for t in self.dtypes] != [str(t) for t in other.dtypes]:
            return False
        a = self._plain()
        both = a.withColumn("__n", F.lit(1)).unionAll(other._plain().withColumn("__n", F.lit(-1)))
        return not both.groupBy(*a.columns).agg(F.sum("__n").alias("__n")).where("__n <> 0").limit(1).count()

    def _plain(self) -> SparkFrame:
        return self.rows.sdf.select(*(F.col(c).alias(f"i{k}") for k, c in enumerate(self.rows.index)), *(e.alias(f"c{k}") for k, (_, e) in enumerate(self._columns)))

    def first_valid_index(self):
        some = functools.reduce(lambda a, b: a | b, (~logic.isnull(s.v) for s in self._series()))
        row = self.rows.sdf.where(some).orderBy(*self.rows.sort_columns()).select(*self.rows.index).first()
        return None if row is None else row[0]

    # aggregates ----------------------------------------------------------------------------------
    def _numeric(self, only: bool) -> list[Series]:
        return [s for s in self._series() if not only or s.v.is_number or s.v.is_bool]

    def agg(self, func):
        """One row of aggregates as a series, or a frame with a row for each function."""
        if isinstance(func, (list, tuple)):
            rows = [(aggregates.by_name(f), self.agg(f)) for f in func]
            return pd.DataFrame({name: got for name, got in rows}).T
        if isinstance(func, Mapping):
            exprs = {(n, aggregates.by_name(f)): aggregates.aggregate(f, self[n].v) for n, fs in func.items() for f in listed(fs)}
            got = self.rows.sdf.agg(*(e.alias(f"a{k}") for k, e in enumerate(exprs.values()))).first()
            if all(not isinstance(fs, (list, tuple)) for fs in func.values()):
                return pd.Series({n: got[k] for k, (n, _) in enumerate(exprs)})
            out: dict = {}
            for k, (n, f) in enumerate(exprs):
                out.setdefault(n, {})[f] = got[k]
            return pd.DataFrame(out)
        return self._aggregate(lambda s: aggregates.aggregate(func, s.v), func in ("mean", "std", "var", "median"))

    aggregate = agg

    def _aggregate(self, f, numeric_only=False, axis=0):
        cols = self._numeric(numeric_only)
        if axis in (1, "columns"):
            return NotImplemented
        got = self.rows.sdf.agg(*(f(s).alias(f"a{k}") for k, s in enumerate(cols))).first()
        return pd.Series({s.name: got[k] for k, s in enumerate(cols)})

    def _row_wise(self, how: str) -> Series:
        """Aggregates along a row, as one expression over an array of its values."""
        values = F.array(*(number(s.v).cast("double") for s in self._numeric(how not in ("any", "all"))))
        expr = nested.array_reduce(values, how) if how not in ("std", "var", "prod", "median") else {
            "prod": F.aggregate(F.filter(values, lambda v: v.isNotNull()), F.lit(1.0), lambda a, v: a * v),
            "var": _array_var(values), "std": F.sqrt(_array_var(values)), "median": F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int")),
        }[how]
        return Series(self.rows, expr, None)

    def aggregate_frame(self, **named) -> SparkFrame:
        """A lazy one-row Spark DataFrame of named aggregates: name=(column, function)."""
        return self.rows.sdf.agg(*(aggregates.aggregate(f, self[c].v).alias(n) for n, (c, f) in named.items()))

    def quantile(self, q=0.5, numeric_only=False):
        if isinstance(q, (list, tuple)):
            return pd.DataFrame({x: self.quantile(x, numeric_only) for x in q}).T
        return self._aggregate(lambda s: aggregates.quantile(s.v, q), True)

    def median(self, numeric_only=False, exact=True):
        return self._aggregate(lambda s: aggregates.quantile(s.v, 0.5) if exact else aggregates.approx_quartile(s.v, 2), True)

    def nunique(self):
        return self._aggregate(lambda s: F.count_distinct(s.expr))

    def _pairs(self, f, other=None):
        cols = self._numeric(True)
        exprs = [f(number(a.v).cast("double"), number(b.v).cast("double")) for a in cols for b in cols]
        got = self.rows.sdf.agg(*(e.alias(f"p{k}") for k, e in enumerate(exprs))).first()
        n = len(cols)
        labels = [s.name for s in cols]
        return pd.DataFrame([[got[i * n + j] for j in range(n)] for i in range(n)], index=labels, columns=labels)

    def corr(self, method="pearson", min_periods=None, numeric_only=False):
        return self._pairs(F.corr)

    def cov(self, numeric_only=False):
        return self._pairs(F.covar_samp)

    def corrwith(self, other, numeric_only=False):
        a, b = self.align(other, "inner") if isinstance(other, DataFrame) else (self, None)
        if b is None:
            return pd.Series({s.name: s.corr(other) for s in self._numeric(True)})
        got = a.rows.sdf.agg(*(F.corr(number(a[n].v).cast("double"), number(b[n].v).cast("double")).alias(f"x{k}") for k, n in enumerate(a.columns))).first()
        return pd.Series(dict(zip(a.columns, got)))

    def idxmin(self):
        return pd.Series({s.name: s.idxmin() for s in self._numeric(True)})

    def idxmax(self):
        return pd.Series({s.name: s.idxmax() for s in self._numeric(True)})

    def describe(self, include=None):
        from ..operators.reshape import describe

        return describe(self, include)

    def value_counts(self, subset=None, normalize=False, sort=True, ascending=False, dropna=True):
        from ..operators.reshape import value_counts

        return value_counts(self, subset, normalize, sort, ascending, dropna)

    def dot(self, other):
        from ..operators.reshape import dot

        return dot(self, other)

    __matmul__ = dot

    # windows -----------------------------------------------------------------------------------------
    def _window_each(self, verb: str, *args, **kwargs) -> DataFrame:
        out = self
        cols = []
        for s in out._series():
            got = getattr(s, verb)(*args, **kwargs)
            cols.append((s.name, got))
        if all(g.rows is self.rows for _, g in cols):
            return self._new([(n, g.expr) for n, g in cols])
        return functools.reduce(lambda d, c: d._assigned({c[0]: c[1]}), cols[1:], cols[0][1].to_frame(cols[0][0]))

    def rolling(self, window, min_periods=None, on=None, closed="right"):
        from ..operators.windows import Rolling

        return Rolling(self, window, min_periods, closed, on=on)

    def expanding(self, min_periods=1):
        from ..operators.windows import Rolling

        return Rolling(self, None, min_periods, "right")

    # shape ------------------------------------------------------------------------------------------------
    def groupby(self, by=None, level=None, as_index=True, dropna=True):
        from ..operators.grouping import GroupBy

        if level is not None:
            ks = [self._level(x) for x in listed(level)]
            keys = [(self.rows.names[k], F.col(self.rows.index[k])) for k in ks]
        else:
            keys = [(b.name, b.expr) if isinstance(b, Series) else (b, self._column(b)) for b in listed(by)]
        return GroupBy(self, keys, as_index, dropna)

    def merge(self, right, how="inner", on=None, left_on=None, right_on=None, left_index=False, right_index=False, sort=False, suffixes=("_x", "_y")):
        from ..operators.relational import merge

        return merge(self, right, how, on, left_on, right_on, left_index, right_index, sort, suffixes)

    def join(self, other, on=None, how="left", lsuffix="", rsuffix=""):
        from ..operators.relational import join

        return join(self, other.to_frame() if isinstance(other, Series) else other, on, how, lsuffix, rsuffix)

    def melt(self, id_vars=None, value_vars=None, var_name="variable", value_name="value"):
        from ..operators.reshape import melt

        return melt(self, id_vars, value_vars, var_name, value_name)

    def pivot(self, *, columns, index=None, values=None):
        from ..operators.reshape import pivot

        return pivot(self, columns, index, values, "any_value")

    def pivot_table(self, values=None, index=None, columns=None, aggfunc="mean", fill_value=None, **_):
        from ..operators.reshape import pivot

        out = pivot(self, columns, index, values, aggfunc)
        return out.fillna(fill_value) if fill_value is not None else out

    def stack(self, level=-1):
        from ..operators.reshape import stack

        return stack(self)

    def unstack(self, level=-1):
        from ..operators.reshape import unstack

        return unstack(self, level)

    def transpose(self):
        from ..operators.reshape import transpose

        return transpose(self)

    @property
    def T(self):
        return self.transpose()

    def resample(self, rule, closed=None, label=None, on=None, level=None, origin="start_day"):
        from ..operators.grouping import resample

        return resample(self, rule, on, level, origin, closed, label)

    # sinks, accessors ----------------------------------------------------------------------------------------
    def to_dict(self, orient="dict", into=dict, **_):
        return self.to_pandas().to_dict(orient=orient, into=into)

    def to_records(self, **_):
        return self.to_pandas().to_records()

    def __dataframe__(self, nan_as_null=False, allow_copy=True):
        return self.to_pandas().__dataframe__(nan_as_null, allow_copy)

    @property
    def struct(self):
        from .accessors import StructFrame

        return StructFrame(self)

    @property
    def ai(self):
        from ..ai import AIAccessor

        return AIAccessor(self)

    @property
    def semantics(self):
        from ..ai import Semantics

        return Semantics(self)

    @property
    def plot(self):
        from .accessors import Plot

        return Plot(self)


def fitting(sdf: SparkFrame, most: int, method: str | None, seed: int | None) -> SparkFrame:
    """All rows if they take ``most`` bytes at most; else a uniform sample or the head, or an error if no method is given."""
    n, width = sdf.select(F.count(F.lit(1)), F.coalesce(F.avg(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()
    if n * width <= most:
        return sdf
    if method is None:
        raise ValueError(f"about {int(n * width)} bytes are over the limit of {most}; give a sampling_method")
    share = most / (n * width)
    return sdf.limit(max(1, int(n * share))) if method == "head" else sdf.sample(fraction=share, seed=seed or 0)


def _array_var(values: Column) -> Column:
    kept = F.filter(values, lambda v: v.isNotNull())
    n = F.size(kept)
    mean = F.aggregate(kept, F.lit(0.0), lambda a, v: a + v) / F.nullif(n, F.lit(0))
    return F.aggregate(kept, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / F.nullif(n - 1, F.lit(0))


for _name in ("sum", "mean", "min", "max", "std", "var", "count", "prod", "product", "all", "any", "skew", "kurt", "kurtosis"):

    def _agg(self, axis=0, numeric_only=False, *_, n=_name, **__):
        if axis in (1, "columns"):
            return self._row_wise({"product": "prod"}.get(n, n))
        return self._aggregate(lambda s: aggregates.aggregate(n, s.v), numeric_only or n in ("mean", "std", "var", "skew", "kurt", "kurtosis", "sum", "prod", "product"))

    setattr(DataFrame, _name, _agg)

for _name in ("cumsum", "cumprod", "cummin", "cummax", "shift", "diff", "pct_change", "ffill", "bfill", "interpolate"):
    setattr(DataFrame, _name, lambda self, *a, n=_name, **k: self._window_each(n, *a, **k))
for _name in ("hist", "line", "area", "bar"):
    setattr(Series, _name, lambda self, *a, n=_name, **k: getattr(self.plot, n)(*a, **k))
for _name in ("hist", "line", "area", "bar", "scatter"):
    setattr(DataFrame, _name, lambda self, *a, n=_name, **k: getattr(self.plot, n)(*a, **k))
DataFrame.rank = lambda self, axis=0, method="average", numeric_only=False, na_option="keep", ascending=True, pct=False: self._window_each("rank", axis, method, numeric_only, na_option, ascending, pct)


class Index(Common):
    """The labels of rows; each verb works on the first level unless it names one."""

    ndim = 1
    shape = property(lambda self: (len(self),))
    size = property(lambda self: len(self))
    T = property(lambda self: self)

    def transpose(self):
        return self

    def __init__(self, rows: Rows):
        self.rows = rows

    @property
    def names(self):
        return self.rows.names

    @property
    def name(self):
        return self.rows.names[0] if len(self.rows.names) == 1 else None

    @property
    def nlevels(self) -> int:
        return len(self.rows.index)

    def to_series(self, index=None, name=None) -> Series:
        return Series(self.rows, F.col(self.rows.index[0]), name if name is not None else self.name)

    def get_level_values(self, level):
        k = self.rows.names.index(level) if level in self.rows.names else level
        return Index(Rows(self.rows.sdf, [self.rows.index[k]], [self.rows.names[k]], self.rows.order))

    def to_frame(self) -> DataFrame:
        return DataFrame(self.rows, [(n if n is not None else k, F.col(c)) for k, (c, n) in enumerate(zip(self.rows.index, self.rows.names))])

    @classmethod
    def from_frame(cls, frame) -> Index:
        return frame.set_index(list(frame.columns)).index

    def to_pandas(self, **_):
        out = self.to_frame().reset_index(drop=True)
        values = out.to_pandas()
        return pd.Index(values.iloc[:, 0], name=self.name) if self.nlevels == 1 else pd.MultiIndex.from_frame(values)

    def to_list(self, **_):
        return self.to_pandas().to_list()

    tolist = to_list

    @property
    def values(self):
        return self.to_pandas().to_numpy()

    @property
    def dtype(self):
        return self.to_series().dtype

    @property
    def dtypes(self):
        return self.to_frame().dtypes

    @property
    def is_unique(self) -> bool:
        return not self.has_duplicates

    @property
    def has_duplicates(self) -> bool:
        return bool(self.rows.sdf.groupBy(*self.rows.index).count().where("count > 1").limit(1).count())

    def __contains__(self, key) -> bool:
        keys = key if isinstance(key, tuple) else (key,)
        cond = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(literal(k).col) for c, k in zip(self.rows.index, keys)))
        return bool(self.rows.sdf.where(cond).limit(1).count())

    def get_loc(self, key):
        pos = self.rows.offset()
        got = [r[0] for r in self.rows.sdf.where(F.col(self.rows.index[0]) == literal(key).col).orderBy(pos).select(pos).limit(2).collect()]
        if not got:
            raise KeyError(key)
        return got[0]

    def rename(self, name, inplace=False):
        return Index(Rows(self.rows.sdf, self.rows.index, listed(name), self.rows.order))

    def _of(self, s: Series) -> Index:
        name = s.rows.put(s.expr)[0]
        return Index(Rows(s.rows.sdf, [name], [self.name], s.rows.order))

    def __getattr__(self, verb):
        if verb.startswith("_") or verb == "rows":
            raise AttributeError(verb)
        if verb in ("year", "month", "day", "dayofweek", "day_of_week", "weekday"):
            return self._of(getattr(self.to_series().dt, verb))
        target = getattr(self.to_series(), verb)
        if not callable(target):
            return target

        def call(*args, **kwargs):
            got = target(*args, **kwargs)
            return self._of(got) if isinstance(got, Series) and verb not in ("value_counts",) else got

        return call

    def __eq__(self, other):
        return self.to_series() == (other.to_series() if isinstance(other, Index) else other)

    __hash__ = object.__hash__

    def __getitem__(self, key):
        return self._of(self.to_series().iloc[key]) if isinstance(key, slice) else self.to_list()[key]

    def __repr__(self):
        return f"Index({self.to_series().peek(10).tolist()}, name={self.name!r})"


class MultiIndex(Index):
    @classmethod
    def from_tuples(cls, tuples, sortorder=None, names=None, session=None):
        return _local(pd.DataFrame(list(tuples), columns=names or None), session).pipe(Index.from_frame)

    @classmethod
    def from_arrays(cls, arrays, sortorder=None, names=None, session=None):
        return cls.from_tuples(zip(*arrays), names=names, session=session)


class Loc:
    """Selection by label."""

    def __init__(self, of):
        self.of = of

    def __getitem__(self, key):
        frame = self.of if isinstance(self.of, DataFrame) else self.of.to_frame("x")
        cols = None
        if isinstance(key, tuple) and isinstance(self.of, DataFrame) and len(frame.rows.index) < 2 or isinstance(key, tuple) and len(key) == 2 and isinstance(key[0], (slice, Series)):
            key, cols = key
        if isinstance(key, Series):
            out = frame[key]
        elif isinstance(key, slice):
            i = frame.rows.value(F.col(frame.rows.index[0]))
            cond = F.lit(True)
            if key.start is not None:
                cond = cond & logic.ge(i, literal(key.start))
            if key.stop is not None:
                cond = cond & logic.le(i, literal(key.stop))
            out = frame._filtered(cond)
        else:
            many = isinstance(key, (list, Index))
            keys = key.to_list() if isinstance(key, Index) else key if many else [key]
            if keys and isinstance(keys[0], tuple):
                cond = functools.reduce(lambda a, b: a | b, (functools.reduce(lambda a, b: a & b, (F.col(c) == literal(x).col for c, x in zip(frame.rows.index, k))) for k in keys))
            else:
                cond = logic.isin(frame.rows.value(F.col(frame.rows.index[0])), keys)
            out = frame._filtered(cond)
            if not many and (not isinstance(self.of, DataFrame) or isinstance(cols, str)):
                values = out["x" if not isinstance(self.of, DataFrame) else cols].tolist()
                if not values:
                    raise KeyError(key)
                return values[0] if len(values) == 1 else values
        if not isinstance(self.of, DataFrame):
            return out["x"].rename(self.of.name)
        return out if cols is None else out[list(out.columns)] if isinstance(cols, slice) else out[cols]

    def __setitem__(self, key, value):
        row, col = key if isinstance(key, tuple) else (key, None)
        frame = self.of
        cond = row if isinstance(row, Series) else Series(frame.rows, logic.isin(frame.rows.value(F.col(frame.rows.index[0])), listed(row)))
        old = frame[col] if col in frame else Series(frame.rows, F.lit(None))
        frame[col] = Series(frame.rows, logic.where(value.v if isinstance(value, Series) else literal(value), cond.v, old.v))


class ILoc:
    """Selection by position; positions come from a distributed numbering, prefixes and single rows near the start from a plain limit."""

    near = 1000

    def __init__(self, of):
        self.of = of

    def __getitem__(self, key):
        frame = self.of if isinstance(self.of, DataFrame) else self.of.to_frame("x")
        if isinstance(key, tuple):
            c = key[1]
            picked = [frame.columns[c]] if isinstance(c, int) else list(frame.columns[c])
            if isinstance(key[0], int) and isinstance(c, int) and 0 <= key[0] < self.near:
                return frame[picked].head(key[0] + 1).to_pandas().iloc[:, 0].tolist()[key[0]]
            out = ILoc(frame)[key[0]] if not isinstance(key[0], int) else ILoc(frame)[[key[0]]]
            return out[picked[0]].item() if isinstance(key[0], int) and isinstance(c, int) else out[picked[0]] if isinstance(c, int) else out[picked]
        if isinstance(key, int):
            got = (frame.head(key + 1).to_pandas().iloc[key:] if 0 <= key < self.near else frame.take([key]).to_pandas()).iloc[0]
            return got.iloc[0] if not isinstance(self.of, DataFrame) else got
        if isinstance(key, slice):
            start, stop, step = key.start, key.stop, key.step or 1
            if step == 1 and not start and stop is not None and stop >= 0:
                out = frame.head(stop)
            else:
                pos = F.col(frame.rows.offset())
                n = len(frame) if step < 0 or (start or 0) < 0 or (stop or 0) < 0 else None
                if n is not None:
                    start, stop, step = slice(start, stop, step).indices(n)
                start = start or 0
                cond = (pos >= start if step > 0 else pos <= start) & ((pos - start) % abs(step) == 0)
                if stop is not None:
                    cond = cond & (pos < stop if step > 0 else pos > stop)
                out = frame._filtered(cond)
                if step < 0:
                    out = DataFrame(Rows(out.rows.sdf, out.rows.index, out.rows.names, [(c, not u) for c, u in out.rows.order]), out._columns)
        else:
            out = frame.take(list(key))
        return out if isinstance(self.of, DataFrame) else out["x"].rename(self.of.name)


class Deferred:
    """An expression over a frame that is named later: ``col("a") + 1``."""

    def __init__(self, bind: Callable[[DataFrame], Series]):
        self.bind = bind

    def __getattr__(self, verb):
        if verb.startswith("__") and verb not in ("__getitem__",):
            raise AttributeError(verb)
        if verb in ("str", "dt"):
            return _DeferredAccessor(self, verb)
        return lambda *a, **k: Deferred(lambda frame: getattr(self.bind(frame), verb)(*a, **k))


class _DeferredAccessor:
    def __init__(self, of: Deferred, name: str):
        self.__dict__.update(of=of, name=name)

    def __getattr__(self, verb):
        def call(*a, **k):
            return Deferred(lambda frame: getattr(getattr(self.of.bind(frame), self.name), verb)(*a, **k))

        return call


for _n in ("add", "sub", "mul", "truediv", "floordiv", "mod", "pow", "eq", "ne", "lt", "le", "gt", "ge", "and", "or", "xor"):

    def _op(self, other, n=_n, flip=False):
        return Deferred(lambda frame: self.bind(frame)._binary(n, other.bind(frame) if isinstance(other, Deferred) else other, flip))

    setattr(Deferred, f"__{_n}__", _op)
    if _n not in ("eq", "ne", "lt", "le", "gt", "ge"):
        setattr(Deferred, f"__r{_n}__", functools.partialmethod(_op, flip=True))
Deferred.__hash__ = object.__hash__


def col(name) -> Deferred:
    return Deferred(lambda frame: frame[name])


def _local(data: pd.DataFrame, session=None) -> DataFrame:
    from ..sources.session import Session

    return (session or Session.active()).read_pandas(data)

