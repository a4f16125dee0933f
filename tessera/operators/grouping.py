"""Groups: aggregates by one hash aggregation, analytics by windows over the keys; resampling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import aggregates, datetimes
from ..functions.numeric import time_micros
from ..functions.typed import V, number
from ..plans.frame import DataFrame, Series, listed
from ..plans.rows import Rows, fresh
from .windows import Rolling, rank


class NamedAgg(tuple):
    def __new__(cls, column, aggfunc):
        return super().__new__(cls, (column, aggfunc))


class GroupBy:
    def __init__(self, frame: DataFrame, keys: list[tuple[object, Column]], as_index=True, dropna=True, selected=None, series=False, names=None):
        if dropna:
            cond = None
            for _, k in keys:
                cond = k.isNotNull() if cond is None else cond & k.isNotNull()
            frame = frame._filtered(cond)
        self.frame, self.keys, self.as_index, self.dropna, self.series, self.shown = frame, keys, as_index, dropna, series, names
        key_names = {n for n, _ in keys}
        self.selected = selected if selected is not None else [c for c in frame.columns if c not in key_names]

    def __getitem__(self, key):
        out = GroupBy.__new__(GroupBy)
        out.__dict__.update(self.__dict__)
        out.selected, out.series = listed(key), not isinstance(key, list)
        return out

    def __getattr__(self, key):
        if key.startswith("_") or key not in self.__dict__.get("selected", ()):
            raise AttributeError(key)
        return self[key]

    def _named(self, name, key=None):
        self.shown = name
        if key is not None:
            self.keys = [(key, self.keys[0][1])]
        return self

    def _by(self) -> list[Column]:
        return [e for _, e in self.keys]

    # aggregates ---------------------------------------------------------------
    def _result(self, named: list[tuple[object, Column]]) -> DataFrame:
        keys, cols = [fresh("k") for _ in self.keys], [fresh() for _ in named]
        sdf = self.frame.rows.sdf.groupBy(*(e.alias(k) for (_, e), k in zip(self.keys, keys))).agg(*(e.alias(c) for (_, e), c in zip(named, cols)))
        labels = [n for n, _ in self.keys]
        out = [(n, F.col(c)) for (n, _), c in zip(named, cols)]
        order = [(k, True) for k in keys]
        if not self.as_index:
            return DataFrame(Rows(sdf, [], [], order), [*((n, F.col(k)) for n, k in zip(labels, keys)), *out])
        return DataFrame(Rows(sdf, keys, labels, order), out)

    def _columns(self, numeric: bool) -> list[Series]:
        cols = [self.frame[n] for n in self.selected]
        return [s for s in cols if not numeric or s.v.is_number or s.v.is_bool]

    def agg(self, func=None, **named):
        if named:
            return self._result([(n, aggregates.aggregate(f, self.frame[c].v)) for n, (c, f) in named.items()])
        if isinstance(func, Mapping):
            many = any(isinstance(f, (list, tuple)) for f in func.values())
            return self._result([((c, aggregates.by_name(f)) if many else c, aggregates.aggregate(f, self.frame[c].v)) for c, fs in func.items() for f in listed(fs)])
        if isinstance(func, (list, tuple)):
            cols = self._columns(False)
            label = (lambda c, f: aggregates.by_name(f)) if self.series else (lambda c, f: (c, aggregates.by_name(f)))
            return self._result([(label(s.name, f), aggregates.aggregate(f, s.v)) for s in cols for f in func])
        return self._apply(lambda s: aggregates.aggregate(func, s.v), func in ("mean", "std", "var", "median", "skew", "kurt"))

    aggregate = agg

    def _apply(self, f, numeric=False):
        out = self._result([(s.name, f(s)) for s in self._columns(numeric and not self.series)])
        return out.iloc_column(len(out._columns) - 1).rename(self.shown if self.shown is not None else self.selected[0]) if self.series and self.as_index else out

    def size(self):
        out = self._result([("size", F.count(F.lit(1)))])
        return out["size"].rename(None) if self.as_index else out

    def quantile(self, q=0.5, numeric_only=False):
        return self._apply(lambda s: aggregates.quantile(s.v, q), True)

    def median(self, numeric_only=False, exact=True, **_):
        return self._apply(lambda s: aggregates.quantile(s.v, 0.5) if exact else aggregates.approx_quartile(s.v, 2), True)

    def nunique(self):
        return self._apply(lambda s: F.count_distinct(s.expr))

    def first(self, numeric_only=False, min_count=-1):
        return self._ends(F.min_by)

    def last(self, numeric_only=False, min_count=-1):
        return self._ends(F.max_by)

    def _ends(self, pick):
        """The first or last value that is not null, in row order."""
        order = F.struct(*(F.col(c) for c in self.frame.rows.total_order()))
        return self._apply(lambda s: pick(F.when(s.expr.isNotNull(), s.expr), F.when(s.expr.isNotNull(), order)))

    def corr(self, numeric_only=False):
        return self._pairs(F.corr)

    def cov(self, numeric_only=False):
        return self._pairs(F.covar_samp)

    def _pairs(self, f):
        """A column (a, b) for each pair of numeric columns."""
        cols = self._columns(True)
        return self._result([((a.name, b.name), f(number(a.v).cast("double"), number(b.v).cast("double"))) for a in cols for b in cols])

    def describe(self, include=None):
        parts = {"count": "count", "mean": "mean", "std": "std", "min": "min", "25%": "q1", "50%": "q2", "75%": "q3", "max": "max"}
        return self._result([((s.name, n), aggregates.aggregate(f, s.v)) for s in self._columns(True) for n, f in parts.items()])

    def value_counts(self, subset=None, normalize=False, sort=True, ascending=False, dropna=True):
        cols = [self.frame[n] for n in (listed(subset) if subset is not None else self.selected)]
        inner = GroupBy(self.frame, [*self.keys, *((s.name, s.expr) for s in cols)], True, dropna)
        out = inner.size().rename("count").to_frame()
        if normalize:
            from pyspark.sql import Window

            rows = out.rows
            total = F.sum(out._column("count")).over(Window.partitionBy(*rows.index[: len(self.keys)]))
            out = out._new([("proportion", out._column("count") / F.col(rows.put(total)[0]))])
        label = out.columns[0]
        if sort:
            rows = out.rows
            name = rows.put(out._column(label))[0]
            keys = [(c, True) for c in rows.index[: len(self.keys)]]
            out = DataFrame(Rows(rows.sdf, rows.index, rows.names, [*keys, (name, ascending), *rows.order]), out._columns)
        return out[label]

    # analytics -----------------------------------------------------------------------
    def _analytic(self, f) -> DataFrame | Series:
        out = [(s.name, f(s)) for s in self._columns(False)]
        cols = [(n, e.expr if isinstance(e, Series) else F.col(self.frame.rows.put(e)[0])) for n, e in out]
        frame = DataFrame(self.frame.rows, cols)
        return frame.iloc_column(0).rename(self.shown if self.shown is not None else self.selected[0]) if self.series else frame

    def _w(self):
        return self.frame.rows.window(self._by())

    def _cumulate(self, f):
        from pyspark.sql import Window

        w = self._w().rowsBetween(Window.unboundedPreceding, 0)
        return self._analytic(lambda s: F.when(s.expr.isNotNull(), f(number(s.v)).over(w)))

    def cumsum(self, *_, **__):
        return self._cumulate(F.sum)

    def cumprod(self, *_, **__):
        return self._cumulate(F.product)

    def cummin(self, *_, **__):
        return self._cumulate(F.min)

    def cummax(self, *_, **__):
        return self._cumulate(F.max)

    def cumcount(self, ascending=True):
        w = self.frame.rows.window(self._by(), reverse=not ascending)
        return Series(self.frame.rows, F.col(self.frame.rows.put(F.row_number().over(w) - 1)[0]).cast("bigint"), None)

    def shift(self, periods=1):
        w = self._w()
        return self._analytic(lambda s: F.lag(s.expr, periods).over(w) if periods >= 0 else F.lead(s.expr, -periods).over(w))

    def diff(self, periods=1):
        w = self._w()
        return self._analytic(lambda s: s.expr - (F.lag(s.expr, periods).over(w) if periods >= 0 else F.lead(s.expr, -periods).over(w)))

    def rank(self, method="average", ascending=True, na_option="keep", pct=False):
        return self._analytic(lambda s: rank(s, self._by(), method, na_option, ascending, pct))

    def head(self, n=5):
        at = self.frame.rows.put(F.row_number().over(self._w()))[0]
        return self.frame._filtered(F.col(at) <= n)

    def rolling(self, window, min_periods=None, on=None, closed="right"):
        return Rolling(self._picked(on), window, min_periods, closed, on, self._by(), self.series)

    def expanding(self, min_periods=1):
        return Rolling(self._picked(), None, min_periods, "right", None, self._by(), self.series)

    def _picked(self, on=None):
        return self.frame[[*self.selected, *([on] if on is not None and on not in self.selected else [])]]

    def __iter__(self):
        """(key, frame) for each group; the keys, not the rows, come to the driver."""
        for row in self.frame.rows.sdf.select(*self._by()).distinct().orderBy(*range(1, len(self.keys) + 1)).toLocalIterator():
            cond = None
            for (_, e), v in zip(self.keys, row):
                here = e.eqNullSafe(F.lit(v))
                cond = here if cond is None else cond & here
            yield (row[0] if len(row) == 1 else tuple(row)), self.frame._filtered(cond)

    def __len__(self):
        return self.frame.rows.sdf.select(*self._by()).distinct().count()


for _n in ("sum", "mean", "min", "max", "std", "var", "count", "prod", "all", "any", "skew", "kurt", "kurtosis"):
    setattr(GroupBy, _n, lambda self, *_, n=_n, **__: self._apply(lambda s: aggregates.aggregate(n, s.v), n not in ("min", "max", "count", "all", "any")))


class Resampler:
    """Bins of time, left closed and left labelled; empty bins between the first and last are there, as null or zero."""

    def __init__(self, frame: DataFrame, rule: str, on, level, origin):
        import re

        n, unit = re.fullmatch(r"(\d*)([A-Za-z]+)", rule).groups()
        self.frame, self.unit, self.n, self.series = frame, unit, int(n or 1), None
        at = frame._column(on) if on is not None else F.col(frame.rows.index[frame._level(level) if level is not None else 0])
        self.kind = frame.rows.value(at).type
        self.on, self.at, self.origin = on, at, origin
        self.fixed = unit in datetimes.SECONDS and unit != "W"
        stamp = time_micros(at, self.kind)
        if self.fixed:
            step = int(datetimes.SECONDS[unit] * self.n * 1_000_000)
            if origin == "epoch":
                first = F.lit(0)
            else:
                least = frame.rows.sdf.agg(F.min(stamp)).first()[0] or 0
                first = F.lit(least if origin == "start" else least - least % 86_400_000_000)
            self.label = datetimes.label_time(datetimes.integer_label(V(at, self.kind), step / 1e6, first), step / 1e6, first, self.kind)
            self.step = F.make_dt_interval(secs=F.lit(step / 1e6))
        else:
            self.label = datetimes.floor_dt(V(at, self.kind), unit)
            months = {"M": 1, "MS": 1, "Q": 3, "QS": 3, "Y": 12, "YS": 12}.get(unit)
            self.step = F.make_ym_interval(F.lit(0), F.lit(months)) if months else F.make_dt_interval(F.lit(7))

    def __getitem__(self, key):
        self.series = key
        return self

    def agg(self, how):
        cols = [s for s in self.frame._series() if s.name != self.on and (self.series is None or s.name in listed(self.series)) and (s.v.is_number or s.v.is_bool or how in ("count", "min", "max", "size"))]
        key, names = fresh("k"), [fresh() for _ in cols]
        made = self.frame.rows.sdf.groupBy(self.label.alias(key)).agg(*(aggregates.aggregate(how, s.v).alias(n) for s, n in zip(cols, names)))
        grid = made.agg(F.min(key).alias("a"), F.max(key).alias("b")).select(F.explode(F.sequence("a", "b", self.step)).alias(key))
        full = grid.join(made, key, "left")
        empty = {"sum": 0, "count": 0, "size": 0}.get(how)
        rows = Rows(full, [key], [self.on if self.on is not None else self.frame.rows.names[0]], [(key, True)])
        out = DataFrame(rows, [(s.name, F.coalesce(F.col(n), F.lit(empty)) if empty is not None else F.col(n)) for s, n in zip(cols, names)])
        return out[self.series] if isinstance(self.series, str) else out


for _n in ("sum", "mean", "min", "max", "std", "var", "count", "median", "size"):
    setattr(Resampler, _n, lambda self, n=_n: self.agg(n))


def resample(frame, rule, on, level, origin, closed=None, label=None) -> Resampler:
    if closed not in (None, "left") or label not in (None, "left"):
        raise NotImplementedError("bins are closed and labelled on the left")
    return Resampler(frame, rule, on, level, origin)
