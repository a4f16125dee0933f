"""User-defined functions: Arrow-batched, typed by annotation or by argument."""

from __future__ import annotations

import inspect

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {int: "bigint", float: "double", str: "string", bool: "boolean", bytes: "binary", list[int]: "array<bigint>", list[float]: "array<double>", list[str]: "array<string>", list[bool]: "array<boolean>"}
NAMED = {t.__name__: s for t, s in TYPES.items() if isinstance(t, type)}


def spark_type(kind) -> str:
    if isinstance(kind, T.DataType):
        return kind.simpleString()
    return TYPES.get(kind) or NAMED.get(str(kind)) or str(kind)


def udf(func=None, *, input_types=None, output_type=None, name=None, session=None, **_):
    """Make a function usable on series; with ``name`` also from SQL.

    Values reach the function in Arrow batches, one call a value.  Null arguments are
    passed on as None.  Options of deployment, which have no meaning here, are ignored.
    """

    def wrap(f):
        hints = inspect.get_annotations(f, eval_str=True)
        kind = spark_type(output_type if output_type is not None else hints.get("return", str))
        n = len(inspect.signature(f).parameters)

        def batch(*columns: pd.Series) -> pd.Series:
            return pd.Series([f(*(None if x is None or x is pd.NA else x for x in row)) for row in zip(*columns)], dtype=object)

        # pandas_udf reads the signature, so one with as many arguments as ``f`` is made.
        args = ", ".join(f"a{k}: pd.Series" for k in range(n))
        space = {"pd": pd, "batch": batch}
        exec(f"def typed({args}) -> pd.Series:\n    return batch({', '.join(f'a{k}' for k in range(n))})", space)
        made = F.pandas_udf(space["typed"], kind)
        f.spark_udf, f.output_type, f.input_types = made, kind, input_types
        if name:
            from pyspark.sql import SparkSession

            (session or SparkSession.active()).udf.register(name, made)
        return f

    return wrap if func is None else wrap(func)


remote_function = udf


def read_function(name: str):
    """An existing SQL function as a function on series."""

    def f(*_):
        raise TypeError("call it through Series.apply")

    f.spark_udf = lambda *cols: F.call_function(name, *cols)
    return f


def row_udf(func, frame, args=()):
    """A function of a whole row (a pandas Series), or of as many values as there are columns."""
    hints = inspect.get_annotations(func, eval_str=True)
    kind = spark_type(getattr(func, "output_type", None) or hints.get("return", str))
    labels = [str(c) for c in frame.columns]
    plain = [p for p in inspect.signature(func).parameters.values()]
    spread = len(plain) == len(labels) + len(args) and len(labels) > 1

    @F.pandas_udf(kind)
    def run(rows: pd.DataFrame) -> pd.Series:
        rows = rows.set_axis(labels, axis=1)
        if spread:
            return pd.Series([func(*r, *args) for r in rows.itertuples(index=False, name=None)])
        return pd.Series([func(r, *args) for _, r in rows.iterrows()])

    return run(F.struct(*(e.alias(n) for n, (_, e) in zip(labels, frame._columns))))
