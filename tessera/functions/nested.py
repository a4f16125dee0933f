"""Arrays, structs and JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def array_slice(x, start: int = 0, stop: int | None = None) -> Column:
    return F.slice(x, F.lit(start + 1), F.greatest(F.lit(0), (F.size(x) if stop is None else F.least(F.lit(stop), F.size(x))) - start))


def array_reduce(x, how: str) -> Column:
    kept = F.filter(x, lambda v: v.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return {
        "sum": total, "count": F.size(kept).cast("bigint"), "mean": total / F.nullif(F.size(kept), F.lit(0)), "min": F.array_min(x), "max": F.array_max(x),
        "any": F.exists(kept, lambda v: v.cast("boolean")), "all": F.forall(kept, lambda v: v.cast("boolean")),
    }[how]


def json_value(x, path: str = "$") -> Column:
    """Scalars only; null for objects and arrays."""
    found = F.get_json_object(x, path)
    kind = F.get_json_object(x, path)
    return F.when(~kind.rlike(r"^\s*[\[{]"), found)


def json_query(x, path: str = "$") -> Column:
    """The JSON text at a path; strings keep their quotes."""
    try_text = F.try_parse_json(x)
    return F.to_json(F.try_variant_get(try_text, path, "variant"))


def json_array(x, path: str = "$") -> Column:
    """Elements of the array at a path as JSON texts."""
    return F.transform(F.try_variant_get(F.try_parse_json(x), path, "array<variant>"), lambda v: F.to_json(v))


def json_string_array(x, path: str = "$") -> Column:
    """Elements of the array at a path as strings; null if any is not a scalar."""
    found = F.from_json(F.get_json_object(x, path), T.ArrayType(T.StringType()))
    return F.when(~F.exists(found, lambda v: F.coalesce(v.rlike(r"^\s*[\[{]"), F.lit(False))), found)


def _set(steps: list[str], node, value):
    if not steps:
        return value
    head, rest = steps[0], steps[1:]
    if isinstance(node, list) and head.isdigit():
        k = int(head)
        node = node + [None] * (k + 1 - len(node))
        node[k] = _set(rest, node[k], value)
        return node
    node = dict(node) if isinstance(node, dict) else {}
    node[head] = _set(rest, node.get(head), value)
    return node


def json_set(x, path: str, value) -> Column:
    steps = [s for s in path.removeprefix("$").replace("[", ".").replace("]", "").split(".") if s]

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(_set(steps, json.loads(t), value), separators=(",", ":")))

    return run(x)


def _keys(node, depth: int | None, prefix: str = "") -> list[str]:
    out = []
    if isinstance(node, dict) and depth != 0:
        for k, v in node.items():
            out.append(prefix + k)
            out += _keys(v, None if depth is None else depth - 1, prefix + k + ".")
    return out


def json_keys(x, max_depth: int | None = None) -> Column:
    if max_depth == 1:
        return F.array_sort(F.json_object_keys(x))

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else sorted(_keys(json.loads(t), max_depth)))

    return run(x)


def to_json_string(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(x)
    if isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        wrapped = F.to_json(F.array(x.cast("string")))
        return F.when(x.isNull(), F.lit("null")).otherwise(F.substring(wrapped, F.lit(2), F.length(wrapped) - 2))
    return F.coalesce(x.cast("string"), F.lit("null"))
