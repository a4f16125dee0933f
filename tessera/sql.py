"""SQL-style functions on series: arrays, JSON, time, geography, search, structs, models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import aggregates, datetimes, geo, nested
from .functions.templates import sql_scalar
from .operators.grouping import GroupBy
from .operators.search import VectorIndex
from .operators.search import vector_search as _search
from .plans.frame import DataFrame, Series

__all__ = ["sql_scalar"]


def _col(f):
    def call(series: Series, *args, **kwargs) -> Series:
        return series._new(f(series.expr, *args, **kwargs))

    call.__doc__ = f.__doc__
    return call


def _two(f):
    def call(series: Series, other) -> Series:
        me, o = series._with(other)
        return me._new(f(me.expr, o.col))

    return call


# aggregates and arrays ------------------------------------------------------------


def approx_top_count(series: Series, number: int):
    """The most frequent values with their approximate counts, from one bounded sketch."""
    return series._one(aggregates.approx_top_count(series.v, number))


def array_agg(obj):
    """Non-null values of each group (or of all rows), in row order, as arrays."""
    if isinstance(obj, GroupBy):
        order = [F.col(c) for c in obj.frame.rows.total_order()]
        return obj._apply(lambda s: aggregates.array_agg(s.v, order))
    order = [F.col(c) for c in obj.rows.total_order()]
    return obj._one(aggregates.array_agg(obj.v, order))


array_length = _col(lambda x: F.size(x).cast("bigint"))
array_to_string = _col(lambda x, delimiter: F.array_join(x, delimiter))

# time --------------------------------------------------------------------------------


def unix_seconds(series: Series) -> Series:
    return series._new(datetimes.PARTS["unix_seconds"](series.v))


def unix_millis(series: Series) -> Series:
    return series._new(datetimes.PARTS["unix_millis"](series.v))


def unix_micros(series: Series) -> Series:
    return series._new(datetimes.PARTS["unix_micros"](series.v))


# JSON ------------------------------------------------------------------------------------

json_extract = json_query = _col(nested.json_query)
json_extract_array = json_query_array = _col(nested.json_array)
json_extract_string_array = json_value_array = _col(nested.json_string_array)
json_value = _col(nested.json_value)
json_keys = _col(nested.json_keys)
parse_json = _col(lambda x: F.parse_json(x))


def json_set(series: Series, json_path_value_pairs) -> Series:
    for path, value in json_path_value_pairs:
        series = series._new(nested.json_set(series.expr, path, value))
    return series


def to_json_string(series: Series) -> Series:
    return series._new(nested.to_json_string(series.expr, series.dtype))


def to_json(series: Series) -> Series:
    return series._new(F.parse_json(nested.to_json_string(series.expr, series.dtype)))


# geography ---------------------------------------------------------------------------------

st_area, st_length, st_centroid, st_convexhull, st_boundary, st_isclosed = (_col(f) for f in (geo.st_area, geo.st_length, geo.st_centroid, geo.st_convexhull, geo.st_boundary, geo.st_isclosed))
st_distance, st_intersection, st_difference, st_geogpoint = (_two(f) for f in (geo.st_distance, geo.st_intersection, geo.st_difference, geo.st_geogpoint))
st_buffer, st_simplify, st_astext, st_geogfromtext, st_x, st_y = (_col(f) for f in (geo.st_buffer, geo.st_simplify, geo.st_astext, geo.st_geogfromtext, geo.st_x, geo.st_y))


def st_regionstats(*_, **__):
    raise NotImplementedError("raster statistics need a raster service, which this engine has none of")


# structs, numbers, files -------------------------------------------------------------------------


def struct(frame: DataFrame) -> Series:
    return Series(frame.rows, F.struct(*(e.alias(str(n)) for n, e in frame._columns)), None)


def rand(frame: DataFrame, seed: int | None = None) -> Series:
    return Series(frame.rows, F.rand() if seed is None else F.rand(seed), None)


def make_ref(uri: Series, authorizer: str | None = None) -> Series:
    return uri.str.to_blob(authorizer)


def make_ref_from_json(text: Series) -> Series:
    return text._new(F.from_json(text.expr, T.StructType.fromDDL("uri string, version string, authorizer string, details string")))


def fetch_metadata(ref: Series) -> Series:
    """References with size and time of change of their files, read where the tasks run."""
    import json
    import os

    import pandas as pd

    @F.pandas_udf("string")
    def details(uris: pd.Series) -> pd.Series:
        def one(u):
            if u is None:
                return None
            s = os.stat(u.removeprefix("file:").replace("///", "/"))
            return json.dumps({"size": s.st_size, "updated": pd.Timestamp(s.st_mtime, unit="s").isoformat()})

        return uris.map(one)

    return ref._new(ref.expr.withField("details", details(ref.expr["uri"])))


def get_access_url(ref: Series, mode: str = "R", duration=None) -> Series:
    """The uri itself: there is no signing service."""
    return ref._new(ref.expr["uri"])


# search -----------------------------------------------------------------------------------------------


def create_vector_index(frame: DataFrame, column: str, key: str, distance_type: str = "EUCLIDEAN", lists: int = 32) -> VectorIndex:
    return VectorIndex(frame.to_spark(), column, key, lists, distance=distance_type)


def vector_search(base: DataFrame, column_to_search: str, query: DataFrame, *, key: str, query_column_to_search: str | None = None, query_key: str, top_k: int = 10, distance_type: str = "EUCLIDEAN", index: VectorIndex | None = None, fraction_lists_to_search: float | None = None) -> DataFrame:
    """Nearest rows of ``base`` for each query: exactly, or through an index."""
    q, qc = query.to_spark(), query_column_to_search or column_to_search
    if index is not None:
        probes = max(1, round((fraction_lists_to_search or 0.25) * len(index.centres)))
        return DataFrame.from_spark(index.search(q.withColumnRenamed(qc, "__v"), "__v", query_key, top_k, probes))
    return DataFrame.from_spark(_search(base.to_spark(), column_to_search, key, q, qc, query_key, top_k, distance_type))


# models -------------------------------------------------------------------------------------------------

MODELS: dict[str, object] = {}


def create_model(name: str, kind: str, training_data: DataFrame, label: str | None = None, replace: bool = True, **options):
    """Fit an estimator of ``tessera.ml`` by its class name and keep it under a name."""
    from . import ml

    if name in MODELS and not replace:
        raise ValueError(f"model {name!r} exists")
    model = getattr(ml, kind)(**options)
    X = training_data if label is None else training_data.drop(columns=label)
    MODELS[name] = model.fit(X) if label is None else model.fit(X, training_data[label])
    return MODELS[name]


def _model(m):
    return MODELS[m] if isinstance(m, str) else m


def predict(model, data: DataFrame) -> DataFrame:
    return _model(model).predict(data)


def evaluate(model, data: DataFrame, label: str) -> dict:
    return _model(model).score(data.drop(columns=label), data[label])


def explain_predict(model, data: DataFrame, top_k_features: int = 5) -> DataFrame:
    return _model(model).predict_explain(data, top_k_features)


def global_explain(model):
    return _model(model).global_explain()


def transform(model, data: DataFrame) -> DataFrame:
    return _model(model).transform(data)


def row_number(frame: DataFrame, by: list[str], order: list[str]) -> Series:
    """0-based, as the other positions are."""
    w = Window.partitionBy(*(frame._column(c) for c in by)).orderBy(*(frame._column(c).asc_nulls_last() for c in order))
    return Series(frame.rows, F.col(frame.rows.put((F.row_number().over(w) - 1).cast("bigint"))[0]), None)
