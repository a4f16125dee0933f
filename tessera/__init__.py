"""tessera: a pandas-style analytics engine whose every verb is a Spark plan.

Names are imported when first used, so Python workers load only what they run.
"""

from importlib import import_module

_WHERE = {
    "DataFrame": "plans.frame", "Index": "plans.frame", "MultiIndex": "plans.frame", "Series": "plans.frame", "col": "plans.frame",
    "NamedAgg": "operators.grouping", "concat": "operators.relational", "merge": "operators.relational", "crosstab": "operators.reshape", "get_dummies": "operators.reshape",
    "cut": "operators.windows", "qcut": "operators.windows", "to_datetime": "operators.convert", "to_timedelta": "operators.convert",
    "GeoSeries": "plans.geoseries", "Session": "sources.session", "read_function": "sources.functions", "remote_function": "sources.functions", "udf": "sources.functions",
}

_READERS = ("read", "read_arrow", "read_csv", "read_json", "read_orc", "read_pandas", "read_parquet", "read_pickle", "read_sql", "read_stream", "read_table", "from_glob_path")

__all__ = sorted(_WHERE) + list(_READERS)


def __getattr__(name: str):
    if name in _READERS:
        return getattr(import_module(".sources.session", __name__).Session.active(), name)
    if name not in _WHERE:
        raise AttributeError(name)
    return getattr(import_module(f".{_WHERE[name]}", __name__), name)
