"""Every registered query with SQL gives what DuckDB gives, at the smallest size."""

import decimal
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.queries import QUERIES, SQL
from tessera.queries.verbs import said

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
        return str(bool(v))
    if hasattr(v, "tolist") and getattr(v, "ndim", 0):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([f"{x:.6g}" if isinstance(x := cell(y), float) else x for y in v])
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        # Whole numbers in full: a null makes whole numbers of pandas floats.
        return str(int(v)) if math.isfinite(v) and v == int(v) and abs(v) < 2**53 else float(v)
    return v if isinstance(v, str) else str(v).replace(" 00:00:00", "")


def rows(df):
    """Rows in an order that the last digits of a fraction have no part in."""
    made = [tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)]
    return sorted(made, key=lambda r: [f"{float(v):.4g}" if isinstance(v, float) else v for v in r] + [f"{v!r}" for v in r])


def alike(a, b) -> bool:
    """Whole numbers, texts and times are the same; fractions agree to a millionth."""
    return len(a) == len(b) and all(len(x) == len(y) and all(map(_close, x, y)) for x, y in zip(a, b))


def _close(x, y) -> bool:
    if x == y:
        return True
    # A fraction may be next to a whole number, which is text here.
    one, other = _number(x), _number(y)
    return None not in (one, other) and float in (type(x), type(y)) and math.isclose(one, other, rel_tol=1e-6, abs_tol=1e-9)


def _number(x):
    try:
        return float(x)
    except ValueError:
        return None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert alike(rows(got), rows(want))
    else:
        assert len(got)


def test_classes_judge_whole_texts(spark, duck):
    got = QUERIES["string_classes_whole"](spark, FOLDER).toPandas().set_index("doc_id")
    spaced = [r[0] for r in duck.sql("SELECT doc_id FROM documents WHERE regexp_full_match(substr(text, 1, 3), '\\p{L}+') AND contains(text, ' ')").fetchall()]
    assert spaced and not got.loc[spaced, ["an", "al"]].astype(bool).any(axis=None)


def test_null_keys_of_whole_tables_meet(spark, duck):
    got = QUERIES["join_null_keys_whole"](spark, FOLDER).toPandas()
    assert got["k"].isna().sum() == duck.sql("SELECT count(*) FROM events WHERE event_id % 4 = 0").fetchall()[0][0] and got["event_id"].max() >= 40


def test_extremes_are_the_first_keys_of_ties(spark, tmp_path):
    rows = [(k, x) for k, x in zip(range(8), (None, 2.0, 9.0, 1.0, 9.0, 1.0, 9.0, 1.0))]
    for name, dealt in (("up", rows), ("down", rows[::-1])):
        spark.createDataFrame(dealt, "c_custkey bigint, c_acctbal double").coalesce(1).write.parquet(str(tmp_path / name / "customer.parquet"))
        assert [tuple(r) for r in QUERIES["idx_extremes"](spark, str(tmp_path / name)).collect()] == [(2, 3)]


def test_facts_round_a_half_as_sql(duck):
    for x in (0.00025, 0.00005, -0.00025, 0.49835, 1234.56785, 0.00035):
        assert said(x) == str(duck.sql(f"SELECT CAST(round(({x}::DOUBLE) * 10000) AS BIGINT)").fetchall()[0][0]), x


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
