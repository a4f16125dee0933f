"""Frame semantics on tiny inputs, against plain pandas where it says the same."""

import datetime
import decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tessera
from tessera import NamedAgg, concat, udf
from tessera.functions import geo, nested
from tessera.plans.frame import DataFrame


@pytest.fixture
def local():
    return pd.DataFrame({"k": ["a", "b", "a", None, "c"], "x": [1.0, None, 3.0, 4.0, -5.0], "n": [1, 2, 3, 4, 5]}, index=pd.Index([10, 11, 12, 13, 14], name="id"))


@pytest.fixture
def frame(session, local):
    return session.read_pandas(local.assign(x=local["x"].astype(object)))


def values(series):
    return [None if v is None or v != v else v for v in series.to_pandas().tolist()]


def test_round_trip_keeps_order_and_index(frame, local):
    out = frame.to_pandas()
    assert out.index.tolist() == local.index.tolist() and out.index.name == "id"
    assert out["n"].tolist() == [1, 2, 3, 4, 5]


def test_same_rows_combine_without_join(frame):
    out = frame["n"] + frame["n"] * 2
    assert values(out) == [3, 6, 9, 12, 15]
    assert "Join" not in out.to_frame("v").sql


def test_different_rows_meet_on_the_index(session):
    a = session.read_pandas(pd.Series([1, 2], index=["x", "y"], name="a"))
    b = session.read_pandas(pd.Series([10, 20], index=["y", "z"], name="b"))
    assert (a + b).to_pandas().sort_index().fillna(-1).to_dict() == {"x": -1, "y": 12, "z": -1}


def test_division_and_modulo_follow_python(session):
    f = session.read_pandas(pd.DataFrame({"a": [7, -7, 7, 0], "b": [2, 2, 0, 0]}))
    assert values(f["a"] // f["b"]) == [3, -4, 0, 0]
    assert values(f["a"] % f["b"]) == [1, 1, 0, 0]
    q = (f["a"] / f["b"]).to_pandas()
    assert q.tolist()[:3] == [3.5, -3.5, np.inf] and np.isnan(q.tolist()[3])


def test_power_overflow_is_null(session):
    f = session.read_pandas(pd.DataFrame({"a": [2, 10]}))
    assert values(f["a"] ** 20)[0] == 1048576 and values(f["a"] ** 40)[1] is None


def test_sums_of_nothing(frame):
    none = frame[frame["n"] > 100]
    assert none["x"].sum() == 0 and bool(none["n"].all()) is True and bool(none["n"].any()) is False and none["x"].mean() is None


def test_nulls_sort_last_both_ways(frame):
    assert values(frame["k"].sort_values())[-1] is None
    assert values(frame["k"].sort_values(ascending=False))[-1] is None
    assert values(frame["k"].sort_values(na_position="first"))[0] is None


def test_group_keys(frame):
    assert frame.groupby("k")["n"].sum().to_pandas().to_dict() == {"a": 4, "b": 2, "c": 5}
    assert len(frame.groupby("k", dropna=False)["n"].sum().to_pandas()) == 4
    out = frame.groupby("k", as_index=False).agg(total=NamedAgg("n", "sum"), top=NamedAgg("n", "max")).to_pandas()
    assert out["total"].tolist() == [4, 2, 5]


def test_group_iteration_and_describe(frame):
    assert {k: len(g) for k, g in frame.groupby("k")} == {"a": 2, "b": 1, "c": 1}
    assert frame.groupby("k")[["n"]].describe().to_pandas().shape == (3, 8)


def test_null_keys_match_in_joins(session):
    a = session.read_pandas(pd.DataFrame({"k": ["x", None], "a": [1, 2]}))
    b = session.read_pandas(pd.DataFrame({"k": ["x", None], "b": [3, 4]}))
    assert len(a.merge(b, on="k")) == 2


def test_merge_suffixes_and_outer(session):
    a = session.read_pandas(pd.DataFrame({"k": [1, 2], "v": [1, 2]}))
    b = session.read_pandas(pd.DataFrame({"k": [2, 3], "v": [5, 6]}))
    out = a.merge(b, on="k", how="outer").to_pandas()
    assert list(out.columns) == ["k", "v_x", "v_y"] and sorted(out["k"]) == [1, 2, 3]


def test_positions_and_slices(frame):
    assert frame.iloc[1:4:2]["n"].tolist() == [2, 4]
    assert frame.iloc[-2:]["n"].tolist() == [4, 5]
    assert frame.iloc[::-1]["n"].tolist() == [5, 4, 3, 2, 1]
    assert frame.iloc[2]["n"] == 3 and frame.iloc[0, 2] == 1
    assert frame.tail(2)["n"].tolist() == [4, 5] and frame.head(-3)["n"].tolist() == [1, 2]


def test_labels(frame):
    assert frame.loc[[10, 14]]["n"].tolist() == [1, 5]
    assert frame.loc[11:13]["n"].tolist() == [2, 3, 4]
    assert frame.loc[12, "n"] == 3
    assert 13 in frame.index and 99 not in frame.index


def test_windows(frame):
    assert values(frame["n"].shift(1)) == [None, 1, 2, 3, 4]
    assert values(frame["n"].cumsum()) == [1, 3, 6, 10, 15]
    assert values(frame["n"].cumprod()) == [1, 2, 6, 24, 120]
    assert values(frame["x"].ffill()) == [1, 1, 3, 4, -5]
    assert values(frame["n"].rolling(2).sum()) == [None, 3, 5, 7, 9]
    assert values(frame["n"].expanding().max()) == [1, 2, 3, 4, 5]
    assert values(frame["x"].interpolate()) == [1, 2, 3, 4, -5]


def test_rank_against_pandas(session):
    s = pd.Series([3.0, 1.0, 3.0, None, 2.0], name="x")
    for how in ("average", "min", "max", "dense", "first"):
        assert session.read_pandas(s).rank(method=how).to_pandas().fillna(-1).tolist() == s.rank(method=how).fillna(-1).tolist()


def test_assignment_and_columns(frame):
    frame["twice"] = frame["n"] * 2
    frame.insert(0, "zero", 0)
    assert list(frame.columns) == ["zero", "k", "x", "n", "twice"]
    del frame["zero"]
    assert frame.drop(columns="k").rename(columns={"n": "m"}).columns.tolist() == ["x", "m", "twice"]
    with pytest.raises(KeyError):
        frame.drop(columns="absent")


def test_query_eval_and_outer_names(frame):
    least = 2  # noqa: F841
    assert frame.query("n > @least and k == 'a'")["n"].tolist() == [3]
    assert frame.eval("n * 2 + 1").tolist() == [3, 5, 7, 9, 11]


def test_reshape(session):
    wide = pd.DataFrame({"a": [1, 2], "b": [3, 4]}, index=["r", "s"])
    f = session.read_pandas(wide)
    assert f.T.to_pandas().to_dict() == wide.T.to_dict()
    assert f.stack().to_pandas().tolist() == [1, 3, 2, 4]
    assert f.melt(var_name="v", value_name="x").to_pandas()["x"].tolist() == [1, 2, 3, 4]
    assert f.stack().unstack().to_pandas().to_dict() == wide.to_dict()


def test_explode_keeps_empty(session):
    f = session.read_pandas(pd.DataFrame({"k": [1, 2, 3], "v": [[1, 2], [], None]}))
    assert values(f.explode("v")["v"]) == [1, 2, None, None]


def test_concat_order_and_columns(session):
    a, b = session.read_pandas(pd.DataFrame({"x": [1], "y": [2]})), session.read_pandas(pd.DataFrame({"x": [3], "z": [4]}))
    out = concat([a, b]).to_pandas()
    assert list(out.columns) == ["x", "y", "z"] and out["x"].tolist() == [1, 3]
    assert list(concat([a, b], join="inner").columns) == ["x"]


def test_row_aggregates_and_describe(frame):
    assert values(frame[["x", "n"]].sum(axis=1)) == [2, 2, 6, 8, 0]
    d = frame[["n"]].describe().to_pandas()["n"]
    assert d["count"] == 5 and d["mean"] == 3 and d["max"] == 5


def test_strings(session):
    s = session.read_pandas(pd.Series(["-5", "ab c", None, "straße"], name="s"))
    assert values(s.str.zfill(4)) == ["-005", "ab c", None, "straße"]
    assert values(s.str[1:-1]) == ["", "b ", None, "traß"]
    assert values(s.str.find("z")) == [-1, -1, None, -1]
    assert values(s.str.center(6, "*"))[1] == "*ab c*"
    assert values(s.str.extract(r"(?P<n>\d+)")["n"]) == ["5", None, None, None]
    assert values(s.str.pad(2)) == ["-5", "ab c", None, "straße"]


def test_times(session):
    t = session.read_pandas(pd.Series(pd.to_datetime(["2024-12-30 23:59:59.5", None]), name="t"))
    assert values(t.dt.year) == [2024, None] and values(t.dt.isocalendar()["year"]) == [2025, None]
    assert values(t.dt.strftime("%d.%m.%Y at %H"))[0] == "30.12.2024 at 23"
    assert t.dt.floor("D").to_pandas()[0] == datetime.datetime(2024, 12, 30)


def test_functions_of_users(frame):
    @udf
    def plus(x: int) -> int:
        return x + 1

    assert values(frame["n"].apply(plus)) == [2, 3, 4, 5, 6]

    def first(a, b) -> float:
        return float(a)

    assert values(frame[["n", "x"]].apply(first, axis=1)) == [1, 2, 3, 4, 5]


def test_json(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, "x"]}, "c": "s"}',), (None,)], "j string")
    row = df.select(nested.json_value(F.col("j"), "$.c").alias("v"), nested.json_value(F.col("j"), "$.a").alias("o"), nested.json_query(F.col("j"), "$.c").alias("q"), nested.json_keys(F.col("j")).alias("k"), nested.json_set(F.col("j"), "$.a.z", 1).alias("s")).first()
    assert (row.v, row.o, row.q) == ("s", None, '"s"') and row.k == ["a", "a.b", "c"] and '"z":1' in row.s


def test_geometry():
    square = "POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))"
    assert abs(geo.area(square) / 1.2364e10 - 1) < 0.01
    assert geo.centroid(square) == "POINT(0.5 0.5)" and geo.isclosed("LINESTRING(0 0, 1 1)") is False
    assert geo.intersection(square, "POINT(0.5 0.5)") == "POINT(0.5 0.5)"
    assert geo.intersection(square, "POINT(2 2)").endswith("EMPTY")


def test_sinks(frame, session, tmp_path, spark):
    for kind in ("parquet", "csv", "json", "orc"):
        path = str(tmp_path / kind)
        getattr(frame, f"to_{kind}")(path)
        assert len(getattr(session, f"read_{kind}")(path)) == 5
    frame.to_table("t_frame", if_exists="replace")
    frame.to_table("t_frame", if_exists="append")
    assert len(session.read_table("t_frame", filters=[("n", ">", 3)])) == 4
    with pytest.raises(Exception):
        frame.to_table("t_frame")
    assert sum(len(p) for p in frame.to_pandas_batches(page_size=2)) == 5


def test_train_test_split_and_model(session):
    from tessera.ml import LinearRegression, LogisticRegression, Pipeline, StandardScaler, metrics, train_test_split

    x = np.arange(200.0)
    f = session.read_pandas(pd.DataFrame({"a": x, "b": x % 7, "y": 3 * x + 2 * (x % 7) + 1, "c": x > 100}))
    train, test = train_test_split(f, test_size=0.25)
    assert len(train) + len(test) == 200
    m = LinearRegression().fit(f[["a", "b"]], f["y"])
    assert np.allclose(m.coef_, [3, 2], atol=1e-3)
    p = m.predict(f[["a", "b"]])
    assert abs(p["predicted_label"].to_pandas()[0] - 1) < 0.1
    assert m.score(f[["a", "b"]], f["y"])["r2_score"] > 0.99
    c = Pipeline([("s", StandardScaler()), ("m", LogisticRegression())]).fit(f[["a"]], f["c"])
    assert c.score(f[["a"]], f["c"])["accuracy"] > 0.95
    assert metrics.roc_auc_score(f["c"], f["a"]) == 1.0


def test_streaming(session, tmp_path, spark):
    spark.range(10).withColumn("v", F.col("id") % 2).write.parquet(str(tmp_path / "in"))
    s = session.read_stream(str(tmp_path / "in"))
    s["w"] = s["v"] + 1
    s = s[s["v"] == 1][["id", "w"]].rename({"w": "z"})
    s.to_table(str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).columns == ["id", "z"] and spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_model_backed(session):
    f = session.read_pandas(pd.DataFrame({"t": ["red apple", "blue sky", "green apple"]}))
    assert len(f.ai.search("t", "apple", top_k=2)) == 2
    assert f.semantics.agg("Sum up {t}").count() == 1
    assert len(f.ai.sim_join(f, "t", "t", top_k=1)) == 3


def test_names_are_lazy():
    assert set(tessera.__all__) >= {"DataFrame", "Session", "concat", "udf"}


def test_sql_functions(session):
    from tessera import sql

    f = session.read_pandas(pd.DataFrame({"k": [1, 1, 2], "s": ["a", "b", None], "j": ['{"a":1}', '{"a":[1,2]}', None]}))
    assert list(sql.array_agg(f.groupby("k")["s"]).to_pandas().tolist()[0]) == ["a", "b"]
    assert values(sql.json_value(f["j"], "$.a")) == ["1", None, None]
    assert values(sql.json_query(f["j"], "$.a")) == ["1", "[1,2]", None]
    assert values(sql.json_value(sql.json_set(f["j"], [("$.b", 5)]), "$.b")) == ["5", "5", None]
    assert values(sql.to_json_string(f["s"])) == ['"a"', '"b"', "null"]
    assert values(sql.struct(f[["k", "s"]]).struct.field("k")) == [1, 1, 2]
    assert values(sql.sql_scalar("{0} * 10", [f["k"]])) == [10, 10, 20]
    assert values(sql.row_number(f, ["k"], ["s"])) == [0, 1, 0]


def test_index_recall(session, spark):
    from tessera.operators.search import VectorIndex, vector_search

    rng = np.random.default_rng(1)
    base = spark.createDataFrame([(k, rng.normal(size=16).tolist()) for k in range(2000)], "id bigint, v array<double>")
    q = base.where("id % 100 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    exact = {(r.q, r.id) for r in vector_search(base, "v", "id", q, "qv", "q", 10, "EUCLIDEAN", block=7).collect()}
    x = np.array([r.v for r in base.orderBy("id").collect()])
    for i in range(0, 2000, 100):
        near = np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[:10]
        assert {(i, int(k)) for k in near} == {p for p in exact if p[0] == i}
    found = {(r.q, r.id) for r in VectorIndex(base, "v", "id", lists=16).search(q, "qv", "q", 10, probes=12).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_geoseries(session):
    from tessera import GeoSeries

    g = GeoSeries.from_xy([1.0, 2.5], [3.0, 4.0], session=session)
    assert values(g.x) == [1.0, 2.5] and values(g.to_wkt()) == ["POINT(1 3)", "POINT(2.5 4)"]
    assert values(g.distance("POINT(1 3)"))[0] == 0.0


def test_named_models(session):
    from tessera import sql

    x = np.arange(50.0)
    f = session.read_pandas(pd.DataFrame({"a": x, "y": 2 * x}))
    sql.create_model("m", "LinearRegression", f, "y")
    assert sql.evaluate("m", f, "y")["r2_score"] > 0.99 and len(sql.predict("m", f[["a"]])) == 50
    out = sql.explain_predict("m", f[["a"]]).to_pandas()
    assert out["top_feature_attributions"][3][0]["feature"] == "a"


def test_other_models(session):
    from tessera import ml

    f = session.read_pandas(pd.DataFrame({"u": ["a", "a", "b", "b", "c"], "i": [1, 2, 1, 3, 2], "rating": [5.0, 3.0, 4.0, 1.0, 2.0], "x": [1.0, 2.0, 3.0, None, 5.0]}))
    assert len(ml.MatrixFactorization(num_factors=2, user_col="u", item_col="i", rating_col="rating").fit(f).predict(f)) == 5
    assert values(ml.SimpleImputer(strategy="mean").fit(f[["x"]]).transform(f[["x"]]).iloc_column(0))[3] == 2.75
    assert ml.PCA(n_components=1).fit(f[["i", "rating"]]).predict(f[["i", "rating"]]).columns[0] == "principal_component_1"
    assert values(ml.KBinsDiscretizer(n_bins=2, strategy="uniform").fit(f[["i"]]).transform(f[["i"]]).iloc_column(0)) == ["bin_1", "bin_2", "bin_1", "bin_2", "bin_2"]
    assert ml.PolynomialFeatures(2).fit_transform(f[["i", "rating"]]).shape[1] == 5
    assert len(ml.RandomForestClassifier(numTrees=3).fit(f[["i", "rating"]], f["u"]).predict(f[["i", "rating"]])) == 5
    assert len(ml.KMeans(n_clusters=2).fit(f[["i"]]).detect_anomalies(f[["i"]])) == 5
    assert [len(t) + len(v) for t, v, _, _ in ml.KFold(2).split(f)] == [5, 5]


def test_limits_and_truth(frame):
    with pytest.raises(ValueError):
        bool(frame["n"] > 1)
    assert len(frame.to_pandas(max_download_size=1)) == 5
    many = frame.merge(frame, how="cross").merge(frame, how="cross")
    assert len(many.to_pandas(max_download_size=0, sampling_method="head")) == 1
    with pytest.raises(ValueError):
        many.to_pandas(max_download_size=0)
    s = frame["n"]
    s[11] = 99
    assert values(s) == [1, 99, 3, 4, 5] and frame.index.shape == (5,)


def test_expanding_over_all_rows(session):
    s = pd.Series([3.0, None, 1.0, 5.0, None, 2.0], name="x")
    f = session.read_pandas(s)
    for how in ("count", "sum", "mean", "min", "max", "var", "std"):
        want = getattr(s.expanding(), how)()
        assert np.allclose(getattr(f.expanding(), how)().to_pandas().astype(float).fillna(-9), want.fillna(-9)), how


def test_ranks_and_gaps_over_many_partitions(session):
    rng = np.random.default_rng(3)
    s = pd.Series(1e6 + rng.integers(0, 40, 500).astype(float), name="x").mask(rng.random(500) < 0.2)
    f = session.read_pandas(s)
    for how in ("average", "min", "max", "dense", "first"):
        for option in ("keep", "top", "bottom"):
            for pct in (False, True):
                want = s.rank(method=how, na_option=option, pct=pct)
                assert np.allclose(f.rank(method=how, na_option=option, pct=pct).to_pandas().astype(float).fillna(-1), want.fillna(-1)), (how, option, pct)
    assert np.allclose(f.interpolate().to_pandas().astype(float).fillna(-1), s.interpolate().fillna(-1))
    assert np.allclose(f.expanding().var().to_pandas().astype(float).fillna(-1), s.expanding().var().fillna(-1))


def test_rolling_over_time_without_groups(session):
    rng = np.random.default_rng(4)
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.choice(100_000, 300, replace=False)), unit="s")
    p = pd.DataFrame({"at": at, "x": rng.integers(0, 9, 300).astype(float)})
    f = session.read_pandas(p)
    for closed in ("right", "left", "both", "neither"):
        want = p.rolling("1h", on="at", closed=closed)["x"].sum()
        assert np.allclose(f.rolling("1h", on="at", closed=closed).sum()["x"].to_pandas().astype(float).fillna(-1), want.fillna(-1)), closed


def test_extremes_of_a_frame_are_the_first_of_ties(session):
    p = pd.DataFrame({"x": [2.0, 9.0, 1.0, 9.0, 1.0, None], "y": [5.0, 5.0, 5.0, 4.0, 4.0, 4.0]}, index=pd.Index([30, 20, 10, 40, 50, 60], name="k"))
    f = session.read_pandas(p)
    assert f.idxmax().to_dict() == p.idxmax().to_dict() and f.idxmin().to_dict() == p.idxmin().to_dict()


def test_extremes_of_a_series_are_the_first_of_ties(session):
    p = pd.Series([2.0, 9.0, 1.0, 9.0, 1.0, None], index=pd.Index([30, 20, 10, 40, 50, 60], name="k"), name="x")
    f = session.read_pandas(p)
    assert (f.idxmax(), f.idxmin()) == (p.idxmax(), p.idxmin()) == (20, 10)
    # Row order, not the order of the labels, and not that of the files.
    back = f.sort_index(ascending=False)
    assert (back.idxmax(), back.idxmin()) == (40, 50)
    assert f[f > 100].idxmax() is None


def test_transfers_by_arrow_and_by_rows_agree(spark):
    from tessera.operators import transfer

    kinds = {"b": "boolean", "i": "int", "l": "bigint", "f": "float", "d": "double", "s": "string", "t": "date", "m": "decimal(9,2)", "k": "tinyint"}
    values = {"b": True, "i": 7, "l": 2**60 + 1, "f": 1.1, "d": float("nan"), "s": "x", "t": datetime.date(2024, 2, 29), "m": decimal.Decimal("1.50"), "k": -3}
    whole = [tuple(values[k] for k in kinds)] * 5
    for rows in (whole, [*whole, (None,) * len(kinds), *whole], [(None,) * len(kinds)] * 3, []):
        df = spark.createDataFrame(rows, ", ".join(f"{k} {t}" for k, t in kinds.items())).coalesce(1)
        assert transfer.plain(df)
        pd.testing.assert_frame_equal(transfer.fetched(df), df.toPandas())
        for size in (1, 2, 3, 100):
            got, want = list(transfer.pages(df, size)), list(transfer._row_pages(df, size))
            assert len(got) == len(want)
            for a, b in zip(got, want):
                pd.testing.assert_frame_equal(a, b)
    assert spark.conf.get(transfer.ARROW) == "false" and not transfer.plain(spark.sql("SELECT array(1) AS a"))


def test_pages_come_as_batches_not_as_rows(session, monkeypatch):
    from tessera.operators import transfer

    monkeypatch.setattr(transfer, "_row_pages", lambda *_: pytest.fail("rows fetched one by one"))
    f = session.read_pandas(pd.DataFrame({"x": np.arange(25)[::-1], "s": "a"})).sort_values("x")
    assert [len(p) for p in f.to_pandas_batches(page_size=10)] == [10, 10, 5]
    assert [r["x"] for _, r in f.iterrows()] == list(range(25)) and [r.x for r in f.itertuples()] == list(range(25))


def test_equal_frames_count_their_rows(session):
    a, b, c = (session.read_pandas(pd.DataFrame({"x": x}, index=[0] * 3)) for x in ([1.0, 1.0, None], [1.0, None, 1.0], [1.0, None, None]))
    assert a.equals(b) and not a.equals(c) and not c.equals(a) and not a.equals(a.head(2)) and not a.head(2).equals(a)


def test_single_rows_near_the_start_need_no_positions(session):
    f = session.read_pandas(pd.DataFrame({"x": [5, 6, 7], "s": ["a", "b", "c"]}))
    assert f.iat[1, 1] == "b" and f["x"].iat[2] == 7 and f.iloc[0]["s"] == "a" and not f.rows.positions
    assert f.iloc[-1]["x"] == 7
    with pytest.raises(IndexError):
        f.iat[3, 0]


def _training_shares(session, monkeypatch, kind):
    """Rows that each task holds when a model of a kind is fitted on 1,000 rows in one piece, 100 rows a task."""
    from tessera import ml

    seen = []

    class Caught:
        def fit(self, sdf):
            seen.extend(len(p) for p in sdf.rdd.glom().collect())

    monkeypatch.setattr(ml, "SHARE", 100)
    monkeypatch.setattr(getattr(ml, kind), "make", lambda **_: Caught())
    f = DataFrame.from_spark(session.spark.range(0, 1000, 1, 1).withColumn("y", F.col("id") % 2 == 0))
    getattr(ml, kind)().fit(f[["id"]], f["y"])
    return seen


def test_training_rows_of_classes_are_dealt_over_tasks(session, monkeypatch):
    seen = _training_shares(session, monkeypatch, "XGBClassifier")
    assert sum(seen) == 1000 and max(seen) <= 200


def test_training_rows_of_values_are_dealt_over_tasks(session, monkeypatch):
    seen = _training_shares(session, monkeypatch, "XGBRegressor")
    assert sum(seen) == 1000 and max(seen) <= 200


def _holt(p: pd.DataFrame, horizon: int):
    """The trend by one loop over a whole series."""
    p = p.dropna(subset=["v"]).sort_values(["ts", "v"])
    y, errors = p["v"].tolist(), []
    level, slope = y[0], 0.0
    for x in y[1:]:
        guess = level + slope
        errors.append(x - guess)
        new = 0.5 * x + 0.5 * guess
        slope, level = 0.1 * (new - level) + 0.9 * slope, new
    k = np.arange(1, horizon + 1)
    step = p["ts"].diff().median() if len(p) > 1 else pd.Timedelta(days=1)
    at = [(p["ts"].iloc[-1] + step * int(i)).floor("us") for i in k]
    return at, level + slope * k, 1.959964 * (np.std(errors) if errors else 0.0) * np.sqrt(k)


def test_forecast_in_ranges_is_that_of_the_whole_series(session, spark, monkeypatch):
    from tessera.ai import forecast
    from tessera.operators import trend

    scanned, durable = [], trend.durable
    monkeypatch.setattr(trend, "durable", lambda df: scanned.append(durable(df)) or scanned[-1])
    rng, n = np.random.default_rng(5), 9000
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.choice(10**9, n)), unit="us")
    p = pd.DataFrame({"ts": at, "v": 100 + np.cumsum(rng.normal(size=n)), "k": rng.choice(["a", "b"], n, p=[0.8, 0.2])})
    p.loc[rng.random(n) < 0.05, "v"] = np.nan
    p.loc[p.index[:5], "ts"] = p["ts"].iloc[0]
    p = pd.concat([p, pd.DataFrame({"ts": at[:1], "v": [3.0], "k": ["one"]})])
    p.loc[p["k"] == "b", "k"] = None
    df = spark.createDataFrame(p.sample(frac=1, random_state=2))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for ids in ([], ["k"]):
            got = forecast(df, "ts", "v", ids, 3).toPandas()
            assert scanned.pop().where("d IS NULL").groupBy("g").count().agg(F.max("count")).first()[0] > 1
            for key, part in p.groupby("k", dropna=False) if ids else [(None, p)]:
                mine = got[got["k"].isna() if pd.isna(key) else got["k"] == key] if ids else got
                mine = mine.sort_values("forecast_timestamp")
                times, mean, wide = _holt(part, 3)
                assert mine["forecast_timestamp"].tolist() == times
                assert np.allclose(mine["forecast_value"], mean, rtol=1e-12) and np.allclose(mine["prediction_interval_upper_bound"], mean + wide, rtol=1e-12) and np.allclose(mine["prediction_interval_lower_bound"], mean - wide, rtol=1e-12)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_forecast_of_half_a_microsecond_and_of_nothing(spark):
    from tessera.ai import forecast

    rows = [(datetime.datetime(2024, 1, 1, 0, 0, 0, us), float(us)) for us in (0, 1, 3)]
    df = spark.createDataFrame(rows, "ts timestamp, v double")
    assert [r[0].microsecond for r in forecast(df, "ts", "v", [], 3).orderBy("forecast_timestamp").collect()] == [4, 6, 7]
    assert forecast(df.withColumn("v", F.lit(None).cast("double")), "ts", "v", [], 3).count() == 0


def test_anomalies_need_no_window_over_all_rows(session):
    from tessera import ml

    f = session.read_pandas(pd.DataFrame({"t": pd.date_range("2024-01-01", periods=30), "v": [1.0, 2.0] * 14 + [1.5, 90.0], "k": ["a", None] * 15}))
    for ids in ({}, {"id_col": f[["k"]]}):
        found = ml.ARIMAPlus().fit(f[["t"]], f[["v"]], **ids).detect_anomalies()
        # Within its group of ones, 1.5 is one too.
        assert sorted(r["y"] for r in found.to_spark().where("is_anomaly").collect()) == ([1.5, 90.0] if ids else [90.0]) and len(found) == 30
        assert list(found.columns) == ["t", "y", *(["k"] if ids else []), "z", "is_anomaly"] and "Window" not in found.sql
