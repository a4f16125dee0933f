"""Models and their scores, transformers, model-backed verbs, JSON, shapes and files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import ai, ml, sql
from ..ai import AIAccessor, Backend, Semantics
from ..functions.templates import sql_scalar
from ..ml import metrics
from ..plans.frame import DataFrame
from .registry import query
from .verbs import columns, facts, said_by_sql, tenthousandths

# --- regressions, classes, clusters -----------------------------------------------------

FIT = "(SELECT regr_slope(c_acctbal, c_nationkey) AS a, regr_intercept(c_acctbal, c_nationkey) AS b FROM customer)"


@query("linear_regression_fit", f"SELECT c_custkey, round(a * c_nationkey + b, 3) AS predicted, round(a * c_nationkey, 3) AS attribution, round(b, 3) AS baseline FROM customer, {FIT}")
def _(t):
    f = t.customer
    model = ml.LinearRegression().fit(f[["c_nationkey"]], f["c_acctbal"])
    keyed = t.indexed("customer")
    out = model.predict_explain(keyed[["c_nationkey"]])
    top = out._column("top_feature_attributions")[0]["attribution"]
    return out._new([("predicted", F.round(out._column("predicted_label"), 3)), ("attribution", F.round(top, 3)), ("baseline", F.round(out._column("baseline_prediction_value"), 3))]).reset_index()


@query("model_functions", said_by_sql("", r2="(SELECT 10000)", mae="0", mse="0", explained=tenthousandths("SELECT 2.0"), transformed=tenthousandths("SELECT max(z) FROM (SELECT (p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER () AS z FROM part)"), predicted="(SELECT sum(2 * p_size + 3) FROM part)", coef="20000", intercept="30000"))
def _(t):
    f = t.part[["p_size"]]
    f = f.assign(y=f["p_size"] * 2.0 + 3.0)
    sql.create_model("size_line", "LinearRegression", f, label="y")
    scored = sql.evaluate("size_line", f, "y")
    sql.create_model("size_scale", "StandardScaler", f[["p_size"]])
    z = sql.transform("size_scale", f[["p_size"]]).to_spark()
    predicted = sql.predict("size_line", f[["p_size"]])["predicted_label"].sum()
    explained = sql.explain_predict("size_line", f[["p_size"]], 1)
    assert "top_feature_attributions" in explained.columns
    model = sql.MODELS["size_line"]
    return facts(
        t, r2=round(scored["r2_score"], 6), mae=round(scored["mean_absolute_error"], 4), mse=round(scored["mean_squared_error"], 4), explained=list(sql.global_explain("size_line").values())[0], transformed=float(z.agg(F.max(z.columns[0])).first()[0]), predicted=int(round(predicted)), coef=model.coef_[0], intercept=model.intercept_,
    )


#: Labels that one feature tells: every tree and a logistic line find them whole.
CLASSES = "SELECT p_partkey, p_size > 25 AS {} FROM part"


def separable(t):
    f = t.indexed("part")
    f = f.assign(big=(f["p_size"] > 25).astype("Int64").astype("float64"))
    return f, f["p_size"] > 25


for _name in ("LogisticRegression", "RandomForestClassifier", "XGBClassifier"):

    @query(f"classes_by_{_name}", CLASSES.format("predicted"))
    def _(t, name=_name):
        f, y = separable(t)
        model = getattr(ml, name)().fit(f[["big"]], y)
        scores = model.score(f[["big"]], y)
        assert scores["accuracy"] == 1.0 and scores["f1_score"] == 1.0
        return model.predict(f[["big"]])[["predicted_label"]].rename(columns={"predicted_label": "predicted"}).reset_index()


for _name in ("RandomForestRegressor", "XGBRegressor"):

    @query(f"values_by_{_name}", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 11.0 ELSE 1.0 END AS predicted FROM part")
    def _(t, name=_name):
        f, _ = separable(t)
        model = getattr(ml, name)(**({"bootstrap": False} if name == "RandomForestRegressor" else {})).fit(f[["big"]], f["big"] * 10 + 1)
        out = model.predict(f[["big"]])
        return out.assign(predicted=out["predicted_label"].round(3))[["predicted"]].reset_index()


@query("clusters_and_anomalies", "SELECT p_size > 25 AS big, count(*) AS n, 1 AS clusters, 0 AS anomalies FROM part GROUP BY 1")
def _(t):
    f, _ = separable(t)
    f = f.assign(x=f["big"] * 1000)
    model = ml.KMeans(n_clusters=2).fit(f[["x"]])
    assert model.score(f[["x"]])["mean_squared_distance"] < 1e-6 and len(model.cluster_centers_) == 2
    out = model.detect_anomalies(f[["x"]], 0.1).to_spark()
    return out.groupBy((F.col("x") > 500).alias("big")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("centroid_id").alias("clusters"), F.sum((F.col("distance") > 1e-6).cast("bigint")).alias("anomalies"))


@query("principal_components", said_by_sql("", first="10000", second="0", spread=tenthousandths("SELECT stddev_samp(p_size) * sqrt(5.0) FROM part"), anomalies="true"))
def _(t):
    f = t.part
    f = f.assign(a=f["p_size"].astype("float64"), b=f["p_size"] * 2.0)
    model = ml.PCA(n_components=2).fit(f[["a", "b"]])
    out = model.predict(f[["a", "b"]])
    flagged = model.detect_anomalies(f[["a", "b"]], 0.1)
    assert len(model.components_) == 2
    return facts(t, first=model.explained_variance_ratio_[0], second=abs(round(model.explained_variance_ratio_[1], 6)), spread=float(out["principal_component_1"].std()), anomalies=0 <= int(flagged["is_anomaly"].astype("Int64").sum()) <= len(f) // 5)


@query("matrix_factorization", said_by_sql("", predicted="(SELECT count(*) FROM (SELECT DISTINCT o_custkey % 20, o_orderkey % 10 FROM orders))", close="true"))
def _(t):
    pairs = t.spark.read.parquet(t.path("orders")).select((F.col("o_custkey") % 20).alias("user_id"), (F.col("o_orderkey") % 10).alias("item_id")).distinct()
    f = DataFrame.from_spark(pairs.withColumn("rating", (F.col("user_id") % 3 + 1).cast("double")))
    model = ml.MatrixFactorization(num_factors=4, l2_reg=0.01).fit(f)
    return facts(t, predicted=len(model.predict(f)), close=model.score(f)["mean_squared_error"] < 0.1)


@query("steady_forecast", "SELECT i AS step, 5.0::DOUBLE AS forecast, 5.0::DOUBLE AS low, 5.0::DOUBLE AS high FROM (SELECT unnest([1, 2, 3]) AS i)")
def _(t):
    f = t.events
    f = f.assign(five=f["value"] * 0 + 5.0)
    model = ml.ARIMAPlus().fit(f[["ts"]], f[["five"]])
    out = model.predict(horizon=3).to_spark()
    assert model.summary().to_spark().count() == 1 and model.detect_anomalies().to_spark().where("is_anomaly").count() == 0
    same = f.ai.forecast("ts", "five", horizon=3).to_spark()
    assert same.count() == out.count()
    step = F.row_number().over(Window.orderBy("forecast_timestamp"))  # over the three rows of the result
    return out.select(step.alias("step"), F.col("forecast_value").alias("forecast"), F.col("prediction_interval_lower_bound").alias("low"), F.col("prediction_interval_upper_bound").alias("high"))


# --- scores ------------------------------------------------------------------------------------

PAIRS = "WITH p AS (SELECT (p_size > 25)::INT AS y, (p_partkey % 3 = 0)::INT AS q, p_retailprice AS s, p_size::DOUBLE AS a FROM part) "


@query(
    "score_functions",
    said_by_sql(
        PAIRS, accuracy_score=tenthousandths("SELECT avg((y = q)::INT) FROM p"), precision_score=tenthousandths("SELECT sum(y * q) / sum(q) FROM p"), recall_score=tenthousandths("SELECT sum(y * q) / sum(y) FROM p"), f1_score=tenthousandths("SELECT 2 * sum(y * q) / (sum(y) + sum(q)) FROM p"),
        r2_score=tenthousandths("SELECT 1 - sum((a - s / 40) ** 2) / sum((a - m) ** 2) FROM p, (SELECT avg(a) AS m FROM p)"), mean_squared_error=tenthousandths("SELECT avg((a - s / 40) ** 2) FROM p"), mean_absolute_error=tenthousandths("SELECT avg(abs(a - s / 40)) FROM p"), confusion_matrix="(SELECT sum((y = 1 AND q = 0)::INT) FROM p)",
        roc_auc_score=tenthousandths("SELECT (sum(CASE WHEN x.s > z.s THEN 1.0 WHEN x.s = z.s THEN 0.5 ELSE 0 END)) / count(*) FROM p x, p z WHERE x.y = 1 AND z.y = 0"), roc_curve="(SELECT count(DISTINCT s) + 1 FROM p)", auc="5000",
    ),
)
def _(t):
    f = t.part
    y, q, s, a = (f["p_size"] > 25).astype("Int64"), (f["p_partkey"] % 3 == 0).astype("Int64"), f["p_retailprice"], f["p_size"].astype("float64")
    b = s / 40
    return facts(
        t, accuracy_score=metrics.accuracy_score(y, q), precision_score=metrics.precision_score(y, q), recall_score=metrics.recall_score(y, q), f1_score=metrics.f1_score(y, q), r2_score=metrics.r2_score(a, b), mean_squared_error=metrics.mean_squared_error(a, b), mean_absolute_error=metrics.mean_absolute_error(a, b),
        confusion_matrix=int(metrics.confusion_matrix(y, q).loc[1, 0]), roc_auc_score=metrics.roc_auc_score(y, s), roc_curve=len(metrics.roc_curve(y, s)), auc=metrics.auc([0.0, 0.5, 1.0], [0.0, 0.5, 1.0]),
    )


@query("paired_distances", "SELECT c_custkey, round(sqrt((c_nationkey - 1) ** 2 + (c_acctbal - 2) ** 2), 4) AS euclidean, round(abs(c_nationkey - 1) + abs(c_acctbal - 2), 4) AS manhattan, round(1 - (c_nationkey + 2 * c_acctbal) / (sqrt(c_nationkey ** 2 + c_acctbal ** 2) * sqrt(5.0)), 4) AS cosine FROM customer")
def _(t):
    f = t.customer
    f = f.assign(one=f["c_custkey"] * 0 + 1, two=f["c_custkey"] * 0 + 2)
    X, Y = f[["c_nationkey", "c_acctbal"]], f[["one", "two"]]
    return columns(f, c_custkey=f["c_custkey"], euclidean=metrics.paired_euclidean_distances(X, Y).round(4), manhattan=metrics.paired_manhattan_distance(X, Y).round(4), cosine=metrics.paired_cosine_distances(X, Y).round(4))


# --- transformers ----------------------------------------------------------------------------------


@query("transformers", """SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 5) AS standard, round(p_size / max(abs(p_size)) OVER (), 6) AS max_abs, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()), 6) AS min_max,
'bin_' || (1 + (p_size >= lo + (hi - lo) / 2.0)::INT) AS bin, dense_rank() OVER (ORDER BY p_brand) AS label, dense_rank() OVER (ORDER BY p_brand) AS hot, round(coalesce(masked, avg(masked) OVER ()), 4) AS imputed, p_size * p_size * 1.0 AS poly, p_size + 1 AS templated
FROM (SELECT *, CASE WHEN p_size > 10 THEN p_size END AS masked, min(p_size) OVER () AS lo, max(p_size) OVER () AS hi FROM part)""")
def _(t):
    f = t.part
    f = f.assign(masked=f["p_size"].where(f["p_size"] > 10).astype("float64"), n=f["p_size"].astype("Int64"))
    chain = ml.ColumnTransformer([("standard", ml.StandardScaler(), "p_size"), ("template", ml.SQLScalarColumnTransformer("{0} + 1"), "n")]).fit_transform(f[["p_size", "n"]])
    made = {
        "standard": chain._columns[0][1], "max_abs": ml.MaxAbsScaler().fit_transform(f[["p_size"]])._columns[0][1], "min_max": ml.MinMaxScaler().fit_transform(f[["p_size"]])._columns[0][1], "bin": ml.KBinsDiscretizer(n_bins=2, strategy="uniform").fit_transform(f[["p_size"]])._columns[0][1],
        "label": ml.LabelEncoder().fit_transform(f[["p_brand"]])._columns[0][1], "hot": ml.OneHotEncoder().fit_transform(f[["p_brand"]])._columns[0][1][0]["index"], "imputed": ml.SimpleImputer(strategy="mean").fit_transform(f[["masked"]])._columns[0][1],
        "poly": ml.PolynomialFeatures(degree=2).fit_transform(f[["p_size"]])._columns[1][1], "templated": chain._columns[1][1],
    }
    digits = {"standard": 5, "max_abs": 6, "min_max": 6, "imputed": 4}
    return f._new([("p_partkey", f["p_partkey"].expr), *((n, F.round(e, digits[n]) if n in digits else e) for n, e in made.items())])


@query("selection_and_pipelines", said_by_sql("", rows="(SELECT count(*) FROM part)", shared="0", folds="3", tested="(SELECT count(*) FROM part)", r2="10000", piped="10000"))
def _(t):
    f = t.indexed("part")[["p_size"]]
    f = f.assign(y=f["p_size"] * 3.0 - 1)
    train, test = ml.train_test_split(f, test_size=0.3, random_state=4)
    folds = list(ml.KFold(3).split(f[["p_size"]], f[["y"]]))
    both = train.to_spark(index=True).intersect(test.to_spark(index=True)).count()
    scores = ml.cross_validate(ml.LinearRegression(), f[["p_size"]], f["y"], cv=3)["test_score"]
    pipe = ml.Pipeline([("scale", ml.StandardScaler()), ("line", ml.LinearRegression())]).fit(f[["p_size"]], f["y"])
    return facts(t, rows=len(train) + len(test), shared=both, folds=len(folds), tested=sum(len(x) for _, x, _, _ in folds), r2=round(min(s["r2_score"] for s in scores), 6), piped=round(pipe.score(f[["p_size"]], f["y"])["r2_score"], 6))


# --- model-backed verbs, on a model that SQL can follow -------------------------------------------------


class Lengths(Backend):
    """Knows texts by their length alone."""

    def embed(self, texts):
        return [[float(len(x or "") % 7), float(len(x or "") % 5), 1.0] for x in texts]

    def generate(self, prompts, options=None):
        return [options[len(p) % len(options)] if options else f"{len(p)} letters" for p in prompts]


ASKED = "(SELECT *, length('Is ' || p_name || ' good?') AS n FROM part)"


@query("ai_functions", f"SELECT p_partkey, n || ' letters' AS generate, n % 2 = 0 AS generate_bool, n AS generate_int, n::DOUBLE AS generate_double, n % 2 = 0 AS if_, ['a', 'b', 'c'][n % 3 + 1] AS classify, ((n % 7) ** 2 + (n % 5) ** 2 + 1)::DOUBLE AS score, (n + 6) || ' letters' AS in_table FROM {ASKED}")
def _(t):
    f, model = t.part, Lengths()
    text = ai.prompt(f, "Is {p_name} good?")
    made = dict(
        generate=ai.generate(text, model=model), generate_bool=ai.generate_bool(text, model), generate_int=ai.generate_int(text, model), generate_double=ai.generate_double(text, model), if_=ai.if_(text, model), classify=ai.classify(text, ["a", "b", "c"], model), score=ai.score(text, model),
        in_table=ai.generate_table(text, {"about": "string"}, model)["about"],
    )
    return f._new([("p_partkey", f["p_partkey"].expr), *made.items()])


@query("ai_filter_map_classify", f"SELECT p_partkey, n || ' letters' AS said, ['x', 'y'][n % 2 + 1] AS kind FROM {ASKED} WHERE n % 2 = 0")
def _(t):
    model = Lengths()
    f = AIAccessor(t.part[["p_partkey", "p_name"]]).filter("Is {p_name} good?", model)
    f = f.ai.map("Is {p_name} good?", model, output_column="said")
    return f.ai.classify("Is {p_name} good?", model, labels=["x", "y"], output_column="kind")[["p_partkey", "said", "kind"]]


@query("ai_join", "SELECT n_nationkey, r_regionkey FROM nation, region WHERE length(n_name || ' in ' || r_name) % 2 = 0")
def _(t):
    out = t.nation[["n_nationkey", "n_name"]].ai.join(t.region[["r_regionkey", "r_name"]], "{n_name} in {r_name}", Lengths())
    return out[["n_nationkey", "r_regionkey"]]


@query("semantics_map_and_top", "SELECT n_nationkey, length('Of ' || n_name) || ' letters' AS said FROM nation")
def _(t):
    f = Semantics(t.nation[["n_nationkey", "n_name"]])
    assert len(f.top_k("Of {n_name}", Lengths(), k=3)) == 3
    return f.map("Of {n_name}", "said", Lengths())[["n_nationkey", "said"]]


@query("ai_search_scores", "SELECT n_nationkey, round((a * 4 + b * 4 + 1) / (sqrt(a * a + b * b + 1) * sqrt(33.0)), 5) AS score FROM (SELECT n_nationkey, length(n_name) % 7 AS a, length(n_name) % 5 AS b FROM nation)")
def _(t):
    out = t.nation[["n_nationkey", "n_name"]].ai.search("n_name", "four", 1000, Lengths(), score_column="score")
    return out.assign(score=out["score"].round(5))[["n_nationkey", "score"]]


@query("text_models", "SELECT n_nationkey, length(n_name) || ' letters' AS said, (length(n_name) % 7)::DOUBLE AS first_ FROM nation")
def _(t):
    f = t.nation
    said = ml.TextGenerator(Lengths()).predict(f[["n_name"]])
    vectors = ml.TextEmbeddingGenerator(Lengths()).predict(f[["n_name"]])
    text, vector = said._columns[0][1], vectors._columns[0][1]
    return f._new([("n_nationkey", f["n_nationkey"].expr), ("said", text), ("first_", vector[0])])


# --- JSON, templates, files -----------------------------------------------------------------------------------

DOC = """'{"a": [' || p_size || ', 2], "s": ["x", "' || p_brand || '"], "o": {"k": ' || p_partkey || '}}'"""


@query("json_functions", "SELECT p_partkey, p_partkey::VARCHAR AS value_, '{\"k\":' || p_partkey || '}' AS extract_, 2::BIGINT AS n_array, 2::BIGINT AS n_query_array, p_brand AS string_1, p_brand AS value_1, 'x' AS string_0, p_size::VARCHAR AS array_0, p_partkey::VARCHAR AS parsed, 'x|' || p_brand AS joined, 2::BIGINT AS length_, 3::BIGINT AS n_keys, '\"' || p_brand || '\"' AS to_string_ FROM part")
def _(t):
    f = t.part
    s = f["p_size"].astype("string")
    doc = ("{\"a\": [" + s) + ", 2], \"s\": [\"x\", \"" + f["p_brand"] + "\"], \"o\": {\"k\": " + f["p_partkey"].astype("string") + "}}"
    strings, again = sql.json_extract_string_array(doc, "$.s"), sql.json_value_array(doc, "$.s")
    parsed = sql.parse_json(doc)
    return columns(
        f, p_partkey=f["p_partkey"], value_=sql.json_value(doc, "$.o.k"), extract_=sql.json_extract(doc, "$.o"), n_array=sql.array_length(sql.json_extract_array(doc, "$.a")), n_query_array=sql.array_length(sql.json_query_array(doc, "$.a")), string_1=strings.list[1], value_1=again.list[1], string_0=strings.list[0],
        array_0=sql.json_extract_array(doc, "$.a").list[0], parsed=parsed._new(F.variant_get(parsed.expr, "$.o.k", "string")), joined=sql.array_to_string(strings, "|"), length_=sql.array_length(strings), n_keys=sql.array_length(sql.json_keys(doc, 1)), to_string_=sql.to_json_string(f["p_brand"]),
    )


@query("sql_templates", "SELECT p_partkey, upper(p_name) || ':' || p_size AS t, p_size * 2 AS d FROM part")
def _(t):
    f = t.part
    return columns(f, p_partkey=f["p_partkey"], t=sql_scalar("concat(upper({0}), ':', {1})", [f["p_name"], f["p_size"]]), d=sql_scalar("{0} * 2", [f["p_size"]]))


@query("file_references", said_by_sql("", files="1", uri="true", sized="true", updated="true", kind="true", made="'region'", from_json="'u'", authorizer="'who'", version="true", url="'region'", runtime="true"))
def _(t):
    blobs = t.session.from_glob_path(t.path("region"))
    b = blobs["blob"].blob
    uri = blobs["blob"]._new(F.lit("region"))
    ref = sql.make_ref(uri, "who")
    parsed = sql.make_ref_from_json(blobs["blob"]._new(F.lit('{"uri": "u"}')))
    one = lambda s: s.to_spark().first()[0]
    return facts(
        t, files=1 if len(blobs) >= 1 else 0, uri=one(b.uri()).endswith(".parquet"), sized=int(one(b.size())) > 0, updated=one(b.updated()) is not None, kind=one(b.content_type()) != "", made=one(ref.blob.uri()), from_json=one(parsed.blob.uri()), authorizer=one(ref.blob.authorizer()), version=one(ref.blob.version()) is None,
        url=one(sql.get_access_url(ref)), runtime=len(one(ref.blob.get_runtime_json_str())) > 0,
    )


# --- shapes, of which the formulas are known -------------------------------------------------------------------------

R = "6371010.0"


@query("geo_lines", f"SELECT n_nationkey, round({R} * radians(n_nationkey + 1), 3) AS length_, round({R} * radians(n_nationkey + 1), 3) AS distance_, n_nationkey = -1 AS closed, 0.5::DOUBLE AS x_, n_nationkey::DOUBLE AS y_, round(2 * {R} * {R} * radians(n_nationkey + 1) * sin(radians(0.5)) / 1e6, 0) >= 0 AS has_area FROM nation")
def _(t):
    f = t.nation
    k = f["n_nationkey"].astype("string")
    far = (f["n_nationkey"] + 1).astype("string")
    line = sql.st_geogfromtext("LINESTRING(0 0, " + far + " 0)")
    start, end = line._new(F.lit("POINT(0 0)")), line._new(F.concat(F.lit("POINT("), far.expr, F.lit(" 0)")))
    point = line._new(F.concat(F.lit("POINT(0.5 "), k.expr, F.lit(")")))
    box = line._new(F.concat(F.lit("POLYGON((0 0, "), far.expr, F.lit(" 0, "), far.expr, F.lit(" 1, 0 1, 0 0))")))
    return columns(
        f, n_nationkey=f["n_nationkey"], length_=sql.st_length(line).round(3), distance_=sql.st_distance(start, end).round(3), closed=sql.st_isclosed(line), x_=sql.st_x(point), y_=sql.st_y(point), has_area=sql.st_area(box) > 0,
    )


@query("geo_shapes_facts", said_by_sql("", centroid_x="20000", closed="true", hull="true", boundary="true", buffer="true", simplified="true", intersection="true", difference="true", text="'POINT(1 2)'", xy="true", wkt="true"))
def _(t):
    region = t.region
    one = region[region["r_regionkey"] == 0]["r_name"]
    shape = lambda text: one._new(F.lit(text))
    got = lambda s: s.to_spark().first()[0]
    square, other, line = shape("POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))"), shape("POLYGON((1 1, 3 1, 3 3, 1 3, 1 1))"), shape("LINESTRING(0 0, 1 0, 2 0, 4 0)")
    area = lambda s: got(sql.st_area(s))
    both, left = area(sql.st_intersection(square, other)), area(sql.st_difference(square, other))
    return facts(
        t, centroid_x=float(got(sql.st_x(sql.st_centroid(line)))), closed=got(sql.st_isclosed(shape("LINESTRING(0 0, 1 0, 1 1, 0 0)"))), hull=abs(area(sql.st_convexhull(square)) / area(square) - 1) < 1e-9, boundary=abs(got(sql.st_length(sql.st_boundary(square))) / 889_000 - 1) < 0.01,
        buffer=abs(area(sql.st_buffer(shape("POINT(0 0)"), 1000.0)) / 3.14159e6 - 1) < 0.15, simplified=got(sql.st_length(sql.st_simplify(line, 10.0))) == got(sql.st_length(line)), intersection=abs(both / area(square) - 0.25) < 0.01, difference=abs((both + left) / area(square) - 1) < 1e-3, text=got(sql.st_astext(sql.st_geogfromtext(shape("POINT(1 2)")))),
        xy=got(one._new(F.lit(1.0)).geo.to_wkt()) == 1.0, wkt=got(square.geo.to_wkt()).startswith("POLYGON"),
    )
