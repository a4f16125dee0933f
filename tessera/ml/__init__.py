"""Estimators and transformers over frames, on Spark ML."""

from __future__ import annotations

import functools

from pyspark.ml import Pipeline as SparkPipeline
from pyspark.ml import PipelineModel, classification, clustering, feature, recommendation, regression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.frame import DataFrame, Series
from ..plans.rows import Rows
from . import metrics
from .metrics import auc, roc_curve

__all__ = ["metrics", "auc", "roc_curve"]


def _frame(x) -> DataFrame:
    return x.to_frame() if isinstance(x, Series) else x


def vector(frame: DataFrame):
    """All columns as one vector: numbers, booleans, and arrays."""
    parts = [s.expr.cast("array<double>") if isinstance(s.dtype, T.ArrayType) else F.array(s.expr.cast("double")) for s in frame._series()]
    return array_to_vector(functools.reduce(lambda a, b: F.concat(a, b), parts))


#: Rows a training task holds at most, about; Spark ML keeps the training set by partitions and reads each anew every round.
SHARE = 100_000


def _spread(sdf):
    """Training rows dealt evenly over tasks by their number: files may come as a few large pieces."""
    return sdf.repartition(max(sdf.sparkSession.sparkContext.defaultParallelism, -(-n // SHARE))) if (n := sdf.count()) > SHARE else sdf


class Estimator:
    """Fit on a frame of features (and labels); predictions keep the frame's rows."""

    make = None
    label = "label"
    defaults: dict = {}

    def __init__(self, **params):
        self.params = {**self.defaults, **params}
        self.model = None

    def _data(self, X: DataFrame, y=None):
        X = _frame(X)
        if y is not None:
            y = _frame(y)
            if y.rows is not X.rows:
                X, y = X.assign(__label=y.iloc_column(0)).pipe(lambda d: (d.drop(columns="__label"), d[["__label"]]))
        sdf = X.rows.sdf.withColumns({"features": vector(X), **({"label": y._columns[0][1]} if y is not None else {})})
        return X, sdf.dropna(subset=["features", *(["label"] if y is not None else [])]) if y is not None else sdf

    def fit(self, X, y=None, X_eval=None, y_eval=None):
        X, sdf = self._data(X, y)
        if y is not None and isinstance(sdf.schema["label"].dataType, (T.StringType, T.BooleanType)):
            self.classes = sorted(r[0] for r in sdf.select("label").distinct().collect())
            mapping = F.create_map(*(F.lit(v) for k, c in enumerate(self.classes) for v in (c, float(k))))
            sdf = sdf.withColumn("label", mapping[F.col("label")])
        else:
            self.classes = None
            if y is not None:
                sdf = sdf.withColumn("label", F.col("label").cast("double"))
        self.model = type(self).make(**self._spark()).fit(_spread(sdf.select("features", *(["label"] if y is not None else []))))
        return self

    def _spark(self) -> dict:
        return self.params

    def _predicted(self, X) -> tuple[DataFrame, object]:
        X = _frame(X)._stored()
        sdf = self.model.transform(X.rows.sdf.withColumn("features", vector(X)))
        return X, sdf

    def predict(self, X) -> DataFrame:
        X, sdf = self._predicted(X)
        expr = F.col("prediction")
        if self.classes:
            expr = F.element_at(F.array(*(F.lit(c) for c in self.classes)), (F.col("prediction") + 1).cast("int"))
        name = f"predicted_{self.label}"
        extra = [("probabilities", vector_to_array("probability"))] if "probability" in sdf.columns else []
        return DataFrame(Rows(sdf, X.rows.index, X.rows.names, X.rows.order), [(name, expr), *extra, *X._columns])

    def score(self, X, y) -> dict:
        X = _frame(X).assign(__y=_frame(y).iloc_column(0))
        out = self.predict(X.drop(columns="__y"))
        p = out[f"predicted_{self.label}"]
        y_true = Series(out.rows, X._column("__y"), "y") if X.rows is out.rows else None
        if y_true is None:
            both = X._stored()
            p = self.predict(both.drop(columns="__y"))
            y_true, p = Series(p.rows, both._column("__y"), "y"), p[f"predicted_{self.label}"]
        return self._scores(y_true, p)

    def _scores(self, y, p) -> dict:
        return {"mean_absolute_error": metrics.mean_absolute_error(y, p), "mean_squared_error": metrics.mean_squared_error(y, p), "r2_score": metrics.r2_score(y, p)}

    def save(self, path: str):
        self.model.write().overwrite().save(path)
        return path

    to_model = save


class _Classifier(Estimator):
    def _scores(self, y, p):
        return {"accuracy": metrics.accuracy_score(y, p), "f1_score": metrics.f1_score(y, p), "precision": metrics.precision_score(y, p), "recall": metrics.recall_score(y, p)}


class LinearRegression(Estimator):
    make = regression.LinearRegression

    @property
    def coef_(self):
        return list(self.model.coefficients)

    @property
    def intercept_(self):
        return self.model.intercept

    def predict_explain(self, X, top_k_features: int = 5):
        """Predictions with each feature's share: coefficient times value."""
        out = self.predict(X)
        names = [n for n, _ in out._columns[1:]]
        parts = F.array(*(F.struct(F.lit(str(n)).alias("feature"), (out._column(n).cast("double") * F.lit(float(c))).alias("attribution")) for n, c in zip(names, self.coef_)))
        ranked = F.slice(F.reverse(F.array_sort(parts, lambda a, b: F.when(F.abs(a["attribution"]) < F.abs(b["attribution"]), -1).otherwise(1))), 1, top_k_features)
        return out._new([*out._columns, ("top_feature_attributions", ranked), ("baseline_prediction_value", F.lit(float(self.intercept_)))])

    def global_explain(self):
        return {k: abs(c) for k, c in enumerate(self.coef_)}


class LogisticRegression(_Classifier):
    make = classification.LogisticRegression

    predict_explain = Estimator.predict


class RandomForestRegressor(Estimator):
    make = regression.RandomForestRegressor
    defaults = {"seed": 1}


class RandomForestClassifier(_Classifier):
    make = classification.RandomForestClassifier
    defaults = {"seed": 1}


class XGBRegressor(Estimator):
    make = regression.GBTRegressor
    defaults = {"seed": 1}


class XGBClassifier(_Classifier):
    make = classification.GBTClassifier
    defaults = {"seed": 1}


class KMeans(Estimator):
    make = clustering.KMeans

    def _spark(self):
        return {"k": self.params.get("n_clusters", 8), "seed": self.params.get("random_state", 1)}

    @property
    def cluster_centers_(self):
        return [list(c) for c in self.model.clusterCenters()]

    def predict(self, X):
        X, sdf = self._predicted(X)
        centres = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in self.cluster_centers_))
        from ..functions.vector import euclidean

        gap = euclidean(vector_to_array("features"), F.get(centres, F.col("prediction")))
        return DataFrame(Rows(sdf, X.rows.index, X.rows.names, X.rows.order), [("centroid_id", F.col("prediction") + 1), ("distance", gap), *X._columns])

    def detect_anomalies(self, X, contamination: float = 0.1):
        out = self.predict(X)._stored()
        edge = out["distance"].quantile(1 - contamination)
        return out.assign(is_anomaly=out["distance"] > edge)

    def score(self, X, y=None):
        out = self.predict(X)
        d = out["distance"]
        return {"mean_squared_distance": (d * d).mean()}


class PCA(Estimator):
    make = feature.PCA

    def _spark(self):
        return {"k": self.params.get("n_components", 2), "inputCol": "features", "outputCol": "components"}

    @property
    def components_(self):
        return self.model.pc.toArray().T.tolist()

    @property
    def explained_variance_ratio_(self):
        return self.model.explainedVariance.toArray().tolist()

    def predict(self, X):
        X, sdf = self._predicted(X)
        k = self._spark()["k"]
        parts = vector_to_array("components")
        return DataFrame(Rows(sdf, X.rows.index, X.rows.names, X.rows.order), [*((f"principal_component_{i + 1}", parts[i]) for i in range(k)), *X._columns])

    def detect_anomalies(self, X, contamination: float = 0.1):
        out = self.predict(X)._stored()
        k = self._spark()["k"]
        norm = functools.reduce(lambda a, b: a + b, (out[f"principal_component_{i + 1}"] ** 2 for i in range(k)))
        out = out.assign(mean_squared_error=norm)
        return out.assign(is_anomaly=out["mean_squared_error"] > out["mean_squared_error"].quantile(1 - contamination))


class MatrixFactorization:
    def __init__(self, *, num_factors=10, user_col="user_id", item_col="item_id", rating_col="rating", l2_reg=0.1, feedback_type="explicit"):
        self.cols = user_col, item_col, rating_col
        self.als = recommendation.ALS(rank=num_factors, userCol="__u", itemCol="__i", ratingCol="__r", regParam=l2_reg, implicitPrefs=feedback_type == "implicit", coldStartStrategy="nan", seed=1)

    def _ids(self, X: DataFrame, fit: bool):
        sdf = X.to_spark()
        u, i, _ = self.cols
        if fit:
            self.indexer = SparkPipeline(stages=[feature.StringIndexer(inputCol=c, outputCol=o, handleInvalid="keep") for c, o in ((u, "__u"), (i, "__i"))]).fit(sdf)
        return self.indexer.transform(sdf)

    def fit(self, X: DataFrame, y=None):
        self.model = self.als.fit(self._ids(X, True).withColumn("__r", F.col(self.cols[2]).cast("float")))
        return self

    def predict(self, X: DataFrame) -> DataFrame:
        out = self.model.transform(self._ids(X, False))
        return DataFrame.from_spark(out.select(F.col("prediction").alias(f"predicted_{self.cols[2]}"), *X.columns))

    def score(self, X, y=None):
        out = self.predict(X)
        return {"mean_squared_error": metrics.mean_squared_error(out[self.cols[2]], out[f"predicted_{self.cols[2]}"])}


class ARIMAPlus:
    """A trend model for each series (Holt's linear smoothing)."""

    def __init__(self, horizon: int = 1000, **_):
        self.horizon = horizon

    def fit(self, X, y, id_col=None):
        X, y = _frame(X), _frame(y)
        ids = [] if id_col is None else [_frame(id_col)._columns[0]]
        self.ids = [n for n, _ in ids]
        self.data = X.rows.sdf.select(X._columns[0][1].alias("t"), y._columns[0][1].alias("y"), *(e.alias(n) for n, e in ids))
        return self

    def predict(self, X=None, *, horizon: int = 3, confidence_level: float = 0.95):
        from ..ai import forecast

        return DataFrame.from_spark(forecast(self.data, "t", "y", self.ids, horizon, confidence_level))

    predict_explain = predict

    def detect_anomalies(self, X=None, *, anomaly_prob_threshold: float = 0.95):
        of = {c: f"__id{k}" for k, c in enumerate(self.ids)}
        known = self.data.groupBy(*(F.col(c).alias(k) for c, k in of.items())).agg(F.avg("y").alias("__mean"), F.stddev_samp("y").alias("__std"))
        same = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(k)) for c, k in of.items()), F.lit(True))
        out = self.data.join(known, same) if of else self.data.crossJoin(known)
        out = out.withColumn("z", (F.col("y") - F.col("__mean")) / F.nullif(F.col("__std"), F.lit(0.0))).drop(*of.values(), "__mean", "__std")
        return DataFrame.from_spark(out.withColumn("is_anomaly", F.abs("z") > (1.96 if anomaly_prob_threshold == 0.95 else 2.58)))

    def summary(self):
        return DataFrame.from_spark(self.data.groupBy(*self.ids).agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std")))

    coef_ = property(summary)


# --- transformers -----------------------------------------------------------------


class Transformer:
    """Statistics are fitted by one aggregation; transforming is a projection."""

    prefix = ""

    def __init__(self, **params):
        self.params = params

    def stats(self, s: Series) -> dict:
        raise NotImplementedError

    def apply(self, s: Series, stat: dict):
        raise NotImplementedError

    def fit(self, X, y=None):
        X = _frame(X)
        named = {(s.name, k): e for s in X._series() for k, e in self.stats(s).items()}
        got = X.rows.sdf.agg(*(e.alias(f"a{i}") for i, e in enumerate(named.values()))).first()
        self.fitted = {s.name: {} for s in X._series()}
        for i, (n, k) in enumerate(named):
            self.fitted[n][k] = got[i]
        return self

    def transform(self, X) -> DataFrame:
        X = _frame(X)
        return X._new([(f"{self.prefix}_{s.name}", self.apply(s, self.fitted[s.name])) for s in X._series()])

    def fit_transform(self, X, y=None):
        return self.fit(X, y).transform(X)


class StandardScaler(Transformer):
    prefix = "standard_scaled"

    def stats(self, s):
        return {"mean": F.avg(s.expr), "std": F.stddev_samp(s.expr)}

    def apply(self, s, stat):
        return (s.expr - F.lit(stat["mean"])) / F.lit(stat["std"] or 1.0)


class MaxAbsScaler(Transformer):
    prefix = "max_abs_scaled"

    def stats(self, s):
        return {"m": F.max(F.abs(s.expr))}

    def apply(self, s, stat):
        return s.expr / F.lit(float(stat["m"] or 1.0))


class MinMaxScaler(Transformer):
    prefix = "min_max_scaled"

    def stats(self, s):
        return {"lo": F.min(s.expr), "hi": F.max(s.expr)}

    def apply(self, s, stat):
        return (s.expr - F.lit(stat["lo"])) / F.lit(float((stat["hi"] - stat["lo"]) or 1.0))


class KBinsDiscretizer(Transformer):
    prefix = "kbinsdiscretizer"

    def stats(self, s):
        n = self.params.get("n_bins", 5)
        if self.params.get("strategy", "quantile") == "uniform":
            return {"lo": F.min(s.expr), "hi": F.max(s.expr)}
        return {"q": F.percentile_approx(s.expr, [k / n for k in range(1, n)])}

    def apply(self, s, stat):
        n = self.params.get("n_bins", 5)
        edges = stat["q"] if "q" in stat else [stat["lo"] + (stat["hi"] - stat["lo"]) * k / n for k in range(1, n)]
        return F.concat(F.lit("bin_"), (functools.reduce(lambda a, e: a + (s.expr >= F.lit(e)).cast("int"), edges, F.lit(1))).cast("string"))


class SimpleImputer(Transformer):
    prefix = "imputer"

    def stats(self, s):
        how = self.params.get("strategy", "mean")
        return {"v": {"mean": F.avg(s.expr), "median": F.percentile_approx(s.expr, 0.5), "most_frequent": F.mode(s.expr)}[how]}

    def apply(self, s, stat):
        return F.coalesce(s.expr, F.lit(stat["v"]))


class LabelEncoder(Transformer):
    """Ranks of the values in order, from 1; unknown ones are 0.  More values than ``most`` are an error."""

    prefix = "labelencoded"
    most = 1_000_000

    def fit(self, X, y=None):
        X = _frame(X)
        self.fitted = {}
        for s in X._series():
            counted = X.rows.sdf.groupBy(s.expr.alias("v")).count().where("v IS NOT NULL")
            if most := self.params.get("max_categories"):
                rows = counted.orderBy(F.desc("count"), "v").limit(most).collect()
            elif len(rows := counted.limit(self.most + 1).collect()) > self.most:
                raise ValueError(f"{s.name} has more than {self.most} values; give max_categories")
            least = self.params.get("min_frequency") or 0
            self.fitted[s.name] = {v: k + 1 for k, v in enumerate(sorted(r["v"] for r in rows if r["count"] >= least))}
        return self

    def apply(self, s, stat):
        if not stat:
            return F.lit(0)
        return F.coalesce(F.create_map(*(F.lit(x) for kv in stat.items() for x in kv))[s.expr], F.lit(0))


class OneHotEncoder(LabelEncoder):
    """One struct (index, value) for each value, as a sparse vector with a single one."""

    prefix = "onehotencoded"

    def apply(self, s, stat):
        return F.array(F.struct(LabelEncoder.apply(self, s, stat).alias("index"), F.lit(1.0).alias("value")))


class PolynomialFeatures(Transformer):
    def __init__(self, degree: int = 2):
        super().__init__(degree=degree)

    def fit(self, X, y=None):
        return self

    def transform(self, X):
        from itertools import combinations_with_replacement

        X = _frame(X)
        cols = X._series()
        out = []
        for d in range(1, self.params["degree"] + 1):
            for chosen in combinations_with_replacement(cols, d):
                out.append(("poly_feat_" + "_".join(str(s.name) for s in chosen), functools.reduce(lambda a, b: a * b, (s.expr.cast("double") for s in chosen))))
        return X._new(out)


class SQLScalarColumnTransformer:
    """SQL text with {0} for the column."""

    def __init__(self, sql: str, target_column: str = "transformed_{0}"):
        self.sql, self.target = sql, target_column


class ColumnTransformer:
    def __init__(self, transformers):
        self.transformers_ = transformers

    def fit(self, X, y=None):
        for _, tr, cols in self.transformers_:
            if hasattr(tr, "fit"):
                tr.fit(X[[cols] if isinstance(cols, str) else list(cols)])
        return self

    def transform(self, X):
        from ..functions.templates import sql_scalar

        out = []
        for _, tr, cols in self.transformers_:
            cols = [cols] if isinstance(cols, str) else list(cols)
            if isinstance(tr, SQLScalarColumnTransformer):
                out += [(tr.target.format(c), sql_scalar(tr.sql, [X[c]]).expr) for c in cols]
            else:
                out += tr.transform(X[cols])._columns
        return X._new(out)

    def fit_transform(self, X, y=None):
        return self.fit(X, y).transform(X)


class Pipeline:
    def __init__(self, steps):
        self.steps = steps

    def fit(self, X, y=None):
        for _, tr in self.steps[:-1]:
            X = tr.fit(X).transform(X)
        self.steps[-1][1].fit(X, y) if y is not None else self.steps[-1][1].fit(X)
        return self

    def _through(self, X):
        for _, tr in self.steps[:-1]:
            X = tr.transform(X)
        return X

    def predict(self, X):
        return self.steps[-1][1].predict(self._through(X))

    def score(self, X, y):
        return self.steps[-1][1].score(self._through(X), y)


# --- selection ------------------------------------------------------------------------


def _fold(frame: DataFrame, seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), *(F.col(c) for c in frame.rows.total_order())), F.lit(1_000_000)) / 1_000_000.0


def train_test_split(*frames, test_size=None, train_size=None, random_state: int = 0, stratify=None, shuffle=True):
    """Rows dealt by a seeded hash of their order key, the same for every frame of the same rows."""
    share = test_size if test_size is not None else 1 - train_size if train_size is not None else 0.25
    out = []
    for f in frames:
        part = f.to_frame() if isinstance(f, Series) else f
        name = part.rows.put(_fold(part, random_state))[0]
        for cond in (F.col(name) >= share, F.col(name) < share):
            got = part._filtered(cond)
            out.append(got.iloc_column(0) if isinstance(f, Series) else got)
    return out


class KFold:
    def __init__(self, n_splits: int = 5, *, random_state: int = 0):
        self.n, self.seed = n_splits, random_state

    def get_n_splits(self):
        return self.n

    def split(self, X, y=None):
        X = _frame(X)
        name = X.rows.put(F.floor(_fold(X, self.seed) * self.n).cast("int"))[0]
        for k in range(self.n):
            parts = []
            for f in (X, _frame(y) if y is not None else None):
                if f is not None:
                    parts += [DataFrame(f._taken(X.rows.sdf.where(F.col(name) != k)), f._columns), DataFrame(f._taken(X.rows.sdf.where(F.col(name) == k)), f._columns)]
                else:
                    parts += [None, None]
            yield tuple(parts)


def cross_validate(estimator, X, y, cv: int | KFold = 5):
    cv = KFold(cv) if isinstance(cv, int) else cv
    scores = []
    for X_train, X_test, y_train, y_test in cv.split(X, y):
        scores.append(estimator.fit(X_train, y_train).score(X_test, y_test))
    return {"test_score": scores}


class TextEmbeddingGenerator:
    def __init__(self, model=None):
        from ..ai import DEFAULT

        self.model = model or DEFAULT

    def predict(self, X):
        from ..ai import embed

        X = _frame(X)
        return X._new([("ml_generate_embedding_result", embed(X._columns[0][1], self.model)), *X._columns])


class TextGenerator(TextEmbeddingGenerator):
    def predict(self, X, **_):
        from ..ai import generate

        X = _frame(X)
        return X._new([("ml_generate_text_llm_result", generate(X._columns[0][1], "string", self.model)), *X._columns])

    def score(self, X, y):
        out = self.predict(X)
        return {"accuracy": metrics.accuracy_score(_frame(y).iloc_column(0), out.iloc_column(0))}


class ONNXModel:
    """A model file run in the tasks by onnxruntime, one session a worker."""

    def __init__(self, model_path: str, output: str = "output", kind: str = "array<double>"):
        self.path, self.output, self.kind = model_path, output, kind

    def predict(self, X):
        import pandas as pd

        path = self.path

        @functools.lru_cache(maxsize=1)
        def session():
            import onnxruntime

            return onnxruntime.InferenceSession(path)

        @F.pandas_udf(self.kind)
        def run(v: pd.Series) -> pd.Series:
            import numpy as np

            s = session()
            got = s.run(None, {s.get_inputs()[0].name: np.array(v.tolist(), np.float32)})[0]
            return pd.Series(got.reshape(len(v), -1).astype(float).tolist())

        X = _frame(X)
        return X._new([(self.output, run(vector_to_array(vector(X)))), *X._columns])


def load(path: str):
    return PipelineModel.load(path)


