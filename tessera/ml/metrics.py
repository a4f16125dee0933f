"""Scores of predictions, each by one aggregation."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vector
from ..plans.frame import Series


def _pair(y, p):
    me, o = y._with(p)
    return me.rows.sdf, me.expr, o.col


def r2_score(y, p, force_finite=True) -> float:
    sdf, a, b = _pair(y, p)
    row = sdf.agg(F.sum(F.pow(a - b, F.lit(2))).alias("e"), (F.var_pop(a) * F.count(a)).alias("t")).first()
    return 1 - row["e"] / row["t"] if row["t"] else (1.0 if not row["e"] else 0.0)


def accuracy_score(y, p, normalize=True) -> float:
    sdf, a, b = _pair(y, p)
    hit = (a == b).cast("double")
    return sdf.agg(F.avg(hit) if normalize else F.sum(hit)).first()[0]


def mean_squared_error(y, p) -> float:
    sdf, a, b = _pair(y, p)
    return sdf.agg(F.avg(F.pow(a - b, F.lit(2)))).first()[0]


def mean_absolute_error(y, p) -> float:
    sdf, a, b = _pair(y, p)
    return sdf.agg(F.avg(F.abs(a - b))).first()[0]


def confusion_matrix(y, p) -> pd.DataFrame:
    sdf, a, b = _pair(y, p)
    got = sdf.groupBy(a.alias("y"), b.alias("p")).count().toPandas()
    out = got.pivot(index="y", columns="p", values="count").fillna(0).astype(int)
    labels = sorted(set(out.index) | set(out.columns))
    return out.reindex(index=labels, columns=labels, fill_value=0)


def _per_class(y, p) -> pd.DataFrame:
    m = confusion_matrix(y, p)
    hit = pd.Series({k: m.loc[k, k] for k in m.index})
    return pd.DataFrame({"precision": (hit / m.sum(0)).fillna(0.0), "recall": (hit / m.sum(1)).fillna(0.0), "f1": (2 * hit / (m.sum(0) + m.sum(1))).fillna(0.0)})


def _averaged(values: pd.Series, average, pos_label):
    if average == "binary":
        return float(values[pos_label if pos_label in values.index else max(values.index)])
    return float(values.mean()) if average == "macro" else values


def recall_score(y, p, average="binary", pos_label=1):
    return _averaged(_per_class(y, p)["recall"], average, pos_label)


def precision_score(y, p, pos_label=1, average="binary"):
    return _averaged(_per_class(y, p)["precision"], average, pos_label)


def f1_score(y, p, average="binary", pos_label=1):
    return _averaged(_per_class(y, p)["f1"], average, pos_label)


def roc_curve(y, score, drop_intermediate=True) -> pd.DataFrame:
    """Rates at every distinct score, counted per score before the running sums."""
    sdf, a, b = _pair(y, score)
    per = sdf.groupBy(b.alias("thresholds")).agg(F.sum(a.cast("int")).alias("tp"), F.sum(1 - a.cast("int")).alias("fp"))
    w = Window.orderBy(F.desc("thresholds"))
    run = per.select("thresholds", F.sum("tp").over(w).alias("tp"), F.sum("fp").over(w).alias("fp")).toPandas().sort_values("thresholds", ascending=False)
    head = pd.DataFrame({"thresholds": [float("inf")], "tp": [0], "fp": [0]})
    run = pd.concat([head, run], ignore_index=True)
    return pd.DataFrame({"fpr": run["fp"] / max(1, run["fp"].iloc[-1]), "tpr": run["tp"] / max(1, run["tp"].iloc[-1]), "thresholds": run["thresholds"]})


def auc(x, y) -> float:
    x, y = list(x), list(y)
    return abs(sum((b - a) * (p + q) / 2 for a, b, p, q in zip(x, x[1:], y, y[1:])))


def roc_auc_score(y, score) -> float:
    c = roc_curve(y, score)
    return auc(c["fpr"], c["tpr"])


def _arrays(f, X, Y):
    a = F.array(*(e.cast("double") for _, e in X._columns))
    b = F.array(*(e.cast("double") for _, e in Y._columns))
    return Series(X.rows, f(a, b), None)


paired_cosine_distances = functools.partial(_arrays, vector.cosine)
paired_manhattan_distance = functools.partial(_arrays, vector.manhattan)
paired_euclidean_distances = functools.partial(_arrays, vector.euclidean)
