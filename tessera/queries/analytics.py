"""Windows, streams, models and model-backed operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.frame import DataFrame
from .registry import query

W = "OVER (ORDER BY event_id)"
U = "OVER (PARTITION BY user_id ORDER BY event_id"


def _events(f, /, **cols):
    return DataFrame(f.rows, [("event_id", f["event_id"].expr), *((n, s.expr) for n, s in cols.items())])


@query("shift_diff", f"SELECT event_id, lag(value, 1) {W} AS s1, lead(value, 2) {W} AS s2, round(value - lag(value, 1) {W}, 6) AS d, round(value / lag(value, 1) {W} - 1, 6) AS p FROM events WHERE value <> 0")
def _(t):
    f = t.events
    f = f[f["value"] != 0]
    x = f["value"]
    return _events(f, s1=x.shift(1), s2=x.shift(-2), d=x.diff().round(6), p=x.pct_change().round(6))


@query("cumulative", "SELECT event_id, round(sum(value) OVER (ORDER BY event_id), 4) AS cs FROM events")
def _(t):
    f = t.events
    c = f[["event_id", "value"]]
    s = c["value"].cumsum()
    return DataFrame(s.rows, [("event_id", F.col("event_id")), ("cs", F.round(s.expr, 4))])


@query("cumulative_extremes", "SELECT event_id, max(value) OVER (ORDER BY event_id) AS hi FROM events")
def _(t):
    s = t.events["value"].cummax()
    return DataFrame(s.rows, [("event_id", F.col("event_id")), ("hi", s.expr)])


@query("rank_methods", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS av, rank() OVER (ORDER BY p_size)::DOUBLE AS mn, (rank() OVER (ORDER BY p_size) + count(*) OVER (PARTITION BY p_size) - 1)::DOUBLE AS mx, dense_rank() OVER (ORDER BY p_size)::DOUBLE AS de, row_number() OVER (ORDER BY p_size, p_partkey)::DOUBLE AS fi, rank() OVER (ORDER BY p_size DESC)::DOUBLE AS ds FROM part")
def _(t):
    f = t.part
    x = f["p_size"]
    return DataFrame(f.rows, [("p_partkey", f["p_partkey"].expr), *((n, x.rank(method=m, ascending=a).expr) for n, m, a in (("av", "average", True), ("mn", "min", True), ("mx", "max", True), ("de", "dense", True), ("fi", "first", True), ("ds", "min", False)))])


@query("rank_grouped", "SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal)::DOUBLE AS r FROM customer")
def _(t):
    f = t.customer
    g = f.groupby("c_mktsegment")
    r = g["c_acctbal"].rank(method="min")
    return DataFrame(r.rows, [("c_custkey", F.col("c_custkey")), ("r", r.expr)])


@query("rolling_rows", "SELECT event_id, CASE WHEN count(value) OVER w >= 5 THEN round(avg(value) OVER w, 6) END AS m, CASE WHEN count(value) OVER w >= 5 THEN max(value) OVER w END AS mx, CASE WHEN count(value) OVER w >= 5 THEN round(sum(value) OVER w, 4) END AS s FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def _(t):
    f = t.events
    r = f["value"].rolling(5)
    return _events(f, m=r.mean().round(6), mx=r.max(), s=r.sum().round(4))


@query("rolling_closed", "SELECT event_id, CASE WHEN count(value) OVER w >= 1 THEN min(value) OVER w END AS v FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)")
def _(t):
    f = t.events
    return _events(f, v=f["value"].rolling(3, min_periods=1, closed="left").min())


@query("rolling_time", "SELECT event_id, count(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999' SECOND PRECEDING AND CURRENT ROW) AS n FROM events")
def _(t):
    f = t.events
    n = f.groupby("user_id")["value"].rolling("1D", on="ts").count()
    return DataFrame(n.rows, [("event_id", F.col("event_id")), ("n", n.expr)])


@query("expanding", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS m, count(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n FROM events")
def _(t):
    f = t.events
    e = f.groupby("user_id")["value"].expanding()
    return DataFrame((m := e.mean()).rows, [("event_id", F.col("event_id")), ("m", F.round(m.expr, 6)), ("n", e.count().expr)])


@query("grouped_cumulative", f"SELECT event_id, round(sum(value) {U} ROWS UNBOUNDED PRECEDING), 4) AS cs, max(value) {U} ROWS UNBOUNDED PRECEDING) AS cm, min(value) {U} ROWS UNBOUNDED PRECEDING) AS cn, row_number() {U}) - 1 AS cc FROM events")
def _(t):
    g = t.events.groupby("user_id")
    v = g["value"]
    a, b, c, d = v.cumsum(), v.cummax(), v.cummin(), g.cumcount()
    return DataFrame(a.rows, [("event_id", F.col("event_id")), ("cs", F.round(a.expr, 4)), ("cm", b.expr), ("cn", c.expr), ("cc", d.expr)])


@query("grouped_shift_diff", f"SELECT event_id, lag(value) {U}) AS s, round(value - lag(value) {U}), 6) AS d FROM events")
def _(t):
    v = t.events.groupby("user_id")["value"]
    s, d = v.shift(1), v.diff(1)
    return DataFrame(s.rows, [("event_id", F.col("event_id")), ("s", s.expr), ("d", F.round(d.expr, 6))])


@query("grouped_head", "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 3")
def _(t):
    return t.events.groupby("event_type").head(3)[["event_id"]]


@query("fill_forward_backward", "WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS x FROM events) SELECT event_id, last_value(x IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS f, first_value(x IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM e")
def _(t):
    f = t.events
    x = f["value"].where(f["event_id"] % 3 == 0)
    return _events(f, f=x.ffill(), b=x.bfill())


@query("interpolate", "WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS p, CASE WHEN event_id % 3 = 0 THEN value END AS x FROM events), k AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN p END IGNORE NULLS) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS bp, last_value(x IGNORE NULLS) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS bx, first_value(CASE WHEN x IS NOT NULL THEN p END IGNORE NULLS) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ap, first_value(x IGNORE NULLS) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ax FROM e) SELECT event_id, round(coalesce(x, bx + (ax - bx) * (p - bp) / nullif(ap - bp, 0), bx), 6) AS v FROM k")
def _(t):
    f = t.events
    return _events(f, v=f["value"].where(f["event_id"] % 3 == 0).interpolate().round(6))


# --- vectors, models ------------------------------------------------------------------


@query("vector_search", "WITH q AS (SELECT vec_id AS q_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT q_id, vec_id, round(list_distance(embedding::DOUBLE[], e::DOUBLE[]), 5) AS distance, row_number() OVER (PARTITION BY q_id ORDER BY list_distance(embedding::DOUBLE[], e::DOUBLE[]), vec_id) AS r FROM embeddings, q) SELECT q_id, vec_id, distance FROM d WHERE r <= 5")
def _(t):
    from ..operators.search import vector_search

    base = t.spark.read.parquet(t.path("embeddings"))
    queries = base.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    out = vector_search(base, "embedding", "vec_id", queries, "q", "q_id", top_k=5, distance="EUCLIDEAN")
    return out.select("q_id", "vec_id", F.round("distance", 5).alias("distance"))


@query("ml_linear_regression")
def _(t):
    from ..ml import LinearRegression

    f = t.lineitem
    m = LinearRegression().fit(f[["l_quantity", "l_discount"]], f["l_extendedprice"])
    return m.predict(f[["l_quantity", "l_discount"]])[["predicted_label"]]


@query("ml_kmeans")
def _(t):
    from ..ml import KMeans

    x = t.customer[["c_acctbal", "c_nationkey"]]
    return KMeans(n_clusters=3).fit(x).predict(x)[["centroid_id"]]


@query("ml_standard_scaler", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 5) AS z FROM customer")
def _(t):
    from ..ml import StandardScaler

    f = t.customer
    z = StandardScaler().fit(f[["c_acctbal"]]).transform(f[["c_acctbal"]])
    return DataFrame(f.rows, [("c_custkey", f["c_custkey"].expr), ("z", z.iloc_column(0).round(5).expr)])


@query("ml_min_max_scaler", "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS z FROM customer")
def _(t):
    from ..ml import MinMaxScaler

    f = t.customer
    z = MinMaxScaler().fit(f[["c_acctbal"]]).transform(f[["c_acctbal"]])
    return DataFrame(f.rows, [("c_custkey", f["c_custkey"].expr), ("z", z.iloc_column(0).round(6).expr)])


@query("ml_label_encoder", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) AS code FROM customer")
def _(t):
    from ..ml import LabelEncoder

    f = t.customer
    return DataFrame(f.rows, [("c_custkey", f["c_custkey"].expr), ("code", LabelEncoder().fit(f["c_mktsegment"]).transform(f["c_mktsegment"]).iloc_column(0).expr.cast("bigint"))])


@query("ml_metrics", "WITH p AS (SELECT l_quantity > 25 AS y, l_extendedprice > 30000 AS q, l_quantity AS a, l_extendedprice / 1000 AS b FROM lineitem) SELECT round(avg((y = q)::INT), 8) AS accuracy, round(count(*) FILTER (y AND q) / count(*) FILTER (y), 8) AS recall, round(count(*) FILTER (y AND q) / count(*) FILTER (q), 8) AS precision_v, round(avg((a - b) ** 2), 4) AS mse, round(avg(abs(a - b)), 6) AS mae FROM p")
def _(t):
    from ..ml import metrics

    f = t.lineitem
    y, q = f["l_quantity"] > 25, f["l_extendedprice"] > 30000
    a, b = f["l_quantity"], f["l_extendedprice"] / 1000
    row = (metrics.accuracy_score(y, q), metrics.recall_score(y, q, average="binary"), metrics.precision_score(y, q, average="binary"), metrics.mean_squared_error(a, b), metrics.mean_absolute_error(a, b))
    return t.spark.createDataFrame([tuple(round(x, d) for x, d in zip(row, (8, 8, 8, 4, 6)))], "accuracy double, recall double, precision_v double, mse double, mae double")


@query("ml_forecast")
def _(t):
    from ..ai import forecast

    daily = t.events.rows.sdf.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.sum("value").alias("total"))
    return forecast(daily, "day", "total", ["event_type"], horizon=5)


@query("ai_classify_filter")
def _(t):
    f = t.benchmark
    out = f.ai.classify("What kind of text is {text}?", labels=["a", "b"], output_column="kind")
    return out[["item_id", "kind"]]


@query("ai_embedding_search")
def _(t):
    return t.benchmark.ai.search("text", "that and the", top_k=3, score_column="score")[["item_id", "score"]]


# --- streams ---------------------------------------------------------------------------------


@query("stream_filter", "SELECT event_id, value FROM events WHERE event_type = 'click'")
def _(t):
    import uuid

    s = t.session.read_stream(_folder(t), t.spark.read.parquet(t.path("events")).schema)
    s = s[s["event_type"] == "click"][["event_id", "value"]]
    name = "s" + uuid.uuid4().hex
    s.to_memory(name).awaitTermination()
    return t.spark.table(name)


@query("stream_windowed", "SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    import uuid

    s = t.session.read_stream(_folder(t), t.spark.read.parquet(t.path("events")).schema)
    s = s.windowed("ts", "1 day", late="1000 days", by=["event_type"], n=F.count(F.lit(1)))
    name = "s" + uuid.uuid4().hex
    s.to_memory(name, mode="complete").awaitTermination()
    return t.spark.table(name).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n")


def _folder(t) -> str:
    """A glob that a file stream takes: one table of the folder."""
    return t.path("[e]vents")
