"""Frame verbs: selection, order, aggregation, reshaping, sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from .. import NamedAgg, col, concat, crosstab, cut, get_dummies, qcut
from ..functions import aggregates
from ..operators import reshape
from ..plans.frame import DataFrame, Series
from .registry import query


@query("filter_project", "SELECT o_orderkey, o_totalprice / 2 AS half FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000")
def _(t):
    f = t.orders
    f = f[(f["o_orderstatus"] == "O") & (f["o_totalprice"] > 1000)]
    return f.assign(half=f["o_totalprice"] / 2)[["o_orderkey", "half"]]


@query("query_and_eval", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice > 50000 AND o_orderstatus IN ('F', 'O')")
def _(t):
    f = t.orders.query("o_totalprice > 50000 and o_orderstatus in ['F', 'O']")
    return f.eval("twice = o_totalprice * 2")[["o_orderkey", "twice"]]


@query("deferred_columns", "SELECT c_custkey, upper(c_mktsegment) AS seg, c_acctbal + 1 AS more FROM customer")
def _(t):
    return t.customer.assign(seg=col("c_mktsegment").str.upper(), more=col("c_acctbal") + 1)[["c_custkey", "seg", "more"]]


@query("read_with_filters", "SELECT p_partkey, p_size FROM part WHERE (p_size IN (1, 2, 3) AND p_brand LIKE 'Brand#1%') OR p_retailprice > 1900")
def _(t):
    return t.session.read_parquet(t.path("part"), filters=[[("p_size", "in", [1, 2, 3]), ("p_brand", "LIKE", "Brand#1%")], [("p_retailprice", ">", 1900)]])[["p_partkey", "p_size"]]


@query("sql_with_frames", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def _(t):
    o = t.orders
    return t.session.read_sql("SELECT o_orderstatus, count(*) AS n FROM {o} GROUP BY 1", o=o[o["o_totalprice"] > 1000])


@query("head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 7")
def _(t):
    return t.orders.head(7)[["o_orderkey", "o_totalprice"]]


@query("tail", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def _(t):
    return t.orders.tail(7)[["o_orderkey"]]


@query("iloc_slice", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r >= 10 AND r < 50 AND (r - 10) % 3 = 0")
def _(t):
    return t.orders.iloc[10:50:3][["o_orderkey"]]


@query("positions", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders")
def _(t):
    f = t.orders
    pos = f.rows.offset()
    return f._new([("o_orderkey", f["o_orderkey"].expr), ("pos", F.col(pos))])


@query("loc_labels", "SELECT n_name FROM nation WHERE n_nationkey IN (1, 3, 5)")
def _(t):
    return t.indexed("nation").loc[[1, 3, 5]][["n_name"]]


@query("nlargest", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 12")
def _(t):
    return t.customer.nlargest(12, "c_acctbal")[["c_custkey", "c_acctbal"]]


@query("nsmallest", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 12")
def _(t):
    return t.customer.nsmallest(12, "c_acctbal")[["c_custkey", "c_acctbal"]]


@query("sort_first", "SELECT s_suppkey FROM supplier ORDER BY s_nationkey DESC, s_acctbal, s_suppkey LIMIT 5")
def _(t):
    return t.supplier.sort_values(["s_nationkey", "s_acctbal"], ascending=[False, True]).head(5)[["s_suppkey"]]


@query("drop_duplicates", "SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) WHERE r = 1")
def _(t):
    return t.customer.drop_duplicates("c_mktsegment")[["c_mktsegment", "c_custkey"]]


@query("duplicated", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) > 1 AS dup FROM customer")
def _(t):
    f = t.customer
    return DataFrame(f.rows, [("c_custkey", f["c_custkey"].expr), ("dup", f.duplicated("c_nationkey", keep="last").expr)])


@query("dropna", "SELECT event_id FROM events WHERE value IS NOT NULL AND event_id % 5 <> 0")
def _(t):
    f = t.events
    f["x"] = f["value"].mask(f["event_id"] % 5 == 0)
    return f.dropna(subset=["x", "value"])[["event_id"]]


@query("dropna_thresh", "SELECT event_id FROM events WHERE (event_id % 2 <> 0)::INT + (event_id % 3 <> 0)::INT >= 1")
def _(t):
    f = t.events
    k = f["event_id"]
    f = f.assign(a=k.mask(k % 2 == 0), b=k.mask(k % 3 == 0))
    return f.dropna(subset=["a", "b"], thresh=1)[["event_id"]]


@query("concat_rows", "SELECT c_custkey AS k, c_name AS n, 'c' AS src FROM customer UNION ALL SELECT s_suppkey, s_name, 's' FROM supplier")
def _(t):
    a = t.customer[["c_custkey", "c_name"]].rename(columns={"c_custkey": "k", "c_name": "n"}).assign(src="c")
    b = t.supplier[["s_suppkey", "s_name"]].rename(columns={"s_suppkey": "k", "s_name": "n"}).assign(src="s")
    return concat([a, b], ignore_index=True)


@query("concat_columns", "SELECT n_nationkey, n_name, r_name FROM nation FULL JOIN region ON n_nationkey = r_regionkey")
def _(t):
    n, r = t.indexed("nation")[["n_name"]], t.indexed("region")[["r_name"]]
    return concat([n, r], axis=1).reset_index(names=["n_nationkey"])


@query("align_add", "SELECT n_nationkey AS k, (n_regionkey + r_regionkey * 10)::BIGINT AS v FROM nation FULL JOIN region ON n_nationkey = r_regionkey")
def _(t):
    n, r = t.nation.set_index("n_nationkey"), t.region.assign(v=col("r_regionkey") * 10).set_index("r_regionkey")
    total = n["n_regionkey"] + r["v"]
    return total.to_frame("v").reset_index(names=["k"])


@query("combine_first", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END, user_id::DOUBLE) AS v FROM events")
def _(t):
    f = t.events
    x = f["value"].mask(f["event_id"] % 3 == 0)
    return DataFrame(f.rows, [("event_id", f["event_id"].expr), ("v", x.combine_first(f["user_id"].astype("float64")).expr)])


@query("reindex", "SELECT k::BIGINT AS k, n_name FROM (VALUES (3), (99), (1)) v(k) LEFT JOIN nation ON n_nationkey = k")
def _(t):
    return t.indexed("nation").reindex(index=[3, 99, 1])[["n_name"]].reset_index(names=["k"])


# --- aggregates -------------------------------------------------------------


@query("global_aggregates", "SELECT sum(c_acctbal) AS sum_v, round(avg(c_acctbal), 6) AS mean_v, min(c_acctbal) AS min_v, max(c_acctbal) AS max_v, count(c_acctbal) AS count_v, count(DISTINCT c_nationkey) AS nunique_v, round(stddev_samp(c_acctbal), 4) AS std_v, round(var_samp(c_acctbal), 2) AS var_v, round(var_pop(c_acctbal), 2) AS popvar_v, quantile_cont(c_acctbal, 0.5) AS median_v, round(quantile_cont(c_acctbal, 0.3), 6) AS q30_v, bool_and(c_custkey <> 0) AS all_v, bool_or(c_acctbal <> 0) AS any_v, round(skewness(c_acctbal), 6) AS skew_v, round(kurtosis(c_acctbal), 6) AS kurt_v FROM customer")
def _(t):
    f = t.customer
    x = f["c_acctbal"].v
    a = lambda n, digits=None: F.round(aggregates.aggregate(n, x), digits) if digits else aggregates.aggregate(n, x)
    return f.rows.sdf.agg(a("sum").alias("sum_v"), a("mean", 6).alias("mean_v"), a("min").alias("min_v"), a("max").alias("max_v"), a("count").alias("count_v"), aggregates.aggregate("nunique", f["c_nationkey"].v).alias("nunique_v"), a("std", 4).alias("std_v"), a("var", 2).alias("var_v"), a("popvar", 2).alias("popvar_v"), a("median").alias("median_v"), F.round(aggregates.quantile(x, 0.3), 6).alias("q30_v"), aggregates.aggregate("all", f["c_custkey"].v).alias("all_v"), a("any").alias("any_v"), a("skew", 6).alias("skew_v"), a("kurt", 6).alias("kurt_v"))


@query("empty_aggregates", "SELECT 0.0::DOUBLE AS sum_v, NULL::DOUBLE AS mean_v, 0::BIGINT AS count_v, TRUE AS all_v, FALSE AS any_v, 1.0::DOUBLE AS prod_v")
def _(t):
    f = t.customer
    f = f[f["c_custkey"] < 0]
    return f.aggregate_frame(sum_v=("c_acctbal", "sum"), mean_v=("c_acctbal", "mean"), count_v=("c_acctbal", "count"), all_v=("c_acctbal", "all"), any_v=("c_acctbal", "any"), prod_v=("c_acctbal", "prod"))


@query("corr_cov", "SELECT round(corr(l_quantity, l_extendedprice), 8) AS r, round(covar_samp(l_quantity, l_extendedprice), 2) AS c FROM lineitem")
def _(t):
    f = t.lineitem
    return f.rows.sdf.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("r"), F.round(F.covar_samp("l_quantity", "l_extendedprice"), 2).alias("c"))


@query("groupby_dropna", "SELECT CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS k, count(*) AS n FROM events WHERE event_id % 4 <> 0 AND event_type IS NOT NULL GROUP BY 1")
def _(t):
    f = t.events
    f["k"] = f["event_type"].mask(f["event_id"] % 4 == 0)
    return f.groupby("k", as_index=False).agg(n=NamedAgg("event_id", "size"))


@query("groupby_keepna", "SELECT CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS k, count(*) AS n FROM events GROUP BY 1")
def _(t):
    f = t.events
    f["k"] = f["event_type"].mask(f["event_id"] % 4 == 0)
    return f.groupby("k", as_index=False, dropna=False).agg(n=NamedAgg("event_id", "size"))


@query("groupby_many", "SELECT c_mktsegment, min(c_acctbal) AS mn, max(c_acctbal) AS mx, count(DISTINCT c_nationkey) AS nu, bool_or(c_acctbal > 9000) AS an, bool_and(c_acctbal > -1000) AS al, count(c_acctbal) AS n FROM customer GROUP BY 1")
def _(t):
    f = t.customer
    f = f.assign(big=f["c_acctbal"] > 9000, low=f["c_acctbal"] > -1000)
    return f.groupby("c_mktsegment", as_index=False).agg(mn=("c_acctbal", "min"), mx=("c_acctbal", "max"), nu=("c_nationkey", "nunique"), an=("big", "any"), al=("low", "all"), n=("c_acctbal", "count"))


@query("groupby_first_last", "SELECT c_mktsegment, first(c_name ORDER BY c_custkey) AS first_v, last(c_name ORDER BY c_custkey) AS last_v FROM customer GROUP BY 1")
def _(t):
    g = t.customer.groupby("c_mktsegment")["c_name"]
    a, b = g.first().to_frame("first_v"), g.last().to_frame("last_v")
    return a.join(b).reset_index()


@query("groupby_quantile", "SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS l_quantity FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupby("l_returnflag")["l_quantity"].quantile(0.25).to_frame("l_quantity").reset_index()


@query("groupby_corr", "SELECT l_returnflag, round(corr(l_quantity, l_tax), 8) AS r FROM lineitem GROUP BY 1")
def _(t):
    g = t.lineitem.groupby("l_returnflag")[["l_quantity", "l_tax"]].corr()
    return g[[("l_quantity", "l_tax")]].rename(columns=lambda n: "r").round(8).reset_index()


@query("groupby_skew_product", "SELECT n_regionkey, product(n_nationkey + 1)::DOUBLE AS p, round(skewness(n_nationkey), 6) AS s FROM nation GROUP BY 1")
def _(t):
    f = t.nation
    f["k"] = f["n_nationkey"] + 1
    return f.groupby("n_regionkey", as_index=False).agg(p=("k", "prod"), s=("n_nationkey", "skew")).round({"s": 6})


@query("array_and_string_agg", "SELECT n_regionkey, len(list(n_name)) AS n, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def _(t):
    f = t.nation
    v, order = f["n_name"].v, [F.col("n_nationkey")]
    return f.rows.sdf.groupBy("n_regionkey").agg(F.size(aggregates.array_agg(v, order)).cast("bigint").alias("n"), aggregates.string_agg(v, ",", order).alias("names"))


@query("approx_top_count")
def _(t):
    f = t.customer
    return f.rows.sdf.agg(aggregates.approx_top_count(f["c_mktsegment"].v, 3).alias("top"))


@query("approx_quartiles")
def _(t):
    f = t.customer
    return f.rows.sdf.agg(*(aggregates.approx_quartile(f["c_acctbal"].v, k).alias(f"q{k}") for k in (1, 2, 3)))


@query("row_aggregates", "SELECT l_orderkey, l_linenumber, round(l_quantity + l_discount + l_tax, 6) AS s, round((l_quantity + l_discount + l_tax) / 3, 6) AS m, greatest(l_quantity, l_discount, l_tax) AS mx, least(l_quantity, l_discount, l_tax) AS mn FROM lineitem")
def _(t):
    f = t.lineitem
    v = f[["l_quantity", "l_discount", "l_tax"]]
    return DataFrame(f.rows, [("l_orderkey", f["l_orderkey"].expr), ("l_linenumber", f["l_linenumber"].expr), ("s", v.sum(axis=1).round(6).expr), ("m", v.mean(axis=1).round(6).expr), ("mx", v.max(axis=1).expr), ("mn", v.min(axis=1).expr)])


@query("value_counts", "SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY 1")
def _(t):
    return t.orders["o_orderstatus"].value_counts().to_frame("count").reset_index()


@query("value_counts_normalized", "SELECT o_orderpriority, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM orders GROUP BY 1")
def _(t):
    return t.orders["o_orderpriority"].value_counts(normalize=True).to_frame("share").round(8).reset_index()


@query("mode", "SELECT p_size AS p_size FROM part GROUP BY 1 HAVING count(*) = (SELECT max(n) FROM (SELECT count(*) AS n FROM part GROUP BY p_size))")
def _(t):
    return t.part["p_size"].mode()


@query("nunique_unique", "SELECT DISTINCT c_mktsegment FROM customer")
def _(t):
    return t.customer["c_mktsegment"].unique(keep_order=False)


@query("idx_extremes", "SELECT max_by(c_custkey, c_acctbal) AS hi, min_by(c_custkey, c_acctbal) AS lo FROM customer")
def _(t):
    f = t.indexed("customer")
    key, x = F.col("c_custkey"), f["c_acctbal"].expr
    first = lambda pick, then: pick(key, F.when(x.isNotNull(), F.struct(x, then)))
    return f.rows.sdf.agg(first(F.max_by, -key).alias("hi"), first(F.min_by, key).alias("lo"))  # of ties the smallest key


@query("describe")
def _(t):
    return t.customer[["c_acctbal"]].describe().reset_index(names=["stat"])


@query("is_monotonic", "SELECT TRUE AS up, FALSE AS down")
def _(t):
    k = t.orders["o_orderkey"]
    return t.spark.createDataFrame([(bool(k.is_monotonic_increasing), bool(k.is_monotonic_decreasing))], "up boolean, down boolean")


# --- reshape --------------------------------------------------------------------


@query("pivot_table", "SELECT c_mktsegment, round(sum(CASE WHEN c_nationkey % 3 = 0 THEN c_acctbal END), 2) AS k0, round(sum(CASE WHEN c_nationkey % 3 = 1 THEN c_acctbal END), 2) AS k1, round(sum(CASE WHEN c_nationkey % 3 = 2 THEN c_acctbal END), 2) AS k2 FROM customer GROUP BY 1")
def _(t):
    f = t.customer
    f["k"] = (f["c_nationkey"] % 3).astype("string")
    out = f.pivot_table(values="c_acctbal", index="c_mktsegment", columns="k", aggfunc="sum").rename(columns=lambda n: f"k{n}").round(2)
    return out.reset_index()


@query("pivot", "SELECT o_orderstatus, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN n END)::BIGINT AS urgent, sum(CASE WHEN o_orderpriority = '5-LOW' THEN n END)::BIGINT AS low FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def _(t):
    n = t.orders.groupby(["o_orderstatus", "o_orderpriority"], as_index=False).agg(n=("o_orderkey", "size"))
    out = n.pivot(index="o_orderstatus", columns="o_orderpriority", values="n")
    return out.rename(columns={"1-URGENT": "urgent", "5-LOW": "low"})[["urgent", "low"]].reset_index()


@query("melt", "SELECT l_orderkey, l_linenumber, 'l_discount' AS variable, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
def _(t):
    return t.lineitem.melt(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


@query("stack_unstack", "SELECT n_nationkey, n_regionkey::BIGINT AS a, (n_regionkey * 2)::BIGINT AS b FROM nation")
def _(t):
    f = t.nation.set_index("n_nationkey")
    f = f.assign(a=f["n_regionkey"], b=f["n_regionkey"] * 2)[["a", "b"]]
    return reshape.unstack(f.stack().to_frame("x"), -1, single=True).reset_index(names=["n_nationkey"])


@query("transpose", "SELECT 'r_regionkey2' AS field, 0 AS c0, 2 AS c1, 4 AS c2, 6 AS c3, 8 AS c4")
def _(t):
    f = t.region.set_index("r_regionkey")
    f = f.assign(r_regionkey2=Series(f.rows, F.col("r_regionkey") * 2))[["r_regionkey2"]]
    return f.T.rename(columns=lambda n: f"c{n}").reset_index(names=["field"])


@query("explode", "SELECT n_regionkey, unnest(string_split(n_name, 'A')) AS piece FROM nation")
def _(t):
    f = t.nation
    f["piece"] = f["n_name"].str.split("A")
    return f[["n_regionkey", "piece"]].explode("piece")


@query("get_dummies", "SELECT c_custkey, c_mktsegment = 'BUILDING' AS seg_BUILDING, c_mktsegment = 'MACHINERY' AS seg_MACHINERY FROM customer")
def _(t):
    return get_dummies(t.customer[["c_custkey", "c_mktsegment"]], prefix="seg")[["c_custkey", "seg_BUILDING", "seg_MACHINERY"]]


@query("crosstab", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1")
def _(t):
    f = t.orders
    return crosstab(f["o_orderpriority"], f["o_orderstatus"])[["F", "O"]].rename(columns={"F": "f", "O": "o"}).reset_index(names=["o_orderpriority"])


@query("cut", "SELECT c_custkey, (CASE WHEN c_acctbal > -1000 AND c_acctbal <= 0 THEN 0 WHEN c_acctbal > 0 AND c_acctbal <= 5000 THEN 1 WHEN c_acctbal > 5000 AND c_acctbal <= 10000 THEN 2 END)::BIGINT AS bin FROM customer")
def _(t):
    f = t.customer
    return DataFrame(f.rows, [("c_custkey", f["c_custkey"].expr), ("bin", cut(f["c_acctbal"], [-1000, 0, 5000, 10000], labels=False).expr)])


@query("qcut", "SELECT c_custkey, CAST(greatest(ceil(percent_rank() OVER (ORDER BY c_acctbal) * 4) - 1, 0) AS BIGINT) AS bin FROM customer")
def _(t):
    f = t.customer
    return DataFrame(f.rows, [("c_custkey", f["c_custkey"].expr), ("bin", qcut(f["c_acctbal"], 4).expr)])


@query("resample", "SELECT d AS ts, coalesce(n, 0) AS value FROM (SELECT unnest(generate_series(min(date_trunc('day', ts)), max(date_trunc('day', ts)), INTERVAL 1 DAY)) AS d FROM events) LEFT JOIN (SELECT date_trunc('day', ts) AS d, count(value) AS n FROM events GROUP BY 1) USING (d)")
def _(t):
    return t.events[["ts", "value"]].resample("D", on="ts").count().reset_index()


@query("sample")
def _(t):
    return t.orders.sample(n=20, random_state=7)[["o_orderkey"]]


@query("local_round_trip", "SELECT i::BIGINT AS i, s, x::DOUBLE AS x FROM (VALUES (1, 'a', 1.5), (2, 'b', NULL), (3, NULL, 2.5)) v(i, s, x)")
def _(t):
    return t.session.read_pandas(pd.DataFrame({"i": [1, 2, 3], "s": ["a", "b", None], "x": [1.5, None, 2.5]})).assign(x=lambda d: d["x"].where(d["x"].notna()))


@query("dot_product", "SELECT l_orderkey, l_linenumber, round(l_quantity * 2 + l_tax * 3, 6) AS v FROM lineitem")
def _(t):
    f = t.lineitem
    w = t.session.read_pandas(pd.DataFrame({"v": [2, 3]}, index=["l_quantity", "l_tax"]))
    return f.assign(v=f[["l_quantity", "l_tax"]].dot(w)["v"].round(6))[["l_orderkey", "l_linenumber", "v"]]


@query("rename_prefix_filter", "SELECT r_regionkey AS x_r_regionkey, r_name AS x_r_name FROM region")
def _(t):
    return t.region.add_prefix("x_").filter(like="x_r")
