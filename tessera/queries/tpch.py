"""Star-schema queries, as far as the tables' columns allow, and the group-by and join benchmark."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators.grouping import NamedAgg
from ..operators.relational import semi
from .registry import Tables, query

D = datetime.datetime


def revenue(f):
    return f["l_extendedprice"] * (1 - f["l_discount"])


@query("q1", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(t: Tables):
    f = t.lineitem
    f = f[f["l_shipdate"] <= D(1998, 9, 2)]
    f["disc"] = revenue(f)
    f["charge"] = f["disc"] * (1 + f["l_tax"])
    g = f.groupby(["l_returnflag", "l_linestatus"], as_index=False).agg(sum_qty=NamedAgg("l_quantity", "sum"), sum_base_price=NamedAgg("l_extendedprice", "sum"), sum_disc_price=NamedAgg("disc", "sum"), sum_charge=NamedAgg("charge", "sum"), avg_qty=NamedAgg("l_quantity", "mean"), avg_price=NamedAgg("l_extendedprice", "mean"), avg_disc=NamedAgg("l_discount", "mean"), count_order=NamedAgg("l_quantity", "size"))
    out = g.round({"sum_base_price": 2, "sum_disc_price": 2, "sum_charge": 2, "avg_qty": 6, "avg_price": 6, "avg_disc": 6})
    return out.sort_values(["l_returnflag", "l_linestatus"])


@query("q3", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10")
def _(t):
    c = t.customer
    c = c[c["c_mktsegment"] == "BUILDING"][["c_custkey"]]
    o = t.orders
    o = o[o["o_orderdate"] < D(1995, 3, 15)][["o_orderkey", "o_custkey", "o_orderdate"]]
    li = t.lineitem
    li = li[li["l_shipdate"] > D(1995, 3, 15)]
    li["revenue"] = revenue(li)
    j = li[["l_orderkey", "revenue"]].merge(semi(o, c.rename(columns={"c_custkey": "o_custkey"}), "o_custkey"), left_on="l_orderkey", right_on="o_orderkey")
    g = j.groupby(["l_orderkey", "o_orderdate"], as_index=False).agg({"revenue": "sum"}).round({"revenue": 2})
    return g.sort_values(["revenue", "l_orderkey"], ascending=[False, True]).head(10)


@query("q4", "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1995-07-01' AND o_orderdate < TIMESTAMP '1996-07-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1")
def _(t):
    o = t.orders
    o = o[(o["o_orderdate"] >= D(1995, 7, 1)) & (o["o_orderdate"] < D(1996, 7, 1))]
    li = t.lineitem
    late = li[li["l_returnflag"] == "R"][["l_orderkey"]].rename(columns={"l_orderkey": "o_orderkey"})
    return semi(o, late, "o_orderkey").groupby("o_orderpriority", as_index=False).agg(order_count=NamedAgg("o_orderkey", "size"))


@query("q5", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
def _(t):
    r = t.region
    n = t.nation.merge(r[r["r_name"] == "ASIA"], left_on="n_regionkey", right_on="r_regionkey")[["n_nationkey", "n_name"]]
    s = t.supplier.merge(n, left_on="s_nationkey", right_on="n_nationkey")[["s_suppkey", "s_nationkey", "n_name"]]
    li = t.lineitem
    li["revenue"] = revenue(li)
    j = li[["l_orderkey", "l_suppkey", "revenue"]].merge(s, left_on="l_suppkey", right_on="s_suppkey").merge(t.orders[["o_orderkey", "o_custkey"]], left_on="l_orderkey", right_on="o_orderkey").merge(t.customer[["c_custkey", "c_nationkey"]], left_on=["o_custkey", "s_nationkey"], right_on=["c_custkey", "c_nationkey"])
    return j.groupby("n_name", as_index=False).agg({"revenue": "sum"}).round({"revenue": 2})


@query("q6", "SELECT coalesce(round(sum(l_extendedprice * l_discount), 2), 0) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def _(t):
    f = t.lineitem
    f = f[(f["l_shipdate"] >= D(1995, 1, 1)) & (f["l_shipdate"] < D(1996, 1, 1)) & f["l_discount"].between(0.05, 0.07) & (f["l_quantity"] < 24)]
    return f.assign(x=f["l_extendedprice"] * f["l_discount"]).aggregate_frame(revenue=("x", "sum")).select(F.round("revenue", 2).alias("revenue"))


@query("q10", "SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY ALL ORDER BY revenue DESC, c_custkey LIMIT 20")
def _(t):
    li = t.lineitem
    li = li[li["l_returnflag"] == "R"]
    li["revenue"] = revenue(li)
    per = li[["l_orderkey", "revenue"]].merge(t.orders[["o_orderkey", "o_custkey"]], left_on="l_orderkey", right_on="o_orderkey").groupby("o_custkey", as_index=False).agg({"revenue": "sum"})
    j = t.customer.merge(per, left_on="c_custkey", right_on="o_custkey").merge(t.nation, left_on="c_nationkey", right_on="n_nationkey")
    return j[["c_custkey", "c_name", "revenue", "n_name"]].round({"revenue": 2}).sort_values(["revenue", "c_custkey"], ascending=[False, True]).head(20)


@query("q14", "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue FROM lineitem JOIN part ON l_partkey = p_partkey")
def _(t):
    li = t.lineitem
    li["revenue"] = revenue(li)
    j = li[["l_partkey", "revenue"]].merge(t.part[["p_partkey", "p_type"]], left_on="l_partkey", right_on="p_partkey")
    j["promo"] = j["revenue"].where(j["p_type"].str.startswith("PROMO"), 0.0)
    return j.aggregate_frame(p=("promo", "sum"), r=("revenue", "sum")).select(F.round(100.0 * F.col("p") / F.col("r"), 6).alias("promo_revenue"))


@query("q17", "SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey JOIN (SELECT l_partkey AS k, avg(l_quantity) AS a FROM lineitem GROUP BY 1) ON k = l_partkey WHERE l_quantity < 0.4 * a AND p_size < 20")
def _(t):
    p = t.part
    li = semi(t.lineitem, p[p["p_size"] < 20][["p_partkey"]].rename(columns={"p_partkey": "l_partkey"}), "l_partkey")
    mean = li.groupby("l_partkey", as_index=False).agg(a=NamedAgg("l_quantity", "mean"))
    j = li.merge(mean, on="l_partkey")
    return j[j["l_quantity"] < j["a"] * 0.4].aggregate_frame(s=("l_extendedprice", "sum")).select(F.round(F.col("s") / 7.0, 4).alias("avg_yearly"))


@query("q18", "SELECT c_name, o_orderkey, o_totalprice, sum(l_quantity) AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL HAVING sum(l_quantity) > 200 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(t):
    big = t.lineitem.groupby("l_orderkey", as_index=False).agg(qty=NamedAgg("l_quantity", "sum"))
    big = big[big["qty"] > 200]
    j = t.orders.merge(big, left_on="o_orderkey", right_on="l_orderkey").merge(t.customer, left_on="o_custkey", right_on="c_custkey")
    return j[["c_name", "o_orderkey", "o_totalprice", "qty"]].sort_values(["o_totalprice", "o_orderkey"], ascending=[False, True]).head(100)


@query("q22", "SELECT c_mktsegment, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY 1")
def _(t):
    c = t.customer
    mean = c[c["c_acctbal"] > 0]["c_acctbal"].mean()
    o = t.orders
    urgent = o[o["o_orderpriority"] == "1-URGENT"][["o_custkey"]].rename(columns={"o_custkey": "c_custkey"})
    rich = semi(c[c["c_acctbal"] > mean], urgent, "c_custkey", anti=True)
    return rich.groupby("c_mktsegment", as_index=False).agg(numcust=NamedAgg("c_custkey", "size"), totacctbal=NamedAgg("c_acctbal", "sum")).round({"totacctbal": 2})


@query(
    "q7",
    """
    SELECT sn.n_name AS supp_nation, cn.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN nation cn ON c_nationkey = cn.n_nationkey
    JOIN region sr ON sn.n_regionkey = sr.r_regionkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
    WHERE (sr.r_name = 'ASIA' AND cr.r_name = 'EUROPE' OR sr.r_name = 'EUROPE' AND cr.r_name = 'ASIA') AND l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
    GROUP BY ALL
    """,
)
def _(t):
    r = t.region
    n = t.nation.merge(r[r["r_name"].isin(["ASIA", "EUROPE"])], left_on="n_regionkey", right_on="r_regionkey")[["n_nationkey", "n_name", "r_name"]]
    s = t.supplier.merge(n.rename(columns={"n_name": "supp_nation", "r_name": "from"}), left_on="s_nationkey", right_on="n_nationkey")[["s_suppkey", "supp_nation", "from"]]
    c = t.customer.merge(n.rename(columns={"n_name": "cust_nation", "r_name": "to"}), left_on="c_nationkey", right_on="n_nationkey")[["c_custkey", "cust_nation", "to"]]
    li = t.lineitem
    li = li[(li["l_shipdate"] >= D(1995, 1, 1)) & (li["l_shipdate"] < D(1997, 1, 1))]
    li["l_year"] = li["l_shipdate"].dt.year
    li["revenue"] = revenue(li)
    j = li[["l_orderkey", "l_suppkey", "l_year", "revenue"]].merge(s, left_on="l_suppkey", right_on="s_suppkey")
    j = j.merge(t.orders[["o_orderkey", "o_custkey"]], left_on="l_orderkey", right_on="o_orderkey").merge(c, left_on="o_custkey", right_on="c_custkey")
    return j[j["from"] != j["to"]].groupby(["supp_nation", "cust_nation", "l_year"], as_index=False).agg({"revenue": "sum"}).round({"revenue": 2})


@query(
    "q8",
    """
    SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year, round(sum(CASE WHEN sn.n_name = 'NATION_2' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS mkt_share
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region ON cn.n_regionkey = r_regionkey JOIN nation sn ON s_nationkey = sn.n_nationkey
    WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY' GROUP BY 1
    """,
)
def _(t):
    r, p = t.region, t.part
    n = t.nation.merge(r[r["r_name"] == "AMERICA"], left_on="n_regionkey", right_on="r_regionkey")[["n_nationkey"]]
    c = semi(t.customer, n.rename(columns={"n_nationkey": "c_nationkey"}), "c_nationkey")[["c_custkey"]]
    s = t.supplier.merge(t.nation[["n_nationkey", "n_name"]], left_on="s_nationkey", right_on="n_nationkey")[["s_suppkey", "n_name"]]
    o = semi(t.orders, c.rename(columns={"c_custkey": "o_custkey"}), "o_custkey")
    o["o_year"] = o["o_orderdate"].dt.year
    li = semi(t.lineitem, p[p["p_type"] == "ECONOMY"][["p_partkey"]].rename(columns={"p_partkey": "l_partkey"}), "l_partkey")
    li["volume"] = revenue(li)
    j = li[["l_orderkey", "l_suppkey", "volume"]].merge(o[["o_orderkey", "o_year"]], left_on="l_orderkey", right_on="o_orderkey").merge(s, left_on="l_suppkey", right_on="s_suppkey")
    j["part"] = j["volume"].where(j["n_name"] == "NATION_2", 0.0)
    g = j.groupby("o_year", as_index=False).agg(part=NamedAgg("part", "sum"), volume=NamedAgg("volume", "sum"))
    return g.assign(mkt_share=g["part"] / g["volume"])[["o_year", "mkt_share"]].round({"mkt_share": 6})


@query(
    "q15",
    """
    WITH r AS (SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total_revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY 1)
    SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN r ON s_suppkey = l_suppkey WHERE total_revenue = (SELECT max(total_revenue) FROM r)
    """,
)
def _(t):
    li = t.lineitem
    li = li[(li["l_shipdate"] >= D(1996, 1, 1)) & (li["l_shipdate"] < D(1996, 4, 1))]
    li["total_revenue"] = revenue(li)
    per = li.groupby("l_suppkey", as_index=False).agg({"total_revenue": "sum"}).round({"total_revenue": 2})
    best = per[per["total_revenue"] == per["total_revenue"].max()]
    return t.supplier.merge(best, left_on="s_suppkey", right_on="l_suppkey")[["s_suppkey", "s_name", "total_revenue"]]


@query("sort_1", "SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_partkey, l_orderkey, l_linenumber")
def _(t):
    return t.lineitem.sort_values(["l_partkey", "l_orderkey", "l_linenumber"])[["l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice"]]


GROUPS = {
    "groupby_1": (["l_returnflag"], {"v": ("l_quantity", "sum")}, "SELECT l_returnflag, sum(l_quantity) AS v FROM lineitem GROUP BY 1"),
    "groupby_2": (["l_returnflag", "l_linestatus"], {"v": ("l_quantity", "sum")}, "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"),
    "groupby_3": (["l_partkey"], {"v": ("l_quantity", "sum"), "m": ("l_tax", "mean")}, "SELECT l_partkey, sum(l_quantity) AS v, round(avg(l_tax), 6) AS m FROM lineitem GROUP BY 1"),
    "groupby_4": (["l_linenumber"], {"a": ("l_quantity", "mean"), "b": ("l_discount", "mean"), "c": ("l_tax", "mean")}, "SELECT l_linenumber, round(avg(l_quantity), 6) AS a, round(avg(l_discount), 6) AS b, round(avg(l_tax), 6) AS c FROM lineitem GROUP BY 1"),
    "groupby_5": (["l_suppkey"], {"a": ("l_quantity", "sum"), "b": ("l_discount", "sum"), "c": ("l_tax", "sum")}, "SELECT l_suppkey, sum(l_quantity) AS a, round(sum(l_discount), 6) AS b, round(sum(l_tax), 6) AS c FROM lineitem GROUP BY 1"),
    "groupby_6": (["l_suppkey"], {"med": ("l_quantity", "median"), "sd": ("l_quantity", "std")}, "SELECT l_suppkey, median(l_quantity) AS med, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY 1"),
    "groupby_7": (["l_returnflag"], {"hi": ("l_quantity", "max"), "lo": ("l_discount", "min")}, "SELECT l_returnflag, max(l_quantity) AS hi, min(l_discount) AS lo FROM lineitem GROUP BY 1"),
    "groupby_10": (["l_orderkey", "l_partkey", "l_suppkey"], {"v": ("l_quantity", "sum"), "n": ("l_quantity", "size")}, "SELECT l_orderkey, l_partkey, l_suppkey, sum(l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2, 3"),
}
for _name, (_keys, _aggs, _sql) in GROUPS.items():

    @query(_name, _sql)
    def _(t, keys=_keys, aggs=_aggs):
        out = t.lineitem.groupby(keys, as_index=False).agg(**aggs)
        return out.round({n: 6 for n, (_, f) in aggs.items() if f in ("mean", "std", "sum")})


@query("groupby_8_top2", "SELECT l_suppkey, l_extendedprice AS v FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 2")
def _(t):
    f = t.lineitem.sort_values("l_extendedprice", ascending=False)
    return f.groupby("l_suppkey").head(2)[["l_suppkey", "l_extendedprice"]].rename(columns={"l_extendedprice": "v"})


JOINS = {"join_inner": ("inner", "JOIN"), "join_left": ("left", "LEFT JOIN"), "join_right": ("right", "RIGHT JOIN"), "join_outer": ("outer", "FULL JOIN")}
for _name, (_how, _said) in JOINS.items():

    @query(_name, f"SELECT c_custkey, c_name, s_suppkey, s_name FROM customer {_said} supplier ON c_custkey = s_suppkey + 5")
    def _(t, how=_how):
        s = t.supplier
        s["k"] = s["s_suppkey"] + 5
        return t.customer.merge(s, how=how, left_on="c_custkey", right_on="k")[["c_custkey", "c_name", "s_suppkey", "s_name"]]


@query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def _(t):
    return t.region.merge(t.nation, how="cross")[["r_name", "n_name"]]


@query("join_null_keys_whole", "WITH a AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS k FROM events), b AS (SELECT k, count(*) AS n, min(c_custkey) AS least FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END AS k FROM customer) GROUP BY k) SELECT event_id, a.k AS k, n, least FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def _(t):
    e = t.events
    e["k"] = e["user_id"].mask(e["event_id"] % 4 == 0)
    c = t.customer
    c["k"] = c["c_custkey"].mask(c["c_custkey"] % 3 == 0)
    # One row a key, so that the null group meets each event once and the result is linear.
    c = c.groupby("k", dropna=False, as_index=False).agg(n=("c_custkey", "size"), least=("c_custkey", "min"))
    return e[["event_id", "k"]].merge(c, on="k")


@query("join_by_index", "SELECT n_nationkey, n_name, s.n AS suppliers FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON n_nationkey = s_nationkey")
def _(t):
    per = t.supplier.groupby("s_nationkey").size().to_frame("suppliers")
    return t.indexed("nation").join(per).reset_index(names=["n_nationkey"])[["n_nationkey", "n_name", "suppliers"]]


@query("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def _(t):
    o = t.orders
    c = t.customer
    return c[c["c_custkey"].isin(o[o["o_totalprice"] > 100000]["o_custkey"])][["c_custkey"]]


@query("anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    c = t.customer
    return c[~c["c_custkey"].isin(t.orders["o_custkey"])][["c_custkey"]]
