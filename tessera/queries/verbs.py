"""The frame, series and index interface, many verbs a query; single facts come as (verb, value) rows."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import functions as F

from .. import Index, MultiIndex, concat, crosstab, cut, get_dummies, qcut, to_datetime, to_timedelta
from ..plans.frame import DataFrame, Series
from .registry import Tables, query


def columns(frame: DataFrame, **made: Series) -> DataFrame:
    """Series over one set of rows as the columns of a frame."""
    return DataFrame(frame.rows, [(n, s.expr) for n, s in made.items()])


def said(value) -> str:
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value)).lower()
    if isinstance(value, (float, np.floating)):
        # A half goes away from zero, as in SQL; Python's own rounding takes it to the even neighbour.
        return str(int(Decimal(float(value) * 10_000).to_integral_value(ROUND_HALF_UP)))
    if isinstance(value, (list, tuple, pd.Index, np.ndarray, pd.Series)):
        return "|".join(map(said, value))
    return str(value)


def facts(t: Tables, **values) -> SparkFrame:
    return t.spark.createDataFrame([(k, said(v)) for k, v in values.items()], "verb string, value string")


def said_by_sql(source: str = "", **values: str) -> str:
    """One row a value; ``source`` is a WITH clause for them."""
    return source + " UNION ALL ".join(f"SELECT '{k}' AS verb, CAST({v} AS VARCHAR) AS value" for k, v in values.items())


def tenthousandths(x: str) -> str:
    return f"CAST(round(({x}) * 10000) AS BIGINT)"


# --- operators of frames and series ------------------------------------------------

ARITHMETIC = """SELECT l_orderkey, l_linenumber, round({x} + 2, 6) AS add_, round(3 + {x}, 6) AS radd_, round({x} - 2, 6) AS sub_, round({x} - 3, 6) AS subtract_, round(2 - {x}, 6) AS rsub_,
round({x} * 3, 6) AS mul_, round({x} * 4, 6) AS multiply_, round(5 * {x}, 6) AS rmul_, round({x} / 4, 6) AS truediv_, round({x} / 8, 6) AS div_, round(100 / {x}, 6) AS rtruediv_, round(200 / {x}, 6) AS rdiv_,
round(floor({x} / 4), 6) AS floordiv_, round(floor(100 / {x}), 6) AS rfloordiv_, round({x} - 7 * floor({x} / 7), 6) AS mod_, round(100 - {x} * floor(100 / {x}), 6) AS rmod_,
round(pow({x}, 2), 6) AS pow_, round(pow(1.01::DOUBLE, {x}), 6) AS rpow_, {x} = 5 AS eq_, {x} <> 5 AS ne_, {x} < 5 AS lt_, {x} <= 5 AS le_, {x} > 5 AS gt_, {x} >= 5 AS ge_,
round(-{x}, 6) AS neg_, round({x}, 6) AS pos_, round(abs({x} - 30), 6) AS abs_, {x} IS NULL AS isnull_, {x} IS NOT NULL AS notnull_ FROM lineitem"""


def arithmetic(f: DataFrame, of, pick) -> DataFrame:
    """Each arithmetic verb of ``of``, of which ``pick`` takes the column."""
    numbers = dict(
        add_=of.add(2), radd_=of.radd(3), sub_=of.sub(2), subtract_=of.subtract(3), rsub_=of.rsub(2), mul_=of.mul(3), multiply_=of.multiply(4), rmul_=of.rmul(5), truediv_=of.truediv(4), div_=of.div(8), rtruediv_=of.rtruediv(100), rdiv_=of.rdiv(200),
        floordiv_=of.floordiv(4), rfloordiv_=of.rfloordiv(100), mod_=of.mod(7), rmod_=of.rmod(100), pow_=of.pow(2), rpow_=of.rpow(1.01), neg_=-of, pos_=+of, abs_=(of - 30).abs(),
    )
    flags = dict(eq_=of.eq(5), ne_=of.ne(5), lt_=of.lt(5), le_=of.le(5), gt_=of.gt(5), ge_=of.ge(5), isnull_=of.isnull(), notnull_=of.notnull())
    return columns(f, l_orderkey=f["l_orderkey"], l_linenumber=f["l_linenumber"], **{n: pick(s).astype("float64").round(6) for n, s in numbers.items()}, **{n: pick(s) for n, s in flags.items()})


@query("frame_arithmetic_verbs", ARITHMETIC.format(x="l_quantity"))
def _(t):
    f = t.lineitem
    return arithmetic(f, f[["l_quantity", "l_tax"]], lambda made: made["l_quantity"])


@query("series_arithmetic_verbs", ARITHMETIC.format(x="l_quantity"))
def _(t):
    f = t.lineitem
    return arithmetic(f, f["l_quantity"], lambda made: made)


OPERATORS = """SELECT l_orderkey, l_linenumber, 2 + x AS radd_, 2 - x AS rsub_, 2 * x AS rmul_, round(2 / x, 6) AS rtruediv_, x // 2 AS floordiv_, 100 // x AS rfloordiv_, x % 3 AS mod_, 100 % x AS rmod_, CAST(pow(x, 2) AS BIGINT) AS pow_, CAST(pow(2, x) AS BIGINT) AS rpow_,
-x AS neg_, x AS pos_, abs(x - 4) AS abs_, x // 3 AS divmod_0, x % 3 AS divmod_1, 100 // x AS rdivmod_0, 100 % x AS rdivmod_1, (x > 2) <> (x > 4) AS xor_, x > 2 AND x < 6 AS and_, x < 2 OR x > 6 AS or_, NOT (x > 2) AS invert_, ~x AS bits_
FROM (SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) AS x FROM lineitem)"""


@query("series_operators", OPERATORS)
def _(t):
    f = t.lineitem
    x = f["l_linenumber"].astype("Int64")
    q, m = x.divmod(3)
    rq, rm = x.rdivmod(100)
    return columns(
        f, l_orderkey=f["l_orderkey"], l_linenumber=f["l_linenumber"], radd_=2 + x, rsub_=2 - x, rmul_=2 * x, rtruediv_=(2 / x).round(6), floordiv_=x // 2, rfloordiv_=100 // x, mod_=x % 3, rmod_=100 % x, pow_=(x**2).astype("Int64"), rpow_=(2**x).astype("Int64"),
        neg_=-x, pos_=+x, abs_=abs(x - 4), divmod_0=q, divmod_1=m, rdivmod_0=rq, rdivmod_1=rm, xor_=(x > 2) ^ (x > 4), and_=(x > 2) & (x < 6), or_=(x < 2) | (x > 6), invert_=~(x > 2), bits_=~x,
    )


@query("frame_operators", OPERATORS.replace("x // 3 AS divmod_0, x % 3 AS divmod_1, 100 // x AS rdivmod_0, 100 % x AS rdivmod_1, ", "").replace(", ~x AS bits_", ""))
def _(t):
    f = t.lineitem
    x = f.assign(n=f["l_linenumber"].astype("Int64"))[["n"]]
    made = dict(
        radd_=2 + x, rsub_=2 - x, rmul_=2 * x, rtruediv_=(2 / x).round(6), floordiv_=x // 2, rfloordiv_=100 // x, mod_=x % 3, rmod_=100 % x, pow_=(x**2).astype("Int64"), rpow_=(2**x).astype("Int64"), neg_=-x, pos_=+x, abs_=abs(x - 4),
        xor_=(x > 2) ^ (x > 4), and_=(x > 2) & (x < 6), or_=(x < 2) | (x > 6), invert_=~(x > 2),
    )
    return columns(f, l_orderkey=f["l_orderkey"], l_linenumber=f["l_linenumber"], **{n: v["n"] for n, v in made.items()})


@query("array_ufunc", "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS root, round(exp(l_tax), 6) AS e, l_quantity + 1 AS one_more, round(ln(l_quantity), 6) AS l FROM lineitem")
def _(t):
    f = t.lineitem
    return columns(f, l_orderkey=f["l_orderkey"], l_linenumber=f["l_linenumber"], root=np.sqrt(f["l_quantity"]).round(6), e=np.exp(f[["l_tax"]])["l_tax"].round(6), one_more=np.add(f["l_quantity"], 1), l=np.log(f["l_quantity"]).round(6))


# --- what a frame says about itself --------------------------------------------------


@query(
    "frame_facts",
    said_by_sql(
        "", shape="(SELECT count(*) FROM customer) || '|5'", ndim="2", size="(SELECT 5 * count(*) FROM customer)", empty="false", columns="'c_custkey|c_name|c_nationkey|c_acctbal|c_mktsegment'", dtypes="5", axes="2", keys="5", len_="(SELECT count(*) FROM customer)",
        iter_="'c_custkey|c_name|c_nationkey|c_acctbal|c_mktsegment'", contains_="true", values="(SELECT sum(c_custkey) FROM customer)", to_numpy="(SELECT sum(c_custkey) FROM customer)", array_="(SELECT sum(c_custkey) FROM customer)", to_dict="(SELECT sum(c_custkey) FROM customer)", to_records="(SELECT count(*) FROM customer)",
        itertuples="(SELECT sum(c_custkey) FROM customer)", iterrows="(SELECT sum(c_custkey) FROM customer)", items="5", peek="3", get="true", dir_="true", bool_="'refused'", pipe="(SELECT max(c_custkey) FROM customer)", sql="true", at="(SELECT c_name FROM customer ORDER BY c_custkey LIMIT 1)",
        iat="(SELECT c_name FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 2)", select_dtypes="'c_custkey|c_nationkey|c_acctbal'", memory_usage="true", info="true", repr_="true", to_string="true", to_html="true", to_arrow="(SELECT sum(c_custkey) FROM customer)", dataframe_="5", to_pandas="(SELECT sum(c_custkey) FROM customer)",
        to_pandas_batches="(SELECT sum(c_custkey) FROM customer)", first_valid_index="(SELECT min(c_custkey) FROM customer)", getattr_="(SELECT max(c_custkey) FROM customer)", equals="true", differs="false",
    ),
)
def _(t):
    f, keyed = t.customer, t.indexed("customer")

    def refused():
        try:
            return bool(f)
        except ValueError:
            return "refused"

    return facts(
        t, shape=f.shape, ndim=f.ndim, size=f.size, empty=f.empty, columns=f.columns, dtypes=len(f.dtypes), axes=len(f.axes), keys=len(f.keys()), len_=len(f), iter_=list(f), contains_="c_name" in f, values=int(f[["c_custkey"]].values.sum()), to_numpy=int(f[["c_custkey"]].to_numpy().sum()),
        array_=int(np.asarray(f[["c_custkey"]].to_numpy()).sum()), to_dict=sum(f[["c_custkey"]].to_dict("list")["c_custkey"]), to_records=len(f.to_records()), itertuples=sum(r.c_custkey for r in f[["c_custkey"]].itertuples()), iterrows=sum(int(r["c_custkey"]) for _, r in f[["c_custkey"]].iterrows()), items=len(list(f.items())),
        peek=len(f.peek(3)), get=f.get("nowhere") is None, dir_="merge" in dir(f), bool_=refused(), pipe=f.pipe(lambda x: x["c_custkey"].max()), sql=len(f.sql) > 0, at=keyed.at[0, "c_name"], iat=f.iat[2, 1], select_dtypes=f.select_dtypes("number").columns, memory_usage=len(f.memory_usage()) > 0,
        info=f.info() is None, repr_=len(repr(f.head(2))) > 0, to_string="c_name" in f.head(2).to_string(), to_html="<table" in f.head(2).to_html(), to_arrow=sum(f.to_arrow().column("c_custkey").to_pylist()), dataframe_=f.__dataframe__().num_columns(), to_pandas=int(f.to_pandas()["c_custkey"].sum()),
        to_pandas_batches=int(sum(b["c_custkey"].sum() for b in f.to_pandas_batches())), first_valid_index=keyed.first_valid_index(), getattr_=f.c_custkey.max(), equals=f.equals(f.copy()), differs=f.equals(f.head(1)),
    )


C = "FROM customer"


@query(
    "series_facts",
    said_by_sql(
        "", shape=f"(SELECT count(*) {C})", size=f"(SELECT count(*) {C})", ndim="1", empty="false", hasnans="false", keys=f"(SELECT count(*) {C})", len_=f"(SELECT count(*) {C})", iter_=f"(SELECT sum(c_nationkey) {C})", contains_="true", contains_not="false", values=f"(SELECT sum(c_nationkey) {C})",
        to_numpy=f"(SELECT sum(c_nationkey) {C})", array_=f"(SELECT sum(c_nationkey) {C})", tolist=f"(SELECT sum(c_nationkey) {C})", to_list=f"(SELECT sum(c_nationkey) {C})", to_dict=f"(SELECT sum(c_custkey) {C})", to_pandas=f"(SELECT sum(c_nationkey) {C})", items=f"(SELECT sum(c_custkey) {C})",
        transpose=f"(SELECT sum(c_nationkey) {C})", item=f"(SELECT max(c_custkey) {C})", peek="3", equals="true", differs="false", iat=f"(SELECT c_name {C} ORDER BY c_custkey LIMIT 1 OFFSET 4)", iloc=f"(SELECT c_name {C} ORDER BY c_custkey LIMIT 1 OFFSET 4)", loc="'Customer#'", idxmax=f"(SELECT c_custkey {C} ORDER BY c_acctbal DESC, c_custkey LIMIT 1)",
        idxmin=f"(SELECT c_custkey {C} ORDER BY c_acctbal, c_custkey LIMIT 1)", argmax=f"(SELECT count(*) {C} WHERE c_custkey < (SELECT c_custkey {C} ORDER BY c_acctbal DESC, c_custkey LIMIT 1))", argmin=f"(SELECT count(*) {C} WHERE c_custkey < (SELECT c_custkey {C} ORDER BY c_acctbal, c_custkey LIMIT 1))",
        first_valid_index=f"(SELECT min(c_custkey) {C})", is_unique="true", cov=tenthousandths(f"SELECT covar_samp(c_nationkey, c_custkey) {C}"), product=f"(SELECT CAST(product(c_nationkey + 1) AS BIGINT) {C} WHERE c_custkey <= 5)", prod=f"(SELECT CAST(product(c_nationkey + 1) AS BIGINT) {C} WHERE c_custkey <= 5)",
        dot=f"(SELECT sum(c_nationkey * c_custkey) {C})", matmul_=f"(SELECT sum(c_nationkey * c_custkey) {C})", pipe=f"(SELECT max(c_nationkey) {C})", bool_="'refused'", repr_="true", to_string="true", to_markdown="true", to_latex="true", dtype="'string'", nunique=f"(SELECT count(DISTINCT c_nationkey) {C})",
        to_arrow=f"(SELECT sum(c_nationkey) {C})", dir_="true", get="'none'", name="'c_name'",
    ),
)
def _(t):
    f = t.indexed("customer")
    n, name, bal = f["c_nationkey"], f["c_name"], f["c_acctbal"]
    plain = t.customer
    key, nation = plain["c_custkey"], plain["c_nationkey"]
    few = (nation + 1)[key <= 5]

    def refused():
        try:
            return bool(n)
        except ValueError:
            return "refused"

    def text(s, verb):
        try:
            return len(getattr(s.head(2), verb)()) > 0
        except ImportError:  # pandas itself lacks its optional helper
            return True

    return facts(
        t, shape=n.shape, size=n.size, ndim=n.ndim, empty=n.empty, hasnans=n.hasnans, keys=len(n.keys()), len_=len(n), iter_=sum(n), contains_=1 in n, contains_not=-5 in n, values=int(n.values.sum()), to_numpy=int(n.to_numpy().sum()), array_=int(np.asarray(n.to_numpy()).sum()), tolist=sum(n.tolist()), to_list=sum(n.to_list()),
        to_dict=sum(n.to_dict()), to_pandas=int(n.to_pandas().sum()), items=sum(k for k, _ in n.items()), transpose=int(n.transpose().sum()), item=key.sort_values().tail(1).item(), peek=len(n.peek(3)), equals=n.equals(n.copy()), differs=n.equals(bal), iat=name.iat[4], iloc=name.iloc[4], loc=name.loc[1][:9], idxmax=bal.idxmax(),
        idxmin=bal.idxmin(), argmax=bal.argmax(), argmin=bal.argmin(), first_valid_index=n.first_valid_index(), is_unique=key.is_unique, cov=float(nation.cov(key)), product=int(few.product()), prod=int(few.prod()), dot=int(nation.dot(key)), matmul_=int(nation @ key), pipe=n.pipe(lambda s: s.max()),
        bool_=refused(), repr_=len(repr(n.head(2))) > 0, to_string=text(n, "to_string"), to_markdown=text(n, "to_markdown"), to_latex=text(n, "to_latex"), dtype=name.dtype.simpleString(), nunique=n.nunique(), to_arrow=sum(n.to_arrow().column("c_nationkey").to_pylist()), dir_="rolling" in dir(n), get=n.get(-5, "none"), name=name.name,
    )


I = "(SELECT c_nationkey AS k, * FROM customer)"


@query(
    "index_facts",
    said_by_sql(
        "", len_="(SELECT count(*) FROM nation)", shape="(SELECT count(*) FROM nation)", size="(SELECT count(*) FROM nation)", ndim="1", nlevels="1", empty="false", names="'n_name'", name="'n_name'", dtype="'string'", dtypes="1", is_unique="true", has_duplicates="false", is_monotonic_increasing="true", is_monotonic_decreasing="false",
        min="(SELECT min(n_nationkey) FROM nation)", max="(SELECT max(n_nationkey) FROM nation)", argmin="0", argmax="(SELECT count(*) - 1 FROM nation)", nunique="(SELECT count(DISTINCT n_regionkey) FROM nation)", all="false", any="true", contains_="true", get_loc="3", to_list="(SELECT sum(n_nationkey) FROM nation)", values="(SELECT sum(n_nationkey) FROM nation)",
        to_numpy="(SELECT sum(n_nationkey) FROM nation)", to_pandas="(SELECT sum(n_nationkey) FROM nation)", item="(SELECT max(n_nationkey) FROM nation)", repr_="true", from_frame="2", from_tuples="2", from_arrays="2", get_level_values="(SELECT sum(o_orderkey) FROM (SELECT l_orderkey AS o_orderkey FROM lineitem))", bool_="'refused'", new_="3", transpose="(SELECT count(*) FROM nation)",
    ),
)
def _(t):
    named, keyed, region = t.nation.set_index("n_name").index, t.nation.set_index("n_nationkey").index, t.nation.set_index("n_regionkey").index

    def refused():
        try:
            return bool(keyed)
        except ValueError:
            return "refused"

    lines = t.indexed("lineitem").index
    return facts(
        t, len_=len(named), shape=named.shape, size=named.size, ndim=named.ndim, nlevels=named.nlevels, empty=named.empty, names=named.names, name=named.name, dtype=named.dtype.simpleString(), dtypes=len(named.dtypes), is_unique=named.is_unique, has_duplicates=named.has_duplicates, is_monotonic_increasing=keyed.is_monotonic_increasing,
        is_monotonic_decreasing=keyed.is_monotonic_decreasing, min=keyed.min(), max=keyed.max(), argmin=keyed.argmin(), argmax=keyed.argmax(), nunique=region.nunique(), all=keyed.all(), any=keyed.any(), contains_=3 in keyed, get_loc=keyed.get_loc(3), to_list=sum(keyed.to_list()), values=int(np.sum(keyed.values)), to_numpy=int(keyed.to_numpy().sum()),
        to_pandas=int(keyed.to_pandas().to_series().sum()), item=keyed.to_series().tail(1).index.item(), repr_=len(repr(keyed)) > 0, from_frame=Index.from_frame(t.nation[["n_regionkey", "n_nationkey"]]).nlevels, from_tuples=MultiIndex.from_tuples([(1, "a"), (2, "b")], names=["x", "y"], session=t.session).nlevels,
        from_arrays=len(MultiIndex.from_arrays([[1, 2], ["a", "b"]], names=["x", "y"], session=t.session)), get_level_values=int(lines.get_level_values(0).to_series().sum()), bool_=refused(), new_=len(t.session.read_pandas(pd.Index([1, 2, 3], name="n"))), transpose=len(named.transpose()),
    )


def values(index: Index, name: str) -> DataFrame:
    """The labels of an index as a column."""
    s = index.to_series()
    return columns(s, **{name: s})


@query("index_verbs", "SELECT n_regionkey * 10 AS k, 'astype' AS verb FROM nation UNION ALL SELECT DISTINCT n_regionkey, 'unique' FROM nation UNION ALL SELECT DISTINCT n_regionkey, 'drop_duplicates' FROM nation UNION ALL SELECT n_regionkey, 'isin' FROM nation WHERE n_regionkey IN (1, 2) UNION ALL SELECT n_regionkey, 'drop' FROM nation WHERE n_regionkey NOT IN (0, 4) UNION ALL SELECT count(*), 'value_counts' FROM nation GROUP BY n_regionkey UNION ALL SELECT n_regionkey, v FROM nation, (SELECT unnest(['sort_values', 'copy', 'dropna', 'fillna', 'rename', 'to_frame']) AS v)")
def _(t):
    index = t.nation.set_index("n_regionkey").index
    made = dict(
        astype=index.astype("Int64").to_series() * 10, unique=index.unique().to_series(), drop_duplicates=index.drop_duplicates().to_series(), isin=index.to_series()[index.to_series().isin([1, 2])], drop=index.drop([0, 4]).to_series(), value_counts=index.value_counts(), sort_values=index.sort_values().to_series(), copy=index.copy().to_series(),
        dropna=index.dropna().to_series(), fillna=index.fillna(0).to_series(), rename=index.rename("r").to_series(), to_frame=index.to_frame()["n_regionkey"],
    )
    out = None
    for verb, s in made.items():
        one = s.to_spark().toDF("k").select(F.col("k").cast("bigint").alias("k"), F.lit(verb).alias("verb"))
        out = one if out is None else out.unionByName(one)
    return out


@query("datetime_index", "SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, isodow(ts) - 1 AS dayofweek, isodow(ts) - 1 AS day_of_week, isodow(ts) - 1 AS weekday FROM events")
def _(t):
    f = t.events
    index = f.set_index("ts").index
    parts = {p: getattr(index, p) for p in ("year", "month", "day", "dayofweek", "day_of_week", "weekday")}
    keyed = f["event_id"]
    rows = index.rows
    return DataFrame(rows, [("event_id", keyed.expr), *((n, (p.to_series() if isinstance(p, Index) else p).expr) for n, p in parts.items())])


# --- labels and order -------------------------------------------------------------------


@query("frame_labels", "SELECT n_nationkey AS n_nationkey_x, n_name AS pre_n_name, n_regionkey AS region FROM nation WHERE n_nationkey NOT IN (1, 2)")
def _(t):
    f = t.nation
    f = f.drop(columns=["n_regionkey"]).assign(region=f["n_regionkey"])
    f.insert(0, "first", f["region"] * 2)
    del f["first"]
    f = f[["n_nationkey"]].add_suffix("_x").assign(name=f["n_name"], region=f["region"]).rename(columns={"name": "n_name"})
    f["pre_n_name"] = f[["n_name"]].add_prefix("pre_")["pre_n_name"]
    f = f.drop(columns="n_name")
    f.region = f["region"] + 0
    f.columns = ["n_nationkey_x", "region", "pre_n_name"] if list(f.columns) == ["n_nationkey_x", "region", "pre_n_name"] else f.columns
    return f[["n_nationkey_x", "pre_n_name", "region"]].set_index("n_nationkey_x", drop=False).drop(index=[1, 2])


@query("index_levels", "SELECT l_linenumber AS a, l_orderkey AS b, l_quantity AS q FROM lineitem WHERE l_linenumber <= 2")
def _(t):
    f = t.indexed("lineitem")[["l_quantity"]]
    f = f.swaplevel().reorder_levels([1, 0]).swaplevel(0, 1).rename_axis(["a", "b"])
    s = f["l_quantity"].swaplevel().swaplevel().reorder_levels([0, 1]).rename_axis(["a", "b"])
    out = s.to_frame("q").reset_index()
    out = out[out["a"] <= 2]
    dropped = f.droplevel(1)
    assert dropped.index.names == ["a"] and s.droplevel("b").index.names == ["a"]
    return out


@query("sorted_and_taken", "SELECT p_partkey, 'take' AS verb FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS r FROM part) WHERE r IN (0, 3, 7) UNION ALL SELECT p_partkey, 'sort_index' FROM (SELECT p_partkey FROM part ORDER BY p_partkey DESC LIMIT 4) UNION ALL SELECT p_partkey, 'series_take' FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS r FROM part) WHERE r IN (1, 2) UNION ALL SELECT p_partkey, 'series_sort_index' FROM (SELECT p_partkey FROM part ORDER BY p_partkey DESC LIMIT 3) UNION ALL SELECT p_partkey, 'series_drop' FROM part WHERE p_partkey NOT IN (1, 2, 3) UNION ALL SELECT p_partkey, 'loc' FROM part WHERE p_partkey IN (5, 6)")
def _(t):
    f = t.indexed("part")
    s = t.part["p_partkey"]
    keyed = t.part.set_index("p_partkey", drop=False)
    made = dict(
        take=t.part.take([0, 3, 7])["p_partkey"], sort_index=keyed.sort_index(ascending=False).head(4)["p_partkey"], series_take=s.take([1, 2]), series_sort_index=keyed["p_partkey"].sort_index(ascending=False).head(3), series_drop=keyed["p_partkey"].drop([1, 2, 3]), loc=keyed.loc[[5, 6]]["p_partkey"],
    )
    assert f.index.names == ["p_partkey"]
    out = None
    for verb, one in made.items():
        rows = one.to_spark().toDF("p_partkey").withColumn("verb", F.lit(verb))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- two frames that meet by their index --------------------------------------------------------


@query("combine_and_update", "SELECT c.c_custkey, coalesce(x, 0) + coalesce(c_acctbal, 0) AS combined, coalesce(x, c_acctbal) AS updated, coalesce(x, -1) AS aligned, x AS reindexed FROM customer c LEFT JOIN (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS x FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey")
def _(t):
    c = t.indexed("customer")[["c_acctbal"]].rename(columns={"c_acctbal": "x"})
    n = t.orders[["o_custkey", "o_totalprice"]].groupby("o_custkey").agg(x=("o_totalprice", "size"))
    n = n.astype("float64")
    combined = c.combine(n, lambda a, b: a.fillna(0) + b.fillna(0))["x"]
    updated = c.copy()
    updated.update(n)
    left, right = c.align(n, join="left", axis=0)
    series = c["x"].copy()
    series.update(n["x"])
    out = combined.to_frame("combined")
    out = out.join(updated.rename(columns={"x": "updated"})).join(right["x"].fillna(-1).to_frame("aligned")).join(n.reindex_like(c).rename(columns={"x": "reindexed"}))
    both = series.to_frame("s").join(c["x"].combine(n["x"], lambda a, b: a.fillna(0) + b.fillna(0)).to_frame("t")).join(n["x"].reindex_like(c["x"]).to_frame("r"))
    assert both.shape[1] == 3 and left.shape[1] == 1
    return out.reset_index()


# --- statistics -----------------------------------------------------------------------------------


@query("frame_statistics", said_by_sql(
    "", idxmax="(SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1)", idxmin="(SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1)", product="(SELECT CAST(product(r_regionkey + 1) AS BIGINT) FROM region)", prod="(SELECT CAST(product(r_regionkey + 1) AS BIGINT) FROM region)",
    kurtosis=tenthousandths("SELECT kurtosis(c_acctbal) FROM customer"), kurt=tenthousandths("SELECT kurtosis(c_acctbal) FROM customer"), cov=tenthousandths("SELECT covar_samp(c_nationkey, c_acctbal) FROM customer"), corr=tenthousandths("SELECT corr(c_nationkey, c_acctbal) FROM customer"), corrwith=tenthousandths("SELECT corr(c_nationkey, c_acctbal) FROM customer"),
    dot=tenthousandths("SELECT sum(c_nationkey * c_nationkey) FROM customer"), autocorr=tenthousandths("SELECT corr(c_nationkey, p) FROM (SELECT c_nationkey, lag(c_nationkey) OVER (ORDER BY c_custkey) AS p FROM customer)"), series_kurtosis=tenthousandths("SELECT kurtosis(c_acctbal) FROM customer"), transpose="(SELECT sum(r_regionkey) FROM region)",
    any_value="true", series_describe="(SELECT count(*) FROM customer)", describe="(SELECT count(*) FROM customer)", describe_max=tenthousandths("SELECT max(c_acctbal) FROM customer"),
))
def _(t):
    keyed = t.indexed("customer")[["c_nationkey", "c_acctbal"]]
    f = t.customer[["c_nationkey", "c_acctbal"]]
    region = t.region[["r_regionkey"]] + 1
    first = lambda made, k=0: (made.to_pandas() if hasattr(made, "to_pandas") else made).iloc[k]
    pdf = lambda made: made.to_pandas() if hasattr(made, "to_pandas") else made
    d = pdf(keyed.describe())
    return facts(
        t, idxmax=int(first(keyed[["c_acctbal"]].idxmax())), idxmin=int(first(keyed[["c_acctbal"]].idxmin())), product=int(first(region.product())), prod=int(first(region.prod())), kurtosis=float(first(f[["c_acctbal"]].kurtosis())), kurt=float(first(f[["c_acctbal"]].kurt())), cov=float(pdf(f.cov()).loc["c_nationkey", "c_acctbal"]),
        corr=float(pdf(f.corr()).loc["c_nationkey", "c_acctbal"]), corrwith=float(pdf(f[["c_nationkey"]].rename(columns={"c_nationkey": "v"}).corrwith(f[["c_acctbal"]].rename(columns={"c_acctbal": "v"}))).iloc[0]), dot=float(f["c_nationkey"].dot(f["c_nationkey"])),
        autocorr=float(f["c_nationkey"].autocorr()), series_kurtosis=float(f["c_acctbal"].kurtosis()), transpose=int(t.region.set_index("r_name")[["r_regionkey"]].transpose().to_pandas().iloc[0].sum()), any_value=t.customer["c_name"].agg("any_value") is not None, series_describe=int(pdf(keyed["c_acctbal"].describe())["count"]),
        describe=int(d.loc["count", "c_acctbal"]), describe_max=float(d.loc["max", "c_acctbal"]),
    )


@query("describe_numbers", "SELECT count(c_acctbal) AS count_, round(avg(c_acctbal), 4) AS mean_, round(stddev_samp(c_acctbal), 4) AS std_, min(c_acctbal) AS min_, max(c_acctbal) AS max_ FROM customer")
def _(t):
    d = t.customer[["c_acctbal"]].describe()
    d = (d.to_pandas() if hasattr(d, "to_pandas") else d)["c_acctbal"]
    return t.spark.createDataFrame([(int(d["count"]), round(float(d["mean"]), 4), round(float(d["std"]), 4), float(d["min"]), float(d["max"]))], "count_ bigint, mean_ double, std_ double, min_ double, max_ double")


@query("groupby_statistics", "SELECT c_mktsegment, count(*) AS n, round(covar_samp(c_nationkey, c_acctbal), 4) AS cov_, round(kurtosis(c_acctbal), 4) AS kurt_, min(c_name) <= max(c_name) AS any_ FROM customer GROUP BY 1")
def _(t):
    f = t.customer
    g = f.groupby("c_mktsegment")
    cov = g[["c_nationkey", "c_acctbal"]].cov().to_pandas()[("c_nationkey", "c_acctbal")]
    kurt, kurt2 = g[["c_acctbal"]].kurtosis().to_pandas()["c_acctbal"], g["c_acctbal"].kurtosis().to_pandas()
    sizes = {k if isinstance(k, str) else k[0]: len(part) for k, part in g}
    assert len(g) == len(sizes) == len(g["c_acctbal"]) == len(list(g["c_acctbal"])) and kurt.round(6).equals(kurt2.round(6).rename("c_acctbal"))
    rows = [(k, n, round(float(cov[k]), 4), round(float(kurt[k]), 4), True) for k, n in sizes.items()]
    return t.spark.createDataFrame(rows, "c_mktsegment string, n bigint, cov_ double, kurt_ double, any_ boolean")


@query("cumulative_products", "SELECT o_orderkey, round(product(1 + o_totalprice / 1e9) OVER w, 6) AS in_group, round(product(1 + o_totalprice / 1e9) OVER w, 6) AS series_in_group FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)")
def _(t):
    f = t.indexed("orders")
    f = f.assign(m=f["o_totalprice"] / 1e9 + 1)
    g = f.groupby("o_custkey")
    return g[["m"]].cumprod()["m"].round(6).to_frame("in_group").join(g["m"].cumprod().round(6).to_frame("series_in_group")).reset_index()


@query("running_product", "SELECT p_partkey, round(product(1 + p_size / 1e6) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING), 6) AS series_, round(product(1 + p_size / 1e6) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING), 6) AS frame_ FROM part")
def _(t):
    f = t.part
    f = f.assign(m=f["p_size"] / 1e6 + 1)
    f = f.assign(series_=f["m"].cumprod().round(6))
    f = f.assign(frame_=f[["m"]].cumprod()["m"].round(6))
    return f[["p_partkey", "series_", "frame_"]]


# --- reshaping ----------------------------------------------------------------------------------------


@query("crosstab_counts", "SELECT l_returnflag, sum((l_linestatus = 'F')::INT) AS F, sum((l_linestatus = 'O')::INT) AS O FROM lineitem GROUP BY 1")
def _(t):
    f = t.lineitem
    return crosstab(f["l_returnflag"], f["l_linestatus"]).reset_index()


@query("dummies", "SELECT o_orderkey, o_orderstatus = 'F' AS s_F, o_orderstatus = 'O' AS s_O, o_orderstatus = 'P' AS s_P FROM orders")
def _(t):
    f = t.orders
    made = get_dummies(f["o_orderstatus"], prefix="s")
    return columns(f, o_orderkey=f["o_orderkey"], **{n: made[n] for n in ("s_F", "s_O", "s_P")})


@query("cut_and_qcut", "SELECT p_partkey, CASE WHEN p_size > 30 THEN 2 WHEN p_size > 10 THEN 1 WHEN p_size > 0 THEN 0 END AS c, CASE WHEN p_retailprice <= m THEN 0 ELSE 1 END AS q FROM part, (SELECT quantile_cont(p_retailprice, 0.5) AS m FROM part)")
def _(t):
    f = t.part
    return columns(f, p_partkey=f["p_partkey"], c=cut(f["p_size"], [0, 10, 30, 1000], labels=False).astype("Int64"), q=qcut(f["p_retailprice"], 2, labels=False).astype("Int64"))


@query("concat_verbs", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def _(t):
    a = t.nation[["n_nationkey", "n_name"]].rename(columns={"n_nationkey": "k", "n_name": "name"})
    b = t.region[["r_regionkey", "r_name"]].rename(columns={"r_regionkey": "k", "r_name": "name"})
    return concat([a, b], ignore_index=True)


# --- sinks, read back ---------------------------------------------------------------------------------------


def shared(t: Tables, name: str) -> str:
    import uuid

    root = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return f"{root}/{t.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


for _kind in ("parquet", "csv", "json", "orc"):

    @query(f"sink_{_kind}", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
    def _(t, kind=_kind):
        path, f = shared(t, kind), t.customer
        kinds = {"c_custkey": "int64", "c_nationkey": "Int64", "c_acctbal": "float64"}
        if kind == "parquet":
            f.to_parquet(path, index=False)
            return t.session.read_parquet(path)
        if kind == "csv":
            f.to_csv(path, index=False)
            return t.session.read_csv(path).astype(kinds)
        if kind == "json":
            f.to_json(path, orient="records", lines=True, index=False)
            return t.session.read_json(path, lines=True).astype(kinds)[list(f.columns)]
        f.to_orc(path, index=False)
        return t.session.read_orc(path)


@query("sink_table_and_batches", "SELECT r_regionkey, r_name FROM region")
def _(t):
    import uuid

    name = f"region_{uuid.uuid4().hex}"
    t.region.to_table(name, if_exists="replace")
    again = t.session.read_table(name)
    arrow = t.session.read_arrow(again[["r_regionkey", "r_name"]].to_arrow())
    assert sum(len(b) for b in again.to_pandas_batches()) == len(arrow)
    return arrow.cache()


@query("reader_options", "SELECT p_partkey, p_size FROM part WHERE p_size > 40")
def _(t):
    name = f"part_{id(t)}"
    t.session.create_external_table(name, t.path("part"), replace=True)
    got = t.session.read_table(name, columns=["p_partkey", "p_size"], filters=[("p_size", ">", 40)])
    same = t.session.read(f"SELECT p_partkey, p_size FROM {name} WHERE p_size > 40")
    assert got.shape == same.shape
    return got


# --- time -------------------------------------------------------------------------------------------------------


@query("time_parsing", "SELECT event_id, ts AS parsed, make_timestamp(epoch_us(ts)) AS from_micros, make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS from_seconds, epoch_us(to_minutes(event_id)) AS minutes_, epoch_us(ts + INTERVAL 3 DAY) - epoch_us(ts) AS three_days FROM events")
def _(t):
    import datetime

    from .. import sql

    f = t.events
    micros = sql.unix_micros(f["ts"])
    seconds = sql.unix_seconds(f["ts"])
    later = f["ts"] + datetime.timedelta(days=3)
    return columns(
        f, event_id=f["event_id"], parsed=to_datetime(f["ts"].dt.strftime("%Y-%m-%d %H:%M:%S.%f"), format="%Y-%m-%d %H:%M:%S.%f"), from_micros=to_datetime(micros, unit="us"), from_seconds=to_datetime(seconds, unit="s"), minutes_=to_timedelta(f["event_id"], "m").astype("int64"), three_days=(later - f["ts"]).astype("int64"),
    )


@query("timedelta_verbs", "SELECT o_orderkey, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, CAST(o_orderdate AS DATE) + 5 AS date_plus, CAST(o_orderdate AS DATE) - 5 AS date_minus, epoch_us(o_orderdate) - coalesce(lag(epoch_us(o_orderdate)) OVER (ORDER BY o_orderkey), epoch_us(o_orderdate)) AS since FROM orders")
def _(t):
    import datetime

    f = t.orders
    o = f["o_orderdate"]
    day = o.astype("date")
    since = o.diff().astype("int64").fillna(0)
    return columns(f, o_orderkey=f["o_orderkey"], days=(day - datetime.date(1995, 1, 1)).dt.days, date_plus=(day + datetime.timedelta(days=5)).astype("date"), date_minus=(day - datetime.timedelta(days=5)).astype("date"), since=since)


# --- strings and arrays --------------------------------------------------------------------------------------------


@query("string_padding", "SELECT p_partkey, lpad(p_brand, 12, ' ') AS left_, rpad(p_brand, 12, '*') AS right_, substr(p_name, 2, 3) AS slice_, repeat('-', (12 - length(p_brand)) // 2) || p_brand || repeat('-', 12 - length(p_brand) - (12 - length(p_brand)) // 2) AS both_, 'Brand' || substr(p_brand, 6) AS cat_ FROM part")
def _(t):
    f = t.part
    b = f["p_brand"].str
    return columns(f, p_partkey=f["p_partkey"], left_=b.pad(12), right_=b.pad(12, side="right", fillchar="*"), slice_=f["p_name"].str.slice(1, 4), both_=b.center(12, "-"), cat_=b.slice(0, 5) + b.slice(5))
