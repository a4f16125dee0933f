"""Scalar operators, family by family."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import to_datetime, to_timedelta
from ..functions import datetimes, geo, logic, nested, numeric, vector
from ..functions.typed import literal
from ..plans.frame import DataFrame, Series
from .registry import query

UNARY = {
    "sin": "sin(x)", "cos": "cos(x)", "tan": "tan(x)", "arctan": "atan(x)", "sinh": "sinh(x/1000)", "cosh": "cosh(x/1000)", "tanh": "tanh(x/1000)", "arcsinh": "asinh(x)",
    "exp": "exp(x/1000)", "expm1": "exp(x/1000) - 1", "sqrt": "sqrt(abs(x))", "floor": "floor(x)", "ceil": "ceil(x)", "abs": "abs(x)", "negative": "-x", "positive": "x", "log1p": "ln(1 + abs(x))", "arccosh": "acosh(1 + abs(x))",
}
SCALED = {"sinh", "cosh", "tanh", "exp", "expm1"}
SHIFTED = {"sqrt": lambda s: s.abs(), "log1p": lambda s: s.abs(), "arccosh": lambda s: s.abs() + 1}


@query("numeric_unary", "SELECT c_custkey, " + ", ".join(f"round({e.replace('x', 'c_acctbal') if 'exp' not in n else e.replace('(x', '(c_acctbal')}, 4) AS {n}_v" for n, e in UNARY.items() if n != "arccosh") + ", round(acosh(1 + abs(c_acctbal)), 4) AS arccosh_v FROM customer")
def _(t):
    c = t.customer
    x = c["c_acctbal"]
    out = [("c_custkey", c["c_custkey"].expr)]
    for n in UNARY:
        arg = SHIFTED.get(n, lambda s: s / 1000 if n in SCALED else s)(x)  # noqa: B023
        out.append((f"{n}_v", F.round(numeric.UNARY[n](arg.v), 4)))
    return c._new(out)


@query("numeric_domain", "SELECT l_orderkey, l_linenumber, round(asin(l_discount), 6) AS arcsin_v, round(acos(l_discount), 6) AS arccos_v, round(atanh(l_discount), 6) AS arctanh_v, CASE WHEN l_discount = 0 THEN '-inf' ELSE CAST(round(ln(CASE WHEN l_discount = 0 THEN 1 ELSE l_discount END), 4) AS VARCHAR) END IS NOT NULL AS ln_known, round(atan2(l_discount, l_tax), 6) AS arctan2_v FROM lineitem")
def _(t):
    f = t.lineitem
    d = f["l_discount"]
    keep = [(n, f[n].expr) for n in ("l_orderkey", "l_linenumber")]
    return f._new([*keep, *((f"{n}_v", F.round(numeric.UNARY[n](d.v), 6)) for n in ("arcsin", "arccos", "arctanh")), ("ln_known", numeric.ln(d.v).isNotNull()), ("arctan2_v", F.round(numeric.BINARY["arctan2"](d.v, f["l_tax"].v), 6))])


@query("numeric_logs_at_zero", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 'neg_inf' ELSE 'finite' END AS ln_kind, CASE WHEN l_discount = 0 THEN 'neg_inf' ELSE 'finite' END AS log10_kind, round(CASE WHEN l_discount = 0 THEN 0 ELSE log10(greatest(l_discount, 1e-9)) END, 6) AS log10_v FROM lineitem")
def _(t):
    f = t.lineitem
    d = f["l_discount"].v
    kind = lambda c: F.when(c == float("-inf"), "neg_inf").otherwise("finite")
    return f._new([("l_orderkey", f["l_orderkey"].expr), ("l_linenumber", f["l_linenumber"].expr), ("ln_kind", kind(numeric.ln(d))), ("log10_kind", kind(numeric.log10(d))), ("log10_v", F.round(F.when(d.col == 0, 0.0).otherwise(numeric.log10(d)), 6))])


@query("arithmetic", "SELECT l_orderkey, l_linenumber, round(l_extendedprice + l_quantity, 4) AS add_v, round(l_extendedprice - l_tax, 4) AS sub_v, round(l_extendedprice * (1 - l_discount), 4) AS mul_v, round(l_extendedprice / l_quantity, 8) AS div_v, l_orderkey // l_linenumber AS floordiv_v, l_orderkey % 7 AS mod_v, floor(-l_orderkey / 7.0)::BIGINT AS negfloor_v, ((-l_orderkey % 7) + 7) % 7 AS negmod_v, (l_linenumber * l_linenumber)::BIGINT AS pow_v, round(pow(l_quantity, 0.5), 4) AS root_v, round(100 - l_quantity, 4) AS rsub_v, round(l_extendedprice, 1) AS round_v FROM lineitem")
def _(t):
    f = t.lineitem
    k, n = f["l_orderkey"], f["l_linenumber"]
    p, q = f["l_extendedprice"], f["l_quantity"]
    r = lambda s: s.round(4)
    return DataFrame(f.rows, [(c, s.expr) for c, s in {
        "l_orderkey": k, "l_linenumber": n, "add_v": r(p + q), "sub_v": r(p - f["l_tax"]), "mul_v": r(p * (1 - f["l_discount"])), "div_v": (p / q).round(8), "floordiv_v": k // n, "mod_v": k % 7,
        "negfloor_v": -k // 7, "negmod_v": -k % 7, "pow_v": n ** 2, "root_v": r(q ** 0.5), "rsub_v": r(100 - q), "round_v": p.round(1),
    }.items()])


@query("division_by_zero", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN value > 0 THEN 'inf' WHEN value < 0 THEN '-inf' ELSE 'nan' END ELSE 'finite' END AS div_kind, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id // (event_id % 3) END AS floordiv_v, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % (event_id % 3) END AS mod_v FROM events WHERE value IS NOT NULL")
def _(t):
    f = t.events
    f = f[f["value"].notna()]
    k = f["event_id"]
    by = k % 3
    q = (f["value"] / by).expr
    kind = F.when(F.isnan(q), "nan").when(q == float("inf"), "inf").when(q == float("-inf"), "-inf").otherwise("finite")
    return f._new([("event_id", k.expr), ("div_kind", kind), ("floordiv_v", (k // by).expr), ("mod_v", (k % by).expr)])


@query("int_pow_overflow", "SELECT p_partkey, CASE WHEN p_size <= 8 THEN CAST(p_size ** 10 AS BIGINT) ELSE NULL END AS big FROM part")
def _(t):
    f = t.part
    return f._new([("p_partkey", f["p_partkey"].expr), ("big", F.when(f["p_size"].expr <= 8, numeric.power(f["p_size"].v, literal(10))))])


@query("comparison", "SELECT o_orderkey, o_totalprice = 1000 AS eq_v, o_totalprice <> 1000 AS ne_v, o_totalprice < 50000 AS lt_v, o_totalprice <= 50000 AS le_v, o_totalprice > 50000 AS gt_v, o_totalprice >= 50000 AS ge_v, o_totalprice BETWEEN 1000 AND 90000 AS between_v, o_orderpriority IN ('1-URGENT', '2-HIGH') AS isin_v, (o_totalprice > 50000) AND (o_orderstatus = 'F') AS and_v, (o_totalprice > 50000) OR (o_orderstatus = 'F') AS or_v, (o_totalprice > 50000) <> (o_orderstatus = 'F') AS xor_v, NOT (o_totalprice > 50000) AS not_v FROM orders")
def _(t):
    f = t.orders
    p, s = f["o_totalprice"], f["o_orderstatus"]
    big, fin = p > 50000, s == "F"
    return DataFrame(f.rows, [(n, x.expr) for n, x in {"o_orderkey": f["o_orderkey"], "eq_v": p == 1000, "ne_v": p != 1000, "lt_v": p < 50000, "le_v": p <= 50000, "gt_v": big, "ge_v": p >= 50000, "between_v": p.between(1000, 90000), "isin_v": f["o_orderpriority"].isin(["1-URGENT", "2-HIGH"]), "and_v": big & fin, "or_v": big | fin, "xor_v": big ^ fin, "not_v": ~big}.items()])


@query("bitwise", "SELECT p_partkey, (p_partkey & 12)::BIGINT AS and_v, (p_partkey | 3)::BIGINT AS or_v, xor(p_partkey, 5)::BIGINT AS xor_v, (~p_partkey)::BIGINT AS not_v FROM part")
def _(t):
    f = t.part
    k = f["p_partkey"]
    return DataFrame(f.rows, [("p_partkey", k.expr), ("and_v", (k & 12).expr), ("or_v", (k | 3).expr), ("xor_v", (k ^ 5).expr), ("not_v", (~k).expr)])


@query("nulls_and_conditionals", "WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS x, value, event_type FROM events) SELECT event_id, x IS NULL AS isnull_v, x IS NOT NULL AS notnull_v, coalesce(x, -1) AS fill_v, CASE WHEN x > 10 THEN x END AS where_v, CASE WHEN NOT (x > 10) OR x IS NULL THEN x END AS mask_v, CASE WHEN x IS NULL THEN NULL ELSE least(greatest(x, 5), 50) END AS clip_v, (CASE WHEN x > 50 THEN 2 WHEN x > 10 THEN 1 ELSE 0 END)::BIGINT AS case_v, CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' ELSE event_type END AS repl_v, (CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 END)::BIGINT AS map_v, CASE WHEN x IS NULL THEN NULL ELSE greatest(x, 20) END AS max_v, CASE WHEN x IS NULL THEN NULL ELSE least(x, 20) END AS min_v FROM e")
def _(t):
    f = t.events
    x = f["value"].mask(f["event_id"] % 5 == 0)
    k = f["event_type"]
    cases = logic.case_when([((x > 50).v, literal(2)), ((x > 10).v, literal(1))], literal(0))
    out = {"event_id": f["event_id"].expr, "isnull_v": x.isna().expr, "notnull_v": x.notna().expr, "fill_v": x.fillna(-1).expr, "where_v": x.where(x > 10).expr, "mask_v": F.when((x > 10).fillna(False).expr, None).otherwise(x.expr), "clip_v": x.clip(5, 50).expr, "case_v": cases, "repl_v": k.replace({"click": "c", "view": "v"}).expr, "map_v": k.map({"click": 1, "view": 2}).expr, "max_v": logic.maximum(x.v, literal(20)), "min_v": logic.minimum(x.v, literal(20))}
    return f._new(list(out.items()))


@query("casts", "SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS DOUBLE) AS f, CAST(l_linenumber AS VARCHAR) AS s, CAST(trunc(l_extendedprice) AS BIGINT) AS i, CASE WHEN l_linenumber > 2 THEN 'True' ELSE 'False' END AS bs, l_discount <> 0 AS b, CAST(l_shipdate AS DATE) AS d, TRY_CAST(l_returnflag AS BIGINT) AS safe FROM lineitem")
def _(t):
    f = t.lineitem
    return DataFrame(f.rows, [(n, s.expr) for n, s in {"l_orderkey": f["l_orderkey"], "l_linenumber": f["l_linenumber"], "f": f["l_orderkey"].astype("float64"), "s": f["l_linenumber"].astype("string"), "i": f["l_extendedprice"].astype("int64"), "bs": (f["l_linenumber"] > 2).astype("string"), "b": f["l_discount"].astype("bool"), "d": f["l_shipdate"].astype("date"), "safe": f["l_returnflag"].astype("int64", errors="null")}.items()])


@query("string_basic", "SELECT p_partkey, upper(p_name) AS up, lower(p_name) AS low, reverse(p_name) AS rev, length(p_name) AS n, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) AS cap, trim(p_name, 'a') AS st, ltrim(p_name, 'ab') AS ls, rtrim(p_name, 'e') AS rs, repeat(p_brand, 2) AS rep, p_name || '-' || p_brand AS cat FROM part")
def _(t):
    f = t.part
    s, b = f["p_name"], f["p_brand"]
    return DataFrame(f.rows, [(n, x.expr) for n, x in {"p_partkey": f["p_partkey"], "up": s.str.upper(), "low": s.str.lower(), "rev": s.str.reverse(), "n": s.str.len(), "cap": s.str.capitalize(), "st": s.str.strip("a"), "ls": s.str.lstrip("ab"), "rs": s.str.rstrip("e"), "rep": b.str.repeat(2), "cat": (s + "-").str.cat(b)}.items()])


@query("string_search", "SELECT p_partkey, contains(p_name, 'a') AS has, regexp_matches(p_type, 'S[A-Z]+L') AS rx, starts_with(p_type, 'S') OR starts_with(p_type, 'P') AS st, ends_with(p_type, 'L') AS en, instr(p_name, 'e') - 1 AS at, regexp_matches(p_brand, '^(?:Brand)') AS m, regexp_full_match(p_brand, 'Brand#[0-9]+') AS fm, CASE WHEN regexp_matches(p_brand, '#([0-9]+)') THEN regexp_extract(p_brand, '#([0-9]+)', 1) END AS ex, replace(p_type, 'A', 'x') AS rp, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS rr FROM part")
def _(t):
    f = t.part
    s, k, b = f["p_name"].str, f["p_type"].str, f["p_brand"].str
    return DataFrame(f.rows, [(n, x.expr) for n, x in {"p_partkey": f["p_partkey"], "has": s.contains("a", regex=False), "rx": k.contains("S[A-Z]+L"), "st": k.startswith(("S", "P")), "en": k.endswith("L"), "at": s.find("e"), "m": b.match("Brand"), "fm": b.fullmatch("Brand#[0-9]+"), "ex": b.extract("#([0-9]+)")[0], "rp": k.replace("A", "x"), "rr": k.replace("[AEIOU]", "_", regex=True)}.items()])


@query("string_shape", "SELECT c_custkey, lpad(c_mktsegment, greatest(length(c_mktsegment), 12)::INT, '*') AS lp, rpad(c_mktsegment, greatest(length(c_mktsegment), 12)::INT, '*') AS rp, lpad(CAST(c_custkey AS VARCHAR), greatest(8, length(CAST(c_custkey AS VARCHAR)))::INT, '0') AS z, substr(c_name, 3, 4) AS sl, substr(c_name, 1, 1) AS g, array_to_string(string_split(c_name, '#'), '|') AS sp, substr(c_name, length(c_name) - 2, 3) AS tail FROM customer")
def _(t):
    f = t.customer
    s, m = f["c_name"].str, f["c_mktsegment"].str
    return DataFrame(f.rows, [(n, x.expr) for n, x in {"c_custkey": f["c_custkey"], "lp": m.rjust(12, "*"), "rp": m.ljust(12, "*"), "z": f["c_custkey"].astype("string").str.zfill(8), "sl": s[2:6], "g": s[0], "sp": s.split("#").str.join("|"), "tail": s[-3:]}.items()])


@query("string_classes_whole", "WITH s AS (SELECT doc_id, coalesce(text, '') AS x FROM documents) SELECT doc_id, regexp_full_match(x, '[\\p{N}\\p{L}]+') AS an, regexp_full_match(x, '\\p{L}+') AS al, regexp_full_match(x, '\\p{Nd}+') AS de, regexp_full_match(x, '\\p{N}+') AS nu, regexp_full_match(x, '\\s+') AS sp, lower(x) = x AND upper(x) <> x AS lo, upper(x) = x AND lower(x) <> x AS up FROM s")
def _(t):
    f = t.documents
    s = f["text"].fillna("").str
    return DataFrame(f.rows, [(n, x.expr) for n, x in {"doc_id": f["doc_id"], "an": s.isalnum(), "al": s.isalpha(), "de": s.isdecimal(), "nu": s.isnumeric(), "sp": s.isspace(), "lo": s.islower(), "up": s.isupper()}.items()])


@query("string_digits", "SELECT p_partkey, regexp_full_match(CAST(p_size AS VARCHAR), '[0-9]+') AS dg, regexp_full_match(p_brand, '[0-9]+') AS db FROM part")
def _(t):
    f = t.part
    return DataFrame(f.rows, [("p_partkey", f["p_partkey"].expr), ("dg", f["p_size"].astype("string").str.isdigit().expr), ("db", f["p_brand"].str.isdigit().expr)])


@query("datetime_parts", "SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, CAST(floor(second(ts)) AS BIGINT) AS s, quarter(ts) AS q, isodow(ts) - 1 AS dow, dayofyear(ts) AS doy, week(ts) AS iw, isoyear(ts) AS iy, isodow(ts) AS id, dayname(ts) AS dn, CAST(ts AS DATE) AS dt, date_trunc('day', ts) AS nm FROM events")
def _(t):
    f = t.events
    d = f["ts"].dt
    iso = d.isocalendar()
    return DataFrame(f.rows, [(n, x.expr) for n, x in {"event_id": f["event_id"], "y": d.year, "mo": d.month, "d": d.day, "h": d.hour, "mi": d.minute, "s": d.second, "q": d.quarter, "dow": d.dayofweek, "doy": d.dayofyear, "iw": iso["week"], "iy": iso["year"], "id": iso["day"], "dn": d.day_name(), "dt": d.date, "nm": d.normalize()}.items()])


@query("datetime_floor_format", "SELECT event_id, date_trunc('hour', ts) AS fh, date_trunc('month', ts) AS fm, date_trunc('week', ts) AS fw, date_trunc('quarter', ts) AS fq, date_trunc('year', ts) AS fy, strftime(ts, '%Y/%m/%d %H-%M-%S') AS sf, strftime(ts, '%H:%M:%S.%f') AS tm, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000000 AS sec FROM events")
def _(t):
    f = t.events
    d, v = f["ts"].dt, f["ts"].v
    out = {"event_id": f["event_id"], "fh": d.floor("h"), "fm": d.floor("M"), "fw": d.floor("W"), "fq": d.floor("Q"), "fy": d.floor("Y"), "sf": d.strftime("%Y/%m/%d %H-%M-%S"), "tm": d.time, "us": f["ts"]._new(datetimes.PARTS["unix_micros"](v)), "ms": f["ts"]._new(datetimes.PARTS["unix_millis"](v)), "sec": f["ts"]._new(datetimes.PARTS["unix_seconds"](v))}
    return DataFrame(f.rows, [(n, x.expr) for n, x in out.items()])


@query("timedelta", "SELECT o_orderkey, o_orderdate + INTERVAL 36 HOUR AS plus, o_orderdate - INTERVAL 1 DAY AS minus, epoch_us(o_orderdate - TIMESTAMP '1995-01-01') // 86400000000 AS days_v, CAST(epoch_us(o_orderdate - TIMESTAMP '1995-01-01') / 1e6 AS DOUBLE) AS secs FROM orders")
def _(t):
    import datetime

    f = t.orders
    o = f["o_orderdate"]
    gap = o - datetime.datetime(1995, 1, 1)
    return DataFrame(f.rows, [("o_orderkey", f["o_orderkey"].expr), ("plus", (o + datetime.timedelta(hours=36)).expr), ("minus", (o - datetime.timedelta(days=1)).expr), ("days_v", gap.dt.days.expr), ("secs", gap.dt.total_seconds().expr)])


@query("to_datetime_and_timedelta", "SELECT event_id, strptime(strftime(ts, '%Y-%m-%d %H:%M'), '%Y-%m-%d %H:%M') AS parsed, make_timestamp(event_id * 1000000) AS from_s, epoch_us(to_seconds(event_id)) AS td_us FROM events")
def _(t):
    f = t.events
    text = f["ts"].dt.strftime("%Y-%m-%d %H:%M")
    td = to_timedelta(f["event_id"], "s")
    return DataFrame(f.rows, [("event_id", f["event_id"].expr), ("parsed", to_datetime(text, format="%Y-%m-%d %H:%M").expr), ("from_s", to_datetime(f["event_id"], unit="s").expr), ("td_us", td.astype("int64").expr)])


@query("date_diff", "SELECT o_orderkey, CAST(o_orderdate AS DATE) - DATE '1995-06-17' AS d FROM orders")
def _(t):
    import datetime

    f = t.orders
    day = f["o_orderdate"].astype("date")
    gap = datetimes.date_diff(day.v, literal(datetime.date(1995, 6, 17)))
    return f._new([("o_orderkey", f["o_orderkey"].expr), ("d", day._new(gap).dt.days.expr)])


@query("arrays", "SELECT vec_id, len(embedding) AS n, round(embedding[1], 5) AS first_v, round(list_sum(embedding[1:4]::DOUBLE[]), 4) AS sum4, round(list_max(embedding), 5) AS mx, round(list_min(embedding), 5) AS mn, len(embedding[3:10]) AS sl, len(list_filter(embedding, lambda x: x > 0)) AS pos FROM embeddings")
def _(t):
    f = t.embeddings
    e = f["embedding"]
    cut = e.list[0:4].expr
    out = {"vec_id": f["vec_id"].expr, "n": e.list.len().expr, "first_v": F.round(e.list[0].expr, 5), "sum4": F.round(nested.array_reduce(cut, "sum"), 4), "mx": F.round(nested.array_reduce(e.expr, "max"), 5), "mn": F.round(nested.array_reduce(e.expr, "min"), 5), "sl": F.size(e.list[2:10].expr).cast("bigint"), "pos": F.size(F.filter(e.expr, lambda x: x > 0)).cast("bigint")}
    return f._new(list(out.items()))


@query("array_build_map_join", "SELECT n_nationkey, array_to_string([n_name, CAST(n_regionkey AS VARCHAR)], ':') AS joined, len([n_nationkey, n_regionkey]) AS n, list_sum(list_transform([n_nationkey, n_regionkey], lambda x: x * 2))::BIGINT AS twice FROM nation")
def _(t):
    f = t.nation
    a, b = f["n_nationkey"].expr, f["n_regionkey"].expr
    return f._new([("n_nationkey", a), ("joined", F.array_join(F.array(f["n_name"].expr, b.cast("string")), ":")), ("n", F.size(F.array(a, b)).cast("bigint")), ("twice", F.aggregate(F.transform(F.array(a, b), lambda x: x * 2), F.lit(0), lambda x, y: x + y).cast("bigint"))])


@query("structs", "SELECT n_nationkey, n_name AS name_v, n_regionkey AS region_v FROM nation")
def _(t):
    f = t.nation
    s = Series(f.rows, F.struct(f["n_name"].expr.alias("name"), f["n_regionkey"].expr.alias("region")), "s")
    wide = f._new([("n_nationkey", f["n_nationkey"].expr), ("s", s.expr)]).struct.explode("s")
    return wide.rename(columns={"s.name": "name_v", "s.region": "region_v"})


@query("json_scalars", "SELECT event_id, json_extract_string(props, '$.k') AS v, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n, json_keys(props)[1] AS k1 FROM events")
def _(t):
    f = t.events
    p = f["props"].expr
    v = nested.json_value(p, "$.k")
    return f._new([("event_id", f["event_id"].expr), ("v", v), ("n", v.cast("bigint")), ("k1", F.get(nested.json_keys(p, 1), 0))])


@query("json_build_and_query", "SELECT n_nationkey, n_name AS name_v, '[' || n_nationkey || ',' || n_regionkey || ']' AS arr, 2 AS n, CAST(n_regionkey AS VARCHAR) AS second FROM nation")
def _(t):
    f = t.nation
    doc = F.to_json(F.struct(f["n_name"].expr.alias("name"), F.array(f["n_nationkey"].expr, f["n_regionkey"].expr).alias("ids")))
    ids = nested.json_string_array(doc, "$.ids")
    return f._new([("n_nationkey", f["n_nationkey"].expr), ("name_v", nested.json_value(doc, "$.name")), ("arr", nested.json_query(doc, "$.ids")), ("n", F.size(nested.json_array(doc, "$.ids"))), ("second", F.get(ids, 1))])


@query("json_set", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS old, 1 AS new_v FROM events")
def _(t):
    f = t.events
    p = nested.json_set(f["props"].expr, "$.added", 1)
    return f._new([("event_id", f["event_id"].expr), ("old", nested.json_value(p, "$.k").cast("bigint")), ("new_v", nested.json_value(p, "$.added").cast("int"))])


@query("vector_distances", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 5) AS cosine, round(list_distance(embedding::DOUBLE[], e::DOUBLE[]), 4) AS euclid, round(list_sum(list_transform(list_zip(embedding, e), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))), 4) AS manhattan FROM embeddings, q")
def _(t):
    f = t.embeddings
    first = [float(x) for x in f.rows.sdf.where("vec_id = 0").select("embedding").first()[0]]
    q = F.array(*(F.lit(x).cast("float") for x in first))
    e = f["embedding"].expr
    return f._new([("vec_id", f["vec_id"].expr), ("cosine", F.round(vector.cosine(e, q), 5)), ("euclid", F.round(vector.euclidean(e, q), 4)), ("manhattan", F.round(vector.manhattan(e, q), 4))])


@query("geo_points", "WITH p AS (SELECT c_custkey, ((c_custkey % 360) - 180.0)::DOUBLE AS x, ((c_custkey % 170) - 85.0)::DOUBLE AS y FROM customer) SELECT c_custkey, x, y, round(2 * 6371010 * asin(sqrt(least(1.0, pow(sin(radians(10.0 - y) / 2), 2) + cos(radians(y)) * cos(radians(10.0)) * pow(sin(radians(20.0 - x) / 2), 2)))), 0) AS metres FROM p")
def _(t):
    f = t.customer
    k = f["c_custkey"]
    x, y = (k % 360 - 180.0).expr, (k % 170 - 85.0).expr
    g = Series(f.rows, geo.st_geogpoint(x, y), "g")
    return f._new([("c_custkey", k.expr), ("x", g.geo.x.expr), ("y", g.geo.y.expr), ("metres", F.round(geo.st_distance(g.expr, F.lit("POINT(20 10)")), 0))])


@query("geo_shapes")
def _(t):
    f = t.nation
    k = f["n_nationkey"].expr.cast("string")
    g = Series(f.rows, F.concat(F.lit("POLYGON((0 0, "), k, F.lit(" 0, "), k, F.lit(" 1, 0 1, 0 0))")), "g")
    g = Series(f.rows, F.when(f["n_nationkey"].expr > 0, g.expr), "g")
    return DataFrame(f.rows, [("n_nationkey", f["n_nationkey"].expr), ("area", F.round(g.geo.area.expr)), ("length", F.round(g.geo.length.expr)), ("centroid", g.geo.centroid.expr), ("hull", g.geo.convex_hull.expr), ("closed", g.geo.is_closed.expr), ("boundary", g.geo.boundary.expr), ("simple", g.geo.simplify(10.0).expr), ("buffered", F.length(g.geo.buffer(1000.0).expr)), ("cut", geo.st_intersection(g.expr, F.lit("POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))"))), ("rest", geo.st_difference(g.expr, F.lit("POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))")))])


@query("hash_and_rowkey")
def _(t):
    f = t.nation
    return f._new([("n_nationkey", f["n_nationkey"].expr), ("h", logic.hash_(f["n_name"].v))])


@query("udf_scalar", "SELECT n_nationkey, (n_nationkey * n_nationkey + 1)::BIGINT AS sq, upper(n_name) || '!' AS shout FROM nation")
def _(t):
    from .. import udf

    @udf
    def square(x: int) -> int:
        return None if x is None else x * x + 1

    @udf(output_type=str)
    def shout(x):
        return None if x is None else x.upper() + "!"

    f = t.nation
    return DataFrame(f.rows, [("n_nationkey", f["n_nationkey"].expr), ("sq", f["n_nationkey"].apply(square).expr), ("shout", f["n_name"].map(shout, na_action="ignore").expr)])


@query("udf_rows", "SELECT n_nationkey, (n_nationkey * 100 + n_regionkey)::BIGINT AS code FROM nation")
def _(t):
    f = t.nation

    def code(row) -> int:
        return int(row["n_nationkey"]) * 100 + int(row["n_regionkey"])

    two = f[["n_nationkey", "n_regionkey"]]
    return f._new([("n_nationkey", f["n_nationkey"].expr), ("code", two.apply(code, axis=1).expr)])


@query("sql_template", "SELECT c_custkey, round(c_acctbal * 2 + 1, 3) AS v FROM customer")
def _(t):
    from ..functions.templates import sql_scalar

    f = t.customer
    return f._new([("c_custkey", f["c_custkey"].expr), ("v", sql_scalar("round({0} * 2 + 1, 3)", [f["c_acctbal"]]).expr)])


