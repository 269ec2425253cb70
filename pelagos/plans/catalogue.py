"""The registered queries of the engine, each with the SQL that it must agree with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], SparkFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None, *tables: str):
    """Registers a function of frames over ``tables``, which gives a Spark frame."""

    def add(func):
        def run(spark: SparkSession, sf_dir: str) -> SparkFrame:
            from pelagos.sources.files import read_parquet

            return func(*(read_parquet(f"{sf_dir}/{t}.parquet") for t in tables))

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return func

    return add


def _rounded(sdf: SparkFrame, digits: int, *columns: str) -> SparkFrame:
    """Sums of doubles depend on their order: they are compared rounded."""
    return sdf.withColumns({c: F.round(c, digits) for c in columns})


# projection, predicates


@query("scan_project", "SELECT o_orderkey, o_totalprice FROM orders", "orders")
def scan_project(o):
    return o[["o_orderkey", "o_totalprice"]].to_spark()


_COLUMNS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]


@query("filter_conj", f"SELECT {', '.join(_COLUMNS)} FROM lineitem WHERE l_quantity < 24 AND l_discount >= 0.05", "lineitem")
def filter_conj(x):
    return x[(x["l_quantity"] < 24) & (x["l_discount"] >= 0.05)][_COLUMNS].to_spark()


@query("filter_or_not", f"SELECT {', '.join(_COLUMNS)} FROM lineitem WHERE NOT (l_quantity <= 40) OR l_returnflag = 'R'", "lineitem")
def filter_or_not(x):
    return x[~(x["l_quantity"] <= 40) | (x["l_returnflag"] == "R")][_COLUMNS].to_spark()


for _name, _op in (("lt", "<"), ("le", "<="), ("eq", "="), ("ne", "<>"), ("ge", ">="), ("gt", ">")):

    @query(f"filter_{_name}", f"SELECT p_partkey, p_size FROM part WHERE p_size {_op} 25", "part")
    def _filter(p, op=f"__{_name}__"):
        return p[getattr(p["p_size"], op)(25)][["p_partkey", "p_size"]].to_spark()


@query("filter_str_eq", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'", "orders")
def filter_str_eq(o):
    return o[o["o_orderstatus"] != "F"][["o_orderkey", "o_orderstatus"]].to_spark()


@query("frame_compare", "SELECT c_custkey < 700 AS c_custkey, c_nationkey < 700 AS c_nationkey, c_acctbal < 700 AS c_acctbal FROM customer", "customer")
def frame_compare(c):
    return (c < 700).to_spark()


@query("filter_by_index", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 500", "orders")
def filter_by_index(o):
    frame = o[["o_orderkey", "o_totalprice"]].set_index("o_orderkey")
    return frame[frame.index < 500].to_spark(include_index=True)


# arithmetic


@query("arith_columns", "SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS revenue FROM lineitem", "lineitem")
def arith_columns(x):
    x["revenue"] = x["l_extendedprice"] * x["l_discount"]
    return x[["l_orderkey", "l_linenumber", "revenue"]].to_spark()


@query("arith_scalar", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity * 2 + 1 - 23 AS shifted, l_extendedprice / 4 AS quarter FROM lineitem", "lineitem")
def arith_scalar(x):
    x["net"] = x["l_extendedprice"] * (1 - x["l_discount"])
    x["shifted"] = x["l_quantity"] * 2 + 1 - 23
    x["quarter"] = x["l_extendedprice"] / 4
    return x[["l_orderkey", "l_linenumber", "net", "shifted", "quarter"]].to_spark()


@query("arith_frame_scalar", "SELECT s_suppkey * 2 AS s_suppkey, s_acctbal * 2 AS s_acctbal FROM supplier", "supplier")
def arith_frame_scalar(s):
    return (s[["s_suppkey", "s_name", "s_acctbal"]] * 2).to_spark()


@query("arith_frame_list", "SELECT s_suppkey + 5 AS s_suppkey, s_acctbal + 0.5 AS s_acctbal FROM supplier", "supplier")
def arith_frame_list(s):
    return (s[["s_suppkey", "s_name", "s_acctbal"]] + [5, 0.5]).to_spark()


@query("int_div_keep_dtype", "SELECT p_partkey, CAST(p_size // 2 AS INTEGER) AS half, CAST((p_size - 30) // 7 AS INTEGER) AS signed FROM part", "part")
def int_div_keep_dtype(p):
    p["half"] = p["p_size"] / 2
    p["signed"] = (p["p_size"] - 30) / 7
    return p[["p_partkey", "half", "signed"]].to_spark()


@query("pow_scalar", "SELECT p_partkey, CAST(p_size * p_size AS INTEGER) AS squared FROM part", "part")
def pow_scalar(p):
    p["squared"] = p["p_size"] ** 2
    return p[["p_partkey", "squared"]].to_spark()


@query(
    "positional_sum",
    """WITH a AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders),
b AS (SELECT o_totalprice AS v, o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders)
SELECT b.o_orderkey, b.v + a.v AS both FROM b JOIN a USING (place)""",
    "orders",
)
def positional_sum(o):
    own = o.sort_values("o_orderkey")
    own["both"] = own["o_totalprice"] + o.sort_values(["o_totalprice", "o_orderkey"])["o_totalprice"]
    return own[["o_orderkey", "both"]].to_spark()


_UNARY = ("exp", "log", "sqrt", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh")
_DUCK = {"log": "ln"}
for _f in _UNARY:

    @query(f"unary_{_f}", f"SELECT l_orderkey, l_linenumber, round({_DUCK.get(_f, _f)}(l_discount + 0.25), 8) AS y FROM lineitem", "lineitem")
    def _unary(x, f=_f):
        from pelagos import functions

        x["y"] = (x["l_discount"] + 0.25).apply(getattr(functions, f))
        return _rounded(x[["l_orderkey", "l_linenumber", "y"]].to_spark(), 8, "y")


@query(
    "unary_erf",
    """SELECT l_orderkey, l_linenumber, round(2 / sqrt(pi()) * (x - pow(x, 3) / 3 + pow(x, 5) / 10 - pow(x, 7) / 42 + pow(x, 9) / 216 - pow(x, 11) / 1320 + pow(x, 13) / 9360), 8) AS y
FROM (SELECT l_orderkey, l_linenumber, CAST(l_discount AS DOUBLE) * 3 - 0.15 AS x FROM lineitem)""",
    "lineitem",
)
def unary_erf(x):
    from pelagos import erf

    x["y"] = (x["l_discount"] * 3 - 0.15).apply(erf)
    return _rounded(x[["l_orderkey", "l_linenumber", "y"]].to_spark(), 8, "y")


@query("arith_two_columns", "SELECT l_orderkey, l_linenumber, l_extendedprice - l_tax AS less, l_extendedprice / l_quantity AS each, round(pow(l_quantity, l_discount), 8) AS power FROM lineitem", "lineitem")
def arith_two_columns(x):
    x["less"] = x["l_extendedprice"] - x["l_tax"]
    x["each"] = x["l_extendedprice"] / x["l_quantity"]
    x["power"] = x["l_quantity"] ** x["l_discount"]
    return _rounded(x[["l_orderkey", "l_linenumber", "less", "each", "power"]].to_spark(), 8, "power")


@query("typed_literal", "SELECT p_partkey, CAST(p_size + 3 AS INTEGER) AS more, p_retailprice * 2 AS twice FROM part", "part")
def typed_literal(p):
    p["more"] = p["p_size"] + np.int32(3)
    p["twice"] = p["p_retailprice"] * np.float64(2)
    return p[["p_partkey", "more", "twice"]].to_spark()


@query(
    "filter_foreign_mask",
    """SELECT s_suppkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier)
JOIN (SELECT s_acctbal, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS place FROM supplier) b USING (place) WHERE b.s_acctbal > 5000""",
    "supplier",
)
def filter_foreign_mask(s):
    other = s.sort_values(["s_acctbal", "s_suppkey"])["s_acctbal"] > 5000.0
    return s.sort_values("s_suppkey")[["s_suppkey"]][other].to_spark()


# frames, labels and values from the driver and back


@query("frame_from_pandas", "SELECT n_nationkey, n_name, n_regionkey FROM nation", "nation")
def frame_from_pandas(n):
    from pelagos import DataFrame

    return DataFrame.from_pandas(n.to_pandas()).to_spark()


@query("frame_from_dict", "SELECT n_nationkey AS a, n_name AS b, n_regionkey * 2 AS c FROM nation", "nation")
def frame_from_dict(n):
    from pelagos import DataFrame

    key, name, region = n.values
    frame = DataFrame({"a": key, "b": name})
    frame["c"] = region * 2  # an array goes in by position
    return frame.to_spark()


@query("index_constructors", "SELECT n_nationkey AS i, n_name AS name, CAST(n_nationkey AS BIGINT) AS range FROM nation", "nation")
def index_constructors(n):
    from pelagos import DataFrame, Index, MultiIndex, RangeIndex

    key, name, _ = n.sort_values("n_nationkey").values
    both = MultiIndex([Index(key), Index(name)])
    both.names = ["i", "name"]
    return DataFrame({"range": RangeIndex(0, len(key)).values}, both).to_spark(include_index=True)


@query("index_from_pandas", "SELECT n_nationkey AS k, n_name AS v FROM nation", "nation")
def index_from_pandas(n):
    import pandas as pd

    from pelagos import DataFrame, Index

    key, name, _ = n.values
    return DataFrame({"v": name}, Index.from_pandas(pd.Index(key, name="k"))).to_spark(include_index=True)


@query("range_compare", "SELECT CAST(n_nationkey AS BIGINT) AS i FROM nation WHERE n_nationkey >= 7", "nation")
def range_compare(n):
    from pelagos import RangeIndex

    labels = RangeIndex(0, len(n))
    return labels[labels >= 7].to_spark("i")


@query("evaluate", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0", "supplier")
def evaluate(s):
    return s[s["s_acctbal"] > 0.0][["s_suppkey", "s_acctbal"]].evaluate().to_spark()


@query("lengths_and_types", "SELECT (SELECT count(*) FROM orders) AS n, 'o_orderkey,o_totalprice' AS names, 'int64,float64' AS types", "orders")
def lengths_and_types(o):
    few = o[["o_orderkey", "o_totalprice"]]
    names = ",".join(few)
    types = ",".join(str(few[c].dtype) for c in few)
    return o._plan.sdf.sparkSession.createDataFrame([(len(few), names, types)], "n long, names string, types string")


# aggregates

_SQL_AGG = {"min": "min({0})", "max": "max({0})", "sum": "sum({0})", "prod": "product({0})", "count": "count(*)", "mean": "avg({0})", "var": "var_samp({0})", "std": "stddev_samp({0})"}
_AGG_COLUMNS = ("l_quantity", "l_discount")
for _how, _sql in _SQL_AGG.items():
    if _how != "prod":

        @query(f"agg_{_how}", " UNION ALL ".join(f"SELECT '{c}' AS name, round(CAST({_sql.format(c)} AS DOUBLE), 4) AS value FROM lineitem" for c in _AGG_COLUMNS), "lineitem")
        def _agg(x, how=_how):
            found = getattr(x[list(_AGG_COLUMNS)], how)()
            out = found.to_spark("value", include_index=True).withColumnRenamed("index", "name")
            return _rounded(out.withColumn("value", F.col("value").cast("double")), 4, "value")


@query("agg_prod", "SELECT round(product(1 + l_discount / 1000000), 6) AS value FROM lineitem", "lineitem")
def agg_prod(x):
    return _rounded((x["l_discount"] / 1000000 + 1).prod().to_spark().withColumnRenamed("prod", "value"), 6, "value")


@query("agg_series_keeps_dtype", "SELECT max(p_size) AS value FROM part", "part")
def agg_series_keeps_dtype(p):
    return p["p_size"].max().to_spark().withColumnRenamed("max", "value")


_MULTI = ("min", "max", "count", "sum", "mean", "var", "std")


@query("agg_multi", " UNION ALL ".join(f"SELECT '{a}' AS name, " + ", ".join(f"round(CAST({_SQL_AGG[a].format(c)} AS DOUBLE), 4) AS {c}" for c in _AGG_COLUMNS) + " FROM lineitem" for a in _MULTI), "lineitem")
def agg_multi(x):
    out = x[list(_AGG_COLUMNS)].agg(list(_MULTI)).to_spark(include_index=True).withColumnRenamed("index", "name")
    return _rounded(out, 4, *_AGG_COLUMNS)


@query("agg_multi_series", " UNION ALL ".join(f"SELECT '{a}' AS name, round(CAST({_SQL_AGG[a].format('o_totalprice')} AS DOUBLE), 2) AS value FROM orders" for a in ("min", "std", "count")), "orders")
def agg_multi_series(o):
    return _rounded(o["o_totalprice"].agg(["min", "std", "count"]).to_spark("value", include_index=True).withColumnRenamed("index", "name"), 2, "value")


_GROUP = {"min": "min({0})", "max": "max({0})", "sum": "sum({0})", "mean": "avg({0})", "var": "coalesce(var_samp({0}), 0)", "std": "coalesce(stddev_samp({0}), 0)", "size": "count(*)"}
for _how, _sql in _GROUP.items():

    @query(f"group_{_how}", "SELECT l_returnflag, " + ", ".join(f"round(CAST({_sql.format(c)} AS DOUBLE), 3) AS {c}" for c in ("l_quantity", "l_tax")) + " FROM lineitem GROUP BY l_returnflag", "lineitem")
    def _group(x, how=_how):
        out = getattr(x[["l_returnflag", "l_quantity", "l_tax"]].groupby("l_returnflag"), how)().to_spark(include_index=True)
        return _rounded(out.withColumns({c: F.col(c).cast("double") for c in ("l_quantity", "l_tax")}), 3, "l_quantity", "l_tax")


@query("group_prod", "SELECT p_brand, round(product(1 + CAST(p_size AS DOUBLE) / 1000000), 6) AS v FROM part GROUP BY p_brand", "part")
def group_prod(p):
    p["v"] = p["p_size"].apply("1 + CAST({self} AS DOUBLE) / 1000000", new_dtype="float64")
    return _rounded(p[["p_brand", "v"]].groupby("p_brand").prod().to_spark(include_index=True), 6, "v")


@query(
    "group_multi_key",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice FROM lineitem WHERE l_quantity < 24 AND l_discount >= 0.05 GROUP BY 1, 2",
    "lineitem",
)
def group_multi_key(x):
    few = x[(x["l_quantity"] < 24) & (x["l_discount"] >= 0.05)]
    out = few[["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"]].groupby(["l_returnflag", "l_linestatus"]).sum()
    return _rounded(out.to_spark(include_index=True), 2, "l_quantity", "l_extendedprice")


@query("group_string_min", "SELECT o_orderstatus, min(o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1", "orders")
def group_string_min(o):
    return o[["o_orderstatus", "o_orderpriority"]].groupby("o_orderstatus").min().to_spark(include_index=True)


# joins over whole tables: customers without orders, and a predicate on values, leave keys without a match

_ALL = "SELECT o_custkey AS custkey, max(o_totalprice) AS price, min(o_orderkey) AS orderkey FROM orders GROUP BY 1"
_OWING = "SELECT c_custkey AS custkey, c_acctbal AS balance, c_mktsegment AS segment FROM customer WHERE c_acctbal < 5000"


def _sides(o, c):
    every = o.rename({"o_custkey": "custkey", "o_totalprice": "price", "o_orderkey": "orderkey"})
    one = every[["custkey", "price"]].groupby("custkey").max().merge(every[["custkey", "orderkey"]].groupby("custkey").min(), on="custkey").reset_index()
    owing = c[c["c_acctbal"] < 5000.0].rename({"c_custkey": "custkey", "c_acctbal": "balance", "c_mktsegment": "segment"})
    return one[["custkey", "price", "orderkey"]], owing[["custkey", "balance", "segment"]]


for _how in ("inner", "left", "right", "outer"):

    @query(
        f"join_{_how}",
        f"""SELECT coalesce(a.custkey, b.custkey) AS custkey, coalesce(price, -999) AS price, coalesce(orderkey, -999) AS orderkey, coalesce(balance, -999) AS balance, coalesce(segment, 'None') AS segment
FROM ({_ALL}) a {'FULL' if _how == 'outer' else _how.upper()} JOIN ({_OWING}) b ON a.custkey = b.custkey""",
        "orders",
        "customer",
    )
    def _join(o, c, how=_how):
        one, owing = _sides(o, c)
        return one.merge(owing, how=how, on="custkey").to_spark(include_index=True).select("custkey", "price", "orderkey", "balance", "segment")


@query("join_hash", f"SELECT a.custkey, price, balance FROM ({_ALL}) a JOIN ({_OWING}) b ON a.custkey = b.custkey", "orders", "customer")
def join_hash(o, c):
    one, owing = _sides(o, c)
    return one[["custkey", "price"]].merge(owing[["custkey", "balance"]], on="custkey", algorithm="hash").to_spark(include_index=True).select("custkey", "price", "balance")


@query("join_on_index", f"SELECT a.custkey, price, balance FROM ({_ALL}) a JOIN ({_OWING}) b ON a.custkey = b.custkey", "orders", "customer")
def join_on_index(o, c):
    one, owing = _sides(o, c)
    return one.set_index("custkey").merge(owing.set_index("custkey")).to_spark(include_index=True).select("custkey", "price", "balance")


@query("join_orders_customer", "SELECT o_orderkey, o_custkey AS custkey, c_acctbal, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey", "orders", "customer")
def join_orders_customer(o, c):
    left = o.rename({"o_custkey": "custkey"})[["o_orderkey", "custkey"]]
    return left.merge(c.rename({"c_custkey": "custkey"})[["custkey", "c_acctbal", "c_mktsegment"]], on="custkey").to_spark(include_index=True).select("o_orderkey", "custkey", "c_acctbal", "c_mktsegment")


@query(
    "join_multi_key",
    """WITH a AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey, l_linenumber, max(l_tax) AS t FROM lineitem WHERE l_quantity > 20 GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, coalesce(q, -999) AS q, coalesce(t, -999) AS t FROM a FULL JOIN b USING (l_orderkey, l_linenumber)""",
    "lineitem",
)
def join_multi_key(x):
    keys = ["l_orderkey", "l_linenumber"]
    a = x[[*keys, "l_quantity"]].rename({"l_quantity": "q"}).groupby(keys).min()
    b = x[x["l_quantity"] > 20][[*keys, "l_tax"]].rename({"l_tax": "t"}).groupby(keys).max()
    return a.merge(b, how="outer", on=keys).to_spark(include_index=True)


@query("join_suffix", "SELECT n.n_regionkey AS regionkey, n_name AS name_n, r_name AS name_r, n_nationkey FROM nation n JOIN region r ON n_regionkey = r_regionkey", "nation", "region")
def join_suffix(n, r):
    left = n.rename({"n_regionkey": "regionkey", "n_name": "name"})
    right = r.rename({"r_regionkey": "regionkey", "r_name": "name"})
    out = left.join(right[["regionkey", "name"]], on="regionkey", how="inner", lsuffix="_n", rsuffix="_r")
    return out.to_spark(include_index=True).select("regionkey", "name_n", "name_r", "n_nationkey")


@query(
    "align_setitem",
    "SELECT c_custkey, coalesce(p, -999) AS price FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS p FROM orders WHERE o_totalprice > 200000 GROUP BY 1) ON o_custkey = c_custkey",
    "customer",
    "orders",
)
def align_setitem(c, o):
    own = c.set_index("c_custkey")
    own["price"] = o[o["o_totalprice"] > 200000].set_index("o_custkey")["o_totalprice"]
    return own[["price"]].to_spark(include_index=True)


@query("iloc_missing", "SELECT i AS i, coalesce(n_nationkey, -999) AS n_nationkey FROM (VALUES (0), (3), (77)) v(i) LEFT JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation) ON place = i", "nation")
def iloc_missing(n):
    from pelagos import Series

    at = Series(np.array([0, 3, 77]))
    found = n.sort_values("n_nationkey")["n_nationkey"]._iloc(at, missing=True)
    plan, (expr,) = found._plan.zipped(at._plan, [at._expr])
    return plan.sdf.select(expr.cast("int").alias("i"), found._expr.alias("n_nationkey"))


# duplicates

for _keep, _sql in (("min", "min({0})"), ("max", "max({0})"), ("+", "sum({0})")):

    @query(
        f"drop_duplicates_subset_{ {'+': 'sum'}.get(_keep, _keep)}",
        f"SELECT o_custkey, o_orderstatus, CAST({_sql.format('o_orderkey')} AS BIGINT) AS o_orderkey, round({_sql.format('o_totalprice')}, 2) AS o_totalprice FROM orders GROUP BY 1, 2",
        "orders",
    )
    def _drop(o, keep=_keep):
        out = o[["o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice"]].drop_duplicates(["o_custkey", "o_orderstatus"], keep=keep)
        return _rounded(out.to_spark(), 2, "o_totalprice")


@query("drop_duplicates_product", "SELECT o_orderstatus, round(product(1 + o_totalprice / 1000000000), 6) AS v FROM orders GROUP BY 1", "orders")
def drop_duplicates_product(o):
    o["v"] = o["o_totalprice"] / 1000000000 + 1
    return _rounded(o[["o_orderstatus", "v"]].drop_duplicates(["o_orderstatus"], keep="*").to_spark(), 6, "v")


@query("drop_duplicates_all", "SELECT o_custkey, o_orderstatus, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2", "orders")
def drop_duplicates_all(o):
    return o.set_index("o_orderkey")[["o_custkey", "o_orderstatus"]].drop_duplicates().to_spark(include_index=True)


@query("unique", "SELECT DISTINCT l_returnflag FROM lineitem", "lineitem")
def unique(x):
    return x["l_returnflag"].unique().to_spark("l_returnflag")


# order and positions

_BY_PRICE = "row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) - 1"


@query("sort_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100", "orders")
def sort_topk(o):
    return o.sort_values(["o_totalprice", "o_orderkey"], ascending=False)[["o_orderkey", "o_totalprice"]].head(100).to_spark()


@query("sort_single_stable", "SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS place FROM part", "part")
def sort_single_stable(p):
    frame = p.sort_values("p_partkey").sort_values("p_size")[["p_partkey", "p_size"]].reset_index().drop("index")
    return frame.to_spark(include_index=True).withColumnRenamed("index", "place")


@query("head", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7", "orders")
def head(o):
    return o.sort_values("o_orderkey")[["o_orderkey"]].head(7).to_spark()


@query("tail", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7", "orders")
def tail(o):
    return o.sort_values("o_orderkey")[["o_orderkey"]].tail(7).to_spark()


@query("slice", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 30 OFFSET 20", "orders")
def slice_(o):
    return o.sort_values("o_orderkey")[["o_orderkey"]][20:50].to_spark()


@query("slice_step", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders) WHERE place >= 5 AND place < 2000 AND (place - 5) % 7 = 0", "orders")
def slice_step(o):
    return o.sort_values("o_orderkey")[["o_orderkey"]][5:2000:7].to_spark()


@query("iloc_int", "SELECT o_totalprice AS value FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 11", "orders")
def iloc_int(o):
    return o.sort_values("o_orderkey")["o_totalprice"].iloc[11].to_spark()


@query("iloc_array", f"SELECT o_orderkey FROM (SELECT o_orderkey, {_BY_PRICE} AS place FROM orders) WHERE place IN (3, 5, 8, 400)", "orders")
def iloc_array(o):
    return o.sort_values(["o_totalprice", "o_orderkey"], ascending=False)[["o_orderkey"]].iloc[np.array([8, 3, 400, 5])].to_spark()


@query("sort_by_date", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders", "orders")
def sort_by_date(o):
    frame = o.sort_values(["o_orderdate", "o_orderkey"])[["o_orderkey"]].reset_index().drop("index")
    return frame.to_spark(include_index=True).withColumnRenamed("index", "place")


@query("sort_index_desc", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS place FROM orders", "orders")
def sort_index_desc(o):
    frame = o[["o_orderkey", "o_custkey"]].set_index("o_orderkey").sort_index(ascending=False).reset_index()
    return frame[["o_orderkey"]].to_spark(include_index=True).withColumnRenamed("index", "place")


@query("range_labels", "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS label FROM part WHERE p_partkey > 100", "part")
def range_labels(p):
    frame = p[["p_partkey"]].sort_values("p_partkey")
    return frame[frame["p_partkey"] > 100].reset_index().drop("index").to_spark(include_index=True).withColumnRenamed("index", "label")


@query("udf_sort", "SELECT a.s_suppkey, b.s_acctbal AS v FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier) a JOIN (SELECT s_acctbal, row_number() OVER (ORDER BY s_acctbal) AS place FROM supplier) b USING (place)", "supplier")
def udf_sort(s):
    from pelagos import sort

    frame = s.sort_values("s_suppkey")
    frame["v"] = frame["s_acctbal"].apply(sort)
    return frame[["s_suppkey", "v"]].to_spark()


# strings

_P, _INSTR = "p_name", "strpos(p_name, 'e')"
_STRINGS = {
    "lower": (lambda s: s.str.lower(), f"lower({_P})"),
    "upper": (lambda s: s.str.upper(), f"upper({_P})"),
    "capitalize": (lambda s: s.str.capitalize(), f"upper({_P}[1:1]) || lower({_P}[2:])"),
    "get": (lambda s: s.str.get(3), f"CASE WHEN length({_P}) > 3 THEN substr({_P}, 4, 1) ELSE 'None' END"),
    "get_end": (lambda s: s.str.get(-2), f"substr({_P}, length({_P}) - 1, 1)"),
    "get_missing": (lambda s: s.str.get(12), f"CASE WHEN length({_P}) > 12 THEN substr({_P}, 13, 1) ELSE 'None' END"),
    "strip": (lambda s: s.str.slice(0, 6).str.strip(), f"trim(substr({_P}, 1, 6), ' ')"),
    "slice": (lambda s: s.str.slice(2, 7), f"substr({_P}, 3, 5)"),
    "slice_step": (lambda s: s.str.slice(0, 6, 2), f"substr({_P}, 1, 1) || substr({_P}, 3, 1) || substr({_P}, 5, 1)"),
    "contains": (lambda s: s.str.contains("e"), f"contains({_P}, 'e')"),
    "startswith": (lambda s: s.str.startswith("p"), f"starts_with({_P}, 'p')"),
    "endswith": (lambda s: s.str.endswith("1"), f"ends_with({_P}, '1')"),
    "find": (lambda s: s.str.find("a", 1, 9), f"CASE WHEN strpos(substr({_P}, 2, 8), 'a') > 0 THEN strpos(substr({_P}, 2, 8), 'a') ELSE -1 END"),
    "replace": (lambda s: s.str.replace("e", "<>"), f"CASE WHEN {_INSTR} > 0 THEN {_P}[1:{_INSTR} - 1] || '<>' || {_P}[{_INSTR} + 1:] ELSE {_P} END"),
    "split_left": (lambda s: s.str.split("e", "left"), f"CASE WHEN {_INSTR} > 0 THEN {_P}[1:{_INSTR} - 1] ELSE {_P} END"),
    "split_right": (lambda s: s.str.split("e", "right"), f"CASE WHEN {_INSTR} > 0 THEN {_P}[{_INSTR} + 1:] ELSE {_P} END"),
}
for _name, (_func, _sql) in _STRINGS.items():

    @query(f"str_{_name}", f"SELECT p_partkey, {_sql} AS v FROM part", "part")
    def _string(p, func=_func):
        p["v"] = func(p["p_name"])
        return p[["p_partkey", "v"]].to_spark()


# missing data: balances above 5000 stand for missing ones

_MISS = "CASE WHEN c_acctbal > 5000 THEN -999 ELSE c_acctbal END"


def _missing(c):
    c["v"] = c["c_acctbal"].apply("CASE WHEN {self} > 5000 THEN -999 ELSE {self} END")
    return c


@query("isna", f"SELECT c_custkey, {_MISS} = -999 AS v FROM customer", "customer")
def isna(c):
    c = _missing(c)
    c["v"] = c["v"].isna()
    return c[["c_custkey", "v"]].to_spark()


@query("notna", f"SELECT c_custkey <> -999 AS c_custkey, {_MISS} <> -999 AS v FROM customer", "customer")
def notna(c):
    return _missing(c)[["c_custkey", "c_name", "v"]].notna().to_spark()


@query("dropna", "SELECT c_custkey, c_acctbal AS v FROM customer WHERE c_acctbal <= 5000", "customer")
def dropna(c):
    return _missing(c)[["c_custkey", "v"]].dropna(["v"]).to_spark()


@query("fillna", f"SELECT c_custkey, CASE WHEN {_MISS} = -999 THEN 1.5 ELSE c_acctbal END AS v FROM customer", "customer")
def fillna(c):
    return _missing(c)[["c_custkey", "v"]].fillna({"v": 1.5}).to_spark()


# schema, conversions, functions of the user


@query("rename_drop_astype", "SELECT CAST(s_suppkey AS DOUBLE) AS key, CAST(trunc(s_acctbal) AS BIGINT) AS balance FROM supplier", "supplier")
def rename_drop_astype(s):
    frame = s.rename({"s_suppkey": "key", "s_acctbal": "balance", "nothing": "ignored"}).drop(["s_name", "s_nationkey"])
    return frame.astype({"key": np.float64, "balance": np.int64}).to_spark()


@query("set_reset_index", "SELECT n_nationkey, n_name, n_regionkey FROM nation", "nation")
def set_reset_index(n):
    return n.set_index(["n_nationkey", "n_name"]).reset_index().to_spark()


@query("csv_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation)", "nation")
def csv_roundtrip(n):
    from pelagos.plans.plan import session
    from pelagos.sources.files import read_csv

    shared = session().conf.get("spark.checkpoint.dir", "")
    if not shared:
        if not session().sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{tempfile.gettempdir()}"
    path = f"{shared.rstrip('/')}/csv-{uuid.uuid4().hex}"
    n.to_csv(path, index=False)
    return read_csv(path).to_spark()


@query("udf_template", "SELECT l_orderkey, l_linenumber, l_quantity + 2 AS v FROM lineitem", "lineitem")
def udf_template(x):
    x["v"] = x["l_quantity"].apply("{self} + {k}", mapping={"k": 2})
    return x[["l_orderkey", "l_linenumber", "v"]].to_spark()


@query("udf_column_fn", "SELECT l_orderkey, l_linenumber, l_quantity * 3 - 1 AS v FROM lineitem", "lineitem")
def udf_column_fn(x):
    x["v"] = x["l_quantity"].apply(lambda c, k: c * k - 1, k=3)
    return x[["l_orderkey", "l_linenumber", "v"]].to_spark()


@query("udf_numpy", "SELECT s_suppkey, sqrt(abs(s_acctbal)) AS v FROM supplier", "supplier")
def udf_numpy(s):
    from pelagos import raw

    s["v"] = s["s_acctbal"].apply(raw(lambda a: np.sqrt(np.abs(a))))
    return s[["s_suppkey", "v"]].to_spark()


@query("bench_pipeline", "SELECT l_returnflag, round(coalesce(var_samp(l_extendedprice * (1 - l_discount)), 0), 0) AS net, round(coalesce(var_samp(l_quantity * 2), 0), 2) AS twice FROM lineitem WHERE l_quantity < 30 GROUP BY 1", "lineitem")
def bench_pipeline(x):
    few = x[x["l_quantity"] < 30]
    few["net"] = few["l_extendedprice"] * (1 - few["l_discount"])
    few["twice"] = few["l_quantity"] * 2
    out = few[["l_returnflag", "net", "twice"]].groupby("l_returnflag").var().to_spark(include_index=True)
    return _rounded(_rounded(out, 0, "net"), 2, "twice")
