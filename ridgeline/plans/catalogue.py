"""Queries over the test tables, one or more for each operator, with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import functions as R
from ridgeline import operators as op

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

c = F.col


class Tables:
    """The Parquet tables of a folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return op.scan(self.spark, f"{self.dir}/{name}.parquet")


def query(sql: str) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    def register(build: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(spark, sf_dir))

        QUERIES[build.__name__], SQL[build.__name__] = run, sql
        return run

    return register


def same(name: str, sql: str, build: Callable[[Tables], DataFrame]) -> None:
    build.__name__ = name
    query(sql)(build)


# sources and projection
same("scan_project", "select c_custkey as k, c_name as name, c_acctbal as bal from customer", lambda t: t.customer.select(c("c_custkey").alias("k"), c("c_name").alias("name"), c("c_acctbal").alias("bal")))
same("select_star", "select * from nation", lambda t: t.nation)
same("qualified_star", "select n.* from nation n join region r on n.n_regionkey = r.r_regionkey", lambda t: op.join(t.nation.alias("n"), t.region.alias("r"), c("n.n_regionkey") == c("r.r_regionkey")).select("n.*"))
same("no_from", "select cast(1+2 as bigint) as a, cast('x' as varchar) as s, true as b", lambda t: op.nothing(t.spark).select((F.lit(1).cast("bigint") + F.lit(2)).alias("a"), F.lit("x").alias("s"), F.lit(True).alias("b")))
same("key_lookup", "select o_orderkey, o_totalprice from orders where o_orderkey = 42", lambda t: op.key_lookup(t.orders, "o_orderkey", [42]).select("o_orderkey", "o_totalprice"))
same("key_lookup_or", "select o_orderkey, o_totalprice from orders where o_orderkey = 1 or o_orderkey = 7 or o_orderkey = 99", lambda t: op.key_lookup(t.orders, "o_orderkey", [1, 7, 99, 7]).select("o_orderkey", "o_totalprice"))
same("index_lookup", "select c_custkey, c_mktsegment from customer where c_mktsegment = 'BUILDING'", lambda t: op.index_lookup(t.customer, "c_mktsegment", ["BUILDING"]).select("c_custkey", "c_mktsegment"))
same("index_lookup_null", "select p_partkey, k from (select p_partkey, nullif(p_size, 10) as k from part) where k = 3 or k is null", lambda t: op.index_lookup(t.part.select("p_partkey", F.nullif("p_size", F.lit(10)).alias("k")), "k", [3, None]))
same("index_scan", "select s_nationkey, count(*) as n, min(s_suppkey) as first_key, max(s_suppkey) as last_key from supplier group by s_nationkey", lambda t: op.index_scan(t.supplier, "s_nationkey", "s_suppkey").select("s_nationkey", F.size("keys").cast("bigint").alias("n"), F.array_min("keys").alias("first_key"), F.array_max("keys").alias("last_key")))

# filters
same("filter_and", "select o_orderkey from orders where o_totalprice > 300000 and o_orderstatus = 'F'", lambda t: t.orders.where((c("o_totalprice") > 300000) & (c("o_orderstatus") == "F")).select("o_orderkey"))
same("filter_or_nested", "select o_orderkey from orders where (o_totalprice > 450000 or o_orderpriority = '1-URGENT') and (o_orderstatus = 'F' or o_orderstatus = 'P')", lambda t: t.orders.where(((c("o_totalprice") > 450000) | (c("o_orderpriority") == "1-URGENT")) & ((c("o_orderstatus") == "F") | (c("o_orderstatus") == "P"))).select("o_orderkey"))
same("filter_not", "select p_partkey from part where not (p_size > 10 or p_brand = 'Brand#1')", lambda t: t.part.where(~((c("p_size") > 10) | (c("p_brand") == "Brand#1"))).select("p_partkey"))
same("cmp_ge_le_ne", "select p_partkey, p_size from part where p_size >= 10 and p_size <= 20 and p_size <> 15", lambda t: t.part.where((c("p_size") >= 10) & (c("p_size") <= 20) & (c("p_size") != 15)).select("p_partkey", "p_size"))
same("cmp_gt_lt", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 10 and l_quantity < 12", lambda t: t.lineitem.where((c("l_quantity") > 10) & (c("l_quantity") < 12)).select("l_orderkey", "l_linenumber", "l_quantity"))
same("cmp_int_float", "select p_partkey from part where p_size = 15.0", lambda t: t.part.where(c("p_size") == F.lit(15.0)).select("p_partkey"))
same("cmp_string", "select n_nationkey, n_name from nation where n_name > 'NATION_2'", lambda t: t.nation.where(c("n_name") > "NATION_2").select("n_nationkey", "n_name"))

# expressions
same("arith_float", "select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) + l_tax - 1 as v from lineitem", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", (c("l_extendedprice") * (1 - c("l_discount")) + c("l_tax") - 1).alias("v")))
same("div_int", "select p_partkey, cast(p_size // 7 as bigint) as q, cast(p_size // nullif(p_size % 5, 0) as bigint) as qz from part", lambda t: t.part.select("p_partkey", R.int_divide(c("p_size"), F.lit(7)).alias("q"), R.int_divide(c("p_size"), c("p_size") % 5).alias("qz")))
same("div_float", "select o_orderkey, o_totalprice / nullif(cast(o_custkey as double), 0) as v from orders", lambda t: t.orders.select("o_orderkey", R.float_divide(c("o_totalprice"), c("o_custkey")).alias("v")))
same("modulo", "select p_partkey, p_size % 7 as m, (0 - p_size) % 7 as neg from part", lambda t: t.part.select("p_partkey", R.modulo(c("p_size"), F.lit(7)).alias("m"), R.modulo(0 - c("p_size"), F.lit(7)).alias("neg")))
same("power", "select p_partkey, pow(p_size, 2) as sq, round(pow(p_size, 0.5), 6) as rt from part", lambda t: t.part.select("p_partkey", R.power(c("p_size"), F.lit(2)).alias("sq"), F.round(R.power(c("p_size"), F.lit(0.5)), 6).alias("rt")))
same("factorial", "select p_partkey, cast(factorial(cast(p_size % 10 as integer)) as bigint) as f from part", lambda t: t.part.select("p_partkey", R.factorial(c("p_size") % 10).alias("f")))
same("negate", "select c_custkey, -c_acctbal as neg from customer", lambda t: t.customer.select("c_custkey", (-c("c_acctbal")).alias("neg")))
same("like_prefix", "select p_partkey, p_name from part where p_name like 'red%'", lambda t: t.part.where(c("p_name").like("red%")).select("p_partkey", "p_name"))
same("like_contains", "select p_partkey, p_name from part where p_name like '%widget%'", lambda t: t.part.where(c("p_name").like("%widget%")).select("p_partkey", "p_name"))
same("like_underscore", "select c_custkey, c_name from customer where c_name like 'Customer#00000000_'", lambda t: t.customer.where(c("c_name").like("Customer#00000000_")).select("c_custkey", "c_name"))
same("null_is_null", "select p_partkey, nullif(p_size, 10) is null as isn from part", lambda t: t.part.select("p_partkey", F.nullif("p_size", F.lit(10)).isNull().alias("isn")))


@query("select p_partkey, (nullif(p_size,10) > 5 and true) as a, (nullif(p_size,10) > 5 or true) as o, (not nullif(p_size,10) > 5) as n from part")
def null_3vl(t):
    big = F.nullif("p_size", F.lit(10)) > 5
    return t.part.select("p_partkey", (big & F.lit(True)).alias("a"), (big | F.lit(True)).alias("o"), (~big).alias("n"))


# joins
same("cross_join", "select r.r_name, n.n_name from region r cross join nation n", lambda t: op.cross_join(t.region, t.nation).select("r_name", "n_name"))
same("comma_join", "select n.n_name, r.r_name from nation n, region r where n.n_regionkey = r.r_regionkey", lambda t: op.cross_join(t.nation, t.region).where(c("n_regionkey") == c("r_regionkey")).select("n_name", "r_name"))
same("inner_join", "select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey", lambda t: op.join(t.orders, t.customer, c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name"))
same("theta_join", "select a.n_name as x, b.n_name as y from nation a join nation b on a.n_nationkey < b.n_nationkey", lambda t: op.join(t.nation.alias("a"), t.nation.alias("b"), c("a.n_nationkey") < c("b.n_nationkey")).select(c("a.n_name").alias("x"), c("b.n_name").alias("y")))
same("join_residual", "select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey and o.o_totalprice > c.c_acctbal * 50", lambda t: op.join(t.orders, t.customer, (c("o_custkey") == c("c_custkey")) & (c("o_totalprice") > c("c_acctbal") * 50)).select("o_orderkey", "c_name"))


def _large_orders(t):
    return t.orders.where(c("o_totalprice") > 450000)


same("left_join_unmatched", "select c.c_custkey, o.o_orderkey from customer c left join (select * from orders where o_totalprice > 450000) o on c.c_custkey = o.o_custkey", lambda t: op.join(t.customer, _large_orders(t), c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "o_orderkey"))
same("left_join_on_pred", "select c.c_custkey, o.o_orderkey from customer c left join orders o on c.c_custkey = o.o_custkey and c.c_acctbal > 5000", lambda t: op.join(t.customer, t.orders, (c("c_custkey") == c("o_custkey")) & (c("c_acctbal") > 5000), "left").select("c_custkey", "o_orderkey"))
same("left_join_where", "select c.c_custkey from customer c left join (select * from orders where o_totalprice > 450000) o on c.c_custkey = o.o_custkey where o.o_orderkey is null", lambda t: op.join(t.customer, _large_orders(t), c("c_custkey") == c("o_custkey"), "left").where(c("o_orderkey").isNull()).select("c_custkey"))
same("right_join", "select o.o_orderkey, c.c_custkey from (select * from orders where o_totalprice > 450000) o right join customer c on o.o_custkey = c.c_custkey", lambda t: op.join(_large_orders(t), t.customer, c("o_custkey") == c("c_custkey"), "right").select("o_orderkey", "c_custkey"))

_NULL_KEYS = "select a.p_partkey as x, b.s_suppkey as y from (select p_partkey, nullif(p_size, 10) as k from part) a join (select s_suppkey, nullif(s_nationkey, 10) as k from supplier) b on a.k {} b.k"


def _null_keys(t):
    a = t.part.select("p_partkey", F.nullif("p_size", F.lit(10)).alias("k"))
    return a.alias("a"), t.supplier.select("s_suppkey", F.nullif("s_nationkey", F.lit(10)).alias("k")).alias("b")


same("null_join_eq", _NULL_KEYS.format("="), lambda t: op.join(*_null_keys(t), c("a.k") == c("b.k")).select(c("p_partkey").alias("x"), c("s_suppkey").alias("y")))
same("null_join_safe", _NULL_KEYS.format("is not distinct from"), lambda t: op.null_safe_join(*_null_keys(t), c("a.k"), c("b.k")).select(c("p_partkey").alias("x"), c("s_suppkey").alias("y")))
same("self_join", "select a.s_suppkey as x, b.s_suppkey as y from supplier a join supplier b on a.s_nationkey = b.s_nationkey where a.s_suppkey < b.s_suppkey", lambda t: op.join(t.supplier.alias("a"), t.supplier.alias("b"), c("a.s_nationkey") == c("b.s_nationkey")).where(c("a.s_suppkey") < c("b.s_suppkey")).select(c("a.s_suppkey").alias("x"), c("b.s_suppkey").alias("y")))


@query("select r.r_name as region, count(*) as n, round(sum(o.o_totalprice), 2) as total from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey group by r.r_name")
def join_chain(t):
    rows = op.join(op.join(op.join(t.orders, t.customer, c("o_custkey") == c("c_custkey")), t.nation, c("c_nationkey") == c("n_nationkey")), t.region, c("n_regionkey") == c("r_regionkey"))
    return rows.groupBy(c("r_name").alias("region")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# aggregates
_n = lambda: F.count(F.lit(1)).alias("n")
same("agg_global", "select count(*) as n, round(sum(l_quantity), 2) as s, min(l_extendedprice) as mn, max(l_extendedprice) as mx, round(avg(l_quantity), 4) as av from lineitem", lambda t: t.lineitem.agg(_n(), F.round(F.sum("l_quantity"), 2).alias("s"), F.min("l_extendedprice").alias("mn"), F.max("l_extendedprice").alias("mx"), F.round(F.avg("l_quantity"), 4).alias("av")))
same("agg_empty", "select count(*) as n, sum(o_totalprice) as s from orders where o_orderkey < 0", lambda t: t.orders.where(c("o_orderkey") < 0).agg(_n(), F.sum("o_totalprice").alias("s")))
same("agg_empty_group", "select o_orderstatus, count(*) as n from orders where o_orderkey < 0 group by o_orderstatus", lambda t: t.orders.where(c("o_orderkey") < 0).groupBy("o_orderstatus").agg(_n()))
same("agg_int_avg", "select p_brand, cast(sum(p_size) // count(p_size) as bigint) as av from part group by p_brand", lambda t: t.part.groupBy("p_brand").agg(R.int_average(c("p_size")).alias("av")))
same("agg_count_null", "select count(*) as a, count(nullif(p_size, 10)) as b from part", lambda t: t.part.agg(F.count(F.lit(1)).alias("a"), F.count(F.nullif("p_size", F.lit(10))).alias("b")))
same("agg_null_skip", "select p_brand, cast(sum(nullif(p_size, 10)) as bigint) as s, min(nullif(p_size, 1)) as mn, max(nullif(p_size, 50)) as mx from part group by p_brand", lambda t: t.part.groupBy("p_brand").agg(F.sum(F.nullif("p_size", F.lit(10))).alias("s"), F.min(F.nullif("p_size", F.lit(1))).alias("mn"), F.max(F.nullif("p_size", F.lit(50))).alias("mx")))
same("agg_minmax_string", "select p_type, min(p_name) as mn, max(p_name) as mx from part group by p_type", lambda t: t.part.groupBy("p_type").agg(F.min("p_name").alias("mn"), F.max("p_name").alias("mx")))
same("group_multi", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_extendedprice), 2) as s from lineitem group by l_returnflag, l_linestatus", lambda t: t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(_n(), F.round(F.sum("l_extendedprice"), 2).alias("s")))
same("group_hidden_key", "select count(*) as n from orders group by o_orderpriority", lambda t: t.orders.groupBy("o_orderpriority").agg(_n()).select("n"))
same("group_alias", "select o_orderstatus as st, count(*) as n from orders group by st", lambda t: t.orders.groupBy(c("o_orderstatus").alias("st")).agg(_n()))
same("group_null_key", "select nullif(n_regionkey, 2) as k, count(*) as n from nation group by nullif(n_regionkey, 2)", lambda t: t.nation.groupBy(F.nullif("n_regionkey", F.lit(2)).alias("k")).agg(_n()))
same("group_expr", "select p_size % 5 as b, count(*) as n from part group by p_size % 5", lambda t: t.part.groupBy((c("p_size") % 5).alias("b")).agg(_n()))
same("distinct_by_group", "select c_mktsegment, c_nationkey from customer group by c_mktsegment, c_nationkey", lambda t: op.distinct(t.customer, "c_mktsegment", "c_nationkey"))
same("agg_of_expr", "select l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) as rev from lineitem group by l_returnflag", lambda t: t.lineitem.groupBy("l_returnflag").agg(F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("rev")))
same("expr_of_aggs", "select event_type, round(sum(value) / count(value), 4) as m from events group by event_type", lambda t: t.events.groupBy("event_type").agg(F.round(F.sum("value") / F.count("value"), 4).alias("m")))
same("having_agg", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 15", lambda t: t.orders.groupBy("o_custkey").agg(_n()).where(c("n") > 15))
same("having_hidden", "select o_custkey from orders group by o_custkey having sum(o_totalprice) > 4000000", lambda t: t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s")).where(c("s") > 4000000).select("o_custkey"))

# order and limit
same("order_desc_limit", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10", lambda t: op.top(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 10))
same("order_limit_offset", "select p_partkey from part order by p_partkey limit 10 offset 20", lambda t: op.top(t.part.select("p_partkey"), [F.asc("p_partkey")], 10, 20))
same("order_hidden_col", "select c_name from customer order by c_acctbal desc, c_custkey limit 5", lambda t: op.top(t.customer, [F.desc("c_acctbal"), F.asc("c_custkey")], 5).select("c_name"))
same("order_alias_agg", "select c_nationkey, count(*) as n from customer group by c_nationkey order by n desc, c_nationkey limit 5", lambda t: op.top(t.customer.groupBy("c_nationkey").agg(_n()), [F.desc("n"), F.asc("c_nationkey")], 5))
same("order_nulls_first", "select p_partkey, nullif(p_size, 10) as k from part order by k asc nulls first, p_partkey limit 30", lambda t: op.top(t.part.select("p_partkey", F.nullif("p_size", F.lit(10)).alias("k")), [F.asc("k"), F.asc("p_partkey")], 30))
same("order_nulls_last_desc", "select p_partkey from part order by nullif(p_size, 50) desc nulls last, p_partkey limit 30", lambda t: op.top(t.part, [F.nullif("p_size", F.lit(50)).desc(), F.asc("p_partkey")], 30).select("p_partkey"))

# what changes and constraints come down to
same("update_expr", "select s_suppkey, case when s_acctbal < 0 then 0.0::double else s_acctbal end as s_acctbal from supplier", lambda t: t.supplier.select("s_suppkey", F.when(c("s_acctbal") < 0, F.lit(0.0)).otherwise(c("s_acctbal")).alias("s_acctbal")))
same("delete_pred", "select * from supplier where not coalesce(s_acctbal < 0, false)", lambda t: t.supplier.where(~F.coalesce(c("s_acctbal") < 0, F.lit(False))))
same("fk_violations", "select o_orderkey from orders o where not exists (select 1 from customer c where c.c_custkey = o.o_custkey and c.c_acctbal > 0)", lambda t: t.orders.join(t.customer.where(c("c_acctbal") > 0), c("o_custkey") == c("c_custkey"), "left_anti").select("o_orderkey"))
same("pk_duplicates", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1", lambda t: t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(_n()).where(c("n") > 1))


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty, round(avg(l_discount), 6) as disc, min(l_extendedprice) as low, max(l_extendedprice) as high from lineitem where l_quantity > 5 and l_discount < 0.09 group by l_returnflag, l_linestatus having count(*) > 10 order by l_returnflag, l_linestatus")
def flagship(t):
    """Filter, group, aggregate, HAVING and order at once."""
    rows = t.lineitem.where((c("l_quantity") > 5) & (c("l_discount") < 0.09)).groupBy("l_returnflag", "l_linestatus")
    aggs = rows.agg(_n(), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))
    return aggs.where(c("n") > 10).orderBy("l_returnflag", "l_linestatus")
