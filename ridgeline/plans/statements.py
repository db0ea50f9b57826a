"""Statements of the dialect over the test tables, run as text through a session, with the SQL that gives the same rows in
DuckDB: SELECTs over Parquet tables, and definitions, changes, constraints, transactions and administration over a store
into which whole tables are loaded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.dialect.tokens import SqlError
from ridgeline.repl import Repl
from ridgeline.session import Session, TransactionError
from ridgeline.sources.constraints import ConstraintError
from ridgeline.sources.folder import new_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
REFUSALS = (ConstraintError, SqlError, TransactionError)


class Db(Session):
    """A session over a store of its own, beside the Parquet tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, root: str | None = None):
        super().__init__(spark, root or new_folder(spark, "store"), {t: f"{sf_dir}/{t}.parquet" for t in TABLES})
        self.dir = sf_dir

    def other(self) -> Db:
        return Db(self.spark, self.dir, self.store.files.root)

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.external[name])

    def rows(self, sql: str) -> DataFrame:
        return self.execute(sql).rows

    def refused(self, sql: str) -> bool:
        """Whether the statement is refused; it takes effect otherwise."""
        try:
            self.execute(sql)
        except REFUSALS:
            return True
        return False

    def told(self, rows: list[tuple], kind: str) -> DataFrame:
        return self.spark.createDataFrame(rows, kind)


def select(name: str, text: str, sql: str | None = None, digits: dict[str, int] | None = None) -> None:
    """A SELECT of the dialect; sql: DuckDB's, if it needs another text; digits: columns that are rounded behind it, as
    sums of floats depend on their order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = Db(spark, sf_dir).rows(text)
        return rows.withColumns({c: F.round(f"`{c}`", n) for c, n in (digits or {}).items()})

    QUERIES[f"sql_{name}"], SQL[f"sql_{name}"] = run, sql or text


def script(sql: str) -> Callable[[Callable[[Db], DataFrame]], Query]:
    def register(build: Callable[[Db], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Db(spark, sf_dir))

        QUERIES[build.__name__], SQL[build.__name__] = run, sql
        return run

    return register


# projection, expressions, names
select("star", "select * from nation")
select("qualified_star", "select n.* from nation as n join region r on n.n_regionkey = r.r_regionkey where r.r_regionkey < 3")
select("aliases", "select c_custkey as k, c_name name, c_acctbal as 'bal' from customer", "select c_custkey as k, c_name as name, c_acctbal as bal from customer")
select("no_from", "select 1 + 2 as a, 'x' as s, true as b, null is null as n", "select 3::bigint as a, 'x' as s, true as b, true as n")
select("arithmetic", "select p_partkey, p_size + 1 as a, p_size - 60 as s, p_size * 2 as m, p_size / 7 as q, (0 - p_size) / 7 as nq, p_size % 7 as r, (0 - p_size) % 7 as nr, p_size / (p_size - p_size) as z, p_retailprice / 2 as f from part",
       "select p_partkey, (p_size + 1)::bigint as a, (p_size - 60)::bigint as s, (p_size * 2)::bigint as m, (p_size // 7)::bigint as q, (-(p_size // 7))::bigint as nq, (p_size % 7)::bigint as r, (-(p_size % 7))::bigint as nr, null::bigint as z, p_retailprice / 2 as f from part")
select("power_factorial", "select p_partkey, p_size ^ 2 as sq, 2 ^ 3 ^ 2 as left_first, !(p_size % 10) as f from part", "select p_partkey, pow(p_size, 2) as sq, 64.0::double as left_first, factorial((p_size % 10)::integer)::bigint as f from part")
select("signs_parentheses", "select c_custkey, -c_acctbal as neg, +c_acctbal as pos, (c_nationkey + 1) * 2 as par, -(c_nationkey - 3) as inner_neg from customer",
       "select c_custkey, -c_acctbal as neg, c_acctbal as pos, ((c_nationkey + 1) * 2)::bigint as par, (3 - c_nationkey)::bigint as inner_neg from customer")
select("constants", "select n_nationkey from nation order by n_nationkey limit 2 + 3 offset 2 * 2", "select n_nationkey from nation order by n_nationkey limit 5 offset 4")
select("escapes", r"""select n_nationkey, 'it''s' as q, "a\tb\n" as t, 'x\\y' as b, "d""d" as d from nation""", r"""select n_nationkey, 'it''s' as q, 'a' || chr(9) || 'b' || chr(10) as t, 'x\y' as b, 'd"d' as d from nation""")
select("names", "select n_name, R_NAME from nation, region where n_regionkey = R_regionkey and nation.n_nationkey > 3", "select n_name, r_name from nation, region where n_regionkey = r_regionkey and n_nationkey > 3")
select("default_names", "select p_brand, count(*), sum(p_size), avg(p_size), min(p_retailprice), max(p_retailprice) from part group by p_brand",
       'select p_brand, count(*) as "count()", sum(p_size)::bigint as "sum(p_size)", (sum(p_size) // count(p_size))::bigint as "average(p_size)", min(p_retailprice) as "min(p_retailprice)", max(p_retailprice) as "max(p_retailprice)" from part group by p_brand')

# filters
select("filter_and", "select o_orderkey from orders where o_totalprice > 300000 && o_orderstatus = 'F'", "select o_orderkey from orders where o_totalprice > 300000 and o_orderstatus = 'F'")
select("filter_or", "select o_orderkey from orders where (o_totalprice > 450000 || o_orderpriority = '1-URGENT') and (o_orderstatus = 'F' or o_orderstatus = 'P')", "select o_orderkey from orders where (o_totalprice > 450000 or o_orderpriority = '1-URGENT') and (o_orderstatus = 'F' or o_orderstatus = 'P')")
select("filter_not", "select p_partkey from part where not (p_size > 10 or p_brand = 'Brand#1')")
select("not_binds_late", "select p_partkey from part where not p_size = 10")
select("compare", "select p_partkey, p_size >= 10 as ge, p_size <= 20 as le, p_size <> 15 as ne, p_size != 15 as nb, p_size > 25 as gt, p_size < 25 as lt, p_size = 15.0 as eq, p_brand > 'Brand#3' as s from part")
select("like_words", "select p_partkey, p_name from part where p_name like %widget% or p_name like red%", "select p_partkey, p_name from part where p_name like '%widget%' or p_name like 'red%'")
select("like_quoted", "select c_custkey from customer where c_name like 'Customer#00000000_'")
select("key_lookup", "select * from customer where c_custkey = 42")
select("keys_lookup", "select o_orderkey, o_totalprice from orders where o_orderkey = 1 or o_orderkey = 7 or o_orderkey = 99")
select("index_lookup", "select c_custkey, c_mktsegment from customer where c_mktsegment = 'BUILDING' or c_mktsegment is null")

# joins
select("cross_join", "select r_name, n_name from region cross join nation")
select("comma_join", "select n.n_name, r.r_name from nation n, region r where n.n_regionkey = r.r_regionkey")
select("inner_join", "select o.o_orderkey, c.c_name from orders o inner join customer c on o.o_custkey = c.c_custkey and o.o_totalprice > c.c_acctbal * 50")
select("theta_join", "select a.n_name as x, b.n_name as y from nation a join nation b on a.n_nationkey < b.n_nationkey")
select("left_join", "select c.c_custkey, o.o_orderkey from customer c left outer join orders o on c.c_custkey = o.o_custkey and o.o_totalprice > 450000")
select("left_join_where", "select c.c_custkey from customer c left join orders o on c.c_custkey = o.o_custkey and o.o_totalprice > 450000 where o.o_orderkey is null")
select("right_join", "select o.o_orderkey, c.c_custkey from orders o right join customer c on o.o_custkey = c.c_custkey and o.o_totalprice > 450000")
select("self_join", "select a.s_suppkey as x, b.s_suppkey as y from supplier a join supplier b on a.s_nationkey = b.s_nationkey where a.s_suppkey < b.s_suppkey")
select("join_chain", "select r.r_name as region, count(*) as n, sum(o.o_totalprice) as total from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey group by r.r_name",
       "select r.r_name as region, count(*) as n, round(sum(o.o_totalprice), 1) as total from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey group by r.r_name", {"total": 1})

# aggregates
select("agg_global", "select count(*) as n, sum(l_quantity) as s, min(l_extendedprice) as mn, max(l_extendedprice) as mx, avg(l_quantity) as av, sum(l_linenumber) as i, avg(l_linenumber) as ia from lineitem",
       "select count(*) as n, round(sum(l_quantity), 2) as s, min(l_extendedprice) as mn, max(l_extendedprice) as mx, round(avg(l_quantity), 4) as av, sum(l_linenumber)::bigint as i, (sum(l_linenumber) // count(l_linenumber))::bigint as ia from lineitem", {"s": 2, "av": 4})
select("agg_empty", "select count(*) as n, sum(o_custkey) as s, max(o_orderstatus) as m from orders where o_orderkey < 0", "select count(*) as n, sum(o_custkey)::bigint as s, max(o_orderstatus) as m from orders where o_orderkey < 0")
select("agg_nulls", "select c.c_nationkey as k, count(*) as a, count(o.o_orderkey) as b, max(o.o_orderkey) as m from customer c left join orders o on c.c_custkey = o.o_custkey and o.o_totalprice > 450000 group by c.c_nationkey")
select("null_group", "select o.o_orderstatus as k, count(*) as n from customer c left join orders o on c.c_custkey = o.o_custkey and o.o_totalprice > 450000 group by o.o_orderstatus")
select("group_alias", "select o_orderstatus as st, o_orderpriority, count(*) as n from orders group by st, o_orderpriority")
select("group_hidden", "select count(*) as n from orders group by o_orderpriority")
select("distinct", "select c_mktsegment, c_nationkey from customer group by c_mktsegment, c_nationkey")
select("agg_of_expr", "select l_returnflag, sum(l_linenumber * (l_linenumber + 1)) as v, sum(l_linenumber) / count(*) as q from lineitem group by l_returnflag", "select l_returnflag, sum(l_linenumber * (l_linenumber + 1))::bigint as v, (sum(l_linenumber) // count(*))::bigint as q from lineitem group by l_returnflag")
select("having", "select o_custkey, count(*) as n from orders group by o_custkey having n > 12 and max(o_totalprice) > 400000", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12 and max(o_totalprice) > 400000")

# order
select("order_desc", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey asc limit 10")
select("order_offset", "select p_partkey from part order by p_partkey limit 10 offset 20")
select("order_hidden", "select c_name from customer order by c_acctbal desc, c_custkey limit 5")
select("order_aggregate", "select c_nationkey, count(*) as n from customer group by c_nationkey order by count(*) desc, c_nationkey limit 5")
select("order_nulls", "select c.c_custkey, o.o_orderkey from customer c left join orders o on c.c_custkey = o.o_custkey and o.o_totalprice > 300000 order by o.o_orderkey, c.c_custkey limit 40", "select c.c_custkey, o.o_orderkey from customer c left join orders o on c.c_custkey = o.o_custkey and o.o_totalprice > 300000 order by o.o_orderkey asc nulls first, c.c_custkey limit 40")

SUPPLIER = "CREATE TABLE s (s_suppkey INT PRIMARY KEY, s_name TEXT UNIQUE NOT NULL, s_nationkey INT, s_acctbal FLOAT, KEY (s_nationkey))"
CUSTOMER = "CREATE TABLE c (c_custkey INT PRIMARY KEY, c_name TEXT, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment VARCHAR(10))"
NATIONS = "CREATE TABLE r (r_regionkey INT PRIMARY KEY, r_name TEXT); CREATE TABLE n (n_nationkey INT PRIMARY KEY, n_name TEXT, n_regionkey INT NOT NULL, FOREIGN KEY (n_regionkey) REFERENCES r (r_regionkey))"
SUPPLIERS = "select s_suppkey, s_name, s_nationkey::bigint as s_nationkey, s_acctbal from supplier"


def suppliers(db: Db) -> Db:
    db.execute(SUPPLIER)
    db.load("s", db.source("supplier"))
    return db


def customers(db: Db) -> Db:
    db.execute(CUSTOMER)
    db.load("c", db.source("customer"))
    return db


def nations(db: Db) -> Db:
    db.execute(NATIONS)
    db.load("r", db.source("region"))
    db.load("n", db.source("nation"))
    return db


# definitions
@script("select 'n' as name, 'CREATE TABLE n (\n  n_nationkey INT PRIMARY KEY,\n  n_name TEXT NULL DEFAULT NULL,\n  n_regionkey INT NOT NULL,\n  FOREIGN KEY (n_regionkey) REFERENCES r (r_regionkey)\n)' as ddl union all select 'r', 'CREATE TABLE r (\n  r_regionkey INT PRIMARY KEY,\n  r_name TEXT NULL DEFAULT NULL\n)'")
def ddl_describe(db):
    """Tables and the texts that make them."""
    db.execute(NATIONS)
    return db.told([(name, db.describe(name)) for name in db.tables()], "name string, ddl string")


@script("select * from (values ('again', true), ('no key', true), ('two keys', true), ('null key', true), ('default of another type', true), ('no such parent', true), ('parent column without a key', true), ('reserved name', true), ('own parent', false)) x(what, refused)")
def ddl_refusals(db):
    db.execute(NATIONS)
    tried = {"again": "CREATE TABLE n (id INT PRIMARY KEY)", "no key": "CREATE TABLE a (id INT)", "two keys": "CREATE TABLE a (id INT PRIMARY KEY, k INT PRIMARY KEY)", "null key": "CREATE TABLE a (id INT NULL PRIMARY KEY)",
             "default of another type": "CREATE TABLE a (id INT PRIMARY KEY, k INT DEFAULT 'x')", "no such parent": "CREATE TABLE a (id INT PRIMARY KEY, k INT, FOREIGN KEY (k) REFERENCES z (id))",
             "parent column without a key": "CREATE TABLE a (id INT PRIMARY KEY, k TEXT, FOREIGN KEY (k) REFERENCES r (r_name))", "reserved name": "CREATE TABLE a (id INT PRIMARY KEY, _deleted BOOL)", "own parent": "CREATE TABLE a (id INT PRIMARY KEY, k INT, FOREIGN KEY (k) REFERENCES a (id))"}
    return db.told([(what, db.refused(sql)) for what, sql in tried.items()], "what string, refused boolean")


@script("select * from (values ('r', true), ('n', false), ('n again', true), ('r now', false)) x(what, refused)")
def ddl_drop(db):
    """A table that another refers to can't be dropped; one that isn't there neither."""
    nations(db)
    return db.told([(what, db.refused(f"DROP TABLE {what[0]}")) for what in ("r", "n", "n again", "r now")], "what string, refused boolean")


@script("select 1::bigint as id, 'kept' as v")
def ddl_recreate(db):
    """A table made anew under a dropped one's name begins empty."""
    suppliers(db).execute("DROP TABLE s; CREATE TABLE s (id INT PRIMARY KEY, v TEXT); INSERT INTO s VALUES (1, 'kept')")
    return db.rows("select * from s")


@script("select 1::bigint as id, 'ABC' as a, 'ABC' as b, 'ABC' as c, true as d, false as e, 3.14::double as f, 2.71828::double as g, 42::bigint as h, 100::bigint as i, null::varchar as j")
def ddl_types(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, a CHAR(10), b VARCHAR(255), c TEXT, d BOOLEAN, e BOOL, f FLOAT, g DOUBLE, h INT, i INTEGER, j TEXT NULL)")
    db.execute("INSERT INTO t VALUES (1,'ABC','ABC','ABC',TRUE,FALSE,3.14,2.71828,42,100)")
    return db.rows("select * from t")


# changes
@script(f"{SUPPLIERS} union all select -1, 'new one', 3, 1.5 union all select -2, 'another', null, null")
def dml_insert(db):
    suppliers(db).execute("INSERT INTO s VALUES (0-1, 'new one', 3, 1.5), (0-2, 'another', NULL, NULL)")
    return db.rows("select * from s")


@script("select * from (values (1::bigint, 'none', null::bigint, true), (2, 'none', null, true), (3, 'x', 5, false)) t(id, name, n, ok)")
def dml_insert_defaults(db):
    db.execute("CREATE TABLE d (id INT PRIMARY KEY, name TEXT DEFAULT 'none', n INT NULL, ok BOOL NOT NULL DEFAULT TRUE); INSERT INTO d (id) VALUES (1), (2); INSERT INTO d VALUES (3, 'x', 2 + 3, FALSE)")
    return db.rows("select * from d")


@script("select s_suppkey, s_name, s_nationkey::bigint as s_nationkey, case when s_acctbal < 0 then 0.0 else s_acctbal end as s_acctbal from supplier")
def dml_update(db):
    suppliers(db).execute("UPDATE s SET s_acctbal = 0.0 WHERE s_acctbal < 0")
    return db.rows("select * from s")


@script("select s_suppkey, s_name, (s_nationkey + 1)::bigint as s_nationkey, s_acctbal * (s_nationkey + 1) as s_acctbal from supplier")
def dml_update_in_order(db):
    """An assignment sees those before it."""
    suppliers(db).execute("UPDATE s SET s_nationkey = s_nationkey + 1, s_acctbal = s_acctbal * s_nationkey")
    return db.rows("select * from s")


@script("select case when s_nationkey < 5 then s_suppkey + 100000000 else s_suppkey end as s_suppkey, s_name, s_nationkey::bigint as s_nationkey, s_acctbal from supplier")
def dml_update_key(db):
    suppliers(db).execute("UPDATE s SET s_suppkey = s_suppkey + 100000000 WHERE s_nationkey < 5")
    return db.rows("select * from s")


@script("select * from (select s_suppkey, s_name, s_nationkey::bigint as s_nationkey, s_acctbal from supplier) where not s_acctbal < 0")
def dml_delete(db):
    suppliers(db).execute("DELETE FROM s WHERE s_acctbal < 0")
    return db.rows("select * from s")


@script("select * from (select s_suppkey, s_name, s_nationkey::bigint as s_nationkey, s_acctbal from supplier) where s_suppkey <> 1 union all select 1, 'back again', null, 2.5")
def dml_insert_deleted_key(db):
    suppliers(db).execute("DELETE FROM s WHERE s_suppkey = 1; INSERT INTO s VALUES (1, 'back again', NULL, 2.5)")
    return db.rows("select * from s")


@script("select 'load' as change, count(*) as n from customer union all select 'update', count(*) from customer where c_nationkey < 5 union all select 'delete', count(*) from customer where c_acctbal < 0 union all select 'insert', 2 union all select 'delete none', 0")
def dml_counts(db):
    db.execute(CUSTOMER)
    done = [("load", db.load("c", db.source("customer")).count)]
    for what, sql in (("update", "UPDATE c SET c_mktsegment = 'X' WHERE c_nationkey < 5"), ("delete", "DELETE FROM c WHERE c_acctbal < 0"), ("insert", "INSERT INTO c (c_custkey) VALUES (0-1), (0-2)"), ("delete none", "DELETE FROM c WHERE FALSE")):
        done.append((what, db.execute(sql).count))
    return db.told(done, "change string, n bigint")


@script("select s_nationkey + case when s_suppkey < 50 then 100 else 0 end as k, count(*) as n, min(s_suppkey) as first_key from supplier group by k")
def dml_index(db):
    """What an index lists after a change."""
    suppliers(db).execute("UPDATE s SET s_nationkey = s_nationkey + 100 WHERE s_suppkey < 50")
    return db.index("s", "s_nationkey").select(F.col("s_nationkey").alias("k"), F.size("keys").cast("bigint").alias("n"), F.array_min("keys").alias("first_key"))


# constraints
def after(db: Db, table: str, tried: dict[str, str]) -> DataFrame:
    """What was refused, and how many rows there are then."""
    said = [(what, db.refused(sql)) for what, sql in tried.items()]
    return db.told(said, "what string, refused boolean").crossJoin(db.rows(f"select count(*) as n from {table}"))


@script("select what, refused, n + 2 as n from (values ('there', true), ('twice', true), ('null', true), ('new', false), ('moved onto one', true), ('moved together', true), ('moved', false), ('another', false)) x(what, refused), (select count(*) as n from supplier)")
def constraint_primary_key(db):
    return after(suppliers(db), "s", {
        "there": "INSERT INTO s VALUES (1, 'p', 1, 1.0)", "twice": "INSERT INTO s VALUES (0-1, 'p', 1, 1.0), (0-1, 'q', 1, 1.0)", "null": "INSERT INTO s VALUES (NULL, 'p', 1, 1.0)", "new": "INSERT INTO s VALUES (0-5, 'p', 1, 1.0)",
        "moved onto one": "UPDATE s SET s_suppkey = 2 WHERE s_suppkey = 1", "moved together": "UPDATE s SET s_suppkey = 0-9 WHERE s_suppkey < 3", "moved": "UPDATE s SET s_suppkey = 0-9 WHERE s_suppkey = 1", "another": "INSERT INTO s VALUES (1, 'q', 1, 1.0)"})


@script("select what, refused, 4::bigint as n from (values ('same value', true), ('second null', true), ('another', false), ('all alike', true), ('two nulls', true), ('freed value', false)) x(what, refused)")
def constraint_unique(db):
    """NULL counts as a value."""
    db.execute("CREATE TABLE u (id INT PRIMARY KEY, email TEXT UNIQUE); INSERT INTO u VALUES (1, 'a'), (2, NULL)")
    return after(db, "u", {"same value": "INSERT INTO u VALUES (3, 'a')", "second null": "INSERT INTO u VALUES (3, NULL)", "another": "INSERT INTO u VALUES (3, 'b')", "all alike": "UPDATE u SET email = 'z'",
                           "two nulls": "UPDATE u SET email = NULL", "freed value": "UPDATE u SET email = 'c' WHERE id = 1; INSERT INTO u VALUES (4, 'a')"})


@script("select what, refused, 1::bigint as n from (values ('null', true), ('int for float', true), ('text for int', true), ('too many', true), ('too few named', true), ('no default', true), ('unknown column', true), ('right', false), ('update to null', true), ('update of another type', true)) x(what, refused)")
def constraint_not_null_types_arity(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, name TEXT NOT NULL, x FLOAT)")
    return after(db, "t", {"null": "INSERT INTO t VALUES (1, NULL, 1.0)", "int for float": "INSERT INTO t VALUES (1, 'a', 1)", "text for int": "INSERT INTO t VALUES ('1', 'a', 1.0)", "too many": "INSERT INTO t VALUES (1, 'a', 1.0, 2)",
                           "too few named": "INSERT INTO t (id, name) VALUES (1)", "no default": "INSERT INTO t (id) VALUES (1)", "unknown column": "INSERT INTO t (id, nope) VALUES (1, 2)", "right": "INSERT INTO t VALUES (1, 'a', 1.0)",
                           "update to null": "UPDATE t SET name = NULL", "update of another type": "UPDATE t SET x = 1"})


@script("select what, refused, n + 1 as n from (values ('no parent', true), ('null', true), ('a parent', false), ('moved to no parent', true), ('moved to a parent', false)) x(what, refused), (select count(*) as n from nation)")
def constraint_foreign_key_write(db):
    return after(nations(db), "n", {"no parent": "INSERT INTO n VALUES (100, 'x', 77)", "null": "INSERT INTO n VALUES (100, 'x', NULL)", "a parent": "INSERT INTO n VALUES (100, 'x', 1)", "moved to no parent": "UPDATE n SET n_regionkey = 78 WHERE n_nationkey = 3", "moved to a parent": "UPDATE n SET n_regionkey = 2 WHERE n_nationkey = 3"})


@script("select what, refused, n from (values ('referred to', true), ('moved away', true), ('its children first', false), ('not referred to', false)) x(what, refused), (select count(*) as n from region)")
def constraint_foreign_key_delete(db):
    nations(db).execute("INSERT INTO r VALUES (50, 'empty')")
    return after(db, "r", {"referred to": "DELETE FROM r WHERE r_regionkey = 1", "moved away": "UPDATE r SET r_regionkey = 90 WHERE r_regionkey = 1", "its children first": "UPDATE n SET n_regionkey = 0 WHERE n_regionkey = 1; DELETE FROM r WHERE r_regionkey = 1", "not referred to": "INSERT INTO r VALUES (51, 'e'); DELETE FROM r WHERE r_regionkey = 50"})


# transactions
@script("select s_suppkey, s_name, case when s_suppkey <= 5 then 7 else s_nationkey end::bigint as s_nationkey, s_acctbal from supplier where s_suppkey <> 9 union all select -1, 'new', 1, 1.5")
def txn_commit(db):
    suppliers(db).execute("START TRANSACTION; UPDATE s SET s_nationkey = 7 WHERE s_suppkey <= 5; DELETE FROM s WHERE s_suppkey = 9; INSERT INTO s VALUES (0-1, 'new', 1, 1.5); COMMIT")
    return db.other().rows("select * from s")


@script(SUPPLIERS)
def txn_rollback(db):
    suppliers(db).execute("START TRANSACTION READ WRITE; UPDATE s SET s_nationkey = 7; DELETE FROM s WHERE s_suppkey < 9; ROLLBACK")
    return db.rows("select * from s")


@script("select * from (select 'own changes' as seen, count(*) - 1 as n from supplier union all select 'by others before the commit', count(*) from supplier union all select 'others'' commits', 0 union all select 'by others after it', count(*) - 1 from supplier)")
def txn_isolation(db):
    """A transaction sees its snapshot and its own changes; others see them when it has committed."""
    other, told = suppliers(db).other(), []
    n = lambda session, sql: session.rows(sql).first()[0]
    db.execute("START TRANSACTION; DELETE FROM s WHERE s_suppkey = 1")
    told.append(("own changes", n(db, "select count(*) from s")))
    told.append(("by others before the commit", n(other, "select count(*) from s")))
    other.execute("UPDATE s SET s_nationkey = 1000 WHERE s_suppkey = 2")
    told.append(("others' commits", n(db, "select count(*) from s where s_nationkey = 1000")))
    db.execute("COMMIT")
    told.append(("by others after it", n(other, "select count(*) from s")))
    return db.told(told, "seen string, n bigint")


@script("select * from (values ('other keys', false), ('the same key', true), ('a unique value', true), ('a child of a row that goes', true), ('a parent that gets a child', true)) x(what, refused)")
def txn_conflicts(db):
    other, told = suppliers(nations(db)).other(), []
    db.execute("INSERT INTO r VALUES (60, 'a'), (61, 'b')")
    for what, mine, theirs in (("other keys", "UPDATE s SET s_nationkey = 1 WHERE s_suppkey = 1", "UPDATE s SET s_nationkey = 2 WHERE s_suppkey = 2"), ("the same key", "UPDATE s SET s_nationkey = 3 WHERE s_suppkey = 1", "UPDATE s SET s_nationkey = 4 WHERE s_suppkey = 1"),
                               ("a unique value", "INSERT INTO s VALUES (0-1, 'x', 1, 1.0)", "INSERT INTO s VALUES (0-2, 'x', 1, 1.0)"), ("a child of a row that goes", "INSERT INTO n VALUES (200, 'x', 60)", "DELETE FROM r WHERE r_regionkey = 60"),
                               ("a parent that gets a child", "DELETE FROM r WHERE r_regionkey = 61", "INSERT INTO n VALUES (201, 'x', 61)")):
        db.execute(f"START TRANSACTION; {mine}")
        other.execute(theirs)
        told.append((what, db.refused("COMMIT")))
    return db.told(told, "what string, refused boolean")


@script("select * from (values ('write after BEGIN', true), ('write after READ ONLY', true), ('BEGIN twice', true), ('COMMIT without one', true), ('ROLLBACK without one', true), ('version with READ WRITE', true), ('version to come', true), ('select after BEGIN', false)) x(what, refused)")
def txn_rules(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY)")
    told = []
    for what, first, then in (("write after BEGIN", "BEGIN", "INSERT INTO t VALUES (1)"), ("write after READ ONLY", "START TRANSACTION READ ONLY", "DELETE FROM t WHERE id = 1"), ("BEGIN twice", "BEGIN", "BEGIN"), ("COMMIT without one", "", "COMMIT"), ("ROLLBACK without one", "", "ROLLBACK"),
                              ("version with READ WRITE", "", "START TRANSACTION READ WRITE 1"), ("version to come", "", "START TRANSACTION READ ONLY 99"), ("select after BEGIN", "BEGIN", "SELECT * FROM t")):
        if first:
            db.execute(first)
        told.append((what, db.refused(then)))
        if db.txn:
            db.execute("ROLLBACK")
    return db.told(told, "what string, refused boolean")


@script("select 2 as at, 0 as n, null::double as low union all select 3, count(*), min(s_acctbal) from supplier union all select 4, count(*), min(s_acctbal) from supplier where s_acctbal >= 0 union all select 5, count(*), min(s_acctbal) + 1 from supplier where s_acctbal >= 0")
def as_of(db):
    """What the versions below one saw."""
    suppliers(db).execute("DELETE FROM s WHERE s_acctbal < 0; UPDATE s SET s_acctbal = s_acctbal + 1.0")
    told = []
    for version in (2, 3, 4, 5):
        db.execute(f"START TRANSACTION READ ONLY {version}")
        told.append(db.rows("select count(*) as n, min(s_acctbal) as low from s").select(F.lit(version).alias("at"), "n", "low"))
        db.execute("COMMIT")
    return told[0].unionByName(told[1]).unionByName(told[2]).unionByName(told[3])


@script("select s_suppkey, s_name, s_nationkey::bigint as s_nationkey, s_acctbal from supplier where s_acctbal < 0")
def as_of_rows(db):
    """Rows that are gone now, as an earlier version has them."""
    suppliers(db).execute("DELETE FROM s WHERE s_acctbal < 0; START TRANSACTION READ ONLY 3")
    return db.rows("select * from s where s_acctbal < 0")


@script("select * from (values ('create', 2), ('insert', 3), ('select', 3), ('refused insert', 4), ('rolled back', 5), ('read only', 5)) x(what, version)")
def version_counter(db):
    """Every beginning of a read-write transaction takes a version."""
    told = []
    for what, sql in (("create", "CREATE TABLE t (id INT PRIMARY KEY)"), ("insert", "INSERT INTO t VALUES (1)"), ("select", "SELECT * FROM t"), ("refused insert", "INSERT INTO t VALUES (1)"), ("rolled back", "START TRANSACTION; ROLLBACK"), ("read only", "BEGIN; COMMIT")):
        db.refused(sql)
        told.append((what, db.status()["version"]))
    return db.told(told, "what string, version int")


# administration
@script("select s_suppkey, s_name, (s_nationkey + 3)::bigint as s_nationkey, s_acctbal from supplier")
def compaction(db):
    """A store whose changes are a fifth of it or more is rewritten when it is opened, under a transaction that stays open."""
    suppliers(db).execute("UPDATE s SET s_nationkey = s_nationkey + 1; UPDATE s SET s_nationkey = s_nationkey + 1; START TRANSACTION; UPDATE s SET s_nationkey = s_nationkey + 1")
    opened = db.other()
    if len(opened.store.live("s", opened.store.snapshot())) != 1:
        raise AssertionError("not compacted")
    db.execute("COMMIT")
    return opened.rows("select * from s")


@script("select * from (values ('changes make garbage', true), ('opening compacts', true), ('earlier versions stay', true)) x(what, so)")
def compaction_facts(db):
    suppliers(db).execute("UPDATE s SET s_nationkey = 1")
    before = db.status()
    opened = db.other()
    live = opened.store.live("s", opened.store.snapshot())
    opened.execute("START TRANSACTION READ ONLY 3")
    earlier = opened.rows("select count(*) from s where s_nationkey <> 1").first()[0] == db.source("supplier").where("s_nationkey <> 1").count()
    return db.told([("changes make garbage", before["garbage"] > 0), ("opening compacts", len(live) == 1 and before["commits"] + 1 == len(opened.store.snapshot())), ("earlier versions stay", earlier)], "what string, so boolean")


@script(SUPPLIERS)
def recovery(db):
    """A commit whose writer was lost before it was whole changes nothing, nor do files that no commit names."""
    suppliers(db).store.write(db.table("s"), db.rows("select * from s").limit(1).withColumn("_deleted", F.lit(True)), 90, 1, "change")
    db.store.files.create(f"_log/{len(db.store.files.names('_log')):020d}.json", '{"version": 90, "tables": {"s": [{"pa')
    return db.other().rows("select * from s")


@script("select * from (values ('SELECT s_name FROM s WHERE s_suppkey = 1', true), ('INSERT INTO s VALUES (0-1, ''x'', 1, 1.0)', true), ('UPDATE s SET s_nationkey = 1 WHERE s_suppkey = 1', true), ('DELETE FROM s WHERE s_suppkey = 1', true)) x(statement, planned), (select count(*) as n from supplier)")
def explain(db):
    """Plans are told, nothing is run."""
    suppliers(db)
    told = []
    for sql in ("SELECT s_name FROM s WHERE s_suppkey = 1", "INSERT INTO s VALUES (0-1, 'x', 1, 1.0)", "UPDATE s SET s_nationkey = 1 WHERE s_suppkey = 1", "DELETE FROM s WHERE s_suppkey = 1"):
        text = db.execute(f"EXPLAIN {sql}").text
        told.append((sql, "== Physical Plan ==" in text and ("Insert" in text[:6] or "PushedFilters: [IsNotNull(s_suppkey), EqualTo(s_suppkey,1)" in text)))
    return db.told(told, "statement string, planned boolean").crossJoin(db.rows("select count(*) as n from s"))


@script("select * from (values ('version', 4), ('commits', 1), ('tables', 1), ('active', 1), ('transaction', 3)) x(name, value)")
def status(db):
    suppliers(db).execute("START TRANSACTION")
    now = db.status()
    db_says = [(k, int(now[k])) for k in ("version", "commits", "tables", "active", "transaction")]
    db.execute("ROLLBACK")
    return db.told(db_says, "name string, value int")


@script("select * from (values (0, 't'), (1, 'insert: 2 rows'), (2, 'id|x|b\n1|2.5000|TRUE\n2|NULL|FALSE'), (3, 'headers off'), (4, '1|2.5000|TRUE'), (5, 't'), (6, 'CREATE TABLE t (\n  id INT PRIMARY KEY,\n  x FLOAT NULL DEFAULT NULL,\n  b BOOL NULL DEFAULT NULL\n)'), (7, 'update: 1 rows')) x(line, said)")
def shell(db):
    repl, said = Repl(db), []
    for text in ("CREATE TABLE t (id INT PRIMARY KEY, x FLOAT,", "b BOOL);", "INSERT INTO t VALUES (1, 2.5, TRUE), (2, NULL, FALSE);", "SELECT * FROM t ORDER BY id;", "!headers", "SELECT * FROM t WHERE id = 1;", "!tables", "!table t", "UPDATE t SET b = TRUE WHERE id = 2;"):
        if (out := repl.line(text)) is not None:
            said.append((len(said), out))
    return db.told(said, "line int, said string")
