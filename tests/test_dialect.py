"""Parsing, and SELECTs of the dialect against DuckDB."""

import glob
import os
import random
from collections import Counter

import duckdb
import pytest

from ridgeline.dialect import tree as t
from ridgeline.dialect.lower import Selects
from ridgeline.dialect.parser import parse
from ridgeline.dialect.tokens import SqlError

SF = "/root/testdata/sf0.001"


def one(sql):
    return parse(sql)[0]


def test_precedence():
    e = one("SELECT 1 + 2 * 3 ^ 2 ^ 2 - 4").items[0].expr
    power = t.Binary("^", t.Binary("^", t.Literal(3), t.Literal(2)), t.Literal(2))
    assert e == t.Binary("-", t.Binary("+", t.Literal(1), t.Binary("*", t.Literal(2), power)), t.Literal(4))
    assert one("SELECT 1 WHERE NOT a = 1 OR b && c").where == t.Binary("or", t.Unary("not", t.Binary("=", t.Name("a"), t.Literal(1))), t.Binary("and", t.Name("b"), t.Name("c")))


def test_strings_aliases_patterns():
    s = one(r"""select 'it''s' x, "a\n\t\"q" as 'Nice', n from T as u where n like A% and m like %li% and o like 'x_%' and not p is null""")
    assert [i.alias for i in s.items] == ["x", "Nice", None] and s.items[0].expr.value == "it's" and s.items[1].expr.value == 'a\n\t"q'
    assert str(s.where).count("like") == 3 and "'A%'" in str(s.where) and "'%li%'" in str(s.where)
    assert s.source == t.Source("t", "u")


def test_split_at_semicolons_outside_strings():
    assert len(parse("select ';' ; select 1e3 ;; select 2")) == 3
    assert parse("select 1e3")[0].items[0].expr == t.Literal(1000.0)


def test_statements():
    c = one("CREATE TABLE IF NOT EXISTS a (id INT PRIMARY KEY, n VARCHAR(20) UNIQUE NOT NULL, k DOUBLE DEFAULT 1.5, f INT, KEY (k), FOREIGN KEY (f) REFERENCES b (id))")
    assert [x.kind for x in c.columns] == ["bigint", "string", "double", "bigint"] and c.columns[3].references == ("b", "id") and c.columns[2].index
    assert one("BEGIN") == t.Begin(True) and one("START TRANSACTION") == t.Begin(False) and one("start transaction read only 7") == t.Begin(True, 7)
    assert one("insert t (a, b) values (1, 'x'), (2, null)") == t.Insert("t", ["a", "b"], [[t.Literal(1), t.Literal("x")], [t.Literal(2), t.Literal(None)]])
    assert isinstance(one("explain select 1"), t.Explain)


@pytest.mark.parametrize("sql", ["select", "select 1 from", "delete from t", "start transaction read write 3", "select a from t where x in (1)", "select count(distinct a) from t", "select 1 union select 2",
                                 "alter table t", "create table t (a blob)", "select * from (select 1)", "select a limit", "select 'open", "insert into t select 1", "select case when 1 then 2 end"])
def test_refused(sql):
    with pytest.raises(SqlError):
        parse(sql)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.fixture(scope="module")
def selects(spark):
    return Selects(spark, lambda name: spark.read.parquet(f"{SF}/{name}.parquet"))


SAME = [
    ("select c_custkey k, c_name as 'name' from customer", None),
    ("select n.* from nation n join region r on n.n_regionkey = r.r_regionkey", None),
    ("select 1+2 as a, 'x' as s, TRUE as b", "select 3::bigint as a, 'x' as s, true as b"),
    ("select o_orderkey from orders where (o_totalprice > 450000 || o_orderpriority = '1-URGENT') && (o_orderstatus = 'F' or o_orderstatus = 'P')", "select o_orderkey from orders where (o_totalprice > 450000 or o_orderpriority = '1-URGENT') and (o_orderstatus = 'F' or o_orderstatus = 'P')"),
    ("select p_partkey, p_size / 7 as q, p_size / (p_size % 5) as z from part", "select p_partkey, (p_size // 7)::bigint as q, (p_size // nullif(p_size % 5, 0))::bigint as z from part"),
    ("select p_partkey, p_size ^ 2 as sq, !(p_size % 10) as f, -p_size as m from part", "select p_partkey, pow(p_size, 2) as sq, factorial((p_size % 10)::int)::bigint as f, -p_size as m from part"),
    ("select p_partkey from part where p_name like red%", "select p_partkey from part where p_name like 'red%'"),
    ("select p_partkey from part where p_name like %widget%", "select p_partkey from part where p_name like '%widget%'"),
    ("select n.n_name, r.r_name from nation n, region r where n.n_regionkey = r.r_regionkey", None),
    ("select a.n_name x, b.n_name y from nation a join nation b on a.n_nationkey < b.n_nationkey", None),
    ("select c.c_custkey, o.o_orderkey from customer c left outer join orders o on c.c_custkey = o.o_custkey and c.c_acctbal > 5000", None),
    ("select o.o_orderkey, c.c_custkey from orders o right join customer c on o.o_custkey = c.c_custkey and o.o_totalprice > 450000", None),
    ("select r.r_name region, count(*) n from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey group by r_name", None),
    ("select p_brand, avg(p_size) av, sum(p_size) s, min(p_name) mn from part group by p_brand", "select p_brand, (sum(p_size) // count(p_size))::bigint av, sum(p_size)::bigint s, min(p_name) mn from part group by p_brand"),
    ("select count(*) n, sum(o_totalprice) s from orders where o_orderkey < 0", None),
    ("select o_orderstatus st, count(*) n from orders where o_orderkey < 0 group by st", None),
    ("select c_mktsegment, c_nationkey from customer group by c_mktsegment, c_nationkey", None),
    ("select p_size % 5 b, count(*) n from part group by p_size % 5", None),
    ("select o_custkey from orders group by o_custkey having sum(o_totalprice) > 4000000 and count(*) > 3", None),
    ("select c_nationkey, count(*) as N from customer group by c_nationkey order by n desc, c_nationkey limit 5 offset 2", None),
    ("select c_name from customer order by c_acctbal desc, c_custkey limit 5", None),
    ("select event_type, sum(value) / count(value) > 3 m from events group by event_type", None),
]


@pytest.mark.parametrize(("mine", "theirs"), SAME)
def test_same_rows(selects, duck, mine, theirs):
    df, con = selects(one(mine)), duck.execute(theirs or mine)
    assert [c.lower() for c in df.columns] == [d[0].lower() for d in con.description]
    assert Counter(map(repr, map(tuple, df.collect()))) == Counter(map(repr, con.fetchall()))


@pytest.mark.parametrize("sql", ["select nope from nation", "select n_name from nation, nation", "select n_regionkey from nation a, nation b", "select 'a' + 1", "select n_name from nation where n_name = 1", "select n_name, count(*) from nation",
                                 "select * from nation limit 'x'", "select sum(count(*)) from nation", "select n_name from nation where count(*) > 1", "select 1.5 % 2"])
def test_unresolved(selects, sql):
    with pytest.raises(SqlError):
        selects(one(sql))


def test_default_titles(selects):
    assert selects(one("select count(*), sum(n_regionkey), avg(n_regionkey), n_name from nation group by n_name")).columns == ["count()", "sum(n_regionkey)", "average(n_regionkey)", "n_name"]


def test_random_expressions_against_duckdb(selects, duck):
    rng = random.Random(4)

    def number(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["p_size", "p_partkey", "p_retailprice", str(rng.randint(0, 9)), "2.5"])
        return f"({number(depth - 1)} {rng.choice('+-*')} {number(depth - 1)})"

    def test(depth):
        if depth == 0:
            return f"({number(1)} {rng.choice(['<', '>', '=', '<>', '<=', '>='])} {number(1)})"
        return rng.choice([f"(not {test(depth - 1)})", f"({test(depth - 1)} and {test(depth - 1)})", f"({test(depth - 1)} or {test(depth - 1)})", f"({number(1)} is null)"])

    items = ", ".join(f"{number(3)} as n{k}, {test(2)} as t{k}" for k in range(12))
    sql = f"select p_partkey, {items} from part"
    got = sorted(tuple(r) for r in selects(one(sql)).collect())
    want = sorted(duck.execute(sql).fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or abs(float(x) - float(y)) <= 1e-9 * abs(float(y)) for x, y in zip(a, b, strict=True))
