"""Definitions, changes, constraints, transactions and time travel, on the worked examples."""

import pytest

from ridgeline.dialect.tokens import SqlError
from ridgeline.repl import Repl
from ridgeline.session import Session, TransactionError
from ridgeline.sources.constraints import ConstraintError


@pytest.fixture
def db(spark, tmp_path):
    return Session(spark, f"file://{tmp_path}/db")


def rows(db, sql):
    return sorted((tuple(r) for r in db.execute(sql).rows.collect()), key=repr)


SALES = """CREATE TABLE sales (id INT PRIMARY KEY, product_name TEXT, price DOUBLE, quantity INT);
INSERT INTO sales VALUES (1,'Laptop',999.99,3),(2,'Phone',699.50,5),(3,'Tablet',299.00,2),(4,'Headphones',149.99,8),(5,'Speaker',199.95,4);"""


def test_all_types(db):
    db.execute("""CREATE TABLE example_table (id INT PRIMARY KEY, char_col CHAR(10), varchar_col VARCHAR(255), text_col TEXT, boolean_col BOOLEAN, bool_col BOOL, float_col FLOAT, double_col DOUBLE,
                  int_col INT, integer_col INTEGER, nullable_col TEXT NULL)""")
    db.execute("INSERT INTO example_table VALUES (1,'ABC','ABC','ABC',TRUE,FALSE,3.14,2.71828,42,100)")
    assert rows(db, "select * from example_table") == [(1, "ABC", "ABC", "ABC", True, False, 3.14, 2.71828, 42, 100, None)]
    for bad in ("(2, 1, 'a','a',true,true,1.0,1.0,1,1,null)", "(2,'a','a','a',true,true,1,1.0,1,1,null)", "(null,'a','a','a',true,true,1.0,1.0,1,1,null)", "(1,'a','a','a',true,true,1.0,1.0,1,1,null)"):
        with pytest.raises(ConstraintError):
            db.execute(f"INSERT INTO example_table VALUES {bad}")


def test_aggregates_on_sales(db):
    db.execute(SALES)
    got = rows(db, "select count(*), sum(price), min(price), max(price), avg(price), sum(quantity), avg(quantity), min(quantity), max(quantity), sum(price*quantity) from sales")[0]
    assert got[0] == 5 and [round(x, 3) for x in got[1:5]] == [2348.43, 149.99, 999.99, 469.686] and got[5:9] == (22, 4, 2, 8) and round(got[9], 2) == 9095.19


def test_defaults_and_unique(db):
    db.execute("CREATE TABLE e (id INT PRIMARY KEY NOT NULL, username VARCHAR(9) UNIQUE NOT NULL, email TEXT UNIQUE NULL DEFAULT NULL, is_active BOOL NOT NULL DEFAULT TRUE)")
    db.execute("INSERT INTO e (id, username) VALUES (1,'A')")
    assert rows(db, "select * from e") == [(1, "A", None, True)]
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO e (id, username) VALUES (2,'B')")  # a second NULL email
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO e VALUES (2,'A','x',TRUE)")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO e (id) VALUES (2)")
    with pytest.raises(SqlError):
        db.execute("CREATE TABLE f (id INT PRIMARY KEY, n INT DEFAULT 'x')")
    assert db.describe("e").startswith("CREATE TABLE e (\n  id INT PRIMARY KEY,\n  username TEXT NOT NULL UNIQUE")


def test_references(db):
    db.execute("""CREATE TABLE departments (department_id INT PRIMARY KEY, department_name TEXT NOT NULL UNIQUE);
      CREATE TABLE employees (employee_id INT PRIMARY KEY, salary INT NOT NULL, name TEXT NOT NULL, email TEXT NOT NULL UNIQUE, ext_id INT NULL, KEY (salary), FOREIGN KEY (name) REFERENCES departments(department_name));
      INSERT INTO departments VALUES (1,'Human Resources'),(2,'Engineering'),(3,'Empty');
      INSERT INTO employees VALUES (1,100,'Human Resources','123@.com',11),(2,200,'Engineering','456@.com',22)""")
    for bad in ("INSERT INTO employees VALUES (3,1,'Sales','x',1)", "INSERT INTO employees VALUES (1,1,'Engineering','x',1)", "INSERT INTO employees VALUES (3,1,'Engineering','123@.com',1)", "INSERT INTO employees VALUES (3,1,NULL,'x',1)",
                "DROP TABLE departments", "DELETE FROM departments WHERE department_id = 1", "UPDATE departments SET department_name = 'X' WHERE department_id = 2", "UPDATE employees SET name = 'X'", "UPDATE employees SET email = 'same'"):
        with pytest.raises(ConstraintError):
            db.execute(bad)
    assert db.execute("DELETE FROM departments WHERE department_id = 3").count == 1
    assert db.execute("UPDATE departments SET department_id = 9 WHERE department_id = 2").count == 1
    assert rows(db, "select department_id, department_name from departments") == [(1, "Human Resources"), (9, "Engineering")]
    assert len(rows(db, "select * from employees")) == 2
    assert [tuple(r) for r in db.index("employees", "salary").orderBy("salary").collect()] == [(100, [1]), (200, [2])]


def test_update_and_delete(db):
    db.execute(SALES)
    assert db.execute("UPDATE sales SET quantity = quantity + 1, price = price * quantity WHERE id <= 2").count == 2
    assert [(i, round(p, 2), q) for i, p, q in rows(db, "select id, price, quantity from sales where id < 3")] == [(1, 3999.96, 4), (2, 4197.0, 6)]
    assert rows(db, "select id from sales where price = 999.99") == []  # newest first, then the filter
    assert db.execute("DELETE FROM sales WHERE quantity > 4").count == 2
    assert rows(db, "select id from sales") == [(1,), (3,), (5,)]
    db.execute("INSERT INTO sales VALUES (2,'Again',1.0,1)")
    assert len(rows(db, "select id from sales")) == 4
    assert db.execute("UPDATE sales SET id = id + 10 WHERE id < 3").count == 2
    assert rows(db, "select id from sales") == [(11,), (12,), (3,), (5,)]
    with pytest.raises(ConstraintError):
        db.execute("UPDATE sales SET price = 3")
    with pytest.raises(ConstraintError):
        db.execute("UPDATE sales SET id = 3 WHERE id = 5")


def test_time_travel(db):
    db.execute("CREATE TABLE employees (id INT PRIMARY KEY, firstname TEXT, lastname TEXT, email TEXT UNIQUE)")
    assert db.status()["version"] == 2
    db.execute("INSERT INTO employees VALUES (3,'Alice','Brown','alice@example.com'),(4,'Bob','Johnson',NULL),(5,'Charlie','Lee','charlie.lee@example.com')")
    assert db.status()["version"] == 3
    db.execute("DELETE FROM employees WHERE id = 4")
    for version, n in ((2, 0), (3, 3), (4, 2)):
        db.execute(f"START TRANSACTION READ ONLY {version}")
        assert len(rows(db, "select * from employees")) == n
        db.execute("COMMIT")
    with pytest.raises(SqlError):
        db.execute("START TRANSACTION READ WRITE 3")
    with pytest.raises(TransactionError):
        db.execute("START TRANSACTION READ ONLY 99")


def test_transactions(db, spark):
    db.execute(SALES)
    other = Session(spark, db.store.files.root)
    db.execute("START TRANSACTION; UPDATE sales SET quantity = 0 WHERE id = 1; INSERT INTO sales VALUES (6,'Mouse',9.5,1)")
    assert len(rows(db, "select * from sales")) == 6 and len(rows(other, "select * from sales")) == 5
    other.execute("UPDATE sales SET quantity = 7 WHERE id = 2")
    assert rows(db, "select quantity from sales where id = 2") == [(5,)]  # isolated
    db.execute("COMMIT")  # other keys: no conflict
    assert rows(other, "select quantity from sales where id < 3") == [(0,), (7,)]
    db.execute("START TRANSACTION; UPDATE sales SET quantity = 1 WHERE id = 3")
    other.execute("DELETE FROM sales WHERE id = 3")
    with pytest.raises(TransactionError, match="Serialization"):
        db.execute("COMMIT")
    assert rows(db, "select id from sales where id = 3") == []
    db.execute("START TRANSACTION; DELETE FROM sales WHERE id > 0")
    assert rows(db, "select * from sales") == []
    db.execute("ROLLBACK")
    assert len(rows(db, "select * from sales")) == 5
    with pytest.raises(TransactionError):
        db.execute("COMMIT")
    db.execute("BEGIN")
    with pytest.raises(TransactionError):
        db.execute("DELETE FROM sales WHERE id = 1")
    with pytest.raises(TransactionError):
        db.execute("BEGIN")
    db.execute("ROLLBACK")


def test_compaction_keeps_rows_and_versions(db):
    db.execute(SALES)
    for k in range(4):
        db.execute(f"UPDATE sales SET quantity = {k} WHERE id = 1")
    now, v = rows(db, "select * from sales"), db.status()["version"]
    assert db.store.compact(least=3) == ["sales"] and db.store.compact(least=3) == []
    assert rows(db, "select * from sales") == now
    db.execute(f"START TRANSACTION READ ONLY {v - 1}")
    assert rows(db, "select quantity from sales where id = 1") == [(2,)]
    db.execute("ROLLBACK")
    db.execute("DROP TABLE sales; CREATE TABLE sales (id INT PRIMARY KEY, product_name TEXT, price DOUBLE, quantity INT)")
    assert rows(db, "select * from sales") == []


def test_explain_and_shell(db):
    repl = Repl(db)
    assert repl.line("CREATE TABLE t (id INT PRIMARY KEY, x FLOAT,") is None
    assert repl.line("b BOOL);") == "t"
    assert repl.line("INSERT INTO t VALUES (1, 2.5, TRUE), (2, NULL, FALSE);") == "insert: 2 rows"
    assert repl.line("SELECT * FROM t ORDER BY id;") == "id|x|b\n1|2.5000|TRUE\n2|NULL|FALSE"
    assert repl.line("!headers") == "headers off" and repl.line("!tables") == "t" and "PRIMARY KEY" in repl.line("!table t")
    assert "version: 3" in repl.line("!status") and "statements" in repl.line("!help")
    assert repl.line("SELECT nope FROM t;").startswith("error:")
    plan = repl.line("EXPLAIN SELECT x FROM t WHERE id = 1;")
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,1)]" in plan and rows(db, "select count(*) from t") == [(2,)]
