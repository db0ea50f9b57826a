"""Sessions: statements of the dialect over a versioned store, in implicit or explicit transactions.

A SELECT outside a transaction reads the newest snapshot; any other statement is a read-write transaction of its own.
BEGIN is read-only; START TRANSACTION is read-write unless it says READ ONLY, which may name a version and then sees the
commits of lower versions. Snapshots are isolated; two transactions that wrote the same key can't both commit, nor can one
that wrote a row beside one that removed what the row refers to. DDL takes effect at once and is not rolled back. Opening a
store compacts tables of which changes are a given share. Parquet files can be read beside it as tables that nothing changes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.dialect import tree as t
from ridgeline.dialect.lower import Expressions, Field, Selects, constant
from ridgeline.dialect.parser import parse
from ridgeline.dialect.tokens import SqlError
from ridgeline.sources import constraints
from ridgeline.sources.schema import KINDS, TableDef, define
from ridgeline.sources.store import Store


class TransactionError(RuntimeError):
    pass


@dataclass
class Result:
    kind: str  # select, insert, update, delete, create, drop, begin, commit, rollback, explain
    rows: DataFrame | None = None
    count: int = 0
    text: str = ""
    version: int | None = None


@dataclass
class Transaction:
    read_only: bool
    snapshot: list[str]
    version: int | None = None
    staged: dict[str, list[dict]] = field(default_factory=dict)
    seq: int = 0


class Session:
    def __init__(self, spark: SparkSession, root: str, external: dict[str, str] | None = None, compact_ratio: float | None = 0.2):
        """external: Parquet paths by table name; compact_ratio: None never compacts by itself."""
        self.spark, self.store, self.txn, self.external = spark, Store(spark, root), None, external or {}
        if compact_ratio is not None:
            self.store.compact(ratio=compact_ratio)

    def execute(self, sql: str) -> Result:
        """Runs all statements of the text and returns the last one's result."""
        done = [self.run(s) for s in parse(sql)]
        if not done:
            raise SqlError("no statement")
        return done[-1]

    def run(self, s) -> Result:
        match s:
            case t.Begin(read_only, version):
                return self.begin(read_only, version)
            case t.Commit():
                return self.finish(True)
            case t.Rollback():
                return self.finish(False)
            case t.Explain(inner):
                return Result("explain", text=self.explain(inner))
            case t.Select():
                return Result("select", rows=self.selects(self.txn or Transaction(True, self.store.snapshot()))(s))
        if self.txn and self.txn.read_only:
            raise TransactionError("a read-only transaction changes nothing")
        if isinstance(s, (t.CreateTable, t.DropTable)):
            if not self.txn:
                self.store.end(self.store.begin())
            return self.create(s) if isinstance(s, t.CreateTable) else self.drop(s)
        txn = self.txn or Transaction(False, self.store.snapshot(), self.store.begin())
        change = {t.Insert: self.insert, t.Update: self.update, t.Delete: self.delete}[type(s)]
        held = {k: list(v) for k, v in txn.staged.items()}
        try:
            out = change(txn, s)
        except Exception:
            txn.staged = held  # the statement leaves nothing, the transaction goes on
            if not self.txn:
                self.store.end(txn.version)
            raise
        if not self.txn:
            self.commit(txn)
        return out

    # transactions
    def begin(self, read_only: bool, version: int | None) -> Result:
        if self.txn:
            raise TransactionError("a transaction is open")
        if version is not None and not read_only:
            raise TransactionError("only a read-only transaction takes a version")
        if version is not None and version > self.store.next_version():
            raise TransactionError(f"version {version} is not there yet")
        snapshot = self.store.snapshot(version)
        self.txn = Transaction(read_only, snapshot, version if read_only else self.store.begin())
        return Result("begin", version=self.txn.version)

    def finish(self, keep: bool) -> Result:
        if not self.txn:
            raise TransactionError("no transaction is open")
        txn, self.txn = self.txn, None
        if keep:
            self.commit(txn)
        else:
            self.discard(txn)
            self.store.end(None if txn.read_only else txn.version)
        return Result("commit" if keep else "rollback", version=txn.version)

    def discard(self, txn: Transaction) -> None:
        for deltas in txn.staged.values():
            for d in deltas:
                self.store.files.delete(d["path"])

    def commit(self, txn: Transaction) -> None:
        try:
            self.publish(txn)
        finally:
            self.store.end(None if txn.read_only else txn.version)

    def publish(self, txn: Transaction) -> None:
        if not txn.staged:
            return
        seen = set(txn.snapshot)
        while True:
            number = len(self.store.files.names("_log"))
            since = [n for n in self.store.snapshot() if n not in seen]
            try:
                self.no_conflict(txn, since)
                self.no_dangling(txn, since)
            except Exception:
                self.discard(txn)
                raise
            if self.store.append(number, txn.version, txn.staged):
                return

    def no_conflict(self, txn: Transaction, since: list[str]) -> None:
        """No commit since the snapshot wrote a key, or gave a row a unique value, that this transaction wrote."""
        for name, deltas in txn.staged.items():
            theirs = [d for d in self.store.deltas(name, since) if d["kind"] != "base"]
            table = self.table(name)
            if theirs:
                mine, other = self.store.delta(table, deltas), self.store.delta(table, theirs)
                for c in table.columns:
                    if c.unique:
                        live = F.lit(True) if c.primary else ~F.col("_deleted")
                        there = other.where(live).select(F.col(c.name).alias("_there"))
                        if not mine.where(live).join(there, F.col(c.name).eqNullSafe(F.col("_there")), "left_semi").isEmpty():
                            raise TransactionError("Error Serialization")

    def no_dangling(self, txn: Transaction, since: list[str]) -> None:
        """No row that this transaction or a commit since the snapshot wrote refers to what the other removed."""
        theirs = {name for n in since for name, deltas in self.store.commit_of(n)["tables"].items() if any(d["kind"] != "base" for d in deltas)}
        if not theirs:
            return
        tables, now = self.store.tables(), self.store.snapshot()
        both = lambda name: self.store.rows(tables[name], self.store.live(name, now) + txn.staged.get(name, []))
        for table in tables.values():
            for c in table.columns:
                parent = c.references[0] if c.references else None
                if parent and (table.name in txn.staged and parent in theirs or parent in txn.staged and table.name in theirs):
                    deltas = [d for d in self.store.deltas(table.name, since) if d["kind"] != "base"] + txn.staged.get(table.name, [])
                    key = F.col(table.key.name) == F.col("_there")
                    written = both(table.name).join(self.store.delta(table, deltas).select(F.col(table.key.name).alias("_there")), key, "left_semi")
                    target = both(parent).select(F.col(c.references[1]).alias("_there"))
                    if not written.join(target, F.col(c.name) == F.col("_there"), "left_anti").isEmpty():
                        raise TransactionError("Error Serialization")

    # reading
    def table(self, name: str) -> TableDef:
        tables = self.store.tables()
        if name not in tables:
            raise SqlError(f"no table {name}")
        return tables[name]

    def read(self, txn: Transaction, name: str) -> DataFrame:
        if name in self.external and name not in self.store.tables():
            return self.spark.read.parquet(self.external[name])
        return self.store.rows(self.table(name), self.store.live(name, txn.snapshot) + txn.staged.get(name, []))

    def selects(self, txn: Transaction) -> Selects:
        return Selects(self.spark, lambda name: self.read(txn, name))

    def explain(self, s) -> str:
        """The optimised plan of a statement, which isn't run."""
        txn = self.txn or Transaction(True, self.store.snapshot())
        match s:
            case t.Select():
                return self.selects(txn)(s)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            case t.Update() | t.Delete():
                plan = self.matching(txn, self.table(s.table), s.where)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
                return f"{type(s).__name__} {s.table}\n{plan}"
            case t.Insert():
                table = self.table(s.table)
                return f"Insert {s.table}: {len(s.rows)} rows\n" + self.inserted(table, s)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return type(s).__name__

    # definitions
    def create(self, s: t.CreateTable) -> Result:
        def change(tables):
            if s.name in tables:
                raise SqlError(f"table {s.name} is there already")
            tables[s.name] = define(s, tables, self.spark)

        self.store.define(change)
        return Result("create", text=s.name)

    def drop(self, s: t.DropTable) -> Result:
        def change(tables):
            if s.name not in tables:
                raise SqlError(f"no table {s.name}")
            for other in tables.values():
                if other.name != s.name and any(c.references and c.references[0] == s.name for c in other.columns):
                    raise constraints.ConstraintError(f"{other.name} refers to {s.name}")
            del tables[s.name]

        table = self.table(s.name)
        gone = self.store.rows(table, self.store.live(s.name, self.store.snapshot()))
        self.store.define(change)
        if not gone.isEmpty():  # a later table of this name begins empty
            version = self.store.begin()
            rows = gone.withColumn("_deleted", F.lit(True))
            delta = self.store.write(table, rows.limit(0), version, 0, "base")
            while not self.store.append(len(self.store.files.names("_log")), version, {s.name: [delta]}):
                pass
            self.store.end(version)
        return Result("drop", text=s.name)

    # changes
    def stage(self, txn: Transaction, table: TableDef, rows: DataFrame, kind: str) -> dict:
        txn.seq += 1
        delta = self.store.write(table, rows, txn.version, txn.seq, kind)
        txn.staged.setdefault(table.name, []).append(delta)
        return delta

    def inserted(self, table: TableDef, s: t.Insert) -> DataFrame:
        """The rows that an INSERT names, with defaults, checked by type."""
        names = s.columns or [c.name for c in table.columns]
        for n in names:
            table.column(n)
        if len(set(names)) < len(names):
            raise SqlError("a column is named twice")
        rows = []
        for values in s.rows:
            if len(values) > len(names) or s.columns and len(values) < len(names):
                raise SqlError(f"{len(values)} values for {len(names)} columns")
            given = dict(zip(names, (constant(v, self.spark) for v in values), strict=False))
            row = []
            for c in table.columns:
                if c.name not in given and not c.has_default:
                    raise constraints.ConstraintError(f"{c.name} has no value and no default")
                v = given.get(c.name, c.default)
                if not c.accepts(v):
                    raise constraints.ConstraintError(f"{c.name} can't be {v!r}")
                row.append(v)
            rows.append(tuple(row))
        return self.spark.createDataFrame(rows, table.struct())

    def insert(self, txn: Transaction, s: t.Insert) -> Result:
        table = self.table(s.table)
        return self.add(txn, table, self.inserted(table, s))

    def add(self, txn: Transaction, table: TableDef, new: DataFrame) -> Result:
        constraints.not_null(table, new)
        constraints.unique(table, new, self.read(txn, table.name))
        constraints.references(table, new, lambda name: self.read(txn, name))
        delta = self.stage(txn, table, new.withColumn("_deleted", F.lit(False)), "insert")
        return Result("insert", count=self.store.delta(table, [delta]).count(), version=txn.version)

    def load(self, name: str, rows: DataFrame) -> Result:
        """Inserts the rows of a DataFrame, however many, under the table's constraints: a column is taken by its name and
        cast to the table's type, one that rows lacks has its default."""
        if self.txn and self.txn.read_only:
            raise TransactionError("a read-only transaction changes nothing")
        table, there = self.table(name), {c.lower(): c for c in rows.columns}
        for c in table.columns:
            if c.name not in there and not c.has_default:
                raise constraints.ConstraintError(f"{c.name} has no value and no default")
        new = rows.select(*((F.col(f"`{there[c.name]}`") if c.name in there else F.lit(c.default)).cast(KINDS[c.kind]).alias(c.name) for c in table.columns))
        txn = self.txn or Transaction(False, self.store.snapshot(), self.store.begin())
        try:
            out = self.add(txn, table, new)
        except Exception:
            if not self.txn:
                self.store.end(txn.version)
            raise
        if not self.txn:
            self.commit(txn)
        return out

    def matching(self, txn: Transaction, table: TableDef, where) -> DataFrame:
        rows = self.read(txn, table.name)
        return rows if where is None else rows.where(self.lower(table)(where).column.cast("boolean"))

    @staticmethod
    def lower(table: TableDef) -> Expressions:
        return Expressions([Field(table.name, c.name, c.name, KINDS[c.kind]) for c in table.columns])

    def update(self, txn: Transaction, s: t.Update) -> Result:
        """Assignments see earlier ones of their row. The changed rows are written once, and checked from there."""
        table = self.table(s.table)
        before, lower = self.matching(txn, table, s.where), self.lower(table)
        key, changed = table.key.name, {n for n, _ in s.sets}
        after = before.withColumn("_key", F.col(key))
        for name, e in s.sets:
            c, x = table.column(name), lower(e)
            if not (x.kind == KINDS[c.kind] or x.kind.typeName() == "void"):
                raise constraints.ConstraintError(f"{name} can't take {x.kind.simpleString()}")
            after = after.withColumn(name, x.column.cast(KINDS[c.kind]))
        path = f"{self.store.files.root}/data/{table.name}/work-{txn.version}-{txn.seq + 1}"
        try:
            after.write.mode("overwrite").parquet(path)
            after = self.spark.read.parquet(path)
            count = after.count()
            if count:
                new, stays = after.drop("_key"), self.read(txn, table.name).join(after.select("_key"), F.col(key) == F.col("_key"), "left_anti")
                constraints.not_null(table, new)
                constraints.unique(table, new, stays)
                constraints.references(table, new, lambda name: self.read(txn, name), changed)
                if any(c.name in changed for c in table.columns if c.unique or c.index):
                    old = self.read(txn, table.name).join(after.select("_key"), F.col(key) == F.col("_key"), "left_semi")
                    for c in table.columns:  # values that no row has any longer
                        if c.name in changed:
                            lost = old.join(new.select(F.col(c.name).alias("_kept")), F.col(c.name) == F.col("_kept"), "left_anti")
                            only = TableDef(table.name, [c, *([table.key] if not c.primary else [])])
                            tables = {n: TableDef(n, [x for x in d.columns if x.primary or x.references == (table.name, c.name)]) for n, d in self.store.tables().items()}
                            constraints.unreferenced(only, lost, tables, lambda name: self.read(txn, name))
                if key in changed:
                    moved = after.where(F.col("_key") != F.col(key))
                    self.stage(txn, table, self.tombstones(table, moved.select(F.col("_key").alias(key))), "change")
                self.stage(txn, table, new.withColumn("_deleted", F.lit(False)), "change")
        finally:
            self.store.files.delete(path.removeprefix(f"{self.store.files.root}/"))
        return Result("update", count=count, version=txn.version)

    @staticmethod
    def tombstones(table: TableDef, keys: DataFrame) -> DataFrame:
        return keys.select(*(F.col(c.name) if c.primary else F.lit(None).cast(KINDS[c.kind]).alias(c.name) for c in table.columns), F.lit(True).alias("_deleted"))

    def delete(self, txn: Transaction, s: t.Delete) -> Result:
        table = self.table(s.table)
        gone = self.matching(txn, table, s.where)
        constraints.unreferenced(table, gone, self.store.tables(), lambda name: self.read(txn, name))
        delta = self.stage(txn, table, self.tombstones(table, gone.select(table.key.name)), "change")
        return Result("delete", count=self.store.delta(table, [delta]).count(), version=txn.version)

    # administration
    def tables(self) -> list[str]:
        return sorted(self.store.tables())

    def describe(self, name: str) -> str:
        return self.table(name).ddl()

    def index(self, table: str, column: str) -> DataFrame:
        from ridgeline.operators import index_scan

        return index_scan(self.read(self.txn or Transaction(True, self.store.snapshot()), table), column, self.table(table).key.name)

    def status(self) -> dict:
        """The next version, commits, tables, bytes of data, the share of them that is garbage, read-write transactions that
        are open anywhere (or were lost), and this session's transaction's version."""
        return {"garbage": round(self.store.garbage(), 4), "active": len(self.store.active()), **{"version": self.store.next_version(), "commits": len(self.store.snapshot()), "tables": len(self.store.tables()), "bytes": self.store.files.size(), "transaction": self.txn.version if self.txn else None}}
