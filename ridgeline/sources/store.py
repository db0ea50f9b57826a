"""A versioned Parquet store on any file system that Hadoop knows.

    _catalog/N.json   the table definitions after the N-th change (definitions are not versioned with the data)
    _begin/V          one empty file for each read-write transaction begun; V is its version
    _end/V            one for each that was committed or rolled back
    _sums/S.json      all commits up to the S-th in one file, so that a reader opens a few files and not all of the log
    _log/S.json       the S-th commit: {"version": V, "tables": {name: [{"path", "kind"}]}}
    data/...          Parquet deltas: a table's columns, _version, _seq and _deleted

A commit is the exclusive creation of one file, so several tables change at once or not at all; what a lost writer leaves
is named by no commit. A snapshot is a set of commits. Reading takes each key's newest row and leaves deleted ones out: rows
whose keys no change names are read as they lie, filters and columns reaching their scan, and only the others are grouped.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.sources.schema import TableDef

#: Every so many commits are summed up in one file.
SUM_EVERY = 32

HIDDEN = [T.StructField("_version", T.LongType()), T.StructField("_seq", T.IntegerType()), T.StructField("_deleted", T.BooleanType())]


class Files:
    """The few file operations that the store needs, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def create(self, name: str, text: str = "") -> bool:
        """Whether this call made the file; an existing one stays as it is."""
        path = self._path(name)
        self.fs.mkdirs(path.getParent())
        if self.fs.getScheme() == "file":  # Hadoop's local file system doesn't create exclusively
            try:
                with open(path.toUri().getPath(), "x") as f:
                    f.write(text)
                return True
            except FileExistsError:
                return False
        try:
            out = self.fs.create(path, False)
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read_json(self, name: str, wait: float = 5.0) -> dict | None:
        """None for a file whose writer was lost before it was whole; one that is just being written is waited for."""
        for _ in range(50):
            try:
                return json.loads(self.read(name))
            except ValueError:
                time.sleep(wait / 50)
        return None

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self._path(folder)):
            return []
        return sorted(x for f in self.fs.listStatus(self._path(folder)) if not (x := f.getPath().getName()).startswith("."))

    def size(self, folder: str = "data") -> int:
        return self.fs.getContentSummary(self._path(folder)).getLength() if self.fs.exists(self._path(folder)) else 0

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self._commits: dict[str, dict] = {}
        self._summed: set[str] = set()

    # definitions
    def tables(self) -> dict[str, TableDef]:
        data = next((d for n in reversed(self.files.names("_catalog")) if (d := self.files.read_json(f"_catalog/{n}"))), {"tables": []})
        return {d["name"]: TableDef.from_json(d) for d in data["tables"]}

    def define(self, change) -> None:
        """Applies change(tables) and publishes the outcome; tried again if another writer was first."""
        while True:
            n, tables = len(self.files.names("_catalog")), self.tables()
            change(tables)
            if self.files.create(f"_catalog/{n:020d}.json", json.dumps({"tables": [d.to_json() for d in tables.values()]})):
                return

    # versions
    def next_version(self) -> int:
        return 1 + max((int(n) for n in self.files.names("_begin")), default=0)

    def begin(self) -> int:
        """A version for a read-write transaction: each begin uses one up."""
        while True:
            if self.files.create(f"_begin/{(v := self.next_version()):020d}"):
                return v

    def snapshot(self, before: int | None = None) -> list[str]:
        """Names of the commits so far; of those with a version below `before`."""
        return [n for n in self.files.names("_log") if before is None or self.commit_of(n)["version"] < before]

    def commit_of(self, name: str) -> dict:
        if name not in self._commits:
            for n in [n for n in self.files.names("_sums") if n not in self._summed][-1:]:
                self._commits |= self.files.read_json(f"_sums/{n}") or {}
                self._summed.add(n)
        if name not in self._commits:
            self._commits[name] = self.files.read_json(f"_log/{name}") or {"version": 0, "tables": {}}
        return self._commits[name]

    def append(self, number: int, version: int, tables: dict[str, list[dict]]) -> bool:
        """Whether this made the number-th commit; False if another one is there already."""
        done = self.files.create(f"_log/{number:020d}.json", json.dumps({"version": version, "tables": tables}))
        if done and number % SUM_EVERY == SUM_EVERY - 1:
            self.files.create(f"_sums/{number:020d}.json", json.dumps({n: self.commit_of(n) for n in self.snapshot()[: number + 1]}))
        return done

    def end(self, version: int | None) -> None:
        if version is not None:
            self.files.create(f"_end/{version:020d}")

    def active(self) -> list[int]:
        """Versions of read-write transactions that were begun and neither committed nor rolled back, lost ones included."""
        return sorted({int(n) for n in self.files.names("_begin")} - {int(n) for n in self.files.names("_end")})

    def garbage(self) -> float:
        """The share of data bytes that the newest snapshot doesn't need: deltas that a later base replaces, and rows that a
        change replaces, counted as the bytes of the changes."""
        snapshot, total, gone = self.snapshot(), 0, 0
        for name in {t for n in snapshot for t in self.commit_of(n)["tables"]}:
            every, live = self.deltas(name, snapshot), self.live(name, snapshot)
            total += sum(d.get("bytes", 0) for d in every)
            gone += sum(d.get("bytes", 0) for d in every) - sum(d.get("bytes", 0) for d in live if d["kind"] == "insert")
        return gone / total if total else 0.0

    # rows
    def deltas(self, table: str, snapshot: list[str]) -> list[dict]:
        return [d for n in snapshot for d in self.commit_of(n)["tables"].get(table, [])]

    def write(self, table: TableDef, rows: DataFrame, version: int, seq: int, kind: str) -> dict:
        """Writes a delta (rows have the table's columns and _deleted) that no commit names yet."""
        path = f"data/{table.name}/{version:012d}-{seq:05d}-{uuid.uuid4().hex[:8]}"
        rows.select(*(F.col(f"`{c.name}`") for c in table.columns), F.lit(version).cast("bigint").alias("_version"), F.lit(seq).alias("_seq"), "_deleted").write.parquet(f"{self.files.root}/{path}")
        return {"path": path, "kind": kind, "bytes": self.files.size(path)}

    def delta(self, table: TableDef, deltas: list[dict]) -> DataFrame:
        """All rows of deltas, hidden columns included."""
        kind = T.StructType([*table.struct().fields, *HIDDEN])
        if not deltas:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(f"{self.files.root}/{d['path']}" for d in deltas))

    def rows(self, table: TableDef, deltas: list[dict]) -> DataFrame:
        """The table as the deltas make it: newest row of each key, without the deleted."""
        df, names = self.delta(table, deltas), [c.name for c in table.columns]
        if all(d["kind"] == "insert" for d in deltas):
            return df.select(*names)
        key = table.key.name
        changed = self.delta(table, [d for d in deltas if d["kind"] != "insert"]).select(F.col(key).alias("_there")).distinct()
        touched = F.col(key) == F.col("_there")
        still = self.delta(table, [d for d in deltas if d["kind"] == "insert"]).join(changed, touched, "left_anti").select(*names)
        newest = df.join(changed, touched, "left_semi").groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct("_version", "_seq")).alias("_row"))
        return still.unionByName(newest.where("not _row._deleted").select(*(F.col(f"_row.`{n}`").alias(n) for n in names)))

    def compact(self, least: int = 8, ratio: float | None = None) -> list[str]:
        """Rewrites as one each table of at least `least` deltas or, with ratio, whose changes have at least that share of
        its bytes; as a new commit that takes no version of its own. Versions before it can still be read: their deltas
        stay named by their own commits. Its rows count as older than any commit after it, so a transaction that was open
        meanwhile still wins."""
        done = []
        while True:
            snapshot = self.snapshot()
            heavy = [d for d in self.tables().values() if self._heavy(self.live(d.name, snapshot), least, ratio)]
            if not heavy:
                return done
            version, changed = max((self.commit_of(n)["version"] for n in snapshot), default=0), {}
            for d in heavy:
                whole = self.rows(d, self.live(d.name, snapshot)).withColumn("_deleted", F.lit(False))
                changed[d.name] = [self.write(d, whole, 0, 0, "base")]
            if self.append(len(snapshot), version, changed):  # else a commit came between, and this one would hide it
                done += [d.name for d in heavy]
            else:
                for deltas in changed.values():
                    self.files.delete(deltas[0]["path"])

    @staticmethod
    def _heavy(live: list[dict], least: int, ratio: float | None) -> bool:
        if ratio is None:
            return len(live) >= least
        changes, every = (sum(d.get("bytes", 0) for d in x) for x in ([d for d in live if d["kind"] == "change"], live))
        return changes > 0 and changes >= ratio * every

    def live(self, table: str, snapshot: list[str]) -> list[dict]:
        """The deltas that a snapshot reads: from the last base on. After a base everything counts as inserts until a
        change of another kind."""
        found = self.deltas(table, snapshot)
        base = max((k for k, d in enumerate(found) if d["kind"] == "base"), default=0)
        return [d | {"kind": "insert"} if d["kind"] == "base" else d for d in found[base:]]
