"""Table definitions: columns with their constraints, as a StructType, as JSON and as DDL text."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import types as T

from ridgeline.dialect import tree as t
from ridgeline.dialect.lower import constant, constant_type
from ridgeline.dialect.tokens import SqlError

KINDS = {"bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}
SQL_NAMES = {"bigint": "INT", "double": "FLOAT", "string": "TEXT", "boolean": "BOOL"}
PYTHON = {"bigint": int, "double": float, "string": str, "boolean": bool}


#: Names that the store and the constraints use for columns of their own.
RESERVED = {"_version", "_seq", "_deleted", "_key", "_row", "_there", "_lost", "_kept"}


@dataclass
class ColumnDef:
    name: str
    kind: str
    primary: bool = False
    unique: bool = False
    index: bool = False
    nullable: bool = True
    has_default: bool = False
    default: object = None
    references: tuple[str, str] | None = None

    def accepts(self, value) -> bool:
        """Strict types: no number becomes another kind of number."""
        return self.nullable if value is None else type(value) is PYTHON[self.kind]


@dataclass
class TableDef:
    name: str
    columns: list[ColumnDef]

    @property
    def key(self) -> ColumnDef:
        return next(c for c in self.columns if c.primary)

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name == name:
                return c
        raise SqlError(f"table {self.name} has no column {name}")

    def struct(self, nullable: bool = True) -> T.StructType:
        return T.StructType([T.StructField(c.name, KINDS[c.kind], nullable or c.nullable) for c in self.columns])

    def to_json(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_json(data: dict) -> TableDef:
        return TableDef(data["name"], [ColumnDef(**(c | {"references": tuple(c["references"]) if c["references"] else None})) for c in data["columns"]])

    def ddl(self) -> str:
        """The CREATE TABLE text that makes this table."""
        lines = []
        for c in self.columns:
            line = f"  {c.name} {SQL_NAMES[c.kind]}"
            line += " PRIMARY KEY" if c.primary else " NOT NULL" if not c.nullable else " NULL"
            line += " UNIQUE" if c.unique and not c.primary else ""
            if c.has_default:
                line += f" DEFAULT {_literal(c.default)}"
            lines.append(line)
        lines += [f"  KEY ({c.name})" for c in self.columns if c.index and not c.unique]
        lines += [f"  FOREIGN KEY ({c.name}) REFERENCES {c.references[0]} ({c.references[1]})" for c in self.columns if c.references]
        return f"CREATE TABLE {self.name} (\n" + ",\n".join(lines) + "\n)"


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return str(value).upper() if isinstance(value, bool) else "'" + value.replace("\\", "\\\\").replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def define(statement: t.CreateTable, tables: dict[str, TableDef], spark) -> TableDef:
    """Checks a CREATE TABLE against the tables there are."""
    columns = []
    for c in statement.columns:
        if c.name.lower() in RESERVED:
            raise SqlError(f"column name {c.name} is reserved")
        if c.primary and c.nullable:
            raise SqlError(f"primary key {c.name} can't be NULL")
        nullable = not c.primary and c.nullable is not False
        d = ColumnDef(c.name, c.kind, c.primary, c.unique or c.primary, c.index or c.unique or c.primary, nullable, references=c.references)
        if c.default is not None:
            d.has_default, d.default = True, constant(c.default, spark)
            if d.default is None and not nullable or d.default is not None and constant_type(c.default) != KINDS[c.kind]:
                raise SqlError(f"the default of {c.name} has another type")
        elif nullable:
            d.has_default = True
        columns.append(d)
    table = TableDef(statement.name, columns)
    if sum(c.primary for c in columns) != 1:
        raise SqlError("a table has one primary key column")
    for c in columns:
        if c.references:
            other = table if c.references[0] == table.name else tables.get(c.references[0])
            if other is None:
                raise SqlError(f"no table {c.references[0]}")
            target = other.column(c.references[1])
            if not (target.primary or target.index) or target.kind != c.kind:
                raise SqlError(f"{c.name} can't refer to {other.name}.{target.name}: it needs a key of the same type")
    return table
