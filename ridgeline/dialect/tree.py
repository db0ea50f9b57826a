"""Statements and expressions as data."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Name:
    column: str
    table: str | None = None


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Unary:
    op: str  # neg, pos, not, fact, isnull
    of: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Aggregate:
    op: str  # count, sum, min, max, avg
    of: object


@dataclass(frozen=True)
class Item:
    expr: object
    alias: str | None


@dataclass(frozen=True)
class Source:
    table: str
    alias: str | None


@dataclass(frozen=True)
class Join:
    left: object
    right: object
    how: str  # cross, inner, left, right
    on: object | None


@dataclass
class Select:
    items: list[Item]
    source: object | None = None
    where: object | None = None
    group: list = field(default_factory=list)
    having: object | None = None
    order: list[tuple[object, bool]] = field(default_factory=list)  # (expression, descending)
    limit: object | None = None
    offset: object | None = None


@dataclass
class Column:
    name: str
    kind: str  # bigint, double, string, boolean
    primary: bool = False
    unique: bool = False
    index: bool = False
    nullable: bool | None = None
    default: object | None = None  # an expression
    references: tuple[str, str] | None = None


@dataclass
class CreateTable:
    name: str
    columns: list[Column]


@dataclass
class DropTable:
    name: str


@dataclass
class Insert:
    table: str
    columns: list[str] | None
    rows: list[list]


@dataclass
class Update:
    table: str
    sets: list[tuple[str, object]]
    where: object | None


@dataclass
class Delete:
    table: str
    where: object


@dataclass
class Begin:
    read_only: bool
    version: int | None = None


@dataclass
class Commit:
    pass


@dataclass
class Rollback:
    pass


@dataclass
class Explain:
    statement: object
