"""Lowering: statements to DataFrames, expressions to Columns with their types.

Types are known before a Column is chosen, because `/`, `%` and AVG depend on them. Names resolve against a scope of
(table alias, column); every column of a source gets a name of its own, so self-joins and equal names can't mix."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline import functions as R
from ridgeline import operators as op
from ridgeline.dialect import tree as t
from ridgeline.dialect.tokens import SqlError

NUMBERS = (*R.INTEGERS, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: T.DataType


@dataclass
class Field:
    table: str | None
    name: str
    column: str  # its name in the DataFrame
    kind: T.DataType


def literal(value) -> Typed:
    kind = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}.get(type(value), T.NullType())
    return Typed(F.lit(value).cast(kind) if value is not None else F.lit(None), kind)


def number(x: Typed, sign: str) -> None:
    if not isinstance(x.kind, (*NUMBERS, T.NullType)):
        raise SqlError(f"{sign} needs numbers, not {x.kind.simpleString()}")


class Expressions:
    """Lowers expressions over fields; `given` maps whole expressions to columns that already hold them."""

    def __init__(self, fields: list[Field], given: dict | None = None):
        self.fields, self.given = fields, given or {}

    def find(self, n: t.Name) -> Field:
        found = [f for f in self.fields if f.name.lower() == n.column and (n.table is None or (f.table or "").lower() == n.table)]
        if len(found) != 1:
            raise SqlError(f"{'ambiguous' if found else 'unknown'} column {n.table + '.' if n.table else ''}{n.column}")
        return found[0]

    def __call__(self, e) -> Typed:
        if e in self.given:
            return self.given[e]
        match e:
            case t.Literal(value):
                return literal(value)
            case t.Name():
                f = self.find(e)
                return Typed(F.col(f"`{f.column}`"), f.kind)
            case t.Unary(how, of):
                return self.unary(how, self(of))
            case t.Binary(how, left, right):
                return self.binary(how, self(left), self(right))
            case t.Aggregate():
                raise SqlError("an aggregate may not stand here")
        raise SqlError(f"not an expression: {e}")

    def unary(self, how: str, x: Typed) -> Typed:
        boolean = T.BooleanType()
        match how:
            case "isnull":
                return Typed(x.column.isNull(), boolean)
            case "not":
                return Typed(~x.column.cast(boolean), boolean)
            case "fact":
                number(x, "!")
                return Typed(R.factorial(x.column), T.LongType())
        number(x, how)
        return Typed(-x.column if how == "neg" else x.column, x.kind)

    def binary(self, how: str, a: Typed, b: Typed) -> Typed:
        boolean, x, y = T.BooleanType(), a.column, b.column
        if how in ("and", "or"):
            for z in (a, b):
                if not isinstance(z.kind, (T.BooleanType, T.NullType)):
                    raise SqlError(f"{how.upper()} needs conditions, not {z.kind.simpleString()}")
            x, y = x.cast(boolean), y.cast(boolean)
            return Typed(x & y if how == "and" else x | y, boolean)
        if how == "like":
            if not isinstance(a.kind, (T.StringType, T.NullType)):
                raise SqlError("LIKE needs a text")
            return Typed(F.like(x.cast("string"), y), boolean)
        if how in ("=", "!=", "<", ">", "<=", ">="):
            alike = isinstance(a.kind, NUMBERS) and isinstance(b.kind, NUMBERS) or type(a.kind) is type(b.kind) or T.NullType in (type(a.kind), type(b.kind))
            if not alike:
                raise SqlError(f"{a.kind.simpleString()} and {b.kind.simpleString()} don't compare")
            return Typed({"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[how], boolean)
        number(a, how)
        number(b, how)
        whole = all(R.is_integer(z.kind) or isinstance(z.kind, T.NullType) for z in (a, b))
        kind = T.LongType() if whole else T.DoubleType()
        x, y = x.cast(kind), y.cast(kind)
        match how:
            case "^":
                return Typed(R.power(x, y), T.DoubleType())
            case "%":
                if not whole:
                    raise SqlError("% needs integers")
                return Typed(R.modulo(x, y), kind)
            case "/":
                return Typed(R.divide(x, y, kind, kind), kind)
        return Typed({"+": x + y, "-": x - y, "*": x * y}[how], kind)


def aggregates_in(e) -> list[t.Aggregate]:
    match e:
        case t.Aggregate():
            return [e]
        case t.Unary(_, of):
            return aggregates_in(of)
        case t.Binary(_, a, b):
            return aggregates_in(a) + aggregates_in(b)
    return []


def _aggregate(a: t.Aggregate, lower: Expressions) -> Typed:
    if aggregates_in(a.of):
        raise SqlError("aggregates don't nest")
    x = lower(a.of)
    match a.op:
        case "count":
            return Typed(F.count(x.column), T.LongType())
        case "sum":
            number(x, "SUM")
            return Typed(F.sum(x.column), T.LongType() if R.is_integer(x.kind) else T.DoubleType())
        case "avg":
            number(x, "AVG")
            return Typed(R.average(x.column, x.kind), T.LongType() if R.is_integer(x.kind) else T.DoubleType())
    return Typed({"min": F.min, "max": F.max}[a.op](x.column), x.kind)


def constant(e, spark: SparkSession):
    """The value of an expression without columns."""
    if isinstance(e, t.Literal):
        return e.value
    return op.nothing(spark).select(Expressions([])(e).column.alias("v")).first().v


def constant_type(e) -> T.DataType:
    return Expressions([])(e).kind


class Selects:
    """Lowers SELECTs; `read` gives a table's DataFrame by name."""

    def __init__(self, spark: SparkSession, read: Callable[[str], DataFrame]):
        self.spark, self.read = spark, read

    def source(self, s, taken: list[str]) -> tuple[DataFrame, list[Field]]:
        if isinstance(s, t.Source):
            alias = s.alias or s.table
            if alias in taken:
                raise SqlError(f"table {alias} stands twice; name one of them AS something")
            taken.append(alias)
            df, k = self.read(s.table), len(taken)
            fields = [Field(alias, f.name, f"{k}.{f.name}", f.dataType) for f in df.schema.fields]
            return df.select(*(F.col(f"`{f.name}`").alias(f.column) for f in fields)), fields
        (left, a), (right, b) = self.source(s.left, taken), self.source(s.right, taken)
        fields = a + b
        if s.how == "cross":
            return op.cross_join(left, right), fields
        return op.join(left, right, Expressions(fields)(s.on).column.cast("boolean"), s.how), fields

    def __call__(self, s: t.Select) -> DataFrame:
        df, fields = (op.nothing(self.spark), []) if s.source is None else self.source(s.source, [])
        lower = Expressions(fields)
        if s.where is not None:
            df = df.where(lower(s.where).column.cast("boolean"))  # keeps rows that are TRUE
        items = self.expanded(s.items, fields)
        aliases = {i.alias.lower(): i.expr for i in items if i.alias}
        in_alias = lambda e: aliases.get(e.column, e) if isinstance(e, t.Name) and e.table is None and not any(f.name.lower() == e.column for f in fields) else self.through(e, aliases, fields)
        having = None if s.having is None else in_alias(s.having)
        order = [(in_alias(e), desc) for e, desc in s.order]
        wanted = [*(i.expr for i in items), *([having] if having is not None else []), *(e for e, _ in order)]
        aggs = list(dict.fromkeys(a for e in wanted for a in aggregates_in(e)))
        if s.group or aggs:
            if any(isinstance(i.expr, t.Star) for i in s.items):
                raise SqlError("* doesn't go with groups")
            keys = [in_alias(g) for g in s.group]
            df, lower = self.grouped(df, lower, fields, keys, aggs)
        if having is not None:
            df = df.where(lower(having).column.cast("boolean"))
        columns = [(self.title(i), lower(i.expr).column) for i in items]
        names = [f"out.{k}" for k in range(len(columns))]
        hidden = [f"by.{k}" for k in range(len(order))]
        df = df.select(*(c.alias(n) for n, (_, c) in zip(names, columns, strict=True)), *(lower(e).column.alias(n) for n, (e, _) in zip(hidden, order, strict=True)))
        sort = [F.desc(f"`{n}`") if desc else F.asc(f"`{n}`") for n, (_, desc) in zip(hidden, order, strict=True)]
        df = op.top(df, sort, self.count(s.limit), self.count(s.offset))
        return df.select(*(F.col(f"`{n}`").alias(title) for n, (title, _) in zip(names, columns, strict=True)))

    def through(self, e, aliases: dict, fields: list[Field]):
        """e with select aliases in place of names that no table has."""
        match e:
            case t.Name(column, None) if column in aliases and not any(f.name.lower() == column for f in fields):
                return aliases[column]
            case t.Unary(how, of):
                return t.Unary(how, self.through(of, aliases, fields))
            case t.Binary(how, a, b):
                return t.Binary(how, self.through(a, aliases, fields), self.through(b, aliases, fields))
        return e

    def grouped(self, df, lower, fields, keys, aggs):
        typed = [(k, lower(k)) for k in keys]
        found = [(a, _aggregate(a, lower)) for a in aggs]
        group = [x.column.alias(f"key.{n}") for n, (_, x) in enumerate(typed)]
        totals = [x.column.alias(f"agg.{n}") for n, (_, x) in enumerate(found)]
        out = df.groupBy(*group).agg(*totals) if totals else df.select(*group).distinct()
        given = {k: Typed(F.col(f"`key.{n}`"), x.kind) for n, (k, x) in enumerate(typed)} | {a: Typed(F.col(f"`agg.{n}`"), x.kind) for n, (a, x) in enumerate(found)}
        kept = []
        for n, (k, x) in enumerate(typed):
            if isinstance(k, t.Name):  # t.c and c are one key
                f = lower.find(k)
                kept.append(Field(f.table, f.name, f"key.{n}", x.kind))
        return out, Expressions(kept, given)

    def expanded(self, items: list[t.Item], fields: list[Field]) -> list[t.Item]:
        out = []
        for i in items:
            if not isinstance(i.expr, t.Star):
                out.append(i)
                continue
            found = [f for f in fields if i.expr.table in (None, (f.table or "").lower())]
            if not found:
                raise SqlError("nothing for * to name")
            out += [t.Item(t.Name(f.name.lower(), f.table.lower()), f.name) for f in found]
        return out

    @staticmethod
    def title(i: t.Item) -> str:
        match i.alias, i.expr:
            case str(alias), _:
                return alias
            case _, t.Name(column, _):
                return column
            case _, t.Aggregate(how, t.Name(column, _)):
                return f"{'average' if how == 'avg' else how}({column})"
            case _, t.Aggregate(how, _):
                return f"{'average' if how == 'avg' else how}()"
        return ""

    def count(self, e) -> int | None:
        if e is None:
            return None
        n = constant(e, self.spark)
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise SqlError("LIMIT and OFFSET take whole numbers of at least 0")
        return n
