"""Constraints on changed rows, as joins that must come out empty. Nothing is collected but one offending value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.sources.schema import TableDef


class ConstraintError(ValueError):
    """A row that a table's constraints don't allow."""


def _refuse(rows: DataFrame, said: str) -> None:
    found = rows.limit(1).collect()
    if found:
        raise ConstraintError(said.format(found[0][0]))


def not_null(table: TableDef, rows: DataFrame) -> None:
    for c in table.columns:
        if not c.nullable:
            _refuse(rows.where(F.col(c.name).isNull()).select(F.lit(c.name)), "{} can't be NULL")


def unique(table: TableDef, rows: DataFrame, others: DataFrame) -> None:
    """rows: new rows; others: rows that stay beside them. NULL counts as a value."""
    for c in table.columns:
        if c.unique:
            _refuse(rows.groupBy(c.name).count().where("count > 1").select(c.name), f"{c.name} {{}} stands twice")
            there = others.select(F.col(c.name).alias("_there"))
            _refuse(rows.join(there, F.col(c.name).eqNullSafe(F.col("_there")), "left_semi").select(c.name), f"{c.name} {{}} is there already")


def references(table: TableDef, rows: DataFrame, read, changed: set[str] | None = None) -> None:
    """Every value of a referring column is there in the column it refers to; `read` gives a table's rows by name. A row
    may refer to rows of its own statement."""
    for c in table.columns:
        if c.references and (changed is None or c.name in changed):
            target = read(c.references[0]).select(F.col(c.references[1]).alias("_there"))
            if c.references[0] == table.name:
                target = target.unionByName(rows.select(F.col(c.references[1]).alias("_there")))
            _refuse(rows.join(target, F.col(c.name) == F.col("_there"), "left_anti").select(c.name), f"{c.name} {{}} refers to no row of {c.references[0]}")


def unreferenced(table: TableDef, gone: DataFrame, tables: dict[str, TableDef], read) -> None:
    """No row that stays refers to a value of `gone` (rows of table, before the change)."""
    for other in tables.values():
        for c in other.columns:
            if c.references and c.references[0] == table.name:
                lost = gone.select(F.col(c.references[1]).alias("_lost")).where(F.col("_lost").isNotNull())
                rows = read(other.name)
                if other.name == table.name:
                    rows = rows.join(gone.select(F.col(table.key.name).alias("_key")), F.col(table.key.name) == F.col("_key"), "left_anti")
                _refuse(rows.join(lost, F.col(c.name) == F.col("_lost"), "left_semi").select(c.name), f"{other.name}.{c.name} refers to {{}}")
