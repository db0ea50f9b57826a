"""Scalar and aggregate functions whose meaning depends on operand types, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, INTEGERS)


def int_divide(a: Column, b: Column) -> Column:
    """Truncating integer division; NULL on a zero divisor."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def float_divide(a: Column, b: Column) -> Column:
    """Float division; NULL on a zero divisor."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign; NULL on a zero divisor."""
    return a % F.nullif(b, F.lit(0))


def power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double"))


def factorial(a: Column) -> Column:
    """n!, NULL outside 0 to 20."""
    return F.factorial(a.cast("int"))


def int_average(a: Column) -> Column:
    """Mean of integers as a truncated integer; NULLs don't count, NULL over none."""
    return F.call_function("div", F.sum(a), F.nullif(F.count(a), F.lit(0).cast("bigint")))


def average(a: Column, kind: T.DataType) -> Column:
    return int_average(a) if is_integer(kind) else F.avg(a)


def divide(a: Column, b: Column, kind_a: T.DataType, kind_b: T.DataType) -> Column:
    return int_divide(a, b) if is_integer(kind_a) and is_integer(kind_b) else float_divide(a, b)
