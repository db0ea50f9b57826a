"""Relational operators over DataFrames. Each is a thin declaration; Catalyst picks the physical plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def nothing(spark: SparkSession) -> DataFrame:
    """One row without columns: FROM-less SELECT."""
    return spark.range(1).select()


def scan(spark: SparkSession, path: str, predicate: Column | None = None) -> DataFrame:
    """A Parquet table; the predicate reaches the file scan."""
    df = spark.read.parquet(path)
    return df if predicate is None else df.where(predicate)


def key_lookup(df: DataFrame, key: str, values: list) -> DataFrame:
    """Rows whose key is one of the values, once each; a missing key gives no row."""
    return df.where(F.col(key).isin(list(dict.fromkeys(v for v in values if v is not None)))) if any(v is not None for v in values) else df.limit(0)


def index_lookup(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column has one of the values; None finds NULLs."""
    tests = [F.col(column).isin([v for v in values if v is not None])] * any(v is not None for v in values)
    tests += [F.col(column).isNull()] * any(v is None for v in values)
    return df.where(reduce(lambda a, b: a | b, tests)) if tests else df.limit(0)


def index_scan(df: DataFrame, column: str, key: str) -> DataFrame:
    """column, keys: what an index over the column would list. A hot value's keys are one array; use counts at scale."""
    return df.groupBy(column).agg(F.sort_array(F.collect_set(key)).alias("keys"))


def cross_join(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.crossJoin(b)


def join(a: DataFrame, b: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """inner, left or right; on may be any predicate."""
    if how not in ("inner", "left", "right"):
        raise ValueError(how)
    return a.join(b, on, how)


def null_safe_join(a: DataFrame, b: DataFrame, left: Column, right: Column, how: str = "inner") -> DataFrame:
    """NULL keys match each other."""
    return a.join(b, left.eqNullSafe(right), how)


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    """GROUP BY without aggregates."""
    return df.select(*columns).distinct()


def top(df: DataFrame, order: list[Column], limit: int | None = None, offset: int | None = None) -> DataFrame:
    """ORDER BY, then OFFSET, then LIMIT; NULLs are least. With a limit Spark keeps only the first rows of each task."""
    df = df.orderBy(*order) if order else df
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)
