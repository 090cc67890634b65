"""Relational operators as thin, declarative DataFrame functions; Catalyst picks the physical plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, *exprs: Column | str) -> DataFrame:
    """Evaluate expressions per row; duplicate rows stay."""
    return df.select(*exprs)


def filter_rows(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows for which the condition is true; null counts as false."""
    return df.where(condition)


def join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], residual: Column | None = None) -> DataFrame:
    """Inner equi-join with SQL equality (null keys match nothing) and an optional residual predicate."""
    if not keys:
        raise ValueError("an equi-join needs at least one key pair")
    condition = None
    for a, b in keys:
        term = left[a] == right[b]
        condition = term if condition is None else condition & term
    return left.join(right, condition if residual is None else condition & residual, "inner")


def aggregate(df: DataFrame, keys: Sequence[Column | str], aggs: Sequence[Column]) -> DataFrame:
    """Hash aggregate. Without keys: one row, over empty input too. Without aggregates: the distinct keys."""
    if not aggs:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def sort(df: DataFrame, order: Sequence[tuple[str, bool]], offset: int = 0, fetch: int | None = None) -> DataFrame:
    """ORDER BY with OFFSET and FETCH by the SQL standard. order: (column, ascending); nulls are largest."""
    columns = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_first() for c, up in order]
    out = df.orderBy(*columns) if columns else df
    out = out.offset(offset) if offset else out
    return out if fetch is None else out.limit(fetch)


def select_vector(df: DataFrame, condition: Column) -> DataFrame:
    """The marking form of a filter: an `_active` column is added or narrowed instead of dropping rows."""
    keep = F.coalesce(condition, F.lit(False))
    return df.withColumn("_active", F.col("_active") & keep if "_active" in df.columns else keep)


def compact(df: DataFrame) -> DataFrame:
    """Drop what select_vector marked inactive."""
    return df.where("_active").drop("_active")
