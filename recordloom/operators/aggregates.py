"""Counting and collecting operators; each pre-aggregates before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


def summary(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows and distinct keys of a table: ``(table_name, row_count, unique_keys)``."""
    return df.agg(F.count("*").alias("row_count"), F.countDistinct(key).alias("unique_keys")).select(
        F.lit(name).alias("table_name"), "row_count", "unique_keys"
    )


def count_by(df: DataFrame, column: str, k: int | None = None, skip_null: bool = True) -> DataFrame:
    """Rows per value, largest first; the first ``k`` when given (ties by value)."""
    if skip_null:
        df = df.where(F.col(column).isNotNull())
    counts = df.groupBy(column).agg(F.count("*").alias("row_count"))
    ordered = counts.orderBy(F.desc("row_count"), F.asc_nulls_first(column))
    return ordered if k is None else ordered.limit(k)


def share_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-NULL value with the percentage of all of them: ``(value, row_count, percentage)``.

    The total is a scalar subquery over the same aggregate, so no window gathers
    the groups in one task.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("row_count"))
    total = counts.agg(F.sum("row_count").alias("total")).scalar()
    return counts.select(
        F.col(column),
        F.col("row_count"),
        percentage(F.col("row_count"), total).alias("percentage"),
    )


def percentage(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` with two decimals; NULL when there is nothing to divide by."""
    return F.round(F.lit("100.0").cast("decimal(4,1)") * part / F.nullif(whole, F.lit(0).cast("bigint")), 2)


def date_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.min(column).alias("earliest"), F.max(column).alias("latest"), F.count("*").alias("row_count")
    )


def distinct_rows(df: DataFrame) -> DataFrame:
    """Whole-row dedup. Hashing all columns spreads the copies of a hot key that differ anywhere."""
    return df.distinct()


def distinct_names_by(bridge: DataFrame, dim: DataFrame, key: str, dim_key: str, out: str) -> DataFrame:
    """``(key, out)``: sorted distinct names that a bridge table links to each key.

    Each task merges the names of a key before the only shuffle, so an array never holds
    more than the vocabulary of ``dim``, however many rows a key has.
    """
    named = bridge.select(key, dim_key).join(dim.select(dim_key, F.col("name").alias("_name")), dim_key)
    return named.where(F.col("_name").isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set("_name")).alias(out))


def collect_rows_by(df: DataFrame, key: str, value: Column, out: str) -> DataFrame:
    """``(key, out)``: all values of a key as one sorted array, whatever their number.

    An array is built by one task; :func:`collect_parts_by` and plain rows are for keys
    that outgrow that.
    """
    return df.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(out))


def collect_parts_by(df: DataFrame, key: str, row_id: str, value: Column, out: str, parts: int) -> DataFrame:
    """``(key, part, out)``: the values of a key as up to ``parts`` sorted arrays, dealt by the hash of ``row_id``."""
    part = F.pmod(F.xxhash64(F.col(row_id)), F.lit(parts)).cast("int").alias("part")
    return df.groupBy(key, part).agg(F.array_sort(F.collect_list(value)).alias(out))
