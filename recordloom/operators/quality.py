"""Data-quality checks. Reports are ``(check_name, value, status)`` rows; violations are frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.labels import threshold_status
from recordloom.operators.aggregates import percentage

# fixed values: expected table sizes
SOURCE_ROWS = 25_000
LOOKUP_ROWS = 300


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_count_report(tables: dict[str, DataFrame | None], thresholds: dict[str, int] | None = None) -> DataFrame:
    """Rows per table against its expected size; a missing table (None) is a FAIL row with value 0."""
    thresholds = thresholds or {}
    found = next(df for df in tables.values() if df is not None)
    rows = []
    for name, df in tables.items():
        counted = (
            found.sparkSession.sql("SELECT CAST(0 AS BIGINT) AS value")
            if df is None else df.agg(F.count("*").alias("value"))
        )
        rows.append(counted.select(
            F.lit(name).alias("check_name"),
            "value",
            threshold_status(F.col("value"), thresholds.get(name, 0)).alias("status"),
        ))
    return union_all(rows)


def null_check(df: DataFrame, columns: list[str], name: str, max_share: dict[str, float] | None = None) -> DataFrame:
    """NULLs per column in one pass. A column of ``max_share`` may be NULL in less than that share of rows."""
    max_share = max_share or {}
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    entries = []
    for c in columns:
        if c in max_share:
            status = F.when(F.col(c) < F.col("_rows") * F.lit(str(max_share[c])).cast("decimal(9,6)"), "OK").otherwise("WARN")
        else:
            status = F.when(F.col(c) == 0, "OK").otherwise("FAIL")
        entries.append(F.struct(
            F.lit(f"{name} with NULL {c}").alias("check_name"), F.col(c).alias("value"), status.alias("status")
        ))
    return counts.select(F.inline(F.array(*entries)))


def linkage_report(cases: DataFrame, defendants: DataFrame, plaintiffs: DataFrame, key: str = "row_id") -> DataFrame:
    """Distinct case keys with defendants, plaintiffs and both, and their percentage of all case rows.

    The three key columns are stacked and grouped once: one shuffle with partial
    aggregation and no join, whatever the number of parties per case.
    """
    def tagged(df: DataFrame, mark: int) -> DataFrame:
        return df.select(F.col(key), F.lit(mark).alias("_mark"))

    by_key = union_all([tagged(cases, 0), tagged(defendants, 1), tagged(plaintiffs, 2)]).groupBy(key).agg(
        F.count_if(F.col("_mark") == 0).alias("_cases"),
        F.max(F.col("_mark") == 1).alias("_def"),
        F.max(F.col("_mark") == 2).alias("_plt"),
    )
    linked = F.col(key).isNotNull() & (F.col("_cases") > 0)
    totals = by_key.agg(
        F.coalesce(F.sum("_cases"), F.lit(0).cast("bigint")).alias("_total"),
        F.count_if(linked & F.col("_def")).alias("d"),
        F.count_if(linked & F.col("_plt")).alias("p"),
        F.count_if(linked & F.col("_def") & F.col("_plt")).alias("b"),
    )
    return totals.select(F.inline(F.array(*[
        F.struct(
            F.lit(metric).alias("metric"),
            F.col(c).alias("row_count"),
            percentage(F.col(c), F.col("_total")).alias("percentage"),
        )
        for metric, c in (("Cases with defendants", "d"), ("Cases with plaintiffs", "p"), ("Cases with both", "b"))
    ])))


def duplicate_check(df: DataFrame, key: str) -> DataFrame:
    """Surplus rows over distinct keys."""
    value = F.col("_rows") - F.col("_keys")
    return df.agg(F.count("*").alias("_rows"), F.countDistinct(key).alias("_keys")).select(
        F.lit(f"Duplicate {key}").alias("check_name"),
        value.alias("value"),
        F.when(value == 0, "OK").otherwise("WARN").alias("status"),
    )


def unique_violations(df: DataFrame, keys: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Keys held by more than one row, with the number of rows. NULL parts never collide."""
    if where is not None:
        df = df.where(where)
    keyed = df.select(*[expr.alias(name) for name, expr in keys.items()]).dropna()
    return keyed.groupBy(*keys).agg(F.count("*").alias("row_count")).where(F.col("row_count") > 1)


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Referenced keys that the parent lacks, with the number of child rows; NULL references pass.

    Child rows are counted per key before the join, so a hot key is one row in it.
    """
    referenced = child.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count("*").alias("row_count"))
    return referenced.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def domain_violations(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose value is outside the domain; NULL passes."""
    return df.where(~F.col(column).isin(*allowed))


def not_null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, null_rows)`` of the columns that hold NULLs, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_rows")) for c in columns])
    return counts.select(F.inline(rows)).where(F.col("null_rows") > 0)
