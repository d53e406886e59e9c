"""Column statistics of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.operators.aggregates import percentage
from recordloom.operators.joins import keep_matching, lookup_join
from recordloom.operators.quality import union_all
from recordloom.operators.sampling import sample_percent
from recordloom.session import scratch_path, stage
from recordloom.sources.tables import stored_with_positions


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _exact_sum(col: Column, kind: T.DataType) -> Column:
    """Sum as text: of whole and decimal numbers to the last digit, of others as double."""
    if isinstance(kind, T.DecimalType):
        return F.sum(col.cast(T.DecimalType(38, kind.scale))).cast("string")
    if isinstance(kind, T.IntegralType):
        return F.sum(col.cast("decimal(38,0)")).cast("string")
    return F.sum(col.cast("double")).cast("string")


def _statistics(name: str, kind: T.DataType, approx_distinct: bool) -> Column:
    col = F.col(f"`{name}`")
    number = col.cast("double") if _is_number(kind) else None
    none, no_length = F.lit(None).cast("double"), F.lit(None).cast("bigint")
    length = F.length(col) if isinstance(kind, T.StringType) else None
    stats = {
        "column_name": F.lit(name),
        "row_count": F.count("*"),
        "null_count": F.count_if(col.isNull()),
        "min_value": F.min(col).cast("string"),
        "max_value": F.max(col).cast("string"),
        "mean": F.avg(number) if number is not None else none,
        "stddev": F.stddev_samp(number) if number is not None else none,
        "sum": _exact_sum(col, kind) if number is not None else F.lit(None).cast("string"),
        "min_length": F.min(length).cast("bigint") if length is not None else no_length,
        "max_length": F.max(length).cast("bigint") if length is not None else no_length,
        "avg_length": F.avg(length) if length is not None else none,
    }
    if approx_distinct:
        stats["distinct_count"] = F.approx_count_distinct(col)
    return F.struct(*[v.alias(k) for k, v in stats.items()])


def _identity(col: Column, kind: T.DataType) -> Column:
    """Text that is the same for equal values only, as ``count(distinct)`` sees them."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (col + F.lit(0).cast(kind)).cast("string")  # the two zeros are equal
    if isinstance(kind, T.BinaryType):
        return F.hex(col)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(col, {"ignoreNullFields": "false"})
    return col.cast("string")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, distinct_count)``, exact, in one grouped pass over the columns.

    Copies of a value merge before the shuffle, and a long value travels as its digest.
    """
    def cell(c: str) -> Column:
        text = _identity(F.col(f"`{c}`"), df.schema[c].dataType)
        value = F.when(F.octet_length(text) > 64, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(F.concat(F.lit("="), text))
        return F.struct(F.lit(c).alias("column_name"), value.alias("value"))

    values = df.select(F.inline(F.array(*[cell(c) for c in columns]))).where(F.col("value").isNotNull())
    return values.distinct().groupBy("column_name").agg(F.count("*").alias("distinct_count"))


def profile(
    df: DataFrame,
    key: str | None = None,
    sample_pct: int = 100,
    columns: list[str] | None = None,
    approx_distinct: bool = True,
) -> DataFrame:
    """One row per column: counts, share of NULLs, distinct values, range, moments and text lengths.

    All statistics come from one aggregate over one scan, distinct values from a sketch per
    column. Without ``approx_distinct`` they are exact, which groups the values of all columns
    in a second scan. Sums and extremes are text, so that no digit is lost. ``sample_pct`` below 100 profiles a
    repeatable sample by ``key``.
    """
    if sample_pct < 100:
        df = sample_percent(df, key, sample_pct)
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    stats = df.agg(*[
        _statistics(f.name, f.dataType, approx_distinct).alias(f"_s{i}") for i, f in enumerate(fields)
    ]).select(F.inline(F.array(*[f"_s{i}" for i in range(len(fields))])))
    if not approx_distinct:
        stats = stats.join(distinct_counts(df, [f.name for f in fields]), "column_name", "left").withColumn(
            "distinct_count", F.coalesce("distinct_count", F.lit(0).cast("bigint"))
        )
    return stats.withColumn(
        "null_percent",
        percentage(F.col("null_count"), F.col("row_count")),
    )


def quantiles(df: DataFrame, column: str, probabilities: list[float], slice_values: int = 1_000_000) -> DataFrame:
    """Exact ``(column_name, probability, value)``: the least value with that share of rows up to it.

    Rows are reduced to counts per value, which are written in value ranges of about
    ``slice_values`` each. Values keep the column's type. The rows per range tell which range holds a rank, and only
    those ranges are ordered inside, each in a task of its own.
    """
    spark = df.sparkSession
    value = F.col(f"`{column}`").alias("value")
    counts = stage(df.select(value).dropna().groupBy("value").agg(F.count("*").alias("n")), "value-counts")
    path = scratch_path(spark, "value-ranges")
    ranges = max(1, -(-counts.count() // slice_values))
    counts.repartitionByRange(ranges, "value").write.parquet(path)
    located = stored_with_positions(spark, path, counts.schema).drop("_row")
    per_range = located.groupBy("_file").agg(F.min("value").alias("_least"), F.sum("n").alias("_rows"))
    before = Window.orderBy("_least").rowsBetween(Window.unboundedPreceding, -1)
    total = per_range.agg(F.sum("_rows").alias("total")).scalar()
    ranks = F.array(*[
        F.struct(
            F.lit(float(p)).alias("probability"),
            F.greatest(F.ceil(F.lit(str(p)).cast("decimal(9,8)") * total).cast("bigint"), F.lit(1)).alias("rank"),
        )
        for p in probabilities
    ])
    wanted = (
        per_range.select("_file", "_rows", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
        .select("*", F.inline(ranks))
        .where((F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("_rows")))
    )
    within = Window.partitionBy("_file").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    holding = keep_matching(located, wanted, "_file").withColumn("_upto", F.sum("n").over(within))
    found = lookup_join(holding, wanted.select("_file", "_before", "probability", "rank"), "_file", "inner")
    return (
        found.where(F.col("_before") + F.col("_upto") >= F.col("rank"))
        .groupBy("probability").agg(F.min("value").alias("value"))
        .select(F.lit(column).alias("column_name"), "probability", "value")
    )


def approx_quantiles(df: DataFrame, probabilities: list[float], accuracy: int = 10_000) -> DataFrame:
    """``(column_name, probability, value)`` of the numeric columns, from one mergeable sketch per column.

    Exact while a column has no more rows than ``accuracy``.
    """
    columns = [f.name for f in df.schema.fields if _is_number(f.dataType)]
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    sketches = df.agg(*[
        F.percentile_approx(F.col(f"`{c}`").cast("double"), wanted, F.lit(accuracy)).alias(f"_q{i}")
        for i, c in enumerate(columns)
    ])
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(float(p)).alias("probability"),
            F.get(f"_q{i}", F.lit(j)).alias("value"),
        )
        for i, c in enumerate(columns) for j, p in enumerate(probabilities)
    ]
    return sketches.select(F.inline(F.array(*rows)))


def profile_all(
    tables: dict[str, DataFrame], percent: dict[str, int], keys: dict[str, str], approx_distinct: bool = True
) -> DataFrame:
    """Profiles of several tables, each with its own sample share: ``table_name`` plus the profile columns."""
    return union_all([
        profile(df, keys.get(name), percent.get(name, 100), approx_distinct=approx_distinct).select(F.lit(name).alias("table_name"), "*")
        for name, df in tables.items()
    ])
