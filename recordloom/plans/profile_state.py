"""Column profiles kept as state per load, which merge: a new load is profiled by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.operators.aggregates import percentage
from recordloom.operators.filters import prune_to
from recordloom.plans.profile import _identity, _is_number
from recordloom.sources.tables import replace_parts

#: Sketch sizes. Distinct counts are off by 0.65 % (one standard error), the rank of a quantile by about 0.35 %.
DISTINCT_BITS, RANK_ITEMS = 14, 800
#: What the estimates are held to: more than four standard errors.
DISTINCT_ERROR, RANK_ERROR = 0.03, 0.01


def _total_kind(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.DecimalType):
        return T.DecimalType(38, kind.scale)
    return T.DecimalType(38, 0) if isinstance(kind, T.IntegralType) else T.DoubleType()


def _state(name: str, kind: T.DataType) -> Column:
    """What one load says of a column, in values that merge."""
    col = F.col(f"`{name}`")
    parts = {
        "row_count": F.count("*"), "value_count": F.count(col), "min_value": F.min(col), "max_value": F.max(col),
        # a sketch leaves out empty texts
        "distinct": F.hll_sketch_agg(F.concat(F.lit("="), _identity(col, kind)), DISTINCT_BITS),
    }
    if _is_number(kind):
        number = col.cast("double")
        parts |= {
            "total": F.sum(col.cast(_total_kind(kind))).cast(_total_kind(kind)), "mean": F.avg(number),
            "squares": F.var_pop(number) * F.count(number), "ranks": F.kll_sketch_agg_double(number, RANK_ITEMS),
        }
    if isinstance(kind, T.StringType):
        length = F.length(col).cast("bigint")
        parts |= {"min_length": F.min(length), "max_length": F.max(length), "length_total": F.sum(length)}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def profile_loads(landing: DataFrame, loads: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Write the state of ``loads`` to ``path``, one folder per load; a load that comes again replaces its own.

    Of a landing table partitioned by load only these partitions are read.
    """
    fields = [f for f in landing.schema.fields if f.name != "load_id" and (columns is None or f.name in columns)]
    rows = prune_to(landing, loads, "load_id")
    replace_parts(rows.groupBy("load_id").agg(*[_state(f.name, f.dataType).alias(f.name) for f in fields]), path, ["load_id"])


def read_states(spark: SparkSession, path: str, loads: DataFrame | None = None) -> DataFrame:
    """The states of ``loads``, by default of all."""
    states = spark.read.parquet(path)
    return states if loads is None else prune_to(states, loads, "load_id")


def _has(states: DataFrame, column: str, part: str) -> bool:
    return part in states.schema[column].dataType.names


def merged_profile(states: DataFrame) -> DataFrame:
    """The columns of ``plans.profile.profile``, out of states alone. Distinct counts are estimates, all else is exact.

    Variances merge by the means of the loads around the mean of all, so that large numbers of small spread
    lose no digits.
    """
    columns = [c for c in states.columns if c != "load_id"]
    numbers = [c for c in columns if _has(states, c, "mean")]
    n = lambda c: F.col(f"`{c}`.value_count")
    if numbers:
        means = F.struct(*[(F.sum(n(c) * F.col(f"`{c}`.mean")) / F.nullif(F.sum(n(c)), F.lit(0))).alias(c) for c in numbers])
        states = states.withColumn("_means", states.agg(means.alias("means")).scalar())
    none, no_length = F.lit(None).cast("double"), F.lit(None).cast("bigint")

    def merged(c: str) -> Column:
        part = lambda p: F.col(f"`{c}`.{p}")
        is_number, is_text = c in numbers, _has(states, c, "length_total")
        values = F.sum(n(c))
        stats = {
            "column_name": F.lit(c), "row_count": F.sum(part("row_count")), "null_count": F.sum(part("row_count") - n(c)),
            "min_value": F.min(part("min_value")).cast("string"), "max_value": F.max(part("max_value")).cast("string"),
            "mean": none, "stddev": none, "sum": F.lit(None).cast("string"),
            "min_length": no_length, "max_length": no_length, "avg_length": none,
            "distinct_count": F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(part("distinct"))), F.lit(0)).cast("bigint"),
        }
        if is_number:
            mean = F.col(f"_means.`{c}`")
            squares = F.sum(part("squares") + n(c) * (part("mean") - mean) * (part("mean") - mean))
            stats |= {
                "mean": F.max(mean), "stddev": F.when(values > 1, F.sqrt(squares / (values - 1))), "sum": F.sum(part("total")).cast("string"),
            }
        if is_text:
            stats |= {
                "min_length": F.min(part("min_length")), "max_length": F.max(part("max_length")),
                "avg_length": F.sum(part("length_total")) / F.nullif(values, F.lit(0)),
            }
        return F.struct(*[v.alias(k) for k, v in stats.items()])

    rows = states.agg(*[merged(c).alias(f"_s{i}") for i, c in enumerate(columns)])
    stats = rows.select(F.inline(F.array(*[f"_s{i}" for i in range(len(columns))])))
    return stats.withColumn("null_percent", percentage(F.col("null_count"), F.col("row_count")))


def merged_quantiles(states: DataFrame, probabilities: list[float]) -> DataFrame:
    """``(column_name, probability, value)`` of the number columns that hold a value, near the rank asked for (``RANK_ERROR``)."""
    columns = [c for c in states.columns if c != "load_id" and _has(states, c, "ranks")]
    sketches = states.agg(*[F.kll_merge_agg_double(F.col(f"`{c}`.ranks"), RANK_ITEMS).alias(f"_k{i}") for i, c in enumerate(columns)])
    rows = []
    for i, c in enumerate(columns):
        filled = F.when(F.kll_sketch_get_n_double(f"_k{i}") > 0, F.col(f"_k{i}"))
        rows += [
            F.struct(F.lit(c).alias("column_name"), F.lit(float(p)).alias("probability"), F.kll_sketch_get_quantile_double(filled, F.lit(float(p))).alias("value"))
            for p in probabilities
        ]
    return sketches.select(F.inline(F.array(*rows))).where(F.col("value").isNotNull())
