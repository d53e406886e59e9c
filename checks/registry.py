"""Collects queries with their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.fixtures import Data, with_subqueries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def portable(df: DataFrame) -> DataFrame:
    """Result columns in types that any engine prints alike: dates, times and arrays as text, decimals as double."""
    def convert(field: T.StructField):
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType):
            if isinstance(field.dataType.elementType, T.StringType):
                return F.when(col.isNotNull(), F.array_join(col, "|")).alias(field.name)
            return F.to_json(col).alias(field.name)
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return col.cast("string").alias(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return col.cast("double").alias(field.name)
        return col

    return df.select(*[convert(f) for f in df.schema.fields])


def query(sql: str | None = None):
    """Register a function of :class:`Data` under its own name, with the SQL it must equal."""
    def register(build: Callable[[Data], DataFrame]):
        name = build.__name__
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: portable(build(Data(spark, sf_dir)))
        if sql is not None:
            SQL[name] = with_subqueries(sql)
        return build

    return register


def register(name: str, build: Callable[[Data], DataFrame], sql: str | None = None) -> None:
    build.__name__ = name
    query(sql)(build)
