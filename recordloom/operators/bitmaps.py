"""Distinct whole-number keys as bitmaps: exact counts and links out of small states that merge.

A state has a row per table, load and bucket of 32,768 neighbouring keys, with a bitmap of 4 kB, whatever the number of rows.
States of loads are kept and merged with OR, so a new load is read by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.aggregates import percentage
from recordloom.operators.quality import union_all
from recordloom.sources.tables import replace_parts

LINKS = {"Cases with defendants": ("defendants",), "Cases with plaintiffs": ("plaintiffs",), "Cases with both": ("defendants", "plaintiffs")}


def key_states(df: DataFrame, key: str, table: str, load: str | Column | None = None) -> DataFrame:
    """``table_name, load_id, bucket, row_count, bits`` of the rows of ``df``; rows without key are counted under a null bucket.

    Bitmaps are made before the shuffle, so a hot key costs no more than others.
    """
    number = F.col(key).cast("bigint")
    load_id = F.lit(0) if load is None else F.col(load) if isinstance(load, str) else load
    rows = df.select(load_id.cast("bigint").alias("load_id"), F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("position"))
    states = rows.groupBy("load_id", "bucket").agg(F.count("*").alias("row_count"), F.bitmap_construct_agg(F.col("position")).alias("bits"))
    return states.select(F.lit(table).alias("table_name"), "load_id", "bucket", "row_count", "bits")


def write_states(states: DataFrame, path: str) -> None:
    """Add the states of loads; those of a table and load that are there already are replaced."""
    replace_parts(states, path, ["table_name", "load_id"])


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("table_name", "load_id", "bucket", "row_count", "bits")


def merged(states: DataFrame) -> DataFrame:
    """``table_name, bucket, row_count, bits`` over all loads."""
    return states.groupBy("table_name", "bucket").agg(F.sum("row_count").alias("row_count"), F.bitmap_or_agg(F.col("bits")).alias("bits"))


def summary(states: DataFrame) -> DataFrame:
    """``table_name, row_count, unique_keys`` of every table, exact."""
    keys = F.sum(F.when(F.col("bucket").isNotNull(), F.bitmap_count(F.col("bits"))).otherwise(0)).alias("unique_keys")
    return merged(states).groupBy("table_name").agg(F.sum("row_count").alias("row_count"), keys)


def duplicates(states: DataFrame) -> DataFrame:
    """``table_name, value, status``: surplus rows over distinct keys."""
    value = F.col("row_count") - F.col("unique_keys")
    return summary(states).select("table_name", value.alias("value"), F.when(value == 0, "OK").otherwise("WARN").alias("status"))


def linkage(states: DataFrame, cases: str = "cases", links: dict[str, tuple[str, ...]] = LINKS) -> DataFrame:
    """``metric, row_count, percentage``: distinct keys of ``cases`` that all tables of a link hold too, and their share of its rows.

    The bitmaps of a bucket are joined with AND; no key is joined or grouped. Metrics without any link are 0.
    """
    by_bucket = merged(states)
    total = by_bucket.where(F.col("table_name") == cases).agg(F.coalesce(F.sum("row_count"), F.lit(0).cast("bigint")).alias("total")).scalar()
    found = []
    for metric, others in links.items():
        tables = [cases, *others]
        common = by_bucket.where(F.col("table_name").isin(*tables) & F.col("bucket").isNotNull()).groupBy("bucket").agg(
            F.count("*").alias("tables"), F.bitmap_and_agg(F.col("bits")).alias("bits")
        )
        keys = common.where(F.col("tables") == len(tables)).agg(F.coalesce(F.sum(F.bitmap_count(F.col("bits"))), F.lit(0).cast("bigint")).alias("row_count"))
        found.append(keys.select(F.lit(metric).alias("metric"), "row_count"))
    return union_all(found).withColumn("percentage", percentage(F.col("row_count"), total))
