"""Sampling operators: repeatable for the same rows, however they are partitioned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: rows kept as a preview, and share of rows a profile reads
SAMPLE_ROWS = 50
SAMPLE_PERCENT = {"default": 85, "published": 80, "source": 50, "governance": 100}


def sample_rows(df: DataFrame, key: str | list[str], n: int = SAMPLE_ROWS) -> DataFrame:
    """The first ``n`` rows by key: each task keeps ``n`` rows, then the best ``n`` of those."""
    return df.orderBy(*([key] if isinstance(key, str) else key)).limit(n)


def sample_percent(df: DataFrame, key: str, percent: int) -> DataFrame:
    """About ``percent`` of the rows, chosen by a hash of the key."""
    if percent >= 100:
        return df
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 7), 16, 10).cast("bigint") % 100
    return df.where(bucket < percent)
