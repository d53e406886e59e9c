"""Usage counts from a query or event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: days of log that are read, and rows of the report
LOG_DAYS = 7
RESULT_LIMIT = 1000


def usage_rollup(
    log: DataFrame, by: list[str], time_column: str = "ts", top_n: int | None = None
) -> DataFrame:
    """Uses per day and ``by`` columns, all of them, or the busiest ``top_n`` in order."""
    counts = log.groupBy(F.to_date(time_column).alias("day"), *by).agg(F.count("*").alias("uses"))
    if top_n is None:
        return counts
    return counts.orderBy(F.desc("uses"), "day", *by).limit(top_n)


def recent_log(log: DataFrame, as_of: str, days: int = LOG_DAYS, time_column: str = "ts") -> DataFrame:
    """Entries of the last ``days`` before ``as_of``; a plain range filter that reaches the scan."""
    end = F.lit(as_of).cast(log.schema[time_column].dataType)
    return log.where((F.col(time_column) >= end - F.make_dt_interval(F.lit(days))) & (F.col(time_column) < end))
