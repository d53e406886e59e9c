"""The busiest keys of sliding windows of days, out of one small summary per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.plans.usage import LOG_DAYS, RESULT_LIMIT, usage_rollup

#: Keys that a day's summary keeps.
KEEP = 10_000
#: Parts that a day's keys are ranked in before they meet.
SALTS = 64


def _first(df: DataFrame, by: list[str], order: list, n: int, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def summarize_days(log: DataFrame, by: list[str], keep: int = KEEP, time_column: str = "ts") -> DataFrame:
    """``day, by, uses, dropped``: the ``keep`` busiest keys of each day, exactly counted.

    ``dropped`` is the largest count of a key that the day's summary leaves out, 0 if it holds all.
    A day's summary depends on that day alone, so it is written once and kept. Keys of a day are
    ranked in parts first, so no task ranks a whole day. NULL keys count like others.
    """
    counts = usage_rollup(log, by, time_column)
    busiest = [F.desc("uses"), *by]
    few = _first(counts.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS))), ["day", "_salt"], busiest, keep + 1, "_rank")
    ranked = _first(few, ["day"], busiest, keep + 1, "_rank")
    left_out = F.max(F.when(F.col("_rank") > keep, F.col("uses"))).over(Window.partitionBy("day"))
    return ranked.withColumn("dropped", F.coalesce(left_out, F.lit(0).cast("bigint"))).where(F.col("_rank") <= keep).select(
        "day", *by, "uses", "dropped"
    )


def sliding_top(
    log: DataFrame, summaries: DataFrame, by: list[str], days: int = LOG_DAYS, top: int = RESULT_LIMIT, time_column: str = "ts"
) -> DataFrame:
    """``last_day, by, uses, missed_at_most, certain``: the ``top`` busiest keys of the ``days`` up to each summarized day.

    Keys in any summary of a window are its candidates; their uses are counted again from the
    log, where nothing else is aggregated. A key outside the candidates has ``missed_at_most`` uses, the sum
    of what the days dropped, so a row with more than that is ``certain`` to belong where it stands.
    """
    ends = F.explode(F.sequence("day", F.date_add("day", days - 1))).alias("last_day")
    known = summaries.select(F.col("day").alias("last_day")).distinct()
    bounds = summaries.groupBy("day").agg(F.max("dropped").alias("dropped")).select(ends, "dropped")
    bounds = bounds.groupBy("last_day").agg(F.sum("dropped").alias("missed_at_most")).join(known, "last_day", "left_semi")

    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    keys = summaries.select(*by).distinct()
    asked = log.alias("l").join(keys.alias("k"), same("l", "k"), "left_semi")
    counts = usage_rollup(asked, by, time_column).select("day", *by, "uses", ends)
    candidates = summaries.select(*by, ends).distinct()
    counts = counts.alias("c").join(
        candidates.alias("s"), [F.col("c.last_day") == F.col("s.last_day"), *same("c", "s")], "left_semi"
    )
    total = counts.groupBy("last_day", *by).agg(F.sum("uses").alias("uses")).join(bounds, "last_day")
    found = _first(total, ["last_day"], [F.desc("uses"), *by], top, "_rank").drop("_rank")
    return found.withColumn("certain", F.col("uses") > F.col("missed_at_most"))
