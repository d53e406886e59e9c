"""Step counts and load reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.dates import seconds_between
from recordloom.operators.quality import union_all
from recordloom.sources.tables import values_df


def step_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """``(step, row_count)`` per named stage."""
    return union_all([
        df.agg(F.count("*").alias("row_count")).select(F.lit(step).alias("step"), "row_count")
        for step, df in stages.items()
    ])


class StepCounter:
    """Rows at the steps of a pipeline, counted while it writes its results.

    :meth:`watch` puts a count into a plan; the numbers are there once a write of that plan is done. No step is
    run a second time for them. Map tasks that run again because an executor was lost count again, so a
    number may be too large then; those of a last step, whose tasks write the result, never are.
    """

    def __init__(self) -> None:
        self.watched: list[tuple[Observation, list[str]]] = []

    def watch(self, df: DataFrame, step: str, **parts: Column) -> DataFrame:
        """``df``, whose rows are counted as ``step``; ``parts`` counts rows with a condition under a name of its own."""
        seen = Observation()
        self.watched.append((seen, [step, *parts]))
        return df.observe(seen, F.count(F.lit(1)).alias(step), *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in parts.items()])

    def counts(self, spark: SparkSession) -> DataFrame:
        """``(step, row_count)`` in the order in which steps were watched; waits for their writes."""
        rows = [(name, seen.get[name]) for seen, names in self.watched for name in names]
        return values_df(spark, rows, "step string, row_count bigint")


def load_report(ledger: DataFrame, source: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per load: status, duration, ledger count, landed rows, rows that became cases.

    ``cases`` carries the ``source_id`` it came from.
    """
    landed = (
        source.select("load_id", "source_id")
        .join(cases.select("source_id").distinct().withColumn("_hit", F.lit(1)), "source_id", "left")
        .groupBy("load_id")
        .agg(F.count("*").alias("source_rows"), F.count("_hit").alias("processed_rows"))
    )
    return ledger.join(landed, "load_id", "left").select(
        "load_id",
        "file_name",
        "load_status",
        "error_message",
        "rows_loaded",
        seconds_between(F.col("load_started_at"), F.col("load_completed_at")).alias("duration_seconds"),
        F.coalesce("source_rows", F.lit(0).cast("bigint")).alias("source_rows"),
        F.coalesce("processed_rows", F.lit(0).cast("bigint")).alias("processed_rows"),
    )
