"""Lineage edges and reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.session import scratch_path, stage


def lineage_edges(lineage: DataFrame, dataset: DataFrame) -> DataFrame:
    """Edges with the titles of both ends, where known."""
    def named(side: str) -> DataFrame:
        return dataset.select(F.col("dataset_id").alias(f"{side}_dataset_id"), F.col("title").alias(f"{side}_title"))

    return (
        lineage.join(named("upstream"), "upstream_dataset_id", "left")
        .join(named("downstream"), "downstream_dataset_id", "left")
        .select("upstream_dataset_id", "upstream_title", "downstream_dataset_id", "downstream_title", "lineage_type")
    )


def endpoints(edges: DataFrame, direction: str = "downstream") -> DataFrame:
    """``dataset_id`` of the datasets where following ``direction`` starts: those nothing leads to."""
    other = "upstream" if direction == "downstream" else "downstream"
    starts = edges.select(F.col(f"{other}_dataset_id").alias("dataset_id")).distinct()
    ends = edges.select(F.col(f"{direction}_dataset_id").alias("dataset_id")).distinct()
    return starts.join(ends, "dataset_id", "left_anti")


def lineage_closure(
    edges: DataFrame, starts: DataFrame, direction: str = "downstream", max_depth: int | None = None
) -> DataFrame:
    """``(start_id, dataset_id, depth)``: what each start reaches, with the shortest distance.

    Follows the edges level by level. A pair is kept the first time it is seen, so a
    cycle ends by itself; ``max_depth`` is for those who want less. Every level is
    written to the shared folder, so the plan does not grow and a lost executor costs
    no earlier level. Levels are joined by sorted shuffles: one broadcast a level would send the
    driver all pairs in the end.
    """
    spark = edges.sparkSession
    source, target = ("upstream", "downstream") if direction == "downstream" else ("downstream", "upstream")
    steps = stage(
        edges.select(F.col(f"{source}_dataset_id").alias("dataset_id"), F.col(f"{target}_dataset_id").alias("_next"))
        .dropna().distinct(),
        "lineage-steps",
    )
    levels = scratch_path(spark, "lineage-levels")
    level = starts.select(F.col("dataset_id").alias("start_id"), "dataset_id").distinct()
    schema = T.StructType([*level.schema.fields, T.StructField("depth", T.IntegerType())])
    depth = 0
    while _write_level(level, f"{levels}/depth={depth}") and (max_depth is None or depth < max_depth):
        seen = spark.read.schema(schema).parquet(levels)
        frontier = seen.where(F.col("depth") == depth)
        level = (
            frontier.join(steps.hint("merge"), "dataset_id").select("start_id", F.col("_next").alias("dataset_id")).distinct()
            .join(seen.hint("merge"), ["start_id", "dataset_id"], "left_anti")
        )
        depth += 1
    return spark.read.schema(schema).parquet(levels).where(F.col("depth") > 0)


def _write_level(level: DataFrame, path: str) -> int:
    """Write one level and tell its size."""
    written = Observation()
    level.observe(written, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return written.get["n"]
