"""Row filters with their NULL behaviour spelled out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import null_if_in
from recordloom.operators.joins import BROADCAST_BYTES
from recordloom.session import stage

#: What a key of a broadcast takes, roughly.
KEY_BYTES = 32


def null_sentinels(df: DataFrame, columns: list[str], sentinels: tuple[str, ...] = ("NA",)) -> DataFrame:
    """Sentinel texts become NULL in ``columns``, in one projection."""
    return df.withColumns({c: null_if_in(F.col(c), sentinels) for c in columns if c in df.columns})


def filter_in(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.where(F.col(column).isin(*values))


def filter_not_in_or_null(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """The exact complement of :func:`filter_in`: NULL is kept."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*values))


def mentions_any(col: Column, keywords: list[str]) -> Column:
    """True when the text contains a keyword in any letter case; false, not NULL, for NULL."""
    hits = [F.upper(col).contains(k) for k in keywords]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))


def exclude_keywords(df: DataFrame, column: str, keywords: list[str]) -> DataFrame:
    return df.where(~mentions_any(F.col(column), keywords))


def usable_document(col: Column) -> Column:
    """Present and not the sentinel."""
    return col.isNotNull() & (col != "NA")


def filter_names(df: DataFrame, column: str, includes: list[str] = (), excludes: list[str] = ()) -> DataFrame:
    """Keep rows whose name matches any include pattern (all, when none is given) and no exclude pattern."""
    if includes:
        df = df.where(reduce(lambda a, b: a | b, [F.col(column).rlike(p) for p in includes]))
    for pattern in excludes:
        df = df.where(~F.col(column).rlike(pattern))
    return df


def filter_loads(df: DataFrame, loads: DataFrame | list[int] | None) -> DataFrame:
    """Rows of the given loads: a list of ids, or a frame with a column ``load_id``. None keeps no row."""
    if loads is None:
        return df.where(F.lit(False))
    if isinstance(loads, DataFrame):
        return prune_to(df, loads, "load_id")
    return df.where(F.col("load_id").isin(*loads)) if loads else df.where(F.lit(False))


def prune_to(df: DataFrame, keys: DataFrame, name: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows whose ``name`` is among ``keys``; of a table partitioned by ``name`` only their partitions are read.

    The keys are written down and counted. Up to ``broadcast_bytes`` they are broadcast, and the scan takes its
    partitions from that broadcast when it runs, so no key passes through the plan. Beyond it the
    scan is limited to the range of the keys, and the join shuffles.
    """
    keys = stage(keys.select(name).dropna().distinct(), "pruning-keys")
    found = keys.agg(F.min(name).alias("low"), F.max(name).alias("high"), F.count("*").alias("n")).first()
    if not found["n"]:
        return df.where(F.lit(False))
    in_range = F.col(name).between(F.lit(found["low"]), F.lit(found["high"]))
    wanted = keys.where(in_range)  # a selective condition, without which partitions are not pruned
    if found["n"] * KEY_BYTES <= broadcast_bytes:
        wanted = F.broadcast(wanted)
    return df.where(in_range).join(wanted, name, "left_semi").select(*df.columns)
