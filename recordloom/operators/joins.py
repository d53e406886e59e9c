"""Joins that stay whole and balanced when a key is hot or a lookup outgrows a broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.session import stage

BROADCAST_BYTES = 64 * 1024 * 1024
#: Rows of one key that a task of a shuffled join takes; a key with more is salted.
HOT_ROWS = 5_000_000
SALTS = 64


def measured_bytes(df: DataFrame) -> int:
    """Size of the values of ``df`` as text, by one distributed aggregate."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + F.lit(16) for c in df.columns), F.lit(0))
    return df.agg(F.coalesce(F.sum(width.cast("bigint")), F.lit(0)).alias("bytes")).first()["bytes"]


def lookup_join(
    df: DataFrame,
    lookup: DataFrame,
    key: str,
    how: str = "left",
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Equi join of a large frame to a lookup on ``key``; NULL keys match nothing.

    The lookup is measured first. Within ``broadcast_bytes`` the large side is not
    shuffled at all. Beyond it the join shuffles both sides once. Keys with more than
    ``hot_rows`` rows are measured, and only their lookup rows are copied to ``salts``
    salts, over which their rows are dealt; rows with a NULL key are dealt as well.
    """
    if measured_bytes(lookup) <= broadcast_bytes:
        return df.join(F.broadcast(lookup), key, how)
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    # at most one key per `hot_rows` rows of the large side
    hot = stage(counts.where(F.col("_n") > hot_rows).select(key, F.lit(True).alias("_hot")), "hot-keys")
    if measured_bytes(hot) <= broadcast_bytes:
        hot = F.broadcast(hot)
    dealt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) + F.spark_partition_id(), F.lit(salts)).cast("int")
    spread = F.when(F.col("_hot") | F.col(key).isNull(), dealt).otherwise(0)
    rows = df.join(hot, key, "left").withColumn("_salt", spread).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    lookup = lookup.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return rows.join(lookup, [key, "_salt"], how).drop("_salt")


def distinct_keys(df: DataFrame, names: list[str], spread: int = 8) -> DataFrame:
    """At most ``spread`` copies of each key, for the right side of a semi or anti join.

    A plain ``distinct`` would hand its own partitioning to the join, and adaptive
    execution does not split a hot key of the left side then. Counting the map task
    into the grouping leaves the join a shuffle of its own, which it can split.
    """
    return df.select(*names, (F.spark_partition_id() % spread).alias("_spread")).distinct().drop("_spread")


def _match(df: DataFrame, keys: DataFrame, on: str | list[str], unique: bool, how: str) -> DataFrame:
    names = [on] if isinstance(on, str) else on
    right = keys.select(*names) if unique else distinct_keys(keys, names)
    return df.join(right, names, how)


def keep_matching(df: DataFrame, keys: DataFrame, on: str | list[str], unique: bool = False) -> DataFrame:
    """EXISTS: rows of ``df`` whose key is in ``keys``. ``unique``: no key occurs twice in ``keys``."""
    return _match(df, keys, on, unique, "left_semi")


def drop_matching(df: DataFrame, keys: DataFrame, on: str | list[str], unique: bool = False) -> DataFrame:
    """NOT EXISTS: rows of ``df`` whose key is not in ``keys``; rows with a NULL key stay."""
    return _match(df, keys, on, unique, "left_anti")


def left_join_many(df: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join to a frame that may hold very many rows of one key.

    A left outer join gives all right rows of a key to one task. Its matches are an inner
    join, whose hot keys adaptive execution splits on either side; rows without a match
    are added by an anti join.
    """
    unmatched = drop_matching(df, right, key)
    return df.join(right, key).unionByName(unmatched, allowMissingColumns=True)
