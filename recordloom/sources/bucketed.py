"""Tables that keep the first row of each key over many batches, partitioned by a hash bucket of the key.

A batch is checked against the buckets of its own keys only: other folders are neither listed
nor read, however large the table has grown.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.operators.joins import drop_matching, keep_matching
from recordloom.operators.merge import pick_first
from recordloom.session import stage
from recordloom.sources.tables import replace_parts

#: Buckets of a table, fixed once it has rows. A batch with many more keys than buckets reads them all.
BUCKETS = 64


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def read_buckets(
    spark: SparkSession, path: str, schema: T.StructType, numbers: list[int] | None = None, before: int | None = None,
    batch_id: int | None = None,
) -> DataFrame:
    """Rows of the buckets ``numbers`` (all of them by default) that were written before batch ``before``, or by ``batch_id``."""
    stored = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch_id", T.LongType())])
    path = path.rstrip("/")
    names = "*" if numbers is None else "{" + ",".join(map(str, numbers)) + "}"
    batch = "" if batch_id is None else f"/batch_id={batch_id}"
    try:
        found = spark.read.schema(stored).option("basePath", path).parquet(f"{path}/bucket={names}{batch}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if numbers is not None:
        found = found.where(F.col("bucket").isin(*numbers))
    if before is not None:
        found = found.where(F.col("batch_id") < before)
    return found.select(*schema.names)


def known_keys(spark: SparkSession, path: str, key: T.StructField, keys: DataFrame, batch_id: int, buckets: int = BUCKETS) -> DataFrame:
    """The distinct ``keys``, of one column ``key``, that batches before ``batch_id`` have written.

    The driver gets the numbers of the buckets that ``keys`` fall into, at most ``buckets``.
    """
    numbers = sorted(r["bucket"] for r in keys.select(bucket_of(key.name, buckets).alias("bucket")).distinct().toLocalIterator())
    if not numbers:
        return spark.createDataFrame([], T.StructType([key]))
    stored = read_buckets(spark, path, T.StructType([key]), numbers, batch_id)
    return keep_matching(stored, keys, key.name, unique=True)


def write_buckets(df: DataFrame, path: str, key: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """Add a batch of rows with distinct keys; a batch that runs again replaces its own."""
    rows = df.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket")
    replace_parts(rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")), path, ["bucket", "batch_id"])


def first_wins_into(
    path: str, source: DataFrame, key: str, order_by: list[str], batch_id: int, seen: DataFrame | None = None, buckets: int = BUCKETS
) -> tuple[DataFrame, DataFrame]:
    """Write the first row of each key that no earlier batch has; returns ``(rows written, keys known before)``.

    Within a batch the smallest row by ``order_by`` is the first; the earlier batch wins over a later
    one. Known are those of ``seen``, which must hold the keys of ``source``; by default those.
    Null keys are left out. Both results are written tables: the rows are those of the buckets. With ``seen`` the
    rows are written nowhere else, as they are picked only once then.
    """
    spark, field = source.sparkSession, source.schema[key]
    first = pick_first(source.where(F.col(key).isNotNull()), [key], order_by)
    if seen is None:
        first = stage(first, "first-rows")
    keys = first.select(key) if seen is None else stage(seen.select(key).dropna().distinct(), "keys")
    known = stage(known_keys(spark, path, field, keys, batch_id, buckets), "known-keys")
    write_buckets(drop_matching(first, known, key, unique=True), path, key, batch_id, buckets)
    return read_buckets(spark, path, first.schema, batch_id=batch_id), known
