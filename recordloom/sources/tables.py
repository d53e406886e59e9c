"""Table readers and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.operators.joins import lookup_join
from recordloom.session import SMALL_CODEC


def read_table(spark: SparkSession, fmt: str, **options: str) -> DataFrame:
    """A table or view behind any Spark source, such as ``parquet`` (``path``) or ``jdbc`` (``url``, ``dbtable``).

    For JDBC pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``,
    else the whole table is read by one task.
    """
    if fmt == "jdbc" and "partitionColumn" not in options:
        raise ValueError("a JDBC table needs partitionColumn, lowerBound, upperBound and numPartitions")
    return spark.read.format(fmt).options(**options).load()


def values_df(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """Constant rows as a relation whose size the optimizer knows."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)

    def literal(value: object, kind: T.DataType) -> str:
        if value is None:
            return f"CAST(NULL AS {kind.simpleString()})"
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, (int, float)):
            return f"CAST({value} AS {kind.simpleString()})"
        text = str(value).replace("\\", "\\\\").replace("'", "\\'")
        return f"CAST('{text}' AS {kind.simpleString()})"

    body = ", ".join(
        "(" + ", ".join(literal(v, f.dataType) for v, f in zip(row, schema.fields)) + ")" for row in rows
    )
    names = ", ".join(f"`{f.name}`" for f in schema.fields)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def materialize(df: DataFrame, path: str, partition_by: list[str] = ()) -> DataFrame:
    """Replace a table in full and read it back. ``path`` must not be an input of ``df``."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def overwrite_lookup(df: DataFrame, path: str) -> DataFrame:
    """Truncate and load: the lookup holds exactly the new rows."""
    return materialize(df, path)


def append_landing(df: DataFrame, path: str, mode: str = "replace", by_load: bool = False) -> DataFrame:
    """Land rows that carry a ``load_id``, one folder per load.

    ``replace`` swaps the folders of the loads at hand and leaves all others, so a
    repeated load does not double its rows; ``append`` adds to them. The rows are gathered by load first, a large
    load over several tasks, so that files and what a task sorts do not grow with tasks times loads. With
    ``by_load`` few tasks hold rows of a load already: they are written where they are, and nothing is shuffled.
    """
    if not by_load:
        df = df.hint("rebalance", "load_id")
    if mode == "append":
        df.write.mode("append").partitionBy("load_id").parquet(path, compression=SMALL_CODEC)
    elif mode == "replace":
        replace_parts(df, path, ["load_id"], SMALL_CODEC)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_with_positions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A written table with the file ``_file`` and the position ``_row`` of each row."""
    return spark.read.schema(schema).parquet(path).select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )


def number_stored(located: DataFrame, start: int = 0, column: str = "source_id") -> DataFrame:
    """Gapless numbers after ``start`` for rows with ``_file`` and ``_row``.

    The number of a row is its position in its file plus the rows of the files before
    it. Files do not change once written, so a retried task gives the same numbers;
    only one small row per file is ranked and no data row is shuffled.
    """
    sizes = located.groupBy("_file").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        lookup_join(located, offsets, "_file", "inner")
        .withColumn(column, F.lit(start) + F.col("_before") + F.col("_row") + 1)
        .drop("_file", "_row", "_before")
    )


def number_rows(df: DataFrame, path: str, start: int = 0, column: str = "source_id") -> DataFrame:
    """Write ``df`` to ``path`` and read it back with gapless numbers after ``start``."""
    df.write.parquet(path)
    return number_stored(stored_with_positions(df.sparkSession, path, df.schema), start, column)


def existing_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The parquet table at ``path``; no rows before the first run has written it."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _versions(spark: SparkSession, path: str, schema: T.StructType, before: int | None) -> DataFrame:
    versioned = T.StructType([*schema.fields, T.StructField("version", T.LongType())])
    stored = existing_table(spark, path, versioned)
    return stored if before is None else stored.where(F.col("version") < before)


def read_newest(spark: SparkSession, path: str, schema: T.StructType, key: str, before: int | None = None) -> DataFrame:
    """The newest row of each ``key`` in a small table to which every version adds the rows that it changes."""
    newest = _versions(spark, path, schema, before).groupBy(key).agg(F.max_by(F.struct(*schema.names), "version").alias("row"))
    return newest.select("row.*")


def next_version(spark: SparkSession, path: str, schema: T.StructType) -> int:
    versioned = T.StructType([*schema.fields, T.StructField("version", T.LongType())])
    newest = existing_table(spark, path, versioned).agg(F.max("version").alias("v")).first()["v"]
    return 0 if newest is None else newest + 1


def write_version(df: DataFrame, path: str, version: int) -> None:
    """Add a version; writing the same one again replaces it."""
    replace_parts(df.withColumn("version", F.lit(version).cast("bigint")), path, ["version"])


def replace_parts(df: DataFrame, path: str, partition_by: list[str], codec: str | None = None) -> None:
    """Replace the partitions at hand and leave all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path, compression=codec)
