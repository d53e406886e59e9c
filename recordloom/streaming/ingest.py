"""Incremental loading and processing with Structured Streaming.

Both jobs run to completion over what is new (``availableNow``) and can be started
again at any time. What a micro-batch writes is named after its files or its batch id,
so a batch that is retried after a lost driver or executor replaces its own output
instead of doubling it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from recordloom.functions.text import to_bigint
from recordloom.operators.filters import filter_loads
from recordloom.operators.joins import drop_matching
from recordloom.plans.loads import accept_cases, commit_load, party_rows
from recordloom.schemas import CASE_FIELDS, CASE_FILE_COLUMNS, LANDING_SCHEMA, LEDGER_SCHEMA
from recordloom.session import note_staged, stage
from recordloom.sources.bucketed import BUCKETS, first_wins_into
from recordloom.sources.csv import read_many
from recordloom.sources.tables import existing_table, replace_parts


PROCESSED_COLUMNS = [
    "source_id", "load_id", *[c for c in CASE_FILE_COLUMNS if c in CASE_FIELDS.values() or c in ("cjis", "defendant", "plaintiff")],
]


def _limited(reader: DataStreamReader, max_files: int | None) -> DataStreamReader:
    return reader if max_files is None else reader.option("maxFilesPerTrigger", str(max_files))


def stream_load(
    spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, as_of: str, multi_line: bool = True,
    max_files: int | None = None,
) -> StreamingQuery:
    """Land the files of ``in_dir`` that were not loaded yet: ``out_dir/landing`` and ``out_dir/ledger``.

    The result is that of the batch load, except that a file without any record is not
    noted. ``max_files`` cuts a backlog into micro-batches of that many files. The stream itself
    is one of file names; a batch reads its files as the batch load does, large ones in splits.
    """
    files = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile")

    def land(batch: DataFrame, batch_id: int) -> None:
        paths = [re.sub(r"([\\{}\[\]*?])", r"\\\1", r["path"]) for r in batch.distinct().toLocalIterator()]  # names, not patterns
        if paths:
            with note_staged() as staged:
                rows = read_many(spark, paths, multi_line)
            commit_load(rows, None, out_dir, batch_id, as_of, staged=staged)

    return (
        _limited(files, max_files).load(in_dir).select("path").writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_process(
    spark: SparkSession, load_dir: str, case_types: DataFrame, out_dir: str, checkpoint: str, version: str = "v2",
    schema: T.StructType = LANDING_SCHEMA, max_files: int | None = None, buckets: int = BUCKETS,
) -> StreamingQuery:
    """Turn loads that were not processed yet into ``out_dir/cases``, ``defendants`` and ``plaintiffs``, one folder per batch.

    The stream follows the ledger in ``load_dir``, so a load counts once its commit is done. A
    load is processed once: if its file is loaded again later, the tables stay as they are.
    Only the landing partitions of new loads are read. The first row of a case wins over all batches.
    The check runs against the written cases, of which only the buckets of a batch's own case ids are read,
    not against stream state, so nothing accumulates in memory. ``buckets`` of the cases are fixed by the first run. ``max_files`` cuts a backlog into micro-batches of that many ledger files.
    """
    load_dir, out_dir = load_dir.rstrip("/"), out_dir.rstrip("/")
    versioned = T.StructType([*LEDGER_SCHEMA.fields, T.StructField("version", T.LongType())])
    events = _limited(spark.readStream.schema(versioned), max_files).parquet(f"{load_dir}/ledger").select("load_id", "load_status")

    def write(df: DataFrame, name: str, batch_id: int) -> None:
        replace_parts(df.withColumn("batch_id", F.lit(batch_id).cast("bigint")), f"{out_dir}/{name}", ["batch_id"])

    def earlier(like: DataFrame, name: str, batch_id: int) -> DataFrame:
        stored = T.StructType([*like.schema.fields, T.StructField("batch_id", T.LongType())])
        return existing_table(like.sparkSession, f"{out_dir}/{name}", stored).where(F.col("batch_id") < batch_id)

    def process(batch: DataFrame, batch_id: int) -> None:
        completed = batch.where(F.col("load_status") == "completed").select("load_id").distinct()
        todo = stage(drop_matching(completed, earlier(completed, "processed_loads", batch_id), "load_id", unique=True), "open-loads")
        landed = existing_table(batch.sparkSession, f"{load_dir}/landing", schema)
        # a stream of files is read as it was defined, so the columns are chosen here
        rows = filter_loads(landed, todo).select(*PROCESSED_COLUMNS)
        fresh, known = first_wins_into(
            f"{out_dir}/cases", accept_cases(rows, case_types, version), "row_id", ["source_id", "category"], batch_id,
            seen=rows.select(to_bigint(F.col("id")).alias("row_id")), buckets=buckets,
        )
        accepted = fresh.select("row_id").union(known)
        for name, column in (("defendants", "defendant"), ("plaintiffs", "plaintiff")):
            write(party_rows(rows, accepted, column), name, batch_id)
        write(todo, "processed_loads", batch_id)

    return (
        events.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
