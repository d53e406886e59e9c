"""Load ledger, landing of record files and incremental processing of loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.labels import label_subtype
from recordloom.functions.text import to_bigint
from recordloom.operators.audit import StepCounter
from recordloom.operators.filters import filter_in, filter_loads, null_sentinels
from recordloom.operators.joins import drop_matching, keep_matching, lookup_join
from recordloom.operators.merge import pick_first, update_where, upsert
from recordloom.operators.parties import unnest_party
from recordloom.plans.cases import is_excluded_system, label_with_lookup, project_case
from recordloom.schemas import (
    CASE_FILE_COLUMNS,
    CIVIL_SUBTYPES,
    CLEANED_COLUMNS,
    FAILED_LOAD_MESSAGE,
    LANDING_SCHEMA,
    LEDGER_SCHEMA,
)
from recordloom.session import SMALL_CODEC, note_staged, release, scratch_path, stage
from recordloom.sources.csv import read_many
from recordloom.sources.tables import (
    append_landing,
    existing_table,
    next_version,
    number_stored,
    read_newest,
    stored_with_positions,
    write_version,
)


NUMBERS_SCHEMA = T.StructType([T.StructField("name", T.StringType()), T.StructField("last_source_id", T.LongType())])


def _time(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(file_name, file_path, file_size_bytes)`` of every file, also of one without rows."""
    return spark.read.format("binaryFile").load(paths).select(
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_size_bytes"),
    )


def start_loads(ledger: DataFrame, files: DataFrame, as_of: str) -> DataFrame:
    """Ledger with every file marked ``started``: a known name keeps its load id, a new one gets the next.

    Only files, never records, are numbered here.
    """
    newest = ledger.agg(F.coalesce(F.max("load_id"), F.lit(0).cast("bigint")).alias("m")).scalar()
    unknown = files.join(ledger.select("file_name"), "file_name", "left_anti")
    fresh = unknown.withColumn("load_id", newest + F.row_number().over(Window.orderBy("file_name")))
    batch = files.join(fresh.select("file_name", "load_id"), "file_name", "left").withColumns(
        {"load_started_at": _time(as_of), "load_status": F.lit("started")}
    )
    return upsert(ledger, batch, ["file_name"], ["load_started_at", "load_status"])


def finish_loads(ledger: DataFrame, counts: DataFrame, as_of: str, mode: str = "replace") -> DataFrame:
    """Ledger with the outcome of each load in ``counts (load_id, good_rows, bad_rows)``.

    A load with any malformed record fails as a whole and lands no row.
    """
    landed = F.coalesce("good_rows", F.lit(0).cast("bigint"))
    if mode == "append":
        landed = landed + F.coalesce("rows_loaded", F.lit(0).cast("bigint"))
    done = ledger.join(counts, "load_id", "left")
    failed = F.col("bad_rows") > 0
    done = done.withColumns({
        "rows_loaded": F.when(failed | F.col("bad_rows").isNull(), F.col("rows_loaded")).otherwise(landed),
        "load_completed_at": F.when(failed | F.col("bad_rows").isNull(), F.col("load_completed_at")).otherwise(_time(as_of)),
        "load_status": F.when(failed, "failed").when(F.col("bad_rows").isNull(), F.col("load_status")).otherwise("completed"),
        "error_message": F.when(failed, FAILED_LOAD_MESSAGE).otherwise(F.col("error_message")),
    })
    return done.select(*LEDGER_SCHEMA.names)


def stamp_load(df: DataFrame, load_id: int) -> DataFrame:
    """Rows that have no load id yet belong to this load."""
    return update_where(df, F.col("load_id").isNull(), {"load_id": F.lit(load_id).cast(df.schema["load_id"].dataType)})


def land_rows(
    rows: DataFrame, files: DataFrame | None, ledger: DataFrame, as_of: str, mode: str = "replace", start_id: int = 0,
    staged: list[str] = (),
) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """``(landing rows, ledger, counts, by_load)`` for scanned rows that carry their file and ``is_bad``; one count row per load of the run.

    The text is parsed once: the rows are staged, and the outcome of each load, the row
    numbers and the landing rows all come from there. ``files`` may list files without
    rows; by default the files of the rows are taken. The file name identifies a load,
    so files of one name in several folders are one load. ``staged`` are tables that only the rows are made of; they are deleted
    once the rows are written. ``by_load`` tells whether the landing rows of a load lie together, as those of files
    that are read in their order do.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "parsed")
    rows.write.parquet(path, compression=SMALL_CODEC)
    release(spark, staged)
    stored = stored_with_positions(spark, path, rows.schema)
    if files is None:
        files = stage(stored.select("file_name", "file_path", "file_size_bytes").distinct(), "load-files")
    files = pick_first(files, ["file_name"], ["file_path"])
    started = start_loads(ledger, files, as_of)
    spans = stored.groupBy("file_name", "_file").agg(F.count_if(~F.col("is_bad")).alias("good_rows"), F.count_if("is_bad").alias("bad_rows"))
    spans = stage(spans, "load-spans")
    per_file = spans.groupBy("file_name").agg(F.sum("good_rows").alias("good_rows"), F.sum("bad_rows").alias("bad_rows"))
    found = spans.agg(F.count("*").alias("spans"), F.countDistinct("file_name").alias("loads"), F.countDistinct("_file").alias("parts")).first()
    # loads that follow each other through the parts are cut into fewer spans than there are loads and parts
    by_load = found["spans"] <= 2 * (found["loads"] + found["parts"])
    zero = F.lit(0).cast("bigint")
    counts = stage(
        files.select("file_name").join(started, "file_name").join(per_file, "file_name", "left").select(
            "load_id", "file_name",
            F.coalesce("good_rows", zero).alias("good_rows"), F.coalesce("bad_rows", zero).alias("bad_rows"),
        ),
        "load-counts",
    )
    done = finish_loads(started, counts.drop("file_name"), as_of, mode)
    good = counts.where(F.col("bad_rows") == 0).select("file_name", "load_id")
    landing = lookup_join(number_stored(stored, start_id), good, "file_name", "inner")
    return landing.select(*CASE_FILE_COLUMNS, _time(as_of).alias("loaded_at"), "source_id", "load_id"), done, counts, by_load


def load_files(
    spark: SparkSession, paths: str | list[str], ledger: DataFrame, as_of: str, mode: str = "replace",
    start_id: int = 0, multi_line: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Scan all files at once: ``(landing rows with load_id, ledger with outcomes)``.

    The files are listed before they are read: one that arrives in between is left to the next run.
    """
    files = list_files(spark, paths)
    with note_staged() as staged:
        rows = read_many(spark, paths, multi_line)
    return land_rows(rows, files, ledger, as_of, mode, start_id, staged)[:2]


def commit_load(
    rows: DataFrame, files: DataFrame | None, out_dir: str, version: int, as_of: str, mode: str = "replace",
    staged: list[str] = (),
) -> None:
    """Land scanned rows in ``out_dir/landing`` and add version ``version`` to ``out_dir/ledger``.

    A version holds the loads of this run only, and the last row number is written down, so
    a commit costs what its files cost, whatever was landed before.

    Runs again safely: until the ledger version is there, a second run gives the same
    files the same load ids and replaces what the first one landed.

    What it stages is deleted in the end, and ``staged``, tables that only the rows are made of, once the rows are written.
    """
    spark, out_dir = rows.sparkSession, out_dir.rstrip("/")
    ledger = read_ledger(spark, out_dir, before=version)
    last = read_newest(spark, f"{out_dir}/numbers", NUMBERS_SCHEMA, "name", before=version).first()
    with note_staged() as own:
        landing, after, counts, by_load = land_rows(rows, files, ledger, as_of, mode, last["last_source_id"] if last else 0, staged)
    append_landing(landing, f"{out_dir}/landing", mode, by_load)
    used = counts.agg((F.lit(last["last_source_id"] if last else 0) + F.coalesce(F.sum(F.col("good_rows") + F.col("bad_rows")), F.lit(0))).alias("last_source_id"))
    write_version(used.select(F.lit("source_id").alias("name"), "last_source_id"), f"{out_dir}/numbers", version)
    write_version(keep_matching(after, counts, "load_id", unique=True), f"{out_dir}/ledger", version)
    release(spark, own)


def run_load(
    spark: SparkSession, paths: str | list[str], out_dir: str, as_of: str, mode: str = "replace", multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """The whole load job: files to ``out_dir/landing`` and ``out_dir/ledger``, which it returns."""
    out_dir = out_dir.rstrip("/")
    version = next_version(spark, f"{out_dir}/ledger", LEDGER_SCHEMA)
    files = list_files(spark, paths)
    with note_staged() as staged:
        rows = read_many(spark, paths, multi_line)
    commit_load(rows, files, out_dir, version, as_of, mode, staged)
    return read_landing(spark, out_dir), read_ledger(spark, out_dir)


def read_ledger(spark: SparkSession, out_dir: str, before: int | None = None) -> DataFrame:
    """The ledger after all runs, or after those whose version is below ``before``."""
    return read_newest(spark, f"{out_dir.rstrip('/')}/ledger", LEDGER_SCHEMA, "load_id", before)


def read_landing(spark: SparkSession, out_dir: str) -> DataFrame:
    """Landed rows of the loads that the ledger knows to hold rows.

    Leaves out what an interrupted run landed, and the old rows of a file that is empty by now.
    """
    out_dir = out_dir.rstrip("/")
    ledger = read_ledger(spark, out_dir)
    landed = existing_table(spark, f"{out_dir}/landing", LANDING_SCHEMA)
    return filter_loads(landed, ledger.where(F.col("rows_loaded") > 0).select("load_id")).select(*LANDING_SCHEMA.names)


def unprocessed_loads(ledger: DataFrame, cases: DataFrame) -> DataFrame:
    """``load_id`` of completed loads of which no row became a case yet; cases know their load."""
    completed = ledger.where(F.col("load_status") == "completed").select("load_id")
    return drop_matching(completed, cases, "load_id")


def accept_cases(rows: DataFrame, case_types: DataFrame, version: str = "v2") -> DataFrame:
    """Case rows, with ``source_id`` and ``load_id``, that the incremental rules accept.

    ``v1`` keeps the civil subtypes, ``v2`` all. Empty text counts as missing here,
    also for ``cjis``. May hold several rows per ``row_id``.
    """
    labelled = label_with_lookup(rows, case_types)
    if version == "v1":
        labelled = filter_in(labelled, "subtype", CIVIL_SUBTYPES)
    labelled = labelled.withColumn("category", label_subtype(F.col("subtype"), "A" if version == "v1" else "V2"))
    kept = null_sentinels(labelled, CLEANED_COLUMNS, ("NA", "")).where(
        ~is_excluded_system() & F.col("cjis").isNull()
    )
    return project_case(kept, carry=["source_id", "load_id"])


def party_rows(rows: DataFrame, cases: DataFrame, column: str) -> DataFrame:
    """Party rows of source rows whose id is an accepted case."""
    keyed = rows.withColumn("row_id", to_bigint(F.col("id")))
    return unnest_party(keep_matching(keyed, cases, "row_id", unique=True), column)


def process_loads(
    source: DataFrame, case_types: DataFrame, cases: DataFrame, loads: DataFrame | list[int], version: str = "v2",
    counter: StepCounter | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(cases after, new defendants, new plaintiffs)`` for the given loads.

    The first source row of a case wins, across loads and within one. The new cases
    are staged once because all three results build on them. A landing table partitioned by load is
    read only where ``loads`` are, however many there are: their ids prune the scan as it runs. A ``counter``
    gets the rows of each step up to the new cases as these are written.
    """
    rows = filter_loads(source, loads)
    watch = counter.watch if counter else lambda df, step: df
    accepted = watch(accept_cases(watch(rows, "load_rows"), case_types, version), "accepted")
    batch = watch(pick_first(accepted, ["row_id"], ["source_id", "category"]), "first_rows")
    fresh = stage(watch(drop_matching(batch, cases, "row_id", unique=True), "new_cases"), "new-cases")
    after = cases.unionByName(fresh)
    return after, party_rows(rows, after, "defendant"), party_rows(rows, after, "plaintiff")
