"""File sources and sinks, load jobs and streams: each writes to the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks.court import finals
from checks.fixtures import CASE_COLUMNS, KEPT_SYSTEM, LABEL, NA_EMPTY_REPLACED, Data, party_sql
from checks.registry import query
from recordloom.operators import filters
from recordloom.operators.joins import lookup_join
from recordloom.operators.quality import union_all
from recordloom.plans import cases as plan
from recordloom.plans import loads
from recordloom.schemas import CASE_FILE_COLUMNS, LEDGER_SCHEMA, LOOKUP_FILE_COLUMNS
from recordloom.session import scratch_path, stage
from recordloom.sources import bucketed, csv, tables
from recordloom.streaming import ingest

AS_OF = "2024-03-01 00:00:00"
FILE_ROWS = 100_000


def _files(d: Data) -> str:
    """Record files of the case rows, eight at least and more for more rows."""
    path = scratch_path(d.spark, "record-files")
    files = max(8, -(-d.table("orders").count() // FILE_ROWS))
    csv.write_cases_csv(d.src(files), path)
    return path


# --- sources and sinks -----------------------------------------------------------------------

@query("SELECT " + ", ".join(f"nullif({c}, 'NA') AS {c}" for c in CASE_FILE_COLUMNS) + " FROM src")
def scan_cases_csv(d):
    path = scratch_path(d.spark, "cases-csv")
    csv.write_cases_csv(d.src(), path)
    return csv.read_cases_csv(d.spark, path)


@query("""SELECT p_size AS case_count, concat('TYPE ', cast(p_partkey as varchar)) AS case_type, p_brand AS subtype,
                 concat(p_name, ', "', p_type, '"') AS notes, '' AS col5, CAST(NULL AS VARCHAR) AS col6, cast(p_retailprice as varchar) AS col7 FROM part""")
def scan_lookup_csv(d):
    """A lookup file with carriage returns and its header line repeated between the rows."""
    path = scratch_path(d.spark, "lookup-csv")
    row = F.struct(
        F.col("p_size").cast("string").alias("case_count"),
        F.concat(F.lit("TYPE "), F.col("p_partkey").cast("string")).alias("case_type"),
        F.col("p_brand").alias("subtype"),
        F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')).alias("notes"),
        F.lit("").alias("col5"), F.lit("NA").alias("col6"),
        F.concat(F.col("p_retailprice").cast("string"), F.lit("\r")).alias("col7"),
    )
    header = F.struct(*[F.lit(c).alias(c) for c in LOOKUP_FILE_COLUMNS[:-1]], F.lit("col7\r").alias("col7"))
    lines = F.when(F.col("p_size") > 45, F.array(row, header)).otherwise(F.array(row))
    d.table("part").select(F.inline(lines)).write.options(header="true", quote='"', escape='"').csv(path)
    return csv.read_lookup_csv(d.spark, path)


@query("SELECT load_id, " + ", ".join(f"nullif({c}, 'NA') AS {c}" for c in CASE_FILE_COLUMNS) + ", true AS has_file FROM src")
def scan_many_files(d):
    path = scratch_path(d.spark, "record-files")
    csv.write_cases_csv(d.src(), path, by="load_id")
    rows = csv.read_many(d.spark, f"{path}/*/*.csv").where(~F.col("is_bad"))
    return rows.select(
        F.regexp_extract("file_path", r"load_id=(\d+)/", 1).cast("int").alias("load_id"), *CASE_FILE_COLUMNS,
        (F.col("file_name").endswith(".csv") & (F.col("file_size_bytes") > 0)).alias("has_file"),
    )


@query("SELECT * FROM final_cases")
def materialize_table(d):
    """Written twice: the second write replaces the first."""
    path = scratch_path(d.spark, "final-cases")
    cases = finals(d)[0]
    tables.materialize(cases.where(F.col("category").isNull()), path)
    return tables.materialize(cases, path)


@query("SELECT p_partkey, p_brand AS subtype FROM part")
def overwrite_lookup(d):
    path = scratch_path(d.spark, "lookup")
    tables.overwrite_lookup(d.table("part").select("p_partkey", F.col("p_type").alias("subtype")), path)
    return tables.overwrite_lookup(d.table("part").select("p_partkey", F.col("p_brand").alias("subtype")), path)


@query("SELECT load_id, id, case_number FROM src")
def append_landing(d):
    """Some loads are landed twice, which replaces them."""
    path = scratch_path(d.spark, "landing")
    rows = d.src().select("id", "case_number", "load_id")
    tables.append_landing(rows, path)
    repeated = rows.join(d.gov("file_load").where("load_status = 'failed'").select("load_id"), "load_id", "left_semi")
    return tables.append_landing(repeated.select(*rows.columns), path)


@query("""SELECT o_orderstatus, v.label, count(*) AS row_count FROM orders
          JOIN (VALUES ('F', 'finished', 1), ('O', 'open', 2), ('P', NULL, 3)) AS v(code, label, rank) ON v.code = o_orderstatus GROUP BY 1, 2""")
def constant_relation(d):
    labels = tables.values_df(
        d.spark, [("F", "finished", 1), ("O", "open", 2), ("P", None, 3)], "o_orderstatus string, label string, rank int"
    )
    return d.table("orders").join(labels, "o_orderstatus").groupBy("o_orderstatus", "label").agg(F.count("*").alias("row_count"))


@query("SELECT * REPLACE (CAST(o_orderdate AS VARCHAR) AS o_orderdate) FROM orders")
def read_table_source(d):
    return tables.read_table(d.spark, "parquet", path=f"{d.sf_dir}/orders.parquet")


@query("SELECT count(*) AS row_count, count(*) AS numbers, 1 AS first_number, count(*) AS last_number FROM events")
def number_landed_rows(d):
    numbered = tables.number_rows(d.table("events").repartition(4, "event_id"), scratch_path(d.spark, "numbered"))
    return numbered.agg(
        F.count("*").alias("row_count"), F.countDistinct("source_id").alias("numbers"),
        F.min("source_id").cast("int").alias("first_number"), F.max("source_id").alias("last_number"),
    )


# --- loads -----------------------------------------------------------------------------------

_LANDED = "SELECT " + ", ".join(f"nullif({c}, 'NA') AS {c}" for c in CASE_FILE_COLUMNS) + """, true AS counted,
    (SELECT count(*) FROM src) AS numbers FROM src"""


def _landed(landing: DataFrame, ledger: DataFrame) -> DataFrame:
    """All cells; whether the ledger counts the rows of the load; how many row numbers there are."""
    per_load = landing.groupBy("load_id").agg(F.count("*").alias("n"))
    counted = per_load.join(ledger.where("load_status = 'completed'"), "load_id").select("load_id", (F.col("n") == F.col("rows_loaded")).alias("counted"))
    numbers = landing.agg(F.countDistinct("source_id").alias("numbers")).scalar()
    return lookup_join(landing, stage(counted, "counted"), "load_id", "inner").select(*CASE_FILE_COLUMNS, "counted", numbers.alias("numbers"))


@query(_LANDED)
def load_files(d):
    landing, ledger = loads.load_files(d.spark, f"{_files(d)}/*.csv", loads.empty_ledger(d.spark), AS_OF)
    return _landed(stage(landing, "landing"), ledger)


@query(_LANDED)
def load_files_again(d):
    """The whole load job twice over the same files: load ids are kept and rows replaced."""
    path, out = _files(d), scratch_path(d.spark, "loaded")
    loads.run_load(d.spark, f"{path}/*.csv", out, AS_OF)
    return _landed(*loads.run_load(d.spark, f"{path}/*.csv", out, AS_OF, multi_line=False))


def _runs(d: Data, version: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First the started loads and the small completed ones, then whatever completed load has no case yet."""
    source, ledger = d.amended(), d.gov("file_load")
    first = ledger.where("load_status = 'started' or (load_status = 'completed' and rows_loaded < 3)").select("load_id")
    none = loads.accept_cases(source, d.ct(), version).where(F.lit(False))
    cases, _, _ = loads.process_loads(source, d.ct(), none, first, version)
    open_loads = loads.unprocessed_loads(ledger, cases)
    return loads.process_loads(source, d.ct(), cases, open_loads, version)


@query("SELECT * FROM processed_v1")
def process_loads_v1(d):
    return _runs(d, "v1")[0]


@query("SELECT * FROM processed_v2")
def process_loads_v2(d):
    return _runs(d, "v2")[0]


@query(party_sql("second_run_v2", "defendant"))
def process_loads_defendants(d):
    return _runs(d, "v2")[1]


@query(party_sql("second_run_v1", "plaintiff"))
def process_loads_plaintiffs(d):
    return _runs(d, "v1")[2]


# --- streams ---------------------------------------------------------------------------------

@query(_LANDED)
def stream_load(d):
    """Started twice: the second run finds nothing new."""
    path, out, checkpoint = _files(d), scratch_path(d.spark, "stream"), scratch_path(d.spark, "stream-state")
    for _ in range(2):
        ingest.stream_load(d.spark, path, out, checkpoint, AS_OF).awaitTermination()
    return _landed(loads.read_landing(d.spark, out), loads.read_ledger(d.spark, out))


def _commit(rows: DataFrame, chosen: Column, out: str, version: int) -> None:
    """Land the chosen rows and note their loads, which hold no others, as completed; they are counted where they landed."""
    landed = tables.append_landing(rows.where(chosen), f"{out}/landing")
    done = landed.where(chosen).groupBy("load_id").agg(F.count("*").alias("rows_loaded")).withColumn("load_status", F.lit("completed"))
    known = {f.name: F.col(f.name) if f.name in done.columns else F.lit(None) for f in LEDGER_SCHEMA.fields}
    ledger = done.select(*[known[f.name].cast(f.dataType).alias(f.name) for f in LEDGER_SCHEMA.fields])
    tables.write_version(ledger, f"{out}/ledger", version)


def _streamed(d: Data) -> str:
    """The rows of the record files as first batch, the amended ones, which come as other loads, as second.

    Then all first loads come once more: they were processed, so nothing changes.
    """
    loaded, out, checkpoint = (scratch_path(d.spark, n) for n in ("loaded", "stream", "stream-state"))
    rows = d.amended()
    rows = rows.withColumn("load_id", F.col("load_id") + F.when(F.col("source_id") >= 10**12, 100).otherwise(0))
    for version, late in enumerate((False, True, False)):
        _commit(rows, (F.col("source_id") >= 10**12) == late, loaded, version)
        ingest.stream_process(d.spark, loaded, d.ct(), out, checkpoint, schema=rows.schema).awaitTermination()
    return out


_STREAM_ACCEPTED = """all_labelled AS (SELECT s.* REPLACE (CASE WHEN source_id >= 1000000000000 THEN load_id + 100 ELSE load_id END AS load_id),
    1 AS run, c.subtype FROM amended_src s LEFT JOIN ct c ON s.case_type = c.case_type)"""


def _stream_sql(select: str) -> str:
    rest = "WHEN 'X' THEN 'OTHER CIVIL' ELSE CASE WHEN subtype IS NULL THEN 'NO INFORMATION' ELSE 'UNKNOWN' END"
    return f"""WITH {_STREAM_ACCEPTED}, accepted AS (
          SELECT {NA_EMPTY_REPLACED} FROM (SELECT *, {LABEL.format(rest=rest)} AS clear_type FROM all_labelled)),
        streamed_cases AS (SELECT source_id, load_id, {CASE_COLUMNS} FROM accepted WHERE {KEPT_SYSTEM} AND cjis IS NULL
          QUALIFY row_number() OVER (PARTITION BY CAST(id AS BIGINT) ORDER BY source_id, clear_type) = 1),
        streamed_rows AS (SELECT * FROM amended_src WHERE CAST(id AS BIGINT) IN (SELECT row_id FROM streamed_cases))
        {select}"""


@query(_stream_sql("SELECT * FROM streamed_cases"))
def stream_process_cases(d):
    return d.spark.read.parquet(f"{_streamed(d)}/cases").drop("batch_id", "bucket")


@query("""SELECT id, source_id, caption, load_id FROM (
            SELECT *, CASE WHEN source_id >= 1000000000000 THEN 1 WHEN status = 'F' THEN 2 ELSE 0 END AS batch FROM amended_src)
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch, source_id) = 1""")
def first_wins_buckets(d):
    """Three batches into a table by buckets: the open cases, the amended rows of finished ones, then all rows."""
    path, rows = scratch_path(d.spark, "first-wins"), d.amended()
    late = F.col("source_id") >= 10**12
    rows = rows.select("id", "source_id", "caption", "load_id", late.alias("late"), F.coalesce(F.col("status") == "F", F.lit(False)).alias("is_finished"))
    rows = stage(rows, "amended")
    columns = ["id", "source_id", "caption", "load_id"]
    for batch_id, batch in enumerate((rows.where("not late and not is_finished"), rows.where("late"), rows.where("not late"))):
        bucketed.first_wins_into(path, batch.select(columns), "id", ["source_id"], batch_id)
    return bucketed.read_buckets(d.spark, path, rows.select(columns).schema)


@query("SELECT s.id, s.load_id, s.caption FROM src s WHERE load_id IN (SELECT load_id FROM gov_file_load WHERE load_status = 'completed')")
def prune_to_loads(d):
    """A landing table partitioned by load, of which a ledger chooses the loads."""
    path = scratch_path(d.spark, "landing")
    landed = tables.materialize(d.src().select("id", "caption", "load_id"), path, ["load_id"])
    return filters.prune_to(landed, d.gov("file_load").where("load_status = 'completed'"), "load_id").select("id", "load_id", "caption")


@query(_stream_sql(party_sql("streamed_rows", "plaintiff")))
def stream_process_plaintiffs(d):
    return d.spark.read.parquet(f"{_streamed(d)}/plaintiffs").drop("batch_id")


@query(_stream_sql(party_sql("streamed_rows", "defendant")))
def stream_process_defendants(d):
    return d.spark.read.parquet(f"{_streamed(d)}/defendants").drop("batch_id")


@query("""SELECT 'final_cases' AS tbl, row_id, concat_ws('|', case_number, caption, court_system, file_date, category) AS cells FROM final_cases
          UNION ALL SELECT 'final_defendants', row_id, concat_ws('|', name, zip, address, org_name, removal_date) FROM final_defendants
          UNION ALL SELECT 'final_plaintiffs', row_id, concat_ws('|', name, zip, address, org_name, removal_date) FROM final_plaintiffs""")
def publish_final_tables(d):
    published = plan.publish(d.src(), d.ct(), scratch_path(d.spark, "published"))
    cells = {"final_cases": ["case_number", "caption", "court_system", "file_date", "category"]}
    party = ["name", "zip", "address", "org_name", "removal_date"]
    return union_all([
        df.select(F.lit(name).alias("tbl"), "row_id", F.concat_ws("|", *[F.col(c).cast("string") for c in cells.get(name, party)]).alias("cells"))
        for name, df in published.items()
    ])
