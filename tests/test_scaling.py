"""Steps whose cost must not grow faster than their input."""

import datetime as dt
import glob

from pyspark.sql import functions as F

from checks import jobs
from checks.fixtures import Data
from checks.jobs import _files
from recordloom.functions.dates import safe_to_date
from recordloom.plans import enrichment, lineage, loads
from recordloom.schemas import CASE_FILE_COLUMNS
from recordloom.session import note_staged, release, scratch_path, shared_dir, stage
from recordloom.sources import bucketed, csv, tables
from recordloom.streaming import ingest

AS_OF = "2024-03-01 00:00:00"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_level_of_a_closure_is_broadcast(spark, rows, monkeypatch):
    plans, write = [], lineage._write_level
    monkeypatch.setattr(lineage, "_write_level", lambda level, path: plans.append(plan(level)) or write(level, path))
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "upstream_dataset_id int, downstream_dataset_id int")
    found = lineage.lineage_closure(edges, spark.createDataFrame([(1,)], "dataset_id int"))
    assert rows(found) == [(1, 2, 1), (1, 3, 2), (1, 4, 3)]
    assert len(plans) == 5 and not [p for p in plans[1:] if "Broadcast" in p]


def test_enriched_tables_are_built_once(spark, rows):
    stamps = "created_at date, updated_at date"
    agency = spark.createDataFrame([("a", "One", "O", None, None, None, None)], f"agency_id string, name string, acronym string, description string, contact_email string, {stamps}")
    dataset = spark.createDataFrame([("d", "part-1", "old", None, None, None, None, None, None, None, None)], (
        "dataset_id string, source_identifier string, title string, description string, agency_id string, landing_page string, "
        f"license string, public_access_level string, {stamps}, harvest_timestamp date"))
    distribution = spark.createDataFrame([("f", "d", "u1", "t")], "distribution_id string, dataset_id string, download_url string, title string")
    batch = spark.createDataFrame([("part-1",), ("new-1",)], "source_identifier string").selectExpr(
        "source_identifier", "'x' AS title", "'x' AS description", "'ONE' AS agency_name", "'x' AS landing_page", "'x' AS license", "'x' AS public_access_level", "'u1' AS download_url")
    changes = {"dataset": batch.drop("download_url"), "distribution": batch.select("source_identifier", "download_url", "title")}
    after = enrichment.enrich_datasets({"agency": agency, "dataset": dataset, "distribution": distribution}, changes, AS_OF)
    assert rows(after["dataset"], "source_identifier", "title") == [("new-1", "x"), ("part-1", "x")]
    assert rows(after["distribution"], "title") == [("t",), ("x",)]
    assert not [name for name in changes if "Join" in plan(after[name])]


def record(i, caption):
    return ",".join({"id": str(i), "row_num": str(i), "caption": caption}.get(c, "NA") for c in CASE_FILE_COLUMNS) + "\n"


def test_a_large_file_is_read_in_splits(spark, tmp_path, rows, monkeypatch):
    files, head = tmp_path / "in", ",".join(CASE_FILE_COLUMNS) + "\n"
    files.mkdir()
    for name, n, offset in (("small {1} [a].csv", 5, 0), ("large*.csv", 400, 100)):
        (files / name).write_text(head + "".join(record(i + offset, f'"line, {i}\n""second"""') for i in range(n)))
    batch, ledger = loads.load_files(spark, str(files), loads.empty_ledger(spark), AS_OF)
    columns = [*CASE_FILE_COLUMNS, "load_id"]
    expected = rows(batch, *columns), rows(ledger, "file_name", "rows_loaded")
    assert [r[1] for r in expected[1]] == [400, 5]
    monkeypatch.setattr(csv, "WHOLE_BYTES", 5000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        assert csv.read_many(spark, str(files)).rdd.getNumPartitions() > 5
        landing, ledger = loads.load_files(spark, str(files), loads.empty_ledger(spark), AS_OF)
        assert (rows(landing, *columns), rows(ledger, "file_name", "rows_loaded")) == expected
        out = str(tmp_path / "out")
        ingest.stream_load(spark, str(files), out, f"{out}-state", AS_OF).awaitTermination()
        assert (rows(loads.read_landing(spark, out), *columns), rows(loads.read_ledger(spark, out), "file_name", "rows_loaded")) == expected
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_record_files_hold_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("checks.jobs.FILE_ROWS", 100)
    day = dt.datetime(1996, 1, 2)
    spark.createDataFrame([(i, 1, "O", day, "1-URGENT") for i in range(2000)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "Customer", 3)], "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    read = csv.read_many(spark, f"{_files(Data(spark, str(tmp_path)))}/*.csv").groupBy("file_name").count().collect()
    assert sum(r["count"] for r in read) == 2000 and max(r["count"] for r in read) < 200


def test_landing_files_do_not_grow_with_tasks(spark, tmp_path):
    path, rows = str(tmp_path / "landing"), spark.range(0, 4000, 1, 8).select(F.col("id").cast("string").alias("id"), (F.col("id") % 5).alias("load_id"))
    for mode, n in (("replace", 1), ("replace", 1), ("append", 2)):
        landed = tables.append_landing(rows, path, mode)
        assert {(r["load_id"], r["count"]) for r in landed.groupBy("load_id").count().collect()} == {(i, 800 * n) for i in range(5)}
        assert len(glob.glob(f"{path}/load_id=*/*.parquet")) == 5 * n


def test_first_rows_are_written_to_the_buckets_alone(spark, tmp_path, rows, monkeypatch):
    staged, stage = [], bucketed.stage
    monkeypatch.setattr(bucketed, "stage", lambda df, name: staged.append(name) or stage(df, name))
    path, names = str(tmp_path / "t"), "k long, v string"
    fresh, known = bucketed.first_wins_into(path, spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], names), "k", ["v"], 0, seen=spark.range(1, 5).toDF("k"))
    assert rows(fresh) == [(1, "a"), (2, "c")] and rows(known) == []
    fresh, known = bucketed.first_wins_into(path, spark.createDataFrame([(2, "x"), (3, "y")], names), "k", ["v"], 1, seen=spark.range(1, 5).toDF("k"))
    assert rows(fresh) == [(3, "y")] and rows(known) == [(1,), (2,)]
    fresh, _ = bucketed.first_wins_into(path, spark.createDataFrame([(2, "x")], names), "k", ["v"], 2, seen=spark.range(1, 5).toDF("k"))
    assert rows(fresh) == [] and staged == ["keys", "known-keys"] * 3


def test_dates_are_read_without_a_parser_that_raises(spark):
    texts = {
        "2020-2-3": "2020-02-03", "  2021-1-1 12:00": "2021-01-01", "20200105": "2020-01-05", "5-1-1": "0005-01-01", "0-1-1": "0000-01-01",
        "2000-02-29": "2000-02-29", "1900-02-29": None, "2020-02-30": None, "2020-13-01": None, "2020-01": None, "": None, "NA": None, None: None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", safe_to_date(F.col("t")).cast("string").alias("d"))
    assert {r["t"]: r["d"] for r in df.collect()} == texts
    assert "gettimestamp" not in plan(df)


def test_a_commit_builds_its_rows_once(spark, tmp_path, rows):
    built = spark.sparkContext.accumulator(0)
    load = F.udf(lambda i: built.add(1) or i % 3, "bigint")
    source = spark.range(30).select(F.col("id").alias("source_id"), load("id").alias("load_id"))
    for version, late in enumerate((False, True)):
        jobs._commit(source, (F.col("source_id") >= 30) == late, str(tmp_path), version)
    assert built.value == 30
    assert rows(loads.read_ledger(spark, str(tmp_path)), "load_id", "rows_loaded", "load_status") == [(i, 10, "completed") for i in range(3)]


def record_files(folder, files=6, n=30, caption="plain"):
    folder.mkdir()
    for f in range(files):
        text = "".join(record(f * n + i, caption) for i in range(n))
        (folder / f"{f}.csv").write_text(",".join(CASE_FILE_COLUMNS) + "\n" + text)
    return str(folder)


def scratch_tables(spark):
    return set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/recordloom/{spark.sparkContext.applicationId}/*"))


def test_released_tables_are_those_that_were_noted(spark):
    with note_staged() as outer:
        first = stage(spark.range(3), "first")
        with note_staged() as inner:
            stage(spark.range(3), "second")
        inner_path = inner[0]
        after = scratch_path(spark, "third")
    before = scratch_tables(spark)
    assert outer == [*outer[:1], inner_path, after] and len(inner) == 1
    release(spark, inner)
    release(spark, [after])  # was never written
    assert before - scratch_tables(spark) == {inner_path} and first.count() == 3
    stage(spark.range(1), "fourth")
    assert len(outer) == 3


def test_a_load_leaves_nothing_staged(spark, tmp_path, rows):
    files, out, before = record_files(tmp_path / "in", caption='"a\nb"'), str(tmp_path / "out"), scratch_tables(spark)
    columns = [*CASE_FILE_COLUMNS, "load_id"]
    landed, ledger = loads.run_load(spark, files, out, AS_OF)
    first = rows(landed, *columns)
    left = scratch_tables(spark) - before
    assert len(first) == 180 and all("/pruning-keys-" in t for t in left)  # of the landing that is returned
    landed, ledger = loads.run_load(spark, files, out, AS_OF, multi_line=False)
    assert rows(landed, *columns) == first
    assert rows(ledger, "load_id", "rows_loaded") == [(i, 30) for i in range(1, 7)]
    ingest.stream_load(spark, files, f"{out}-stream", f"{out}-state", AS_OF, multi_line=False).awaitTermination()
    assert rows(loads.read_landing(spark, f"{out}-stream"), *columns) == first
    assert all("/pruning-keys-" in t for t in scratch_tables(spark) - before)


def test_text_in_splits_is_released_once_it_is_parsed(spark, tmp_path, rows, monkeypatch):
    files, before, seen, land = record_files(tmp_path / "in"), scratch_tables(spark), [], loads.append_landing
    monkeypatch.setattr(loads, "append_landing", lambda *a: seen.extend(scratch_tables(spark) - before) or land(*a))
    loads.run_load(spark, files, str(tmp_path / "out"), AS_OF, multi_line=False)
    assert {t.rpartition("/")[2].rpartition("-")[0] for t in seen} == {"parsed", "load-spans", "load-counts"}
    batch, _ = loads.load_files(spark, files, loads.empty_ledger(spark), AS_OF, multi_line=False)
    assert batch.count() == 180 and not [t for t in scratch_tables(spark) - before if "/lines-" in t or "/states-" in t]


def test_rows_that_lie_by_load_land_without_a_shuffle(spark, tmp_path, rows, monkeypatch):
    files, plans, replace = record_files(tmp_path / "in", 12, 40), [], tables.replace_parts
    monkeypatch.setattr(tables, "replace_parts", lambda df, path, *a: (path.endswith("/landing") and plans.append(plan(df))) or replace(df, path, *a))
    expected, listed = None, loads.list_files(spark, files)
    for name, read in {"whole": csv.read_many(spark, files), "splits": csv.read_many(spark, files, False), "dealt": csv.read_many(spark, files).repartition(16)}.items():
        out = str(tmp_path / name)
        loads.commit_load(read, listed, out, 0, AS_OF)
        landed = rows(loads.read_landing(spark, out), "id", "load_id", "row_num", "caption")
        expected = expected or landed
        assert landed == expected and len(landed) == 480
        assert rows(spark.read.parquet(f"{out}/landing"), "source_id") == sorted([(i,) for i in range(1, 481)], key=str)
        assert len(glob.glob(f"{out}/landing/load_id=*/*.parquet")) <= 2 * 12
    assert ["REBALANCE" in p for p in plans] == [False, False, True]


def test_record_files_are_dealt_before_they_are_wide(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, 1, "O", dt.datetime(1996, 1, 2), "1-URGENT") for i in range(50)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "Customer", 3)], "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    written, write = [], csv.write_cases_csv
    monkeypatch.setattr(csv, "write_cases_csv", lambda df, path: written.append(df) or write(df, path))
    _files(Data(spark, str(tmp_path)))
    steps = plan(written[0])
    assert 0 <= steps.index(" matter number ") < steps.index("REPARTITION_BY_NUM")
    assert sorted(written[0].collect()) == sorted(Data(spark, str(tmp_path)).src().collect())


def test_landed_rows_stay_in_place_when_loads_are_counted(spark, rows):
    landing = spark.range(40).select(*[F.col("id").cast("string").alias(c) for c in CASE_FILE_COLUMNS], (F.col("id") % 4).alias("load_id"), F.col("id").alias("source_id"))
    ledger = spark.createDataFrame([(0, 10, "completed"), (1, 9, "completed"), (2, 10, "failed")], "load_id long, rows_loaded long, load_status string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        landed = jobs._landed(stage(landing, "landing"), ledger)
        assert "SortMergeJoin" not in plan(landed) and "BroadcastHashJoin" in plan(landed)
        assert rows(landed.groupBy("counted", "numbers").count()) == [(False, 40, 10), (True, 40, 10)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
