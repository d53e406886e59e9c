"""Files, loads and streams end to end on small inputs."""

import csv as python_csv
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators.filters import filter_loads
from recordloom.plans import cases, loads
from recordloom.schemas import CASE_FILE_COLUMNS, LEDGER_SCHEMA
from recordloom.sources import csv, tables
from recordloom.streaming import ingest

AS_OF, LATER = "2024-03-01 00:00:00", "2024-03-02 00:00:00"


def line(**values):
    return ",".join(values.get(c, "NA") for c in CASE_FILE_COLUMNS)


def write(path, name, *lines, header=True):
    text = ([",".join(CASE_FILE_COLUMNS)] if header else []) + list(lines)
    (path / name).write_text("\n".join(text) + "\n", encoding="utf-8")


@pytest.fixture
def lookup(spark):
    return tables.values_df(
        spark, [("T", "D"), ("F", "PD"), ("F", "PE"), ("X", "X"), ("NA", "E")], "case_type string, subtype string"
    )


def source(spark, *rows):
    base = {c: None for c in CASE_FILE_COLUMNS}
    data = [tuple({**base, **r}[c] for c in CASE_FILE_COLUMNS) + (r.get("source_id", i), r.get("load_id", 1)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in CASE_FILE_COLUMNS) + ", source_id bigint, load_id bigint")


def test_csv_nulls_quotes_and_newlines(spark, tmp_path):
    write(tmp_path, "a.csv", line(id="1", caption='"a, ""b""\nc"', name="", dob='""', defendant='"{""Name"":""x""}"', court="é"))
    row = csv.read_cases_csv(spark, str(tmp_path)).first().asDict()
    assert (row["caption"], row["name"], row["dob"], row["case_number"]) == ('a, "b"\nc', "", "", None)
    assert (row["defendant"], row["court"]) == ('{"Name":"x"}', "é")


def test_csv_header_is_skipped_not_matched(spark, tmp_path):
    write(tmp_path, "a.csv", "other header," * 28 + "x", line(id="1"), header=False)
    assert [r["id"] for r in csv.read_cases_csv(spark, str(tmp_path)).collect()] == ["1"]


def test_lookup_file(spark, tmp_path, rows):
    text = "case_count,case_type,subtype,notes,col5,col6,col7\r\n5,A,D,,,,\r\ncase_count,case_type,subtype,notes,col5,col6,col7\r\n7,B,NA,n,,,\r\nNA,\"C, d\",X,,,,z\r\n"
    (tmp_path / "l.csv").write_bytes(text.encode())
    assert rows(csv.read_lookup_csv(spark, str(tmp_path)), "case_count", "case_type", "subtype", "col7") == [(None, "C, d", "X", "z"), (5, "A", "D", "")]
    assert rows(csv.lookup_rejects(spark, str(tmp_path)), "case_type") == [("B",)]


def test_load_ledger_over_runs(spark, tmp_path, rows):
    files = tmp_path / "in dir"
    files.mkdir()
    write(files, "Court Data a+b.csv", line(id="1"), line(id="2"))
    write(files, "broken.csv", line(id="3"), "too,few")
    write(files, "empty.csv")
    landing, ledger = loads.load_files(spark, str(files), loads.empty_ledger(spark), AS_OF)
    first = rows(ledger, "file_name", "load_id", "rows_loaded", "load_status", "error_message")
    names = [r[0] for r in first]
    assert [r[1:] for r in first] == [(1, 2, "completed", None), (2, None, "failed", "Copy command failed"), (3, 0, "completed", None)]
    assert rows(landing, "id", "load_id") == [("1", 1), ("2", 1)]
    kept = tables.materialize(ledger, str(tmp_path / "ledger"))
    write(files, "broken.csv", line(id="3"))
    write(files, "another.csv", line(id="4"))
    landing, ledger = loads.load_files(spark, str(files), kept, LATER)
    second = {r[0]: r[1:] for r in rows(ledger, "file_name", "load_id", "rows_loaded", "load_status", "load_started_at")}
    at = dt.datetime(2024, 3, 2)
    assert second[names[0]] == (1, 2, "completed", at) and second["broken.csv"] == (2, 1, "completed", at)
    assert second["another.csv"] == (4, 1, "completed", at)
    assert rows(landing, "id") == [("1",), ("2",), ("3",), ("4",)]


def test_split_reading_keeps_line_breaks(spark, tmp_path, rows):
    write(tmp_path, "good.csv", line(id="1"))
    write(tmp_path, "breaks.csv", line(id="2", caption='"a\nb"'))
    write(tmp_path, "bad.csv", line(id="3"), "too,few")
    for multi_line in (False, True):
        landing, ledger = loads.load_files(spark, str(tmp_path), loads.empty_ledger(spark), AS_OF, multi_line=multi_line)
        assert rows(ledger, "file_name", "load_status") == [("bad.csv", "failed"), ("breaks.csv", "completed"), ("good.csv", "completed")]
        assert rows(landing, "id", "caption") == [("1", None), ("2", "a\nb")]


def test_interrupted_load_is_made_good_by_the_next(spark, tmp_path, rows):
    files, out = tmp_path / "in", str(tmp_path / "out")
    files.mkdir()
    write(files, "a.csv", line(id="1"))
    loads.run_load(spark, str(files), out, AS_OF)
    write(files, "b.csv", line(id="2"), line(id="3"))
    # a run that died after landing and before the ledger
    ledger = loads.read_ledger(spark, out)
    landing, _ = loads.load_files(spark, str(files), ledger, LATER, start_id=1)
    tables.append_landing(landing, f"{out}/landing")
    landed, ledger = loads.run_load(spark, str(files), out, LATER)
    assert rows(landed, "id", "load_id") == [("1", 1), ("2", 2), ("3", 2)]
    assert landed.select("source_id").distinct().count() == 3
    assert rows(ledger, "load_id", "rows_loaded", "load_status") == [(1, 1, "completed"), (2, 2, "completed")]


def test_a_run_without_good_rows(spark, tmp_path, rows):
    files, out = tmp_path / "in", str(tmp_path / "out")
    files.mkdir()
    write(files, "a.csv", "bad,row")
    for status, expected in (("failed", []), ("completed", [("7",)])):
        landed, ledger = loads.run_load(spark, str(files), out, AS_OF)
        assert rows(landed, "id") == expected
        assert rows(ledger, "load_id", "load_status") == [(1, status)]
        write(files, "a.csv", line(id="7"))


def test_a_file_that_became_empty_leaves_no_rows(spark, tmp_path, rows):
    files, out = tmp_path / "in", str(tmp_path / "out")
    files.mkdir()
    write(files, "a.csv", line(id="1"))
    write(files, "b.csv", line(id="2"))
    loads.run_load(spark, str(files), out, AS_OF)
    write(files, "a.csv")
    landed, ledger = loads.run_load(spark, str(files), out, LATER)
    assert rows(landed, "id") == [("2",)]
    assert rows(ledger, "load_id", "rows_loaded") == [(1, 0), (2, 1)]


def test_shared_folder(spark, monkeypatch):
    from recordloom import session

    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    monkeypatch.setattr(session, "CHECKPOINT_DIR", "spark.some.unset.dir")
    if not spark.sparkContext.getCheckpointDir():
        with pytest.raises(ValueError, match="spark.some.unset.dir"):
            session.shared_dir(spark)


def test_a_replaced_load_is_processed_once(spark, tmp_path, rows, lookup):
    files, out = tmp_path / "in", str(tmp_path / "out")
    files.mkdir()

    def run():
        loads.run_load(spark, str(files), out, AS_OF)
        ingest.stream_process(spark, out, lookup, f"{out}/tables", f"{out}/state").awaitTermination()
        return [rows(spark.read.parquet(f"{out}/tables/{n}"), "row_id", "batch_id") for n in ("cases", "defendants")]

    write(files, "a.csv", line(id="1", case_type="T", defendant='"[{""Name"":""x""}]"'))
    assert run() == [[(1, 0)], [(1, 0)]]
    assert run() == [[(1, 0)], [(1, 0)]]
    write(files, "b.csv", line(id="1", case_type="T", defendant='"[{""Name"":""y""}]"'), line(id="2", case_type="T"))
    assert run() == [[(1, 0), (2, 2)], [(1, 0), (1, 2)]]
    # a commit that died between landing and ledger: its rows wait for the commit that is done
    write(files, "c.csv", line(id="3", case_type="T", defendant='"[{""Name"":""z""}]"'))
    ledger = loads.read_ledger(spark, out)
    landing, _ = loads.load_files(spark, str(files), ledger, LATER, start_id=100)
    tables.append_landing(landing, f"{out}/landing")
    ingest.stream_process(spark, out, lookup, f"{out}/tables", f"{out}/state").awaitTermination()
    assert rows(spark.read.parquet(f"{out}/tables/cases"), "row_id") == [(1,), (2,)]
    assert run() == [[(1, 0), (2, 2), (3, 3)], [(1, 0), (1, 2), (3, 3)]]


def test_only_the_partitions_of_new_loads_are_read(spark, tmp_path, lookup):
    files, out = tmp_path / "in", str(tmp_path / "out")
    files.mkdir()
    for i in range(3):
        write(files, f"{i}.csv", line(id=str(i), case_type="T"))
    loads.run_load(spark, str(files), out, AS_OF)
    landed = spark.read.parquet(f"{out}/landing")
    after, _, _ = loads.process_loads(landed, lookup, loads.accept_cases(landed, lookup).where("false"), spark.createDataFrame([(2,)], "load_id bigint"))
    assert [r["row_id"] for r in after.collect()] == [1]
    plan = filter_loads(landed, [2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(load_id" in plan and "= 2)" in plan


def test_session_is_sized_to_the_input(spark):
    from recordloom.session import size_session

    session = spark.newSession()
    size_session(session, 100 * 1024**4)
    assert int(session.conf.get("spark.sql.shuffle.partitions")) == 409_600
    assert int(session.conf.get("spark.sql.files.maxPartitionBytes")) == 1024**3
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_append_mode_counts_rows_again(spark, tmp_path, rows):
    write(tmp_path, "a.csv", line(id="1"))
    out = f"{tmp_path}-landing"
    landing, ledger = loads.load_files(spark, str(tmp_path), loads.empty_ledger(spark), AS_OF, "append")
    tables.append_landing(landing, out, "append")
    kept = tables.materialize(ledger, f"{tmp_path}-ledger")
    landing, ledger = loads.load_files(spark, str(tmp_path), kept, LATER, "append")
    assert tables.append_landing(landing, out, "append").count() == 2
    assert rows(ledger, "rows_loaded") == [(2,)]


def test_replacing_a_load_leaves_the_others(spark, tmp_path, rows):
    out = str(tmp_path / "landing")
    tables.append_landing(spark.createDataFrame([("a", 1), ("b", 2)], "id string, load_id bigint"), out)
    landed = tables.append_landing(spark.createDataFrame([("c", 2), ("d", 2)], "id string, load_id bigint"), out)
    assert rows(landed) == [("a", 1), ("c", 2), ("d", 2)]


def test_number_rows_is_gapless(spark, tmp_path, rows):
    df = spark.range(100).repartition(5)
    numbered = tables.number_rows(df, str(tmp_path / "n"), start=10)
    assert [r[0] for r in sorted(rows(numbered, "source_id"))] == list(range(11, 111))
    assert rows(numbered) == rows(numbered)


def test_empty_cjis_view_and_procedure_differ(spark, lookup):
    src = source(spark, {"id": "1", "case_type": "T", "cjis": ""}, {"id": "2", "case_type": "T", "cjis": "NA"})
    assert [r["row_id"] for r in cases.final_tables(src, lookup)[0].collect()] == [2]
    assert sorted(r["row_id"] for r in loads.accept_cases(src, lookup).collect()) == [1, 2]


def test_lookup_sees_raw_keys_and_fans_out(spark, lookup, rows):
    doc = '{"Name":"d"}'
    src = source(spark, {"id": "1", "case_type": "NA"}, {"id": "2", "case_type": "F", "defendant": doc}, {"id": "3", "case_type": None, "court_system": "CIVIL"})
    final, defendants, _ = cases.final_tables(src, lookup)
    assert rows(final, "row_id", "case_type", "category") == [
        (1, None, "EVICTION"), (2, "F", "POSSIBLE DEBT"), (2, "F", "POSSIBLE EVICTION"), (3, None, "NO INFORMATION")]
    assert rows(defendants, "row_id", "name") == [(2, "d"), (2, "d")]


def test_branches(spark, lookup, rows):
    src = source(
        spark,
        {"id": "1", "case_type": "X", "court_system": "CIVIL FAMILY"}, {"id": "2", "case_type": "X", "court_system": "Civil"},
        {"id": "3", "case_type": "T", "court_system": "Civil Family"}, {"id": "4", "case_type": "T", "court_system": "CIVIL", "cjis": "C"},
        {"id": "5", "case_type": "T", "court_system": None}, {"id": "6", "case_type": "X", "court_system": None},
        {"id": "7", "case_type": "X", "court_system": "NA", "plaintiff": '{"Name":"p"}'},
        {"id": "2", "case_type": "X", "court_system": "Civil", "plaintiff": '{"Name":"p"}'},
    )
    routed = cases.route(cases.label_with_lookup(src, lookup))
    assert rows(routed.where("branch is not null").select("id", "branch").distinct()) == [("1", "B1"), ("2", "B2"), ("5", "A")]
    final, _, plaintiffs = cases.final_tables(src, lookup)
    assert rows(final, "row_id", "category") == [(1, "OTHER CIVIL"), (2, "OTHER CIVIL"), (5, "DEBT")]
    assert plaintiffs.count() == 0


def test_bad_id_fails_unless_asked(spark, lookup):
    src = source(spark, {"id": "x", "case_type": "T"})
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cases.final_tables(src, lookup)[0].collect()
    assert cases.project_case(src.withColumn("category", F.lit("c")), "null").first()["row_id"] is None


def test_processing_twice_adds_nothing(spark, lookup, rows):
    src = source(
        spark, {"id": "1", "case_type": "T", "source_id": 5, "caption": "first"}, {"id": "1", "case_type": "T", "source_id": 9, "caption": "again"},
        {"id": "2", "case_type": "F", "source_id": 6, "load_id": 2, "defendant": '[{"Name":"a"},{"Name":"b"}]'},
        {"id": "3", "case_type": "T", "source_id": 7, "load_id": 3},
    )
    ledger = spark.createDataFrame([(1, "completed"), (2, "completed"), (3, "failed")], "load_id bigint, load_status string")
    none = loads.accept_cases(src, lookup).where("false")
    todo = loads.unprocessed_loads(ledger, none)
    after, defendants, _ = loads.process_loads(src, lookup, none, todo)
    assert rows(after, "row_id", "source_id", "caption", "category") == [(1, 5, "first", "DEBT"), (2, 6, None, "POSSIBLE DEBT")]
    assert rows(defendants, "row_id", "name") == [(2, "a"), (2, "b")]
    assert loads.unprocessed_loads(ledger, after).count() == 0
    again, defendants, _ = loads.process_loads(src, lookup, after, loads.unprocessed_loads(ledger, after))
    assert rows(again) == rows(after) and defendants.count() == 0


def test_stream_equals_batch_and_reads_each_file_once(spark, tmp_path, rows, lookup):
    files, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    files.mkdir()
    write(files, "a 1.csv", line(id="1", case_type="T"), line(id="2", case_type="F", defendant='"[{""Name"":""a""}]"'))
    write(files, "b.csv", line(id="3", case_type="T"), "bad,row")

    def run():
        ingest.stream_load(spark, str(files), out, state, AS_OF).awaitTermination()
        return loads.read_landing(spark, out), loads.read_ledger(spark, out)

    run()
    landing, ledger = run()
    batch_landing, batch_ledger = loads.load_files(spark, str(files), loads.empty_ledger(spark), AS_OF)
    assert rows(landing, *CASE_FILE_COLUMNS, "load_id") == rows(batch_landing, *CASE_FILE_COLUMNS, "load_id")
    columns = ["load_id", "file_name", "rows_loaded", "load_status", "error_message"]
    assert rows(ledger, *columns) == rows(batch_ledger, *columns)
    write(files, "c.csv", line(id="1", case_type="T", caption="later"), line(id="4", case_type="T"))
    landing, ledger = run()
    assert rows(landing, "id", "source_id")[-1][0] == "4" and landing.select("source_id").distinct().count() == 4
    assert rows(ledger, "load_id", "load_status") == [(1, "completed"), (2, "failed"), (3, "completed")]

    def process():
        ingest.stream_process(spark, out, lookup, f"{out}/tables", f"{out}/process-state").awaitTermination()
        return spark.read.parquet(f"{out}/tables/cases")

    assert rows(process(), "row_id", "caption", "category") == [(1, None, "DEBT"), (2, None, "POSSIBLE DEBT"), (4, None, "DEBT")]
    assert process().count() == 3


def test_small_batches_give_the_same_tables(spark, tmp_path, rows, lookup):
    files = tmp_path / "in"
    files.mkdir()
    for i in range(4):
        write(files, f"{i}.csv", *[line(id=str(j), case_type="T", caption=f"c{i}") for j in range(i, i + 3)])
    results = []
    for name, max_files in (("whole", None), ("small", 1)):
        out = str(tmp_path / name)
        ingest.stream_load(spark, str(files), out, f"{out}-s1", AS_OF, max_files=max_files).awaitTermination()
        landing = loads.read_landing(spark, out)
        ingest.stream_process(spark, out, lookup, f"{out}/tables", f"{out}-s2", max_files=max_files).awaitTermination()
        cases_after = spark.read.parquet(f"{out}/tables/cases")
        ledger = loads.read_ledger(spark, out)
        results.append((rows(landing, "id", "caption"), rows(cases_after, "row_id"), rows(ledger, "file_name", "rows_loaded", "load_status")))
        assert landing.select("source_id").distinct().count() == 12
    assert results[0] == results[1]
    assert results[0][1] == [(i,) for i in range(6)]


@pytest.mark.parametrize("terminator", ["\n", "\r\n"])
def test_csv_against_another_reader(spark, tmp_path, terminator):
    rnd = random.Random(23)
    alphabet = ["a", "É", ",", '"', "\n", " ", "NA", "\\", "'", "{", ":", "1"]
    records = [
        [str(i), *["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(4))) for _ in CASE_FILE_COLUMNS[1:]]]
        for i in range(400)
    ]
    with open(tmp_path / "a.csv", "w", encoding="utf-8", newline="") as out:
        writer = python_csv.writer(out, lineterminator=terminator)
        writer.writerow(CASE_FILE_COLUMNS)
        writer.writerows(records)
    for multi_line in (True, False):
        if not multi_line:  # one file in many splits
            spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        try:
            read = {r["row_num"]: tuple(r) for r in csv.read_cases_csv(spark, str(tmp_path), multi_line).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len(read) == 400
        for record in records:
            assert read[record[0]] == tuple(None if v == "NA" else v for v in record)
