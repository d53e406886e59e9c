"""Record files read in splits hold the rows that a quoted reader of whole files finds."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.plans import loads
from recordloom.schemas import CASE_FILE_COLUMNS
from recordloom.sources import csv

WIDTH = len(CASE_FILE_COLUMNS)
AS_OF = "2024-03-01 00:00:00"


def record(*fields):
    """A line of a record file: the given raw fields, then empty ones."""
    return ",".join([*fields, *[""] * (WIDTH - len(fields))])


def both(spark, folder):
    found = []
    for multi_line in (True, False):
        rows = csv.read_many(spark, str(folder), multi_line).select("file_name", "is_bad", *CASE_FILE_COLUMNS).collect()
        good = sorted((tuple(r) for r in rows if not r["is_bad"]), key=str)
        bad = sorted(r["file_name"] for r in rows if r["is_bad"])
        found.append((good, bad))
    return found


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


FILES = {
    "inner quotes in unquoted fields": [record("1", '5" pipe'), record("2", "x"), record("3", "y"), record("4", '6" pipe'), record("5", "z")],
    "escaped quotes and breaks": [record("1", '"a ""b""\nc"'), record("2", '""'), record("3", '"""\n"""'), record("4", '"\n\n\n"', '"x,y"')],
    "text after a closed quote": [record("1", '"a"b'), record("2", '"a" b"c'), record("3", '"a" "b'), record("4", '"a"\t'), record("5", '"a"b', '"c\nd"')],
    "blank lines": ["", record("1", "a"), "", "", record("2", '"\n\nb"'), ""],
    "bad records": [record("1"), "too,short", record("2", '"\n"') + ",too long", '"x\ny"', record("3")],
    "header alone": [],
    "a break at every split": [record(str(i), '"' + "\n" * (i % 9) + "q" * i + '"') for i in range(40)],
}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_both_forms_agree(spark, tmp_path, small_splits, end):
    for name, records in FILES.items():
        text = "\n".join([",".join(CASE_FILE_COLUMNS), *records, ""])
        (tmp_path / f"{name}.csv").write_bytes(text.replace("\n", end).encode())
    (tmp_path / "mixed.csv").write_bytes((",".join(CASE_FILE_COLUMNS) + end + record("1", '"a\r\nb\n"') + "\r\n" + record("2", "x") + "\n").encode())
    (tmp_path / "header with a break.csv").write_bytes((record('"a\nb"') + end + record("1", "x")).encode())
    whole, split = both(spark, tmp_path)
    assert split == whole and len(whole[0]) > 60 and len(whole[1]) >= 3


def test_both_forms_agree_on_random_text(spark, tmp_path, small_splits):
    rng = random.Random(11)
    for n in range(25):
        fields = lambda: ["".join(rng.choice(['"', '"', '""', "a", "b", " ", "\n", ",", "\t"]) for _ in range(rng.randrange(6))) for _ in range(4)]
        records = [record(str(i), *fields()) for i in range(8)]
        # a closed last field, so that no quote stays open at the end
        text = "\n".join([",".join(CASE_FILE_COLUMNS), *records])
        if not open_at_end(text):
            (tmp_path / f"{n:02}.csv").write_bytes((text + "\n").encode())
    whole, split = both(spark, tmp_path)
    assert split == whole and len(whole[0]) > 10


def open_at_end(text):
    state = 0
    for c in text:
        if state == 2:
            state = 3 if c == '"' else 2
        elif c == '"':
            state = {0: 2, 1: 1, 3: 2}[state]
        else:
            state = 0 if c in ",\n" else 1
    return state == 2


def test_a_quote_that_never_closes_is_one_bad_record(spark, tmp_path, small_splits):
    lines = [",".join(CASE_FILE_COLUMNS), record("1", "a"), record("2", '"open'), *[record(str(i), "b") for i in range(3, 300)]]
    (tmp_path / "open.csv").write_text("\n".join(lines))
    rows = csv.read_many(spark, str(tmp_path), multi_line=False)
    assert sorted((r["is_bad"], r["row_num"]) for r in rows.collect())[0] == (False, "1")
    assert rows.count() == 2 and rows.where("is_bad").count() == 1
    for multi_line in (True, False):
        landing, ledger = loads.load_files(spark, str(tmp_path), loads.empty_ledger(spark), AS_OF, multi_line=multi_line)
        assert landing.count() == 0 and ledger.first()["load_status"] == "failed"


def test_a_record_beyond_the_bound_is_reported_and_not_gathered(spark, tmp_path, small_splits):
    lines = [",".join(CASE_FILE_COLUMNS), record("1", '"' + "x\n" * 500 + '"'), record("2", '"y\nz"'), record("3", "w")]
    (tmp_path / "long.csv").write_text("\n".join(lines) + "\n")
    rows = {r["record"][:2]: (r["is_broken"], len(r["record"])) for r in csv.split_records(spark, str(tmp_path), record_bytes=900).collect()}
    assert rows["1,"] == (True, 4) and not rows["2,"][0] and not rows["3,"][0]


def test_text_is_not_shuffled_where_few_records_hold_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([",".join(CASE_FILE_COLUMNS), *[record(str(i), "a") for i in range(50)], ""]))
    single = csv.split_records(spark, str(tmp_path)).where(~F.col("is_broken"))
    plan = single._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 4 and "SortMergeJoin" not in plan
