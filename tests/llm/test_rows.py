"""Row numbers that any reading of a table gives alike, and workers without the package."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordloom.llm import common, forest, licenses, minhash, repeats, substrings
from tests.llm.helpers import SF_DIR, given

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture
def parallelism(spark):
    """Sets how many splits a scan is planned for, as live executors do."""
    names = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes")

    def put(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "1")

    yield put
    for name in names:
        spark.conf.unset(name)


@pytest.fixture
def many_files(spark, tmp_path):
    path = str(tmp_path / "many")
    given(spark, "documents").repartition(12, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


def test_numbers_do_not_depend_on_live_executors(spark, many_files, parallelism):
    rows = common.keyed(many_files.select("doc_id", "text"), "rid")
    found = []
    for n in (4, 12, 1):
        parallelism(n)
        found.append(sorted((r["rid"], r["doc_id"]) for r in rows.select("rid", "doc_id").collect()))
    assert found[0] == found[1] == found[2] and len({r for r, _ in found[0]}) == many_files.count()
    parts = []
    for n in (4, 12):
        parallelism(n)
        parts.append(many_files.select("doc_id").rdd.getNumPartitions())
    assert parts[0] != parts[1]  # else the test would show nothing


def test_rows_that_come_from_no_file_are_numbered_too(spark):
    rows = common.keyed(spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "_file long, _row string"), "rid")
    assert rows.columns == ["_file", "_row", "rid"] and rows.select("rid").distinct().count() == 3
    shuffled = common.keyed(spark.range(50).repartition(5), "rid")
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, shuffled.collect()))
    assert common.keyed(spark.createDataFrame([], "x long"), "rid").count() == 0


def test_a_scan_is_not_written_down(spark, many_files, monkeypatch):
    written = []
    monkeypatch.setattr(common, "stage", lambda df, name, put=common.stage: written.append(name) or put(df, name))
    common.keyed(many_files.where("doc_id > 3").select("doc_id", "text"), "rid")
    assert written == ["files"]


@pytest.mark.parametrize("operator", ["minhash", "repeats", "substrings"])
def test_executors_may_come_and_go_within_an_operator(spark, many_files, parallelism, monkeypatch, operator):
    """The table is planned anew for another number of executors between the steps of an operator."""
    run = {
        "minhash": lambda df: minhash.near_duplicates(df, "doc_id", "text", words=2, percent=80).drop("key"),
        "repeats": lambda df: repeats.remove_repeated_bytes(df, "doc_id", "text", length=400),
        "substrings": lambda df: substrings.remove_repeats(df, "doc_id", "text", length=35),
    }[operator]
    want = sorted(map(str, run(many_files).collect()))
    module = {"minhash": minhash, "repeats": repeats, "substrings": substrings}[operator]
    step, put = {"minhash": "texts_of", "repeats": "build_sketch", "substrings": "build_sketch"}[operator], parallelism

    def changed(*args, f=getattr(module, step), **kwargs):
        put(12)
        return f(*args, **kwargs)

    monkeypatch.setattr(module, step, changed)
    put(4)
    found = run(many_files)
    put(7)
    assert sorted(map(str, found.collect())) == want


def test_the_pipeline_keeps_a_column_named_as_its_own(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f", "R1"), (2, "g h i j k l", "R2")], "doc_id long, text string, rid string")
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR)
    assert kept.columns == docs.columns and sorted(r["rid"] for r in kept.collect()) == ["R1", "R2"]


def test_cosines_of_huge_and_tiny_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 0.0]), (2, [3e-200, 4e-200]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["score"] for r in forest.search(df, "vec_id", "embedding", df["vec_id"] == 0, 5).collect()}
    assert found == {3: pytest.approx(1.0), 2: pytest.approx(0.7 * np.sqrt(2)), 1: pytest.approx(np.sqrt(0.5))}


PROSE = ["The general public is invited to the fair", "all rights of the child", "This public license plate is free", "rights reserved", "software is free and open to the public"]


def test_ordinary_prose_bears_no_licence(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PROSE)], "doc_id long, text string")
    assert all(not r["spans"] and not r["places"] for r in licenses.scan(df, "doc_id", "text").collect())


def test_paragraphs_of_licences_are_found_without_their_notice(spark):
    texts = [(i, f"Some words before. {t.capitalize()}. And after") for i, (_, t) in enumerate(licenses.TEMPLATES)]
    found = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text").collect()
    for row in found:
        assert licenses.TEMPLATES[row["doc_id"]][0] in {s["label"] for s in row["spans"]} and row["score"] == 1.0


def test_executors_need_no_copy_of_the_package(tmp_path):
    """All queries in a process that starts elsewhere, whose workers cannot import the package."""
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from recordloom.session import build_session
spark = build_session("elsewhere", "local[8]", spark__sql__shuffle__partitions="4", spark__checkpoint__dir={str(tmp_path / 'shared')!r})
spark.sparkContext.setLogLevel("OFF")
def missing(batches):
    try:
        import recordloom
    except ImportError:
        yield from batches
assert spark.range(1).mapInArrow(missing, "id long").count() == 1
import __spark_entry__
for name, query in __spark_entry__.queries().items():
    if name.startswith("op") and name[2].isdigit():
        print("\\nran", name, query(spark, {SF_DIR!r}).count() > 0)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    ran = [line for line in done.stdout.splitlines() if line.startswith("ran ")]
    assert len(ran) == 13 and all(line.endswith("True") for line in ran), done.stderr[-3000:]
