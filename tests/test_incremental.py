"""Incremental work reads what it needs: buckets of a batch's keys, partitions of open loads."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.operators.filters import prune_to
from recordloom.plans import loads
from recordloom.session import stage
from recordloom.sources import bucketed, tables

KEY = T.StructField("k", T.LongType())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_row_of_a_key_wins_over_batches(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (None, "null")], "k long, v string")
    fresh, known = bucketed.first_wins_into(path, first, "k", ["v"], 0, buckets=8)
    assert rows(fresh) == [(1, "a"), (2, "c")] and known.count() == 0
    for _ in range(2):  # a batch that runs again replaces itself
        fresh, known = bucketed.first_wins_into(path, spark.createDataFrame([(2, "x"), (3, "y")], "k long, v string"), "k", ["v"], 1, buckets=8)
        assert rows(fresh) == [(3, "y")] and rows(known) == [(2,)]
    assert rows(bucketed.read_buckets(spark, path, fresh.schema)) == [(1, "a"), (2, "c"), (3, "y")]
    assert rows(bucketed.read_buckets(spark, path, fresh.schema, before=1)) == [(1, "a"), (2, "c")]


def test_known_keys_of_a_table_that_is_not_there(spark, tmp_path):
    keys = spark.createDataFrame([(1,)], "k long")
    assert bucketed.known_keys(spark, str(tmp_path / "none"), KEY, keys, 5).count() == 0
    assert bucketed.known_keys(spark, str(tmp_path / "none"), KEY, keys.where("false"), 5).count() == 0
    assert bucketed.read_buckets(spark, str(tmp_path / "none"), T.StructType([KEY])).count() == 0


def test_seen_keys_tell_more_than_the_batch(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    bucketed.first_wins_into(path, spark.createDataFrame([(1,), (2,)], "k long"), "k", [], 0)
    fresh, known = bucketed.first_wins_into(path, spark.createDataFrame([(3,)], "k long"), "k", [], 1, seen=spark.createDataFrame([(1,), (3,), (1,)], "k long"))
    assert rows(fresh) == [(3,)] and rows(known) == [(1,)]


def test_a_small_batch_reads_its_own_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    bucketed.first_wins_into(path, spark.range(5000).select(F.col("id").alias("k")), "k", [], 0)
    keys = spark.createDataFrame([(17,), (4000,), (9999,)], "k long")
    numbers = sorted({r[0] for r in keys.select(bucketed.bucket_of("k")).collect()})
    known = bucketed.known_keys(spark, path, KEY, keys, 1)
    scanned = known._jdf.queryExecution().executedPlan().toString()
    assert len(numbers) < 4 and "/bucket={" not in scanned and "PartitionFilters: [isnotnull(batch_id" in scanned
    files = {f.split("bucket=")[1].split("/")[0] for f in bucketed.read_buckets(spark, path, T.StructType([KEY]), numbers).inputFiles()}
    assert files == {str(n) for n in numbers}
    assert sorted(r["k"] for r in known.collect()) == [17, 4000]


def test_partitions_are_pruned_by_the_ledger_as_the_scan_runs(spark, tmp_path):
    landed = tables.materialize(spark.range(400).select("id", (F.col("id") % 40).alias("load_id")), str(tmp_path / "landing"), ["load_id"])
    ledger = spark.range(40).select(F.col("id").alias("load_id"), F.when(F.col("id") % 7 == 0, "completed").otherwise("failed").alias("load_status"))
    found = prune_to(landed, ledger.where("load_status = 'completed'"), "load_id")
    assert "dynamicpruning" in plan_of(found)
    assert {r["load_id"] for r in found.collect()} == set(range(0, 40, 7)) and found.count() == 60
    assert prune_to(landed, ledger.where("load_status = 'open'"), "load_id").count() == 0


def test_more_keys_than_a_broadcast_takes(spark, tmp_path):
    landed = tables.materialize(spark.range(400).select("id", (F.col("id") % 40).alias("load_id")), str(tmp_path / "landing"), ["load_id"])
    keys = spark.createDataFrame([(3,), (5,), (5,), (None,), (99,)], "load_id long")
    found = prune_to(landed, keys, "load_id", broadcast_bytes=0)
    assert found.count() == 20 and "load_id#" in plan_of(found) and ">= 3" in plan_of(found)


def test_ten_thousand_open_loads(spark, tmp_path):
    """Their ids are no literals of the plan, and only their partitions are read."""
    from recordloom.schemas import CASE_FILE_COLUMNS

    texts = [F.lit("T").alias(c) if c == "case_type" else F.col("source_id").cast("string").alias(c) if c == "id" else F.lit(None).cast("string").alias(c) for c in CASE_FILE_COLUMNS]
    rows = spark.range(60).select(F.col("id").alias("source_id"), (F.col("id") * 1000).alias("load_id"))
    landed = tables.materialize(rows.select(*texts, "source_id", "load_id"), str(tmp_path / "landing"), ["load_id"])
    ledger = stage(spark.range(20_000).select((F.col("id") * 2).alias("load_id"), F.lit("completed").alias("load_status")), "ledger")
    lookup = tables.values_df(spark, [("T", "D")], "case_type string, subtype string")
    none = loads.accept_cases(landed, lookup).where("false")
    todo = loads.unprocessed_loads(ledger.where("load_id < 20000"), none)
    assert todo.count() == 10_000
    after, _, _ = loads.process_loads(landed, lookup, none, todo)
    assert sorted(r["load_id"] for r in after.collect()) == list(range(0, 20_000, 1000))
    pruned = prune_to(landed, todo, "load_id")
    assert "dynamicpruning" in plan_of(pruned) and len(plan_of(pruned)) < 20_000
