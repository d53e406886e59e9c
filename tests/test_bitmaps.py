"""Counts and links out of bitmaps of keys."""

from pyspark.sql import functions as F

from recordloom.operators import bitmaps, quality


def states_of(spark, **tables):
    return quality.union_all([bitmaps.key_states(spark.createDataFrame([(k,) for k in keys], "row_id long"), "row_id", name) for name, keys in tables.items()])


def test_summary_and_duplicates(spark, rows):
    states = states_of(spark, a=[1, 1, 2, None, -5, 32_768, 32_769, 2**40, 0], b=[7], c=[None, None])
    assert rows(bitmaps.summary(states)) == sorted([("a", 9, 7), ("b", 1, 1), ("c", 2, 0)], key=str)
    assert rows(bitmaps.duplicates(states)) == sorted([("a", 2, "WARN"), ("b", 0, "OK"), ("c", 2, "WARN")], key=str)


def test_linkage_equals_the_report_by_keys(spark, rows):
    keys = {
        "cases": [1, 1, 2, 3, None, 40_000, 2**41, -9], "defendants": [1, 1, 1, 40_000, None, 77, -9], "plaintiffs": [1, 2, 2**41, 99, -9],
    }
    frames = [spark.createDataFrame([(k,) for k in keys[n]], "row_id long") for n in keys]
    assert rows(bitmaps.linkage(states_of(spark, **keys))) == rows(quality.linkage_report(*frames))
    empty = states_of(spark, cases=[1, 2]).where("table_name <> 'x'")
    assert rows(bitmaps.linkage(empty), "row_count") == [(0,), (0,), (0,)]


def test_loads_merge_and_replace_their_own(spark, tmp_path, rows):
    path = str(tmp_path / "states")
    df = spark.range(100_000).select((F.col("id") % 60_000).alias("k"), (F.col("id") % 3).alias("load"))
    for part in ("load = 0", "load > 0", "load = 1"):
        bitmaps.write_states(bitmaps.key_states(df.where(part), "k", "t", "load"), path)
    assert rows(bitmaps.summary(bitmaps.read_states(spark, path))) == [("t", 100_000, 60_000)]
    assert bitmaps.read_states(spark, path).count() == 7  # two buckets for each load, and that of key 0


def test_a_hot_key_leaves_a_task_as_one_bitmap(spark):
    df = spark.range(200_000, numPartitions=4).select(F.lit(5).alias("k"))
    plan = bitmaps.key_states(df, "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert "partial_bitmap_construct_agg" in plan
