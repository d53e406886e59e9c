"""Operators on small frames: NULL behaviour, hot keys, repeat runs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from recordloom.plans import governance
from recordloom.operators import aggregates, filters, joins, merge, quality, sampling
from recordloom.plans import lineage
from recordloom.plans.classify import classify_columns
from recordloom.plans.profile import approx_quantiles, profile, quantiles
from recordloom.schemas import GOVERNANCE_FOREIGN_KEYS, ForeignKey
from recordloom.sources.tables import values_df


def test_complement_is_exact(spark):
    df = spark.createDataFrame([("D",), ("X",), (None,)], "s string")
    assert filters.filter_in(df, "s", ["D"]).count() == 1
    assert filters.filter_not_in_or_null(df, "s", ["D"]).count() == 2


def test_exclude_keywords_keeps_null(spark, rows):
    df = spark.createDataFrame([("Criminal",), ("CIVIL",), (None,), ("x family y",)], "s string")
    assert rows(filters.exclude_keywords(df, "s", ["CRIMINAL", "FAMILY"])) == [(None,), ("CIVIL",)]


def test_filter_loads_without_list_keeps_nothing(spark):
    df = spark.range(3).select(F.col("id").alias("load_id"))
    assert filters.filter_loads(df, None).count() == 0
    assert filters.filter_loads(df, []).count() == 0
    assert filters.filter_loads(df, [1, 2]).count() == 2


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_lookup_equals_plain_join_with_a_hot_key(spark, rows, how):
    keys = ["hot"] * 400 + [None] * 100 + ["a", "b", "zz"] * 20
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k string")
    lookup = spark.createDataFrame([("hot", "1"), ("hot", "2"), ("a", "3"), ("b", "4"), ("unused", "5")], "k string, v string")
    plain = rows(df.join(lookup, "k", how), "id", "k", "v")
    assert rows(joins.lookup_join(df, lookup, "k", how, broadcast_bytes=0, salts=16), "id", "k", "v") == plain
    assert rows(joins.lookup_join(df, lookup, "k", how), "id", "k", "v") == plain


def test_left_join_many_equals_left_join(spark, rows):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (3, "d")], "k int, v string")
    right = spark.createDataFrame([(1, "x")] * 50 + [(2, "y"), (None, "n"), (9, "z")], "k int, w string")
    assert rows(joins.left_join_many(left, right, "k"), "k", "v", "w") == rows(left.join(right, "k", "left"), "k", "v", "w")


def test_lookup_size_decides_on_broadcast(spark):
    df, lookup = spark.range(10).withColumn("k", F.col("id").cast("string")), values_df(spark, [("a", "1")], "k string, v string")
    small = joins.lookup_join(df, lookup, "k")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in small


def test_only_hot_keys_are_salted(spark, rows):
    names = F.when(F.col("id") < 900, "hot").when(F.col("id") < 950, None).otherwise(F.concat(F.lit("k"), F.col("id").cast("string")))
    df = spark.range(1000).withColumn("k", names)
    lookup = df.where("k is not null").select("k", F.upper("k").alias("v")).distinct().union(values_df(spark, [("hot", "again"), (None, "none")], "k string, v string"))
    want = rows(df.join(lookup, "k", "left").select("id", "k", "v"))
    for hot_rows in (10, 10_000):
        for how in ("left", "inner"):
            joined = joins.lookup_join(df, lookup, "k", how, broadcast_bytes=0, hot_rows=hot_rows, salts=8)
            assert rows(joined.select("id", "k", "v")) == (want if how == "left" else [r for r in want if r[1] is not None])
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_pick_first_has_no_window_and_is_total(spark, rows):
    data = [("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", 5, None), (None, 1, "n")]
    df = spark.createDataFrame(data, "k string, s int, v string")
    first = merge.pick_first(df, ["k"], ["s"])
    assert rows(first) == [(None, 1, "n"), ("a", 1, "y"), ("b", 5, None)]
    assert "Window" not in first._jdf.queryExecution().toString()


def test_insert_ignore(spark, rows):
    target = spark.createDataFrame([(1, "Tag"), (2, None)], "id int, name string")
    source = spark.createDataFrame([(3, "TAG"), (4, "new"), (5, "NEW"), (6, None), (7, None)], "id int, name string")
    once = merge.insert_ignore(target, source, [F.lower("name")], ["id"])
    assert rows(once) == [(1, "Tag"), (2, None), (4, "new"), (6, None), (7, None)]
    named = once.where(F.col("name").isNotNull())
    again = merge.insert_ignore(named, source.where(F.col("name").isNotNull()), [F.lower("name")], ["id"])
    assert rows(again) == rows(named)


def test_upsert_keeps_unnamed_columns(spark, rows):
    target = spark.createDataFrame([(1, "A", "old", True), (2, "b", "old", False)], "id int, name string, v string, keep boolean")
    source = spark.createDataFrame([(9, "a", None, False), (3, "c", "new", False)], "id int, name string, v string, keep boolean")
    result = merge.upsert(target, source, [F.lower("name")], ["v"])
    assert rows(result) == [(1, "A", None, True), (2, "b", "old", False), (3, "c", "new", False)]
    assert rows(merge.upsert(result, source, [F.lower("name")], ["v"])) == rows(result)


def test_upsert_updates_every_match_and_skips_null_keys(spark, rows):
    target = spark.createDataFrame([(1, "X@a"), (2, "x@a"), (3, None)], "id int, email string")
    source = spark.createDataFrame([(8, "x@A")], "id int, email string")
    result = merge.upsert(target, source, [F.lower("email")], ["email"])
    assert rows(result) == [(1, "x@A"), (2, "x@A"), (3, None)]


def test_upsert_fails_on_two_rows_for_one_key(spark, rows):
    target = spark.createDataFrame([("a", "old")], "name string, v string")
    twice = spark.createDataFrame([("A", "x"), ("a", "y")], "name string, v string")
    with pytest.raises(Exception, match="several rows to upsert"):
        merge.upsert(target, twice, [F.lower("name")], ["v"]).collect()
    without_key = spark.createDataFrame([(None, "x"), (None, "x")], "name string, v string")
    assert rows(merge.upsert(target, without_key, [F.lower("name")], ["v"])) == [(None, "x"), (None, "x"), ("a", "old")]


def test_first_wins_over_batches(spark, rows):
    target = spark.createDataFrame([(1, 10, "old")], "k int, s int, v string")
    batch = spark.createDataFrame([(1, 1, "late"), (2, 5, "b"), (2, 4, "a")], "k int, s int, v string")
    after = merge.first_wins(target, batch, "k", ["s"])
    assert rows(after) == [(1, 10, "old"), (2, 4, "a")]
    assert rows(merge.first_wins(after, batch, "k", ["s"])) == rows(after)


def test_update_where_ignores_null_condition(spark, rows):
    df = spark.createDataFrame([(1, None), (2, 5)], "id int, x int")
    assert rows(merge.update_where(df, F.col("x") > 3, {"id": F.lit(0)})) == [(0, 5), (1, None)]


def test_delete_follows_cascades_and_empties_references(spark, rows):
    fks = [
        ForeignKey("mid", "top_id", "top", "top_id", "cascade"),
        ForeignKey("leaf", "mid_id", "mid", "mid_id", "cascade"),
        ForeignKey("note", "leaf_id", "leaf", "leaf_id", "set null"),
    ]
    t = {
        "top": spark.createDataFrame([(1,), (2,)], "top_id int"),
        "mid": spark.createDataFrame([(10, 1), (20, 2), (30, None)], "mid_id int, top_id int"),
        "leaf": spark.createDataFrame([(100, 10), (200, 20)], "leaf_id int, mid_id int"),
        "note": spark.createDataFrame([(1000, 100), (2000, 200), (3000, None)], "note_id int, leaf_id int"),
    }
    after = merge.delete_propagate(t, fks, "top", spark.createDataFrame([(1,)], "top_id int"))
    assert {n: rows(df) for n, df in after.items()} == {
        "top": [(2,)], "mid": [(20, 2), (30, None)], "leaf": [(200, 20)],
        "note": [(1000, None), (2000, 200), (3000, None)],
    }


def test_foreign_key_inventory():
    assert len(GOVERNANCE_FOREIGN_KEYS) == 22


def test_array_parts_hold_everything_once(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").otherwise("rare").alias("k"))
    parts = aggregates.collect_parts_by(df, "k", "id", F.struct("id"), "a", parts=8).collect()
    assert sorted((r["k"], r["part"]) for r in parts) == [(k, p) for k in ("hot", "rare") for p in range(8)]
    assert sorted(x["id"] for r in parts for x in r["a"]) == list(range(1000))


def test_one_row_per_use_at_any_size(spark):
    uses = spark.createDataFrame(
        [(1, 7, "a", "d", True, "o"), (2, None, "b", None, None, None)],
        "permissible_use_id int, policy_id int, use_case string, description string, requires_approval boolean, approval_authority string")
    conditions = spark.range(100_001).select(
        F.col("id").alias("permissible_use_condition_id"), F.lit(1).alias("permissible_use_id"),
        *[F.col("id").cast("string").alias(c) for c in ("dataset_id", "condition_type", "condition_value", "condition_text", "enforced_by")])
    t = {"permissible_use": uses, "permissible_use_condition": conditions, "policy": spark.createDataFrame([(7, "p")], "policy_id int, name string")}
    got = governance.permissible_use(t).select("permissible_use_id", "policy_name", F.size("conditions")).collect()
    assert sorted(tuple(r) for r in got) == [(1, "p", 100_001), (2, None, -1)] or sorted((tuple(r) for r in got), key=str) == [(1, "p", 100_001), (2, None, None)]
    long = governance.permissible_use_conditions(t)
    assert long.count() == 100_002 and long.where("permissible_use_condition_id is null").count() == 1


def test_share_of_nothing_and_ties(spark, rows):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    assert [(c, n, str(p)) for c, n, p in rows(aggregates.share_by(df, "c"))] == [("a", 2, "66.67"), ("b", 1, "33.33")]
    assert aggregates.share_by(df.where("false"), "c").count() == 0
    assert [r[0] for r in aggregates.count_by(df.unionAll(df.where("c='b'")), "c", k=1).collect()] == ["a"]


def test_linkage_of_no_cases_is_null(spark, rows):
    empty = spark.createDataFrame([], "row_id bigint")
    assert {p for _, _, p in rows(quality.linkage_report(empty, empty, empty))} == {None}


def test_linkage_against_joins(spark):
    rnd = random.Random(3)
    frames = [spark.createDataFrame([(rnd.choice([None, *range(30)]),) for _ in range(n)], "row_id bigint") for n in (40, 25, 25)]
    c, d, p = frames
    got = {r["metric"]: (r["row_count"], float(r["percentage"])) for r in quality.linkage_report(c, d, p).collect()}
    ids = [{r[0] for r in f.collect()} - {None} for f in frames]
    for metric, want in (("Cases with defendants", ids[0] & ids[1]), ("Cases with plaintiffs", ids[0] & ids[2]), ("Cases with both", ids[0] & ids[1] & ids[2])):
        assert got[metric] == (len(want), round(100 * len(want) / 40, 2))


def test_checks(spark, rows):
    df = spark.createDataFrame([("a", 1), ("A", 2), (None, None), (None, 4)], "name string, ref int")
    assert rows(quality.unique_violations(df, {"name": F.lower("name")})) == [("a", 2)]
    parent = spark.createDataFrame([(1,), (4,)], "id int")
    assert rows(quality.orphans(df, "ref", parent, "id")) == [(2, 1)]
    assert rows(quality.domain_violations(df, "name", ["a"])) == [("A", 2)]
    assert rows(quality.not_null_violations(df, ["name", "ref"])) == [("name", 2), ("ref", 1)]
    report = quality.row_count_report({"t": df, "gone": None, "none": df.where("false")}, {"t": 10})
    assert rows(report) == [("gone", 0, "FAIL"), ("none", 0, "FAIL"), ("t", 4, "WARN")]


def test_sample_is_repeatable_over_partitionings(spark, rows):
    df = spark.range(2000)
    a = rows(sampling.sample_percent(df.repartition(7), "id", 30))
    assert a == rows(sampling.sample_percent(df.coalesce(1), "id", 30))
    assert 450 < len(a) < 750
    assert sampling.sample_percent(df, "id", 100).count() == 2000


def test_lineage_ends_on_a_cycle_and_keeps_the_shortest_way(spark, rows):
    edges = spark.createDataFrame(
        [(1, 2), (2, 3), (3, 1), (1, 3), (3, 4), (9, 9), (None, 5)], "upstream_dataset_id int, downstream_dataset_id int"
    )
    start = spark.createDataFrame([(1,), (9,)], "dataset_id int")
    assert rows(lineage.lineage_closure(edges, start)) == [(1, 2, 1), (1, 3, 1), (1, 4, 2)]
    assert rows(lineage.lineage_closure(edges, spark.createDataFrame([(4,)], "dataset_id int"), "upstream")) == [(4, 1, 2), (4, 2, 2), (4, 3, 1)]
    assert rows(lineage.lineage_closure(edges, start, max_depth=1)) == [(1, 2, 1), (1, 3, 1)]


def test_lineage_against_brute_force(spark):
    rnd = random.Random(5)
    pairs = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(60)}
    edges = spark.createDataFrame(sorted(pairs), "upstream_dataset_id int, downstream_dataset_id int")
    starts = [0, 7, 13]
    want = set()
    for s in starts:
        depth, frontier = {s: 0}, {s}
        while frontier:
            frontier = {b for a, b in pairs if a in frontier and b not in depth}
            depth |= dict.fromkeys(frontier, max(depth.values()) + 1)
        want |= {(s, n, d) for n, d in depth.items() if d}
    got = lineage.lineage_closure(edges, spark.createDataFrame([(s,) for s in starts], "dataset_id int"))
    assert {tuple(r) for r in got.collect()} == want


def test_profile(spark):
    df = spark.createDataFrame([(1, "ab"), (3, None), (None, "c"), (3, "ab")], "n int, s string")
    stats = {r["column_name"]: r for r in profile(df, approx_distinct=False).collect()}
    assert (stats["n"]["null_count"], stats["n"]["distinct_count"], stats["n"]["sum"]) == (1, 2, "7")
    assert (stats["s"]["min_length"], stats["s"]["max_length"], float(stats["s"]["null_percent"])) == (1, 2, 25.0)
    sketch = {r["column_name"]: r["distinct_count"] for r in profile(df, approx_distinct=True).collect()}
    assert sketch == {"n": 2, "s": 2}
    q = {r["probability"]: r["value"] for r in approx_quantiles(df, [0.5, 1.0]).collect()}
    assert q == {0.5: 3.0, 1.0: 3.0}


@pytest.mark.parametrize("slice_values", [1, 3, 1000])
def test_quantiles_against_sorted_values(spark, slice_values):
    rnd = random.Random(11)
    values = [rnd.choice([None, 5, 5, 5, rnd.randrange(100)]) for _ in range(300)]
    known = sorted(v for v in values if v is not None)
    wanted = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = quantiles(spark.createDataFrame([(v,) for v in values], "v int"), "v", wanted, slice_values)
    assert {r["probability"]: r["value"] for r in got.collect()} == {
        p: known[max(1, math.ceil(round(p * len(known), 9))) - 1] for p in wanted
    }


def test_profile_is_exact(spark):
    df = spark.createDataFrame(
        [(2**53, 0.0, ["a, b"], bytearray(b"\x00"), None), (1, -0.0, ["a", "b"], bytearray(b"\xff"), (None, 1)), (0, float("nan"), None, None, (1, None))],
        "n long, x double, a array<string>, b binary, s struct<p:int,q:int>")
    stats = {r["column_name"]: r for r in profile(df, approx_distinct=False).collect()}
    assert stats["n"]["sum"] == str(2**53 + 1)
    assert {c: r["distinct_count"] for c, r in stats.items()} == {"n": 3, "x": 2, "a": 2, "b": 2, "s": 2}
    money = spark.createDataFrame([("0.10",), ("0.20",)], "t string").selectExpr("cast(t as decimal(20,2)) as d")
    assert profile(money).first()["sum"] == "0.30"


def test_profile_of_nothing(spark):
    row = profile(spark.createDataFrame([], "n int")).first()
    assert (row["row_count"], row["distinct_count"], row["null_percent"]) == (0, 0, None)


def test_classify(spark, rows):
    df = spark.createDataFrame([("a@b.org", "x", "1"), ("c@d.com", "y", None)], "contact string, birth_date string, n string")
    found = [(c, t, m) for c, t, m, _ in rows(classify_columns(df))]
    assert found == [("birth_date", "BirthDate", "name"), ("contact", "Email", "value")]


def test_values_df_is_sized_and_typed(spark, rows):
    df = values_df(spark, [("it's \\ ok", 1, None, True)], "a string, b int, c string, d boolean")
    assert rows(df) == [("it's \\ ok", 1, None, True)]
    assert [t for _, t in df.dtypes] == ["string", "int", "string", "boolean"]
