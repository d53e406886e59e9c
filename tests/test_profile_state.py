"""Profiles merged from the states of loads."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from recordloom.plans import profile, profile_state
from recordloom.sources import tables

SCHEMA = "load_id long, n long, x double, m decimal(10,2), t string, d date, b binary, none int"


@pytest.fixture
def landing(spark, tmp_path):
    rows = [
        (i % 5, 10**9 + i % 7, i / 8, Decimal(i), f"text {i % 90}" if i % 3 else "" if i % 2 else None, dt.date(2024, 1, 1 + i % 28), bytes([i % 4]), None)
        for i in range(1000)
    ]
    rows += [(9, None, None, None, None, None, None, None)] * 3
    return tables.materialize(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "landing"), ["load_id"])


def close(a, b):
    return a == b or (isinstance(a, float) and a == pytest.approx(b, rel=1e-7))


def test_merged_states_are_the_profile_of_all_rows(spark, landing, tmp_path):
    path = str(tmp_path / "states")
    loads = landing.select("load_id").distinct()
    for part in ("load_id < 2", "load_id >= 2", "load_id = 1"):  # the last one again
        profile_state.profile_loads(landing, loads.where(part), path)
    assert {r["load_id"] for r in spark.read.parquet(path).select("load_id").collect()} == {0, 1, 2, 3, 4, 9}
    got = {r["column_name"]: r.asDict() for r in profile_state.merged_profile(profile_state.read_states(spark, path)).collect()}
    want = {r["column_name"]: r.asDict() for r in profile.profile(landing.drop("load_id"), approx_distinct=False).collect()}
    assert got.keys() == want.keys()
    for column, stats in want.items():
        assert all(close(got[column][k], v) for k, v in stats.items()), [(column, k, got[column][k], v) for k, v in stats.items() if not close(got[column][k], v)]
    two = profile_state.read_states(spark, path, loads.where("load_id in (0, 9)"))
    assert {r["column_name"]: r["row_count"] for r in profile_state.merged_profile(two).collect()}["n"] == 203
    empty = profile_state.read_states(spark, path, loads.where("load_id = 9"))
    assert {(r["distinct_count"], r["mean"], r["stddev"], r["sum"]) for r in profile_state.merged_profile(empty).collect()} == {(0, None, None, None)}
    assert profile_state.merged_quantiles(empty, [0.5]).count() == 0


def test_quantiles_of_merged_states(spark, landing, tmp_path):
    path = str(tmp_path / "states")
    profile_state.profile_loads(landing, landing.select("load_id").distinct(), path, ["x"])
    found = {r["probability"]: r["value"] for r in profile_state.merged_quantiles(profile_state.read_states(spark, path), [0.0, 0.5, 1.0]).collect()}
    assert found[0.0] == 0 and found[1.0] == 999 / 8 and abs(found[0.5] - 62.5) <= 125 * profile_state.RANK_ERROR


def test_a_new_load_reads_itself_only(spark, landing, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(profile_state, "replace_parts", lambda df, path, by: seen.append(df))
    profile_state.profile_loads(landing, spark.createDataFrame([(3,)], "load_id long"), str(tmp_path / "states"))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "load_id#" in plan
    row = seen[0].collect()
    assert [r["load_id"] for r in row] == [3] and row[0]["n"]["row_count"] == 200


def test_distinct_estimates_keep_their_bound(spark, tmp_path):
    rows = tables.materialize(spark.range(200_000).select("id", F.concat(F.lit("k"), F.col("id") % 70_000).alias("t"), (F.col("id") % 4).alias("load_id")), str(tmp_path / "l"), ["load_id"])
    profile_state.profile_loads(rows, rows.select("load_id").distinct(), str(tmp_path / "s"))
    found = {r["column_name"]: r["distinct_count"] for r in profile_state.merged_profile(spark.read.parquet(str(tmp_path / "s"))).collect()}
    assert abs(found["id"] / 200_000 - 1) < profile_state.DISTINCT_ERROR and abs(found["t"] / 70_000 - 1) < profile_state.DISTINCT_ERROR
