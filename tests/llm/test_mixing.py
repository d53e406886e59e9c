import math
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from recordloom.llm import mixing, queries
from tests.llm.helpers import SF_DIR, empty_documents, given, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_levels(sizes: dict, most=3) -> dict:
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, open_names = {}, Fraction(sum(sizes.values())), set(names)
    while open_names:
        total = sum(weight[s] for s in open_names)
        full = {s for s in open_names if left * weight[s] / total > most * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_names}
        for s in full:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
        open_names -= full
    return target


def check(rows, texts_by_row):
    """What the contract says of (source, doc_id, size, source_size, target, taken)."""
    sizes, taken = defaultdict(int), defaultdict(int)
    for source, _, size, *_ in rows:
        sizes[source] += size
    want = water_levels(sizes)
    for source, _, size, source_size, target, own in rows:
        assert source_size == sizes[source] and math.isclose(target, want[source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= own <= 3 * size
        epochs = int(want[source] // sizes[source]) if sizes[source] else 0
        assert epochs * size <= own <= (epochs + 1) * size
        taken[source] += own
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 0.5 + 1e-6
    assert sorted(s for _, _, s, *_ in rows) == sorted(len(WORD.findall(t or "")) for t in texts_by_row)
    cut = defaultdict(int)
    for source, _, size, source_size, target, own in rows:
        cut[source] += bool(size) and own % size != 0
    assert all(c <= 1 for c in cut.values())  # one document at most is cut


def mixed_rows(df, **names):
    # the operator returns no source, so it is made part of the key
    packed = df.withColumn("name", F.struct("source", "doc_id"))
    found = mixing.mix(packed.withColumn("name", F.to_json("name", {"ignoreNullFields": "false"})), "name", "text", "source")
    parsed = found.withColumn("p", F.from_json("name", "source string, doc_id long"))
    return [tuple(r) for r in parsed.select("p.source", "p.doc_id", "size", "source_size", "target", "taken").collect()]


def test_mix_of_given_documents(spark):
    docs = given(spark, "documents")
    check(mixed_rows(docs), [r["text"] for r in docs.collect()])


def test_mix_with_full_sources_odd_texts_and_a_hot_one(spark):
    rows = [(i, "w " * (i % 7), "hot", 1) for i in range(3000)] + [(i, "only one", f"s{i:03}", 1) for i in range(40)]
    rows += [(1, None, None, 1), (1, "null source", None, 1), (None, "null key", "a", 1), (7, "long " * 40_000, "b", 1), (8, "", "empty", 1)]
    rows += [(9, "same row here", "c", 1)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(11)
    check(mixed_rows(docs), [r[1] for r in rows])


def test_mix_does_not_depend_on_partitions(spark):
    docs = given(spark, "documents")
    again = sorted(tuple(r) for r in queries.QUERIES["op13_mixing"](spark, SF_DIR).collect())
    other = mixing.mix(docs.repartition(17, "lang"), "doc_id", "text", "source")
    assert sorted(tuple(r) for r in other.collect()) == again


def test_mix_of_odd_and_empty_tables(spark):
    odd = odd_documents(spark).withColumn("source", F.lit(None).cast("string"))
    found = mixing.mix(odd, "doc_id", "text", "source").collect()
    assert len(found) == odd.count() and all(r["taken"] == r["size"] for r in found)  # one source takes itself once
    assert mixing.mix(empty_documents(spark), "doc_id", "text", "source").collect() == []
    nothing = spark.createDataFrame([(1, " ", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [tuple(r)[1:] for r in mixing.mix(nothing, "doc_id", "text", "source").collect()] == [(0, 0, 0.0, 0)] * 2


def test_better_texts_are_taken_more_often(spark):
    rows = [(i, f"clean words here {i}" if i % 2 else f"## {i} ## 99 %%", "a") for i in range(2000)] + [(i, "big " * 30, "b") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.where("source = 'a'").unionByName(docs.where("source = 'b'").withColumn("doc_id", F.col("doc_id") + 10_000)), "doc_id", "text", "source").where("doc_id < 10000").collect()}
    size = {i: len(t.split()) for i, t, s in rows if s == "a"}
    whole = {i: found[i] // size[i] for i in size}
    clean, junk = ([whole[i] for i in whole if i % 2 == odd] for odd in (1, 0))
    assert sum(clean) / len(clean) > sum(junk) / len(junk) + 0.1


@pytest.mark.parametrize("name", ["op13_mixing"])
def test_mixing_runs_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
