import random

import pytest
from pyspark.sql import functions as F

from recordloom.plans import reachability

EDGES = "upstream_dataset_id long, downstream_dataset_id long"


def brute(edges, starts):
    after = {}
    for a, b in edges:
        if a is not None and b is not None:
            after.setdefault(a, set()).add(b)
    out = set()
    for s in starts:
        seen, todo = set(), [s]
        while todo:
            for n in after.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        out |= {(s, n) for n in seen if n != s}
    return out


CASES = {
    "no edges": [],
    "acyclic": [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)],
    "one ring": [(1, 2), (2, 3), (3, 1)],
    "rings in a row": [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5), (5, 6), (6, 5), (0, 1), (6, 7)],
    "odd": [(1, 1), (1, 2), (1, 2), (2, None), (None, 1), (3, 3)],
}


@pytest.mark.parametrize("name", CASES)
def test_reachable(spark, name):
    edges = spark.createDataFrame(CASES[name], EDGES)
    starts = sorted({n for e in CASES[name] for n in e if n is not None} | {99})
    frame = spark.createDataFrame([(s,) for s in starts], "dataset_id long")
    found = [tuple(r) for r in reachability.reachable(edges, frame).collect()]
    assert set(found) == brute(CASES[name], starts) and len(found) == len(set(found))


def test_reachable_on_a_random_graph_both_ways(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(75)]
    frame = spark.createDataFrame(edges, EDGES)
    starts = spark.range(60).select(F.col("id").alias("dataset_id"))
    assert {tuple(r) for r in reachability.reachable(frame, starts).collect()} == brute(edges, range(60))
    assert {tuple(r) for r in reachability.reachable(frame, starts, "upstream").collect()} == brute([(b, a) for a, b in edges], range(60))


def test_strong_components(spark, rows):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (7, 1)], "a long, b long")
    assert rows(reachability.strong_components(edges)) == [(1, 3), (2, 3), (3, 3), (4, 5), (5, 5)]
    assert rows(reachability.strong_components(edges.where("a < b"))) == []
