import numpy as np
import pytest

from recordloom.llm import forest, queries, topk
from tests.compare import connect, rows_of
from tests.llm.helpers import SF_DIR, given

ODD = [
    (0, [1.0, 0.0], "a"), (50, [1.0, 0.0], "a"), (1, [0.5, 0.5], "a"), (2, None, "a"), (3, [float("nan"), 1.0], "a"),
    (4, [float("inf"), 1.0], "a"), (5, [None, 1.0], "a"), (6, [0.0, 0.0], "a"), (7, [-1.0, 2.0, 3.0], "a"), (None, [1.0, 1.0], "a"),
    (100, [], "a"), (9, [1.0, 0.0], "a"), (8, [1.0, 0.0], "a"), (10, [-0.25, 0.75], "a"),
]


def odd_vectors(spark):
    return spark.createDataFrame(ODD, "vec_id long, embedding array<float>, score string")


def brute(rows, score, k=5):
    out = []
    for q, a in rows:
        if q % 50 == 0:
            found = sorted(((-score(a, b), n) for n, b in rows if n != q))[:k]
            out += [(q, i, n, -s) for i, (s, n) in enumerate(found, 1)]
    return out


def pad(v, n=3):
    return np.array([*v, *[0.0] * (n - len(v))])


def test_op5(spark):
    con = connect(SF_DIR)
    cur = con.execute(queries.SQL["op5_topk"])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    df = queries.op5_topk(spark, SF_DIR)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_topk_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 3)
    monkeypatch.setattr(topk, "QUERIES", 2)
    from pyspark.sql import functions as F

    df = odd_vectors(spark)
    got = [tuple(r) for r in topk.search(df, "vec_id", "embedding", df.vec_id % 50 == 0, 5, weight=lambda x: F.floor(256 * x).cast("double")).collect()]
    rows = [(i, np.floor(256 * pad(v))) for i, v, _ in ODD if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    assert sorted(got) == sorted(brute(rows, lambda a, b: int(a @ b)))
    none = df.where("vec_id < 0")
    assert topk.search(none, "vec_id", "embedding", none.vec_id % 50 == 0, 5).count() == 0


def test_postings_like_a_product():
    dice = np.random.default_rng(2)
    rows = dice.integers(-3, 4, (300, 12)) * (dice.random((300, 12)) < 0.3)
    index = topk.Postings(np.arange(300), rows)
    for q in range(20):
        assert (index.scores(rows[q]) == rows @ rows[q]).all()
        want = sorted((-s, n) for n, s in enumerate(rows @ rows[q]) if n != q)[:7]
        assert [(-s, n) for n, s in zip(*index.top(q, rows[q], 7))] == want


def cosine(a, b):
    return float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))


def test_recall_and_order(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in forest.search(df, "vec_id", "embedding", df.vec_id % 50 == 0, 5, leaf_rows=32, share=1.0, least=0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    rows = {r.vec_id: np.array(r.embedding) for r in df.collect()}
    hits = []
    for q, found in got.items():
        found.sort()
        want = sorted((-cosine(rows[q], v), n) for n, v in rows.items() if n != q)[:5]
        hits.append(len({n for _, n in want} & {n for _, n, _ in found}) / 5)
        assert [i for i, _, _ in found] == [1, 2, 3, 4, 5]
        assert [n for _, n, _ in found] == [n for _, n in sorted((-s, n) for _, n, s in found)]
        for _, n, s in found:
            assert s == pytest.approx(cosine(rows[q], rows[n]), abs=1e-14)
    assert len(got) == sum(n % 50 == 0 for n in rows)
    assert np.mean(hits) >= 0.9


@pytest.mark.parametrize("n", [6000, 10000])
def test_recall_of_the_defaults_without_structure(spark, n):
    width = len(given(spark, "embeddings").where("embedding is not null").first().embedding)
    rows = np.random.default_rng(n).standard_normal((n, width))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in forest.search(df, "vec_id", "embedding", df.vec_id % 50 == 0, 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows /= np.sqrt((rows * rows).sum(axis=1))[:, None]
    hits = []
    for q in range(0, n, 50):
        score = rows @ rows[q]
        score[q] = -2
        hits.append(len(got[q] & set(np.argsort(-score)[:5].tolist())) / 5)
    assert np.mean(hits) >= 0.92, np.mean(hits)


def test_op3_is_exact_on_few_rows(spark):
    rows = [(r.vec_id, np.array(r.embedding)) for r in given(spark, "embeddings").collect()]
    got = [(r.query_id, r["rank"], r.vec_id) for r in queries.op3_neighbours(spark, SF_DIR).collect()]
    assert sorted(got) == sorted(r[:3] for r in brute(rows, cosine))


def test_neighbours_of_odd_rows(spark):
    df = odd_vectors(spark)
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in forest.search(df, "vec_id", "embedding", df.vec_id % 50 == 0, 5, leaf_rows=2).collect()]
    rows = [(i, pad(v)) for i, v, _ in ODD if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    assert sorted(got) == sorted((q, i, n, round(s, 12)) for q, i, n, s in brute(rows, cosine))
    none = df.where("vec_id < 0")
    assert forest.search(none, "vec_id", "embedding", none.vec_id % 50 == 0, 5).count() == 0
    one = df.where("vec_id = 0")
    assert forest.search(one, "vec_id", "embedding", one.vec_id % 50 == 0, 5).count() == 0


def test_one_common_vector(spark):
    rows = [(i, [0.5, 0.25, 1.0] if i % 3 else [float(i), 1.0, -1.0]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = [(r.query_id, r["rank"], r.vec_id) for r in forest.search(df, "vec_id", "embedding", df.vec_id % 50 == 0, 5, leaf_rows=16).collect()]
    exact = brute([(i, np.array(v)) for i, v in rows], lambda a, b: float((b * a).sum() / (np.sqrt((b * b).sum()) * np.sqrt((a * a).sum()))))
    common = [r for r in got if r[0] % 3]
    assert sorted(common) == sorted(r[:3] for r in exact if r[0] % 3)


def test_queue_visits_near_leaves_first():
    rows = forest.unit(np.random.default_rng(1).standard_normal((500, 6)))
    trees = [forest.Tree.fit(rows, 4, s) for s in range(3)]
    leaves = [t.leaves(rows) for t in trees]
    for i in range(30):
        order = forest.search_leaves(trees, rows[i], 48)
        assert len(set(order)) == len(order) == 48
        own = {(t, int(leaf[i])) for t, leaf in enumerate(leaves)}
        assert own <= set(order[:40])
    assert max(np.bincount(leaves[0])) <= 2 * 500 / 16
