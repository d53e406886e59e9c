"""Approximate nearest neighbours: a forest of random-projection trees and exact reranking of its leaves."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.topk import ranked
from recordloom.llm.vectors import matrix, usable

TREES = 16
#: Rows of a leaf, about.
LEAF_ROWS = 256
#: Vectors that the trees are fitted on, about, at most; bounds their depth and with it what is broadcast.
SAMPLE_ROWS = 65_536
DEEPEST = 14
#: Rows that a query's leaves hold, about: this share of all rows, and at least so many.
SEARCH_SHARE, SEARCH_ROWS = 0.85, 4096
#: Leaves whose rows are kept together.
BLOCK_LEAVES = 32


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows."""
    rows = rows / np.maximum(np.abs(rows).max(axis=1, initial=0), 1e-300)[:, None]
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


class Tree:
    """A complete binary tree; node ``n`` has the children ``2 n + 1`` and ``2 n + 2``."""

    def __init__(self, normals: np.ndarray, borders: np.ndarray, depth: int):
        self.normals, self.borders, self.depth = normals, borders, depth

    @classmethod
    def fit(cls, rows: np.ndarray, depth: int, seed: int) -> Tree:
        """Each node is cut at the median across the line between two of its rows."""
        dice = np.random.default_rng(seed)
        normals = dice.standard_normal(((1 << depth) - 1, rows.shape[1]))
        borders = np.zeros(len(normals))
        rows_of = {0: np.arange(len(rows))}
        for n in range(len(normals)):
            own = rows_of.pop(n)
            if len(own) > 1:
                a, b = dice.choice(own, 2, replace=False)
                if (rows[a] != rows[b]).any():
                    normals[n] = rows[a] - rows[b]
            normals[n] /= np.sqrt((normals[n] ** 2).sum()) or 1
            height = rows[own] @ normals[n]
            borders[n] = np.median(height) if len(own) else 0
            above = height > borders[n]
            rows_of[2 * n + 1], rows_of[2 * n + 2] = own[~above], own[above]
        return cls(normals.astype(np.float32), borders.astype(np.float32), depth)

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            height = np.einsum("ij,ij->i", rows, self.normals[node])
            node = 2 * node + 1 + (height > self.borders[node])
        return node - len(self.normals)


def search_leaves(forest: list[Tree], row: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The first ``most`` leaves ``(tree, leaf)`` that one queue for all trees gives.

    The queue holds nodes by how far the query is inside their cuts at least, the roots first.
    """
    inside = [(t.normals @ row - t.borders).tolist() for t in forest]
    queue = [(-np.inf, t, 0) for t in range(len(forest))]
    found: list[tuple[int, int]] = []
    while queue and len(found) < most:
        worst, t, n = heapq.heappop(queue)
        margins, size = inside[t], len(inside[t])
        while n < size:
            margin = margins[n]
            near, far = (2 * n + 2, 2 * n + 1) if margin > 0 else (2 * n + 1, 2 * n + 2)
            heapq.heappush(queue, (max(worst, abs(margin)), t, far))
            worst, n = max(worst, -abs(margin)), near
        found.append((t, n - size))
    return found


def _fit(table: pa.Table, depth: int) -> pa.Table:
    tree = table["tree"][0].as_py()
    rows = table.sort_by("id")
    fitted = Tree.fit(unit(matrix(rows["vector"])), depth, tree)
    return pa.table({
        "tree": pa.array([tree], pa.int32()), "width": pa.array([fitted.normals.shape[1]], pa.int32()),
        "normals": pa.array([fitted.normals.tobytes()], pa.binary()), "borders": pa.array([fitted.borders.tobytes()], pa.binary()),
    })


def forest_of(rows: list) -> list[Tree]:
    out = []
    for _, width, normals, borders in sorted(rows):
        borders = np.frombuffer(borders, np.float32)
        out.append(Tree(np.frombuffer(normals, np.float32).reshape(-1, width), borders, (len(borders) + 1).bit_length() - 1))
    return out


def _index(batches: Iterator[pa.RecordBatch], forest: Broadcast) -> Iterator[pa.RecordBatch]:
    trees = forest_of(forest.value)
    for batch in batches:
        for begin in range(0, batch.num_rows, 4096):
            part = batch.slice(begin, 4096)
            rows = unit(fitted(matrix(part.column("vector")), trees))
            for t, tree in enumerate(trees):
                leaf = tree.leaves(rows)
                yield pa.record_batch({
                    "tree": pa.array(np.full(len(rows), t, np.int32)), "block": pa.array((leaf // BLOCK_LEAVES).astype(np.int32)),
                    "leaf": pa.array(leaf.astype(np.int32)), "ids": part.column("ids"), "vector": part.column("vector"),
                })


def fitted(rows: np.ndarray, trees: list[Tree]) -> np.ndarray:
    """Rows as wide as the trees: filled up, or without the components that no sampled vector has."""
    width = trees[0].normals.shape[1]
    out = np.zeros((len(rows), width))
    out[:, : rows.shape[1]] = rows[:, :width]
    out[~out.any(axis=1)] = 1.0
    return out


def _route(batches: Iterator[pa.RecordBatch], forest: Broadcast, most: int) -> Iterator[pa.RecordBatch]:
    trees = forest_of(forest.value)
    for batch in batches:
        rows = unit(fitted(matrix(batch.column("vector")), trees))
        at, tree, block, leaves = [], [], [], []
        for i, row in enumerate(rows):
            by_block: dict[tuple[int, int], list[int]] = {}
            for t, leaf in search_leaves(trees, row, most):
                by_block.setdefault((t, leaf // BLOCK_LEAVES), []).append(leaf)
            for (t, b), own in by_block.items():
                at.append(i)
                tree.append(t)
                block.append(b)
                leaves.append(own)
        where = pa.array(at, pa.int64())
        yield pa.record_batch({
            "tree": pa.array(tree, pa.int32()), "block": pa.array(block, pa.int32()), "query_id": batch.column("id").take(where),
            "leaves": pa.array(leaves, pa.list_(pa.int32())), "vector": batch.column("vector").take(where),
        })


def cosines(row: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact cosines, added up the same way wherever they are computed.

    Vectors are brought to components of about 1 by powers of two, which changes no digit, so that the
    squares of very large or small ones neither overflow nor vanish.
    """
    row = np.ldexp(row, -np.frexp(np.abs(row).max(initial=0.0))[1])
    others = np.ldexp(others, -np.frexp(np.abs(others).max(axis=1, initial=0.0))[1][:, None])
    return (others * row).sum(axis=1) / (np.sqrt((others * others).sum(axis=1)) * np.sqrt((row * row).sum()))


def _rerank(queries: pa.Table, members: pa.Table, k: int) -> pa.Table:
    """The best ``k`` candidates of each query among the members of its leaves."""
    width = max(matrix(t["vector"]).shape[1] for t in (queries, members))
    asked, rows = matrix(queries["vector"], width), matrix(members["vector"], width)
    near, far = unit(asked) if len(asked) else asked, unit(rows) if len(rows) else rows
    ids, leaf = members["ids"].to_pylist(), members["leaf"].to_numpy()
    order = np.argsort(leaf, kind="stable")
    leaf = leaf[order]
    visits: dict[int, list[int]] = {}
    for i, leaves in enumerate(queries["leaves"].to_pylist()):
        for own in leaves:
            visits.setdefault(own, []).append(i)
    best: dict[int, list[np.ndarray]] = {}
    for own, who in visits.items():
        place = order[np.searchsorted(leaf, own): np.searchsorted(leaf, own, side="right")]
        if not len(place):
            continue
        score = near[who] @ far[place].T
        if len(place) > k + 1:
            # one more than asked for, as the query itself may be among them, and all about as near as the last
            least = np.partition(score, len(place) - k - 1, axis=1)[:, len(place) - k - 1] - 1e-9
            hits = [place[s >= x] for s, x in zip(score, least)]
        else:
            hits = [place] * len(who)
        for i, hit in zip(who, hits):
            best.setdefault(i, []).append(hit)
    out: list[tuple[int, int, float]] = []
    names = queries["query_id"].to_pylist()
    for i, hits in best.items():
        place = np.concatenate(hits)
        found = [(-s, n) for s, p in zip(cosines(asked[i], rows[place]).tolist(), place.tolist()) for n in ids[p] if n != names[i]]
        out += [(names[i], n, -s) for s, n in heapq.nsmallest(k, found)]
    return pa.table({
        "query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()),
        "score": pa.array([o[2] for o in out], pa.float64()),
    })


def search(df: DataFrame, key: str, vector: str, is_query: Column, k: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS,
           sample_rows: int = SAMPLE_ROWS, share: float = SEARCH_SHARE, least: int = SEARCH_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` nearest rows found, by cosine.

    ``is_query`` chooses the queries; all rows but the query's own are candidates, ties go to the
    smaller id. The trees are fitted on about ``sample_rows`` vectors at most, chosen by a hash of
    their id, one tree per task; every row is indexed. A query takes leaves from one queue for
    all trees until they hold about ``share`` of all rows and at least ``least``. Their members
    are compared exactly on the original vectors, blocks of leaves each in one task. Vectors
    without any structure need a large share; recall is tested against brute force.

    Equal vectors are indexed once, with their ``k + 1`` smallest ids: more cannot be among the
    nearest of any query. Null keys, null, empty and zero vectors and those with null or
    non-finite components take no part. Shorter vectors are filled up with zeros. Rows that
    share an id count as one if their vectors are equal; queries that share one are asked once, by the first
    of their vectors in order, and a candidate of two vectors counts with the nearer one.
    """
    spark = df.sparkSession
    wanted = usable(df[vector]) & F.exists(df[vector], lambda x: x != 0) & df[key].isNotNull()
    rows = df.where(wanted).select(df[key].cast("long").alias("id"), df[vector].alias("vector"))
    asked = df.where(wanted & is_query).select(df[key].cast("long").alias("id"), df[vector].alias("vector"))
    asked = asked.groupBy("id").agg(F.min("vector").alias("vector"))
    smallest = Window.partitionBy("vector").orderBy("id")
    # a row number limit is applied before the shuffle too, so a common vector sends few rows
    few = rows.distinct().withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
    distinct = few.groupBy("vector").agg(F.collect_list("id").alias("ids"))

    n = rows.count()
    chosen = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(1.0, sample_rows / max(1, n)) * (1 << 20))
    depth = max(0, min(DEEPEST, int(np.ceil(np.log2(max(1, n) / leaf_rows)))))
    sample = rows.where(chosen).select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "id", "vector")
    fit = sample.groupBy("tree").applyInArrow(lambda t: _fit(t, depth), "tree int, width int, normals binary, borders binary")
    fitted_trees = [tuple(r) for r in fit.collect()]  # bounded by the depth
    if not fitted_trees:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = spark.sparkContext.broadcast([(t, w, bytes(a), bytes(b)) for t, w, a, b in fitted_trees])

    kind = df.schema[vector].dataType.simpleString()
    leaf_size = max(1.0, n / (1 << depth))
    most = int(np.ceil(max(least, share * n) / leaf_size))
    members = distinct.mapInArrow(partial(_index, forest=forest), f"tree int, block int, leaf int, ids array<long>, vector {kind}")
    routed = asked.mapInArrow(partial(_route, forest=forest, most=most), f"tree int, block int, query_id long, leaves array<int>, vector {kind}")
    found = routed.groupBy("tree", "block").cogroup(members.groupBy("tree", "block")).applyInArrow(
        lambda asked, members: _rerank(asked, members, k), "query_id long, vec_id long, score double"
    )
    return ranked(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)
