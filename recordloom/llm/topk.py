"""Exact top-k search by inner product: term-at-a-time accumulation over postings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.vectors import matrix, rows_of

#: Rows of a block of candidates, and of a block of queries.
CANDIDATES, QUERIES = 4096, 2048


class Postings:
    """Inverted index of a block: for each term the rows that have it, with their weights."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        self.ids = ids
        term, row = np.nonzero(weights.T)
        self.rows, self.weights = row, weights[row, term]
        self.starts = np.searchsorted(term, np.arange(weights.shape[1] + 1))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """The score of every row: the query's terms scatter their weighted postings, one after the other."""
        out = np.zeros(len(self.ids), np.int64)
        for term in np.flatnonzero(query[: len(self.starts) - 1]):
            own = slice(self.starts[term], self.starts[term + 1])
            out[self.rows[own]] += query[term] * self.weights[own]  # a row occurs once in a posting list
        return out

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best rows but the query's own, ties to smaller ids."""
        score = self.scores(query)
        place = np.flatnonzero(self.ids != query_id)
        if len(place) > k:
            least = np.partition(score[place], len(place) - k)[len(place) - k]
            place = place[score[place] >= least]
        place = place[np.lexsort((self.ids[place], -score[place]))][:k]
        return self.ids[place], score[place]


def _search(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    width = max(matrix(t["weights"]).shape[1] for t in (queries, candidates))
    index = Postings(candidates["id"].to_numpy(), np.rint(matrix(candidates["weights"], width)).astype(np.int64))
    rows = np.rint(matrix(queries["weights"], width)).astype(np.int64)
    found = [(q, *index.top(q, row, k)) for q, row in zip(queries["id"].to_pylist(), rows)]
    none = np.zeros(0, np.int64)
    return pa.table({
        "query_id": pa.array(np.concatenate([none, *(np.full(len(ids), q) for q, ids, _ in found)]), pa.int64()),
        "vec_id": pa.array(np.concatenate([none, *(ids for _, ids, _ in found)]), pa.int64()),
        "score": pa.array(np.concatenate([none, *(score for *_, score in found)]), pa.int64()),
    })


def search(df: DataFrame, key: str, vector: str, is_query: Column, k: int, weight=lambda x: x) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` rows with the largest inner product, exactly.

    ``is_query`` chooses the queries among the rows, ``weight`` turns a component into a whole
    number below 2^53. All rows but the query's own are candidates; ties go to the smaller id.
    Vectors of different lengths are taken as sparse: a missing component is 0. Null keys, null
    vectors and vectors with null or non-finite components take no part. Rows that share an
    id are candidates each for themselves, but none for queries of this id; queries that share
    one are answered once, by the first of their vectors in order.

    Blocks of queries meet blocks of candidates, each pair in one task, where the queries' terms
    scatter into dense score arrays. A task sends ``k`` rows per query, which are merged by query.
    """
    weights = F.transform("vector", weight).alias("weights")
    rows = rows_of(df, key, vector).select("id", weights)
    asked = rows_of(df.where(is_query), key, vector).select("id", weights).groupBy("id").agg(F.min("weights").alias("weights"))
    blocks, query_blocks = -(-rows.count() // CANDIDATES) or 1, -(-asked.count() // QUERIES) or 1
    left = asked.select(
        F.pmod(F.xxhash64("id"), F.lit(query_blocks)).alias("query_block"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("block"), "id", "weights",
    )
    right = rows.select(
        F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<long>")).alias("query_block"), "id", "weights",
    )
    found = left.groupBy("query_block", "block").cogroup(right.groupBy("query_block", "block")).applyInArrow(
        lambda asked, candidates: _search(asked, candidates, k), "query_id long, vec_id long, score long"
    )
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each query, ties to smaller ids."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
