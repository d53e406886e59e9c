"""Packing of documents into windows of tokens, neighbours found by lexical retrieval in shards of related documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import offsets, parts, ranges, text_list, worker_memory
from recordloom.llm.tokens import byte_encoder
from recordloom.llm.windows import mixed
from recordloom.session import scratch_path

#: BM25: how soon a repeated term saturates, and how much a text's length counts.
SATURATION, LENGTH_WEIGHT = 1.2, 0.75
#: Documents that the routing tree is fitted on, about, and of these at least so many in a leaf.
SAMPLE_ROWS, LEAF_ROWS = 1 << 13, 16
#: Directions that documents are projected on to be routed.
DIRECTIONS = 64
#: Tokens that a task packs, shards of at most so many tokens and pieces each, and most tasks.
PART_TOKENS, SHARD_TOKENS, SHARD_PIECES, MOST_PARTS = 1 << 22, 1 << 19, 1 << 11, 100_000
#: Seeds whose scores are computed together, and neighbours sorted before all of a shard are.
SEEDS, NEAREST = 64, 64
#: Terms in more than this share of a shard's pieces are multiplied as a dense matrix, at most so many of them.
COMMON_SHARE, MOST_COMMON = 0.06, 1 << 10
#: Ids are written twice as large as their texts, so they are packed better than by default.
CODEC = "zstd"
#: Bits of a number that count within a task, and of a task's number within a level.
PLACE_BITS, TASK_BITS = 40, 20

#: What a piece carries from level to level; ``sequence_id`` is null while it is unused.
PIECE = "start long, ids binary, doc_tokens long, sequence_id long, offset long, number long, leaf int, mark long, terms binary, counts binary"
NAMES = [c.split()[0] for c in PIECE.split(", ")]
KINDS = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in PIECE.split(", ")]


def weigh(found: np.ndarray, texts: int, count: np.ndarray, size: np.ndarray, mean: float) -> np.ndarray:
    """BM25 weights of terms that are ``found`` in so many texts and ``count`` times in one of ``size`` tokens."""
    norm = SATURATION * (1 - LENGTH_WEIGHT + LENGTH_WEIGHT * size / mean)
    return np.log1p((texts - found + 0.5) / (found + 0.5)) * count * (SATURATION + 1) / (count + norm)


class Shard:
    """BM25 index of ``(terms, counts)`` of documents, weighted by the statistics of the corpus: postings by term, frequent terms as a matrix."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], statistics: tuple):
        found, texts, mean = statistics
        lengths = np.array([len(t) for t, _ in vectors], np.int64)
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)]).astype(np.int64)
        count = np.concatenate([np.zeros(0, np.int64), *(c for _, c in vectors)]).astype(np.int64)
        text = np.repeat(np.arange(len(vectors)), lengths)
        weight = weigh(found[term], texts, count, np.bincount(text, count, len(vectors))[text], mean)
        here = np.bincount(term, minlength=len(found))
        common = np.flatnonzero(here > COMMON_SHARE * len(vectors))
        common = common[np.argsort(-here[common], kind="stable")[:MOST_COMMON]]
        self.size = len(vectors)
        self.column = np.full(len(found), -1, np.int64)
        self.column[common] = np.arange(len(common))
        column = self.column[term]
        self.dense = np.zeros((len(common), len(vectors)), np.float32)
        self.dense[column[column >= 0], text[column >= 0]] = weight[column >= 0]
        order = np.flatnonzero(column < 0)
        order = order[np.argsort(term[order], kind="stable")]
        self.text, self.weight = text[order], weight[order]
        self.starts = offsets(np.where(self.column < 0, here, 0))

    def scores(self, queries: list[np.ndarray]) -> np.ndarray:
        """A row per query, lists of distinct terms, with the scores of all documents."""
        row = np.repeat(np.arange(len(queries)), [len(q) for q in queries])
        query = np.concatenate([np.zeros(0, np.int64), *queries]).astype(np.int64)
        column = self.column[query]
        asked = np.zeros((len(queries), len(self.dense)), np.float32)
        asked[row[column >= 0], column[column >= 0]] = 1
        row, query = row[column < 0], query[column < 0]
        length = self.starts[query + 1] - self.starts[query]
        at = ranges(self.starts[query], length)
        rare = np.bincount(np.repeat(row * self.size, length) + self.text[at], self.weight[at], len(queries) * self.size)
        return asked @ self.dense + rare.reshape(len(queries), self.size).astype(np.float32)


def best_first(score: np.ndarray) -> Iterator[int]:
    """Places by falling score, ties by place; most consumers need only a few of them."""
    if len(score) > NEAREST:
        near = np.flatnonzero(score >= np.partition(score, len(score) - NEAREST)[-NEAREST])
        yield from near[np.argsort(-score[near], kind="stable")].tolist()
        score = score.copy()
        score[near] = -np.inf
        yield from np.argsort(-score, kind="stable")[: len(score) - len(near)].tolist()
    else:
        yield from np.argsort(-score, kind="stable").tolist()


def fill(free: np.ndarray, index: Shard, queries: list[np.ndarray], window: int) -> Iterator[list[tuple[int, int]]]:
    """Full windows of ``(piece, tokens)``; ``free`` holds the unused tokens of every piece and is counted down.

    Each window starts with the longest unused piece, the seed, and takes its best unused
    neighbours while there is space. The last one is cut; what is left of it stays unused.
    """
    left, known = int(free.sum()), {}
    while left >= window:
        seed = int(np.argmax(free))
        if seed not in known:
            ask = np.argsort(-free, kind="stable")[:SEEDS]
            ask = ask[free[ask] > 0].tolist()
            known = dict(zip(ask, index.scores([queries[n] for n in ask])))
        score = np.where(free > 0, known.pop(seed), -1)
        score[seed] = np.inf
        taken, space = [], window
        for n in best_first(score):
            length = min(int(free[n]), space)
            taken.append((n, length))
            free[n] -= length
            space -= length
            if not space:
                break
        left -= window
        yield taken


def fill_rest(free: np.ndarray) -> Iterator[list[tuple[int, int]]]:
    """Windows of powers of two, which need no padding, for what is left at the end."""
    total, n = int(free.sum()), 0
    while total:
        space, taken = 1 << (total.bit_length() - 1), []
        total -= space
        while space:
            length = min(int(free[n]), space)
            if length:
                taken.append((n, length))
            free[n] -= length
            space -= length
            n += not free[n]
        yield taken


def directions(terms: int) -> np.ndarray:
    """A fixed sign per term and direction."""
    memory = worker_memory()
    if ("directions", terms) not in memory:
        cell = np.arange(terms * DIRECTIONS, dtype=np.uint64)
        memory["directions", terms] = ((mixed(cell) & np.uint64(1)).astype(np.float32) * 2 - 1).reshape(terms, DIRECTIONS)
    return memory["directions", terms]


def project(vectors: list[tuple[np.ndarray, np.ndarray]], terms: int) -> np.ndarray:
    """Documents as unit vectors of projected, damped term counts."""
    signs, out = directions(terms), np.zeros((len(vectors), DIRECTIONS), np.float32)
    for n, (own, counts) in enumerate(vectors):
        out[n] = np.log1p(counts).astype(np.float32) @ signs[own]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fit_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normals and borders of a binary tree in heap order: each node halves its points between two means."""
    depth = max(0, int(np.log2(max(1, len(points) / LEAF_ROWS))))
    normals, borders = np.zeros((1 << depth, DIRECTIONS), np.float32), np.zeros(1 << depth, np.float32)
    groups = {1: np.arange(len(points))}
    for node in range(1, 1 << depth):
        own = groups.pop(node)
        here = points[own]
        if len(own):
            far = here[np.argmax(((here - here.mean(0)) ** 2).sum(1))]
            side = (here @ far) > np.median(here @ far)
            for _ in range(8):
                if side.all() or not side.any():
                    break
                normal = here[side].mean(0) - here[~side].mean(0)
                normals[node], borders[node] = normal, np.median(here @ normal)
                side = here @ normal > borders[node]
        side = here @ normals[node] > borders[node]
        groups[2 * node], groups[2 * node + 1] = own[~side], own[side]
    return normals, borders


def leaves(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    normals, borders = tree
    node = np.ones(len(points), np.int64)
    while len(node) and node[0] < len(borders):  # all points are on one level
        node = 2 * node + ((points * normals[node]).sum(1) > borders[node])
    return node - len(borders)


def _points(batches: Iterator[pa.RecordBatch], path: str, terms: int) -> Iterator[pa.RecordBatch]:
    encoder = byte_encoder(path)
    for part in parts(batches, "text"):
        points = project([np.unique(encoder.encode(t), return_counts=True) for t in text_list(part.column("text"))], terms)
        yield pa.record_batch({"point": pa.array([p.tobytes() for p in points], pa.binary())})


def routing_tree(df: DataFrame, text: str, path: str, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """The tree that documents are routed by, fitted on about ``SAMPLE_ROWS`` distinct texts, twice as many at most."""
    texts = df.select(df[text].alias("text")).where(F.col("text") != "")
    share = min(1.0, SAMPLE_ROWS / max(1, texts.count()))
    mark = F.xxhash64("text")
    chosen = texts.where(F.pmod(mark, F.lit(1 << 30)) < int(share * (1 << 30))).groupBy(mark.alias("mark")).agg(F.first("text").alias("text"))
    points = chosen.select("text").limit(2 * SAMPLE_ROWS).mapInArrow(partial(_points, path=path, terms=terms), "point binary").collect()
    return fit_tree(np.array([np.frombuffer(p.point, np.float32) for p in points], np.float32).reshape(-1, DIRECTIONS))


def record(key: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * (1 + len(NAMES))
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [key, *KINDS])], ["key", *NAMES])


def _encode(batches: Iterator[pa.RecordBatch], path: str, end: int, window: int, terms: int, tree) -> Iterator[pa.RecordBatch]:
    """Windows that documents fill by themselves, numbered; the tail of every document, routed; one row of statistics.

    A tail has the terms of its whole document beside it if they are not those of the tail.
    The last row, without a ``doc_tokens``, counts documents per term, documents, tokens and tokens of tails.
    """
    encoder, tree = byte_encoder(path), tree.value
    sequence = number = TaskContext.get().partitionId() << PLACE_BITS
    found, kind = np.zeros(terms + 3, np.int64), pa.null()
    for part in parts(batches, "text"):
        rows, vectors, routed = [], [], []
        kind = part.schema.field("key").type
        for key, text in zip(part.column("key").to_pylist(), text_list(part.column("text"))):
            ids = np.append(encoder.encode(text), np.uint32(end)).astype("<u4")
            full = len(ids) // window * window
            for start in range(0, full, window):
                rows.append((key, start, ids[start: start + window].tobytes(), len(ids), sequence, 0, None, None, None, None, None))
                sequence += 1
            own, counts = np.unique(ids, return_counts=True)
            found[own] += 1
            found[terms:] += 1, len(ids), len(ids) - full
            if full < len(ids):
                whole = (own.astype("<u4").tobytes(), counts.astype("<u4").tobytes()) if full else (None, None)
                routed.append((key, full, ids[full:].tobytes(), len(ids), number, int(mixed(own.astype(np.uint64)).min() >> np.uint64(1)), *whole))
                vectors.append((own, counts))
                number += 1
        for (*piece, number_, mark, own, counts), leaf in zip(routed, leaves(project(vectors, terms), tree).tolist()):
            rows.append((*piece, None, None, number_, leaf, mark, own, counts))
        yield record(kind, rows)
    if found[terms]:
        at = np.flatnonzero(found)
        yield record(kind, [(None, None, None, None, None, None, None, None, None, at.astype("<i8").tobytes(), found[at].astype("<i8").tobytes())])


def _count_terms(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[pa.RecordBatch]:
    """The sums of the rows of statistics."""
    found = np.zeros(terms + 3, np.int64)
    for batch in batches:
        for at, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist()):
            found[np.frombuffer(at, "<i8")] += np.frombuffer(counts, "<i8")
    at = np.flatnonzero(found)
    yield pa.record_batch({"term": pa.array(at, pa.int64()), "found": pa.array(found[at], pa.int64())})


def vectors_of(rows: list[dict], terms: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Terms and counts of the documents of some pieces."""
    ids = [np.zeros(0, "<u4") if r["terms"] else np.frombuffer(r["ids"], "<u4") for r in rows]
    pair = np.repeat(np.arange(len(rows), dtype=np.int64) * terms, [len(i) for i in ids]) + np.concatenate([np.zeros(0, "<u4"), *ids])
    pair, count = np.unique(pair, return_counts=True)
    bounds = np.searchsorted(pair, np.arange(len(rows) + 1, dtype=np.int64) * terms)
    own = (pair % terms).astype("<u4")
    return [
        (np.frombuffer(r["terms"], "<u4"), np.frombuffer(r["counts"], "<u4")) if r["terms"] else (own[a:b], count[a:b].astype("<u4"))
        for r, a, b in zip(rows, bounds, bounds[1:])
    ]


class Packer:
    """Packs the pieces of a task, shard after shard; what a shard leaves goes into the next one."""

    def __init__(self, key: pa.DataType, window: int, first: int, statistics: tuple):
        self.key, self.window, self.next, self.statistics = key, window, first, statistics
        self.pool: list[tuple[dict, tuple]] = []
        self.tokens = 0

    def add(self, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        for row, vector in zip(rows, vectors_of(rows, len(self.statistics[0]))):
            self.pool.append((row, vector))
            self.tokens += len(row["ids"]) // 4
            if self.tokens >= 2 * self.window and (self.tokens >= SHARD_TOKENS or len(self.pool) >= SHARD_PIECES):
                yield self.pack()

    def pack(self, rest: bool = False) -> pa.RecordBatch:
        """The windows of a shard; with ``rest`` also those of powers of two for what it leaves."""
        self.pool.sort(key=lambda p: p[0]["number"])
        free = np.array([len(r["ids"]) // 4 for r, _ in self.pool], np.int64)
        size, rows = free.copy(), []
        windows = fill(free, Shard([v for _, v in self.pool], self.statistics), [v[0] for _, v in self.pool], self.window)
        used = np.zeros(len(free), np.int64)
        for taken in [*windows, *(fill_rest(free) if rest else ())]:
            offset = 0
            for n, length in taken:
                row, begin = self.pool[n][0], int(used[n])
                rows.append((row["key"], row["start"] + begin, row["ids"][4 * begin: 4 * (begin + length)], row["doc_tokens"],
                             self.next, offset, None, None, None, None, None))
                used[n] += length
                offset += length
            self.next += 1
        self.pool = [(r | {"start": r["start"] + int(u), "ids": r["ids"][4 * int(u):]}, v) for (r, v), u, s in zip(self.pool, used, size) if u < s]
        self.tokens = int((size - used).sum())
        return record(self.key, rows)

    def left(self) -> pa.RecordBatch:
        return record(self.key, [
            (r["key"], r["start"], r["ids"], r["doc_tokens"], None, None, r["number"], r["leaf"], r["mark"], own.astype("<u4").tobytes(), counts.astype("<u4").tobytes())
            for r, (own, counts) in self.pool
        ])


def _pack(batches: Iterator[pa.RecordBatch], statistics, window: int, level: int, last: bool) -> Iterator[pa.RecordBatch]:
    packer = None
    for batch in batches:
        if packer is None:
            first = (level << TASK_BITS | TaskContext.get().partitionId()) << PLACE_BITS
            packer = Packer(batch.schema.field("key").type, window, first, statistics.value)
        for begin in range(0, batch.num_rows, SHARD_PIECES):
            yield from packer.add(batch.slice(begin, SHARD_PIECES).to_pylist())
    if packer:
        yield packer.pack(rest=last)
        yield packer.left()


def pack(df: DataFrame, key: str, text: str, vocabulary: str, end: int, window: int) -> DataFrame:
    """``key, start, length, ids, doc_tokens, sequence_id, offset``: pieces of documents packed into windows.

    A document is its ids and ``end`` after them; a null text counts as empty and is ``end``
    alone. Windows that a document fills by itself are cut off its start. What is left, its
    tail, goes into one pool of the whole corpus, which is dealt into shards of related
    documents: a tree of means, fitted on a bounded sample and applied to all, gives the leaf, the
    smallest hash of a document's terms the order there, so that copies are neighbours. Sorted
    by both over all partitions, runs of 2^19 tokens or 2,048 pieces are shards with a BM25 index each.

    In a shard the longest unused piece is the next seed, and its best unused neighbours by BM25
    fill its window; the last one is cut, what is left of it stays unused. A tail is searched
    for, and found, by the terms of its whole document; document frequencies and the mean length
    are those of the corpus. A seed sees its shard, not the corpus, so the work grows with
    the corpus and not with its square. What a shard cannot use goes into the next one; what a
    task leaves, less than a window, into the next level, where the same is done with what all tasks
    left, until one task holds it; what remains there goes into windows of powers of two, so no window is padded.

    ``ids`` are little-endian unsigned 32-bit numbers. Repeated rows and null keys are documents
    like others; other columns are left out. The encoded documents and each level are written
    to the shared folder, so a task that runs again gives the same windows and numbers.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    terms = max(byte_encoder(vocabulary).size, end + 1)
    tree = spark.sparkContext.broadcast(routing_tree(df, text, vocabulary, terms))
    schema = f"key {kind}, {PIECE}"
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    path = scratch_path(spark, "encoded")
    rows.mapInArrow(partial(_encode, path=vocabulary, end=end, window=window, terms=terms, tree=tree), schema).write.parquet(path, compression=CODEC)
    encoded = spark.read.schema(schema).parquet(path)
    tree.destroy()

    counted = encoded.where("doc_tokens is null").select("terms", "counts").mapInArrow(partial(_count_terms, terms=terms), "term long, found long")
    found = np.zeros(terms + 3, np.int64)
    total = counted.groupBy("term").agg(F.sum("found").alias("found")).toArrow()  # bounded by the vocabulary
    found[total.column("term").to_numpy()] = total.column("found").to_numpy()
    statistics = spark.sparkContext.broadcast((found[:terms], int(found[terms]), max(1.0, found[terms + 1] / max(1, found[terms]))))

    done, pool, tokens, level = [encoded.where("sequence_id is not null")], encoded.where("number is not null"), int(found[terms + 2]), 1
    while tokens:
        tasks = min(MOST_PARTS, -(-tokens // max(PART_TOKENS, 4 * window)))
        dealt = pool.repartitionByRange(tasks, "leaf", "mark", "number") if tasks > 1 else pool.coalesce(1)
        packed = dealt.sortWithinPartitions("leaf", "mark", "number").mapInArrow(
            partial(_pack, statistics=statistics, window=window, level=level, last=tasks == 1), schema
        )
        path = scratch_path(spark, "packed")
        packed.withColumn("placed", F.col("sequence_id").isNotNull()).write.partitionBy("placed").parquet(path, compression=CODEC)
        level_rows = spark.read.schema(f"{schema}, placed boolean").parquet(path)
        pool = level_rows.where("not placed").drop("placed")
        done.append(level_rows.where("placed").drop("placed"))
        tokens = 0 if tasks == 1 else pool.agg(F.sum(F.length("ids") / 4)).first()[0]
        tokens, level = int(tokens or 0), level + 1

    statistics.destroy()
    pieces = done[0]
    for more in done[1:]:
        pieces = pieces.unionByName(more)
    return pieces.select(
        F.col("key").alias(key), "start", (F.length("ids") / 4).cast("long").alias("length"), "ids", "doc_tokens", "sequence_id", "offset",
    )
