"""Prefix trie of conversations, peeled from its deepest turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import lists, offsets
from recordloom.llm.sequences import digest_in_order
from recordloom.operators.joins import lookup_join
from recordloom.session import stage

#: Bytes of a turn in a path.
TURN = 16
#: Bytes of paths that are peeled together; a block has so many rows at least.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 16
#: Up to so many rows and bytes of paths the borders of all blocks are peeled as one.
WHOLE_ROWS, WHOLE_BYTES = 40_000, 16 << 20
NO_ID = np.iinfo(np.int64).max
EMPTY = hashlib.sha256(b"").hexdigest()

NODE = "low long, depth long, parent long, parent_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, key binary, ended boolean"
PATH = "path binary, words array<long>, depths array<long>, n array<long>, lows array<long>, children array<long>, leaves array<long>, saved array<long>, ends array<long>"
ENTRY = ["depths", "n", "lows", "children", "leaves", "saved", "ends"]


def count_words(text: Column) -> Column:
    """Words between blanks."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def paths(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """``key, turns array<struct<digest, words>>`` of every conversation, in the order of its turns.

    A turn without number comes first; turns of one number are ordered by a digest of role and
    text. Null role or text counts as empty, rows without key are left out, repeated rows are
    turns of their own. A conversation's digests, some 80 bytes a turn, are held by one task.
    """
    who, what = F.coalesce(df[role].cast("string"), F.lit("")), F.coalesce(df[text].cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what).cast("binary"))
    rows = df.where(df[key].isNotNull()).select(
        df[key].cast("long").alias("key"), F.struct(df[turn].alias("turn"), digest.alias("digest"), count_words(what).alias("words")).alias("row")
    )
    ordered = F.array_sort(F.collect_list("row"))
    return rows.groupBy("key").agg(F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def _shared(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Turns that each path shares with the one before it; -1 for the first."""
    shared = np.zeros(len(lengths), np.int64)
    alive = np.arange(1, len(lengths))
    depth = 0
    while len(alive):
        alive = alive[(lengths[alive] > depth) & (lengths[alive - 1] > depth)]
        alive = alive[(flat[starts[alive] + depth] == flat[starts[alive - 1] + depth]).all(axis=1)]
        depth += 1
        shared[alive] = depth
    shared[:1] = -1
    return shared


class Block:
    """Sorted distinct paths, with what is known of the nodes on them: entries of a row and a depth."""

    def __init__(self, batch: pa.RecordBatch):
        self.paths = batch.column("path").to_pylist()
        self.lengths = np.array([len(p) // TURN for p in self.paths], np.int64)
        self.starts = offsets(self.lengths)[:-1]
        self.flat = np.frombuffer(b"".join(self.paths), np.uint64).reshape(-1, 2)
        self.words = batch.column("words").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.diff(batch.column("depths").offsets.to_numpy())
        columns = [batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ENTRY]
        depth = columns[0]
        order = np.argsort(depth, kind="stable")
        self.row = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.entries = [c[order] for c in columns[1:]]
        self.deepest = int(self.lengths.max())
        self.bounds = np.searchsorted(depth[order], np.arange(self.deepest + 2))
        self.chains: dict[int, list[bytes]] = {}

    def key(self, row: int, depth: int) -> bytes:
        """Digest of the first turns of a path."""
        if depth == self.lengths[row] and row not in self.chains:
            return hashlib.md5(self.paths[row]).digest()
        if row not in self.chains:
            state = hashlib.md5()
            self.chains[row] = [state.digest()]
            for at in range(0, len(self.paths[row]), TURN):
                state.update(self.paths[row][at: at + TURN])
                self.chains[row].append(state.copy().digest())
        return self.chains[row][depth]

    def peel(self, whole: bool, keyed: bool) -> tuple[list[list[tuple]], dict[int, list[tuple]]]:
        """Nodes, and of nodes that other blocks may share what this block adds to them, by their path.

        From the deepest level up: what survived a level meets the paths that end at the next
        one, loses its last turn and is grouped again. Paths in order make groups of
        neighbours. Nodes on the first and the last path stay open unless the block is
        the ``whole``.
        """
        shared = _shared(self.flat, self.starts, self.lengths)
        by_length = np.argsort(self.lengths, kind="stable")
        ended_at = np.searchsorted(self.lengths[by_length], np.arange(self.deepest + 2))
        last = len(self.paths) - 1
        out, border = [], {0: [], last: []}
        reps = np.zeros(0, np.int64)
        values = [np.zeros(0, np.int64)] * 5  # conversations, smallest id, children, leaves, saved tokens
        pending = None
        for depth in range(self.deepest, -1, -1):
            ending = np.sort(by_length[ended_at[depth]: ended_at[depth + 1]])
            fresh = np.zeros(len(ending), np.int64)
            merged = np.concatenate([reps, ending])
            order = np.argsort(merged, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            merged = merged[order]
            first = np.flatnonzero(shared[merged] < depth)
            group = np.cumsum(shared[merged] < depth) - 1
            sums = [np.concatenate([v, fresh + (NO_ID if k == 1 else 0)])[order] for k, v in enumerate(values)]
            n, low, children, leaves, saved = (np.minimum.reduceat(v, first) if k == 1 else np.add.reduceat(v, first) for k, v in enumerate(sums))
            heads = merged[first]
            own = slice(self.bounds[depth], self.bounds[depth + 1])
            at = np.searchsorted(heads, self.row[own], side="right") - 1
            more = [e[own] for e in self.entries]
            ends = np.zeros(len(heads), np.int64)
            np.minimum.at(low, at, more[1])
            for total, add in ((n, more[0]), (children, more[2]), (leaves, more[3]), (saved, more[4]), (ends, more[5])):
                np.add.at(total, at, add)
            open_at = {} if whole else {g: r for r, g in ((last, len(heads) - 1), (0, 0)) if self.lengths[r] >= depth and (r or heads[0] == 0)}
            for g, r in open_at.items():
                border[r].append((depth, *(int(v[g]) for v in (n, low, children, leaves, saved, ends))))
            final = np.ones(len(heads), bool)
            final[list(open_at)] = False
            leaves = np.where(children == 0, 1, leaves)
            if depth:
                saved = saved + (n - 1) * self.words[self.starts[heads] + depth - 1]
            if pending is not None:
                self._note(out, pending, group[place[: len(reps)]], low, final, open_at, depth)
            keys = [self.key(int(heads[g]), depth) if final[g] and (keyed or ends[g]) else None for g in range(len(heads))]
            pending = (depth, low, n, children, leaves, saved, keys, ends > 0, final)
            reps = heads
            values = [np.where(final, v, NO_ID if k == 1 else 0) for k, v in enumerate((n, low, np.ones(len(heads), np.int64), leaves, saved))]
        self._note(out, pending, None, None, None, {}, -1)
        return out, border

    def _note(self, out, pending, group, low, final, open_at, depth) -> None:
        """Nodes of the level below, now that their parents are known."""
        own, lows, n, children, leaves, saved, keys, ended, closed = pending
        for i in np.flatnonzero(closed):
            parent = parent_key = None
            if group is not None:
                g = int(group[i])
                if final[g]:
                    parent = int(low[g])
                else:
                    parent_key = self.key(open_at[g], depth)
            out.append((int(lows[i]), own, parent, parent_key, int(n[i]), int(children[i]), int(leaves[i]), int(saved[i]), keys[i], bool(ended[i])))


def _blocks(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    if whole:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is not None and table.num_rows:
            yield table.combine_chunks().to_batches()[0]
        return
    for batch in batches:
        ends = np.cumsum([len(p) for p in batch.column("path").to_pylist()])
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = min(batch.num_rows, max(begin + BLOCK_ROWS, int(np.searchsorted(ends, before + BLOCK_BYTES, side="right"))))
            yield pa.record_batch([pa.concat_arrays([c]) for c in batch.slice(begin, end - begin).columns], schema=batch.schema)
            begin = end


def _peel(batches: Iterator[pa.RecordBatch], whole: bool, keyed: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.binary(), pa.bool_()]
    names = [f.split()[0] for f in f"{NODE}, {PATH}".split(", ")]
    for batch in _blocks(batches, whole):
        block = Block(batch)
        nodes, border = block.peel(whole, keyed)
        rows = [r for r in sorted(border) if border[r]]
        columns = list(zip(*nodes)) or [()] * len(kinds)
        left = [pa.array(c, k) for c, k in zip(columns, kinds)]
        none = [pa.nulls(len(rows), k) for k in kinds]
        flat = [np.array([e[k] for r in rows for e in border[r]], np.int64) for k in range(len(ENTRY))]
        sizes = np.array([len(border[r]) for r in rows], np.int64)
        words = [block.words[block.starts[r]: block.starts[r] + block.lengths[r]] for r in rows]
        right = [
            pa.array([block.paths[r] for r in rows], pa.binary()),
            lists(np.concatenate([np.zeros(0, np.int64), *words]), np.array([len(w) for w in words], np.int64), pa.int64()),
            *(lists(f, sizes, pa.int64()) for f in flat),
        ]
        blank = [pa.nulls(len(nodes), c.type) for c in right]
        yield pa.record_batch([pa.concat_arrays(pair) for pair in zip([*left, *blank], [*none, *right])], names)


def _rounds(level: DataFrame) -> list[DataFrame]:
    """Nodes of each round. A round peels blocks of sorted paths; the borders of its blocks, two paths each, are the next."""
    found, names = [], [f.split()[0] for f in PATH.split(", ")]
    while True:
        whole = False
        if found:
            size = level.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("path")), F.lit(0)).alias("bytes")).first()
            if not size["rows"]:
                return found
            whole = size["rows"] <= WHOLE_ROWS and size["bytes"] <= WHOLE_BYTES
            parts = 1 if whole else -(-size["rows"] // 10_000) + size["bytes"] // (4 * BLOCK_BYTES)
            level = level.repartition(1) if whole else level.repartitionByRange(parts, "path")
        else:
            level = level.repartitionByRange("path")
        peeled = stage(level.sortWithinPartitions("path").mapInArrow(partial(_peel, whole=whole, keyed=bool(found)), f"{NODE}, {PATH}"), "trie")
        found.append(peeled.where("path is null").drop(*names))
        if whole:
            return found
        level = peeled.where("path is not null").select(*names)


def trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of ``key, turns array<struct<digest, words>>``, one row per conversation.

    A node is a distinct sequence of first turns, the root without turns among them: ``low`` (smallest key of
    its conversations), ``depth``, ``parent`` (the parent's ``low``), ``n_convs``, ``n_children``,
    ``n_leaves`` (nodes without children below it or itself), ``saved_tokens`` (words that are stored
    once instead of once per conversation, below it and itself) and ``ends_sha256``, the digest of the keys of
    conversations that end there.

    Equal conversations are merged first. The distinct ones, as paths of 16 bytes a turn, are
    sorted over all partitions, so that every node's conversations are neighbours, and each
    block of them is peeled from its deepest turn up. Only nodes on a block's two outer paths can
    reach into other blocks; those paths are peeled again, until one block holds them all. So a
    common first turn spreads over many tasks, and rounds do not grow with the number of turns.
    No conversations give no nodes.
    """
    turns = F.col("turns")
    rows = conversations.select("key", F.unhex(F.array_join(turns["digest"], "")).alias("path"), turns["words"].alias("words"))
    rows = stage(rows, "paths")
    zero = F.array(F.lit(0).cast("long"))
    merged = rows.groupBy("path").agg(F.first("words").alias("words"), F.count("*").alias("n"), F.min("key").alias("low"))
    level = merged.select(
        "path", "words", F.array(F.size("words").cast("long")).alias("depths"), F.array("n").alias("n"), F.array("low").alias("lows"),
        zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), F.array(F.lit(1).cast("long")).alias("ends"),
    )
    first, *later = _rounds(level)
    nodes = first
    for more in later:
        nodes = nodes.unionByName(more)
    if later:
        known = later[0]
        for more in later[1:]:
            known = known.unionByName(more)
        known = known.select(F.col("key").alias("parent_key"), F.col("low").alias("found"))
        open_nodes = lookup_join(nodes.where("parent_key is not null"), known, "parent_key", "inner")
        nodes = nodes.where("parent_key is null").unionByName(open_nodes.withColumn("parent", F.col("found")).select(*nodes.columns))
    ends = digest_in_order(rows.select(F.unhex(F.md5("path")).alias("key"), F.col("key").alias("place"), F.col("key").cast("string").alias("piece")), ",")
    columns = ["low", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    with_ends = nodes.where("ended").join(ends, "key").select(*columns, F.col("sha256").alias("ends_sha256"))
    return with_ends.unionByName(nodes.where("not ended").select(*columns, F.lit(EMPTY).alias("ends_sha256")))
