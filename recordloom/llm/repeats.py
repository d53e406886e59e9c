"""Removal of repeated byte strings by run-length compressed suffix indexes.

Texts are reduced to the surroundings of anchors (see ``windows``): a window of bytes is what
stands left of its anchor's core, the core, and what stands right of it. Rows with the same
core meet in one place, the core shrinks to one symbol, and the rows of some cores form a
small text. Its Burrows-Wheeler transform is kept as runs, with the suffix array sampled at
the ends of runs only. From the samples alone the longest other match at each place of the
text is streamed, and matches of a whole window mark the bytes to remove.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import keyed, offsets, parts, ranges
from recordloom.llm.substrings import covered, offsets_, runs, values
from recordloom.llm.windows import Sketch, anchors, build_sketch, byte_texts, letter_values, mixed

#: Symbols of one index.
INDEX_SYMBOLS = 400_000
#: Windows of a hot core are split by cores that this many windows share.
HOT_WINDOWS = 8
GRAM = 8


class RunIndex:
    """Run-length Burrows-Wheeler transform of a text whose symbols at row ends are unique."""

    def __init__(self, text: np.ndarray):
        self.text = text
        order = suffix_array(text)
        before = text[order - 1]  # cyclic: the last symbol stands before the first
        edge = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])) if len(order) else np.zeros(0, np.int64)
        self.symbols = before[edge]
        self.lengths = np.diff(np.append(edge, len(order)))
        # the suffixes at the first and last place of each run, with their neighbours across its border
        self.first, self.above = order[edge[1:]], order[edge[1:] - 1]

    def neighbours(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sampled places with the places whose suffixes stand beside theirs: above run heads, below run tails."""
        yield self.first, self.above
        yield self.above, self.first

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Lengths of the common prefixes of suffixes, up to ``most``."""
        text = np.concatenate([self.text, np.full(most, -1)])
        length, alive = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(alive):
            x, y = a[alive] + length[alive], b[alive] + length[alive]
            same = (text[x] == text[y]) & (text[x] >= 0) & (length[alive] < most)
            alive = alive[same]
            length[alive] += 1
        return length

    def matching_statistics(self, most: int) -> np.ndarray:
        """For each place the longest match with another place, up to ``most`` where the match is as long.

        A neighbour in suffix order stays the neighbour one place further, and its match is one
        shorter, until the next sampled place. So a sample tells all places up to the next one.
        """
        out = np.zeros(len(self.text), np.int64)
        for places, others in self.neighbours():
            order = np.argsort(places)
            places, others = places[order], others[order]
            length = self.common(places, others, 2 * most)
            gap = np.diff(np.append(places, len(self.text)))
            reach = np.minimum(length, gap)
            at = ranges(places, reach)
            left = np.repeat(length, reach) - (at - np.repeat(places, reach))
            out[at] = np.maximum(out[at], left)
        return np.minimum(out, most)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """All suffixes in order, by doubling the length they are compared on; only ties are sorted again."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    # eight symbols at once to begin with
    for width in (1, 2, 4):
        after = np.concatenate([rank[width:] + 1, np.zeros(min(width, n), np.int64)])[:n]
        _, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    width = 8
    first = np.searchsorted(rank[order], np.arange(n))  # a rank's first place in the order
    rank = first[rank]
    tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank[order]] > 1)
    while len(tied):
        own = order[tied]
        after = np.where(own + width < n, rank[np.minimum(own + width, n - 1)] + 1, 0)
        again = np.lexsort((after, rank[own]))
        own, after = own[again], after[again]
        order[tied] = own
        new = np.concatenate([[True], (np.diff(rank[own]) != 0) | (np.diff(after) != 0)])
        place = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        rank[own] = place
        last = np.append(new[1:], True)
        tied = tied[~(new & last)]
        width *= 2
    return order


class Bytes:
    """Bytes of a part, their anchors and the keys of the cores."""

    def __init__(self, part: pa.RecordBatch, length: int):
        self.data, self.bounds = byte_texts(part)
        self.raw = self.data.tobytes()
        self.spread = spread_of(length)
        value = letter_values()[self.data] if len(self.data) else np.zeros(0, np.uint64)
        width = 1
        while width < GRAM:  # hashes of short strings, doubled in length
            value = value * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + np.concatenate([value[width:], np.zeros(min(width, len(value)), np.uint64)])
            width *= 2
        self.anchor, self.low, self.high = anchors(mixed(value), self.bounds, length, self.spread)
        core = length - self.spread + 1
        digest, raw = xxhash.xxh3_64_intdigest, self.raw
        self.keys = np.fromiter((digest(raw[a: a + core]) for a in self.anchor.tolist()), np.uint64, len(self.anchor))


def spread_of(length: int) -> int:
    """Places among which a window's anchor is sought: a power of two that leaves a core of half a window."""
    return 1 << max(0, min(length // 2, length - GRAM + 1).bit_length() - 1)


def _keys(part: pa.RecordBatch, length: int) -> np.ndarray:
    return Bytes(part, length).keys


def _surroundings(batches: Iterator[pa.RecordBatch], length: int, sketch: Broadcast[tuple]) -> Iterator[pa.RecordBatch]:
    """Surroundings of cores that may be repeated, by key; equal ones of a part settle among themselves."""
    sketch = Sketch(*sketch.value)
    digest = xxhash.xxh3_64_intdigest
    for part in parts(batches, "text"):
        own = Bytes(part, length)
        core = length - own.spread + 1
        maybe = sketch.repeated(own.keys)
        hot = sketch.is_hot(own.keys)
        doc = np.searchsorted(own.bounds, own.anchor, side="right") - 1
        rid = part.column("rid").to_numpy()
        raw, seen, rows, known = own.raw, {}, [], {}

        def row(key: int, d: int, low: int, high: int, begin: int, end: int, window: int) -> None:
            """Windows from ``low`` to ``high`` that share the core ``[begin, end)``."""
            left, right = raw[low: begin], raw[end: high + length]
            where = (key, left, right)
            start = low - int(own.bounds[d])
            first = seen.get(where)
            if first is None:
                seen[where] = len(rows)
                rows.append([key, d, start, left, right, window, False])
                return
            if not rows[first][6]:
                rows[first][6] = True
                known.setdefault(rows[first][1], []).append((rows[first][2], rows[first][2] + high - low + length))
            known.setdefault(d, []).append((start, start + high - low + length))

        for j in np.flatnonzero(maybe).tolist():
            a, low, high, d = int(own.anchor[j]), int(own.low[j]), int(own.high[j]), int(doc[j])
            if not hot[j]:
                row(int(own.keys[j]), d, low, high, a, a + core, length - core + 1)
                continue
            # the same split for all windows with this anchor, counted from the anchor
            for block in range((a - high) // HOT_WINDOWS, (a - low) // HOT_WINDOWS + 1):
                begin = a - block * HOT_WINDOWS
                end = begin - HOT_WINDOWS + 1 + length
                lowest, highest = max(low, begin - HOT_WINDOWS + 1), min(high, begin)
                key = digest(raw[begin:end], seed=block + 1)
                row(key, d, lowest, highest, begin, end, HOT_WINDOWS)
        yield pa.record_batch({
            "key": pa.array(np.fromiter((r[0] for r in rows), np.uint64, len(rows)).view(np.int64)),
            "rid": pa.array(rid[[r[1] for r in rows]] if rows else [], pa.int64()), "start": pa.array([r[2] for r in rows], pa.int64()),
            "left": pa.array([r[3] for r in rows], pa.binary()), "right": pa.array([r[4] for r in rows], pa.binary()),
            "window": pa.array([r[5] for r in rows], pa.int32()), "known": pa.array([r[6] for r in rows], pa.bool_()),
            "runs": pa.nulls(len(rows), pa.list_(pa.int64())),
        })
        if known:
            docs = list(known)
            keys = mixed(rid[docs].view(np.uint64)).view(np.int64)
            none = pa.nulls(len(docs), pa.binary())
            yield pa.record_batch({
                "key": pa.array(keys), "rid": pa.array(rid[docs]), "start": pa.nulls(len(docs), pa.int64()), "left": none, "right": none,
                "window": pa.nulls(len(docs), pa.int32()), "known": pa.nulls(len(docs), pa.bool_()),
                "runs": pa.array([merged(np.array(sorted(known[d]))) for d in docs], pa.list_(pa.int64())),
            })


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted spans ``begin, end`` joined where they touch, one after the other."""
    if not len(spans):
        return np.zeros(0, np.int64)
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[new, 0], reach[np.append(new[1:], len(spans)) - 1]], 1).ravel()


def repeated_windows(key: np.ndarray, left: list[bytes], right: list[bytes], window: np.ndarray, known: np.ndarray) -> list[np.ndarray]:
    """For each row the places of ``left`` and the core, counted in the row, where a repeated window starts.

    Rows of one key have equal cores. All rows of a key must be there.
    """
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(key)
    # equal surroundings need no index: several of them are repeated as a whole, one of them goes on
    same: dict[tuple, list[int]] = {}
    for i, row in enumerate(zip(key.tolist(), left, right)):
        same.setdefault(row, []).append(i)
    heads = {rows[0]: rows for rows in same.values()}
    often = {}
    for k, _, _ in same:
        often[k] = often.get(k, 0) + 1
    cores, text, at, size = {}, [], [], 0
    for head, rows in heads.items():
        k = int(key[head])
        whole = len(left[head]) + len(right[head]) + 1 - int(window[head])
        if len(rows) > 1 or known[head]:
            for i in rows:
                found[i] = np.arange(whole + 1)
        elif often[k] == 1:
            continue
        if often[k] > 1:
            # a row's end is unique, a core has one symbol for all its rows
            core = cores.setdefault(k, len(cores))
            text += [np.frombuffer(left[head], np.uint8).astype(np.int64), [256 + core], np.frombuffer(right[head], np.uint8).astype(np.int64), [-1 - head]]
            at.append((head, size, len(left[head]), whole))
            size += len(left[head]) + len(right[head]) + 2
    if at:
        text = np.concatenate(text)
        text = np.where(text < 0, 256 + len(cores) - text, text)
        longest = RunIndex(text).matching_statistics(int(window.max()))
        for head, begin, before, whole in at:
            if not len(found[head]):
                found[head] = np.flatnonzero(longest[begin: begin + whole + 1] >= window[head])
    return found


def _index(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Runs of bytes to remove, out of rows sorted by key."""
    held: list[pa.RecordBatch] = []

    def marked(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        done = rows.filter(rows["runs"].is_valid())
        rows = rows.filter(rows["runs"].is_null())
        rid, sizes, flat = [done["rid"].to_numpy()], [np.diff(offsets_(done["runs"]))], [values(done["runs"])]
        if rows.num_rows:
            known = rows["known"].to_numpy()
            found = repeated_windows(rows["key"].to_numpy(), rows["left"].to_pylist(), rows["right"].to_pylist(), rows["window"].to_numpy(), known)
            start, own = rows["start"].to_numpy(), rows["rid"].to_numpy()
            for i in range(len(found)):
                if len(found[i]) and not known[i]:  # the known ones have had their answer
                    spans = runs(start[i] + found[i], length)
                    rid.append(own[i: i + 1])
                    sizes.append([len(spans)])
                    flat.append(spans)
        bound = pa.array(offsets(np.concatenate(sizes)), pa.int32())
        return pa.record_batch({"rid": pa.array(np.concatenate(rid), pa.int64()), "runs": pa.ListArray.from_arrays(bound, pa.array(np.concatenate(flat), pa.int64()))})

    symbols = 0
    for batch in batches:
        held.append(batch)
        symbols += batch.nbytes
        if symbols >= INDEX_SYMBOLS:
            rows = pa.Table.from_batches(held)
            key = rows["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield marked(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
                symbols = sum(b.nbytes for b in held)
    if held:
        yield marked(pa.Table.from_batches(held))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, "text"):
        data, bounds = byte_texts(part)
        n_removed, n_spans, kept = [], [], []
        for i, spans in enumerate(part.column("runs").to_pylist()):
            own = data[bounds[i]: bounds[i + 1]]
            gone = covered(spans, len(own))
            n_removed.append(int(gone.sum()))
            n_spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
            kept.append(own[~gone].tobytes())
        yield pa.record_batch({
            "rid": part.column("rid"), "n_bytes": pa.array(np.diff(bounds), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary()),
        })


def repeated_bytes(rows: DataFrame, length: int) -> DataFrame:
    """``rid, runs`` of the texts ``rid, text`` that hold a repeated string of ``length`` bytes; runs may overlap."""
    spark = rows.sparkSession
    sketch = spark.sparkContext.broadcast(build_sketch(rows, partial(_keys, length=length)).plain())
    sent = rows.mapInArrow(
        partial(_surroundings, length=length, sketch=sketch),
        "key long, rid long, start long, left binary, right binary, window int, known boolean, runs array<long>",
    )
    found = sent.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_index, length=length), "rid long, runs array<long>")
    return found.groupBy("rid").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def remove_repeated_bytes(df: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept``: the UTF-8 bytes of texts without repeated strings of ``length`` bytes.

    Every byte is removed that is covered by a string of ``length`` bytes which also starts
    elsewhere, in the same text or another; matches never cross texts. ``n_spans`` are the maximal
    removed runs, ``kept`` the bytes left, which need not be whole characters. Rows are numbered by
    their places in files (see ``common.keyed``).

    A sketch over all partitions rules out strings that occur once. What is left meets by
    core and is indexed in pieces of bounded size, in the order of a sorted shuffle. Equal
    surroundings of a part send one for all, and hot cores are split into cores of few
    windows, so no key gathers the copies of a common passage.

    A null text counts as empty. Repeated rows count as texts of their own, so they remove one
    another. Null keys stay, other columns are left out.
    """
    if length < 2 * GRAM:
        raise ValueError(f"strings of at least {2 * GRAM} bytes are looked for")
    kind = df.schema[key].dataType.simpleString()
    rows = keyed(df.select(df[key].alias("key"), df[text].alias("text")), "rid")
    found = repeated_bytes(rows.select("rid", "text"), length)
    joined = rows.join(found, "rid", "left").select(F.struct("key").alias("rid"), "text", "runs")
    out = joined.mapInArrow(_cut, f"rid struct<key:{kind}>, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.col("rid.key").alias(key), "n_bytes", "n_removed", "n_spans", "kept")
