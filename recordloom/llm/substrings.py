"""Removal of repeated runs of words: a count-min prefilter, then exact groups of the windows left."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import keyed, offsets, parts, ranges
from recordloom.llm.windows import Sketch, anchors, build_sketch, byte_texts, letter_values, mixed, span_hashes, words_of

#: Rows of complete groups that are compared at once.
GROUP_ROWS = 20_000


class Words:
    """Word hashes and anchors of a part."""

    def __init__(self, part: pa.RecordBatch, length: int):
        data, bounds = byte_texts(part)
        self.begin, self.end, self.first = words_of(data, bounds)
        self.hashes = span_hashes(letter_values()[data], self.begin, self.end)
        self.spread = 1 << max(0, (length // 2).bit_length() - 1)
        self.anchor, self.low, self.high = anchors(self.hashes, self.first, length, self.spread)
        self.keys = span_hashes(mixed(self.hashes), self.anchor, self.anchor + length - self.spread + 1)


def _keys(part: pa.RecordBatch, length: int) -> np.ndarray:
    return Words(part, length).keys


def runs(starts: np.ndarray, length: int) -> np.ndarray:
    """``begin, end`` pairs of the words that windows from sorted ``starts`` cover."""
    if not len(starts):
        return np.zeros(0, np.int64)
    gap = np.flatnonzero(np.diff(starts) > length)
    return np.stack([starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + length], 1).ravel()


def _windows(batches: Iterator[pa.RecordBatch], length: int, sketch: Broadcast[tuple]) -> Iterator[pa.RecordBatch]:
    """Windows that may be repeated, by key, and runs that are known to be from this part alone."""
    sketch = Sketch(*sketch.value)
    for part in parts(batches, "text"):
        words = Words(part, length)
        maybe = sketch.repeated(words.keys)
        keys, low, high = words.keys[maybe], words.low[maybe], words.high[maybe]
        hot = sketch.is_hot(keys)
        sizes = high - low + 1
        starts = ranges(low, sizes)
        content = span_hashes(mixed(words.hashes ^ np.uint64(0x5851F42D4C957F2D)), starts, starts + length)
        _, first, place, count = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
        sent = np.zeros(len(starts), bool)
        sent[first] = True  # one of equal windows speaks for them
        known = count[place] >= 2
        rid = part.column("rid").to_numpy()
        doc = np.searchsorted(words.first, starts, side="right") - 1
        # windows of a hot key go by their own hash
        group = np.where(np.repeat(hot, sizes), np.arange(len(starts)), np.repeat(np.arange(len(keys)), sizes))
        where, group = np.flatnonzero(sent), group[sent]
        edge = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0])) if len(where) else np.zeros(0, np.int64)
        head = where[edge]
        is_hot = np.repeat(hot, sizes)[head]
        key = np.where(is_hot, content[head], np.repeat(keys, sizes)[head])
        per = np.diff(np.append(edge, len(where)))
        bound = pa.array(offsets(per), pa.int32())
        yield pa.record_batch({
            "key": pa.array(key.view(np.int64)), "rid": pa.array(rid[doc[head]]),
            "starts": pa.ListArray.from_arrays(bound, pa.array((starts - words.first[doc])[where].astype(np.int32))),
            # a negative sign tells that the window is already known to be repeated
            "content": pa.ListArray.from_arrays(bound, pa.array((content[where] >> np.uint64(1)).astype(np.int64) * np.where(known[where], -1, 1))),
        })
        if known.any():
            at = np.flatnonzero(known)
            texts = np.split(at, np.flatnonzero(np.diff(doc[at])) + 1)
            found = [runs(np.unique(starts[t] - words.first[doc[t[0]]]), length) for t in texts]
            own = rid[[doc[t[0]] for t in texts]]
            yield pa.record_batch({
                "key": pa.array(mixed(own.view(np.uint64)).view(np.int64)), "rid": pa.array(own),
                "starts": pa.array([f.astype(np.int32) for f in found], pa.list_(pa.int32())), "content": pa.nulls(len(own), pa.list_(pa.int64())),
            })


def _groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows, out of rows sorted by key."""
    held: list[pa.RecordBatch] = []

    def compared(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        done = rows.filter(rows["content"].is_null())
        rows = rows.filter(rows["content"].is_valid())
        rid, start, found = [done["rid"].to_numpy()], [], [np.diff(offsets_(done["starts"]))]
        flat = [values(done["starts"])]
        if rows.num_rows:
            per = np.diff(offsets_(rows["content"]))
            content, start = values(rows["content"]), values(rows["starts"])
            row = np.repeat(np.arange(rows.num_rows), per)
            key = np.repeat(rows["key"].to_numpy(), per)
            weight = np.where(content < 0, 2, 1)
            order = np.lexsort((np.abs(content), key))
            same = np.concatenate([[False], (np.diff(key[order]) == 0) & (np.diff(np.abs(content[order])) == 0)])
            group = np.cumsum(~same) - 1
            total = np.bincount(group, weight[order])[group]
            again = np.zeros(len(content), bool)
            again[order] = total >= 2
            again &= content >= 0  # the others have had their answer
            at = np.flatnonzero(again)
            for rows_of in np.split(at, np.flatnonzero(np.diff(row[at])) + 1) if len(at) else []:
                span = runs(start[rows_of].astype(np.int64), length)
                rid.append(rows["rid"].to_numpy()[row[rows_of[:1]]])
                found.append(np.array([len(span)]))
                flat.append(span.astype(np.int32))
        bound = pa.array(offsets(np.concatenate(found)), pa.int32())
        return pa.record_batch({"rid": pa.array(np.concatenate(rid), pa.int64()), "runs": pa.ListArray.from_arrays(bound, pa.array(np.concatenate(flat), pa.int32()))})

    for batch in batches:
        held.append(batch)
        rows = pa.Table.from_batches(held)
        if rows.num_rows >= GROUP_ROWS:
            key = rows["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield compared(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
    if held:
        yield compared(pa.Table.from_batches(held))


def offsets_(column: pa.ChunkedArray) -> np.ndarray:
    """Offsets of a list column of one chunk or none."""
    return np.concatenate([[0], *(np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False)) for c in column.chunks)])


def values(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks)])


def covered(spans: list[int] | None, size: int) -> np.ndarray:
    """A mark for each place that one of the spans ``begin, end, begin, end, ...`` covers."""
    step = np.zeros(size + 1, np.int64)
    pairs = np.array(spans or [], np.int64).reshape(-1, 2)
    np.add.at(step, pairs[:, 0], 1)
    np.add.at(step, pairs[:, 1], -1)
    return np.cumsum(step[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch], as_they_are: bool) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, "text"):
        data, bounds = byte_texts(part)
        begin, end, first = words_of(data, bounds)
        raw = data.tobytes()
        n_words, n_removed, kept = [], [], []
        for i, spans in enumerate(part.column("runs").to_pylist()):
            lo, hi = int(first[i]), int(first[i + 1])
            if as_they_are and not spans:
                n_words.append(hi - lo)
                n_removed.append(0)
                kept.append(raw[bounds[i]: bounds[i + 1]].decode())
                continue
            gone = covered(spans, hi - lo)
            n_words.append(hi - lo)
            n_removed.append(int(gone.sum()))
            left = np.flatnonzero(~gone) + lo
            kept.append(b" ".join([raw[a:b] for a, b in zip(begin[left].tolist(), end[left].tolist())]).decode())
        yield pa.record_batch({
            "rid": part.column("rid"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "kept": pa.array(kept, pa.string()),
        })


def repeated_runs(rows: DataFrame, length: int) -> DataFrame:
    """``rid, runs`` of the texts ``rid, text`` that hold a repeated window of ``length`` words; runs may overlap."""
    spark = rows.sparkSession
    sketch = spark.sparkContext.broadcast(build_sketch(rows, partial(_keys, length=length)).plain())
    sent = rows.mapInArrow(partial(_windows, length=length, sketch=sketch), "key long, rid long, starts array<int>, content array<long>")
    found = sent.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_groups, length=length), "rid long, runs array<int>")
    return found.groupBy("rid").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def remove_repeats(df: DataFrame, key: str, text: str, length: int, as_they_are: bool = False) -> DataFrame:
    """``key, n_words, n_removed, kept``: texts without the words that a repeated window of ``length`` words covers.

    Words are runs without ASCII white space, unchanged. A window is repeated if its words
    start anywhere else too, in the same text or another one; all its copies are removed.
    ``kept`` are the words left, joined by one blank; with ``as_they_are`` a text that loses no
    word is kept as it is. Rows are numbered by their places in files (see ``common.keyed``).

    First pass: a sketch of the windows' cores, merged over all partitions. Second pass: windows
    that the sketch does not rule out are compared exactly. Equal windows of a part settle
    among themselves and send one for all; windows of hot cores travel under their own
    hash. So no key gathers the copies of a common passage.

    A null or empty text has no words and is kept as an empty one. Texts shorter than a window
    stay whole, apart from their white space. Repeated rows count as texts of their own, so they
    remove one another. Null keys stay, other columns are left out.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = keyed(df.select(df[key].alias("key"), df[text].alias("text")), "rid")
    found = repeated_runs(rows.select("rid", "text"), length)
    joined = rows.join(found, "rid", "left").select(F.struct("key").alias("rid"), "text", "runs")
    out = joined.mapInArrow(partial(_cut, as_they_are=as_they_are), f"rid struct<key:{kind}>, n_words long, n_removed long, kept string")
    return out.select(F.col("rid.key").alias(key), "n_words", "n_removed", "kept")
