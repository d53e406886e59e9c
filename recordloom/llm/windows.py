"""Windows of symbols that repeat anywhere in a corpus: anchors, and a count-min sketch of them.

All windows of a length are handled by far fewer anchors. The anchor of a window is the place
with the smallest hash among its first ``spread`` places, so it hangs on the window's content
alone. The anchor's core is the stretch of symbols from it that all windows with this anchor
hold; windows that are equal have equal cores. A core that occurs once rules out all its windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import offsets, parts, ranges, text_list, worker_memory

#: Cells of each of the sketch's two rows, as a power of two. Fixes the size of what is broadcast: four bitmaps.
SKETCH_BITS = 26
#: A core that is counted as often as this is hot; operators split its windows over more keys.
HOT = 1000
SEGMENT_BITS = 18
LANES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
#: Places are told apart by this many bits while minima are sought.
PLACE_BITS = 23
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
STEP = 0x9E6C63D0876A9A35 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo two to the 64th."""
    memory = worker_memory()
    if len(memory.get("powers", [()])[0]) < n:
        size = max(n, 1 << 16)
        memory["powers"] = tuple(
            np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(base))])) for base in (STEP, pow(STEP, -1, 1 << 64))
        )
    up, down = memory["powers"]
    return up[:n], down[:n]


def span_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans ``[begin, end)`` of ``values``, equal for equal content."""
    up, down = powers(len(values) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(values * up[:-1])])
    return mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * LANES[0])


def letter_values() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)


def byte_texts(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a part's texts behind one another, and where each text starts, with the end."""
    texts = [t.encode() for t in text_list(part.column("text"))]
    return np.frombuffer(b"".join(texts), np.uint8), offsets([len(t) for t in texts])


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of the words, runs without white space, and the first word of each text, with the end."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    # a text's first byte starts a word whatever stands before it in another text
    starts = ~gap[1:-1] & gap[:-2]
    ends = ~gap[1:-1] & gap[2:]
    inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
    starts[inner] |= ~gap[1:-1][inner]
    ends[inner - 1] |= ~gap[1:-1][inner - 1]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, bounds)


def anchors(hashes: np.ndarray, bounds: np.ndarray, length: int, spread: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, first, last)``: the anchors of all windows, each with the window starts it stands for.

    ``hashes`` has one number per place, made of at most ``length - spread + 1`` symbols from
    there; ``spread`` is a power of two. Windows lie within the texts that ``bounds`` separates.
    """
    sizes = np.maximum(0, np.diff(bounds) - length + 1)
    starts = ranges(bounds[:-1], sizes)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    found = np.empty(len(hashes), np.int64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    step = (1 << PLACE_BITS) - spread
    for begin in range(0, len(hashes), step):
        own = hashes[begin: begin + step + spread - 1]
        # ties go to the later place
        best = (own & ~low) | (low - np.arange(len(own), dtype=np.uint64))
        best = np.concatenate([best, np.full(spread - 1, ~np.uint64(0))])
        width = 1
        while width < spread:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        found[begin: begin + step] = begin + (low - (best[:step] & low)).astype(np.int64)
    at = found[starts]
    edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (np.diff(starts) != 1)]))
    return at[edge], starts[edge], starts[np.append(edge[1:], len(starts)) - 1]


class Sketch:
    """Bitmaps of cells counted twice or more, and of hot cells, for each of two rows."""

    def __init__(self, bits: int, twice: list[bytes], hot: list[bytes]):
        self.bits, self.twice, self.hot = bits, twice, hot

    def plain(self) -> tuple:
        """What the sketch is made of, to be broadcast."""
        return self.bits, self.twice, self.hot

    def test(self, maps: list[bytes], keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for lane, bitmap in zip(LANES, maps):
            cell = (keys * lane) >> np.uint64(64 - self.bits)
            byte = np.frombuffer(bitmap, np.uint8)[(cell >> np.uint64(3)).astype(np.int64)]
            out &= (byte >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """Whether a key may occur more than once; true for all that do."""
        return self.test(self.twice, keys)

    def is_hot(self, keys: np.ndarray) -> np.ndarray:
        return self.test(self.hot, keys)


def _count(batches: Iterator[pa.RecordBatch], keys_of: Callable, bits: int) -> Iterator[pa.RecordBatch]:
    cells, counts, size = [], [], 0

    def merged():
        cell, place = np.unique(np.concatenate([np.zeros(0, np.int64), *cells]), return_inverse=True)
        return cell, np.minimum(np.bincount(place, np.concatenate([np.zeros(0), *counts]), len(cell)), HOT).astype(np.int64)

    def rows():
        cell, count = merged()
        segment = cell >> SEGMENT_BITS
        for edge in np.split(np.arange(len(cell)), np.flatnonzero(np.diff(segment)) + 1) if len(cell) else []:
            yield pa.record_batch({
                "segment": pa.array(segment[edge[:1]].astype(np.int32)),
                "cells": pa.array([(cell[edge] & ((1 << SEGMENT_BITS) - 1)).astype("<u4").tobytes()], pa.binary()),
                "counts": pa.array([count[edge].astype("<u2").tobytes()], pa.binary()),
            })

    for part in parts(batches, "text"):
        keys = keys_of(part)
        own = np.concatenate([(np.int64(row) << bits) + ((keys * lane) >> np.uint64(64 - bits)).astype(np.int64) for row, lane in enumerate(LANES)])
        cells.append(own)
        counts.append(np.ones(len(own)))
        size += len(own)
        if size > 4_000_000:
            cell, count = merged()
            if len(cell) > 2_000_000:
                yield from rows()
                cells, counts, size = [], [], 0
            else:
                cells, counts, size = [cell], [count], len(cell)
    yield from rows()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    dense: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            count = dense.setdefault(row["segment"], np.zeros(1 << SEGMENT_BITS, np.uint16))
            cells = np.frombuffer(row["cells"], "<u4")
            count[cells] = np.minimum(count[cells].astype(np.uint32) + np.frombuffer(row["counts"], "<u2"), HOT)
    for segment, count in dense.items():
        yield pa.record_batch({
            "segment": pa.array([segment], pa.int32()),
            "twice": pa.array([np.packbits(count >= 2, bitorder="little").tobytes()], pa.binary()),
            "hot": pa.array([np.packbits(count >= HOT, bitorder="little").tobytes()], pa.binary()),
        })


def build_sketch(texts: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], bits: int = SKETCH_BITS) -> Sketch:
    """The merged sketch of the keys of all parts of the column ``text``.

    Tasks count their keys in sparse cells, which are merged by segments of the sketch; a
    cell's count is never below that of a key in it. The merged bitmaps have a fixed size
    and are all that reaches the driver. With more keys than cells more of them are
    taken for repeated, none is lost.
    """
    counted = texts.select("text").mapInArrow(partial(_count, keys_of=keys_of, bits=bits), "segment int, cells binary, counts binary")
    merged = counted.repartition("segment").mapInArrow(_merge, "segment int, twice binary, hot binary")
    size = 1 << SEGMENT_BITS >> 3
    maps = {"twice": bytearray(2 << bits >> 3), "hot": bytearray(2 << bits >> 3)}
    for row in merged.toLocalIterator(prefetchPartitions=True):
        for name, bitmap in maps.items():
            bitmap[row["segment"] * size: (row["segment"] + 1) * size] = row[name]
    half = 1 << bits >> 3
    return Sketch(bits, *([bytes(m[:half]), bytes(m[half:])] for m in maps.values()))
