"""Token counts of sections: whole documents are encoded once, spans of tokens are joined with spans of sections."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recordloom.llm.common import parts, text_list
from recordloom.llm.tokens import ByteEncoder, byte_encoder

#: To which of the sections that a token touches it is counted.
RULES = ("start", "end", "share")


def byte_places(text: bytes) -> np.ndarray:
    """For each character, and the end, the place of its first byte."""
    starts = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.append(np.flatnonzero(starts), len(text))


def attribute(encoder: ByteEncoder, text: str, starts: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section ``[start, end)`` in characters; sections are in order and do not overlap."""
    data = text.encode()
    widths = encoder.widths[encoder.encode(text).astype(np.int64)]
    token_end = np.cumsum(widths)
    place = byte_places(data)
    last = len(place) - 1
    begin, end = place[np.clip(starts, 0, last)], place[np.clip(ends, 0, last)]
    if rule == "share":
        # tokens that end up to each border, with the part of the token across it
        edges = np.concatenate([[0.0], token_end])
        done = lambda x: np.interp(x, edges, np.arange(len(edges), dtype=float))
        return done(end) - done(begin)
    # a token's own character: the one of its first byte, or the one of its last
    own = token_end - widths if rule == "start" else token_end - 1
    own = place[np.searchsorted(place, own, side="right") - 1] if len(own) else own
    return (np.searchsorted(own, end) - np.searchsorted(own, begin)).astype(float)


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines with the line break that ends them; an empty text has none."""
    ends = [m.end() for m in re.finditer("\n", text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return np.array([0, *ends[:-1]][: len(ends)], np.int64), np.array(ends, np.int64)


def _spans(value: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    spans = [s for s in value or [] if s and s["start"] is not None and s["end"] is not None]
    return np.array([s["start"] for s in spans], np.int64), np.array([max(s["start"], s["end"]) for s in spans], np.int64)


def _count(batches: Iterator[pa.RecordBatch], path: str, rule: str) -> Iterator[pa.RecordBatch]:
    encoder = byte_encoder(path)
    for part in parts(batches, "text"):
        texts = text_list(part.column("text"))
        if "spans" in part.schema.names:
            spans = list(map(_spans, part.column("spans").to_pylist()))
        else:
            spans = list(map(line_spans, texts))
        counts = [attribute(encoder, t, *s, rule) for t, s in zip(texts, spans)]
        sizes = np.fromiter((len(s[0]) for s in spans), np.int64, len(spans))
        flat = [np.concatenate([np.zeros(0), *x]) for x in ([s[0] for s in spans], [s[1] for s in spans], counts)]
        which = pa.array(np.repeat(np.arange(part.num_rows), sizes))
        yield pa.record_batch({
            "key": part.column("key").take(which),
            "section": pa.array(np.concatenate([np.zeros(0, np.int64), *map(np.arange, sizes)]), pa.int64()),
            "start": pa.array(flat[0].astype(np.int64)), "end": pa.array(flat[1].astype(np.int64)),
            "n_tokens": pa.array(flat[2], pa.float64()),
        })


def count_tokens(df: DataFrame, key: str, text: str, vocabulary: str, sections: str | None = None, rule: str = "start") -> DataFrame:
    """``key, section, start, end, n_tokens``: one row per section of each document.

    ``sections`` names a column ``array<struct<start:int,end:int>>`` of character spans, in order
    and without overlap; without it the lines are the sections, each with its line break.
    Every document is encoded once, as a whole, so a token may cross a border. By the rule
    ``start`` it counts where its first character lies, by ``end`` where its last one lies, by
    ``share`` in parts, by its bytes. Tokens that no section holds count nowhere.

    A null or empty text has no lines, and sections beyond the text count 0. Null sections or
    spans are none. Repeated rows give repeated sections, other columns are left out. No shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    columns = [df[key].alias("key"), df[text].alias("text")]
    rows = df.select(*columns, df[sections].alias("spans")) if sections else df.select(*columns)
    kind = df.schema[key].dataType.simpleString()
    out = rows.mapInArrow(
        partial(_count, path=vocabulary, rule=rule), f"key {kind}, section long, start long, end long, n_tokens double"
    )
    return out.withColumnRenamed("key", key)
