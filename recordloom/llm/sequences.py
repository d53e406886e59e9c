"""Digests of sequences that may be longer than a row: pieces in order stream through one hash per key."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _join_pieces(batches: Iterator[pa.RecordBatch], separator: str) -> Iterator[pa.RecordBatch]:
    """One row per key and batch: the pieces of sorted rows joined, at the place of the first."""
    for batch in batches:
        keys, places, pieces = (batch.column(c).to_pylist() for c in ("key", "place", "piece"))
        rows, begin = [], 0
        for end in range(1, len(keys) + 1):
            if end == len(keys) or keys[end] != keys[begin]:
                rows.append((keys[begin], places[begin], separator.join(pieces[begin:end])))
                begin = end
        columns = zip(*rows)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, batch.schema)], schema=batch.schema)


def _digest(batches: Iterator[pa.RecordBatch], separator: str) -> Iterator[pa.RecordBatch]:
    """``key, sha256`` of the pieces of each key, which come one after the other."""
    state, current, between, kind = None, None, separator.encode(), pa.binary()
    for batch in batches:
        kind = batch.schema.field("key").type
        done = []
        for key, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist()):
            if state is None or key != current:
                if state is not None:
                    done.append((current, state.hexdigest()))
                state, current = hashlib.sha256(piece.encode()), key
            else:
                state.update(between)
                state.update(piece.encode())
        if done:
            keys, digests = zip(*done)
            yield pa.record_batch([pa.array(keys, kind), pa.array(digests, pa.string())], ["key", "sha256"])
    if state is not None:
        yield pa.record_batch([pa.array([current], kind), pa.array([state.hexdigest()], pa.string())], ["key", "sha256"])


def digest_sorted(df: DataFrame, separator: str) -> DataFrame:
    """``key, sha256`` of ``key, piece`` whose partitions hold whole keys in order; nothing is moved."""
    kind = df.schema["key"].dataType.simpleString()
    return df.select("key", "piece").mapInArrow(partial(_digest, separator=separator), f"key {kind}, sha256 string")


def digest_in_order(df: DataFrame, separator: str) -> DataFrame:
    """``key, sha256`` of ``key, place, piece``: the pieces of a key joined by ``separator``, by ascending place.

    Rows are sorted over all partitions and joined there, so the one task that a key's digest needs
    sees few rows, however many pieces the key has, and holds one of them at a time. No null keys, places or pieces.
    """
    rows = df.select("key", "place", "piece")
    joined = rows.repartitionByRange("key", "place").sortWithinPartitions("key", "place").mapInArrow(partial(_join_pieces, separator=separator), rows.schema)
    return digest_sorted(joined.repartition(F.col("key")).sortWithinPartitions("key", "place"), separator)
