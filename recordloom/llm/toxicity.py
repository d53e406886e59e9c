"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import lists, offsets, parts, text_list, worker_memory

#: Labelled documents that the model is fitted on, about, at most.
FIT_ROWS = 12_000
FEATURE_BITS = 18
#: A word's features are the word and its beginnings of these lengths.
BEGINNINGS = (4, 5)
#: Documents of the sample that a feature must be in.
LEAST_DOCUMENTS = 5
PASSES, RATE, PENALTY = 200, 0.15, 0.6
#: Features that are summed at once.
AT_ONCE = 2_000_000

#: Words whose weights a worker remembers.
REMEMBERED = 200_000

#: Words, and the ends of sentences.
PIECE = re.compile(r"[^\W\d_]+|[.!?\n]+")
ENDS = frozenset(".!?\n")


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word."""
    names = [word, *(f"{n}:{word[:n]}" for n in BEGINNINGS if len(word) >= n)]
    return [zlib.crc32(n.encode()) >> (32 - FEATURE_BITS) for n in names]


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences that hold a word; a sentence ends with its marks or a line break."""
    out, begin, words = [], None, 0
    for m in PIECE.finditer(text):
        if m[0][0] in ENDS:
            if words:
                out.append((begin, m.end()))
            begin, words = None, 0
        else:
            begin = m.start() if begin is None else begin
            words += 1
    return out + [(begin, len(text))] if words else out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, "text"):
        flat, sizes, counts = [], [], []
        for text in text_list(part.column("text")):
            split, words = [], []
            for piece in [*PIECE.findall(text.lower()), "\n"]:
                if piece[0] not in ENDS:
                    words += features(piece)
                elif words:
                    split.append(sorted(set(words)))
                    words = []
            counts.append(len(split))
            sizes += [len(s) for s in split]
            flat += [f for s in split for f in s]
        counts = np.array(counts, np.int64)
        sizes = np.array(sizes, np.int64)
        per_doc = np.diff(offsets(sizes)[offsets(counts)])
        yield pa.record_batch({
            "toxic": part.column("toxic"), "features": lists(np.array(flat, np.int32), per_doc, pa.int32()),
            "sizes": lists(sizes.astype(np.int32), counts, pa.int32()),
        })


def fit_noisy_or(feature: np.ndarray, size: np.ndarray, count: np.ndarray, label: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Weights of the features and, last, the bias of sentence scores whose noisy-or fits the documents' labels.

    ``feature`` are the features of all sentences, ``size`` their number per sentence, ``count``
    the sentences per document, ``often`` the documents per feature. Full-batch steps with
    momentum; after each one the weights shrink towards zero, so that only features with
    enough evidence keep one.
    """
    width = len(often)
    doc = np.repeat(np.arange(len(count), dtype=np.int32), count)
    sentence = np.repeat(np.arange(len(size), dtype=np.int32), size)
    pieces = [slice(i, i + AT_ONCE) for i in range(0, len(feature), AT_ONCE)]
    scale = RATE / np.sqrt(np.maximum(1, often))
    weights, push = np.append(np.zeros(width), -4.0), np.zeros(width + 1)
    for _ in range(PASSES):
        z, slope = np.full(len(size), weights[-1]), np.zeros(width + 1)
        for own in pieces:
            z += np.bincount(sentence[own], weights[feature[own]], len(size))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        quiet = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(count))  # log of: no sentence is toxic
        share = np.where(label == 1, np.exp(quiet) / np.maximum(1e-9, -np.expm1(quiet)), -1.0)
        p *= share[doc]
        for own in pieces:
            slope[:-1] += np.bincount(feature[own], p[sentence[own]], width)
        slope[-1] = p.sum()
        push = 0.9 * push + 0.1 * slope
        moved = weights[:-1] + scale * push[:-1]
        weights[:-1] = np.sign(moved) * np.maximum(0, np.abs(moved) - PENALTY * scale)
        weights[-1] += 2 * RATE * push[-1] / max(1, len(count))
    return weights


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = 1 << FEATURE_BITS
    often, got = np.zeros(width, np.int64), []
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            feature, sizes = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("features", "sizes"))
            count = np.diff(part.column("sizes").offsets.to_numpy())
            doc = np.repeat(np.repeat(np.arange(len(count)), count), sizes)
            often += np.bincount(np.unique(doc * width + feature) % width, minlength=width)
            got.append((feature.copy(), sizes.copy(), count, part.column("toxic").to_numpy()))
    weights = np.append(np.zeros(width), -4.0)
    if got:
        # features of a few documents say nothing about others
        used = np.flatnonzero(often >= LEAST_DOCUMENTS)
        place = np.full(width, -1, np.int32)
        place[used] = np.arange(len(used))
        kept = []
        for feature, sizes, *_ in got:
            own = place[feature]
            sentence = np.repeat(np.arange(len(sizes)), sizes)[own >= 0]
            kept.append((own[own >= 0], np.bincount(sentence, minlength=len(sizes)).astype(np.int32)))
        feature, size = (np.concatenate(x) for x in zip(*kept))
        count, label = (np.concatenate([g[i] for g in got]) for i in (2, 3))
        del got, kept
        fitted = fit_noisy_or(feature, size, count, label, often[used])
        weights[used], weights[-1] = fitted[:-1], fitted[-1]
    yield pa.record_batch({"weights": pa.array([weights.tolist()], pa.list_(pa.float64()))})


def fit(df: DataFrame, key: str, text: str, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> np.ndarray:
    """Weights fitted on about ``rows`` labelled documents at most, chosen by a hash of their key.

    Rows with a null key or label are left out; other labels than 1 count as 0, null texts as
    empty. Without any labelled document no sentence is toxic. Sentences become hashed features
    where the texts are; the fit itself runs in one task, on a sample of bounded size.
    """
    labels = labels.select(labels[key].alias("key"), (labels[label] == 1).cast("int").alias("toxic")).dropna()
    total = max(1, labels.count())
    share = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1 << 20)) < int(min(1.0, rows / total) * (1 << 20))
    chosen = labels.where(share)  # about `rows` rows of two numbers each
    docs = df.select(df[key].alias("key"), df[text].alias("text")).join(F.broadcast(chosen), "key").select("text", "toxic")
    sample = docs.mapInArrow(_features, "toxic int, features array<int>, sizes array<int>")
    return np.array(sample.repartition(1).mapInArrow(_fit, "weights array<double>").first()["weights"])


def _score(batches: Iterator[pa.RecordBatch], weights: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
    memory = worker_memory()
    if memory.get("weighed by") != name:  # words of one model at a time
        memory["weighed by"], memory["word weights"] = name, {}
    known: dict[str, float] = memory["word weights"]
    bias = float(weights[-1])
    for part in parts(batches, "text"):
        if len(known) > REMEMBERED:
            known.clear()
        texts = text_list(part.column("text"))
        pieces = [[*PIECE.findall(t.lower()), "\n"] for t in texts]
        for word in {w for ps in pieces for w in ps} - known.keys():
            known[word] = float("nan") if word[0] in ENDS else sum(weights[f] for f in features(word))
        score, spans = [], []
        for text, ps in zip(texts, pieces):
            value = np.fromiter(map(known.__getitem__, ps), np.float64, len(ps))
            end = np.isnan(value)
            total = np.cumsum(np.where(end, 0.0, value))[end]
            words = np.diff(np.flatnonzero(end), prepend=-1) > 1
            z = np.diff(total, prepend=0.0)[words] + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            score.append(0.0 - float(np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())))
            at = np.flatnonzero(p >= 0.5)
            where = sentences(text) if len(at) else []
            spans.append([{"start": where[i][0], "end": where[i][1], "score": float(p[i])} for i in at if i < len(where)])
        yield pa.record_batch({"key": part.column("key"), "score": pa.array(score, pa.float64()), "sentences": pa.array(spans, SPANS)})


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def score(df: DataFrame, key: str, text: str, weights: np.ndarray) -> DataFrame:
    """``key, score, sentences``: noisy-or of the sentence scores of whole texts, and the sentences with 0.5 or more.

    A text without words has no sentences and scores 0. Repeated rows and null keys stay,
    other columns are left out. No shuffle.
    """
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    kind = df.schema[key].dataType.simpleString()
    out = rows.mapInArrow(
        partial(_score, weights=weights, name=str(zlib.crc32(weights.tobytes()))),
        f"key {kind}, score double, sentences array<struct<start:long,end:long,score:double>>",
    )
    return out.withColumnRenamed("key", key)
