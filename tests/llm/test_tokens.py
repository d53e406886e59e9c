import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from recordloom.llm import bpe, packing, queries, token_counts
from recordloom.llm.tokens import byte_encoder
from tests.llm.helpers import ODD_TEXTS, SF_DIR, empty_documents, given_texts, odd_documents

WORD, BYTE = queries.WORD_VOCABULARY, queries.BYTE_VOCABULARY


@pytest.fixture(scope="module")
def library():
    return {p: tokenizers.Tokenizer.from_file(p) for p in (WORD, BYTE)}


def fuzz(n=3000):
    dice = random.Random(3)
    letters = list("ab ' \n\t éß😀1²<|>_-!Σσ日́\x1c\x85\xa0sStTlLvVeErRmMdD")
    return ["".join(dice.choices(letters, k=dice.randint(1, 40))) for _ in range(n)]


def test_words_like_the_library(library):
    texts = [t or "" for t in ODD_TEXTS] + fuzz()
    ids, counts = bpe.encoder(WORD).encode(texts)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    for i, text in enumerate(texts):
        assert ids[bounds[i]: bounds[i + 1]].tolist() == library[WORD].encode(text, add_special_tokens=False).ids, text


def test_bytes_like_the_library(library):
    for text in [t or "" for t in ODD_TEXTS] + fuzz():
        assert byte_encoder(BYTE).encode(text).tolist() == library[BYTE].encode(text, add_special_tokens=False).ids, text


def test_forgetting_changes_nothing(library):
    words = bpe.WordEncoder(WORD)
    words.remembered.limit = 5
    for text in ["one two three four five six seven", "eight two nine", "one two ten"]:
        ids, _ = words.encode([text])
        assert ids.tolist() == library[WORD].encode(text, add_special_tokens=False).ids


def test_op1(spark, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_bpe(spark, SF_DIR).collect()}
    want = {}
    for doc, text in given_texts().items():
        ids = library[WORD].encode(text, add_special_tokens=False).ids
        decoded = library[WORD].decode(ids, skip_special_tokens=False)
        want[doc] = (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)))
    assert got == want


def test_encode_odd_rows(spark, library):
    rows = bpe.decode(bpe.encode(odd_documents(spark), "doc_id", "text", WORD), "doc_id", "ids", WORD).collect()
    assert len(rows) == len(ODD_TEXTS) + 2
    for row in rows:
        if row.doc_id is not None:
            text = ODD_TEXTS[row.doc_id] or ""
            assert row.ids == library[WORD].encode(text, add_special_tokens=False).ids
            assert row.decoded == library[WORD].decode(row.ids, skip_special_tokens=False)
    assert bpe.encode(empty_documents(spark), "doc_id", "text", WORD).count() == 0


def check_packing(rows, texts, library, window, end=1):
    """Each id in one piece, offsets without gaps, windows within bounds; returns the padding."""
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    for doc, pieces in by_doc.items():
        ids = np.array(library[BYTE].encode(texts[doc] or "", add_special_tokens=False).ids + [end], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at: at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert by_doc.keys() == texts.keys()
    return padding


def test_op9(spark, library):
    assert check_packing(queries.op9_packing(spark, SF_DIR).collect(), given_texts(), library, 2048) == 0


def test_pack_odd_rows(spark, library):
    from pyspark.sql import functions as F

    docs = odd_documents(spark).where("doc_id is not null and key = 'x'").repartition(3)
    rows = packing.pack(docs, "doc_id", "text", BYTE, end=1, window=64).withColumn("ids_crc32", F.crc32("ids")).collect()
    assert check_packing(rows, dict(enumerate(ODD_TEXTS)), library, 64) == 0
    assert packing.pack(empty_documents(spark), "doc_id", "text", BYTE, end=1, window=64).count() == 0
    every = packing.pack(odd_documents(spark), "doc_id", "text", BYTE, end=1, window=64).collect()
    assert sum(r.length for r in every if r.doc_id is None) == every[-1].doc_tokens or any(r.doc_id is None for r in every)


def vectors_of(*lists):
    return [tuple(x.astype("<u4") for x in np.unique(np.array(ids, np.int64), return_counts=True)) for ids in lists]


@pytest.mark.parametrize("common", [0.06, 1.0])
def test_neighbours_share_words(monkeypatch, common):
    monkeypatch.setattr(packing, "COMMON_SHARE", common)  # all terms in the matrix, or all in postings
    vectors = vectors_of([1, 2, 3], [4, 5, 6], [1, 2, 9], [])
    found = np.bincount(np.concatenate([t for t, _ in vectors]).astype(np.int64), minlength=10)
    index = packing.Shard(vectors, (found, 4, 9 / 4))
    score, other = index.scores([np.array([1, 2, 3]), np.array([6])])
    assert score[0] > score[2] > score[1] == score[3] == 0
    assert np.flatnonzero(other).tolist() == [1]
    # by hand: rarity times saturated count, lengths against the mean of 9/4
    norm = 1.2 * (0.25 + 0.75 * 3 / 2.25)
    rarity = np.log1p((4 - 2 + 0.5) / 2.5)
    assert np.isclose(score[2], 2 * rarity * 2.2 / (1 + norm))


def test_window_takes_the_best_neighbour():
    vectors = vectors_of(range(5), range(20, 24), range(1, 5))
    found = np.bincount(np.concatenate([t for t, _ in vectors]).astype(np.int64), minlength=30)
    free = np.array([5, 4, 4])
    windows = list(packing.fill(free, packing.Shard(vectors, (found, 3, 13 / 3)), [t for t, _ in vectors], 8))
    assert windows == [[(0, 5), (2, 3)]] and free.tolist() == [0, 4, 1]
    assert list(packing.fill_rest(free)) == [[(1, 4)], [(2, 1)]] and not free.any()


def test_best_come_first_with_ties_by_place():
    dice = np.random.default_rng(4)
    for size in (1, 5, packing.NEAREST, packing.NEAREST + 1, 700):
        score = dice.integers(-1, 9, size).astype(np.float32)
        score[dice.integers(size)] = np.inf
        assert list(packing.best_first(score)) == np.argsort(-score, kind="stable").tolist()


def test_tree_brings_like_together():
    dice = np.random.default_rng(6)
    middle = dice.normal(size=(8, packing.DIRECTIONS))
    points = (middle[np.arange(4000) % 8] + dice.normal(size=(4000, packing.DIRECTIONS)) * 0.3).astype(np.float32)
    tree = packing.fit_tree(points[:1600])
    leaf = packing.leaves(points, tree)
    assert 0 <= leaf.min() and leaf.max() < len(tree[1])
    runs = np.arange(4000)[np.argsort(leaf, kind="stable")].reshape(8, 500) % 8
    assert np.mean([np.bincount(r, minlength=8).max() / 500 for r in runs]) > 0.8
    assert packing.leaves(points[:3], packing.fit_tree(points[:0])).tolist() == [0, 0, 0]
    assert len(packing.leaves(points[:0], tree)) == 0
    packing.leaves(points, packing.fit_tree(np.repeat(points[:1], 100, axis=0)))


def greedy(texts, library, window):
    """Windows of the whole corpus one after the other: the longest unused tail and its best unused neighbours."""
    ids = {d: np.array(library[BYTE].encode(t, add_special_tokens=False).ids + [1]) for d, t in texts.items()}
    tails = {d: x[len(x) // window * window:] for d, x in ids.items() if len(x) % window}
    sets = {d: set(x.tolist()) for d, x in tails.items()}
    found = {t: sum(t in s for s in sets.values()) for t in set().union(*sets.values())}
    mean = np.mean([len(x) for x in tails.values()])

    def score(a, b):
        norm = 1.2 * (0.25 + 0.75 * len(tails[b]) / mean)
        count = {t: int((tails[b] == t).sum()) for t in sets[a] & sets[b]}
        return sum(np.log1p((len(tails) - found[t] + 0.5) / (found[t] + 0.5)) * n * 2.2 / (n + norm) for t, n in count.items())

    left, out = {d: len(x) for d, x in tails.items()}, []
    while sum(left.values()) >= window:
        seed = min((d for d in left if left[d]), key=lambda d: (-left[d], d))
        order = [seed, *sorted((d for d in left if left[d] and d != seed), key=lambda d: -score(seed, d))]
        space, taken = window, []
        for d in order:
            n = min(left[d], space)
            taken.append((d, n))
            left[d] -= n
            space -= n
            if not space:
                break
        out.append(taken)
    return out


def scattered(n=90, topics=6):
    """Texts of a few topics, dealt over all partitions of a frame."""
    dice = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in "bdfglmnprst"]
    dice.shuffle(words)
    return {i: " ".join(dice.choices(words[i % topics * 90: i % topics * 90 + 90], k=dice.randint(5, 60))) for i in range(n)}


def test_neighbours_come_from_the_whole_shard(spark, library):
    texts = scattered()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartitionByRange(6, "doc_id")
    rows = packing.pack(docs, "doc_id", "text", BYTE, end=1, window=256).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        got.setdefault(r.sequence_id, []).append((r.doc_id, r.length))
    want = greedy(texts, library, 256)
    assert list(got.values())[: len(want)] == want


def test_levels_of_small_shards(spark, library, monkeypatch):
    """Tasks, shards and levels at small sizes: each id once, nothing padded, one shard for the rest."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(packing, "PART_TOKENS", 1 << 10)
    monkeypatch.setattr(packing, "SHARD_TOKENS", 1 << 9)
    monkeypatch.setattr(packing, "SHARD_PIECES", 16)
    texts = scattered(600) | {1000 + i: "" for i in range(300)} | {2000 + i: "the same words in all of these" for i in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    rows = packing.pack(docs, "doc_id", "text", BYTE, end=1, window=64).withColumn("ids_crc32", F.crc32("ids")).collect()
    assert check_packing(rows, texts, library, 64) == 0
    size = {}
    for r in rows:
        size[r.sequence_id] = size.get(r.sequence_id, 0) + r.length
    assert sorted(n for n in size.values() if n < 64) == sorted({n for n in size.values() if n < 64})  # powers of two, each once
    levels = {r.sequence_id >> packing.PLACE_BITS + packing.TASK_BITS for r in rows}
    assert len(levels) >= 3
    again = packing.pack(docs, "doc_id", "text", BYTE, end=1, window=64).collect()
    assert sorted(r.length for r in again) == sorted(r.length for r in rows)


def test_shards_hold_related_documents(spark, monkeypatch):
    """Documents of one topic meet in windows although the shards are small and the topics are dealt over all partitions."""
    monkeypatch.setattr(packing, "PART_TOKENS", 1 << 13)
    monkeypatch.setattr(packing, "SHARD_TOKENS", 1 << 13)
    texts = scattered(1200)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    windows = {}
    for r in packing.pack(docs, "doc_id", "text", BYTE, end=1, window=256).collect():
        windows.setdefault(r.sequence_id, []).append(r.doc_id % 6)
    pure = [max(w.count(t) for t in set(w)) / len(w) for w in windows.values()]
    assert np.mean(pure) > 0.8


def test_long_documents_are_matched_by_all_their_words(spark, library):
    size = lambda text: len(library[BYTE].encode(text, add_special_tokens=False).ids)
    head, tail = " ".join(["river"] * 64), " ".join(["stone"] * 40)
    assert size(f"{head} {tail}") + 1 == 64 + 41  # one window and the longest tail, which is the seed
    texts = {0: f"{head} {tail}", 1: " ".join(["cloud"] * 30), 2: " ".join(["river"] * 39), 3: " ".join(["grass"] * 30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartitionByRange(4, "doc_id")
    rows = packing.pack(docs, "doc_id", "text", BYTE, end=1, window=64).collect()
    seed = next(r for r in rows if r.doc_id == 0 and r.start == 64)
    assert [(r.doc_id, r.length) for r in sorted(rows, key=lambda r: r.offset) if r.sequence_id == seed.sequence_id] == [(0, 41), (2, 23)]


def brute_counts(text, spans, offsets, rule):
    out = []
    for begin, end in spans:
        own = [(s if rule == "start" else max(s, e - 1)) for s, e in offsets]
        out.append(sum(begin <= o < end for o in own))
    return out


@pytest.mark.parametrize("rule", ["start", "end"])
def test_counts_like_offsets(library, rule):
    dice = random.Random(5)
    for text in [t for t in ODD_TEXTS if t] + fuzz(400):
        cuts = sorted(dice.choices(range(len(text) + 1), k=3))
        spans = list(zip([0, *cuts], [*cuts, len(text)]))
        offsets = library[BYTE].encode(text, add_special_tokens=False).offsets
        got = token_counts.attribute(byte_encoder(BYTE), text, *map(np.array, zip(*spans)), rule)
        assert got.tolist() == brute_counts(text, spans, offsets, rule), (text, spans)


def test_shares_add_up():
    text = "Wörter und 😀😀 Zeichen\nüber Grenzen"
    cuts = [0, 3, 12, 13, 20, len(text)]
    got = token_counts.attribute(byte_encoder(BYTE), text, np.array(cuts[:-1]), np.array(cuts[1:]), "share")
    assert np.isclose(got.sum(), len(byte_encoder(BYTE).encode(text)))


def test_op7(spark, library):
    got = {}
    for r in queries.op7_token_counts(spark, SF_DIR).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.start, r.end, r.n_tokens))
    want = {}
    for doc, text in given_texts().items():
        lines, at = [], 0
        offsets = library[BYTE].encode(text, add_special_tokens=False).offsets
        for line in text.split("\n"):
            end = min(at + len(line) + 1, len(text))
            if end > at:
                lines.append((len(lines), at, end, sum(at <= s < end for s, _ in offsets)))
            at = end
        want[doc] = lines
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_sections_of_odd_rows(spark):
    rows = [(1, "abc def", [(0, 3), (3, 99)]), (2, None, [(0, 1)]), (3, "abc", None), (4, "abc", [None, (None, 2), (1, 1)])]
    docs = spark.createDataFrame(rows, "key long, text string, spans array<struct<start:int,end:int>>")
    got = [(r.key, r.section, r.n_tokens) for r in token_counts.count_tokens(docs, "key", "text", BYTE, "spans").collect()]
    assert sorted(got) == [(1, 0, 1.0), (1, 1, 1.0), (2, 0, 0.0), (4, 0, 0.0)]
    assert token_counts.count_tokens(empty_documents(spark), "doc_id", "text", BYTE).count() == 0
    lines = token_counts.count_tokens(odd_documents(spark), "doc_id", "text", BYTE).where("doc_id = 5")
    assert lines.groupBy("section").count().where("count = 2").count() == 3
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, "key", "text", BYTE, rule="middle")
