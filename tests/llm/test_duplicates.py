import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from recordloom.llm import minhash, queries, repeats, substrings, windows
from tests.llm.helpers import ODD_TEXTS, SF_DIR, empty_documents, given, given_texts, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_marks(symbols: dict, length: int) -> dict:
    """For each text a mark on every symbol that a repeated window covers."""
    count = Counter(tuple(s[i: i + length]) for s in symbols.values() for i in range(len(s) - length + 1))
    marks = {}
    for doc, s in symbols.items():
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if count[tuple(s[i: i + length])] > 1:
                gone[i: i + length] = [True] * length
        marks[doc] = gone
    return marks


def brute_words(texts: dict, length: int) -> dict:
    words = {doc: WORD.findall(t or "") for doc, t in texts.items()}
    marks = brute_marks(words, length)
    return {d: (len(w), sum(marks[d]), " ".join(x for x, gone in zip(w, marks[d]) if not gone)) for d, w in words.items()}


def brute_bytes(texts: dict, length: int) -> dict:
    data = {doc: (t or "").encode() for doc, t in texts.items()}
    marks = brute_marks(data, length)
    return {
        d: (len(b), sum(marks[d]), sum(g and not p for g, p in zip(marks[d], [False, *marks[d]])), bytes(x for x, gone in zip(b, marks[d]) if not gone))
        for d, b in data.items()
    }


def brute_components(texts: dict, words: int, percent: int) -> dict:
    sets, root = {}, {d: d for d in texts}
    for doc, text in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[doc] = {tuple(w[i: i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    docs = sorted(texts)
    for i, a in enumerate(docs):
        for b in docs[i + 1:]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= percent * large:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in docs}


def patchwork(n=120, seed=9, vocabulary=40):
    """Texts that share passages of many lengths, overlap themselves, and are copied."""
    dice = random.Random(seed)
    word = lambda: "".join(dice.choices("abcdeé", k=dice.randint(1, 5)))
    passages = [" ".join(word() for _ in range(dice.randint(3, 60))) for _ in range(vocabulary)]
    texts = {}
    for doc in range(n):
        parts = [dice.choice(passages) if dice.random() < 0.5 else " ".join(word() for _ in range(dice.randint(0, 15))) for _ in range(dice.randint(0, 6))]
        texts[doc] = dice.choice([" ", "\n", "  "]).join(parts)
        if doc > 3 and dice.random() < 0.15:
            texts[doc] = texts[dice.randrange(doc)]
    texts[n] = "ab " * 200
    texts[n + 1] = "z" * 300
    texts[n + 2] = None
    texts[n + 3] = ""
    return texts


def frame(spark, texts, tasks=4):
    rows = [(d, t, "clash", 1.5) for d, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, rid string, key double").repartition(tasks)


@pytest.fixture
def small_parts(monkeypatch):
    """Parts, groups and hot keys small enough that a few texts need several."""
    # functions are shipped by value, with these settings
    monkeypatch.setattr(windows, "HOT", 4)
    monkeypatch.setattr(substrings, "GROUP_ROWS", 50)
    monkeypatch.setattr(repeats, "INDEX_SYMBOLS", 2000)
    monkeypatch.setattr(windows, "PLACE_BITS", 8)


@pytest.mark.parametrize("length", [2, 5, 35])
def test_words_like_brute_force(spark, small_parts, length):
    texts = patchwork()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(written(spark, frame(spark, texts)), "doc_id", "text", length).collect()}
    assert got == brute_words(texts, length)


def written(spark, df):
    from recordloom.session import stage

    return stage(df, "texts")


@pytest.mark.parametrize("length", [16, 30, 100])
def test_bytes_like_brute_force(spark, small_parts, length):
    texts = patchwork(seed=length)
    rows = repeats.remove_repeated_bytes(written(spark, frame(spark, texts)), "doc_id", "text", length).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows}
    assert got == brute_bytes(texts, length)


def test_op8(spark):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op8_substring_dedup(spark, SF_DIR).collect()}
    want = brute_words(given_texts(), 35)
    assert got == {d: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, (n, gone, kept) in want.items()}
    assert any(gone for _, gone, _ in want.values())


def test_op4(spark):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op4_repeated_bytes(spark, SF_DIR).collect()}
    want = brute_bytes({d: t for d, t in given_texts().items()}, 400)
    assert got == {d: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for d, v in want.items()}


def test_repeats_of_odd_rows(spark):
    df = written(spark, odd_documents(spark))
    texts = dict(enumerate(ODD_TEXTS)) | {"null": "null key", "again": ODD_TEXTS[5]}
    want_words, want_bytes = brute_words(texts, 2), brute_bytes(texts, 16)
    for r in substrings.remove_repeats(df, "doc_id", "text", 2).collect():
        assert (r.n_words, r.n_removed, r.kept) == want_words["null" if r.doc_id is None else r.doc_id]
    for r in repeats.remove_repeated_bytes(df, "doc_id", "text", 16).collect():
        assert (r.n_bytes, r.n_removed) == want_bytes["null" if r.doc_id is None else r.doc_id][:2]
    assert substrings.remove_repeats(written(spark, empty_documents(spark)), "doc_id", "text", 35).count() == 0
    assert repeats.remove_repeated_bytes(written(spark, empty_documents(spark)), "doc_id", "text", 400).count() == 0


def test_texts_without_repeats_stay_as_they_are(spark):
    df = written(spark, frame(spark, {1: "a  b\nc", 2: "x y z", 3: " x y z", 4: None}))
    got = {r.doc_id: r.kept for r in substrings.remove_repeats(df, "doc_id", "text", 3, as_they_are=True).collect()}
    assert got == {1: "a  b\nc", 2: "", 3: "", 4: ""}


def test_run_index():
    dice = np.random.default_rng(5)
    for _ in range(60):
        rows = [dice.integers(0, 3, dice.integers(1, 30)) for _ in range(dice.integers(1, 8))]
        text = np.concatenate([np.append(r, 10 + i) for i, r in enumerate(rows)])
        n = len(text)
        order = repeats.suffix_array(text)
        assert order.tolist() == sorted(range(n), key=lambda i: text[i:].tolist())
        index = repeats.RunIndex(text)
        assert np.repeat(index.symbols, index.lengths).tolist() == text[order - 1].tolist()
        assert (np.diff(index.symbols) != 0).all()
        match = lambda i, j: next((k for k in range(n) if i + k >= n or j + k >= n or text[i + k] != text[j + k]), n)
        want = [max((match(i, j) for j in range(n) if j != i), default=0) for i in range(n)]
        assert index.matching_statistics(n).tolist() == want


def test_anchors_hang_on_content():
    dice = np.random.default_rng(6)
    hashes = dice.integers(0, 5, 400).astype(np.uint64) << np.uint64(40)
    bounds = np.array([0, 100, 100, 130, 400])
    anchor, low, high = windows.anchors(hashes, bounds, 20, 8)
    of = {s: a for a, lo, hi in zip(anchor, low, high) for s in range(lo, hi + 1)}
    assert sorted(of) == [s for a, b in zip(bounds[:-1], bounds[1:]) for s in range(a, b - 19)]
    for s, a in of.items():
        assert a == max(p for p in range(s, s + 8) if hashes[p] == hashes[s: s + 8].min())


def test_sketch_loses_nothing(spark):
    texts = patchwork()
    df = written(spark, frame(spark, texts))
    from functools import partial

    sketch = windows.build_sketch(df, partial(substrings._keys, length=5), bits=18)
    import pyarrow as pa

    keys = np.concatenate([substrings._keys(pa.record_batch({"text": [t]}), 5) for t in texts.values()])
    _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    assert sketch.repeated(keys)[count[place] > 1].all()
    assert sketch.repeated(keys)[count[place] == 1].mean() < 0.2


def near_copies(seed=4):
    dice = random.Random(seed)
    word = lambda: "w" + str(dice.randrange(3000))
    texts, doc = {}, 0
    for _ in range(12):
        base = [word() for _ in range(dice.choice([3, 8, 30, 120]))]
        for _ in range(dice.choice([1, 2, 25])):
            copy = list(base)
            for _ in range(dice.choice([0, 0, 1, 2, 5])):
                copy[dice.randrange(len(copy))] = word()
            texts[doc] = " ".join(copy)
            doc += dice.choice([1, 3])
        # a chain whose ends are apart
        for step in range(dice.choice([0, 12])):
            copy = base[step * 3:] + [word() for _ in range(step * 3)]
            texts[doc] = " ".join(copy).upper()
            doc += 1
    return texts | {doc + 1: None, doc + 2: "", doc + 3: " ", doc + 4: "one", doc + 5: "ONE", doc + 6: "one one", doc + 7: "one one one"}


@pytest.mark.parametrize("words", [2, 5])
def test_components_like_brute_force(spark, monkeypatch, words):
    monkeypatch.setattr(minhash, "MEMBERS", 3)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    texts = near_copies(seed=words)
    rows = minhash.near_duplicates(written(spark, frame(spark, texts)), "doc_id", "text", words, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts, words, 80)
    assert {r.doc_id for r in rows if r.representative} == {r.component_id for r in rows}


def test_op10(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op10_near_duplicates(spark, SF_DIR).collect()}
    assert got == brute_components(given_texts(), 2, 80)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(3, "a b c"), (3, "A b c"), (None, "a  b\tc"), (None, "x y"), (1, None), (1, None), (2, "")]
    df = written(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    got = minhash.near_duplicates(df, "doc_id", "text", 2, 80).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == sorted(
        [("3", 2, 3), ("3", 2, 3), ("None", 2, 3), ("None", 1, None), ("1", 0, 1), ("1", 0, 1), ("2", 0, 2)])
    assert sum(r.representative for r in got) == 5
    assert minhash.near_duplicates(written(spark, empty_documents(spark)), "doc_id", "text", 2, 80).count() == 0


def test_circulant_signatures_estimate_similarity():
    import pyarrow as pa

    base = [f"w{i}" for i in range(400)]
    other = base[:360] + [f"v{i}" for i in range(40)]
    part = pa.record_batch({"text": [" ".join(base), " ".join(other)]})
    a, b = minhash.signatures(minhash.Shingles(part, 2))
    assert abs((a == b).mean() - 359 / 439) < 0.12
    first, shifts = minhash.permutations()
    assert (shifts[1][:-1] == shifts[0][1:]).all() and len(np.unique(first)) == len(first)


def test_stages(spark, monkeypatch):
    """Each stage against what its operator and brute force say of its own input."""
    docs = given(spark, "documents")
    columns = docs.columns
    texts = given_texts()
    one = written(spark, corpus_pipeline.drop_toxic(spark, docs, SF_DIR))
    toxic = {r.doc_id for r in queries.op2_toxicity(spark, SF_DIR).collect() if r.predicted}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == texts.keys() - toxic
    two = written(spark, corpus_pipeline.drop_near_duplicates(spark, one, SF_DIR))
    kept = {r.doc_id: r.text for r in one.collect()}
    want = brute_components(kept, 5, 80)
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted({c for _, c in want.values()})
    three = written(spark, corpus_pipeline.cut_repeats(spark, two, SF_DIR))
    kept = {r.doc_id: r.text for r in two.collect()}
    want = brute_words(kept, 35)
    assert three.columns == columns
    assert {r.doc_id: (r.text, r.n_chars) for r in three.collect()} == {
        d: (kept[d], len(kept[d])) if not gone else (text, len(text)) for d, (_, gone, text) in want.items()}
    four = corpus_pipeline.pack_windows(spark, three, SF_DIR).collect()
    assert {r.doc_id for r in four} == kept.keys()
    final = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted((r.doc_id, r.start, r.length, bytes(r.ids)) for r in final)[0][0] in kept
    assert sum(r.length for r in final) == sum(r.length for r in four)


def test_stages_of_empty_tables(spark, tmp_path):
    folder = str(tmp_path / "empty")
    empty_documents(spark).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
