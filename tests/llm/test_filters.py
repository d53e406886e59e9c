import re

import numpy as np
import pytest

from recordloom.llm import licenses, queries, toxicity
from tests.llm.helpers import ODD_TEXTS, SF_DIR, empty_documents, given_texts, odd_documents, write_table


def brute_places(text, phrases=licenses.PHRASES):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return len(words), sorted(
        (i, label) for phrase, label in phrases.items() for n in [len(phrase.split())]
        for i in range(len(words) - n + 1) if words[i: i + n] == phrase.encode().split()
    )


def licence_row(text):
    n, places = brute_places(text)
    at = [i for i, _ in places]
    return n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


def test_op6(spark):
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in queries.op6_licenses(spark, SF_DIR).collect()}
    assert got == {doc: licence_row(text) for doc, text in given_texts().items()}


def test_licence_cases(spark):
    mit = dict(licenses.TEMPLATES[::-1])["mit"]
    long_mit = [t for label, t in licenses.TEMPLATES if label == "mit"][1]
    texts = {
        0: "CC BY cc-by CC  by-nc", 1: "all rights all rights reserved. General PUBLIC\nlicense", 2: long_mit.upper(),
        3: long_mit.replace("any person obtaining", "any fine person obtaining"), 4: "the software", 5: mit, 6: None, 7: "",
        8: "Licensed under CC BY-NC 4.0.", 9: " ".join(["cc by"] * 500), 10: "İ CC BY ſ",
    }
    docs = spark.createDataFrame([(k, v, "a", 1.0) for k, v in texts.items()], "doc_id long, text string, n_words string, spans double")
    rows = {r.doc_id: r for r in licenses.scan(docs, "doc_id", "text").collect()}
    for doc, text in texts.items():
        n, places = brute_places(text)
        assert (rows[doc].n_words, sorted((p.word, p.label) for p in rows[doc].places)) == (n, places)
        assert 0 <= rows[doc].score <= 1
    labels = {doc: {s.label for s in r.spans} for doc, r in rows.items()}
    assert labels[2] == {"mit"} and rows[2].score == 1 and (rows[2].spans[0].start, rows[2].spans[0].end) == (0, len(long_mit.split()))
    assert "mit" in labels[3] and 0.9 < rows[3].score <= 1
    assert labels[4] == labels[6] == labels[7] == set() and rows[6].score == 0
    assert labels[8] == {"cc-by-nc"} and [p.label for p in rows[8].places] == ["cc-by"]


def test_automaton_finds_the_longest_matches():
    dice = np.random.default_rng(4)
    templates = [("a", "x y z x y"), ("b", "y z x w"), ("c", "x x y")]
    automaton = licenses.Automaton(templates, {"x y": "p"})
    subs = {tuple(w[i:j]) for _, t in [*templates, ("p", "x y")] for w in [t.encode().split()] for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    for _ in range(300):
        words = [bytes([c]) for c in dice.choice(list(b"xyzwq"), 30)]
        places, matches = automaton.scan(words, 1)
        longest = [max((k for k in range(0, i + 1) if tuple(words[i - k: i]) in subs), default=0) for i in range(1, 31)]
        want = [(i, n) for i, n in enumerate(longest, 1) if n and (i == 30 or longest[i] < n + 1)]
        assert [(end, length) for end, _, length in matches] == want
        assert [i for i, _ in places] == [i for i in range(29) if words[i: i + 2] == [b"x", b"y"]]


def test_licences_of_odd_rows(spark):
    rows = licenses.scan(odd_documents(spark), "doc_id", "text").collect()
    assert len(rows) == len(ODD_TEXTS) + 2
    assert {r.doc_id: r.n_words for r in rows if r.doc_id is not None} == {i: brute_places(t)[0] for i, t in enumerate(ODD_TEXTS)}
    assert licenses.scan(empty_documents(spark), "doc_id", "text").count() == 0


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op2_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = [r for r in rows if r.held_out and r.doc_id in labels]
    y, s = np.array([labels[r.doc_id] for r in rows]), np.array([r.score for r in rows])
    area = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
    found, clean = (s[y == 1] >= 0.5).mean(), (s[y == 0] < 0.5).mean()
    print(area, found, clean)
    assert area > 0.95 and found > 0.8 and clean > 0.98


def test_noisy_or_finds_the_word():
    dice = np.random.default_rng(1)
    feature, size, count, label = [], [], [], []
    for _ in range(600):
        sentences = [dice.choice(np.arange(1, 40), 5, replace=False).tolist() for _ in range(dice.integers(1, 6))]
        toxic = dice.random() < 0.3
        if toxic:
            sentences[0][0] = 0
        feature += [f for s in sentences for f in s]
        size += [5] * len(sentences)
        count.append(len(sentences))
        label.append(int(toxic))
    weights = toxicity.fit_noisy_or(*map(np.array, (feature, size, count, label)), np.bincount(feature, minlength=40))
    assert weights[0] + weights[-1] > 0 > weights[1:-1].max() + weights[-1]


def test_offending_sentences(spark):
    weights = np.append(np.zeros(1 << toxicity.FEATURE_BITS), -5.0)
    weights[toxicity.features("badword")[0]] = 10
    docs = spark.createDataFrame([(1, "Fine here. A BADWORD there! Fine again\nbadword.", "z"), (2, "...", "z"), (3, None, "z")], "doc_id long, text string, score string")
    rows = {r.doc_id: r for r in toxicity.score(docs, "doc_id", "text", weights).collect()}
    assert [(s.start, s.end) for s in rows[1].sentences] == [(11, 27), (39, 47)]
    p = 1 / (1 + np.exp([5.0, -5.0, 5.0, -5.0]))
    assert np.isclose(rows[1].score, 1 - np.prod(1 - p))
    assert rows[2].score == rows[3].score == 0


def test_toxicity_of_odd_rows(spark, tmp_path):
    rows = toxicity.score(odd_documents(spark), "doc_id", "text", np.append(np.zeros(1 << toxicity.FEATURE_BITS), -4.0)).collect()
    assert len(rows) == len(ODD_TEXTS) + 2 and all(0 <= r.score <= 1 for r in rows)
    folder = write_table(tmp_path, "documents", {"doc_id": [1, 2], "text": ["a b", None]})
    write_table(tmp_path, "labels", {"doc_id": np.array([], "int64"), "quality": np.array([], "int32"), "toxic": np.array([], "int32")})
    assert [r.predicted for r in queries.op2_toxicity(spark, folder).collect()] == [0, 0]
    assert toxicity.score(empty_documents(spark), "doc_id", "text", np.zeros(1 + (1 << toxicity.FEATURE_BITS))).count() == 0
    null_labels = spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a"), (2, "b c"), (2, "b c")], "doc_id long, text string")
    assert len(toxicity.fit(docs, "doc_id", "text", null_labels, "toxic")) == (1 << toxicity.FEATURE_BITS) + 1
    with pytest.raises(Exception):
        toxicity.fit(docs, "none", "text", null_labels, "toxic")
