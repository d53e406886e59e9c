"""Byte pair encoding by a trie of distinct words, and decoding.

A prefix of a word has one encoding, and that encoding is known from its last token: the
rest is the encoding of a shorter prefix. A token may follow another exactly if no merge
across their border comes before the merges that made them. So the words of a batch go
into a trie, a depth-first walk gives each node its last token, and prefixes that words
share are encoded once.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from recordloom.llm.common import lists, offsets, parts, ranges, text_list, worker_memory

#: Fixed: what the pre-tokenizer counts as white space.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Distinct pieces of text that a worker remembers; then it starts anew.
REMEMBERED = 300_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the files of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class State:
    """A state of the automaton that finds the tokens at the end of a path."""

    __slots__ = ("text", "inner", "final", "steps")

    def __init__(self, text: str, inner: list[tuple[int, int]], final: list[tuple[int, int]]):
        self.text, self.inner, self.final, self.steps = text, inner, final, {}


class Vocabulary:
    """Tokens, merges and added tokens of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*self.ids.values(), *self.added.values()])
        names = {i: t for t, i in (self.ids | self.added).items()}
        self.names = [names.get(i, "") for i in range(self.size)]
        bare = [t.removesuffix(self.suffix) for t in self.ids]
        self.beginnings = {t[:i] for t in bare for i in range(1, len(t) + 1)}
        self.states: dict[str, State] = {}
        self.rank = [-1] * self.size
        self.halves: list[tuple[int, int] | None] = [None] * self.size
        self.pair_rank: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair, whole = (self.ids[left], self.ids[right]), self.ids[left + right]
            self.pair_rank[pair] = rank
            if self.halves[whole] is None:
                self.rank[whole], self.halves[whole] = rank, pair
        self.may_follow: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def border_holds(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Whether no merge across the border of two tokens would come before rank ``before``.

        Takes the tokens apart backwards in time, the later merge first. Merges of one rank
        run from left to right.
        """
        while True:
            across = self.pair_rank.get((left, right))
            if across is not None and across < before:
                return False
            made_left, made_right = self.rank[left], self.rank[right]
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                before, left = made_left, self.halves[left][1]
            else:
                before, right = made_right + 1, self.halves[right][0]

    def stands(self, token: int) -> bool:
        """Whether the token's own text is encoded as that token alone."""
        known = self.whole.get(token)
        if known is None:
            known, todo = True, [token]
            while known and todo:
                t = todo.pop()
                if self.halves[t] and not self.whole.get(t):
                    known = self.border_holds(*self.halves[t], self.rank[t])
                    todo += self.halves[t]
            self.whole[token] = known
        return known

    def follows(self, left: int, right: int) -> bool:
        key = left * self.size + right
        known = self.may_follow.get(key)
        if known is None:
            if len(self.may_follow) > 1_000_000:
                self.may_follow.clear()
            known = self.may_follow[key] = self.border_holds(left, right)
        return known

    def state(self, text: str) -> State:
        """The state of the longest end of ``text`` that some token starts with."""
        while text and text not in self.beginnings:
            text = text[1:]
        known = self.states.get(text)
        if known is None:
            ends = [text[i:] for i in range(len(text))]
            inner = [(self.ids[t], len(t)) for t in ends if t in self.ids and self.stands(self.ids[t])]
            final = [(self.ids[t + self.suffix], len(t)) for t in ends if t + self.suffix in self.ids and self.stands(self.ids[t + self.suffix])]
            known = self.states[text] = State(text, inner, final)
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct non-empty words, written in the letters of the vocabulary.

        A node of the trie keeps its children under their letters, and a word that ends
        below it under the word's last letter and the mark of an end.
        """
        trie: dict = {}
        for word in words:
            node = trie
            for letter in word[:-1]:
                below = node.get(letter)
                if below is None:
                    below = node[letter] = {}
                node = below
            node[word[-1], True] = word
        found: dict[str, list[int]] = {}
        # by depth of the current path: the last token of the prefix, and where that token starts
        last, start = [0], [0]
        follows, known, size = self.follows, self.may_follow, self.size
        todo = [(trie, self.state(""), 0)]
        while todo:
            node, state, depth = todo.pop()
            if depth:
                if depth == len(last):
                    last.append(0)
                    start.append(0)
                last[depth] = -1
                for token, length in state.inner:
                    before = last[depth - length]
                    if depth == length or before >= 0 and (known.get(before * size + token) or follows(before, token)):
                        last[depth], start[depth] = token, depth - length
                        break
            steps = state.steps
            for symbol, below in node.items():
                ends = below.__class__ is str
                letter = symbol[0] if ends else symbol
                to = steps.get(letter)
                if to is None:
                    to = steps[letter] = self.state(state.text + letter)
                if not ends:
                    todo.append((below, to, depth + 1))
                    continue
                for token, length in to.final:
                    at = depth + 1 - length
                    if not at or last[at] >= 0 and (known.get(last[at] * size + token) or follows(last[at], token)):
                        break
                else:
                    raise ValueError(f"the vocabulary has no tokens for {below!r}")
                path = [token]
                while at:
                    path.append(last[at])
                    at = start[at]
                found[below] = path[::-1]
        return found


class Remembered:
    """Ids of pieces of text, kept for the pieces still to come."""

    def __init__(self, encode_many, limit: int = REMEMBERED):
        self.encode_many, self.limit = encode_many, limit
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look_up(self, pieces: list[str]) -> np.ndarray:
        """Places of the pieces in ``starts`` and ``lengths``."""
        new = [p for p in dict.fromkeys(pieces) if p not in self.at]
        if new:
            if len(self.at) + len(new) > self.limit:
                self.clear()
                new = list(dict.fromkeys(pieces))
            flat, lengths = self.encode_many(new)
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, flat])
        return np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, texts: list[str], others: dict[int, list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated ids of texts, cut at blanks, and the number of ids of each; ``others`` has the pieces of some texts."""
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        pieces = cut.flatten().dictionary_encode()
        extra = [p for ps in others.values() for p in ps]
        at = self.look_up(pieces.dictionary.to_pylist() + extra)
        counts = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        where = at[pieces.indices.to_numpy()]
        if others:
            bounds, given = offsets(counts), at[len(pieces.dictionary):]
            ends = dict(zip(others, offsets([len(p) for p in others.values()])[1:]))
            where = np.concatenate([
                given[ends[i] - len(others[i]): ends[i]] if i in others else where[bounds[i]: bounds[i + 1]] for i in range(len(texts))
            ])
            for i, ps in others.items():
                counts[i] = len(ps)
        lengths = self.lengths[where]
        return self.ids[ranges(self.starts[where], lengths)], np.diff(offsets(lengths)[offsets(counts)])


class WordEncoder:
    """Encoder of a vocabulary with word ends: lower case, white space dropped."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.vocabulary.added)) + ")")
        self.letters = {b: letter for b, letter in byte_letters().items() if letter != chr(b)}
        self.remembered = Remembered(self.encode_pieces)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated ids of pieces, and how many each has; an added token is marked by a zero byte before it."""
        added = self.vocabulary.added
        split = [[] if p[:1] == "\0" and p[1:] in added else self.words.findall(p) for p in pieces]
        new = dict.fromkeys(w for ws in split for w in ws)
        for w in new:
            new[w] = w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.letters)
        ids = self.vocabulary.encode_words(new.values())
        new = {w: ids[written] for w, written in new.items()}
        got = [new[ws[0]] if len(ws) == 1 else [i for w in ws for i in new[w]] if ws or p[1:] not in added else [added[p[1:]]] for p, ws in zip(pieces, split)]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.int32, int(lengths.sum())), lengths

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # letter by letter, whatever its place in the word
            text = text.replace("Σ", "σ")
        return text.lower().replace("\n", " ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated ids of whole texts, and the number of ids of each."""
        others = {}
        for n, text in enumerate(texts):
            if "<|" in text and len(split := self.special.split(text)) > 1:
                others[n] = [p for i, t in enumerate(split) for p in (["\0" + t] if i % 2 else self.normal(t).split(" "))]
        return self.remembered.encode(["" if n in others else self.normal(t) for n, t in enumerate(texts)], others)


def encoder(path: str) -> WordEncoder:
    memory = worker_memory()
    if ("words", path) not in memory:
        memory["words", path] = WordEncoder(path)
    return memory["words", path]


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    words = encoder(path)
    for part in parts(batches, "text"):
        ids, counts = words.encode(text_list(part.column("text")))
        yield pa.record_batch({"key": part.column("key"), "ids": lists(ids, counts, pa.int32())})


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    names = pa.array(encoder(path).vocabulary.names)
    for batch in batches:
        for begin in range(0, batch.num_rows, 512):
            part = batch.slice(begin, 512)
            ids = part.column("ids")
            counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            tokens = pa.ListArray.from_arrays(pa.array(offsets(counts), pa.int32()), names.take(ids.flatten()))
            text = pc.binary_join(tokens, " ")
            yield pa.record_batch({"key": part.column("key"), "ids": part.column("ids"), "decoded": text})


def encode(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """``key, ids`` of every whole text, as the vocabulary's own library encodes it without special tokens added.

    ``vocabulary`` is the path of a BPE file with word ends, to be found on every executor. A
    null text counts as empty and gives no ids; strings of added tokens become these tokens.
    Repeated rows and null keys stay as they are, other columns are left out whatever their
    names. Rows are encoded where they are read: no shuffle, memory bounded by a part of a
    batch, or by the longest text.
    """
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    kind = df.schema[key].dataType.simpleString()
    out = rows.mapInArrow(partial(_encode, path=vocabulary), f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def decode(df: DataFrame, key: str, ids: str, vocabulary: str) -> DataFrame:
    """``key, ids, decoded``: the tokens' texts with blanks between, as a file without a decoder asks for.

    Null ids count as none and give an empty text.
    """
    rows = df.select(df[key].alias("key"), df[ids].alias("ids"))
    kind = df.schema[key].dataType.simpleString()
    out = rows.mapInArrow(partial(_decode, path=vocabulary), f"key {kind}, ids array<int>, decoded string")
    return out.withColumnsRenamed({"key": key, "ids": ids})
