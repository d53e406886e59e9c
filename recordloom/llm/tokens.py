"""Ids of a byte-level vocabulary, for the operators that pack or count tokens."""

from __future__ import annotations

import json

import numpy as np
import tiktoken

from recordloom.llm.bpe import SPACE, byte_letters
from recordloom.llm.common import worker_memory

#: Fixed: how the vocabulary's pre-tokenizer splits text.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


class ByteEncoder:
    """Encoder of a byte-level vocabulary; gives the same ids as the vocabulary's own library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte = {letter: b for b, letter in byte_letters().items()}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.coding = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)
        self.size = 1 + max([*ranks.values(), *added.values()])
        self.widths = np.zeros(self.size, np.int64)  # bytes of text
        for token, i in [*ranks.items(), *added.items()]:
            self.widths[i] = len(token.encode() if isinstance(token, str) else token)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; strings of added tokens become these tokens."""
        return self.coding.encode_to_numpy(text, allowed_special="all").astype(np.uint32)


def byte_encoder(path: str) -> ByteEncoder:
    memory = worker_memory()
    if ("bytes", path) not in memory:
        memory["bytes", path] = ByteEncoder(path)
    return memory["bytes", path]
