"""Token ids of a public byte-level vocabulary."""

from __future__ import annotations

import base64

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


class Encoder:
    """Ids exactly as ``Tokenizer.from_file(vocabulary).encode(text, add_special_tokens=False)``.

    The ranks of the same vocabulary make the same merges several times faster; texts that may
    hold its special strings go to the tokenizer itself. Both paths are parameters.
    """

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None):
        table = {}
        with open(ranks or public_tokenizers.path(RANKS), "rb") as lines:
            for line in lines:
                token, rank = line.split()
                table[base64.b64decode(token)] = int(rank)
        self.core = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.vocabulary, self.full = vocabulary or public_tokenizers.path(VOCABULARY), None

    def ids(self, text: str) -> list[int]:
        if "<|" not in text:
            return self.core(text)
        if self.full is None:
            self.full = Tokenizer.from_file(self.vocabulary)
        return self.full.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return np.array(self.ids(text), "<u4").tobytes()
