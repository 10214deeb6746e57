"""Encoding of the whole corpus with a public byte-pair tokenizer, by forced-boundary splitting.

Two bytes that stand side by side inside no vocabulary token can never end up in one token: between them lies a
certain cut. A text is cut at such pairs, the fragments are encoded independently and the ids concatenated. Cuts of
the text itself are further held to places where the tokenizer's word pattern cannot see across: behind a byte that is
no white space and before an ASCII white space byte, as no word of the pattern goes from one to the other and it never
looks back. Words longer than a bound are cut again at every forced pair inside them.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.session import spread

TOKENIZERS = os.environ.get("PANEFLOW_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the word pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of more bytes than this are cut again at every forced pair.
LONG_WORD = 64
#: Fragments that a worker remembers.
REMEMBERED = 200_000


class ForcedBoundaryEncoder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        #: forced[a, b]: bytes a, b stand side by side in no token
        self.forced = np.ones((256, 256), dtype=bool)
        for token in ranks:
            for a, b in zip(token, token[1:]):
                self.forced[a, b] = False
        white = np.zeros(256, dtype=bool)
        white[[9, 10, 11, 12, 13, 32]] = True
        #: candidate cuts of the raw text: forced, no ASCII white space before, ASCII white space after
        self.safe = self.forced & ~white[:, None] & white[None, :]
        self.known: dict[str, list[int]] = {}

    def fragments(self, text: str) -> list[str]:
        """The text cut at all safe forced boundaries."""
        raw = text.encode("utf-8", "surrogatepass")
        b = np.frombuffer(raw, dtype=np.uint8)
        cuts = np.flatnonzero(self.safe[b[:-1], b[1:]]) + 1 if len(b) > 1 else []
        out: list[str] = []
        start = 0
        for end in (*map(int, cuts), len(raw)):
            piece = raw[start:end].decode("utf-8", "surrogatepass")
            if out and out[-1][-1:].isspace():  # white space of another script before the cut: the pattern looks across
                out[-1] += piece
            else:
                out.append(piece)
            start = end
        return out

    def _word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        if len(raw) <= LONG_WORD:
            return self.encoding._encode_single_piece(raw)
        b = np.frombuffer(raw, dtype=np.uint8)
        at = [0, *map(int, np.flatnonzero(self.forced[b[:-1], b[1:]]) + 1), len(raw)]
        return [i for x, y in zip(at, at[1:]) for i in self.encoding._encode_single_piece(raw[x:y])]

    def fragment_ids(self, fragment: str) -> list[int]:
        ids = self.known.get(fragment)
        if ids is None:
            ids = self.encoding.encode_ordinary(fragment) if len(fragment) <= LONG_WORD else [i for m in self.words.finditer(fragment) for i in self._word(m.group())]
            if len(fragment) <= LONG_WORD:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[fragment] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for f in self.fragments(text):
            out += self.fragment_ids(f)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode(list(ids))


@lru_cache(maxsize=4)
def encoder(path: str) -> ForcedBoundaryEncoder:
    return ForcedBoundaryEncoder(path)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids) of every document: the token ids of its whole text without special tokens.

    Null and empty texts have an empty list; strings of special tokens in a text are ordinary text. Every input row
    gives a row, so a repeated document is repeated. ``vocabulary`` is a path that all executors can read.
    """
    path = vocabulary or os.path.join(TOKENIZERS, VOCABULARY)

    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for s in parts:
            yield pd.Series([np.asarray(enc.encode(t), dtype=np.int32) for t in s], index=s.index)

    return spread(documents.select(F.col(key), F.col(text).alias("__text"))).select(key, ids("__text").alias("ids"))
