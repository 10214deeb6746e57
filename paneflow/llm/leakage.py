"""Evaluation texts leaking into training text.

One Aho-Corasick automaton over runs of normalised words of the test items scans each normalised text once; offsets are
mapped back to the original. Every passage that counts holds such a run unaltered: of at least 14 words with at most one
in eight altered, a passage or a part of it that itself counts has a run of ``SEED`` words. Each hit is then extended
word by word in both directions under a bound of alterations, which decides exactly.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.session import spread

SEED = 5
#: Bytes of test items in one automaton; more items are taken in blocks, each of which scans the corpus once.
BLOCK_BYTES = 8 * 1024 * 1024

_INSIDE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}]")
_WORD = regex.compile(r"[\p{L}\p{N}\p{M}\p{Cf}\p{Default_Ignorable_Code_Point}]+(?:['’ʼ＇`´][\p{L}\p{N}\p{M}\p{Cf}]+)*")
#: A tag of any length with attributes (name, or name = value), or an entity; matched without going back.
_TAG = regex.compile(r"""</?[A-Za-z][A-Za-z0-9]*+(?:\s++[\w:.-]++(?:\s*+=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>]++))?+)*+\s*+/?>|&(?:nbsp|amp|quot|lt|gt|#\d++|#x[0-9A-Fa-f]++);""")


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of a text and their places in it.

    Case, punctuation, white space, line breaks, invisible characters and marks of quoting, comments, emphasis and
    markup do not count; nor do compatibility shapes and the form of apostrophes.
    """
    if "<" in text or "&" in text:
        text = _TAG.sub(lambda m: " " * len(m.group()), text)
    words, spans = [], []
    for m in _WORD.finditer(text):
        w = m.group()
        if w.isascii() and w.isalnum():
            words.append(w.lower())
            spans.append(m.span())
            continue
        if not w.isascii():
            w = unicodedata.normalize("NFKC", _INSIDE.sub("", w))
        w = "".join(c for c in w.casefold() if c.isalnum() or unicodedata.category(c) == "Mn")
        if w:
            words.append(w)
            spans.append(m.span())
    return words, spans


@dataclass(frozen=True)
class LeakSpec:
    #: Words of the item that a passage holds at least.
    least_words: int = 14
    #: One altered word in so many; so an item of n words bears n // one_in alterations, and these are followed.
    one_in: int = 8


def _extend(item: list[str], doc: list[str], i: int, j: int, step: int, reach: int) -> list[int]:
    """Most item words gained from (i, j) on in a direction with 0..reach alterations, ending on an equal word (-1: none).

    Furthest-reaching points by diagonal: a word replaced moves along it, one dropped or put in to its neighbours.
    """
    n, m = len(item), len(doc)

    def slide(x: int, y: int) -> int:
        k = 0
        while 0 <= x < n and 0 <= y < m and item[x] == doc[y]:
            x, y, k = x + step, y + step, k + 1
        return k

    gained = [-1] * (reach + 1)
    front = {0: slide(i, j)}
    gained[0] = front[0]
    for e in range(1, reach + 1):
        after: dict[int, int] = {}
        for d, far in front.items():
            # far: item words passed on diagonal d (doc words passed: far + d)
            for nd, nf in ((d, far + 1), (d - 1, far + 1), (d + 1, far)):
                after[nd] = max(after.get(nd, -1), nf)
        best = gained[e - 1]
        front = {}
        for d, far in after.items():
            k = slide(i + step * far, j + step * (far + d))
            front[d] = far + k
            if k:
                best = max(best, far + k)
        gained[e] = best
    return gained


class Matcher:
    """The automaton over test items."""

    def __init__(self, items: list[tuple[int, str]], spec: LeakSpec = LeakSpec()):
        self.spec = spec
        self.items: list[tuple[int, list[str]]] = [(i, w) for i, t in items if t is not None and len(w := words_of(t)[0]) >= spec.least_words]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            for p in range(len(w) - SEED + 1):
                places[" " + " ".join(w[p : p + SEED]) + " "].append((k, p))
        self.automaton = ahocorasick.Automaton()
        for gram, at in places.items():
            self.automaton.add_word(gram, at)
        if places:
            self.automaton.make_automaton()

    def passages(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item_id, start, end, item words, alterations) of the longest passage of each item that counts in the text."""
        if not text or not len(self.automaton):
            return []
        doc, spans = words_of(text)
        if len(doc) < SEED:
            return []
        starts, at = {}, 0
        for k, w in enumerate(doc):
            starts[at] = k
            at += len(w) + 1
        line = " " + " ".join(doc) + " "
        hits: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for end, found in self.automaton.iter(line):
            # `end` is the blank after the last word; the place of the first word follows from the last one's
            last = starts_of(starts, line, end)
            for k, p in found:
                hits[k].add((p, last - SEED + 1))
        out = []
        for k, seeds in hits.items():
            item_id, item = self.items[k]
            if best := self._best(item, doc, seeds):
                n, e, a, b = best
                out.append((item_id, spans[a][0], spans[b][1], n, e))
        return out

    def _best(self, item: list[str], doc: list[str], seeds: set[tuple[int, int]]) -> tuple[int, int, int, int] | None:
        spec, best = self.spec, None
        reach = max(1, len(item) // spec.one_in)
        for p, q in sorted(seeds):
            if (p - 1, q - 1) in seeds:
                continue  # the same run, begun earlier
            right = _extend(item, doc, p, q, 1, reach)
            left = _extend(item, doc, p - 1, q - 1, -1, reach)
            for el, gl in enumerate(left):
                for er, gr in enumerate(right):
                    n, e = max(gl, 0) + gr, el + er
                    if n >= spec.least_words and e * spec.one_in <= n and (best is None or (n, -e) > (best[0], -best[1])):
                        best = (n, e, max(0, q - max(gl, 0)), min(len(doc) - 1, q + gr - 1))
        return best


def starts_of(starts: dict[int, int], line: str, end: int) -> int:
    """Index of the word that ends before the blank at ``end``."""
    return starts[line.rfind(" ", 0, end)]


def leaks(documents: DataFrame, items: DataFrame, spec: LeakSpec = LeakSpec()) -> DataFrame:
    """doc_id, item_id, start, end, item_words, altered: the longest passage of each item in each document.

    Null, empty and blank texts hold nothing; items of fewer than 14 words cannot be held; repeated rows give one row.
    The items are the stated query set: they are taken in blocks of bounded size, each of which scans all documents,
    whole texts, once.
    """
    spark = documents.sparkSession
    known = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(total // BLOCK_BYTES) + 1
    out = None
    docs = spread(documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    for b in range(blocks):
        rows = [(r[0], r[1]) for r in known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]
        shared = spark.sparkContext.broadcast(rows)

        def scan(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            matcher = Matcher(shared.value, spec)
            for pdf in parts:
                found = [(d, *p) for d, t in zip(pdf["doc_id"], pdf["text"]) for p in matcher.passages(t)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "start", "end", "item_words", "altered"])

        part = docs.mapInPandas(scan, "doc_id bigint, item_id bigint, start int, end int, item_words int, altered int")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("item_words", -F.col("altered"), "start", "end", "altered")).alias("p")).select("doc_id", "item_id", "p.start", "p.end", "p.item_words", "p.altered")
