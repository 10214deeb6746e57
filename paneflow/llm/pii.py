"""Personal information inside free text, by a skip-chain conditional random field.

The tokens of a document (all its text fields) form a chain; equal telling tokens anywhere in the document are joined
by skip edges that share potentials. Loopy message passing gives each token's marginals, with which labels of repeated
tokens agree. Weights are trained here by pseudo-likelihood on generated texts. An exact check of each span follows.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.llm.pii_training import GIVEN_NAMES, STREET_AFTER, STREET_BEFORE, STREET_ENDS, TITLES, examples
from paneflow.session import spread
from paneflow.sources.tables import latest

LABELS = ("O", "EMAIL", "PHONE", "ID", "ADDRESS", "NAME")
KINDS = {"EMAIL": "email", "PHONE": "phone", "ID": "id_number", "ADDRESS": "address", "NAME": "person_name"}
DIMS = 1 << 16

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|\n|[^\w\s]|_")
# Words that announce a kind of number or text.
CUES = {
    "order": "order ticket invoice sku tracking isbn version build page row column total ratio commit booking stock parcel port level room item book like",
    "id": "ssn dni nif nie steuer id passport ausweisnummer licence license sécurité sociale security national tax bsn fiscale personal",
    "phone": "call tel fax text mobile phone rückruf téléphone telefon cell reach ext",
    "mail": "write mailto kontakt signed reply invite copie reset mail email",
    "place": "lives delivery deliver pick moved wohnhaft lieu ship box flat apt apartment",
    "person": "by to of from ask guest contact avatar assigned approved reviewed merci grüße regards signed author thanks à owner",
}
_CUE_OF = {w: k for k, ws in CUES.items() for w in ws.split()}
_GIVEN = {x.lower() for x in GIVEN_NAMES}
_TITLE = {x.rstrip(".").lower() for x in TITLES}
_STREET = {x.rstrip(".").lower() for x in [*STREET_AFTER, *STREET_BEFORE]}
_PARTICLE = {"van", "von", "de", "di", "da", "del", "der", "la", "le", "bin", "al"}
# Shapes that serve as features; none of them decides alone.
_AT = r"(?:@| @ | ?\[at\] ?| ?\(at\) ?)"
_DOT = r"(?:\.| ?\[dot\] ?| ?\(dot\) ?)"
SHAPES = {
    "email": re.compile(rf"[\w.+%-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z][A-Za-z0-9-]*)+"),
    "phone": re.compile(r"(?<![\w.,#-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ ./-]\d{2,10}){1,5}(?:,? ?ext\.? ?\d{1,5})?(?![\w-])|\+\d{9,14}(?!\w)"),
    "ssn": re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "idlike": re.compile(r"(?<![\w.-])(?:[A-Z]{1,2}\d{6,8}|\d{8}-?[A-Z]|[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]\d{2}[A-Z]\d{5}|\d{2} \d{3} \d{3} \d{3}|\d \d{2} \d{2} \d{2} \d{3} \d{3}|\d{9}|\d{3} \d{2} \d{4}|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z])(?![\w-])"),
    "time": re.compile(r"\d{4}-\d{2}-\d{2}|\d{1,2}:\d{2}|\d+×\d+|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|\d+\.\d+"),
    "street": re.compile(r"\d+ ?[A-Da-d]?(?: bis| ter)? (?:[A-Z]\. )?(?:[A-Z][\w.'’-]+ ){1,3}(?:Street|Road|Lane|Avenue|Drive|Close|Way|Court|Ct|Blvd|Boulevard|Square|Terrace|Place|Crescent|Row|Gardens|Hill|St|Ave|Rd)\b|\d+(?: bis| ter)? (?:rue|avenue|place|chemin|boulevard) [\w'’ -]+|(?:Via|Viale|Piazza|Calle|Avenida|Plaza|Rua|Travessa|Largo) [\w'’ -]+, \d+|[A-ZÄÖÜ]\w+(?:straße|strasse|weg|gasse|platz|allee|laan|straat|ring|damm) \d+|(?:Am|Alter|Zum|An der|Im) [A-ZÄÖÜ]\w+ \d+|(?:P\. ?O\.|PO) Box \d+"),
}


_NONE: frozenset[str] = frozenset()
_DIGIT = re.compile(r"\d")


class Doc:
    """Tokens of the fields of one document."""

    def __init__(self, fields: list[str]):
        self.fields = fields
        self.tokens: list[str] = []
        self.where: list[tuple[int, int, int]] = []
        self.shapes: list[frozenset[str]] = []
        for k, text in enumerate(fields):
            # an address of mail has an at sign, all other shapes a digit
            digit, mail = _DIGIT.search(text) is not None, "@" in text or "at]" in text or "at)" in text
            found = [(*m.span(), n) for n, p in SHAPES.items() if (mail if n == "email" else digit) for m in p.finditer(text)]
            if k and self.tokens:
                self._add("\n", (k, 0, 0), _NONE)
            for m in _TOKEN.finditer(text):
                x, y = m.span()
                self._add(m.group(), (k, x, y), frozenset(n for lo, hi, n in found if lo <= x and y <= hi) if found else _NONE)

    def _add(self, token: str, at: tuple[int, int, int], shapes: frozenset[str]) -> None:
        self.tokens.append(token)
        self.where.append(at)
        self.shapes.append(shapes)

    def skips(self) -> list[tuple[int, int]]:
        """Edges between successive occurrences of equal capitalised words or long numbers."""
        last: dict[str, int] = {}
        out = []
        for i, t in enumerate(self.tokens):
            if (t[:1].isupper() and len(t) > 2) or (t.isdigit() and len(t) >= 4):
                key = t.lower()
                if key in last and i - last[key] > 1:
                    out.append((last[key], i))
                last[key] = i
        return out

    def features(self) -> np.ndarray:
        """(tokens, width) hashed features, padded with 0, which has no weight."""
        base = [_basic(t) for t in self.tokens]
        rows = []
        n = len(self.tokens)
        for i in range(n):
            f = [f"0{x}" for x in base[i]]
            for d in (-2, -1, 1, 2):
                j = i + d
                if 0 <= j < n:
                    f += [f"{d}{x}" for x in base[j][:5]]
                else:
                    f.append(f"{d}END")
            f += [f"s{x}" for x in self.shapes[i]]
            f += [f"s{x}|{base[i][1]}" for x in self.shapes[i]]
            seen = {_CUE_OF[w] for w in (t.lower() for t in self.tokens[max(0, i - 7) : i]) if w in _CUE_OF}
            line = self.tokens[max(0, i - 12) : i]
            near = {_CUE_OF[w] for w in (t.lower() for t in (line[len(line) - line[::-1].index("\n") :] if "\n" in line else line)[-3:]) if w in _CUE_OF}
            f += [f"c{x}" for x in seen] + [f"n{x}" for x in near]
            f += [f"n{x}|{y}" for x in near for y in self.shapes[i]]
            if i and self.where[i - 1][0] == self.where[i][0]:
                f.append("glued" if self.where[i - 1][2] == self.where[i][1] else "apart")
            rows.append([_slot(x) for x in f])
        width = max(map(len, rows), default=1)
        out = np.zeros((n, width), dtype=np.int32)
        for i, r in enumerate(rows):
            out[i, : len(r)] = r
        return out


@lru_cache(maxsize=300_000)
def _slot(feature: str) -> int:
    return 1 + zlib.crc32(feature.encode()) % (DIMS - 1)


@lru_cache(maxsize=100_000)
def _basic(t: str) -> list[str]:
    low = t.lower()
    if t.isdigit():
        shape = f"d{min(len(t), 9)}"
    elif not t[0].isalpha():
        shape = "p" + t
    else:
        shape = ("X" if len(t) == 1 else "XX" if t.isupper() else "Xx") if t[0].isupper() else "x"
    kind = "given" if low in _GIVEN and t[0].isupper() else "title" if low in _TITLE else "street" if low in _STREET or low.endswith(tuple(STREET_ENDS)) else "particle" if low in _PARTICLE else "cue" + _CUE_OF[low] if low in _CUE_OF else "-"
    word = low if not t.isdigit() else "#"
    return [f"w{word}", f"h{shape}", f"k{kind}", f"k{kind}|{shape}", f"e{low[-3:]}" if t[0].isalpha() else "e-", f"b{low[:3]}" if t[0].isalpha() else "b-", f"e2{low[-2:]}" if t[0].isalpha() else "e2-"]


class SkipChainCRF:
    """Node weights, and label-to-label potentials of chain and skip edges."""

    def __init__(self, w: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.w, self.chain, self.skip = w, chain, skip

    @classmethod
    def fit(cls, texts: int = 4000, epochs: int = 8, seed: int = 5, l2: float = 1e-5) -> SkipChainCRF:
        """Pseudo-likelihood over generated texts, by AdaGrad. Deterministic."""
        feats, ys, prev, nxt, near = [], [], [], [], []
        k = len(LABELS)
        for pieces in examples(texts, seed):
            doc = Doc(["".join(p for p, _ in pieces)])
            ends = np.cumsum([len(p) for p, _ in pieces])
            y = [LABELS.index(pieces[int(np.searchsorted(ends, a, side="right"))][1]) for _, a, _ in doc.where]
            n = len(y)
            if not n:
                continue
            votes = np.zeros((n, k), dtype=np.float32)
            for i, j in doc.skips():
                votes[i, y[j]] += 1
                votes[j, y[i]] += 1
            feats.append(doc.features())
            ys += y
            prev += [k, *y[:-1]]
            nxt += [*y[1:], k]
            near.append(votes)
        width = max(f.shape[1] for f in feats)
        x = np.zeros((len(ys), width), dtype=np.int32)
        at = 0
        for f in feats:
            x[at : at + len(f), : f.shape[1]] = f
            at += len(f)
        y, prev, nxt, near = np.asarray(ys), np.asarray(prev), np.asarray(nxt), np.concatenate(near)
        w, gw = np.zeros((DIMS, k), np.float32), np.full((DIMS, k), 1e-6, np.float32)
        c, gc = np.zeros((k + 1, k + 1), np.float32), np.full((k + 1, k + 1), 1e-6, np.float32)
        s, gs = np.zeros((k, k), np.float32), np.full((k, k), 1e-6, np.float32)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for b in range(0, len(y), 512):
                i = order[b : b + 512]
                z = w[x[i]].sum(1) + c[prev[i], :k] + c[:k, :].T[nxt[i]] + near[i] @ s
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(i)), y[i]] -= 1
                hit, place = np.unique(x[i], return_inverse=True)
                place = place.ravel()
                each = np.repeat(p, x.shape[1], axis=0)
                d = np.stack([np.bincount(place, each[:, a], len(hit)) for a in range(k)], 1).astype(np.float32)
                d[hit == 0] = 0
                g = d / len(i) + l2 * w[hit]
                gw[hit] += g * g
                w[hit] -= 0.3 * g / np.sqrt(gw[hit])
                dc = np.zeros_like(c)
                np.add.at(dc[:, :k], prev[i], p)
                t = np.zeros((k + 1, k), np.float32)
                np.add.at(t, nxt[i], p)
                dc[:k, :] += t.T
                dc /= len(i)
                gc += dc * dc
                c -= 0.1 * dc / np.sqrt(gc)
                ds = near[i].T @ p / len(i)
                ds = (ds + ds.T) / 2
                gs += ds * ds
                s -= 0.05 * ds / np.sqrt(gs)
        w[0] = 0
        return cls(w, c, s)

    def node_scores(self, docs: list[Doc]) -> tuple[np.ndarray, np.ndarray]:
        """(scores of all tokens of all documents, one after the other; where each document starts).

        The same sums of weights as over ``Doc.features``, from tables: a row for each distinct token and place, and one
        for each distinct mix of shapes and cues.
        """
        if not hasattr(self, "_tables"):
            self._tables = _Tables(self.w)
        return self._tables.scores(docs)

    def marginals(self, doc: Doc, rounds: int = 3) -> np.ndarray:
        """Marginals of each token of one document."""
        return self.marginals_all([doc], rounds)[0]

    def marginals_all(self, docs: list[Doc], rounds: int = 3) -> list[np.ndarray]:
        """Marginals of each token by loopy message passing: exact on the chain, repeated with the skip messages.

        All documents take each step together, so a step is a few array operations, whatever their number.
        """
        k = len(LABELS)
        docs_with = [d for d in docs if d.tokens]
        if not docs_with:
            return [np.zeros((0, k)) for _ in docs]
        node, starts = self.node_scores(docs_with)
        size = np.asarray([len(d.tokens) for d in docs_with])
        node[starts] += self.chain[k, :k]
        node[starts + size - 1] += self.chain[:k, k]
        phi0 = np.exp(node - node.max(1, keepdims=True))
        edges = [(s + i, s + j) for d, s in zip(docs_with, starts) for a, b in d.skips() for i, j in ((a, b), (b, a))]
        src, dst = (np.asarray([e[n] for e in edges], dtype=np.int64) for n in (0, 1))
        back = np.arange(len(edges)) ^ 1  # an edge and its reverse stand side by side
        msg = np.full((len(edges), k), 1 / k)
        e = np.exp(np.clip(self.skip.astype(np.float64), -4, 4))
        belief = self._chain_pass(phi0, starts, size)
        if len(edges):
            some = np.unique(np.searchsorted(starts, dst, side="right") - 1)
            rows = np.concatenate([np.arange(starts[i], starts[i] + size[i]) for i in some])
            new = np.zeros(len(node), dtype=np.int64)
            new[rows] = np.arange(len(rows))
            src, dst, base = new[src], new[dst], phi0[rows]
            at, n = new[starts[some]], size[some]
            phi = base * (1 / k) ** np.bincount(dst, minlength=len(rows))[:, None]
            own = self._chain_pass(phi, at, n)
            for _ in range(rounds - 1):
                out = (own[src] / np.maximum(msg[back], 1e-12)) @ e
                msg = 0.5 * msg + 0.5 * out / out.sum(1, keepdims=True)
                phi = base.copy()
                np.multiply.at(phi, dst, msg)
                own = self._chain_pass(phi, at, n)
            belief[rows] = own
        parts = iter(np.split(belief, starts[1:]))
        return [next(parts) if d.tokens else np.zeros((0, k)) for d in docs]

    def _chain_pass(self, phi: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Forward and backward along all chains at once, the longest first."""
        k = len(LABELS)
        t = np.exp(np.clip(self.chain[:k, :k].astype(np.float64), -8, 8))
        order = np.argsort(-size, kind="stable")
        at, n = starts[order], size[order]
        last = at + n - 1
        f, b = np.empty_like(phi), np.empty_like(phi)
        f[at] = phi[at] / phi[at].sum(1, keepdims=True)
        b[last] = 1.0
        for step in range(1, int(n[0])):
            m = int(np.searchsorted(-n, -step, side="left"))  # chains of more than ``step`` tokens
            i = at[:m] + step
            v = (f[i - 1] @ t) * phi[i]
            f[i] = v / v.sum(1, keepdims=True)
            j = last[:m] - step
            v = (phi[j + 1] * b[j + 1]) @ t.T
            b[j] = v / v.sum(1, keepdims=True)
        out = f * b
        return out / out.sum(1, keepdims=True)


class _Tables:
    """Sums of node weights by distinct token and place, and by distinct mix of shapes, cues and gap."""

    PLACES = (0, -2, -1, 1, 2)

    def __init__(self, w: np.ndarray):
        self.w = w.astype(np.float64)
        self.ids: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.shape_of: list[str] = []
        self.cue_of: list[int] = []
        self.ends = {d: self._sum([f"{d}END"]) for d in self.PLACES[1:]}
        self.mixes: dict[tuple, int] = {}
        self.mixed: list[np.ndarray] = []
        self.cues = list(CUES)

    def _sum(self, features: list[str]) -> np.ndarray:
        return self.w[[_slot(x) for x in features]].sum(0) if features else np.zeros(self.w.shape[1])

    def _id(self, token: str) -> int:
        got = self.ids.get(token)
        if got is None:
            base = _basic(token)
            got = self.ids[token] = len(self.rows)
            self.rows.append(np.stack([self._sum([f"0{x}" for x in base]), *[self._sum([f"{d}{x}" for x in base[:5]]) for d in self.PLACES[1:]]]))
            self.shape_of.append(base[1])
            cue = _CUE_OF.get(token.lower())
            self.cue_of.append(1 << self.cues.index(cue) if cue else 0)
        return got

    def _mix(self, key: tuple) -> int:
        got = self.mixes.get(key)
        if got is None:
            shapes, h, seen, near, gap = key
            names = lambda mask: [c for i, c in enumerate(self.cues) if mask >> i & 1]
            f = [f"s{x}" for x in shapes] + [f"s{x}|{h}" for x in shapes] + [f"c{x}" for x in names(seen)] + [f"n{x}" for x in names(near)] + [f"n{x}|{y}" for x in names(near) for y in shapes]
            got = self.mixes[key] = len(self.mixed)
            self.mixed.append(self._sum(f + ([gap] if gap else [])))
        return got

    def scores(self, docs: list[Doc]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.rows) > 200_000:
            self.__init__(self.w)
        ids = np.asarray([self._id(t) for d in docs for t in d.tokens], dtype=np.int64)
        size = np.asarray([len(d.tokens) for d in docs])
        starts = np.cumsum(size) - size
        place = np.arange(len(ids)) - np.repeat(starts, size)
        left = np.repeat(size, size) - 1 - place
        used, ids_here = np.unique(ids, return_inverse=True)
        table = np.stack([self.rows[i] for i in used])
        out = table[ids_here, 0]
        for p, d in enumerate(self.PLACES[1:], 1):
            there = place + d >= 0 if d < 0 else left >= d
            near = np.flatnonzero(there)
            out[near] += table[ids_here[near + d], p]
            out[~there] += self.ends[d]
        cue = np.asarray(self.cue_of)[ids]
        line_end = np.asarray([t == "\n" for d in docs for t in d.tokens])
        seen, close = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        open_ = np.ones(len(ids), dtype=bool)
        for d in range(1, 8):
            i = np.flatnonzero(place >= d)
            seen[i] |= cue[i - d]
            if d <= 3:
                open_[i] &= ~line_end[i - d]
                j = i[open_[i]]
                close[j] |= cue[j - d]
        told: list[int] = []
        at_ids, seen_at, close_at = ids.tolist(), seen.tolist(), close.tolist()
        n = 0
        for d in docs:
            field = end = -1
            for (k, x, y), shapes in zip(d.where, d.shapes):
                gap = "" if k != field else "glued" if x == end else "apart"
                field, end = k, y
                told.append(self._mix((shapes, self.shape_of[at_ids[n]] if shapes else "", seen_at[n], close_at[n], gap)))
                n += 1
        which, back = np.unique(np.asarray(told, dtype=np.int64), return_inverse=True)
        out += np.stack([self.mixed[i] for i in which])[back]
        return out, starts


def valid(kind: str, text: str) -> bool:
    """The exact check of a span."""
    digits = sum(c.isdigit() for c in text)
    words = [w for w in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?", text)]
    if kind == "EMAIL":
        return SHAPES["email"].search(text) is not None and not re.search(r"\.(?:png|jpe?g|gif|svg|webp)$", text)
    if kind == "PHONE":
        return digits >= 7
    if kind == "ID":
        return digits >= 5 and sum(c.isalnum() for c in text) >= 7
    if kind == "ADDRESS":
        return digits >= 1 and len(words) >= 1 and len(text) >= 6
    strong = [w for w in words if w[0].isupper() and w.lower() not in _PARTICLE]
    return len(strong) >= 2 and any(len(w.rstrip(".")) > 2 for w in strong)


def spans(doc: Doc, crf: SkipChainCRF) -> list[tuple[int, int, int, str, float]]:
    """(field, start, end, label, confidence) of the spans that hold."""
    return spans_of(doc, crf.marginals(doc)) if doc.tokens else []


def spans_of(doc: Doc, m: np.ndarray) -> list[tuple[int, int, int, str, float]]:
    """As ``spans``, from the marginals of the tokens."""
    if not len(m):
        return []
    best, top = m.argmax(1), m.max(1)
    out: list[list] = []
    for i in map(int, np.flatnonzero(best)):
        field, a, b = doc.where[i]
        label = LABELS[int(best[i])]
        if b == a:
            continue
        if out and out[-1][0] == field and out[-1][3] == label and out[-1][5] == i - 1:
            out[-1][2], out[-1][5] = b, i
            out[-1][4] = max(out[-1][4], float(top[i]))
        else:
            out.append([field, a, b, label, float(top[i]), i])
    return [(f, a, b, k, p) for f, a, b, k, p, _ in out if valid(k, doc.fields[f][a:b])]


PLACEHOLDER = {k: f"[{v.upper()}]" for k, v in KINDS.items()}


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with typed placeholders for (start, end, label)."""
    for a, b, k in sorted(found, reverse=True):
        text = text[:a] + PLACEHOLDER[k] + text[b:]
    return text


@lru_cache(maxsize=1)
def trained() -> SkipChainCRF:
    """The field with its default parameters: training is deterministic and knows no data, so once a process is enough."""
    return SkipChainCRF.fit()


#: Tokens whose marginals are computed together.
TOGETHER = 100_000


def found_in(docs: list[Doc], crf: SkipChainCRF) -> list[list[tuple[int, int, int, str, float]]]:
    """Spans of each document, computed for so many documents at once as hold about ``TOGETHER`` tokens."""
    out: list = []
    part: list[Doc] = []
    size = 0
    for k, d in enumerate(docs):
        part.append(d)
        size += len(d.tokens)
        if size >= TOGETHER or k + 1 == len(docs):
            out += [spans_of(x, m) for x, m in zip(part, crf.marginals_all(part))]
            part, size = [], 0
    return out


def find_personal_data(nodes: DataFrame, key: str = "view_node_id", fields: tuple[str, ...] = ("name", "text"), crf: SkipChainCRF | None = None) -> DataFrame:
    """(key, field, redacted, found) of each non-null field; found is an array of (kind, start, end, text, confidence).

    The fields of a row are one document. Null and blank fields hold nothing (null fields give no row). Of repeated
    deliveries of a key the latest holds. Labels that came with the rows are not used. Whole texts are read; a document
    is independent of all others, so no key is hot.
    """
    crf = trained() if crf is None else crf
    shared = nodes.sparkSession.sparkContext.broadcast((crf.w, crf.chain, crf.skip))
    one = latest(nodes.where(F.col(key).isNotNull()).select(key, "received_at", *fields), [key], "received_at", list(fields)) if "received_at" in nodes.columns else nodes.select(key, *fields)
    kind = dict(nodes.dtypes)[key]

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = SkipChainCRF(*shared.value)
        known: dict[tuple, list] = {}
        for pdf in parts:
            rows = []
            all_texts = [tuple(t if isinstance(t, str) else None for t in x) for x in pdf[[*fields]].itertuples(index=False, name=None)]
            if len(known) > 50_000:
                known.clear()
            todo = list(dict.fromkeys(t for t in all_texts if t not in known))
            known.update(zip(todo, found_in([Doc([t or "" for t in ts]) for ts in todo], model)))
            for i, texts in zip(pdf[key], all_texts):
                got = known[texts]
                for f, (name, t) in enumerate(zip(fields, texts)):
                    if t is not None:
                        mine = [(a, b, k, p) for g, a, b, k, p in got if g == f]
                        rows.append((i, name, redact(t, [(a, b, k) for a, b, k, _ in mine]), [{"kind": KINDS[k], "start": a, "end": b, "text": t[a:b], "confidence": p} for a, b, k, p in mine]))
            yield pd.DataFrame(rows, columns=[key, "field", "redacted", "found"])

    return spread(one).mapInPandas(scan, f"{key} {kind}, field string, redacted string, found array<struct<kind:string,start:int,end:int,text:string,confidence:double>>")
