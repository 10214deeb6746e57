"""Missing or wrong document language labels, by nearest centroids.

Each text is parted into prose and the rest (code, log lines, error messages, links, stock lines); the prose into
sentences. A sentence is a normalised TF-IDF vector of hashed character n-grams and words, compared by cosine with
several clustered centroids of each language; too great a distance rejects it. Centroids are trained here from the
corpus' own labels, which are wrong in part: sentences that lie nearer to another language change over, a few times.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paneflow.session import spread

LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl", "ru")

# Names of the languages in labels.
LANGUAGE_NAMES = {
    "en": "en eng english anglais englisch inglés ingles inglese inglês engels английский",
    "de": "de deu ger german deutsch allemand alemán aleman tedesco alemão duits немецкий",
    "fr": "fr fra fre french français francais französisch francés francese francês frans французский",
    "es": "es spa esp spanish español espanol castellano espagnol spanisch spagnolo espanhol spaans испанский",
    "it": "it ita italian italiano italien italienisch italiaans итальянский",
    "pt": "pt por portuguese português portugues portugais portugiesisch portugués portoghese portugees португальский",
    "nl": "nl nld dut dutch nederlands néerlandais niederländisch neerlandés olandese holandês нидерландский",
    "ru": "ru rus russian русский russe russisch ruso russo",
}
# Labels that name no language.
PLACEHOLDERS = "und unk unknown xx xxx zz zxx mis mul mult multi multiple none null nil na nan n/a ? ?? - -- other auto undefined undetermined tbd todo default any lang language"
# Lines that are stock, not prose (signatures, edit marks, bumps). A signature names somebody and an edit
# mark says what was done, in five words at most; a longer line that begins like one is prose.
STOCK_LINES = re.compile(
    r"^(?:bump!*|up|\+\d+|edit(?:\s*#?\d+)?\s*:(?:\s+\S+){0,5}|update:\s*typo|typo|(?:--|—|–)\s*(?:sent from|gesendet von|envoyé de|enviado desde).*|--(?:\s+\S+){1,5}|sent from my .*|cross-?posted from .*|solved,? see above\.?|\[redacted\]|edited)\s*$",
    re.I,
)


def normal_label(label: Column) -> Column:
    """The language that a label names: a code of LANGUAGES, 'other' for any other one, null where it names none."""
    word = F.lower(F.regexp_extract(label, r"[\p{L}]+(?:/[\p{L}]+)?", 0))
    whole = F.lower(F.trim(label))
    names = F.create_map(*[F.lit(x) for code, all_ in LANGUAGE_NAMES.items() for name in all_.split() for x in (name, code)])
    blank = label.isNull() | (F.regexp_replace(label, r"[\s\p{Z}\p{Cf}]", "") == "") | whole.isin(PLACEHOLDERS.split()) | word.isin(PLACEHOLDERS.split()) | (word == "")
    return F.when(~blank, F.coalesce(F.element_at(names, word), F.lit("other")))


_FENCE = re.compile(r"^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[ \t]*$|\Z)", re.S | re.M)
_PRE = re.compile(r"<pre\b[^>]*>.*?(?:</pre>|\Z)|<code\b[^>]*>.*?(?:</code>|\Z)", re.S | re.I)
_INLINE = re.compile(r"`[^`\n]*`")
_LINK = re.compile(r"\[([^\]\n]*)\]\([^)\s]*\)|<?(?:https?|ftp)://[^\s<>()]+>?|\bwww\.[^\s<>]+|\S+@\S+\.\S+")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>|&[A-Za-z]+;")
_QUOTE = re.compile(r"^\s*(?:(?:[>#*|]+|//+|--(?=\s)|;+)\s*)+")
_LOG = re.compile(r"^\s*(?:\[?\d{3,}\]?\s+\S+\s+[0-9a-f]{8,}|\[\d+\]|\d{4}-\d\d-\d\d[T ]\d\d:\d\d|Traceback \(most recent|File \".*\", line \d+|\w*(?:Error|Exception)\b:|error:|warning:|fatal:|exit status \d+|at \S+\(.*\)|\$ \S|npm |WARN|INFO|DEBUG|ERROR)")
_CODE_START = re.compile(r"\s*(?:[{}\])#]|def |return\b|import |from \S+ import|const |let |var |fn |class |if \(|for \(|SELECT\b|FROM\b|WHERE\b|GROUP BY|HAVING\b|ORDER BY|\"\w+\":|\$ )")
_CODE_INSIDE = re.compile(r"[{};]\s*$|=>|:=|==|&&|\|\||\(\)|\w\(\w*\)|</?\w+[ >]")
_CODE_MARKS = frozenset("{};=&|(<")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+|\n+|(?<=[.!?…][\"'”»)])\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_LETTER = re.compile(r"\w")


def is_code(line: str) -> bool:
    """Whether a line reads as code: by how it begins, or by marks inside it (looked for only if it has any)."""
    return _CODE_START.match(line) is not None or (not _CODE_MARKS.isdisjoint(line) and _CODE_INSIDE.search(line) is not None)


def _bare(s: str) -> str:
    """A line of prose without inline code, links and markup; what a line has no mark of is not looked for."""
    if "`" in s:
        s = _INLINE.sub(" ", s)
    if "@" in s or "://" in s or "](" in s or "www." in s:
        s = _LINK.sub(" ", s)
    if "<" in s or "&" in s:
        s = _TAG.sub(" ", s)
    return s.strip()


def prose_of(text: str) -> list[str]:
    """The lines of prose of a text, without marks of quoting; code, logs, errors, links and stock lines left out."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "<" in text:
        text = _PRE.sub("\n", text)
    out: list[str] = []
    for block in re.split(r"\n[ \t]*\n", text):
        lines = block.split("\n")
        shift = 1 if lines and all(x.startswith("\t") for x in lines if x.strip()) else 0
        kept: list[str] = []
        indented = [x for x in lines if re.match(r"\t? {4}|\t\t", x[shift:]) and x.strip()]
        code = bool(indented) and (any(is_code(x) or _LOG.match(x.strip()) for x in indented) or not any(re.search(r"[.!?]\s*$", x) for x in indented))
        for line in lines:
            bare = line[shift:]
            if not bare.strip() or (code and re.match(r" {2,}|\t", bare)):
                continue
            if _LOG.match(bare) or (is_code(bare) and not bare.lstrip().startswith("#") and len(_WORD.findall(bare)) < 6):
                continue
            s = _QUOTE.sub("", bare).strip() if not STOCK_LINES.match(bare.strip()) else ""
            s = _bare(s)
            if s and not STOCK_LINES.match(s):
                kept.append(s)
        if kept:
            # lines of one wrapped paragraph belong together: a line that does not end a sentence goes on in the next
            joined = kept[0]
            for s in kept[1:]:
                joined += (" " if not re.search(r"[.!?:…][\"'”»)]*$", joined) and (s[:1].islower() or s[:1].isdigit() or len(joined.rsplit("\n", 1)[-1]) > 35) else "\n") + s
            out += joined.split("\n")
    return out


def sentences_of(text: str) -> list[str]:
    return [s for line in prose_of(text) for s in (x.strip() for x in _SENTENCE.split(line) if x) if _WORD.search(s)]


def word_count(sentence: str) -> int:
    """Words between blanks that hold a letter or digit."""
    return sum(1 for t in sentence.split() if t.isalnum() or _LETTER.search(t))


@dataclass(frozen=True)
class LanguageSpec:
    dims: int = 8192
    clusters: int = 4
    #: Labelled documents of each language that centroids are fitted on at most, and sentences of them.
    fit_documents: int = 300
    #: Only documents of so many characters at most are fitted on.
    fit_chars: int = 20_000
    fit_sentences: int = 500
    #: Only sentences of fewer characters are fitted on; all sentences are classified.
    fit_sentence_chars: int = 500
    rounds: int = 4
    #: A sentence is rejected below this share of the first percentile of the training sentences' cosines.
    reject: float = 0.5
    least_words: int = 12


def _hashed(word: str, dims: int) -> np.ndarray:
    w = f" {word} "
    grams = [w, *(w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1) if w[i : i + n].strip())]
    return np.asarray([zlib.crc32(g.encode()) % dims for g in grams], dtype=np.int32)


_remembered = lru_cache(maxsize=200_000)(_hashed)


def _ngrams(word: str, dims: int) -> np.ndarray:
    """Slots of the n-grams of a word of any length; only those of short words are remembered."""
    return _remembered(word, dims) if len(word) <= 64 else _hashed(word, dims)


def vector(sentence: str, dims: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Indices and counts of the hashed n-grams of a sentence's words."""
    parts = [_ngrams(w, dims) for w in _WORD.findall(sentence.lower())]
    if not parts:
        return None
    return np.unique(np.concatenate(parts), return_counts=True)


class LanguageModel:
    """Clustered centroids of each language."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, floor: np.ndarray, languages: tuple[str, ...]):
        self.idf, self.centroids, self.owner, self.floor, self.languages = idf, centroids, owner, floor, languages
        self._columns = np.ascontiguousarray(centroids.T, dtype=np.float32)
        self._seen: dict[str, tuple[str | None, float]] = {}

    @staticmethod
    def _weigh(v: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> np.ndarray:
        w = np.sqrt(v[1]) * idf[v[0]]
        return w / (np.linalg.norm(w) or 1.0)

    @classmethod
    def fit(cls, labelled: list[tuple[str, str]], spec: LanguageSpec = LanguageSpec()) -> LanguageModel:
        """From (sentence, label) pairs, some labels of which are wrong. Deterministic."""
        vs, ys = [], []
        for s, y in labelled:
            if (v := vector(s, spec.dims)) is not None and len(_WORD.findall(s)) >= 4:
                vs.append(v)
                ys.append(y)
        languages = tuple(x for x in LANGUAGES if x in set(ys))
        if not languages:
            return cls(np.ones(spec.dims, np.float32), np.zeros((0, spec.dims), np.float32), np.zeros(0, int), np.zeros(0), ())
        df = np.zeros(spec.dims)
        for i, _ in vs:
            df[i] += 1
        idf = np.log((1 + len(vs)) / (1 + df)) + 1
        ws = [cls._weigh(v, idf) for v in vs]
        y = np.asarray([languages.index(x) for x in ys])

        def mean(members: np.ndarray) -> np.ndarray:
            c = np.zeros(spec.dims)
            for k in members:
                c[vs[k][0]] += ws[k]
            return c / (np.linalg.norm(c) or 1.0)

        def cosines(cs: np.ndarray) -> np.ndarray:
            cols = np.ascontiguousarray(cs.T)
            return np.stack([w @ cols[v[0]] for v, w in zip(vs, ws)]) if vs else np.zeros((0, len(cs)))

        for _ in range(spec.rounds):
            cs = np.stack([mean(np.flatnonzero(y == k)) for k in range(len(languages))])
            y = cosines(cs).argmax(1)
        centroids, owner, floor = [], [], []
        for k in range(len(languages)):
            mine = np.flatnonzero(y == k)
            if not len(mine):
                continue
            part = np.arange(len(mine)) % min(spec.clusters, max(1, len(mine) // 20))
            for _ in range(6):
                cs = np.stack([mean(mine[part == p]) for p in range(part.max() + 1)])
                cols = np.ascontiguousarray(cs.T)
                part = np.stack([ws[i] @ cols[vs[i][0]] for i in mine]).argmax(1)
            sims = np.stack([ws[i] @ cols[vs[i][0]] for i in mine]).max(1)
            for c in cs:
                centroids.append(c)
                owner.append(k)
                floor.append(spec.reject * float(np.quantile(sims, 0.01)))
        return cls(idf.astype(np.float32), np.asarray(centroids, dtype=np.float32), np.asarray(owner), np.asarray(floor), languages)

    def classify(self, sentence: str) -> tuple[str | None, float]:
        """(language, confidence) of a sentence; (None, 0) if it is too far from every centroid."""
        return self.classify_all([sentence])[0]

    def classify_all(self, sentences: list[str]) -> list[tuple[str | None, float]]:
        """As ``classify``, of many sentences: each distinct one is scored once, in blocks of one product."""
        todo = list(dict.fromkeys(s for s in sentences if s not in self._seen))
        if len(self._seen) + len(todo) > 100_000:
            self._seen.clear()
            todo = list(dict.fromkeys(sentences))
        dims = len(self.idf)
        block: list[np.ndarray] = []
        names: list[str] = []
        for k, s in enumerate(todo):
            parts = [_ngrams(w, dims) for w in _WORD.findall(s.lower())] if len(self.centroids) else []
            if parts:
                block.append(np.concatenate(parts))
                names.append(s)
            else:
                self._seen[s] = (None, 0.0)
            if len(block) == 256 or (block and k + 1 == len(todo)):
                self._seen.update(zip(names, self._score(block)))
                block, names = [], []
        if block:
            self._seen.update(zip(names, self._score(block)))
        return [self._seen[s] for s in sentences]

    def _score(self, block: list[np.ndarray]) -> list[tuple[str | None, float]]:
        dims, n = len(self.idf), len(block)
        owner = np.repeat(np.arange(n, dtype=np.int64), [len(x) for x in block])
        counts = np.bincount(owner * dims + np.concatenate(block), minlength=n * dims).reshape(n, dims)
        w = np.sqrt(counts, dtype=np.float32)
        w *= self.idf
        norm = np.sqrt(np.einsum("ij,ij->i", w, w))
        sims = (w @ self._columns) / np.maximum(norm, 1e-12)[:, None]
        by = np.full((n, len(self.languages)), -1.0)
        floor = np.full(len(self.languages), np.inf)
        for k in range(len(self.languages)):
            mine = self.owner == k
            if mine.any():
                by[:, k] = sims[:, mine].max(1)
                floor[k] = self.floor[mine].min()
        best = by.argmax(1)
        top = by[np.arange(n), best]
        sure = 1 / np.exp((by - top[:, None]) * 25).sum(1)
        return [(self.languages[b], float(p)) if t >= floor[b] else (None, 0.0) for b, t, p in zip(best, top, sure)]


def segments(text: str | None, model: LanguageModel) -> list[tuple[int, str | None, float, int, str]]:
    """(ordinal, language, confidence, words, text) of the runs of prose in one language.

    A sentence of fewer than four words, or one that is unsure, goes with the sentence before it, else the one after.
    """
    if not text or not text.strip():
        return []
    found = sentences_of(text)
    return _segments(found, model.classify_all(found))


def _segments(sentences: list[str], classes: list[tuple[str | None, float]]) -> list[tuple[int, str | None, float, int, str]]:
    told = []
    for s, (lang, sure) in zip(sentences, classes):
        weak = len(_WORD.findall(s)) < 4 or sure < 0.5
        told.append([s, lang, sure, weak])
    # the nearest sure sentence before and after each one
    before, after = [None] * len(told), [None] * len(told)
    for k in range(1, len(told)):
        before[k] = before[k - 1] if told[k - 1][3] else told[k - 1]
    for k in range(len(told) - 2, -1, -1):
        after[k] = after[k + 1] if told[k + 1][3] else told[k + 1]
    for k, t in enumerate(told):
        if t[3]:
            near = before[k] or after[k]
            if near is not None and (t[1] is None or t[1] != near[1]):
                t[1], t[2] = near[1], min(near[2], max(t[2], 0.5))
    out: list[list] = []
    for s, lang, sure, _ in told:
        n = word_count(s)
        if out and out[-1][1] == lang:
            last = out[-1]
            last[2] = (last[2] * last[3] + sure * n) / max(1, last[3] + n)
            last[3] += n
            last[4].append(s)
        else:
            out.append([len(out), lang, sure, n, [s]])
    return [(*x[:4], " ".join(x[4])) for x in out]


def languages_of(found: list[tuple], spec: LanguageSpec = LanguageSpec()) -> list[tuple[str, int, float]]:
    """(language, words, confidence) that count: with 12 words or more, or, if none has so many, the one of most words."""
    words: dict[str, list[float]] = {}
    for _, lang, sure, n, _ in found:
        if lang is not None:
            w = words.setdefault(lang, [0, 0.0])
            w[0] += n
            w[1] += sure * n
    ranked = sorted(((k, int(n), s / max(1, n)) for k, (n, s) in words.items()), key=lambda x: (-x[1], x[0]))
    many = [x for x in ranked if x[1] >= spec.least_words]
    return many or ranked[:1]


def train(documents: DataFrame, spec: LanguageSpec = LanguageSpec()) -> LanguageModel:
    """Centroids from a bounded hash sample of the labelled documents (``fit_documents`` of each language)."""
    rows = documents.where("text is not null and doc_id is not null").select("doc_id", "text", normal_label(F.col("lang")).alias("named")).where(F.col("named").isin(*LANGUAGES))
    order = W.partitionBy("named").orderBy(F.xxhash64("doc_id"), "text")
    picked = rows.where(F.length("text") <= spec.fit_chars).withColumn("r", F.row_number().over(order)).where(F.col("r") <= spec.fit_documents).select("named", "doc_id", "text")
    labelled, count = [], dict.fromkeys(LANGUAGES, 0)
    for named, _, text in sorted(map(tuple, picked.collect())):
        for s in sentences_of(text):
            if count[named] < spec.fit_sentences and len(s) < spec.fit_sentence_chars:
                labelled.append((s, named))
                count[named] += 1
    return LanguageModel.fit(labelled, spec)


def detect(documents: DataFrame, model: LanguageModel | None = None, spec: LanguageSpec = LanguageSpec()) -> DataFrame:
    """doc_id, named, languages, segments of each document.

    named is the language its label names; languages an array of (lang, words, confidence) that count; segments an
    array of (ordinal, lang, confidence, words, text), lang null where the distance rejected it. Null, empty and blank
    texts, and texts without prose, have empty arrays. Whole texts are read.
    """
    model = train(documents, spec) if model is None else model
    shared = documents.sparkSession.sparkContext.broadcast((model.idf, model.centroids, model.owner, model.floor, model.languages))
    rows = spread(documents.where("doc_id is not null").select("doc_id", "text", normal_label(F.col("lang")).alias("named")))

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = LanguageModel(*shared.value)
        for pdf in parts:
            sentences = [sentences_of(t) if isinstance(t, str) and t.strip() else [] for t in pdf["text"]]
            classes = iter(m.classify_all([s for ss in sentences for s in ss]))
            found = [_segments(ss, [next(classes) for _ in ss]) for ss in sentences]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "named": pdf["named"],
                    "languages": [[{"lang": a, "words": b, "confidence": c} for a, b, c in languages_of(f, spec)] for f in found],
                    "segments": [[dict(zip(("ordinal", "lang", "confidence", "words", "text"), x)) for x in f] for f in found],
                }
            )

    return rows.mapInPandas(scan, "doc_id bigint, named string, languages array<struct<lang:string,words:int,confidence:double>>, segments array<struct<ordinal:int,lang:string,confidence:double,words:int,text:string>>")


def wrong_labels(documents: DataFrame, model: LanguageModel | None = None, spec: LanguageSpec = LanguageSpec()) -> DataFrame:
    """doc_id, lang, confidence: each language of each document whose label is missing, wrong or one of several."""
    found = detect(documents, model, spec)
    langs = F.col("languages")
    case = (F.size(langs) > 1) | ((F.size(langs) == 1) & (F.col("named").isNull() | (F.col("named") != langs[0]["lang"])))
    return found.where(case).select("doc_id", F.explode("languages").alias("l")).select("doc_id", "l.lang", "l.confidence").distinct()
