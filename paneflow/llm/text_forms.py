"""Visually identical text with different characters: one display form, and keys by confusables skeleton.

Skeleton: decompose, replace every character by its prototype from the look-alike table, decompose again. Originals
are grouped by equal skeleton. The table is taken from the Unicode confusables data that Spark ships with its ICU
library, asked once for all code points; it has one entry for each look-alike character, so its size is bounded.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paneflow.session import ship_package, small

#: Invisible characters: default ignorable code points, bidirectional marks, joiners, byte order mark.
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￹-￻\U000e0000-\U000e0fff]")
_SPACE = re.compile(r"[\s\u0085   -     　⠀]+")


def _wide(c: str) -> str:
    """Full-width and half-width shapes, and these only, in their usual shape."""
    d = unicodedata.decomposition(c)
    return "".join(chr(int(x, 16)) for x in d.split()[1:]) if d.startswith(("<wide>", "<narrow>")) else c


_TABLE: dict[str, dict[str, str]] = {}


def build_table(spark: SparkSession) -> dict[str, str]:
    """Prototype of every non-ASCII look-alike, letter case kept, of all assigned code points of all planes.

    Unicode puts I, l, 1 and | (and O and 0) under one prototype; a look-alike of one of these gets the one of its own
    kind: a capital letter looks like I or O, a digit like 1 or 0, anything else like l or o. Where the session has no
    JVM at hand, or no ICU library in it, this raises: a shorter list would give other results without a word. Such a
    session is given a table that was built elsewhere.
    """
    if "icu" not in _TABLE:
        _TABLE["icu"] = _ask_icu(spark)
    return _TABLE["icu"]


def _ask_icu(spark: SparkSession) -> dict[str, str]:
    table: dict[str, str] = {}
    for cp in range(0x80, 0x110000):
        c = chr(cp)
        if (w := _wide(c)) != c:
            table[c] = w
    try:
        icu = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        rn = icu.getSkeleton("m")
    except Exception as e:
        raise RuntimeError("the look-alike table needs the ICU library of the session's JVM; give `table` where there is none") from e
    cps = [cp for cp in [*range(0x80, 0xD800), *range(0xE000, 0x110000)] if unicodedata.category(chr(cp)) not in ("Cn", "Co", "Cc", "Zl", "Zp") and unicodedata.normalize("NFD", chr(cp)) == chr(cp)]
    found = dict(zip(map(chr, cps), icu.getSkeleton("\n".join(map(chr, cps))).split("\n"), strict=True))
    for c, proto in found.items():
        if c in table or proto == c:
            continue
        kind = unicodedata.category(c)
        if proto in ("l", "O", "I", "0", "1", "|"):
            letter = proto in ("l", "I", "1", "|")
            value = unicodedata.digit(c, None)
            proto = str(value) if value in (0, 1) else ("I" if letter else "O") if kind == "Lu" else ("l" if letter else "o") if kind == "Ll" else proto
        table[c] = "m" if proto == rn and rn != c else proto
    return table


#: How ASCII characters are folded into one another by the full skeleton (fixed values).
ASCII_FOLD = str.maketrans({"I": "l", "1": "l", "|": "l", "0": "O"})


class Forms:
    """The three forms of a text under one look-alike table."""

    def __init__(self, table: dict[str, str]):
        self._map = {ord(k): v for k, v in table.items()}
        self._wide = {ord(k): v for k, v in table.items() if _wide(k) == v}

    @lru_cache(maxsize=65536)  # noqa: B019 - one instance lives as long as its worker
    def all(self, text: str) -> tuple[str, str, str]:
        shown = _SPACE.sub(" ", _INVISIBLE.sub("", text)).strip(" ")
        display = unicodedata.normalize("NFC", shown.translate(self._wide))
        look = unicodedata.normalize("NFD", unicodedata.normalize("NFD", shown).translate(self._map))
        look = _SPACE.sub(" ", look).strip(" ")
        return display, look, look.translate(ASCII_FOLD).replace("m", "rn")


def normalized(df: DataFrame, text: str, table: dict[str, str] | None = None, to: str = "forms") -> DataFrame:
    """``df`` with struct ``to``: display, look, skeleton.

    display is the one consistent form (NFC, usual widths, single blanks, nothing invisible, ends trimmed), which keeps
    the letters of its script; look is equal for texts that look the same; skeleton also folds I/l/1 and O/0, as
    the Unicode skeleton does. Null text gives null forms, blank text empty ones. Texts of any length are read whole.
    """
    ship_package(df.sparkSession)
    table = build_table(df.sparkSession) if table is None else table

    @F.pandas_udf("display string, look string, skeleton string")
    def forms(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = Forms(table)
        for s in parts:
            yield pd.DataFrame([f.all(t) if t is not None else (None, None, None) for t in s], columns=["display", "look", "skeleton"])

    return df.withColumn(to, forms(F.col(text)))


def match_key(look: Column) -> Column:
    """NormalizedText.matchKey: the look in lower case."""
    return F.lower(look)


def shown_labels(runs: DataFrame, labels: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """capture_id, source_id, label_id, text, display: runs that show a label by other characters.

    Runs and labels meet by equal skeleton; of these, exactly the pairs of equal look and unequal text remain. Rows
    with a null key, null text or nothing visible match nothing; repeated rows give one row. Distinct texts are
    normalized once, so a text that a third of all runs carry costs one row before the join.
    """
    table = build_table(runs.sparkSession) if table is None else table
    texts = normalized(runs.where("text is not null").select("text").distinct(), "text", table)
    texts = texts.select("text", "forms.*").where("look <> ''")
    known = normalized(labels.where("display is not null and label_id is not null").select("label_id", F.col("display").alias("label")).distinct(), "label", table)
    known = known.select("label_id", "label", F.col("forms.look").alias("label_look"), F.col("forms.skeleton").alias("skeleton")).where("label_look <> ''")
    hits = texts.join(small(known), "skeleton").where("look = label_look and text <> label").select("text", "display", "label_id")
    return runs.where("capture_id is not null and source_id is not null").select("capture_id", "source_id", "text").join(small(hits), "text").select("capture_id", "source_id", "label_id", "text", "display").distinct()
