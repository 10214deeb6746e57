"""Column functions over text, colours and addresses."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneflow.schemas import NAMED_COLORS

_WHITE = "[\\\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\u200b\\u200c\\u200d\\ufeff]+".replace("\\\\s", "\\s")


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t) if t is not None else None)


def nfc(text: Column) -> Column:
    """Canonical composition; texts of ASCII alone, which are composed already, are not sent to Python's tables."""
    odd = text.rlike("[^\\x00-\\x7F]")
    return F.when(odd, _nfc(F.when(odd, text))).otherwise(text)


def match_text(display: Column, redacted: Column | None = None) -> Column:
    """Composed, white and zero-width space collapsed, trimmed, lower case; empty if redacted."""
    key = F.lower(F.trim(F.regexp_replace(nfc(display), _WHITE, " ")))
    return key if redacted is None else F.when(redacted, F.lit("")).otherwise(key)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-16 units, rounded up."""
    return F.ceil(utf16_length(text) / 4).cast("bigint")


def patch_tokens(width: Column, height: Column, patch: int) -> Column:
    return (F.ceil(width / patch) * F.ceil(height / patch)).cast("bigint")


#: The marks around untrusted content, and what takes their place inside it (fixed values).
UNTRUSTED_OPEN, UNTRUSTED_CLOSE = "<<<UNTRUSTED_UI_CONTENT>>>", "<<<END_UNTRUSTED_UI_CONTENT>>>"
UNTRUSTED_REMOVED = "[untrusted-marker-removed]"


def sanitize(text: Column) -> Column:
    """Untrusted text with the two marks taken out and control characters other than tab and line ends removed."""
    quiet = F.replace(F.replace(text, F.lit(UNTRUSTED_OPEN), F.lit(UNTRUSTED_REMOVED)), F.lit(UNTRUSTED_CLOSE), F.lit(UNTRUSTED_REMOVED))
    return F.regexp_replace(quiet, "[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def delimit(text: Column) -> Column:
    """A serialized view inside the marks of untrusted content."""
    return F.concat(F.lit(UNTRUSTED_OPEN + "\n"), text, F.lit("\n" + UNTRUSTED_CLOSE))


def canonical_color(text: Column) -> Column:
    """#rrggbb or #rrggbbaa of a named, hexadecimal or rgb() colour; null for anything else."""
    v = F.lower(F.trim(text))
    named = F.element_at(F.create_map(*[F.lit(x) for kv in NAMED_COLORS.items() for x in kv]), v)
    twice = F.regexp_replace(F.regexp_extract(v, "^#([0-9a-f]{3,4})$", 1), "([0-9a-f])", "$1$1")
    rgb, alpha = F.regexp_extract(v, "^#([0-9a-f]{6})([0-9a-f]{2})?$", 1), F.regexp_extract(v, "^#([0-9a-f]{6})([0-9a-f]{2})?$", 2)
    body = F.regexp_extract(v, r"^rgba?\(\s*([^)]*)\)$", 1)
    parts = F.transform(F.filter(F.split(body, r"[,/\s]+"), lambda p: p != ""), lambda p: p.try_cast("double"))
    byte = lambda c: F.lpad(F.lower(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(c + 0.5))).cast("bigint"))), 2, "0")
    part = lambda i: F.get(parts, F.lit(i))
    base = F.concat(F.lit("#"), byte(part(0)), byte(part(1)), byte(part(2)))
    a = part(3)
    full = F.when((F.size(parts) == 4) & (a >= 0) & (a < 1), F.concat(base, byte(a * 255))).otherwise(base)
    return F.coalesce(named, F.when(twice != "", F.concat(F.lit("#"), twice)), F.when(rgb != "", F.concat(F.lit("#"), rgb, F.when(alpha == "ff", "").otherwise(alpha))), F.when(F.size(parts).isin(3, 4), full))


def css_length_px(text: Column, number: Column) -> Column:
    """Style length in CSS px: a number is px; text is a magnitude with an absolute unit, else null."""
    from paneflow.functions.lengths import PX_PER_UNIT

    v = F.lower(F.trim(text))
    m, u = F.regexp_extract(v, r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))([a-z%]*)$", 1), F.regexp_extract(v, r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))([a-z%]*)$", 2)
    factor = F.element_at(F.create_map(*[x for k, f in {**PX_PER_UNIT, "": 1.0}.items() for x in (F.lit(k), F.lit(f))]), u)
    px = F.coalesce(number, F.when(m != "", m.try_cast("double") * factor))
    return F.when(~F.isnan(px) & (F.abs(px) <= 1e7), px)


def url_identity(url: Column) -> Column:
    """Struct of location-independent url, route and capture id: a file keeps its base name and query only, others are unchanged.

    The id is the address without its scheme, with a hyphen for each run of other characters than letters, digits, dots,
    underscores and hyphens, and without hyphens at its ends: ``cap_`` and 96 characters of it; ``cap_page`` if
    nothing is left.
    """
    file = url.startswith("file:")
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    name = F.regexp_extract(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", ""), r"([^/]*)$", 1)
    kept = F.when(file, F.concat(F.lit("file:///"), name, query)).otherwise(url)
    route = F.when(file, F.concat(F.lit("/"), name, query)).otherwise(F.concat(F.when(path == "", "/").otherwise(path), query))
    bare = F.regexp_replace(kept, "^[A-Za-z]+://", "")
    slug = F.substring(F.regexp_replace(F.regexp_replace(bare, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", ""), 1, 96)
    return F.struct(kept.alias("url"), route.alias("route"), F.concat(F.lit("cap_"), F.when(slug == "", "page").otherwise(slug)).alias("slug"))


def screenshot_ref(capture_id: Column, frame_id: Column) -> Column:
    """The logical reference of a frame's screenshot."""
    safe = lambda c: F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("unknown"))
    return F.concat(F.lit("artifact://capture/"), safe(capture_id), F.lit("/"), safe(frame_id), F.lit("/screenshot.png"))
