"""Text normalisation as column expressions (no Python UDF on the main path)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Presentation ligatures, typographic dashes and the accented letters whose
# base letter a question is compared by.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
DASHES = "−–—"
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

WHITESPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
WORD_CHAR = r"[\p{L}\p{N}_]"
JOIN_HYPHEN = f"({WORD_CHAR})[-{DASHES}]{WHITESPACE}({WORD_CHAR})"
NOT_ALNUM = r"[\W_]+"  # all but ASCII letters and digits, by the class that Java's expressions test fastest


# Characters that normalisation leaves as they are and that never join with a neighbour.
STABLE = r"\x00-\x7FÆÐ×ØÞßæð÷øþ\u2013\u2014\u2018-\u201E\u2020-\u2022\u4E00-\u9FFF"
COMPOSED = STABLE + "À-ÖÙ-Ýà-öù-ýÿ"


def _unicode_form(form: str):
    @F.pandas_udf(T.StringType())
    def normal_form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return normal_form


def _normalised(form: str, text: Column, stable: str) -> Column:
    """Only texts with other than ``stable`` characters go through Arrow; the rest are sent as nulls and kept as they are."""
    odd = text.rlike(rf"[^\x00-\x7F](?<=[^{stable}])")  # ASCII is passed over by the first, cheap class
    return F.coalesce(_unicode_form(form)(F.when(odd, text)), text)


def compatibility_form(text: Column) -> Column:
    """NFKC: the one Unicode step Spark has no built-in for."""
    return _normalised("NFKC", _expand_ligatures(text), COMPOSED)


def base_letters(text: Column) -> Column:
    """NFKD without marks. Latin-1 letters are settled natively."""
    plain = F.translate(text, ACCENTED, UNACCENTED)
    return F.regexp_replace(_normalised("NFKD", plain, STABLE), r"\p{M}+", "")


def _expand_ligatures(text: Column) -> Column:
    out = text
    for glyph, letters in LIGATURES.items():
        out = F.replace(out, F.lit(glyph), F.lit(letters))
    return out


def comparable(text: Column) -> Column:
    """Comparable form of a text that is already in compatibility form; native, so it may stand inside a lambda.

    Hyphenation across a line break is undone, every run of other characters than ASCII
    letters and digits becomes one space, and case is dropped. Quote marks need no folding
    of their own, because they end up as spaces either way.
    """
    out = F.regexp_replace(text, JOIN_HYPHEN, "$1$2")
    return F.lower(F.trim(F.regexp_replace(out, NOT_ALNUM, " ")))


def normalise_quote(text: Column) -> Column:
    """Comparable form of a page or a quote."""
    return comparable(compatibility_form(text))


def fold_question(text: Column) -> Column:
    """Accents reduced to base letters, punctuation to spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(base_letters(text), NOT_ALNUM, " ")))


def title_key(text: Column) -> Column:
    """Case- and punctuation-free title; null when nothing is left."""
    out = F.replace(F.lower(base_letters(text)), F.lit("ß"), F.lit("ss"))
    return F.nullif(F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def entity_key(text: Column) -> Column:
    """Compatibility form, whitespace collapsed, case kept: case is data for units and symbols."""
    return F.trim(F.regexp_replace(compatibility_form(text), WHITESPACE, " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def status_token(text: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(text)), r"[\s\-]+", "_")


def slugify(text: Column, limit: int = 60) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    edges = r"^-+|-+$"
    cut = F.regexp_replace(F.substring(F.regexp_replace(dashed, edges, ""), 1, limit), edges, "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("paper"))


def split_keys(text: Column, separator: str = ";") -> Column:
    """``"A; B"`` to its trimmed, non-empty parts; null gives an empty array."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), separator), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def sentences(text: Column, shortest: int = 12) -> Column:
    """Sentences of a page, in order: cut after ``.!?`` before a capital or a digit."""
    flat = F.trim(F.regexp_replace(text, WHITESPACE, " "))
    parts = F.transform(F.split(flat, r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: F.length(p) >= shortest)


def section_before(page_text: Column, sentence: Column, window: int = 400) -> Column:
    """Last heading-like line among the ``window`` characters before the sentence."""
    at = F.instr(page_text, sentence)
    start = F.greatest(F.lit(1), at - window)
    before = F.when(at > 1, F.substr(page_text, start, at - start)).otherwise(F.lit(""))
    found = F.regexp_extract_all(before, F.lit(r"(?m)^(?:\d+(?:\.\d+)*\s+)?(.{3,100})$"), F.lit(1))
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))


def field_label(path: Column) -> Column:
    """Last segment of a dotted path as a label: first letter upper, the rest lower."""
    words = F.replace(F.substring_index(path, ".", -1), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.left(words, F.lit(1))), F.lower(F.substr(words, F.lit(2))))


def drill_path(dimension: str, key: Column) -> Column:
    """Address of the rows behind a tally. Spaces are percent-encoded, not plus-encoded."""
    quoted = F.replace(F.url_encode(key), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit(f"/api/landing/drilldown?dimension={dimension}&key="), quoted)


def contains_ignore_case(text: Column, needle: str) -> Column:
    """Substring search where ``%`` and ``_`` of the needle are ordinary characters."""
    escaped = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return text.ilike(f"%{escaped}%")


def any_key_or_value_contains(row: Column, needle: str) -> Column:
    """Search over the JSON dump of a row, so key names match as well."""
    return F.contains(F.lower(F.to_json(row)), F.lit(needle.lower()))


def list_literal(text: Column) -> Column:
    """A literal list of strings as an array, or null when the cell is anything else.

    Accepts single- and double-quoted items. Cells with escapes are left alone (null), so
    the caller keeps the text as supplied.
    """
    trimmed = F.trim(text)
    item = r"""('[^'\\\\]*'|"[^"\\\\]*")"""
    whole = rf"^\[\s*({item}\s*(,\s*{item}\s*)*,?\s*)?\]$"
    found = F.regexp_extract_all(trimmed, F.lit(item), F.lit(1))
    items = F.transform(found, lambda s: F.substr(s, F.lit(2), F.length(s) - 2))
    return F.when(trimmed.rlike(whole), items)


def claim_value(text: Column) -> Column:
    """Canonical JSON of a cell: a string list where the cell is one, else the text."""
    return F.coalesce(F.to_json(list_literal(text)), json_text(text))


def json_text(text: Column) -> Column:
    """A string as a JSON string literal."""
    inner = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNotNull(), F.substr(inner, F.lit(6), F.length(inner) - 6))
