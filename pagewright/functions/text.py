"""Text cleaning as column expressions; only entities and normal forms need Python."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from html.entities import html5, name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Invisible characters, and the white space of the cleaning rules.
INVISIBLE = "­​‌‍‎‏⁠﻿᠎"
SPACES = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_LIKE = "               　"
MODES = ("none", "raw", "plain", "strict", "keep_newlines")
_ENTITY = re.compile(r"&(?:#[xX]([0-9a-fA-F]+)|#([0-9]+)|([A-Za-z][A-Za-z0-9]+));")


def decode_entities_text(text: str) -> str:
    """Decode entities that end in a semicolon, once; names fall back to any case, unknown ones stay."""

    def one(m: re.Match) -> str:
        if m[1] or m[2]:
            digits = m[1] or m[2]
            n = int(digits, 16 if m[1] else 10) if len(digits) < 9 else 0x110000
            return chr(n) if n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else m[0]
        code = name2codepoint.get(m[3]) or name2codepoint.get(m[3].lower())
        return chr(code) if code else html5.get(f"{m[3]};", m[0]) if m[3] in ("apos", "horbar") else m[0]

    return _ENTITY.sub(one, text) if "&" in text else text


@F.pandas_udf(T.StringType())
def _decode(s: pd.Series) -> pd.Series:
    return s.map(decode_entities_text, na_action="ignore")


def where_needed(c: Column, needs: Column, work: Callable[[Column], Column]) -> Column:
    """``work(c)`` where it is needed, else ``c``. Python gets nulls for the other rows: Spark hands all rows to it."""
    return F.when(needs, work(F.when(needs, c))).otherwise(c)


def decode_entities(c: Column) -> Column:
    """Null stays null; texts without an ampersand never reach Python."""
    return where_needed(c, c.contains("&"), _decode)


def normalize_unicode(c: Column, form: str = "NFC") -> Column:
    """A Unicode normal form; texts that are in it by their characters never reach Python."""

    @F.pandas_udf(T.StringType())
    def normal(s: pd.Series) -> pd.Series:
        import pyarrow as pa
        import pyarrow.compute as pc

        return pc.utf8_normalize(pa.array(s, pa.string(), from_pandas=True), form).to_pandas()

    # Below U+0300 nothing combines.
    return where_needed(c, c.rlike(r"[^\x{0}-\x{2ff}]" if form == "NFC" else r"[^\x{0}-\x{7f}]"), normal)


def remove_invisible(c: Column) -> Column:
    return F.translate(c, INVISIBLE, "")


def strip_noise(c: Column) -> Column:
    return F.regexp_replace(remove_invisible(c), r"[\x{200b}-\x{200f}\x{feff}]+", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACES}]+|[{SPACES}]+$", "")


def collapse_ws(c: Column, keep_newlines: bool = False) -> Column:
    """Runs of white space to one space; with ``keep_newlines``, within lines, and at most two newlines."""
    if not keep_newlines:
        return strip(F.regexp_replace(c, f"[{SPACES}]+", " "))
    c = F.translate(c, SPACE_LIKE, " " * len(SPACE_LIKE))
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"[ \t\f\x0b]+", " ")
    c = F.regexp_replace(c, "(?m)^ | $", "")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def soft_strip(c: Column) -> Column:
    return strip(F.translate(c, " ", " "))


def clean_text(c: Column, mode: str = "plain", decode: bool = True, form: str | None = "NFC") -> Column:
    """Clean a text in one of MODES; null becomes the empty text. Without a form it stays in the JVM."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    c = F.coalesce(c.cast("string"), F.lit(""))
    if mode == "none":
        return c
    c = decode_entities(c) if decode else c
    if mode == "raw":
        return c
    c = remove_invisible(c)
    c = normalize_unicode(c, form) if form else c
    if mode == "strict":
        c = F.regexp_replace(c, r"[\p{C}&&[^\t\n\r]]", "")
    return collapse_ws(c, mode == "keep_newlines")


class CleanPipeline:
    """Ordered steps (Column to Column), applied to texts at any depth of a nested column."""

    def __init__(self, *steps: Callable[[Column], Column]) -> None:
        self.steps = list(steps)

    def add(self, step: Callable[[Column], Column]) -> CleanPipeline:
        self.steps.append(step)
        return self

    def text(self, c: Column) -> Column:
        for step in self.steps:
            c = step(c)
        return c

    def apply(self, c: Column, kind: T.DataType) -> Column:
        """Clean a column of type ``kind``; other leaf types stay."""
        if isinstance(kind, T.StringType):
            return self.text(c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: self.apply(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, v: self.apply(v, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[self.apply(c[f.name], f.dataType).alias(f.name) for f in kind]))
        return c

    @classmethod
    def recipe(cls, name: str) -> CleanPipeline:
        """Recipes by the names of MODES, for decoded texts, at any depth.

        Spark allows no Python function inside a lambda over arrays and maps, so Unicode
        isn't normalised here; use ``clean_text`` on top-level columns for that.
        """
        return cls(lambda c: clean_text(c, name, decode=False, form=None))


def clean_plain(text: str) -> str:
    """The plain mode of one decoded text, for use inside Python operators."""
    text = unicodedata.normalize("NFC", text.translate(dict.fromkeys(map(ord, INVISIBLE))))
    return " ".join(text.split())
