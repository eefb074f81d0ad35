"""Binary pages: charset detection and content decoding."""

from __future__ import annotations

import codecs
import gzip
import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Config

_META = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.I)


def detect_charset_bytes(data: bytes | None, limit: int = DEFAULT.charset_bytes) -> str | None:
    """By byte order mark, then the parity of NULs in 32 bytes, then a meta tag; None if there is nothing."""
    data = data or b""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return name
    head = data[:32]
    if len(head) >= 4:
        even, odd = head[::2].count(0), head[1::2].count(0)
        if odd >= len(head) // 4 and not even:
            return "utf-16-le"
        if even >= len(head) // 4 and not odd:
            return "utf-16-be"
    found = _META.search(data[:limit])
    return found[1].decode("ascii").lower() if found else None


def decode_page(data: bytes | None, charset: str | None = None) -> str | None:
    """Text of a page's bytes; bytes that don't fit become U+FFFD, unknown charsets count as UTF-8."""
    if data is None:
        return None
    name = charset or detect_charset_bytes(data) or "utf-8"
    try:
        codecs.lookup(name)
    except LookupError:
        name = "utf-8"
    return data.decode(name, "replace").removeprefix("﻿")


def decode_body_bytes(data: bytes | None, encoding: str | None) -> bytes | None:
    """Peel content encodings, last one first; an unknown layer or broken data leaves the bytes as they are."""
    if data is None:
        return None
    for layer in reversed([e.strip().lower() for e in (encoding or "").split(",") if e.strip()]):
        try:
            if layer in ("gzip", "x-gzip"):
                data = gzip.decompress(data)
            elif layer == "deflate":
                try:
                    data = zlib.decompress(data)
                except zlib.error:
                    data = zlib.decompress(data, -15)
            elif layer != "identity":
                return data
        except (OSError, EOFError, zlib.error):
            return data
    return data


@F.pandas_udf(T.StringType())
def _charset(data: pd.Series) -> pd.Series:
    return data.map(detect_charset_bytes)


@F.pandas_udf(T.StringType())
def _text(data: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([decode_page(d, c) for d, c in zip(data, charset, strict=True)])


@F.pandas_udf(T.BinaryType())
def _body(data: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([decode_body_bytes(d, e) for d, e in zip(data, encoding, strict=True)])


def detect_charset(data: Column) -> Column:
    return _charset(data)


def page_text(data: Column, charset: Column | None = None) -> Column:
    return _text(data, charset if charset is not None else F.lit(None).cast("string"))


def decode_body(data: Column, encoding: Column) -> Column:
    return _body(data, encoding)


def read_pages(spark: SparkSession, path: str, config: Config = DEFAULT) -> DataFrame:
    """(url, html) of binary files, each decoded by its own charset."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("url"), page_text(F.col("content")).alias("html"))
