"""What requests are made of, as column expressions: addresses, delays, bodies, cookies, previews. Nothing here opens a connection."""

from __future__ import annotations

import json
from urllib.parse import quote, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FormatError
from .urls import absolutize, parts

#: Characters of an address that stay as they are: reserved ones, and the sign of what is already quoted.
KEPT = "!#$%&'()*+,/:;=?@[]~"


def merge_params(url: Column, params: dict) -> Column:
    """The URL with query pairs appended, before a fragment; pairs that are there stay, lists repeat their name."""
    added = urlencode(params, doseq=True)
    if not added:
        return url
    head, fragment = F.substring_index(url, "#", 1), F.regexp_extract(url, "#.*$", 0)
    joint = F.when(~head.contains("?"), "?").when(head.rlike(r"[?&]$"), "").otherwise("&")
    return F.concat(head, joint, F.lit(added), fragment)


def requoted(url: str | None) -> str | None:
    """An address in ASCII: the host by IDNA, all else percent-quoted where it must be."""
    if url is None:
        return None
    try:
        p = urlsplit(url)
        user, at, host = p.netloc.rpartition("@")
        name, colon, port = host.partition(":") if not host.startswith("[") else (host, "", "")
        netloc = quote(user, safe=KEPT) + at + (name if name.isascii() else name.encode("idna").decode()) + colon + port
        return urlunsplit((p.scheme, netloc, quote(p.path, safe=KEPT), quote(p.query, safe=KEPT), quote(p.fragment, safe=KEPT)))
    except (ValueError, UnicodeError):
        return quote(url, safe=KEPT)


@F.pandas_udf(T.StringType())
def _requoted(url: pd.Series) -> pd.Series:
    return url.map(requoted)


def requote(url: Column) -> Column:
    """The URL in ASCII; one that has nothing to quote stays in the JVM."""
    return F.when(url.rlike(r"^[A-Za-z0-9!#$%&'()*+,/:;=?@\[\]~._-]*$"), url).otherwise(_requoted(url))


def resolve_url(url: Column, base: str | None = None) -> Column:
    """An http or https address, against a base if there is one; null for any other scheme or without a host."""
    full = absolutize(url, F.lit(base)) if base else F.trim(url)
    p = parts(full)
    return F.when(F.lower(p["scheme"]).isin("http", "https") & (p["host"] != ""), full)


def retry_delay(attempt: Column, base: float = 0.5, cap: float = 30.0, draw: Column | None = None) -> Column:
    """Seconds to wait before a retry (the first is 0): doubling to a cap, half of it drawn (``draw`` in 0 to 1)."""
    whole = F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(attempt, F.lit(60))))
    return whole / 2 + whole / 2 * (F.rand() if draw is None else draw)


def encode_body(json_value=None, form: dict | None = None, data: bytes | str | None = None) -> tuple[bytes | None, str | None]:
    """(bytes, content type) of a request's body, given as one of JSON, form pairs, or text or bytes."""
    if sum(x is not None for x in (json_value, form, data)) > 1:
        raise FormatError("a body is given in one form")
    if json_value is not None:
        return json.dumps(json_value, ensure_ascii=False).encode(), "application/json"
    if form is not None:
        return urlencode(form, doseq=True).encode(), "application/x-www-form-urlencoded"
    if isinstance(data, str):
        return data.encode(), "text/plain; charset=utf-8"
    return data, None


def ok(status: Column) -> Column:
    """Whether a status is one of success or redirection."""
    return F.coalesce(status.between(200, 399), F.lit(False))


def preview(c: Column, kind: T.DataType, most: int = 200) -> Column:
    """A value as JSON, or a text as it is, cut to so many characters."""
    said = c if isinstance(kind, T.StringType) else F.to_json(c) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else c.cast("string")
    return F.when(F.length(said) > most, F.concat(F.substring(said, 1, most), F.lit("…"))).otherwise(said)


def cookies_for(requests: DataFrame, cookies: DataFrame, url_col: str = "url", now: Column | None = None) -> DataFrame:
    """Each request with the cookies that go with it: ``cookie`` as a header's value, longest path first, then by name.

    ``cookies`` has the columns of ``formats.read_cookies``. A cookie goes with its domain,
    with subdomains if it says so, with paths below its own, with https if it is secure,
    and while it hasn't expired. It is joined on the domain that a request's host ends
    with, an equality for each of its suffixes, so that hosts never meet all cookies.
    Requests must differ; rows that are equal are one.
    """
    p = parts(F.col(url_col))
    host = F.lower(F.regexp_replace(p["host"], r":\d+$", ""))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = requests.select(F.struct(*requests.columns).alias("r"), host.alias("host"), F.when(p["path"] == "", "/").otherwise(p["path"]).alias("p"), (F.lower(p["scheme"]) == "https").alias("safe"), F.explode(suffixes).alias("suffix"))
    live = cookies.where(F.col("expires").isNull() | (F.col("expires") > (F.unix_timestamp() if now is None else now)))
    given = live.select(F.regexp_replace(F.lower("domain"), r"^\.", "").alias("suffix"), "subdomains", F.col("path").alias("cp"), "secure", "name", "value")
    below = (F.col("p") == F.col("cp")) | (F.col("p").startswith(F.concat(F.regexp_replace("cp", "/$", ""), F.lit("/"))))
    fit = ((F.col("host") == F.col("suffix")) | F.col("subdomains")) & below & (~F.col("secure") | F.col("safe"))
    met = asked.join(given, "suffix").where(fit).groupBy("r").agg(F.sort_array(F.collect_set(F.struct((-F.length("cp")).alias("k"), "name", "value"))).alias("c"))
    header = F.array_join(F.transform("c", lambda x: F.concat(x["name"], F.lit("="), x["value"])), "; ")
    return met.select("r.*", header.alias("cookie"))
