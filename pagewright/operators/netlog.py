"""Network logs: events of a request folded into one entry, and entries grouped by what they carry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config


def fold(events: DataFrame, keys: tuple[str, ...], kind: str = "event_type", at: str = "ts") -> DataFrame:
    """One row per request: when each kind of event came first and last, and how many there were.

    A plain aggregation with partial results before the shuffle, so that a request with
    very many events costs no more than another.
    """
    return events.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def entries(events: DataFrame, key: str = "request_id") -> DataFrame:
    """Fold request, response, finished and failed events (``kind``, ``t``, url, method, status, mime, size) to entries."""
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return events.groupBy(key).agg(
        of("request", "url").alias("url"), of("request", "method").alias("method"), of("response", "status").alias("status"),
        of("response", "mime").alias("mime"), of("finished", "size").alias("size"), of("request", "t").alias("t_request"),
        of("response", "t").alias("t_response"), of("finished", "t").alias("t_finished"),
        F.coalesce(F.max(F.col("kind") == "failed"), F.lit(False)).alias("failed"),
    )


def groups_of(config: Config = DEFAULT):
    """Those of json, media and xhr_fetch that a row with url, mime, body and resource_type is in; it may be in several.

    A row without a body counts as json.
    """
    path = F.lower(F.regexp_extract("url", r"^[^?#]*", 0))
    media = reduce(lambda a, b: a | b, [path.endswith(e) for e in sorted(config.media_exts | {".ts"})])
    body = F.substring(F.ltrim(F.coalesce("body", F.lit(""))), 1, 1)
    of = {
        "json": F.lower("mime").contains("json") | body.isin("{", "[", ""),
        "media": media,
        "xhr_fetch": F.lower("resource_type").isin("xhr", "fetch"),
    }
    return F.array_compact(F.array(*[F.when(fits, F.lit(name)) for name, fits in of.items()]))
