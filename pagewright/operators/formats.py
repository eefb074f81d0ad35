"""JSON, CSV, HAR and cookie-file output as column expressions and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FormatError


def to_json(df: DataFrame, name: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row as one JSON object, nulls included."""
    return df.select(*keep, F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias(name))


def cell(c: Column, kind: T.DataType, excel_safe: bool = False) -> Column:
    """A value as a CSV cell: null is empty, booleans in lower case, lists joined by |, structs and maps as JSON."""
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StructType, T.MapType, T.ArrayType)):
        out = F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(""))), "|")
    elif isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        out = F.to_json(c)
    else:
        out = c.cast("string")
    out = F.coalesce(out, F.lit(""))
    return F.when(out.rlike(r"^[=+\-@|]"), F.concat(F.lit("'"), out)).otherwise(out) if excel_safe else out


def to_csv(df: DataFrame, delimiter: str = ",", excel_safe: bool = False, name: str = "line", fieldnames: tuple[str, ...] | None = None, header: bool = False) -> DataFrame:
    """Each row as one line; a cell is quoted only where it must be.

    ``fieldnames`` chooses and orders the columns; names that ``df`` hasn't are empty.
    ``header`` puts a line of the names first.
    """
    if len(delimiter) != 1:
        raise FormatError("a delimiter is one character")
    if fieldnames is not None:
        df = df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in fieldnames])

    def quoted(c: Column) -> Column:
        must = F.instr(c, delimiter) + F.instr(c, '"') + F.instr(c, "\n") + F.instr(c, "\r") > 0
        return F.when(must, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    lines = df.select(F.concat_ws(delimiter, *[quoted(cell(F.col(f"`{f.name}`"), f.dataType, excel_safe)) for f in df.schema]).alias(name))
    if not header:
        return lines
    names = df.sparkSession.range(1).select(F.concat_ws(delimiter, *[quoted(F.lit(c)) for c in df.columns]).alias(name))
    return names.union(lines)


def pretty(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one indented JSON object, nulls included."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false", "pretty": "true"}).alias(name))


def to_records(df: DataFrame, keys: str) -> DataFrame:
    """Rows of a map column as columns, by the union of the maps' keys in order of their names; a missing key is null."""
    names = sorted(r[0] for r in df.select(F.explode(F.map_keys(keys))).distinct().collect())
    return df.select(*[c for c in df.columns if c != keys], *[F.col(keys)[n].alias(n) for n in names])


def to_tsv(df: DataFrame, **options) -> DataFrame:
    return to_csv(df, "\t", **options)


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", excel_safe: bool = False) -> None:
    flat = df.select(*[cell(F.col(f"`{f.name}`"), f.dataType, excel_safe).alias(f.name) for f in df.schema])
    flat.write.option("header", True).option("sep", delimiter).option("escape", '"').option("emptyValue", "").csv(path)


def phase(start: Column, end: Column) -> Column:
    """Milliseconds between two marks, or -1 where one is missing or they are out of order."""
    ok = (start >= 0) & (end >= start)
    return F.when(F.coalesce(ok, F.lit(False)), F.round(end - start, 3)).otherwise(F.lit(-1.0))


def har_timings(df: DataFrame) -> DataFrame:
    """Add the phases of a request and their total: dns, connect, ssl, send, wait, receive, total.

    Needs the columns dns_start, dns_end, connect_start, connect_end, ssl_start, ssl_end,
    send_start, send_end, headers_end (ms from the request, -1 or null if absent) and
    t_request, t_response, t_finished (seconds), failed.
    """
    c = F.col
    wait0 = phase(c("send_end"), c("headers_end"))
    clock = F.coalesce((c("t_response") >= c("t_request")), F.lit(False))
    fallback = (wait0 < 0) & clock
    send0 = phase(c("send_start"), c("send_end"))
    receive = F.when(F.coalesce(c("t_finished") >= c("t_response"), F.lit(False)), F.round((c("t_finished") - c("t_response")) * 1000, 3))
    out = {
        "dns": phase(c("dns_start"), c("dns_end")), "connect": phase(c("connect_start"), c("connect_end")), "ssl": phase(c("ssl_start"), c("ssl_end")),
        "send": F.when(fallback & (send0 < 0), 0.0).otherwise(send0),
        "wait": F.when(fallback, F.round((c("t_response") - c("t_request")) * 1000, 3)).otherwise(wait0),
        "receive": receive.when(c("failed"), 0.0).otherwise(-1.0),
    }
    timed = df.withColumns(out)
    return timed.withColumn("total", F.round(sum((F.greatest(c(k), F.lit(0.0)) for k in out), F.lit(0.0)), 3))


def har_entries(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """HAR 1.2 entries as JSON, of rows with url, method, status, mime, size, started (timestamp) and the marks of har_timings."""
    t = har_timings(df)
    entry = F.struct(
        F.date_format("started", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("startedDateTime"),
        F.col("total").alias("time"),
        F.struct(F.coalesce("method", F.lit("GET")).alias("method"), "url", F.lit("http/1.1").alias("httpVersion")).alias("request"),
        F.struct(F.coalesce("status", F.lit(0)).alias("status"), F.struct(F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("mime", F.lit("application/octet-stream")).alias("mimeType")).alias("content")).alias("response"),
        F.struct(F.lit(-1.0).alias("blocked"), "dns", "connect", "send", "wait", "receive", "ssl").alias("timings"),
    )
    return t.where(F.col("url") != "").select(*keep, F.to_json(entry).alias("entry"))


def har(entries: DataFrame, by: str, title: Column, started: str = "started") -> DataFrame:
    """One HAR document per capture; ``entries`` has its key, the entry and when it started."""
    listed = entries.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(started, "entry"))), lambda x: x["entry"]), ",").alias("entries"))
    head = F.to_json(F.struct(F.lit("page_1").alias("id"), title.cast("string").alias("title")))
    return listed.select(by, F.concat(F.lit('{"log":{"version":"1.2","creator":{"name":"pagewright","version":"1"},"pages":['), head, F.lit('],"entries":['), F.col("entries"), F.lit("]}}")).alias("har"))


def read_cookies(spark, path: str) -> DataFrame:
    """Rows of cookies.txt files: seven fields by tabs; comments and other lines skipped; expiry 0 is a session (null).

    A domain after ``#HttpOnly_`` is one that scripts can't read. Values keep their quotes.
    """
    mark = "#HttpOnly_"
    lines = spark.read.text(path).select(F.rtrim(F.regexp_replace("value", r"\r$", "")).alias("line"), F.col("value").startswith(mark).alias("http_only"))
    lines = lines.select(F.regexp_replace("line", f"^{mark}", "").alias("line"), "http_only").where(~F.col("line").startswith("#"))
    parts = lines.select(F.split("line", "\t", 7).alias("p"), "http_only").where("size(p) >= 6")
    at = lambda i: F.get("p", F.lit(i))
    return parts.select(
        at(0).alias("domain"), (F.upper(at(1)) == "TRUE").alias("subdomains"), at(2).alias("path"), (F.upper(at(3)) == "TRUE").alias("secure"),
        F.nullif(at(4).try_cast("double").cast("bigint"), F.lit(0)).alias("expires"), at(5).alias("name"), F.coalesce(at(6), F.lit("")).alias("value"), "http_only",
    )


def cookie_lines(df: DataFrame) -> DataFrame:
    """cookies.txt lines of rows as ``read_cookies`` gives them."""
    yes = lambda c: F.when(F.col(c), "TRUE").otherwise("FALSE")
    domain = F.when(F.col("http_only"), F.concat(F.lit("#HttpOnly_"), "domain")).otherwise(F.col("domain")) if "http_only" in df.columns else F.col("domain")
    return df.select(F.concat_ws("\t", domain, yes("subdomains"), "path", yes("secure"), F.coalesce("expires", F.lit(0)).cast("string"), "name", "value").alias("value"))
