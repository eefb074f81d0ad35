"""Extraction: one parse of each page, all fields at once, typed results and no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Config
from ..errors import ExtractError
from ..functions import jsonmine
from ..functions.htmltree import ELEMENT, Tree, parse, prettify, prettify_lines, serialize
from ..functions.selectors import Matcher, parse_selector
from ..functions.text import clean_plain
from ..functions.urls import absolutize_text, page_urls

S = T.StringType()


def per_page(pages: DataFrame, make: Callable[[Tree, str | None], list[tuple]], fields: T.StructType, id_col: str, html_col: str, url_col: str | None, config: Config, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``make(tree, url)`` for each page, with the page's id and the columns to ``keep``. A null page is an empty one."""
    url = F.col(url_col) if url_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col), F.col(html_col).alias("a page"), url.alias("its url"), *keep)
    schema = T.StructType([rows.schema[id_col], *fields, *(rows.schema[c] for c in keep)])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            ids, out = [], []
            for i, (html, base) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                found = make(parse(html or "", config.legacy_entities), base)
                out += found
                ids += [i] * len(found)
            of_page = pa.array(ids, pa.int64())
            columns = [batch.column(0).take(of_page)]
            columns += [pa.array([row[k] for row in out], f.type) for k, f in enumerate(list(arrow)[1 : 1 + len(fields)])]
            columns += [batch.column(3 + k).take(of_page) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.mapInArrow(run, schema)


def _op(fields: str):
    """Make an operator of a function (tree, base, **options) to rows."""

    def wrap(make):
        def operator(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url", config: Config = DEFAULT, keep: tuple[str, ...] = (), **options) -> DataFrame:
            return per_page(pages, lambda tree, base: make(tree, base, config=config, **options), T.StructType.fromDDL(fields), id_col, html_col, url_col, config, keep)

        operator.__doc__ = make.__doc__
        operator.__name__ = make.__name__
        return operator

    return wrap


def spoken(tree: Tree, n: int) -> str:
    return clean_plain(tree.text(n, " ", True))


@_op("pos int, text string, href string")
def links(tree, base, config, selector="a[href]", absolute=False):
    """Text and target of each link, in document order."""
    found = Matcher(tree).select(selector)
    href = lambda n: absolutize_text(tree.get(n, "href"), base) if absolute else tree.get(n, "href")
    return [(i, spoken(tree, n), href(n)) for i, n in enumerate(found)]


@_op("pos int, items array<string>")
def lists(tree, base, config, selector="ul, ol", item="li"):
    """Texts of the items of each list; items of nested lists count in both; empty ones drop."""
    match = Matcher(tree)
    return [(i, [t for t in (spoken(tree, m) for m in match.select(item, n)) if t]) for i, n in enumerate(match.select(selector))]


@_op("title string, canonical string, meta map<string,string>")
def meta(tree, base, config):
    """Title, canonical link, and all meta names (last one wins)."""
    match = Matcher(tree)
    title = next((clean_plain(tree.text(n)) for n in match.select("title")), "")
    said = {}
    for n in match.select("meta"):
        name = tree.get(n, "name") or tree.get(n, "property") or tree.get(n, "http-equiv")
        if name:
            said[name.lower()] = clean_plain(tree.get(n, "content") or "")
    return [(title, next((tree.get(n, "href") for n in match.select("link[rel=canonical]")), None), said)]


def grid(tree: Tree, table: int, most: int = DEFAULT.max_span) -> list[list[str]]:
    """Cell texts with colspans repeated and rowspans carried down; rows of nested tables left out."""
    match = Matcher(tree)
    own = lambda n: next(p for p in _up(tree, n) if tree.tag[p] == "table") == table
    rows, carry = [], {}
    for r in (n for n in match.select("tr", table) if own(n)):
        row: list[str] = []

        def pending(row=row) -> None:
            while carry.get(len(row), (0, ""))[0] > 0:
                left, text = carry[len(row)]
                carry[len(row)] = (left - 1, text)
                row.append(text)

        for c in tree.kids(r):
            if tree.kind[c] != ELEMENT or tree.tag[c] not in ("td", "th"):
                continue
            pending()
            text = spoken(tree, c)
            for _ in range(_span(tree.get(c, "colspan"), most)):
                if (down := _span(tree.get(c, "rowspan"), most)) > 1:
                    carry[len(row)] = (down - 1, text)
                row.append(text)
        pending()
        rows.append(row)
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def _up(tree: Tree, n: int):
    while (n := tree.parent[n]) > 0:
        yield n


def _span(value: str | None, most: int) -> int:
    """A span; ``most`` only keeps a hostile page from filling a task's memory."""
    try:
        return min(most, max(1, int(value or 1)))
    except ValueError:
        return 1


@_op("table_no int, row_no int, headers array<string>, cells array<string>, record map<string,string>")
def tables(tree, base, config, selector="table", header_row=0):
    """Records of each table: headers from one row; blank ones become col_i, repeated ones get a suffix; blank rows drop."""
    out = []
    for k, n in enumerate(Matcher(tree).select(selector)):
        rows = grid(tree, n, config.max_span)
        if len(rows) <= header_row:
            continue
        names: list[str] = []
        for i, h in enumerate(rows[header_row]):
            name, j = h or f"col_{i}", 0
            while name in names:
                j += 1
                name = f"{h or f'col_{i}'}_{j}"
            names.append(name)
        body = [r for i, r in enumerate(rows) if i != header_row and any(r)]
        out += [(k, i, names, r, dict(zip(names, r, strict=True))) for i, r in enumerate(body)]
    return out


@_op("rank int, source string, url string")
def find_urls(tree, base, config):
    """URLs of a page from all sources, absolute, each once."""
    return [(i, s, u) for i, (s, u) in enumerate(page_urls(tree, base, config))]


@_op("pos int, source string, json string")
def embedded_json(tree, base, config):
    """JSON values inside a page's scripts."""
    return [(i, s, j) for i, (s, j) in enumerate(jsonmine.embedded_json(tree, config))]


@_op("pos int, url string")
def api_candidates(tree, base, config, templates=False):
    """URLs that scripts call or configure."""
    return [(i, u) for i, u in enumerate(jsonmine.api_candidates(tree, base, config, templates))]


@_op("url string, evidence string, points int")
def endpoint_evidence(tree, base, config):
    """Evidence for a page's API endpoints."""
    return jsonmine.evidence(tree, base, lambda u: jsonmine.classify_text(u, config), config)


def discover_endpoints(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """(id, url, score, evidence): the points of distinct evidence, summed; rank by score, then URL."""
    found = endpoint_evidence(pages, id_col=id_col, **options)
    return found.groupBy(id_col, "url").agg(F.sum("points").cast("int").alias("score"), F.sort_array(F.collect_set("evidence")).alias("evidence"))


@_op("is_shell boolean, n_links int, n_scripts int")
def js_shell(tree, base, config):
    """Whether a page looks like an empty shell that scripts fill."""
    match = Matcher(tree)
    a, s = len(match.select("a[href]")), len(match.select("script"))
    return [(bool(config.shell_links and config.shell_scripts and a <= config.shell_links and s >= config.shell_scripts), a, s)]


@_op("pretty string, compact string")
def serialized(tree, base, config, selector=None):
    """Indented and compact HTML of the page, or of each selected element."""
    return [(prettify(tree, n), serialize(tree, n)) for n in (Matcher(tree).select(selector) if selector else [0])]


@_op("pretty string")
def prettified(tree, base, config):
    """HTML with each node on a line, one space a level, attributes by name; as the common soup libraries print it."""
    return [(prettify_lines(tree),)]


@_op("head string, body string, title string, title_source string")
def head_and_body(tree, base, config):
    """Compact HTML of the first head and body, null where there is none; the stripped text of the first title, and that as the page has it, with its references."""
    match = Matcher(tree)
    first = lambda tag: next(iter(match.select(tag)), None)
    html = lambda n: None if n is None else serialize(tree, n)
    title = first("title")
    return [(html(first("head")), html(first("body")), None if title is None else tree.text(title).strip(), None if title is None else tree.source.get(title + 1, ""))]


def counts(pages: DataFrame, selectors: Mapping[str, str], *, id_col: str = "page_id", html_col: str = "html", config: Config = DEFAULT) -> DataFrame:
    """A row per page with how many elements each selector selects, all in one parse."""
    for s in selectors.values():
        parse_selector(s)

    def make(tree: Tree, _base) -> list[tuple]:
        match = Matcher(tree)
        return [tuple(len(match.select(s)) for s in selectors.values())]

    fields = T.StructType([T.StructField(name, T.LongType()) for name in selectors])
    return per_page(pages, make, fields, id_col, html_col, None, config)


@_op("pos int, text string")
def values(tree, base, config, selector, attr=None):
    """Cleaned texts, or an attribute, of the selected elements."""
    found = Matcher(tree).select(selector)
    return [(i, clean_plain(tree.get(n, attr) or "") if attr else spoken(tree, n)) for i, n in enumerate(found)]


def schema_type(spec: Any) -> T.DataType:
    """The result type of a field spec, or ExtractError."""
    if spec is None or isinstance(spec, str):
        if isinstance(spec, str):
            parse_selector(spec)
        return S
    if not isinstance(spec, Mapping):
        raise ExtractError(f"a field must be a selector or a mapping, not {type(spec).__name__}")
    for key in ("css", "select"):
        if spec.get(key):
            parse_selector(spec[key])
    if "each" in spec:
        return T.ArrayType(schema_struct(spec["each"]))
    if "fields" in spec:
        return schema_struct(spec["fields"])
    if spec.get("urls") or spec.get("type") == "urls" or spec.get("all"):
        return T.ArrayType(S)
    if not isinstance(spec.get("default", ""), (str, type(None))):
        raise ExtractError("a default must be text")
    return S


def schema_struct(schema: Any) -> T.StructType:
    if not isinstance(schema, Mapping) or not schema:
        raise ExtractError("a schema must be a mapping that isn't empty")
    return T.StructType([T.StructField(k, schema_type(v)) for k, v in schema.items()])


def field_value(tree: Tree, match: Matcher, n: int, base: str | None, spec: Any, config: Config, clean: str = "plain") -> Any:
    """A field's value; ``clean`` is what the specs around it ask for, unless it asks for something itself."""
    if spec is None:
        return None
    if isinstance(spec, str):
        spec = {"css": spec}
    css, clean = spec.get("select") or spec.get("css"), spec.get("clean", clean)
    if "each" in spec:
        return [record(tree, match, m, base, spec["each"], config, clean) for m in match.select(css, n)]
    if "fields" in spec:
        scope = next(iter(match.select(css, n)), None) if css else n
        return record(tree, match, scope if scope is not None else n, base, spec["fields"], config, clean)
    if spec.get("urls") or spec.get("type") == "urls":
        return [u for _, u in page_urls(tree, base, config)]
    found = match.select(css, n) if css else [n]
    if spec.get("all"):
        return [element_value(tree, m, base, spec, clean) for m in found]
    return element_value(tree, found[0], base, spec, clean) if found else spec.get("default") or ""


def element_value(tree: Tree, n: int, base: str | None, spec: Mapping, clean: str) -> str:
    names = spec.get("attr")
    if names:
        names = [names] if isinstance(names, str) else names
        value = next((v for v in (tree.get(n, a.lower()) for a in names) if v and v.strip()), "")
    else:
        value = tree.text(n)
    if spec.get("abs") or clean == "url":
        return absolutize_text(value, base)
    return value if clean in ("none", "raw") else clean_plain(value)


def record(tree: Tree, match: Matcher, n: int, base: str | None, schema: Mapping, config: Config, clean: str = "plain") -> dict:
    return {k: field_value(tree, match, n, base, v, config, clean) for k, v in schema.items()}


def extract(pages: DataFrame, schema: Mapping, *, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url", config: Config = DEFAULT) -> DataFrame:
    """One typed row per page by a declarative schema (field to selector, or mapping with css/select, attr, all, each, fields, abs, clean, default)."""
    struct = schema_struct(schema)

    def make(tree: Tree, base: str | None) -> list[tuple]:
        return [tuple(record(tree, Matcher(tree), 0, base, schema, config).values())]

    return per_page(pages, make, struct, id_col, html_col, url_col, config)


def records(pages: DataFrame, item: str, schema: Mapping, **options) -> DataFrame:
    """One row per selected item of a page."""
    found = extract(pages, {"items": {"select": item, "each": schema}}, **options)
    id_col = options.get("id_col", "page_id")
    return found.select(id_col, F.posexplode("items").alias("pos", "item")).select(id_col, "pos", "item.*")
