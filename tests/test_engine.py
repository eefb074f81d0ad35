import csv
import time
import gzip
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from pagewright.errors import ExtractError, SelectorError
from pagewright.functions import text, urls
from pagewright.operators import extract, formats, nodes
from pagewright.plans import catalog
from pagewright.sources.bytes import decode_body_bytes, decode_page, detect_charset_bytes
from pagewright.streaming import pages as streams

DATA = "/root/testdata/sf0.001"


def rows(df, columns):
    flat = lambda v: tuple(map(flat, v)) if isinstance(v, (list, tuple)) else round(v, 6) if isinstance(v, float) else str(v)
    return sorted(flat(tuple(r)) for r in df.select(*columns).collect())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(DATA):
        db.execute(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    got = catalog.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    flat = lambda v: tuple(map(flat, v)) if isinstance(v, (list, tuple)) else round(v, 6) if isinstance(v, float) else str(v)
    want = sorted(flat(r) for r in db.execute(f"select {', '.join(columns)} from ({catalog.oracle_sql()[name]})").fetchall())
    assert rows(got, columns) == want


@pytest.mark.parametrize("name", ["boilerplate_removed", "h1", "head_and_body", "title"])
def test_cut_references_against_sql(spark, tmp_path, name):
    """References cut at any character, as where a title ends."""
    whole = ["&amp;", "&quot;", "&copy;", "&middot;"]
    said = [f"a b {r[:n]}" for r in whole for n in range(1, len(r) + 1)] + [f"a {r} b &{r[:3]}" for r in whole] + ["a b", "&amplt a&amp&quot"]
    page = "<html><head><title>{0}</title></head><body><nav><ul><li>x</li></ul></nav><h1>{0}</h1><p>Next</p><footer>z</footer></body></html>"
    spark.createDataFrame([(i, page.format(t)) for i, t in enumerate(said)], "page_id long, html string").selectExpr("*", "'https://h.org/' as url").write.parquet(str(tmp_path / "pages.parquet"))
    got = catalog.queries()[name](spark, str(tmp_path))
    pages = f"(select * from '{tmp_path}/pages.parquet/*.parquet')"
    want = duckdb.connect().execute(f"with pages as {pages} select {', '.join(sorted(got.columns))} from ({catalog.oracle_sql()[name]})").fetchall()
    assert rows(got, sorted(got.columns)) == sorted(tuple(map(str, r)) for r in want)


def test_pages_of_repeated_and_null_ids(spark):
    """Pages that share an id, or have none, are never mixed up."""
    rows = [(1, "<div></div><b><p>x</p></b>"), (1, "<p>y</p><div></div>"), (None, "<div><p>z</p></div>"), (2, None), (3, "")]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    found = lambda s: [(r.page_id, r.text) for r in nodes.select(pages, s).collect()]
    assert found("div > p") == [(None, "z")] and found("div p, b p") == [(1, "x"), (None, "z")]
    assert nodes.select(pages.limit(0), "p").count() == 0
    plan = nodes.without(pages, "nav, p")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    with pytest.raises(SelectorError):
        nodes.select(pages, "a >")
    with pytest.raises(SelectorError):
        nodes.edit(pages, [("rename", "p")])


def test_navigation_and_edits(spark):
    html = "<div><p class=a>1<p>2</div><!-- c --><ul><li>x<li><b>y</b></ul>t"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    step = lambda s, axis, **o: [(r.step, r.tag or r.kind) for r in nodes.navigate(pages, s, axis, **o).collect()]
    assert step("b", "parents") == [(1, "li"), (2, "ul")] and step("ul", "previous_siblings", every_kind=True) == [(1, "comment"), (2, "div")]
    assert step("p.a", "next_elements", limit=2) == [(1, "p"), (2, "ul")] and step("b", "previous_elements", tag=["p", "ul"]) == [(1, "ul"), (2, "p"), (3, "p")]
    assert step("ul", "next_siblings", every_kind=True) == [(1, "text")] and step("ul", "children") == [(1, "li"), (2, "li")]
    edit = lambda *steps: nodes.edit(pages, list(steps)).first().html
    assert edit(("remove", "div"), ("unwrap", "li")) == "<!-- c --><ul>x<b>y</b></ul>t"
    assert edit(("replace", "ul", "<i>1</i><i>2</i>"), ("wrap", "i", "<u>"), ("after", "p.a", "<hr>")) == '<div><p class="a">1</p><hr><p>2</p></div><!-- c --><u><i>1</i></u><u><i>2</i></u>t'
    assert edit(("remove", "div, p"), ("clear", "ul"), ("prepend", "ul", "<li>n"), ("text", "li", "a<b")) == "<!-- c --><ul><li>a&lt;b</li></ul>t"
    assert [r.string for r in nodes.strings(pages, kinds=("comment",)).collect()] == [" c "]


def test_cost_is_linear_in_depth_and_width():
    """Work on deep and wide pages, within the time that a pass over them takes."""
    from pagewright.functions.htmltree import parse, serialize
    from pagewright.functions.selectors import Matcher

    def took(work):
        start = time.time()
        work()
        return time.time() - start

    deep = parse("<div>" * 3000 + "x")
    assert took(lambda: parse("<div>" * 3000)) < 0.4 and took(lambda: serialize(deep)) < 0.1
    assert took(lambda: Matcher(deep).select("div div div")) < 0.25 and len(Matcher(deep).select("div div div")) == 2998
    assert took(lambda: Matcher(parse("<b>" + "<div>" * 2000)).select("b div div div")) < 0.5
    assert took(lambda: Matcher(parse("<div>" * 400 + "<b>")).select("div:has(div div b)")) < 0.5
    wide = parse("<ul>" + "<li>x" * 3000)
    assert took(lambda: Matcher(wide).select("li:nth-child(2n+1)")) < 0.5


def test_blobs_that_start_alike_all_stay():
    from pagewright.functions.htmltree import parse
    from pagewright.functions.jsonmine import embedded_json

    same = '"k": "' + "x" * 600 + '"'
    html = "".join(f"<script type=application/json>{{{same}, \"n\": {i}}}</script>" for i in range(3))
    assert len(embedded_json(parse(html))) == 3


def test_written_csv_and_cookies(spark, tmp_path):
    rows = [('a"b,c', 1), ("x\ny", 2)]
    formats.write_csv(spark.createDataFrame(rows, "t string, n int").coalesce(1), str(tmp_path / "c"))
    with open(next((tmp_path / "c").glob("part-*")), newline="") as file:
        assert list(csv.reader(file)) == [["t", "n"], ['a"b,c', "1"], ["x\ny", "2"]]
    (tmp_path / "k.txt").write_text('# comment\n#HttpOnly_.h.org\tTRUE\t/\tFALSE\t0\ts\t"q\nh.org\tFALSE\t/a\tTRUE\t99\tn\t\nnonsense\n')
    got = [tuple(r) for r in formats.read_cookies(spark, str(tmp_path / "k.txt")).collect()]
    assert got == [(".h.org", True, "/", False, None, "s", '"q', True), ("h.org", False, "/a", True, 99, "n", "", False)]


def test_edges(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "", "u"), (None, "<a href=x>l</a>", "https://h.org/d/")], "page_id long, html string, url string")
    assert [tuple(r) for r in extract.links(pages, absolute=True).collect()] == [(None, 0, "l", "https://h.org/d/x")]
    assert extract.links(pages.limit(0)).count() == 0
    with pytest.raises(ExtractError):
        extract.extract(pages, {"a": 3})


def test_urls(spark):
    cases = [("https://h.org/a/b.html", "page"), ("https://api.h.org/x", "api"), ("/a.png?x", "media"), ("/a.css", "asset"), ("mailto:x", "other"), ("/x?format=json", "api"), ("/a.xyz", "other"), (None, "other")]
    df = spark.createDataFrame(cases, "u string, want string")
    assert df.where(urls.classify_url(F.col("u")) != F.col("want")).count() == 0
    pairs = [("x", "https://h.org/a/b", "https://h.org/a/x"), ("../y", "https://h.org/a/b/c", "https://h.org/a/y"), ("#f", "https://h.org/", "#f"), ("/z", "https://h.org/a", "https://h.org/z"), ("/a/../b", "https://h.org/", "https://h.org/b"), ("//o.org/", "https://h.org/", "https://o.org/"), ("?q", "https://h.org/a", "https://h.org/a?q")]
    df = spark.createDataFrame(pairs, "h string, b string, want string")
    assert df.where(urls.absolutize(F.col("h"), F.col("b")) != F.col("want")).count() == 0
    hosts = spark.createDataFrame([("https://a.h.org/x",), ("https://o.org/",), ("/r",)], "u string")
    assert hosts.where(urls.filter_urls(F.col("u"), same_host="https://h.org/")).count() == 2


def test_text(spark):
    df = spark.createDataFrame([(" a  b­​ c\n\n\n\nd &amp; ",), (None,)], "t string")
    assert df.select(text.clean_text(F.col("t"))).first()[0] == "a b c d &"
    assert df.select(text.clean_text(F.col("t"), "keep_newlines")).first()[0] == "a b c\n\nd &"
    nested = spark.createDataFrame([([" x "], {"k": " y "})], "a array<string>, m map<string,string>")
    pipe = text.CleanPipeline.recipe("plain")
    assert [r for r in nested.select(*[pipe.apply(F.col(f.name), f.dataType) for f in nested.schema]).first()] == [["x"], {"k": "y"}]


def test_formats(spark):
    df = spark.createDataFrame([("=1", True, None)], "a string, b boolean, c string")
    assert formats.to_csv(df, excel_safe=True).first()[0] == "'=1,true,"
    entry = df.select(
        F.lit("https://x").alias("url"), F.lit("GET").alias("method"), F.lit(200).alias("status"), F.lit("t").alias("mime"), F.lit(3).alias("size"), F.lit("2020-01-01").cast("timestamp").alias("started"),
        *[F.lit(-1.0).alias(f"{p}_{e}") for p in ("dns", "connect", "ssl", "send") for e in ("start", "end")], F.lit(-1.0).alias("headers_end"),
        F.lit(1.0).alias("t_request"), F.lit(1.5).alias("t_response"), F.lit(1.75).alias("t_finished"), F.lit(False).alias("failed"),
    )
    assert '"time":750.0' in formats.har_entries(entry).first()[0]


def test_bytes():
    assert detect_charset_bytes(b"\xef\xbb\xbfx") == "utf-8" and detect_charset_bytes("abcd".encode("utf-16-le")) == "utf-16-le"
    assert decode_page('<meta charset="latin-1">é'.encode("latin-1")).endswith("é")
    assert decode_body_bytes(gzip.compress(b"x"), "gzip") == b"x" and decode_body_bytes(b"x", "zstd, gzip") == b"x"


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "<a href=/x>l</a>", "https://h.org/")], "page_id long, html string, url string").write.parquet(str(tmp_path / "in"))
    seen = []
    stream = streams.link_stream(streams.page_stream(spark, str(tmp_path / "in")))
    streams.to_sink(stream, lambda df, _: seen.extend(df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert [r.href for r in seen] == ["/x"]
