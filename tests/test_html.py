import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.errors import ParseError, SelectorError
from pagewright.functions.htmltree import parse, prettify, serialize
from pagewright.functions.jsonmine import balanced, loads
from pagewright.functions.selectors import Matcher, parse_selector
from pagewright.functions.text import decode_entities_text
from pagewright.functions.urls import parse_srcset


def pick(html, selector):
    tree = parse(html)
    return [tree.text(n) for n in Matcher(tree).select(selector)]


def test_tree_rules():
    assert serialize(parse("<p>a<p>b<div>c")) == "<p>a</p><p>b</p><div>c</div>"
    assert serialize(parse("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>")) == "<ul><li>a</li><li>b<ul><li>c</li></ul></li><li>d</li></ul>"
    assert serialize(parse("<table><tr><td>a<td>b<tr><td>c</table>")) == "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>"
    assert serialize(parse('<script>var t="</p>";</script>')) == '<script>var t="</p>";</script>'
    assert parse("<!DOCTYPE html><!doctype x>").doctype == "html"
    with pytest.raises(ParseError):
        parse(None)


def test_references():
    assert parse("&copy 2 &amp;nbsp; &#xD800; &am;").text() == "© 2 &nbsp; � &am;"
    assert parse("&copy; &copy &amplt &quot", frozenset(("amp",))).text() == "© &copy &lt &quot" and parse("&amp &amp;", False).text() == "&amp &"
    assert parse("<a href='?x=1&copy=2&amp;y'>").get(1, "href") == "?x=1&copy=2&y"
    assert decode_entities_text("&copy=2 &lt;b&gt; &EURO; &nope;") == "&copy=2 <b> € &nope;"


PAGE = "<nav id=n><ul class='a b'><li>1<li>2<li>3</ul></nav><div class=ad></div><article><h1>t</h1><p lang=en-US>x<p>y</article>"


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("nav > ul > li", ["1", "2", "3"]), ("nav li:nth-child(2n+1)", ["1", "3"]), ("li:nth-last-child(1)", ["3"]), ("li:not(:first-child)", ["2", "3"]),
        ("h1 + p", ["x"]), ("h1 ~ p", ["x", "y"]), ("ul.b.a > li:first-child", ["1"]), ("article:has(> h1) p", ["x", "y"]), ("[lang|=en]", ["x"]),
        ("div:empty", [""]), (":is(h1, p:last-child)", ["t", "y"]), ("#n li:only-child", []), ('[class~="b"] li:nth-child(-n+2)', ["1", "2"]), ("x|li, *|h1", ["t"]),
    ],
)
def test_selectors(selector, want):
    assert pick(PAGE, selector) == want


@pytest.mark.parametrize("selector", ["", " ", "a,,b", "a >", "> a", "a > > b", "p::before", "p:hover", "[a=1x!]", "li:nth-child(x)", "*a", "a,", ":not("])
def test_malformed_selectors(selector):
    with pytest.raises(SelectorError):
        parse_selector(selector)


def test_deep_and_wide():
    deep = "<div>" * 3000 + "x"
    assert len(Matcher(parse(deep)).select("div div")) == 2999
    assert len(serialize(parse(deep))) == 3000 * 11 + 1
    assert prettify(parse("<p>" + "<b>" * 200))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/ab=\"' &;!-pli\n", max_size=60))
def test_never_fails_and_settles(html):
    once = serialize(parse(html))
    assert isinstance(once, str)
    tree = parse(html)
    assert all(tree.parent[i] < i <= tree.last[tree.parent[i]] for i in range(1, len(tree)))


def test_json_and_srcset():
    assert balanced('x{"a":"}"}y', 1) == '{"a":"}"}'
    assert loads("{'a':1}") is None and loads('{"a":[1,],}') == {"a": [1]}
    assert parse_srcset("/a.png 1x, /b.png 2x") == ["/a.png", "/b.png"]
    assert parse_srcset("/crop/10,20,30/x.jpg 640w, /c.png") == ["/crop/10,20,30/x.jpg", "/c.png"] and parse_srcset("") == []
