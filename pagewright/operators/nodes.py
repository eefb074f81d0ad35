"""Nodes of pages: selecting, searching, navigating and editing, each in one parse of a page.

Every operator here is a single pass over the pages, inside their input partitions: a page
is parsed once, the whole selector or search is evaluated on its tree, and only what was
asked for leaves the task. Nothing is joined, so pages that share an id, or have none, are
never mixed up, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..config import DEFAULT, Config
from ..errors import SelectorError
from ..functions.htmltree import COMMENT, DOCUMENT, ELEMENT, TEXT, Tree, parse, serialize, sibling_numbers
from ..functions.selectors import Matcher, parse_selector
from .extract import per_page

NODES = (
    "nid int, pid int, last int, depth int, kind string, tag string, attrs map<string,string>, attr_names array<string>, data string, "
    "sib int, eidx int, ecnt int, tidx int, tcnt int, prev_e int, bare boolean"
)
PLACES = ("sib", "eidx", "ecnt", "tidx", "tcnt", "prev_e", "bare")
#: What is said of a node that a search found.
FOUND = "nid int, pid int, depth int, kind string, tag string, attrs map<string,string>, text string"


def nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", config: Config = DEFAULT) -> DataFrame:
    """One row per node: (id, nid, pid, last, depth, kind, tag, attrs, attr_names, data, places among siblings).

    Node 0 is the document; a null page has only that. Attributes keep their order in ``attr_names``.
    """

    def make(tree: Tree, _base) -> list[tuple]:
        at = sibling_numbers(tree)
        places = [at[c] for c in PLACES]
        names = [[k for k, _ in a] for a in tree.attrs]
        return list(zip(range(len(tree)), tree.parent, tree.last, tree.depth, tree.kind, tree.tag, [list(a) for a in tree.attrs], names, tree.data, *places, strict=True))

    return per_page(pages, make, T.StructType.fromDDL(NODES), id_col, html_col, None, config)


def said(tree: Tree, n: int, sep: str, strip: bool) -> tuple:
    text = tree.text(n, sep, strip) if tree.kind[n] in (ELEMENT, DOCUMENT) else tree.data[n]
    return n, tree.parent[n], tree.depth[n], tree.kind[n], tree.tag[n], list(tree.attrs[n]), text


def found_rows(pages: DataFrame, find: Callable[[Tree, Matcher], Iterable[int]], sep: str, strip: bool, id_col: str, html_col: str, config: Config) -> DataFrame:
    def make(tree: Tree, _base) -> list[tuple]:
        return [(i, *said(tree, n, sep, strip)) for i, n in enumerate(find(tree, Matcher(tree)))]

    return per_page(pages, make, T.StructType.fromDDL(f"pos int, {FOUND}"), id_col, html_col, None, config)


def select(pages: DataFrame, selector: str, *, sep: str = " ", strip: bool = True, id_col: str = "page_id", html_col: str = "html", config: Config = DEFAULT) -> DataFrame:
    """The elements that a selector selects, in document order, with the text of their subtrees; ``strip`` drops blank pieces.

    SelectorError if the selector is malformed.
    """
    parse_selector(selector)
    return found_rows(pages, lambda _, match: match.select(selector), sep, strip, id_col, html_col, config)


def matches(pages: DataFrame, selector: str, other: str, *, id_col: str = "page_id", html_col: str = "html", config: Config = DEFAULT) -> DataFrame:
    """(id, pos, nid, matches) of the selected elements: whether each is also one that ``other`` selects."""
    parse_selector(selector)
    parse_selector(other)

    def make(tree: Tree, _base) -> list[tuple]:
        match = Matcher(tree)
        return [(i, n, match.matches(n, other)) for i, n in enumerate(match.select(selector))]

    return per_page(pages, make, T.StructType.fromDDL("pos int, nid int, matches boolean"), id_col, html_col, None, config)


def fits(value: str | None, want) -> bool:
    """Whether a text is as wanted: True for any, None for absent, a pattern, a callable, a list of these, or the text itself."""
    if want is None:
        return value is None
    if isinstance(want, (list, tuple, set, frozenset)):
        return any(fits(value, w) for w in want)
    if callable(want):
        return bool(want(value))
    if value is None:
        return False
    if want is True:
        return True
    return bool(want.search(value)) if isinstance(want, re.Pattern) else value == str(want)


def wanted(tag=None, attrs: dict | None = None, string=None) -> Callable[[Tree, int], bool]:
    """A test for elements by tag, attributes and the one string that they hold."""
    tag = tag.lower() if isinstance(tag, str) else tag
    asked = [(k.lower().rstrip("_"), v) for k, v in (attrs or {}).items()]

    def attribute(tree: Tree, n: int, name: str, want) -> bool:
        have = tree.get(n, name)
        if name != "class" or have is None or want is None:
            return fits(have, want)
        return any(fits(c, want) for c in [*have.split(), have])

    def only_string(tree: Tree, n: int) -> str | None:
        while len(kids := tree.kids(n)) == 1:
            if tree.kind[kids[0]] == TEXT:
                return tree.data[kids[0]]
            n = kids[0]
        return None

    def test(tree: Tree, n: int) -> bool:
        if tree.kind[n] != ELEMENT or (tag is not None and not fits(tree.tag[n], tag)):
            return False
        return all(attribute(tree, n, k, v) for k, v in asked) and (string is None or fits(only_string(tree, n), string))

    return test


def find_all(
    pages: DataFrame, tag=None, attrs: dict | None = None, string=None, limit: int | None = None, recursive: bool = True, *, sep: str = " ", strip: bool = True,
    id_col: str = "page_id", html_col: str = "html", config: Config = DEFAULT,
) -> DataFrame:
    """Elements by tag, attributes and their one string; each a text, pattern, callable, True for any, or a list of these.

    A class is matched by each of its words and by the whole. Without ``recursive``, only
    top elements are looked at. ``limit`` keeps the first so many of each page; none of them if it isn't positive.
    """
    test = wanted(tag, attrs, string)

    def find(tree: Tree, _match) -> list[int]:
        hits = (n for n in (range(1, len(tree)) if recursive else tree.kids(0)) if test(tree, n))
        return list(hits) if limit is None else [n for n, _ in zip(hits, range(max(0, limit)), strict=False)]

    return found_rows(pages, find, sep, strip, id_col, html_col, config)


def around(tree: Tree, n: int, axis: str) -> Iterator[int]:
    """Nodes that stand in a relation to one, nearest first."""
    siblings = tree.kids(tree.parent[n]) if n else []
    walks = {
        "parents": lambda: up(tree, n),
        "children": lambda: iter(tree.kids(n)),
        "descendants": lambda: iter(range(n + 1, tree.last[n] + 1)),
        "next_elements": lambda: iter(range(n + 1, len(tree))),
        "previous_elements": lambda: iter(range(n - 1, 0, -1)),
        "next_siblings": lambda: (k for k in siblings if k > n),
        "previous_siblings": lambda: (k for k in reversed(siblings) if k < n),
    }
    return walks[axis]()


def up(tree: Tree, n: int) -> Iterator[int]:
    while (n := tree.parent[n]) > 0:
        yield n


AXES = ("parents", "children", "descendants", "next_elements", "previous_elements", "next_siblings", "previous_siblings")


def navigate(
    pages: DataFrame, selector: str, axis: str, tag=None, attrs: dict | None = None, string=None, limit: int | None = None, every_kind: bool = False, *,
    sep: str = " ", strip: bool = True, id_col: str = "page_id", html_col: str = "html", config: Config = DEFAULT,
) -> DataFrame:
    """What stands around each selected element: (id, pos of the element, step from 1, found node).

    ``axis`` is one of AXES; nodes come nearest first. They are filtered as in ``find_all``,
    and ``limit`` counts those that fit; with ``every_kind``, texts and comments count, too,
    and nothing is filtered. ``next_elements`` holds an element's own descendants, and
    ``previous_elements`` its ancestors, as both go by the order of the document.
    """
    parse_selector(selector)
    if axis not in AXES:
        raise SelectorError(f"an axis is one of {', '.join(AXES)}")
    test = (lambda tree, n: True) if every_kind else wanted(tag, attrs, string)

    def make(tree: Tree, _base) -> list[tuple]:
        out = []
        for i, n in enumerate(Matcher(tree).select(selector)):
            hits = (m for m in around(tree, n, axis) if test(tree, m))
            steps = enumerate(hits, 1) if limit is None else zip(range(1, max(0, limit) + 1), hits, strict=False)
            out += [(i, k, *said(tree, m, sep, strip)) for k, m in steps]
        return out

    return per_page(pages, make, T.StructType.fromDDL(f"pos int, step int, {FOUND}"), id_col, html_col, None, config)


class Draft:
    """A tree that can be changed: lists of children instead of numbers in document order."""

    def __init__(self, tree: Tree) -> None:
        n = len(tree)
        self.kind, self.tag, self.data = [*tree.kind], [*tree.tag], [*tree.data]
        self.attrs = [list(a) for a in tree.attrs]
        self.kids = [[*tree.kids(i)] for i in range(n)]
        self.parent = [*tree.parent]

    def add(self, kind: str, tag: str = "", attrs: Iterable = (), data: str = "") -> int:
        for column, value in ((self.kind, kind), (self.tag, tag), (self.data, data), (self.attrs, list(attrs)), (self.kids, []), (self.parent, -1)):
            column.append(value)
        return len(self.kind) - 1

    def fragment(self, html: str, config: Config) -> list[int]:
        """The top nodes of a parsed piece of HTML."""
        tree = parse(html, config.legacy_entities)
        own = [0] + [self.add(tree.kind[i], tree.tag[i], tree.attrs[i], tree.data[i]) for i in range(1, len(tree))]
        for i in range(1, len(tree)):
            self.set_children(own[i], [own[k] for k in tree.kids(i)])
        return [own[k] for k in tree.kids(0)]

    def set_children(self, n: int, kids: list[int]) -> None:
        self.kids[n] = kids
        for k in kids:
            self.parent[k] = n

    def replace(self, n: int, by: list[int]) -> None:
        """Put nodes in the place of one; without nodes, take it away."""
        p = self.parent[n]
        if p >= 0 and n in self.kids[p]:
            at = self.kids[p].index(n)
            self.set_children(p, [*self.kids[p][:at], *by, *self.kids[p][at + 1 :]])
            if n not in by:
                self.parent[n] = -1

    def tree(self) -> Tree:
        """The tree as it is now, numbered anew."""
        out, todo = Tree(), [(k, 0) for k in reversed(self.kids[0])]
        while todo:
            i, parent = todo.pop()
            n = out.add(self.kind[i], self.tag[i], tuple(self.attrs[i]), self.data[i], parent)
            todo.extend((k, n) for k in reversed(self.kids[i]))
        for n in range(len(out) - 1, 0, -1):
            out.last[out.parent[n]] = max(out.last[out.parent[n]], out.last[n])
        return out


#: An edit's name, and what it needs besides the selector.
EDITS = {
    "remove": 0, "clear": 0, "unwrap": 0, "rename": 1, "set": 2, "unset": 1, "text": 1, "replace": 1, "wrap": 1, "append": 1, "prepend": 1, "before": 1, "after": 1,
}


def change(draft: Draft, n: int, name: str, args: tuple, config: Config) -> None:
    """Do one edit at one element."""
    if name in ("remove", "clear", "unwrap", "text"):
        if name in ("clear", "text"):
            draft.set_children(n, [draft.add(TEXT, data=args[0])] if name == "text" and args[0] else [])
        else:
            draft.replace(n, [] if name == "remove" else draft.kids[n])
    elif name == "rename":
        draft.tag[n] = args[0].lower()
    elif name in ("set", "unset"):
        key = args[0].lower()
        kept = [(k, args[1] if k == key and name == "set" else v) for k, v in draft.attrs[n] if name == "set" or k != key]
        draft.attrs[n] = kept if name == "unset" or any(k == key for k, _ in kept) else [*kept, (key, args[1])]
    else:
        made = draft.fragment(args[0], config)
        if name == "wrap":
            if made and draft.kind[made[0]] == ELEMENT:
                draft.replace(n, made[:1])
                draft.set_children(made[0], [*draft.kids[made[0]], n])
        elif name == "replace":
            draft.replace(n, made)
        elif name in ("append", "prepend"):
            draft.set_children(n, [*draft.kids[n], *made] if name == "append" else [*made, *draft.kids[n]])
        else:
            draft.replace(n, [*made, n] if name == "before" else [n, *made])


def edited(tree: Tree, steps: list[tuple], config: Config = DEFAULT) -> Tree:
    for name, selector, *args in steps:
        found = Matcher(tree).select(selector)
        draft = Draft(tree)
        for n in found:
            if draft.parent[n] >= 0:  # an earlier edit may have taken it away
                change(draft, n, name, tuple(args), config)
        tree = draft.tree()
    return tree


def edit(pages: DataFrame, steps: list[tuple], *, id_col: str = "page_id", html_col: str = "html", config: Config = DEFAULT) -> DataFrame:
    """Pages after edits: (id, html compact, text, n_elements).

    A step is (name, selector, what the edit needs), see EDITS: tags for ``rename``, an
    attribute and its value for ``set``, HTML for those that put something in. Each step
    sees what the one before left. SelectorError for an unknown edit or a malformed selector.
    """
    for name, selector, *args in steps:
        parse_selector(selector)
        if EDITS.get(name) != len(args):
            raise SelectorError(f"no edit {name!r} with {len(args)} arguments")

    def make(tree: Tree, _base) -> list[tuple]:
        out = edited(tree, steps, config)
        return [(serialize(out), out.text(), sum(k == ELEMENT for k in out.kind))]

    return per_page(pages, make, T.StructType.fromDDL("html string, text string, n_elements int"), id_col, html_col, None, config)


def without(pages: DataFrame, selector: str, **options) -> DataFrame:
    """Pages without the selected subtrees, as ``edit`` gives them."""
    return edit(pages, [("remove", selector)], **options)


def unwrap(pages: DataFrame, selector: str, **options) -> DataFrame:
    """Pages whose selected elements gave way to their children."""
    return edit(pages, [("unwrap", selector)], **options)


def strings(pages: DataFrame, selector: str | None = None, *, kinds: tuple[str, ...] = (TEXT,), strip: bool = False, id_col: str = "page_id", html_col: str = "html", config: Config = DEFAULT) -> DataFrame:
    """(id, pos, kind, string) of the texts, and comments if asked for, of a page or of its selected elements; ``strip`` drops blank ones."""
    if selector:
        parse_selector(selector)
    if set(kinds) - {TEXT, COMMENT}:
        raise SelectorError("strings are of texts or comments")

    def make(tree: Tree, _base) -> list[tuple]:
        scopes = Matcher(tree).select(selector) if selector else [0]
        found = [(tree.kind[i], tree.data[i].strip() if strip else tree.data[i]) for n in scopes for i in range(n, tree.last[n] + 1) if tree.kind[i] in kinds]
        return [(i, *f) for i, f in enumerate(f for f in found if f[1] or not strip)]

    return per_page(pages, make, T.StructType.fromDDL("pos int, kind string, string string"), id_col, html_col, None, config)
