"""CSS selectors: a strict parser and a matcher over flat trees.

A selector is a list of alternatives; each is a chain of (combinator, compound), where a
compound is a list of tests. What isn't understood raises SelectorError when the query
is planned, and never selects nothing silently.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from ..errors import SelectorError
from .htmltree import ELEMENT, Tree, sibling_numbers

_IDENT = re.compile(r"(?:[A-Za-z_\u0080-\U0010ffff]|\\[0-9a-fA-F]{1,6}\s?|\\[^\n0-9a-fA-F]|-(?=[A-Za-z_\u0080-\U0010ffff\\]))(?:[\w\u0080-\U0010ffff-]|\\[0-9a-fA-F]{1,6}\s?|\\[^\n0-9a-fA-F])*")
_NAME = re.compile(r"(?:[\w\u0080-\U0010ffff-]|\\[0-9a-fA-F]{1,6}\s?|\\[^\n0-9a-fA-F])+")
_ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})\s?|([^\n]))")
_NTH = re.compile(r"\s*(?:(odd)|(even)|([+-]?\d+)(?!\d*n)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?)\s*", re.I)
_OPERATOR = re.compile(r"\s*([~|^$*]?=)\s*")
PLACES = ("first-child", "last-child", "only-child", "first-of-type", "last-of-type", "only-of-type", "empty", "root")
NTHS = ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type")


@dataclass
class Test:
    """kind: tag, id, class, attr, place, nth, not, is, has or never."""

    kind: str
    name: str = ""
    op: str = ""
    value: str = ""
    fold: bool = False
    nth: tuple[int, int] = (0, 1)
    inner: list = field(default_factory=list)


Compound = list[Test]
Chain = list[tuple[str, Compound]]  # the first combinator is "" (or that of :has)


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            n = int(m[1], 16)
            return "�" if n == 0 or 0xD800 <= n <= 0xDFFF or n > 0x10FFFF else chr(n)
        return m[2]

    return _ESCAPE.sub(one, text)


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def fail(self, why: str) -> SelectorError:
        return SelectorError(f"{why} at {self.at} in selector {self.text!r}")

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, pattern: re.Pattern) -> re.Match | None:
        if m := pattern.match(self.text, self.at):
            self.at = m.end()
        return m

    def space(self) -> bool:
        start = self.at
        while self.peek().isspace():
            self.at += 1
        return self.at > start

    def groups(self, relative: bool = False, closing: bool = False) -> list[Chain]:
        out = []
        while True:
            out.append(self.chain(relative))
            if self.peek() == ",":
                self.at += 1
                continue
            if closing and self.peek() == ")":
                self.at += 1
                return out
            if self.at >= len(self.text) and not closing:
                return out
            raise self.fail("unexpected text")

    def chain(self, relative: bool) -> Chain:
        self.space()
        lead = ""
        if self.peek() and self.peek() in ">+~":
            if not relative:
                raise self.fail("leading combinator")
            lead = self.peek()
            self.at += 1
            self.space()
        out: Chain = [(lead or (" " if relative else ""), self.compound())]
        while True:
            gap = self.space()
            c = self.peek()
            if not c or c in ",)":
                return out
            if c in ">+~":
                self.at += 1
                self.space()
                if self.peek() in (">", "+", "~", "", ",", ")"):
                    raise self.fail("combinator without a selector")
                out.append((c, self.compound()))
            elif gap:
                out.append((" ", self.compound()))
            else:
                raise self.fail("unexpected text")

    def compound(self) -> Compound:
        out: Compound = []
        start = self.at
        if self.peek() == "|":
            self.at += 1
            if self.peek() == "*":
                self.at += 1
            elif not self.take(_IDENT):
                raise self.fail("name expected")
            out.append(Test("never"))
        elif self.peek() == "*" or _IDENT.match(self.text, self.at):
            first = "*" if self.peek() == "*" else ""
            name = first or unescape(self.take(_IDENT)[0])
            self.at += len(first)
            if first and _IDENT.match(self.text, self.at):
                raise self.fail("name after *")
            if self.peek() == "|" and self.text[self.at + 1 : self.at + 2] != "=":
                self.at += 1
                if name != "*":
                    out.append(Test("never"))
                found = self.take(_IDENT)
                if not found and self.peek() != "*":
                    raise self.fail("name expected")
                name = unescape(found[0]) if found else "*"
                self.at += not found
            if name != "*":
                out.append(Test("tag", name.lower()))
        while (c := self.peek()) and c in "#.[:":
            self.at += 1
            out.append({"#": self.id, ".": self.class_, "[": self.attribute, ":": self.pseudo}[c]())
        if self.at == start:
            raise self.fail("empty selector")
        return out

    def id(self) -> Test:
        if not (m := self.take(_NAME)):
            raise self.fail("id expected")
        return Test("id", value=unescape(m[0]))

    def class_(self) -> Test:
        if not (m := self.take(_IDENT)):
            raise self.fail("class expected")
        return Test("class", value=unescape(m[0]))

    def attribute(self) -> Test:
        self.space()
        never = False
        if self.peek() in ("*", "|") and self.peek():
            self.at += self.peek() == "*"
            if self.peek() != "|":
                raise self.fail("name expected")
            self.at += 1
        m = self.take(_IDENT)
        if m and self.peek() == "|" and self.text[self.at + 1 : self.at + 2] != "=":
            self.at += 1
            never, m = True, self.take(_IDENT)
        if not m:
            raise self.fail("attribute expected")
        test = Test("attr", unescape(m[0]).lower())
        if op := self.take(_OPERATOR):
            test.op = op[1]
            if (q := self.peek()) in ('"', "'") and q:
                end = self.at + 1
                while end < len(self.text) and self.text[end] != q:
                    end += 2 if self.text[end] == "\\" else 1
                if end >= len(self.text):
                    raise self.fail("unclosed quote")
                test.value, self.at = unescape(self.text[self.at + 1 : end]), end + 1
            elif value := self.take(_IDENT):
                test.value = unescape(value[0])
            else:
                raise self.fail("value must be quoted")
            if flag := self.take(re.compile(r"\s+([iIsS])(?=\s*\])|(?<=[\"'])([iIsS])(?=\s*\])")):
                test.fold = (flag[1] or flag[2]).lower() == "i"
        self.space()
        if self.peek() != "]":
            raise self.fail("] expected")
        self.at += 1
        return Test("never") if never else test

    def pseudo(self) -> Test:
        if self.peek() == ":":
            raise self.fail("pseudo-elements aren't supported")
        m = self.take(re.compile(r"[A-Za-z-]+"))
        name = m[0].lower() if m else ""
        if name in PLACES:
            return Test("place", name)
        if name in NTHS:
            if self.peek() != "(":
                return Test("nth", name, nth=(0, 1))
            self.at += 1
            n = self.take(_NTH)
            if not n or self.peek() != ")":
                raise self.fail("bad position")
            self.at += 1
            if n[1] or n[2]:
                return Test("nth", name, nth=(2, 1 if n[1] else 0))
            if n[3]:
                return Test("nth", name, nth=(0, int(n[3])))
            a = int(n[4] + "1") if n[4] in ("", "+", "-") else int(n[4])
            return Test("nth", name, nth=(a, int((n[5] or "+") + (n[6] or "0"))))
        if name in ("not", "is", "where", "matches", "has"):
            if self.peek() != "(":
                raise self.fail(f":{name} needs a selector")
            self.at += 1
            return Test("is" if name in ("where", "matches") else name, inner=self.groups(name == "has", True))
        raise self.fail(f"unsupported pseudo-class {name!r}")


@lru_cache(512)
def parse_selector(selector: str) -> list[Chain]:
    """Alternatives of a selector, or SelectorError."""
    if not isinstance(selector, str) or not selector.strip():
        raise SelectorError("a selector must be a text that isn't empty")
    return _Reader(selector.strip()).groups()


def nth_matches(nth: tuple[int, int], i: int) -> bool:
    a, b = nth
    return i == b if a == 0 else (i - b) % a == 0 and (i - b) // a >= 0


class Matcher:
    """Selects on one tree. A selector costs its compounds times the nodes, however deep these nest.

    Answers are kept as an array over the nodes for each chain, with the chain itself, so
    that its identity stays its own.
    """

    def __init__(self, tree: Tree) -> None:
        self.tree = tree
        self.places = None
        self.kept: dict[tuple, tuple] = {}

    def place(self, name: str) -> list:
        if self.places is None:
            self.places = sibling_numbers(self.tree)
        return self.places[name]

    def select(self, selector: str, scope: int = 0) -> list[int]:
        """Matching elements below ``scope``, in document order; ancestors may lie outside it."""
        found = [self.matching(c) for c in parse_selector(selector)]
        return [n for n in range(scope + 1, self.tree.last[scope] + 1) if any(f[n] for f in found)]

    def matches(self, n: int, selector: str) -> bool:
        """Whether an element is one that a selector selects."""
        return any(self.matching(c)[n] for c in parse_selector(selector))

    def matching(self, chain: Chain) -> bytearray:
        """For each node, whether the chain ends there: one pass in document order for each compound."""
        key = ("is", id(chain))
        if key in self.kept:
            return self.kept[key][0]
        t, size = self.tree, len(self.tree)
        ends = bytearray(size)
        for k, (combinator, tests) in enumerate(chain):
            before, ends = ends, bytearray(size)
            reached = bytearray(size)  # an ancestor, or an earlier sibling, ends the chain so far
            for n in range(1, size):
                if k:
                    at = t.parent[n] if combinator in (" ", ">") else self.place("prev_e")[n]
                    if at is not None and at > 0:
                        reached[n] = before[at] or (combinator in (" ", "~") and reached[at])
                    if not reached[n]:
                        continue
                if t.kind[n] == ELEMENT and self.compound(n, tests):
                    ends[n] = 1
        self.kept[key] = (ends, chain)
        return ends

    def having(self, chain: Chain) -> bytearray:
        """For each element, whether the relative chain leads on from it: one pass from the end for each compound."""
        key = ("has", id(chain))
        if key in self.kept:
            return self.kept[key][0]
        t, size = self.tree, len(self.tree)
        leads = None
        for combinator, tests in reversed(chain):
            after, leads = leads, bytearray(size)
            for n in range(size - 1, 0, -1):
                if t.kind[n] != ELEMENT:
                    continue
                hit = (after is None or after[n]) and self.compound(n, tests)
                at = t.parent[n] if combinator in (" ", ">") else self.place("prev_e")[n]
                if at is not None and at > 0 and (hit or (combinator in (" ", "~") and leads[n])):
                    leads[at] = 1
        self.kept[key] = (leads, chain)
        return leads

    def compound(self, n: int, tests: Compound) -> bool:
        return all(self.test(n, t) for t in tests)

    def test(self, n: int, t: Test) -> bool:
        tree = self.tree
        if t.kind == "tag":
            return tree.tag[n] == t.name
        if t.kind == "id":
            return tree.get(n, "id") == t.value
        if t.kind == "class":
            return t.value in (tree.get(n, "class") or "").split()
        if t.kind == "attr":
            return attribute_matches(tree.get(n, t.name), t)
        if t.kind == "nth":
            i, count = ("tidx", "tcnt") if "type" in t.name else ("eidx", "ecnt")
            i = self.place(i)[n]
            return nth_matches(t.nth, self.place(count)[n] - i + 1 if "last" in t.name else i)
        if t.kind == "place":
            if t.name == "empty":
                return self.place("bare")[n]
            if t.name == "root":
                return tree.parent[n] == 0
            i, count = ("tidx", "tcnt") if "type" in t.name else ("eidx", "ecnt")
            i, count = self.place(i)[n], self.place(count)[n]
            return {"f": i == 1, "l": i == count, "o": count == 1}[t.name[0]]
        if t.kind in ("is", "not"):
            return any(self.matching(c)[n] for c in t.inner) == (t.kind == "is")
        return t.kind == "has" and any(self.having(c)[n] for c in t.inner)


def attribute_matches(have: str | None, t: Test) -> bool:
    if have is None:
        return False
    if not t.op:
        return True
    want = t.value
    if t.fold:
        have, want = have.lower(), want.lower()
    if t.op == "=":
        return have == want
    if t.op == "~=":
        return want in have.split()
    if t.op == "|=":
        return have == want or have.startswith(want + "-")
    return bool(want) and {"^=": have.startswith, "$=": have.endswith, "*=": have.__contains__}[t.op](want)


__all__ = ["Matcher", "Test", "nth_matches", "parse_selector"]
