"""HTML text to a flat tree: parallel lists in document order, no node objects.

Node 0 is the document. ``last[i]`` is the largest number in the subtree of i, so that
"is below" is an interval test. Everything is iterative; depth is no limit.
"""

from __future__ import annotations

import re
from html.entities import html5

from ..config import BLOCKS_CLOSE_P, CLOSES, P_STOPS, RAW_DECODED, RAW_TEXT, STOPS, VOID
from ..errors import ParseError

DOCUMENT, ELEMENT, TEXT, COMMENT = "document", "element", "text", "comment"
SPACE = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0"
_TAG = re.compile(r"[^\W_](?:[^\W_]|[-:])*")
_ATTR = re.compile(r"""\s*(?:/(?!\s*>)\s*)*([^\s/>="'<]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]*)))?""")
_CLOSE = re.compile(r"\s*(/?)\s*>")
_REFERENCE = re.compile(r"&(?:#[xX]([0-9a-fA-F]+)|#([0-9]+)|([A-Za-z][A-Za-z0-9]*));?")
_LONGEST = max(map(len, html5))


def decode_references(text: str, legacy: bool | frozenset[str] = True, attribute: bool = False) -> str:
    """Decode character references once; what isn't one stays. No Windows-1252 remapping.

    ``legacy``: whether names count without a semicolon, or the names that do.
    """
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        digits = m[1] or m[2]
        if digits:
            n = int(digits, 16 if m[1] else 10) if len(digits) < 9 else 0x110000
            if n > 0x10FFFF:
                return m[0]
            return "�" if 0xD800 <= n <= 0xDFFF else chr(n)
        name, ended = m[3], m[0].endswith(";")
        if ended and f"{name};" in html5:
            return html5[f"{name};"]
        if legacy:
            for n in range(min(len(name), _LONGEST), 1, -1):
                if name[:n] in html5 and (legacy is True or name[:n] in legacy):
                    after = name[n:] or m.string[m.end() : m.end() + 1] * (not ended)
                    if attribute and after[:1] and (after[0].isalnum() or after[0] == "="):
                        return m[0]
                    return html5[name[:n]] + m[0][1 + n :]
        return m[0]

    return _REFERENCE.sub(one, text)


class Tree:
    """A parsed document."""

    def __init__(self) -> None:
        self.kind, self.tag, self.attrs, self.data = [DOCUMENT], ["#document"], [()], [""]
        self.parent, self.last, self.depth = [-1], [0], [0]
        self.doctype: str | None = None
        #: Texts of titles and textareas as they stand in the source, with their references.
        self.source: dict[int, str] = {}
        self._kids: list[list[int]] | None = None

    def __len__(self) -> int:
        return len(self.kind)

    def add(self, kind: str, tag: str, attrs: tuple, data: str, parent: int) -> int:
        n = len(self.kind)
        self.kind.append(kind)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.data.append(data)
        self.parent.append(parent)
        self.last.append(n)
        self.depth.append(self.depth[parent] + 1)
        return n

    def kids(self, n: int) -> list[int]:
        if self._kids is None:
            self._kids = [[] for _ in self.kind]
            for i in range(1, len(self.kind)):
                self._kids[self.parent[i]].append(i)
        return self._kids[n]

    def get(self, n: int, name: str) -> str | None:
        return next((v for k, v in self.attrs[n] if k == name), None)

    def strings(self, n: int) -> list[str]:
        """Contents of the text nodes in the subtree."""
        return [self.data[i] for i in range(n, self.last[n] + 1) if self.kind[i] == TEXT]

    def text(self, n: int = 0, sep: str = "", strip: bool = False) -> str:
        found = self.strings(n)
        return sep.join(s for s in map(str.strip, found) if s) if strip else sep.join(found)


def parse(html: str, legacy: bool | frozenset[str] = True) -> Tree:
    """Build the tree of a text. Broken markup never fails."""
    if not isinstance(html, str):
        raise ParseError(f"HTML must be text, not {type(html).__name__}")
    html = html.removeprefix("﻿")
    tree, stack, n, at = Tree(), [0], len(html), 0
    run: list[str] = []

    def flush() -> None:
        if run:
            data = "".join(run)
            run.clear()
            if data:
                tree.add(TEXT, "", (), data, stack[-1])

    def close(depth: int) -> None:
        for i in stack[depth:]:
            tree.last[i] = len(tree) - 1
        del stack[depth:]

    def nearest(names: frozenset, stops: frozenset) -> None:
        for i in range(len(stack) - 1, 0, -1):
            tag = tree.tag[stack[i]]
            if tag in names:
                close(i)
                return
            if tag in stops:
                return

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            run.append(decode_references(html[at:], legacy))
            break
        if lt > at:
            run.append(decode_references(html[at:lt], legacy))
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            flush()
            tree.add(COMMENT, "", (), html[lt + 4 : end if end >= 0 else n], stack[-1])
            at = end + 3 if end >= 0 else n
            continue
        mark = html[lt + 1 : lt + 2]
        if mark in ("!", "?") and mark:
            end = html.find(">", lt)
            end = n if end < 0 else end
            body = html[lt + 2 : end]
            if mark == "!" and body[:7].lower() == "doctype":
                if tree.doctype is None:
                    tree.doctype = body[7:].strip()
            else:
                flush()
                tree.add(COMMENT, "", (), body, stack[-1])
            at = end + 1
            continue
        if mark == "/":
            end = html.find(">", lt)
            end = n if end < 0 else end
            if found := _TAG.match(html, lt + 2, end):
                name = found[0].lower()
                for i in range(len(stack) - 1, 0, -1):
                    if tree.tag[stack[i]] == name:
                        flush()
                        close(i)
                        break
            at = end + 1
            continue
        found = _TAG.match(html, lt + 1) if mark.isalpha() else None
        if not found:
            run.append("<")
            at = lt + 1
            continue
        name, at = found[0].lower(), found.end()
        attrs: dict[str, str] = {}
        closed = False
        while at < n:
            if done := _CLOSE.match(html, at):
                closed, at = bool(done[1]), done.end()
                break
            item = _ATTR.match(html, at)
            if not item or item.end() == at:
                at += 1
                continue
            value = next((v for v in item.groups()[1:] if v is not None), "")
            attrs.setdefault(item[1].lower(), decode_references(value, legacy, True))
            at = item.end()
        flush()
        if name in BLOCKS_CLOSE_P:
            nearest(frozenset(("p",)), P_STOPS)
        if name in CLOSES:
            nearest(CLOSES[name], STOPS[name])
        node = tree.add(ELEMENT, name, tuple(attrs.items()), "", stack[-1])
        if name in VOID or closed:
            continue
        stack.append(node)
        if name in RAW_TEXT:
            end = re.compile(rf"</\s*{re.escape(name)}\s*>", re.I).search(html, at)
            raw = html[at : end.start() if end else n]
            if raw:
                text = tree.add(TEXT, "", (), decode_references(raw, legacy) if name in RAW_DECODED else raw, node)
                if name in RAW_DECODED:
                    tree.source[text] = raw
            close(len(stack) - 1)
            at = end.end() if end else n
    flush()
    close(0)
    tree.last[0] = len(tree) - 1
    return tree


def sibling_numbers(tree: Tree) -> dict[str, list]:
    """For each node: place among siblings, among elements, among its tag, and the previous element."""
    n = len(tree)
    out = {k: [0] * n for k in ("sib", "eidx", "ecnt", "tidx", "tcnt")} | {"prev_e": [None] * n, "bare": [True] * n}
    for p in range(n):
        if tree.kind[p] not in (DOCUMENT, ELEMENT):
            continue
        kids, seen, elements, before = tree.kids(p), {}, 0, None
        for i, k in enumerate(kids):
            out["sib"][k] = i
            if tree.kind[k] == ELEMENT:
                elements += 1
                seen[tree.tag[k]] = seen.get(tree.tag[k], 0) + 1
                out["eidx"][k], out["tidx"][k], out["prev_e"][k], before = elements, seen[tree.tag[k]], before, k
            if tree.kind[k] == ELEMENT or tree.kind[k] == TEXT and tree.data[k].strip():
                out["bare"][p] = False
        for k in kids:
            if tree.kind[k] == ELEMENT:
                out["ecnt"][k], out["tcnt"][k] = elements, seen[tree.tag[k]]
    return out


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def opening_tag(tree: Tree, n: int) -> str:
    """The start tag; attributes in source order."""
    return f"<{tree.tag[n]}" + "".join(f' {k}="{escape(v).replace(chr(34), "&quot;")}"' for k, v in tree.attrs[n]) + ">"


def serialize(tree: Tree, n: int = 0) -> str:
    """Compact HTML of a subtree; attributes in source order."""
    out: list[str] = []
    open_: list[int] = []
    for i in range(n, tree.last[n] + 1):
        while open_ and i > tree.last[open_[-1]]:
            out.append(f"</{tree.tag[open_.pop()]}>")
        kind = tree.kind[i]
        if kind == TEXT:
            raw = tree.tag[tree.parent[i]] in RAW_TEXT - RAW_DECODED
            out.append(tree.data[i] if raw else escape(tree.data[i]))
        elif kind == COMMENT:
            out.append(f"<!--{tree.data[i]}-->")
        elif kind == ELEMENT:
            out.append(opening_tag(tree, i))
            if tree.tag[i] not in VOID:
                open_.append(i)
    out.extend(f"</{tree.tag[i]}>" for i in reversed(open_))
    return "".join(out)


def prettify(tree: Tree, n: int = 0, indent: int = 2, max_depth: int = 64, inline: int = 80) -> str:
    """Indented HTML: an element with one short text stays on its line; below ``max_depth`` it is compact."""
    lines: list[str] = []
    todo: list[tuple] = [(n, 0)]
    while todo:
        i, level = todo.pop()
        pad = " " * (indent * level)
        if isinstance(i, str):
            lines.append(pad + i)
            continue
        kind, kids = tree.kind[i], tree.kids(i)
        if kind == DOCUMENT:
            todo.extend((k, level) for k in reversed(kids))
        elif kind == TEXT:
            if tree.data[i].strip():
                lines.append(pad + escape(tree.data[i].strip()))
        elif kind == COMMENT:
            lines.append(f"{pad}<!--{tree.data[i]}-->")
        else:
            opening = opening_tag(tree, i)
            short = len(kids) == 1 and tree.kind[kids[0]] == TEXT and len(tree.data[kids[0]].strip()) < inline
            if not kids or level >= max_depth:
                lines.append(pad + serialize(tree, i))
            elif short:
                lines.append(f"{pad}{opening}{escape(tree.data[kids[0]].strip())}</{tree.tag[i]}>")
            else:
                lines.append(pad + opening)
                todo.append((f"</{tree.tag[i]}>", level))
                todo.extend((k, level + 1) for k in reversed(kids))
    return "\n".join(lines)



def prettify_lines(tree: Tree, n: int = 0, verbatim: tuple[str, ...] = ("pre", "textarea")) -> str:
    """HTML with each tag and each text on a line of its own, one space a level, attributes by name.

    Blank texts go, others are stripped; what is in ``verbatim`` elements stays as it is.
    """
    lines: list[str] = []

    def start(i: int) -> str:
        said = "".join(f' {k}="{escape(v).replace(chr(34), "&quot;")}"' for k, v in sorted(tree.attrs[i]))
        return f"<{tree.tag[i]}{said}" + ("/>" if tree.tag[i] in VOID else ">")

    todo: list[tuple[int, int, bool]] = [(k, 0, False) for k in reversed(tree.kids(n))] if tree.kind[n] == DOCUMENT else [(n, 0, False)]
    while todo:
        i, level, ends = todo.pop()
        pad = " " * level
        if ends:
            lines.append(f"{pad}</{tree.tag[i]}>")
        elif tree.kind[i] == TEXT:
            said = tree.data[i].strip()
            raw = tree.tag[tree.parent[i]] in RAW_TEXT - RAW_DECODED
            lines += [pad + (said if raw else escape(said))] if said else []
        elif tree.kind[i] == COMMENT:
            lines.append(f"{pad}<!--{tree.data[i]}-->")
        elif tree.tag[i] in verbatim:
            inner = "".join(serialize(tree, k) if tree.kind[k] == ELEMENT else escape(tree.data[k]) for k in tree.kids(i))
            lines.append(f"{pad}{start(i)}{inner}</{tree.tag[i]}>")
        else:
            lines.append(pad + start(i))
            if tree.tag[i] not in VOID:
                todo.append((i, level, True))
                todo.extend((k, level + 1, False) for k in reversed(tree.kids(i)))
    return "".join(f"{x}\n" for x in lines)
