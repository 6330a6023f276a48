"""Wiki markup as a tree.

A tree is a list of nodes: str, or (kind, parts) with kind "template", "parameter" or "link" and
parts a list of trees, or ("sealed", str) for a tag whose contents are nobody else's. An opening
mark that isn't closed is text. Every (place, closing mark) is worked out once, so unclosed marks
don't multiply the work. Templates, parameters and links without marks inside, the most by far, are
found by one regular expression and remembered by their source, so trees must not be changed.
"""

from __future__ import annotations

import re

#: Tags whose contents stay together.
SEALED = ["ref", "nowiki", "math", "pre", "syntaxhighlight", "chem", "ce", "gallery", "score", "templatestyles"]
KINDS = {"}}}": "parameter", "}}": "template", "]]": "link"}
_TAG = rf"<({'|'.join(SEALED)})[ >/\t\n]"
_SEALED = re.compile(_TAG, re.I | re.A)
_CLOSER = {"{{{": "}}}", "{{": "}}", "[[": "]]"}
_BARE = rf"[^{{}}\[\]<]*(?:(?!(?i:{_TAG.replace('(', '(?:')}))<[^{{}}\[\]<]*)*"
_SIMPLE = "|".join(re.escape(mark) + _BARE + re.escape(closer) for mark, closer in _CLOSER.items())
_STOPS = {closer: re.compile("|".join([*(re.escape(closer), r"\|") * bool(closer), f"({_SIMPLE})", r"\{\{\{?", r"\[\[", "<"]), re.A) for closer in ("", *KINDS)}
#: Most nodes and longest source that are remembered.
REMEMBERED, REMEMBERED_CHARS = 1 << 14, 500


class Simple(tuple):
    """A node without marks inside, with its ``source``."""

    source: str


_simple: dict[str, Simple | None] = {}


def _read_simple(source: str) -> Simple | None:
    """The node of a source without marks inside; None for a link whose target has a line break."""
    mark = "{{{" if source.startswith("{{{") else source[:2]
    node = Simple((KINDS[_CLOSER[mark]], [[p] if p else [] for p in source[len(mark) : -len(mark)].split("|")]))
    node.source = source
    if mark == "[[" and node[1][0] and "\n" in node[1][0][0]:
        node = None
    if len(source) <= REMEMBERED_CHARS:
        if len(_simple) >= REMEMBERED:
            _simple.clear()
        _simple[source] = node
    return node


def _add(tree: list, text: str) -> None:
    if text:
        if tree and isinstance(tree[-1], str):
            tree[-1] += text
        else:
            tree.append(text)


class _Parse:
    def __init__(self, text: str):
        self.text = text
        self.known: dict[tuple[int, str], tuple[list, int] | None] = {}

    def sealed(self, at: int) -> int:
        """Where the sealed tag at this place ends; 0 if there is none."""
        m = _SEALED.match(self.text, at)
        end = self.text.find(">", at) if m else -1
        if end < 0:
            return 0
        if self.text[end - 1] == "/":
            return end + 1
        close = re.compile(f"</{m[1]}>", re.I | re.A).search(self.text, end)
        return close.end() if close else len(self.text)

    def parts(self, at: int, closer: str) -> tuple[list, int] | None:
        """The parts up to the closing mark and the place behind it; None if it doesn't come."""
        if (at, closer) not in self.known:
            self.known[at, closer] = self._parts(at, closer)
        return self.known[at, closer]

    def _parts(self, at: int, closer: str) -> tuple[list, int] | None:
        out: list[list] = [[]]
        start = at
        while m := _STOPS[closer].search(self.text, at):
            mark, at = m[0], m.start()
            node: object = None
            end = at + 1
            if m.lastindex:
                node = _simple[mark] if mark in _simple else _read_simple(mark)
                if node is not None:
                    if start < at:
                        _add(out[-1], self.text[start:at])
                    out[-1].append(node)
                    start = end = m.end()
                at = end
                continue
            if mark == closer:
                _add(out[-1], self.text[start:at])
                return out, at + len(closer)
            if mark == "|":
                _add(out[-1], self.text[start:at])
                out.append([])
                start = at = end
                continue
            if mark == "<":
                if stop := self.sealed(at):
                    node, end = ("sealed", self.text[at:stop]), stop
            else:
                node, at, end = self._opened(mark, at)
            if node is not None:
                _add(out[-1], self.text[start:at])
                out[-1].append(node)
                start = end
            at = end
        if closer:
            return None
        _add(out[-1], self.text[start:])
        return out, len(self.text)

    def _opened(self, mark: str, at: int) -> tuple[object, int, int]:
        """The node that a mark opens, where it starts and ends; no node if it isn't closed."""
        if found := self.parts(at + len(mark), _CLOSER[mark]):
            broken = mark == "[[" and any(isinstance(n, str) and re.search(r"[\[\]\n]", n) for n in found[0][0])
            if not broken:
                return (KINDS[_CLOSER[mark]], found[0]), at, found[1]
        elif mark == "{{{" and (found := self.parts(at + 1, "}}")):
            return ("template", found[0]), at + 1, found[1]  # a brace, then a template
        return None, at, at + 1


def parse(text: str) -> list:
    return _Parse(text).parts(0, "")[0][0]


def split_named(tree: list) -> tuple[list, list] | None:
    """(name, value) around the first = in a text of the tree itself."""
    for i, node in enumerate(tree):
        if isinstance(node, str) and "=" in node:
            name, _, value = node.partition("=")
            left, right = list(tree[:i]), []
            _add(left, name)
            _add(right, value)
            return left, right + list(tree[i + 1 :])
    return None


def transcluded(source: str) -> str:
    """What a page contributes where it is used as a template."""
    text = re.sub(r"(?s)<!--.*?(?:-->|\Z)", "", source)
    if "<onlyinclude>" in text:
        text = "".join(re.findall(r"(?s)<onlyinclude>(.*?)(?=</onlyinclude>|\Z)", text))
    text = re.sub(r"(?s)<noinclude>.*?(?:</noinclude>|\Z)", "", text)
    return re.sub(r"</?includeonly>|<noinclude ?/>", "", text)
