"""Literals of Lua data modules: keyed assignments and single tables.

Values are Python's: str, float, bool, None for nil (and for names, which can't be resolved), and
``Table``, an ordered list of (key or None, value).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_SPACE = re.compile(r"(?:[ \t\n\x0c\r]|--\[(=*)\[(?s:.*?)\]\1\]|--(?!\[=*\[)[^\n]*)*")
_LONG = re.compile(r"\[(=*)\[\n?(?s:(.*?))\]\1\]")
_OPENS_LONG = re.compile(r"\[=*\[")
_NAME = re.compile(r"[A-Za-z0-9_]+")
_NUMBER = re.compile(r"[-0-9][A-Za-z0-9.]*")
_QUOTED = re.compile(r"""(["'])((?:\\[\s\S]|(?!\1)[^\\\n])*)\1""")
_ESCAPE = re.compile(rb"\\(?:([0-9]{1,3})|([\s\S]))")
_PLAIN_ESCAPES = {b"n": b"\n", b"t": b"\t", b"\\": b"\\", b'"': b'"', b"'": b"'", b"\n": b"\n"}


class NotLiteral(Exception):
    """What stands here is no literal."""


@dataclass
class Table:
    items: list[tuple[str | None, object]] = field(default_factory=list)

    def get(self, key: str) -> object:
        return next((v for k, v in self.items if k == key), None)

    def truthy(self, key: str) -> bool:
        return self.get(key) not in (None, False)

    def positional(self) -> list:
        return [v for k, v in self.items if k is None]


def strings(value: object) -> list[str]:
    """A string alone, or a table's positional strings."""
    if isinstance(value, str):
        return [value]
    return [v for v in value.positional() if isinstance(v, str)] if isinstance(value, Table) else []


class Scanner:
    def __init__(self, text: str, at: int):
        self.text, self.at = text, at

    def eat(self, pattern: re.Pattern) -> re.Match | None:
        if m := pattern.match(self.text, self.at):
            self.at = m.end()
        return m

    def peek(self) -> str:
        self.eat(_SPACE)
        return self.text[self.at : self.at + 1]

    def need(self, char: str) -> None:
        if self.peek() != char:
            raise NotLiteral
        self.at += 1

    def string(self) -> str:
        if m := self.eat(_LONG):
            return m[2]
        if not (m := self.eat(_QUOTED)):
            raise NotLiteral

        def escape(e: re.Match) -> bytes:
            if e[1]:
                if int(e[1]) > 255:
                    raise NotLiteral
                return bytes([int(e[1])])
            if e[2] not in _PLAIN_ESCAPES:
                raise NotLiteral
            return _PLAIN_ESCAPES[e[2]]

        try:
            return _ESCAPE.sub(escape, m[2].encode()).decode()
        except UnicodeDecodeError:
            raise NotLiteral from None

    def value(self) -> object:
        """A literal with nothing but a separator, a closing bracket or a new statement after it."""
        first = self.peek()
        if first and first in "\"'[":
            out: object = self.string()
        elif first == "{":
            out = self.table()
        elif m := self.eat(_NUMBER):
            try:
                out = float(m[0]) if "_" not in m[0] else None
            except ValueError:
                raise NotLiteral from None
        elif m := self.eat(_NAME):
            out = {"true": True, "false": False}.get(m[0])
        else:
            raise NotLiteral
        after = self.peek()
        if after and after not in ",;}]" and not (after.isascii() and after.isalpha()):
            raise NotLiteral
        return out

    def item(self) -> object:
        """A table's value; one that is no literal is passed over and reads as nil."""
        back = self.at
        try:
            return self.value()
        except NotLiteral:
            self.at = back
        depth = 0
        while char := self.peek():
            if char in "\"'" or _OPENS_LONG.match(self.text, self.at):
                self.string()
                continue
            if depth == 0 and char in ",;}":
                return None
            depth += (char in "({[") - (char in ")}]")
            if depth < 0:
                raise NotLiteral
            self.at += 1
        raise NotLiteral

    def table(self) -> Table:
        self.need("{")
        out = Table()
        while True:
            char = self.peek()
            if not char:
                raise NotLiteral
            if char == "}":
                self.at += 1
                return out
            if char in ",;":
                self.at += 1
            elif char == "[" and not _OPENS_LONG.match(self.text, self.at):
                self.at += 1
                key = self.value()
                if isinstance(key, float):
                    key = f"{key:.0f}" if key.is_integer() else repr(key)
                if not isinstance(key, str):
                    raise NotLiteral
                self.need("]")
                self.need("=")
                out.items.append((key, self.item()))
            else:
                back, key = self.at, None
                if (char.isascii() and char.isalpha()) or char == "_":
                    key = self.eat(_NAME)[0]
                    if self.peek() == "=" and self.text[self.at + 1 : self.at + 2] != "=":
                        self.at += 1
                    else:
                        self.at, key = back, None
                out.items.append((key, self.item()))


def assignments(source: str, table: str) -> tuple[list[tuple[str, object]], int]:
    """All ``table["key"] = literal`` that start a line, in order, and how many others were skipped."""
    out, skipped = [], 0
    for m in re.finditer(rf"(?m:^){re.escape(table)}\[", source):
        if m.start() and source[m.start() - 1] != "\n":
            continue
        scanner = Scanner(source, m.end())
        try:
            key = scanner.value()
            scanner.need("]")
            scanner.need("=")
            if not isinstance(key, str) or source[scanner.at : scanner.at + 1] == "=":
                raise NotLiteral
            out.append((key, scanner.value()))
        except NotLiteral:
            skipped += 1
    return out, skipped


def assigned_table(source: str, name: str) -> Table | None:
    """The table of the first line that begins ``name =``, if it is one."""
    m = re.search(rf"(?:\A|(?<=\n)){re.escape(name)} =", source)
    if not m:
        return None
    try:
        return Scanner(source, m.end()).table()
    except NotLiteral:
        return None
