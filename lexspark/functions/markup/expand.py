"""Template expansion: parameters, parser functions, magic words and module functions.

``Library`` is what a rendering needs of a dictionary: template pages with their redirects
resolved, data tables of labels, tags, languages and place types, and the titles that exist. It is
plain data, made once and broadcast. ``Expander`` expands one text at a time and notes events
(missing templates, stand-ins, notices), which callers count.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from ..lua import Table, assigned_table, assignments, strings
from ..text import WHITE, py_first, py_split
from .parser import REMEMBERED_CHARS, Simple, parse, split_named, transcluded
from .plain import plain

DEPTH = 40
#: Most calls whose results are remembered, and names that are; longest result and most events of one.
REMEMBERED, RESULT_CHARS, RESULT_EVENTS = 1 << 14, 2000, 20
REDIRECTS = 8
#: Templates that only tell editors something.
NOTICES = frozenset([
    "rfdef", "rfex", "rfexample", "rfv-sense", "rfc-sense", "rfd-sense", "rfm-sense", "rfclarify", "rfquote", "rfquote-sense", "rfquotek", "rfref",
    "rfdate", "rfdatek", "rfi", "rfe", "rfv", "rfd", "rfc", "rfm", "rft-sense", "rfscript", "attention", "attn", "rfv-quote", "rfap", "rfpron",
    "rfinfl", "rfelite", "rfgloss", "rfusex", "rfquote-lite", "rfdef-sense", "rfdatek-lite", "rfscriptex", "tea room sense", "tea room",
])
#: The data modules, those asked first first.
LABEL_MODULES = ("labels/data/lang/en", "labels/data", "labels/data/qualifiers", "labels/data/regional", "labels/data/topical")
TAG_MODULES = ("form of/lang-data/en", "form of/data/1", "form of/data/2")
LANGUAGE_MODULES = re.compile(r"Module:(?:languages/data/|etymology languages/data|families/data)(?!.*/(?:extra|documentation)$)")
#: Words for the text's date, page and punctuation.
DATE_WORDS = {"YEAR": "year", "MONTH": "month", "MONTHNAME": "month_name", "DAY": "day"}
DATES = {f"{when}{part}": word for when in ("CURRENT", "LOCAL", "REVISION") for part, word in DATE_WORDS.items() if when + part != "REVISIONMONTHNAME"}
OTHER_WORDS = {"REVISIONUSER": "", "NAMESPACE": "", "!": "|", "=": "="}
CASES: dict[str, Callable[[str], str]] = {"lc": str.lower, "uc": str.upper, "lcfirst": lambda v: py_first(v, str.lower), "ucfirst": py_first}
PAGE_WORDS = frozenset(["PAGENAME", "FULLPAGENAME", "SUBPAGENAME", "BASEPAGENAME", "PAGENAMEE"])
URL_FUNCTIONS = ("fullurl:", "fullurle:", "localurl:", "localurle:", "canonicalurl:", "filepath:")
SAME = frozenset(["urlencode", "anchorencode", "ns", "padleft", "padright", "plural", "formatnum"])
SPACES = frozenset(("Template", "Module", "Wiktionary", "Appendix"))
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|inf|infinity|nan)\Z", re.I | re.A)


@dataclass(frozen=True)
class Label:
    display: str | None = None
    no_comma_before: bool = False
    no_comma_after: bool = False
    no_space_before: bool = False
    no_space_after: bool = False


@dataclass(frozen=True)
class Dates:
    """What date words read, fixed so that every run gives the same text."""

    year: str = "2026"
    month: str = "10"
    month_name: str = "October"
    day: str = "1"


@dataclass
class Library:
    templates: dict[str, str] = field(default_factory=dict)
    titles: frozenset[str] = frozenset()
    labels: dict[str, Label] = field(default_factory=dict)
    label_aliases: dict[str, str] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)
    tag_shortcuts: dict[str, list[str]] = field(default_factory=dict)
    languages: dict[str, str] = field(default_factory=dict)
    place_types: dict[str, str] = field(default_factory=dict)
    skipped: dict[str, int] = field(default_factory=dict)
    dates: Dates = Dates()

    @classmethod
    def of_pages(cls, pages: Iterable[tuple[str, str | None, str]], titles: Iterable[str] = (), dates: Dates | None = None) -> Library:
        """From (title, redirect, text) of template and module pages; ``titles`` are further titles that exist."""
        by_title = {t: (redirect, text) for t, redirect, text in pages}
        modules = {t.removeprefix("Module:"): text or "" for t, (_, text) in by_title.items() if t.startswith("Module:")}
        out = cls(titles=frozenset(titles) | by_title.keys(), dates=dates or Dates())
        for title in by_title:
            at = title
            for _ in range(REDIRECTS):
                if at not in by_title:
                    break
                redirect, text = by_title[at]
                if redirect is None:
                    out.templates[title] = transcluded(text or "")
                    break
                at = redirect
        out._read_labels(modules)
        out._read_tags(modules)
        for title in sorted((t for t in by_title if LANGUAGE_MODULES.match(t)), key=str.encode):
            found, skipped = assignments(by_title[title][1] or "", "m")
            if found:
                out.skipped[title] = skipped
            for code, value in found:
                first = value.positional()[:1] if isinstance(value, Table) else []
                if first and isinstance(first[0], str):
                    out.languages.setdefault(code, first[0])
        if places := assigned_table(modules.get("place/placetypes", ""), "export.placetype_aliases"):
            out.place_types = {k: v for k, v in places.items if k is not None and isinstance(v, str)}
        return out

    def _read_labels(self, modules: dict[str, str]) -> None:
        for module in (m for m in LABEL_MODULES if m in modules):
            found, self.skipped[f"Module:{module}"] = assignments(modules[module], "labels")
            for name, value in found:
                if name in self.labels or name in self.label_aliases:
                    continue
                if isinstance(value, str):
                    self.label_aliases[name] = value
                    continue
                table = value if isinstance(value, Table) else Table()
                for alias in strings(table.get("aliases")):
                    self.label_aliases.setdefault(alias, name)
                display = table.get("display")
                flags = [table.truthy(f"omit_{x}") for x in ("preComma", "postComma", "preSpace", "postSpace")]
                self.labels[name] = Label(display if isinstance(display, str) else None, *flags)

    def _read_tags(self, modules: dict[str, str]) -> None:
        for module in (m for m in TAG_MODULES if m in modules):
            tags, skipped = assignments(modules[module], "tags")
            shortcuts, more = assignments(modules[module], "shortcuts")
            self.skipped[f"Module:{module}"] = skipped + more
            for name, value in tags:
                table = value if isinstance(value, Table) else Table()
                for short in strings((table.positional() + [None] * 3)[2]):
                    self.tag_shortcuts.setdefault(short, [name])
                display = table.get("display")
                self.tags.setdefault(name, display if isinstance(display, str) else name)
            for name, value in shortcuts:
                if expansion := strings(value):
                    self.tag_shortcuts.setdefault(name, expansion)


Args = dict[str, str]


@dataclass(frozen=True)
class Call:
    """A module function's surroundings: its own arguments, those of the template around it, the title."""

    expander: Expander
    args: Args
    outer: Args
    at: str
    depth: int

    @property
    def title(self) -> str:
        self.expander.titled = True
        return self.at

    @property
    def library(self) -> Library:
        return self.expander.library

    def again(self, text: str) -> str:
        """Expand a result that has templates in it itself."""
        return self.expander.tree(parse(text), self.outer, self.at, self.depth + 1) if "{{" in text else text

    def note(self, kind: str, key: str) -> None:
        self.expander.note(kind, key, self.at)

    def stand_in(self, key: str) -> str:
        """The outer arguments from the second on, where nothing better is known; counted."""
        self.note("fallback", key)
        return ", ".join(positional(self.outer, 2))


def given(args: Args, *keys: str) -> str | None:
    """The first of these arguments that isn't blank."""
    return next((v for k in keys if (v := args.get(k)) is not None and v.strip(WHITE)), None)


def positional(args: Args, start: int) -> list[str]:
    """Numbered arguments from ``start`` up to the first that is absent, without blank ones."""
    out, n = [], start
    while (value := args.get(str(n))) is not None:
        if value.strip(WHITE):
            out.append(value)
        n += 1
    return out


ModuleFunction = Callable[[Call], str]
MODULE_FUNCTIONS: dict[str, ModuleFunction] = {}


def module_function(*keys: str) -> Callable[[ModuleFunction], ModuleFunction]:
    """Register what stands for "module|function"; the way to add further ones.

    Its text may depend on nothing but the call, as results are remembered.
    """

    def add(f: ModuleFunction) -> ModuleFunction:
        MODULE_FUNCTIONS.update(dict.fromkeys(keys, f))
        return f

    return add


def same_number_or_text(a: str, b: str) -> bool:
    return float(a) == float(b) if _NUMBER.match(a) and _NUMBER.match(b) else a == b


class Expander:
    """Expands one text at a time.

    A text's own calls without marks inside depend on their source alone, unless they ask for the
    title: results and events of those are remembered, in bounds, and taken again.
    """

    def __init__(self, library: Library):
        self.library = library
        self.trees: dict[str, list] = {}
        self.names: dict[str, str] = {}
        self.results: dict[str, tuple[str, list[tuple[str, str]]] | None] = {}
        self.titled = False
        self.events: list[tuple[str, str]] = []

    def render(self, title: str, text: str) -> tuple[str, list[tuple[str, str]]]:
        """A text's plain form, and the (kind, key) events on the way."""
        self.events = []
        out = []
        for node in parse(text):
            if isinstance(node, str):
                out.append(node)
            elif type(node) is Simple and node[0] != "parameter":
                out.append(node.source if node[0] == "link" else self._remembered(node, title))
            else:
                out.append(self._node(node, {}, title, 0))
        return plain("".join(out)), self.events

    def _remembered(self, node: Simple, title: str) -> str:
        source = node.source
        known = self.results.get(source, False)
        if known:
            self.events += known[1]
            return known[0]
        if known is None:  # asks for the title
            return self._template(node[1], {}, title, 0)
        before, self.titled = len(self.events), False
        text = self._template(node[1], {}, title, 0)
        noted = self.events[before:]
        if len(source) <= REMEMBERED_CHARS and len(text) <= RESULT_CHARS and len(noted) <= RESULT_EVENTS:
            if len(self.results) >= REMEMBERED:
                self.results.clear()
            self.results[source] = None if self.titled else (text, noted)
        return text

    def note(self, kind: str, key: str, title: str) -> None:
        self.events.append((kind, key))

    def body(self, title: str) -> list | None:
        if title not in self.trees:
            source = self.library.templates.get(title)
            if source is None:
                return None
            self.trees[title] = parse(source)
        return self.trees[title]

    def tree(self, tree: list, args: Args, title: str, depth: int) -> str:
        if not tree:
            return ""
        if len(tree) == 1:
            node = tree[0]
            return node if isinstance(node, str) else self._node(node, args, title, depth)
        return "".join([node if isinstance(node, str) else self._node(node, args, title, depth) for node in tree])

    def _node(self, node: tuple, *where: object) -> str:
        return self.NODES[node[0]](self, node[1], *where)

    def _sealed(self, text: str, *_: object) -> str:
        return text

    def _link(self, parts: list, *where: object) -> str:
        return f"[[{'|'.join(self.tree(p, *where) for p in parts)}]]"

    def _parameter(self, parts: list, args: Args, *where: object) -> str:
        name = self.tree(parts[0], args, *where)
        found = args.get(name.strip(WHITE))
        if found is None:
            return self.tree(parts[1], args, *where) if len(parts) > 1 else f"{{{{{{{name}}}}}}}"
        return found

    def bind(self, parts: list, *where: object) -> Args:
        """Named arguments are trimmed, others numbered as they come; later ones win."""
        out, number = {}, 0
        for part in parts:
            if len(part) < 2 and not (part and isinstance(part[0], str)):  # nothing, or one node
                named = None
            elif len(part) == 1:
                name, mark, value = part[0].partition("=")
                if mark:
                    out[name.strip(WHITE)] = value.strip(WHITE)
                else:
                    number += 1
                    out[str(number)] = name
                continue
            else:
                named = split_named(part)
            if named:
                key = self.tree(named[0], *where).strip(WHITE)
                out[key] = self.tree(named[1], *where).strip(WHITE)
            else:
                number += 1
                out[str(number)] = self.tree(part, *where)
        return out

    def _template(self, parts: list, args: Args, title: str, depth: int) -> str:
        if depth > DEPTH:
            self.note("depth", "", title)
            return ""
        where = (args, title, depth)
        head = self.tree(parts[0], *where).strip(WHITE)
        if head[:1] in ("s", "S"):
            for prefix in ("safesubst:", "subst:", "SAFESUBST:", "SUBST:"):
                head = head.removeprefix(prefix).lstrip(WHITE)
        if head.startswith("#"):
            name, _, first = head[1:].partition(":")
            function = self.FUNCTIONS.get(name.strip(WHITE).translate(_ASCII_LOWER))
            return function(self, first.strip(WHITE), parts[1:], where) if function else ""
        word = self._word(head, title)
        return self._page(head, parts[1:], where) if word is None else word

    def _word(self, head: str, title: str) -> str | None:
        """Case functions, values passed through, URLs (left out), date and page words; else None."""
        name, colon, value = head.partition(":")
        if colon:
            if name in CASES:
                return CASES[name](value.strip(WHITE))
            if name in SAME:
                return value.strip(WHITE)
            if head.translate(_ASCII_LOWER).startswith(URL_FUNCTIONS):
                return ""
            return None
        if word := DATES.get(head):
            return getattr(self.library.dates, word)
        if head in PAGE_WORDS:
            self.titled = True
            return title
        return OTHER_WORDS.get(head)

    def _page(self, head: str, parts: list, where: tuple) -> str:
        _, title, depth = where
        name = self.names.get(head)
        if name is None:
            name = " ".join(py_split(head.replace("_", " ")))
            if len(head) <= REMEMBERED_CHARS:
                if len(self.names) >= REMEMBERED:
                    self.names.clear()
                self.names[head] = name
        if name in NOTICES:
            self.note("maintenance", name, title)
            return ""
        space, colon, _ = name.partition(":")
        page = name if colon and space in SPACES else f"Template:{name}"
        body = self.body(page)
        if body is None:
            self.note("missing", page, title)
            return ""
        return self.tree(body, self.bind(parts, *where), title, depth + 1)

    # Parser functions get the text after the colon, the further parts and where they are; a part
    # that isn't chosen is never expanded.

    def _at(self, parts: list, i: int, where: tuple) -> str:
        return self.tree(parts[i], *where).strip(WHITE) if i < len(parts) else ""

    def _if(self, first: str, parts: list, where: tuple) -> str:
        return self._at(parts, 0 if first else 1, where)

    def _ifeq(self, first: str, parts: list, where: tuple) -> str:
        return self._at(parts, 1 if same_number_or_text(first, self._at(parts, 0, where)) else 2, where)

    def _ifexist(self, first: str, parts: list, where: tuple) -> str:
        return self._at(parts, 0 if first in self.library.titles else 1, where)

    def _switch(self, first: str, parts: list, where: tuple) -> str:
        chosen, fallback = False, None
        for i, part in enumerate(parts):
            named = split_named(part)
            case = self.tree(named[0] if named else part, *where).strip(WHITE)
            if not named:
                if i == len(parts) - 1:
                    return case
                chosen |= case == first
            elif chosen or case == first:
                return self.tree(named[1], *where).strip(WHITE)
            elif case == "#default":
                fallback = named[1]
        return self.tree(fallback, *where).strip(WHITE) if fallback is not None else ""

    def _invoke(self, module: str, parts: list, where: tuple) -> str:
        args, title, depth = where
        key = f"{module}|{self._at(parts, 0, where)}"
        call = Call(self, self.bind(parts[1:], *where), args, title, depth)
        function = MODULE_FUNCTIONS.get(key)
        return function(call) if function else call.stand_in(key)

    def _tag(self, first: str, parts: list, where: tuple) -> str:
        return "" if first.translate(_ASCII_LOWER) == "ref" else self._at(parts, 0, where)

    NODES = {"sealed": _sealed, "link": _link, "parameter": _parameter, "template": _template}
    FUNCTIONS = {"if": _if, "ifeq": _ifeq, "ifexist": _ifexist, "switch": _switch, "invoke": _invoke, "tag": _tag}


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

from . import modules as _modules  # noqa: E402, F401  registers the module functions
