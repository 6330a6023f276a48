"""Expanded markup to plain text, in ordered passes."""

from __future__ import annotations

import re

from ..text import WHITE, code_point, py_split

#: Entities with a name, prefixes of other wikis that links don't show.
ENTITIES = {"nbsp": " ", "#160": " ", "#32": " ", "ensp": " ", "emsp": " ", "thinsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "ndash": "–", "mdash": "—", "deg": "°", "times": "×", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "middot": "·", "minus": "−", "frac12": "½", "zwj": "\u200b", "zwnj": "\u200b", "shy": "\u200b", "lrm": "\u200b", "rlm": "\u200b"}
INTERWIKI = ["w", "wikipedia", "s", "wikisource", "species", "c", "commons", "en", "q"]

_TAG = re.compile(r"<(/*)([A-Za-z0-9]+)([^>]*)>")
_LINK = re.compile(r"\[\[(?s:(.*?))\]\]")
_NO_TARGET = re.compile(r"[\[\]\n]")
_REF_END = re.compile(r"(?s).*?(?:</ref>|\Z)")
_HIDDEN = re.compile(r"(?:category|file|image):", re.I | re.A)
_PREFIX = re.compile(rf"(?:{'|'.join(INTERWIKI)}):", re.I | re.A)
_EXTERNAL = re.compile(r"\[http[^\] ]*(?: ([^\]]*))?\]")
_NAME = re.compile(r"&([^;&]{0,10});")


def _tags(text: str) -> str:
    out, at = [], 0
    while m := _TAG.search(text, at):
        out.append(text[at : m.start()])
        at, name, closing = m.end(), m[2].lower(), bool(m[1])
        if name == "ref" and not closing and not m[3].endswith("/"):
            at = _REF_END.match(text, at).end()
        elif name == "br" or (name in ("sup", "sub") and closing and text[at : at + 1].isalnum()):
            out.append(" ")
    return "".join([*out, text[at:]])


def _shown(inner: str) -> str:
    target, bar, label = inner.partition("|")
    target = target.strip(WHITE)
    if ":" not in target:
        return label if bar else target
    if _HIDDEN.match(target):
        return ""
    if bar:
        return label
    target = target.lstrip(":")
    return _PREFIX.sub("", target, count=1) if _PREFIX.match(target) else target


def _links(text: str) -> str:
    out, at = [], 0
    while m := _LINK.search(text, at):
        if _NO_TARGET.search(m[1].partition("|")[0]):  # no target: the brackets are text
            out.append(text[at : m.start() + 2])
            at = m.start() + 2
        else:
            out += [text[at : m.start()], _shown(m[1])]
            at = m.end()
    return "".join([*out, text[at:]])


def _entity(m: re.Match) -> str:
    char = ENTITIES.get(m[1]) or (code_point(m[1][1:]) if m[1][:1] == "#" else None)
    return m[0] if char is None else "" if char == "\u200b" else char


def plain(text: str) -> str:
    """Without tags (and what references hold), links as their labels, entities decoded, spaces tidied."""
    if "<" in text:
        text = _tags(text)
    if "[[" in text:
        text = _links(text)
    if "[http" in text:
        text = _EXTERNAL.sub(lambda m: m[1] or "", text)
    if "''" in text:
        text = text.replace("'''''", "").replace("'''", "").replace("''", "")
    if "&" in text:
        text = _NAME.sub(_entity, text)
    text = " ".join(py_split(text))
    for old, new in ((" ,", ","), ("( ", "("), (" )", ")"), ("()", "")):
        text = text.replace(old, new)
    return text.strip(WHITE)
