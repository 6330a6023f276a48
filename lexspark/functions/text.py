"""Text functions as native column expressions, and their Python twins for use inside UDFs.

Native ones run in the JVM within whole-stage code. Where a rule needs more than a regular
expression (byte-limited entities), the Python function is wrapped as an Arrow UDF.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by Unicode: the characters with the property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WS = r"\p{IsWhite_Space}"

# -- native ------------------------------------------------------------------------------------


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends (Spark's trim takes only U+0020)."""
    return F.regexp_replace(c, f"^{_WS}+|{_WS}+$", "")


def strip_comments(c: Column) -> Column:
    """Without <!-- ... -->; one that is not closed runs to the end."""
    return F.regexp_replace(c, r"(?s)<!--.*?(-->|\z)", "")


def named_entities(c: Column) -> Column:
    """XML's five named entities decoded once: the ampersand last, so nothing is decoded twice."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c


def brace_balance(c: Column) -> Column:
    """Openings minus closings of double braces, counted without overlap."""
    return (F.regexp_count(c, F.lit(r"\{\{")) - F.regexp_count(c, F.lit(r"\}\}"))).cast("long")


def heading(c: Column) -> Column:
    """struct<level int, name string> of a heading line, else null."""
    line = F.regexp_replace(c, f"{_WS}+$", "")
    lead, trail = F.length(F.regexp_extract(line, "^(=+)", 1)), F.length(F.regexp_extract(line, "(=+)$", 1))
    level = F.least(lead, trail)
    name = trim(F.substring(line, level + 1, F.length(line) - 2 * level))
    return F.when((level > 0) & (lead < F.length(line)), F.struct(level.alias("level"), name.alias("name")))


def meaning_line(c: Column) -> Column:
    """struct<depth int, text string> of a line of meaning, else null: a run of # not followed by : or *."""
    parts = r"(?s)^(#++)(?![:*])(.*)$"
    text = trim(F.regexp_extract(c, parts, 2))
    depth = F.least(F.length(F.regexp_extract(c, parts, 1)), F.lit(255))
    return F.when((depth > 0) & (text != ""), F.struct(depth.alias("depth"), text.alias("text")))


def upper_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def lower_first(c: Column) -> Column:
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def article(c: Column) -> Column:
    """An before a vowel letter (brackets and apostrophes apart), else A."""
    return F.when(F.rlike(c, F.lit(r"^[\[']*[aeiouAEIOU]")), "An").otherwise("A")


def join_terms(terms: Column, word: str) -> Column:
    """array -> 'a', 'a or b', 'a, b or c'; empty for an empty array."""
    n = F.size(terms)
    start = F.array_join(F.slice(terms, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, "").when(n == 1, start).otherwise(F.concat(start, F.lit(f" {word} "), F.element_at(terms, -1)))


def leftover_markup(c: Column) -> Column:
    """Whether double brackets or braces are left."""
    return F.rlike(c, F.lit(r"\[\[|\]\]|\{\{|\}\}"))


def html_plain(c: Column) -> Column:
    """Markup of ordinary pages to text: tags, external links, quote marks, common entities, spaces.

    Reference contents and a raised ending before a letter need ``markup.plain``.
    """
    c = F.regexp_replace(c, r"(?i)<br(?![A-Za-z0-9])[^>]*>", " ")
    c = F.regexp_replace(c, r"</*[A-Za-z0-9][^>]*>", "")
    c = external_links(c)
    c = F.regexp_replace(c, r"'{5}|'{3}|'{2}", "")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("middot", "·"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return tidy(c)


def external_links(c: Column) -> Column:
    """[http://... label] -> label; without a label nothing is left."""
    return F.regexp_replace(c, r"\[http[^\] ]*(?: ([^\]]*))?\]", "$1")


def tidy(c: Column) -> Column:
    """White space to single spaces, and none before commas and inside brackets; empty brackets go."""
    c = trim(F.regexp_replace(c, f"{_WS}+", " "))
    for old, new in ((" ,", ","), ("( ", "("), (" )", ")"), ("()", "")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return trim(c)


# -- Python ------------------------------------------------------------------------------------

_XML = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
_ENTITY = re.compile(r"&([^;&]*);")


def code_point(number: str) -> str | None:
    """The character of '65' or 'x41', if there is one."""
    if not re.fullmatch(r"[xX]\+?[0-9A-Fa-f]+|\+?[0-9]+", number):
        return None
    value = int(number[1:], 16) if number[0] in "xX" else int(number)
    return chr(value) if value < 0x110000 and not 0xD800 <= value < 0xE000 else None


def xml_unescape(text: str) -> str:
    """Named and numeric references decoded in one pass; the ; must be in the 12 bytes from the &."""

    def one(m: re.Match) -> str:
        name = m[1]
        if len(name.encode()) > 10:
            return m[0]
        char = _XML.get(name) or (code_point(name[1:]) if name[:1] == "#" else None)
        return m[0] if char is None else char

    return _ENTITY.sub(one, text) if "&" in text else text


def py_strip(text: str) -> str:
    return text.strip(WHITE)


#: What str.split takes for white space beyond WHITE, and runs of WHITE.
_SEPARATORS, _RUN = re.compile("[\x1c-\x1f]"), re.compile(f"[{WHITE}]+")


def py_split(text: str) -> list[str]:
    if not _SEPARATORS.search(text):
        return text.split()
    return [w for w in _RUN.split(text) if w]


def py_join_terms(terms: list[str], word: str) -> str:
    return terms[0] if len(terms) == 1 else f"{', '.join(terms[:-1])} {word} {terms[-1]}" if terms else ""


def py_article(text: str) -> str:
    return "An" if text.lstrip("['")[:1].lower() in tuple("aeiou") else "A"


def py_first(text: str, case=str.upper) -> str:
    return case(text[:1]) + text[1:]


def py_strip_comments(text: str) -> str:
    return re.sub(r"(?s)<!--.*?(?:-->|\Z)", "", text)


def xml_text(c: Column) -> Column:
    """XML references decoded; texts without numeric ones stay in the JVM."""
    decode = F.udf(lambda s: None if s is None else xml_unescape(s), "string", useArrow=True)
    return F.coalesce(decode(F.when(F.contains(c, F.lit("&#")), c)), named_entities(c))
