"""Personal data: detected entities get keyed surrogates of the same type.

Every surrogate is the image of its entity under a keyed permutation of all strings of its form:
digits and letters go through a Feistel cipher over words of the same pattern (digits of a script,
vowels and consonants, other letters by script and block, case), names of the list through a keyed
permutation of the names of their gender and script. So the same entity has the same surrogate
everywhere (coreference) and different entities never share one (distinctness), at any size and
without a table that tasks would have to agree on. A surrogate that would leave its class (a listed
name for an unlisted one, a hexadecimal string for another) is permuted again, which keeps the map
one to one. No permutation of two strings or more has a fixed point.

Collisions are checked twice: every new surrogate is mapped back, and must give its entity; and
``collisions`` counts, per type, surrogates that stand for more than one entity of a table.
"""

from __future__ import annotations

import hmac
import ipaddress
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, small_batches, text_slices

#: Given names by gender and script, titles by gender, endings and beginnings of family names.
GIVEN = {
    ("f", "latin"): [
        "Alice", "Amelia", "Anna", "Anne", "Carla", "Carmen", "Catherine", "Charlotte", "Chloé", "Clara", "Elena", "Elisa", "Emma", "Eva", "Fatima", "Greta", "Hannah", "Helena", "Ingrid", "Isabel", "Jane", "Julia", "Laura", "Lena",
        "Lucia", "Lucía", "Margarita", "Maria", "María", "Marie", "Martha", "Mary", "Mónica", "Nina", "Olivia", "Patricia", "Paula", "Priya", "Renée", "Rosa", "Sarah", "Sofia", "Sofía", "Sophie", "Susan", "Teresa", "Ursula", "Zoë",
    ],
    ("m", "latin"): [
        "Adam", "Ahmed", "Albert", "Andreas", "André", "Antonio", "Bruno", "Carlos", "Christian", "Daniel", "David", "Diego", "Eric", "Felix", "François", "Georg", "George", "Hans", "Henry", "Hugo", "James", "Jan", "Jean", "Johann",
        "John", "Jorge", "José", "Juan", "Jürgen", "Karl", "Louis", "Luc", "Lucas", "Luís", "Manuel", "Marc", "Martin", "Michael", "Mohammed", "Oscar", "Paul", "Peter", "Pierre", "Robert", "Sven", "Thomas", "Victor", "William",
    ],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Светлана", "Татьяна"],
    ("m", "cyrillic"): ["Алексей", "Борис", "Виктор", "Дмитрий", "Иван", "Михаил", "Николай", "Олег", "Павел", "Сергей"],
    ("f", "greek"): ["Αννα", "Ελενη", "Ειρηνη", "Κατερινα", "Μαρια", "Σοφια"],
    ("m", "greek"): ["Αλεξης", "Γιαννης", "Γιωργος", "Κωστας", "Νικος", "Παυλος"],
}
TITLES = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle", "Mr", "Herr", "Señor", "Sr", "Monsieur", "Dr", "Prof"]
FAMILY_ENDINGS = ["sson", "sdottir", "ández", "énez", "érez", "ínez", "ópez", "ánchez", "odriguez", "onzalez", "ernandez", "artinez", "opoulos", "enko", "owski", "owska", "ewski", "ewska", "czyk", "ović", "ovich", "evich", "yan", "ashvili"]
FAMILY_BEGINNINGS = ["Mc", "O'", "O’", "Fitz"]
#: What stands before a name, up to white space.
CUES = ["my name is", "name:", "full name:", "signed by", "contact person:", "ich heiße", "mein name ist", "je m'appelle", "me llamo", "mi nombre es", "il mio nome è", "меня зовут"]
GENDER = {name: gender for (gender, _), names in GIVEN.items() for name in names}

_LETTER = r"[^\W\d_]"
_WORD = rf"(?:O['’])?{_LETTER}[\u0300-\u036f]*(?:{_LETTER}|[\u0300-\u036f])*(?:-{_LETTER}(?:{_LETTER}|[\u0300-\u036f])+)*"
#: Words that don't begin with a small ASCII letter; other small letters are sorted out later.
NAME_WORD = re.compile(rf"(?<![\w@.\-'’])(?=[^a-z]){_WORD}(?![\w@])")
CUE = re.compile("(?i:" + "|".join(map(re.escape, CUES)) + r")[ \t]+\Z")
CUE_HINTS = sorted({c.split()[-1].rstrip(":") for c in CUES})
ENDING = re.compile("(?:" + "|".join(FAMILY_BEGINNINGS) + r")[^\W\d_a-z]\w+|\w{2,}(?:" + "|".join(FAMILY_ENDINGS) + ")")
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
DIGIT = re.compile(r"\d")
#: By type, in the order in which overlapping finds win; persons come last.
PATTERNS: dict[str, str] = {
    "secret": r"""(?i:\b(?:api[_-]?key|token|secret|password|passwd)\b["']?\s*[=:]\s*)["']?(?P<secret>[A-Za-z0-9+/_\-]{8,})""",
    "key": r"\b(?P<key>AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_\-]{16,})\b",
    "email": r"(?P<email>[^\s@<>()\[\]\",;:|]+@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+)",
    "ipv6": r"(?<![\w:.])(?P<ipv6>(?:[0-9A-Fa-f]{0,4}:){2,8}(?:(?:[0-9]{1,3}\.){3}[0-9]{1,3}|[0-9A-Fa-f]{1,4}|(?<=[^:]::)))(?!\w|:[\w:])",
    "ipv4": rf"(?<![\w.])(?P<ipv4>(?:{OCTET}\.){{3}}{OCTET})(?!\w|\.\d)",
    "iban": r"\b(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b",
    "ssn": r"(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])",
    "phone": r"(?<![\w+.])(?P<phone>(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}|\+\d{8,15})(?![\w\-]|\.\d)",
    "card": r"(?<![\w.+\-])(?P<card>\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7})(?![\w\-]|\.\d)",
}
_COMPILED = {kind: re.compile(p) for kind, p in PATTERNS.items()}
#: Strings without which a type can't be found, to leave most texts to the cheap tests; a digit where none are given.
_HINTS = {"email": ["@"], "ipv6": [":"], "secret": ["=", ":"], "key": ["AKIA", "gh", "sk-"]}


# -- permutations -----------------------------------------------------------------------------


def _walk(value: int, size: int, key: bytes, tweak: bytes, back: bool) -> int:
    """A keyed permutation of range(size) or its inverse: eight Feistel rounds, repeated until in range."""
    half = -(-(size - 1).bit_length() // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(8):
            if back:
                mixed = hmac.digest(key, b"%d|%d|%d|%s" % (7 - r, size, left, tweak), "sha256")
                left, right = right ^ (int.from_bytes(mixed) & mask), left
            else:
                mixed = hmac.digest(key, b"%d|%d|%d|%s" % (r, size, right, tweak), "sha256")
                left, right = right, left ^ (int.from_bytes(mixed) & mask)
        value = left << half | right
        if value < size:
            return value


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed one-to-one map of range(size) to itself that leaves no number in its place, or its inverse.

    It adds one in a permuted order of the numbers, so all of them form one cycle. Halves of more
    than 256 bits are beyond a digest: such entities are permuted in parts by ``spell``.
    """
    if size < 2:
        return value
    there = _walk(value, size, key, tweak.encode(), False)
    return _walk((there + (-1 if back else 1)) % size, size, key, tweak.encode(), True)


#: Letters that take each other's place, by script: vowels and consonants, lower case.
ALPHABETS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "äöü", "áéíóúàèìòùâêîôû", "çñ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιου", "βγδζθκλμνξπρστφχψ")
CLASS = {letter: alphabet for alphabet in ALPHABETS for letter in alphabet}
HEX_LOWER, HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"


def _cased(lower: str) -> bool:
    """A small letter with one capital that leads back to it."""
    upper = lower.upper()
    return len(upper) == 1 and upper != lower and upper.lower() == lower


@lru_cache(1)
def other_letters() -> dict[str, str]:
    """All letters that ``CLASS`` doesn't have, by what may take their place.

    That is the same script, block of 256 and kind: small letters with capitals, or letters without
    case. Groups of fewer than four are put together, so every letter can move.
    """
    groups: dict[tuple, list[str]] = {}
    for c in map(chr, range(0xAA, 0x33480)):
        if c.isalpha() and c not in CLASS and not (c != c.lower() and len(c.lower()) == 1 and _cased(c.lower()) and c.lower().upper() == c):
            groups.setdefault((_cased(c), unicodedata.name(c, "?").split()[0], ord(c) >> 8), []).append(c)
    found: dict[str, str] = {}
    for cased in (True, False):
        small = "".join(sorted(c for (kind, *_), letters in groups.items() if kind == cased and len(letters) < 4 for c in letters))
        for (kind, *_), letters in groups.items():
            if kind == cased:
                found |= dict.fromkeys(letters, "".join(letters) if len(letters) >= 4 else small)
    return found


@lru_cache(10_000)
def alphabet_of(c: str) -> str:
    """The characters that may take the place of c (small ones for a capital); empty if it stays."""
    if c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    if not c.isalpha():
        return ""
    lower = c.lower() if len(c.lower()) == 1 and c.lower().upper() == c else c
    return CLASS.get(lower) or other_letters().get(lower, "")


#: Letters regardless of vowels, for strings that aren't words.
ALNUM = {c: "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {c: "0123456789" for c in "0123456789"}


def spell(text: str, key: bytes, tweak: str, alphabet: Callable[[str], str] = alphabet_of, back: bool = False) -> str:
    """Permute a string's letters and digits within their alphabets, or undo it; the rest, and the case, stays.

    An alphabet of small letters serves for capitals too; one that holds a character itself is used as it is.
    """
    if len(text) > 80:  # each part's place and the part before go into its permutation
        out, before = [], ""
        for i in range(0, len(text), 80):
            part = text[i : i + 80]
            out.append(spell(part, key, f"{tweak}|{i}|{before}", alphabet, back))
            before = out[-1] if back else part
        return "".join(out)
    radix = [alphabet(c) for c in text]
    value, size = 0, 1
    for c, letters in zip(text, radix, strict=True):
        if letters:
            value, size = value * len(letters) + letters.index(c if c in letters else c.lower()), size * len(letters)
    form = "".join(letters[0] if letters else c for c, letters in zip(text, radix, strict=True))
    value = permute(value, size, key, f"{tweak}|{form}", back)
    out = []
    for c, letters in zip(reversed(text), reversed(radix), strict=True):
        if letters:
            value, at = divmod(value, len(letters))
            c = letters[at] if c in letters else letters[at].upper()
        out.append(c)
    return "".join(reversed(out))


def within(text: str, step: Callable[[str], str], kind: Callable[[str], object]) -> str:
    """Take steps of a permutation until the result is of the text's own kind, which it is one to one on."""
    own, new = kind(text), step(text)
    while kind(new) != own:
        new = step(new)
    return new


# -- surrogates -------------------------------------------------------------------------------


def hex_kind(text: str) -> str:
    """How hexadecimal digits are written: digits alone, with small or large letters, with both, or not at all."""
    marks = set(text) - set(":")
    if marks <= set("0123456789"):
        return "digits"
    if marks <= set(HEX_LOWER):
        return "lower"
    if marks <= set(HEX_UPPER):
        return "upper"
    return "mixed" if marks <= set(HEX_LOWER + HEX_UPPER) else ""


def _hex(text: str, key: bytes, tweak: str, back: bool, kind: Callable[[str], object] = hex_kind) -> str:
    """Permute hexadecimal digits within their way of writing: with one case any takes any place."""
    own = hex_kind(text)
    if own in ("lower", "upper"):
        marks = HEX_LOWER if own == "lower" else HEX_UPPER
        letters = dict.fromkeys(marks, marks)
    else:
        letters = dict.fromkeys("0123456789", "0123456789") | dict.fromkeys("abcdef", "abcdef") | dict.fromkeys("ABCDEF", "ABCDEF")
    return within(text, lambda t: spell(t, key, f"{tweak}|{own}", lambda c: letters.get(c, ""), back), kind)


def digits_of(text: str) -> str:
    return "".join(str(unicodedata.decimal(c)) for c in text if c.isdecimal())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _refill(form: str, digits: str) -> str:
    """Put digits in the place of a string's, each in the script of the one before it there."""
    supply = iter(digits)
    return "".join(chr(ord(c) - unicodedata.decimal(c) + int(next(supply))) if c.isdecimal() else c for c in form)


def _numbers(entity: str, key: bytes, kind: str, back: bool, keep: int = 0) -> str:
    """Permute the digits after the first ``keep``; punctuation and script stay, and don't matter."""
    digits = digits_of(entity)
    tail = digits[keep:]
    return _refill(entity, digits[:keep] + f"{permute(int(tail), 10 ** len(tail), key, f'{kind}|{len(tail)}|{digits[:keep]}', back):0{len(tail)}d}")


def _phone(entity: str, key: bytes, back: bool) -> str:
    """A country code that stands apart stays."""
    code = re.match(r"\+(\d{1,3})[ .\-]", entity)
    return _numbers(entity, key, "phone", back, len(code[1]) if code else 0)


def _card(entity: str, key: bytes, back: bool) -> str:
    """Valid check digits stay valid; others stay as far from the valid one."""
    digits = digits_of(entity)
    body = digits[:-1]
    check = lambda b: next(d for d in range(10) if luhn(f"{b}{d}"))
    moved = f"{permute(int(body), 10 ** len(body), key, f'card|{len(digits)}', back):0{len(body)}d}"
    return _refill(entity, moved + str((check(moved) + int(digits[-1]) - check(body)) % 10))


def _iban(entity: str, key: bytes, back: bool) -> str:
    """Country and, for valid ones, valid check digits; others stay as far from the valid ones."""

    def check(country: str, rest: str) -> int:
        return 98 - int("".join(str(int(c, 36)) for c in rest.replace(" ", "") + country + "00")) % 97

    country, given, rest = entity[:2], int(entity[2:4]), entity[4:]
    moved = spell(rest, key, f"iban|{country}", lambda c: ALNUM.get(c, ""), back)
    return f"{country}{(check(country, moved) + given - check(country, rest)) % 100:02d}{moved}"


def _ipv4(entity: str, key: bytes, back: bool) -> str:
    """Octets go to octets; one that is written with zeros before it keeps its width and at least one of them."""
    parts = entity.split(".")
    sizes = [10 ** (len(p) - 1) if len(p) > 1 and p[0] == "0" else 256 for p in parts]
    value = 0
    for part, size in zip(parts, sizes, strict=True):
        value = value * size + int(part)
    total = sizes[0] * sizes[1] * sizes[2] * sizes[3]
    value = permute(value, total, key, f"ipv4|{sizes}", back)
    out = []
    for part, size in zip(reversed(parts), reversed(sizes), strict=True):
        value, own = divmod(value, size)
        out.append(str(own) if size == 256 else f"{own:0{len(part)}d}")
    return ".".join(reversed(out))


def is_ipv6(text: str) -> bool:
    """A full, compressed or IPv4-tailed address that has any digits (``::`` alone says nothing)."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return text != "::"


#: What stands before an embedded IPv4 address and only tells its kind.
EMBEDDING = ("::", "::ffff:", "::ffff:0:", "64:ff9b::")


def _ipv6(entity: str, key: bytes, back: bool) -> str:
    """Groups keep their lengths and places; an embedded IPv4 address gets its own surrogate."""
    if "." not in entity:
        return _hex(entity, key, "ipv6", back)
    head, _, tail = entity.rpartition(":")
    head += ":"
    if head.lower() not in EMBEDDING:
        head = _hex(head, key, "ipv6", back, lambda h: (hex_kind(h), h.lower() in EMBEDDING))
    return head + _ipv4(tail, key, back)


def _email(entity: str, key: bytes, back: bool) -> str:
    """The top domain stays."""
    local, _, domain = entity.rpartition("@")
    labels = domain.split(".")
    return f"{spell(local, key, 'local', back=back)}@{'.'.join([*(spell(x, key, 'domain', back=back) for x in labels[:-1]), labels[-1]])}"


def secret_head(secret: str) -> str:
    """A beginning that only tells the secret's issuer."""
    return re.match(r"AKIA|gh[pousr]_|sk-|", secret)[0]


def _secret(entity: str, key: bytes, back: bool) -> str:
    """A known beginning stays, and so does the way in which a hexadecimal string is written."""
    kind = lambda t: (secret_head(t), hex_kind(t[len(secret_head(t)) :]))
    own = secret_head(entity)
    rest = entity[len(own) :]
    if hex_kind(rest):
        return own + _hex(rest, key, "secret", back, lambda t: kind(own + t))
    return own + within(rest, lambda t: spell(t, key, "secret", lambda c: ALNUM.get(c, ""), back), lambda t: kind(own + t))


def script_of(word: str) -> str:
    return unicodedata.name(next((c for c in word if c.isalpha()), "a"), "LATIN").split()[0].lower()


def listed(word: str) -> str | None:
    """The list's name that a word is, also in capitals."""
    if word in GENDER:
        return word
    return name if len(word) > 2 and word.isupper() and (name := word.capitalize()) in GENDER else None


def name_part(word: str, key: bytes, back: bool) -> str:
    """A name of the list goes to another of its gender and script; other names are respelled, never as one of the list."""
    if (own := listed(word)) is None:
        return within(word, lambda w: spell(w, key, "name", back=back), lambda w: listed(w) is None)
    gender, script = GENDER[own], script_of(own)
    names = GIVEN[gender, script]
    new = names[permute(names.index(own), len(names), key, f"given|{gender}|{script}", back)]
    return new if word == own else new.upper()


def _person(entity: str, key: bytes, back: bool) -> str:
    """Each word, and each part of a word with hyphens, for itself."""
    return re.sub(r"[^\s-]+", lambda m: name_part(m[0], key, back), entity)


SURROGATES: dict[str, Callable[[str, bytes, bool], str]] = {
    "secret": _secret,
    "key": _secret,
    "email": _email,
    "ipv6": _ipv6,
    "ipv4": _ipv4,
    "iban": _iban,
    "ssn": lambda e, k, back: _numbers(e, k, "ssn", back),
    "phone": _phone,
    "card": _card,
    "person": _person,
}


@lru_cache(100_000)
def surrogate(kind: str, entity: str, key: bytes) -> str:
    """The entity's keyed replacement, by its type; fails if it is the entity itself or doesn't lead back to it."""
    new = SURROGATES[kind](entity, key, False)
    if new == entity or SURROGATES[kind](new, key, True) != entity:
        raise ValueError(f"no one-to-one surrogate for an entity of type {kind}")
    return new


# -- detection --------------------------------------------------------------------------------


def _merged(taken: list[tuple[int, int, str]], more: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Both ascending lists in one, without those of the second that overlap one of the first."""
    if not more or not taken:
        return taken or more
    out, i = [], 0
    for span in more:
        while i < len(taken) and taken[i][1] <= span[0]:
            out.append(taken[i])
            i += 1
        if i == len(taken) or taken[i][0] >= span[1]:
            out.append(span)
    return out + taken[i:]


def persons(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Names outside the spans that are taken: after a title or a cue, from the list, by the family name's form.

    Each word of a name that was found is one at its other places in the text too.
    """
    starts = [a for a, _, _ in taken]
    words = []
    for m in NAME_WORD.finditer(text):
        a, b = m.span()
        i = bisect_left(starts, b) - 1
        if not m[0][0].islower() and (i < 0 or taken[i][1] <= a):
            words.append((a, b, m[0]))
    cued = any(hint in text or hint.capitalize() in text for hint in CUE_HINTS)
    found: list[tuple[int, int, str]] = []
    titles, i = set(TITLES), 0
    while i < len(words):
        a, b, word = words[i]
        after = [text[b : words[i + 1][0]]] if i + 1 < len(words) else []
        last = None
        if word in titles:
            if after and re.fullmatch(r"\.?\s+|\.", after[0]) and words[i + 1][2] not in titles:
                i, last = i + 1, i + 1
        elif listed(word) or listed(word.split("-")[0]) or (cued and CUE.search(text, max(0, a - 24), a)):
            last = i
        elif after == [" "] and ENDING.fullmatch(words[i + 1][2]):
            last = i
        if last is not None:
            if last + 1 < len(words) and text[words[last][1] : words[last + 1][0]] == " " and words[last + 1][2] not in titles:
                last += 1
            found.append((words[i][0], words[last][1], "person"))
            i = last
        i += 1
    known = {w for a, b, _ in found for w in text[a:b].split() if len(w) > 2}
    return _merged(found, [(a, b, "person") for a, b, w in words if w in known])


_MOVES = lambda secret: any(map(str.isalnum, secret[len(secret_head(secret)) :]))
_VALID: dict[str, Callable[[str], bool]] = dict.fromkeys(PATTERNS, lambda _: True) | {"ipv6": is_ipv6, "secret": _MOVES, "key": _MOVES}


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of a text's entities, ascending, without overlaps.

    What has neither a letter nor a digit to replace is no entity.
    """
    taken: list[tuple[int, int, str]] = []
    digit = DIGIT.search(text) is not None
    for kind, pattern in _COMPILED.items():
        if any(h in text for h in _HINTS[kind]) if kind in _HINTS else digit:
            spans = [(*m.span(kind), kind) for m in pattern.finditer(text) if _VALID[kind](m[kind])]
            taken = _merged(taken, spans)
    return _merged(taken, persons(text, taken))


def replace(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str, str, str]]]:
    """The text with surrogates, and (start, end, type, entity, surrogate) of each, by place in the input."""
    out, at, spans = [], 0, []
    for a, b, kind in find(text):
        new = surrogate(kind, text[a:b], key)
        out += [text[at:a], new]
        at = b
        spans.append((a, b, kind, text[a:b], new))
    return "".join([*out, text[at:]]), spans


SPANS = "array<struct<start int, end int, type string, entity string, surrogate string>>"


def pseudonymize(docs: DataFrame, key: str, keep_entities: bool = False) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``entities`` long (their number) or, on request,
    ``spans`` (with the entities themselves, so they are not for publication).

    Other columns stay as they are, also ones of clashing names: columns called entities or spans
    are replaced. A null text stays null with 0 entities. Rows are independent: repeated rows get
    equal texts, no rows give no rows. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    extra = ("spans", SPANS) if keep_entities else ("entities", "long")
    rows = docs.drop("spans", "entities").withColumn("text", F.col("text").cast("string"))
    names, secret = rows.schema.names, key.encode()
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("entity", pa.string()), ("surrogate", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("pii", dict)
        for part in text_slices(batches, "text"):
            texts, spans = [], []
            for text in part.column("text").to_pylist():
                new, found = (text, []) if not text else replace(text, secret)
                texts.append(new)
                spans.append(found)
            last = pa.array([[dict(zip(("start", "end", "type", "entity", "surrogate"), s, strict=True)) for s in row] for row in spans], kind) if keep_entities else pa.array([len(s) for s in spans], pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(texts, pa.string()) if n == "text" else c for n, c in zip(names, part.columns, strict=True)), last], [*names, extra[0]])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), " ".join(extra)])
    return rows.mapInArrow(run, schema)


def collisions(spans: DataFrame) -> DataFrame:
    """Per type: different entities, different surrogates, and surrogates of more than one entity."""
    pairs = spans.select(F.explode("spans").alias("s")).select("s.type", "s.entity", "s.surrogate").distinct()
    per = pairs.groupBy("type", "surrogate").agg(F.count("*").alias("n"))
    return per.groupBy("type").agg(F.sum("n").alias("entities"), F.count("*").alias("surrogates"), F.sum((F.col("n") > 1).cast("long")).alias("collisions"))
