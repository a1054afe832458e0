"""Personal data behind disguises, with offsets into the source.

The base patterns find e-mail addresses, IP addresses, card and phone numbers as they stand. Then transducers rewrite a
text piece by piece: homoglyphs and full-width forms to ASCII, invisible characters to nothing, spelled digits (English, French, German, Spanish) to digits, at/dot disguises with or
without brackets to @ and dots. The rewritten text is searched again, and spans that touch a rewritten piece are mapped
back: each piece knows its source stretch. Base spans stay; the method only adds spans that overlap no base span. Words for
a dot that are common words (point, punkt, punto) count outside brackets only between numbers or where a common top-level
domain ends the address.

Null text counts as empty. Offsets are code points of the source, ends exclusive. Every pattern takes time in proportion to
the text, so very long texts are scanned whole. Repeated rows give equal results, further columns are not looked at, an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_docs, texts_of

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
#: A match that starts within a run of digits could start with the run, so only starts of runs are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Letters of other scripts that look like ASCII letters, and what they look like.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "З": "3",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "\xa0": " ", " ": " ", " ": " ", " ": " ",
}
# Spelled digits, words for @ and for a dot, and common top-level domains.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_AT, _DOT, _DOT_WORD = "at|arobase|arroba|@", "dot", "point|punkt|punto"
_TOP = "com|org|net|edu|gov|info|io|de|fr|es|eu|uk|us|ch|at|be|it|nl|ca|dev|app"
_ODD = re.compile("[" + "".join(map(re.escape, LOOKALIKES)) + r"！-～­​-‍⁠﻿\u2460-\u24ff\U0001d400-\U0001d7ff]|(?![0-9])\d")
_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
_UNIT = rf"(?:(?:double|triple) )?(?:{_WORD})|[0-9]+"
_BETWEEN = rf" ?[-.] ?| (?:{_DOT}|{_DOT_WORD}) | "
#: At least two spelled or plain digits in a row: prose with a single number word stays as it is.
_SPELLED = re.compile(rf"(?<![^\W_])(?:{_UNIT})(?:(?:{_BETWEEN})(?:{_UNIT}))+(?![^\W_])", re.IGNORECASE)
_PART = re.compile(rf"(?:(?P<times>double|triple) )?(?P<word>{_WORD})|(?P<digits>[0-9]+)|(?P<spoken> (?:{_DOT}|{_DOT_WORD}) )|(?P<dot>\.)|(?P<gap>[ \-]+)", re.IGNORECASE)
_PLUS = re.compile(rf"(?<![^\W_])(?:plus|más)[ \-]+(?=\(?[0-9]|\(?(?:{_WORD})(?![^\W_]))", re.IGNORECASE)
_AFTER_PLUS = re.compile(rf"(?<=\+)(?:{_WORD})(?![^\W_])", re.IGNORECASE)
_BRACKET = re.compile(rf" ?[(\[{{<] ?(?:({_AT})|({_DOT}|{_DOT_WORD}|\.)) ?[)\]}}>] ?", re.IGNORECASE)
_NAME = "[A-Za-z0-9-]+"
_TAIL = rf"(?={_NAME}(?:(?: (?:{_DOT}|\.) |\.){_NAME}|(?:(?: (?:{_DOT}|{_DOT_WORD}|\.) |\.){_NAME}){{0,3}} (?:{_DOT_WORD}) (?:{_TOP})(?![^\W_])))"
_SPACED = re.compile(rf"(?<=[A-Za-z0-9_%+-]) (?:{_AT}) {_TAIL}", re.IGNORECASE)
_SPACED_DOT = re.compile(rf"(?<=[A-Za-z0-9-]) (?:{_DOT}|\.|({_DOT_WORD})) (?=[A-Za-z0-9-])", re.IGNORECASE)
_HYPHEN_MAIL = re.compile(rf"(?<![A-Za-z0-9])[A-Za-z0-9._]+[-_]at[-_][A-Za-z0-9]+(?:[-_]dot[-_][A-Za-z0-9]+)*[-_]dot[-_](?:{_TOP})(?![^\W_])", re.IGNORECASE)
#: Whether any of these can apply.
_MAY = [
    _ODD,
    _BRACKET,
    re.compile(rf" (?:{_AT}) [A-Za-z0-9-]+(?: (?:{_DOT}|{_DOT_WORD}|\.) |\.[A-Za-z0-9])", re.IGNORECASE),
    re.compile(rf"(?<![^\W_])(?:{_WORD})(?:{_BETWEEN})(?:[0-9]|(?:double |triple )?(?:{_WORD}))|[0-9](?:{_BETWEEN})(?:double |triple )?(?:{_WORD})|[0-9] (?:{_DOT}|{_DOT_WORD}) [0-9]|\+(?:{_WORD})", re.IGNORECASE),
    re.compile(r"(?<![^\W_])(?:plus|más) ", re.IGNORECASE),
    re.compile(rf"@[A-Za-z0-9.-]* (?:{_DOT}|{_DOT_WORD}|\.) |[A-Za-z0-9] (?:{_DOT}|\.) [A-Za-z0-9.-]*@", re.IGNORECASE),
    re.compile(r"[-_]at[-_]", re.IGNORECASE),
]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: each has one @, so they are found from their @ instead of trying every word."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := q.lstrip("0") or "0") < 4 and int(p) <= 255 for q in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


class Rewritten:
    """A text after some transducers; each character knows its source stretch and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.first = np.arange(len(text))
        self.last = self.first + 1
        self.new = np.zeros(len(text), bool)

    def apply(self, pattern: re.Pattern, put) -> None:
        """Puts put(match) in the place of each match; None leaves it."""
        texts, first, last, new, done = [], [], [], [], 0
        for m in pattern.finditer(self.text):
            to = put(m)
            if to is None or to == m[0]:
                continue
            a, b = m.span()
            texts += [self.text[done:a], to]
            first += [self.first[done:a], np.full(len(to), self.first[a])]
            last += [self.last[done:a], np.full(len(to), self.last[b - 1])]
            new += [self.new[done:a], np.ones(len(to), bool)]
            if not to and b < len(self.new):
                self.new[b] = True  # what follows a dropped character counts as rewritten
            done = b
        if texts:
            self.text = "".join([*texts, self.text[done:]])
            self.first = np.concatenate([*first, self.first[done:]])
            self.last = np.concatenate([*last, self.last[done:]])
            self.new = np.concatenate([*new, self.new[done:]])

    def found(self) -> list[tuple[str, int, int]]:
        """Spans, mapped back, that touch a rewritten character."""
        return [(kind, int(self.first[a]), int(self.last[b - 1])) for kind, a, b in find(self.text) if self.new[a:b].any()]


def _plain_letter(m: re.Match) -> str | None:
    c = m[0]
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if unicodedata.category(c) == "Cf":
        return ""
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    return unicodedata.normalize("NFKC", c)


def _plain_digits(m: re.Match) -> str | None:
    """A run with spelled digits or dots: words to digits, spoken dots to dots, gaps beside a word to nothing."""
    parts = [(p.lastgroup, p) for p in _PART.finditer(m[0])]
    if not any(kind in ("word", "spoken") for kind, _ in parts):
        return None
    out = []
    for k, (kind, part) in enumerate(parts):
        if kind == "word":
            times = {"double": 2, "triple": 3}.get((part["times"] or "").lower(), 1)
            out.append(DIGITS[part["word"].lower()] * times)
        elif kind in ("dot", "spoken"):
            out.append(".")
        elif kind == "digits" or "word" not in (parts[k - 1][0], parts[k + 1][0]):
            out.append(part[0])
    return "".join(out)


def _spoken_dot(r: Rewritten):
    """Puts a dot where an @ is near; a common word for it must be followed by a dot's word, or a top-level domain."""

    def put(m: re.Match) -> str | None:
        if "@" not in r.text[max(0, m.start() - 80) : m.end() + 80]:
            return None
        return "." if not m[1] or _ENDS.match(r.text, m.end()) else None

    return put


_ENDS = re.compile(rf"(?:{_NAME}(?: (?:{_DOT}|{_DOT_WORD}|\.) |\.)){{0,3}}(?:{_TOP})(?![^\W_])", re.IGNORECASE)


def disguised(text: str) -> list[tuple[str, int, int]]:
    """Spans that only show once the disguises are taken off."""
    if not any(p.search(text) for p in _MAY):
        return []
    r = Rewritten(text)
    r.apply(_ODD, _plain_letter)
    r.apply(_BRACKET, lambda m: "@" if m[1] else ".")
    r.apply(_SPACED, lambda m: "@")
    r.apply(_HYPHEN_MAIL, lambda m: re.sub("(?i)[-_]dot[-_]", ".", re.sub("(?i)[-_]at[-_]", "@", m[0], count=1)))
    for _ in range(2):  # labels of one letter share their neighbours
        r.apply(_SPACED_DOT, _spoken_dot(r))
    r.apply(_PLUS, lambda m: "+")
    r.apply(_SPELLED, _plain_digits)
    r.apply(_AFTER_PLUS, lambda m: DIGITS[m[0].lower()])
    return r.found()


def _apart(spans: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans that overlap none of base."""
    if not base:
        return spans
    edges = sorted((a, b) for _, a, b in base)
    starts, furthest = [a for a, _ in edges], list(accumulate((b for _, b in edges), max))
    return [s for s in spans if not (k := bisect_left(starts, s[2])) or furthest[k - 1] <= s[1]]


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and these with the added ones; both by kind as listed, then start."""
    order = {kind: k for k, kind in enumerate(KINDS)}
    base = find(text)
    return base, sorted({*base, *_apart(disguised(text), base)}, key=lambda s: (order[s[0]], s[1], s[2]))


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans, their digest, and all spans, of every whole text."""

    def make(doc_ids, texts):
        found = [scan(t or "") for t in texts]
        counts = {f"n_{kind}": pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS}
        return {
            "doc_id": doc_ids,
            **counts,
            "base_sha256": pa.array([hashlib.sha256(_listed(base).encode()).hexdigest() for base, _ in found], pa.string()),
            "spans": pa.array([_listed(spans) for _, spans in found], pa.string()),
        }

    return map_docs(texts_of(docs), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id and text with every span replaced by its kind in brackets."""

    def clean(text):
        if text is None:
            return None
        out, done = [], 0
        for kind, a, b in sorted(scan(text)[1], key=lambda s: (s[1], -s[2])):
            if a >= done:
                out += [text[done:a], f"[{kind.upper()}]"]
                done = b
        return "".join([*out, text[done:]])

    return map_docs(texts_of(docs), lambda ids, texts: {"doc_id": ids, "text": pa.array(map(clean, texts), pa.string())}, "doc_id long, text string")
