"""One canonical form for instructions that differ only in their formatting.

Case, width, white space, punctuation, separating or wrapping signs and the order of named
fields do not matter. The value of a number does (a thousands separator is formatting, a
decimal point is content), and so does the field to which a value belongs. Named fields are told by
their structure, whatever the names: one sign, repeated, with a short name before and a value after it.

Null gives null; a text without letters and digits gives ''.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from typing import NamedTuple

NUMBER = re.compile(r"\d+(?:,\d{3})+(?!\d)(?:\.\d+)?|\d+(?:\.\d+)?")
#: Signs between name and value; a text uses one of them.
NAME_SIGNS = (re.compile(":"), re.compile("="), re.compile(r"(?<=\s)-(?=\s)"))
#: Signs between fields, from the surest; a text mostly uses one of them.
SEPARATORS = (re.compile(";"), re.compile(r"\|"), re.compile(r"\n"), re.compile(r",|\.\.+|[—–]{1,2}"))
#: A separator that is in this share of the gaps is the text's own; most letters and words of a name, fewest fields.
OWN_SHARE, LONGEST_NAME, MOST_WORDS, FEWEST_FIELDS = 0.8, 30, 6, 2
#: Signs that belong to a value even without letters.
CONTENT_SIGNS = "%‰°"
FIELD, PART = "\x1f", "\x1e"


class Canonical(NamedTuple):
    text: str
    """What is compared for sameness."""
    fields: list[tuple[str, str]]
    """Letters and digits of the keys and values of named fields, in canonical order; one field without key for a sentence."""
    numbers: str
    """The numbers stated, in order of their text."""


def _plain_number(written: str) -> str:
    whole, _, part = written.replace(",", "").partition(".")
    part = part.rstrip("0")
    return f"{whole}.{part}" if part else whole


def _plain(s: str, numbers: list[str]) -> str:
    """Letters, digits and decimal points of a text that is in NFKC and folded; numbers do not run together."""
    out, at = [], 0

    def letters(a: int, b: int) -> None:
        out.extend(c for c in s[a:b] if c.isalnum() or c in CONTENT_SIGNS)

    for m in NUMBER.finditer(s):
        letters(at, m.start())
        number = _plain_number(m.group())
        signed = m.start() and s[m.start() - 1] in "-−" and (m.start() == 1 or s[m.start() - 2].isspace())
        if signed:
            number = "-" + number
        elif out and out[-1][-1].isdigit():
            out.append("_")
        out.append(number)
        numbers.append(number)
        at = m.end()
    letters(at, len(s))
    return "".join(out)


def _name_spots(s: str, sign: re.Pattern) -> list[tuple[int, int, int]]:
    """(start and end of the name, start of the value) at each sign that has a name before it.

    What is between two signs is a value, a separator and the next name. The name begins after the last
    separator of the kind that nearly all gaps of the text have, else after the last of any kind, else at the last word.
    """
    ends = [(len(s[max(0, m.start() - LONGEST_NAME) : m.start()].rstrip()) + max(0, m.start() - LONGEST_NAME), m.end()) for m in sign.finditer(s)]
    ends = [(a, b) for a, b in ends if a and s[a - 1].isalpha()]
    if len(ends) < FEWEST_FIELDS:
        return []
    gaps = [(0, ends[0][0])] + [(a[1], b[0]) for a, b in zip(ends, ends[1:])]
    own = next((p for p in SEPARATORS if sum(p.search(s, a, b) is not None for a, b in gaps[1:]) >= OWN_SHARE * (len(gaps) - 1)), None)
    spots = []
    for i, ((low, end), (_, value)) in enumerate(zip(gaps, ends, strict=True)):
        cuts = own and [m.end() for m in own.finditer(s, low, end)] or [m.end() for p in SEPARATORS for m in p.finditer(s, low, end)] or [m.end() for m in _GAP.finditer(s, low, end)]
        at = max(cuts, default=-1) if i else 0
        while 0 <= at < end and not s[at].isalnum():  # wrapping signs
            at += 1
        name = s[max(at, 0) : end].split()
        if at >= 0 and 0 < len(name) <= MOST_WORDS and sum(map(len, name)) <= LONGEST_NAME and all(map(str.isalnum, name)):
            spots.append((at, end, value))
    return spots


_GAP = re.compile(r"\s+")


def _split_fields(s: str) -> list[tuple[str, str]]:
    """Names and values of named fields, as written; empty if the text is not made of them.

    It is if one sign has short names before it, at least twice, and nothing is before the first name.
    """
    best: list[tuple[int, int, int]] = []
    for sign in NAME_SIGNS:
        spots = _name_spots(s, sign)
        if len(spots) >= FEWEST_FIELDS and len(spots) > len(best) and not any(c.isalnum() for c in s[: spots[0][0]]):
            best = spots
    ends = [a for a, _, _ in best[1:]] + [len(s)]
    return [("".join(s[a:b].split()), s[c:e]) for (a, b, c), e in zip(best, ends, strict=True)] if best else []


def canonical(text: str | None) -> Canonical | None:
    if text is None:
        return None
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    numbers: list[str] = []
    fields = _split_fields(folded)
    if not fields:
        plain = _plain(folded, numbers)
        return Canonical(plain, [("", "".join(c for c in plain if c.isalnum()))], " ".join(sorted(numbers)))
    pairs = sorted((_plain(k, []), _plain(v, numbers)) for k, v in fields)
    bare = [("".join(c for c in k if c.isalnum()), "".join(c for c in v if c.isalnum())) for k, v in pairs]
    return Canonical(FIELD.join(k + PART + v for k, v in pairs), bare, " ".join(sorted(numbers)))


def digest(text: str) -> bytes:
    """128 bits that stand for a canonical text in joins."""
    return hashlib.blake2b(text.encode(), digest_size=16).digest()
