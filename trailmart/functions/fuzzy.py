"""Fuzzy similarity of short texts on a scale of 0 to 100, from the published definitions.

``ratio`` is twice the matched characters of the longest-block alignment over both lengths,
``partial_ratio`` the best ratio of the shorter text with a window of the longer, and
``token_set_ratio`` compares shared and remaining words.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(100_000)
def ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    return 100.0 * SequenceMatcher(None, a, b, autojunk=False).ratio()


@lru_cache(100_000)
def partial_ratio(a: str, b: str) -> float:
    """Two empty texts are alike; an empty and a non-empty one are not."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 100.0
    starts = {max(0, j - i) for i, j, size in SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks() if size}
    return max((ratio(short, long[s : s + len(short)]) for s in starts), default=0.0)


@lru_cache(100_000)
def token_set_ratio(a: str, b: str) -> float:
    left, right = (set(re.findall(r"\w+", s.casefold())) for s in (a, b))
    if not left or not right:
        return 0.0
    shared = " ".join(sorted(left & right))
    only_left, only_right = (" ".join(sorted(x)) for x in (left - right, right - left))
    if shared and (not only_left or not only_right):
        return 100.0
    with_left, with_right = (f"{shared} {x}".strip() for x in (only_left, only_right))
    return max(ratio(with_left, with_right), ratio(shared, with_left) if shared else 0.0, ratio(shared, with_right) if shared else 0.0)


def plain_words(value: str | None) -> str:
    """Latin letters, digits and Chinese characters of a text in its compatibility form, folded; a decimal point goes too."""
    return re.sub(r"[^0-9a-z\u4e00-\u9fff]+", "", unicodedata.normalize("NFKC", value or "").casefold())


def numbers_agree(wanted: str, candidate: str) -> bool:
    """A text without numbers agrees with any; one with numbers only with the same numbers in the same order."""
    numbers = lambda s: re.findall(r"\d+(?:\.\d+)?", s)
    return not numbers(wanted) or numbers(wanted) == numbers(candidate)


def _texts(values) -> list[str]:
    return [v for v in (values if values is not None else ()) if v is not None]


def matched_share(required, available, threshold: float = 85.0) -> float:
    """The share of required texts met by an available one; 1 if none is required.

    Texts are compared as ``plain_words``; blank ones do not count. A required text is met by a text with the same numbers that
    contains it or reaches the partial ratio, or, if it has no numbers, by all available texts joined.
    """
    required, available = ([w for w in map(plain_words, _texts(values)) if w] for values in (required, available))
    if not required:
        return 1.0
    whole = "".join(available)
    met = lambda w: not re.search(r"\d", w) and w in whole or any(numbers_agree(w, x) and (w in x or partial_ratio(w, x) >= threshold) for x in available)
    return sum(map(met, required)) / len(required)


# Colours, of which the first that a text contains stands for it.
COLOURS = (
    "alabaster apricot aqua ash asphalt azure banana beige black blue blush bordeaux bronze brown burgundy camel camo caramel champagne charcoal cheetah chestnut chocolate christmas coffee "
    "cognac copper coral cranberry cream crystal dark denim eggplant elephant espresso fuchsia gold granite grape graphite grass gray green grey heather indigo ivory ivy khaki lavender lemon "
    "leopard light lilac lime magenta maroon mauve merlot midnight mint mocha multicolor mushroom mustard natural navy nude olive orange peach pewter pink plum purple rainbow red rose royal rust "
    "sand sapphire seashell silver skull slate steel stone stonewash sunflower tan taupe teal tiger turquoise violet walnut wheat white wine yellow"
).split()
# Writings of sizes, of which the first that is found stands for a text.
SIZES = [
    "xx-large", "3x-large", "4x-large", "5x-large", "x-large", "x-small", "medium", "large", "small", "queen", "twin", "full", "king", "one size", "pack",
    r"(.*)neck(.*)sleeve", r"(.*) women \| (.*) men", r"(.*)w x(.*)l", r"(.*)w by (.*)l", r"(.*)w x(.*)h", r"(.*)wide", r"(.*)x-wide", r"(.*)narrow", r"(.*)petite", r"(.*)inch", r"(.*)plus", r"(.*)mm",
    r"women(.*)", r"(.*)x(.*)", r"(.*)ft", r"(.*)feet", r"(.*)meter", r"(.*)yards", r"(.*)\*(.*)", r"(.*)\-(.*)", r'(\d+)"$', r"(\d+)f$", r"(\d+)m$", r"(\d+)cm$", r"(\d+)g$",
]
UNKNOWN = "not_matched"


def first_colour(value: str | None) -> str:
    """The first colour of the list that a text contains; else the text."""
    return next((c for c in COLOURS if c in value), value) if value else ""


def token_set_matches(required, available, threshold: float = 85.0) -> float:
    """The share of required options whose colour or text an available one is like, by the token set ratio; 1 if none is required."""
    required, available = (list(map(first_colour, _texts(v))) for v in (required, available))
    if not required:
        return 1.0
    return sum(any(token_set_ratio(x, w) > threshold for x in available) for w in required) / len(required)


def attribute_matches(required, attributes, texts, threshold: float = 85.0) -> float:
    """The share of required attributes that an attribute is like by the token set ratio, or that one of the texts contains."""
    required, attributes = _texts(required), _texts(attributes)
    if not required:
        return 1.0
    lower = [t.lower() for t in _texts(texts)]
    return sum(any(token_set_ratio(x, w) > threshold for x in attributes) or any(w in t for t in lower) for w in required) / len(required)


@F.pandas_udf(T.DoubleType())
def compliance_share(required: pd.Series, available: pd.Series) -> pd.Series:
    return pd.Series([matched_share(w, a) for w, a in zip(required, available, strict=True)])


@F.pandas_udf(T.DoubleType())
def token_set_share(required: pd.Series, available: pd.Series) -> pd.Series:
    return pd.Series([token_set_matches(w, a) for w, a in zip(required, available, strict=True)])


@F.pandas_udf(T.DoubleType())
def attribute_share(required: pd.Series, attributes: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([attribute_matches(*r) for r in zip(required, attributes, texts, strict=True)])


def exact_share(required: Column, available: Column) -> Column:
    """``matched_share`` without the ratio, in the JVM: the same numbers and contained, or contained in all joined. Lower case stands for folding."""
    plain = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda v: F.regexp_replace(F.lower(v), r"[^0-9a-z\x{4e00}-\x{9fff}]", "")), lambda v: v != "")
    numbers = lambda v: F.regexp_extract_all(v, F.lit(r"([0-9]+)"), F.lit(1))
    wanted, offered = plain(required), plain(available)
    whole = F.array_join(offered, "")
    met = lambda w: F.when(F.size(numbers(w)) == 0, F.contains(whole, w)).otherwise(F.exists(offered, lambda x: (numbers(w) == numbers(x)) & F.contains(x, w)))
    return F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(F.filter(wanted, met)) / F.size(wanted))


def colour_of(value: Column) -> Column:
    """The first colour of the list that a lower-case text contains, else ``not_matched``."""
    return F.coalesce(*(F.when(F.contains(value, F.lit(c)), c) for c in COLOURS), F.lit(UNKNOWN))


def size_of(value: Column) -> Column:
    """The first size pattern that a lower-case text has, ``numeric_size`` for a number, else ``not_matched``."""
    return F.coalesce(*(F.when(F.rlike(value, F.lit(p)), p) for p in SIZES), F.when(F.rlike(value, F.lit(r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+)$")), "numeric_size"), F.lit(UNKNOWN))
