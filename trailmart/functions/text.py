"""Text functions as Spark expressions; Python only where Spark has no Unicode normalisation."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Chinese characters and Latin words of a search text.
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+"
WORD = r"[a-z0-9]+(?:[._+\-/][a-z0-9]+)*"
#: The same in Python's writing.
HAN_RUNS, WORDS = re.compile(r"[\u3400-\u4dbf\u4e00-\u9fff]+"), re.compile(WORD)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def nfkc_casefold(values: pd.Series) -> pd.Series:
    """Compatibility form and case folding of a text, an Arrow batch at a time. Null stays null."""
    return values.map(lambda v: unicodedata.normalize("NFKC", v).casefold(), na_action="ignore")


def one_tag(c: Column | str) -> Column:
    """A tag in one writing: without white space around it, lower case."""
    return F.lower(F.regexp_replace(col(c), r"^[\s\x0b\p{Z}]+|[\s\x0b\p{Z}]+$", ""))


def query_text(c: Column | str, fold=F.lower) -> Column:
    """A search text: folded, currency words as one sign, separators as single spaces.

    ``fold`` is ``F.lower`` (stays in the JVM) or ``nfkc_casefold``.
    """
    s = fold(F.coalesce(col(c), F.lit("")))
    s = F.regexp_replace(F.regexp_replace(s, "人民币|块钱", "元"), r"([0-9])\s*(?:rmb|cny|yuan)\b", "$1元")
    return F.trim(F.regexp_replace(s, r"[\s,，。;；:：!！?？、|]+", " "))


def search_tokens(c: Column | str, fold=F.lower) -> Column:
    """Distinct tokens: pairs of neighbouring Chinese characters (or the single one), then Latin words and numbers."""
    s = query_text(c, fold)
    runs = F.regexp_extract_all(s, F.lit(f"({HAN})"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    return F.array_distinct(F.concat(pairs, F.regexp_extract_all(s, F.lit(f"({WORD})"), F.lit(1))))


@lru_cache(1 << 14)
def tokens_of(text: str) -> tuple[str, ...]:
    """``search_tokens`` of a text that ``query_text`` made, in Python, for tables where the expression's many passes cost too much."""
    pairs = [p for run in HAN_RUNS.findall(text) for p in ([run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)])]
    return tuple(dict.fromkeys(pairs + WORDS.findall(text)))


@F.pandas_udf(T.StringType())
def joined_models(texts: pd.Series) -> pd.Series:
    """``model_numbers`` of texts that ``query_text`` made, joined by spaces."""
    return texts.map(lambda v: " ".join(t for t in tokens_of(v) if re.search("[a-z]", t) and re.search("[0-9]", t)))


def word_sequence(c: Column | str, fold=F.lower) -> Column:
    """Words in order, repeats included: Latin words and numbers, and runs of Chinese characters."""
    return F.regexp_extract_all(query_text(c, fold), F.lit(f"({HAN}|{WORD})"), F.lit(1))


def model_numbers(c: Column | str) -> Column:
    """Tokens with both letters and digits."""
    return F.filter(search_tokens(c), lambda t: t.rlike("[a-z]") & t.rlike("[0-9]"))


def token_overlap(wanted: Column | str, other: Column | str, tokens=search_tokens) -> Column:
    """The share of a text's tokens that another has; a fifth if it has none. ``tokens`` may be any extractor of an array of words."""
    w, o = tokens(wanted), tokens(other)
    return F.when(F.size(w) == 0, 0.2).otherwise(F.size(F.array_intersect(w, o)) / F.size(w))


def letters_and_digits(c: Column | str, fold=F.lower) -> Column:
    """The text without anything but letters and digits."""
    return F.regexp_replace(fold(col(c)), r"[^\p{L}\p{N}]", "")


def click_value(c: Column | str) -> Column:
    """Folded and trimmed, with its punctuation."""
    return F.trim(nfkc_casefold(col(c)))


def path_parts(c: Column | str) -> Column:
    """The parts of a category path between its usual separators."""
    return F.filter(F.transform(F.split(col(c), "[›>/]+"), lambda p: F.trim(p)), lambda p: p != "")


def numbers(c: Column | str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1))


def long_ids(c: Column | str) -> Column:
    """Distinct runs of 10 to 20 digits."""
    runs = F.regexp_extract_all(col(c), F.lit(r"([0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(runs, lambda r: F.length(r).between(10, 20)))


def option_value(c: Column | str) -> Column:
    return F.lower(F.replace(F.trim(col(c)), F.lit("/"), F.lit(" | ")))


def short_code(c: Column | str) -> Column:
    """Ten characters that stand for a text."""
    return F.substring(F.upper(F.sha1(col(c))), 1, 10)


# DuckDB macros with the meaning of the functions above, for the checking SQL.
SQL_MACROS = {
    "query_text": r"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '人民币|块钱', '元', 'g'), '([0-9])\s*(?:rmb|cny|yuan)\b', '\1元', 'g'), '[\s,，。;；:：!！?？、|]+', ' ', 'g'))",
}


def sql_words(c: str) -> str:
    """DuckDB SQL of ``word_sequence``."""
    return f"regexp_extract_all({SQL_MACROS['query_text'].format(c)}, '{HAN}|{WORD}')"


def sql_tokens(c: str) -> str:
    """DuckDB SQL of ``search_tokens``; the order of the tokens is not kept."""
    s = SQL_MACROS["query_text"].format(c)
    han, word = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+", r"[a-z0-9]+(?:[._+\-/][a-z0-9]+)*"
    pairs = f"flatten(list_transform(regexp_extract_all({s}, '{han}'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END))"
    return f"list_distinct(list_concat({pairs}, regexp_extract_all({s}, '{word}')))"
