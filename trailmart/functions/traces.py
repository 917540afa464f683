"""Parsers of agent traces as Spark expressions: actions, control blocks, observations and signatures.

Null texts give null, and a text without what is looked for gives null or an empty array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# How a state names its controls, an instruction and an action, and how actions are written in a log.
SEARCH_FLAG = r"(?i)搜索功能是否可用:\s*(True|False)"
BUTTONS = r"可点击的按钮:\s*(\[[^\n]*\])"
CONTROLS = "\n\n搜索功能是否可用:"
INSTRUCTION, SEPARATOR, ANSWER = "Instruction: ", "[SEP]", "\nAction: "
# What stands around the wish on a start page.
HEADINGS, SEARCH_BUTTON, PRICE = r"(?:amazon shopping game|webshop)\ninstruction:", "\n[button] search [button_]", ", and price lower than"
#: A JSON list of texts and nothing else.
TEXTS = r'^\[\s*(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*(?:,\s*"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*)*+)?\]\s*$'
ACTION_LINE = r"(?md)^(?:search\[[^\]\n]+\][^\n]*|click\[[^\]\n]+\][^\n]*|搜索“[^”\n]+”返回[^\n]*|用户点击了规格“[^”\n]+”[^\n]*)$"


def action_name(action: Column | str) -> Column:
    """The name of an action ``name[argument]``; of anything else the whole text."""
    return F.coalesce(F.nullif(F.regexp_extract(col(action), r"^(.+)\[(.+)\]", 1), F.lit("")), col(action))


def action_argument(action: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(action), r"^(.+)\[(.+)\]", 2), F.lit(""))


def logged_tool(line: Column | str) -> Column:
    """The tool of a logged action: search or click."""
    return F.when(F.rlike(col(line), F.lit("^(?:search|搜索)")), "search").when(F.rlike(col(line), F.lit("^(?:click|用户点击)")), "click")


def logged_argument(line: Column | str) -> Column:
    return F.regexp_extract(col(line), r"^[^\[“]*[\[“]([^\]”]+)", 1)


def search_available(state: Column | str) -> Column:
    """The last search flag of a state."""
    return F.lower(F.try_element_at(F.regexp_extract_all(col(state), F.lit(SEARCH_FLAG), F.lit(1)), F.lit(-1))) == "true"


def clickables(state: Column | str) -> Column:
    """The last list of buttons of a state; null if it is no JSON list of texts."""
    listed = F.try_element_at(F.regexp_extract_all(col(state), F.lit(BUTTONS), F.lit(1)), F.lit(-1))
    return F.when(F.rlike(listed, F.lit(TEXTS)), F.from_json(listed, "array<string>"))


def without_controls(state: Column | str) -> Column:
    """The instruction of a first message: what is before its control block, without its mark."""
    text = F.get(F.split(col(state), CONTROLS, 2), F.lit(0))
    return F.when(F.startswith(text, F.lit(INSTRUCTION)), F.substring(text, F.lit(len(INSTRUCTION) + 1), F.length(text))).otherwise(text)


def instruction_hash(state: Column | str, fold=F.lower) -> Column:
    """sha256 over the letters and digits of an instruction; ``fold`` is ``F.lower`` or ``nfkc_casefold``."""
    return F.sha2(F.regexp_replace(fold(without_controls(state)), r"[^\p{L}\p{N}]", ""), 256)


def observation(page: Column | str) -> Column:
    """An observation from its second separator on, where it begins with the instruction; else as it is."""
    c, mark = col(page), f"{INSTRUCTION}{SEPARATOR}"
    at = F.instr(c, mark)
    rest = F.substring(c, at + len(mark), F.length(c))
    second = F.instr(rest, SEPARATOR)
    return F.when((at > 0) & (second > 0), F.concat(F.lit(SEPARATOR), F.substring(rest, second + len(SEPARATOR), F.length(rest)))).otherwise(c)


def answered_action(answer: Column | str) -> Column:
    """The action that an answer ends with; the whole answer if it names none."""
    return F.when(F.contains(col(answer), F.lit(ANSWER)), F.get(F.split(col(answer), ANSWER), F.lit(1))).otherwise(col(answer))


def control_block(has_search: Column | str, buttons: Column | str) -> Column:
    """The text of the available actions; the search button itself is not listed."""
    listed = F.filter(col(buttons), lambda b: b != "search")
    quoted = F.concat(F.lit("["), F.array_join(F.transform(listed, lambda b: F.concat(F.lit('"'), F.replace(F.replace(b, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))), ", "), F.lit("]"))
    return F.concat(F.lit(CONTROLS + " "), F.when(col(has_search), "True").otherwise("False"), F.lit("\n\n可点击的按钮: "), quoted)


def bare_text(c: Column | str) -> Column:
    """Lower case without quotes and outer white space; the separator keeps its writing."""
    return F.replace(F.trim(F.regexp_replace(F.lower(col(c)), "[\"']", "")), F.lit("[sep]"), F.lit("[SEP]"))


def goal_text(page: Column | str) -> Column:
    """The wish of a start page: lower case, without its heading, its search button and a price condition."""
    s = F.regexp_replace(F.lower(col(page)), "[\"']", "")
    s = F.trim(F.replace(F.regexp_replace(s, HEADINGS, ""), F.lit(SEARCH_BUTTON), F.lit("")))
    return F.get(F.split(s, PRICE, 2), F.lit(0))


def signature(tool: Column | str, arguments: Column | str) -> Column:
    """One text for an action whatever the order and spacing of its JSON arguments; null if they are no JSON."""
    return F.concat(col(tool), F.lit("\u0001"), F.to_json(F.try_parse_json(col(arguments))))


def compact_length(json: Column | str) -> Column:
    """Characters of a JSON text without spaces between its parts; object keys come in order."""
    return F.length(F.to_json(F.try_parse_json(col(json))))
