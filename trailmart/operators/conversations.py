"""Messages of conversations: lengths, order, masks and export.

A conversation is an ordered array of messages (role, content). Work that needs neighbours uses
higher-order functions within the row where that is enough, so a conversation is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import traces

CALLS = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
# Prefixes of roles in chat texts, and marks that must not reach a training sample.
ROLES = {"用户：": "user", "客服：": "assistant", "User: ": "user", "Agent: ": "assistant"}
LEAK_MARKS = ('"reward_detail"', '"goal_options"', '"price_upper"', "正确答案是", "目标商品ASIN")
IGNORE = -100


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once per row: the optimiser does not copy it into later expressions and their lambdas."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def from_chat(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, messages): the messages of a chat text in order; each begins with a line that names a role.

    Lines without a role belong to the message before them; those before the first role, and texts without one, are left out.
    """
    named = "|".join(ROLES)
    parts = F.filter(F.split(text, f"(?md)^(?={named})"), lambda p: F.rlike(p, F.lit(f"^(?:{named})")))
    role = lambda p: F.coalesce(*(F.when(F.startswith(p, F.lit(k)), F.lit(r)) for k, r in ROLES.items()))
    messages = F.transform(parts, lambda p: F.struct(role(p).alias("role"), F.regexp_replace(p, rf"^(?:{named})|\n\z", "").alias("content")))
    return docs.filter(F.col(text).isNotNull()).select(key, messages.alias("messages")).filter(F.size("messages") > 0)


def from_trace(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, conversation): the log of an agent as messages: each line of an action is a tool call, what lies between is a state.

    The first state is the user's, later ones are tool messages. Texts without an action are left out.
    """
    lines = F.regexp_extract_all(text, F.lit(traces.ACTION_LINE), F.lit(0))
    states = F.transform(F.split(text, traces.ACTION_LINE), lambda s: F.regexp_replace(s, r"\A\n|\n\z", ""))
    rows = once(docs.filter(F.rlike(text, F.lit(traces.ACTION_LINE))), "_log", F.struct(lines.alias("lines"), states.alias("states"))).select(key, F.col("_log.lines").alias("_lines"), F.col("_log.states").alias("_states"))

    def message(role, content, call_id=None, calls=None):
        none = F.lit(None)
        return F.struct(role.alias("role"), content.alias("content"), none.cast("string").alias("reasoning_content"), (none.cast("string") if call_id is None else call_id).alias("tool_call_id"), (F.from_json(F.lit(None).cast("string"), CALLS) if calls is None else calls).alias("tool_calls"))

    def call(line, i):
        tool, argument = traces.logged_tool(line), traces.logged_argument(line)
        arguments = F.when(tool == "search", F.to_json(F.struct(argument.alias("keywords")))).otherwise(F.to_json(F.struct(argument.alias("value"))))
        return F.array(F.struct(F.concat(F.lit("call_"), i).alias("id"), F.lit("function").alias("type"), F.struct(tool.alias("name"), arguments.alias("arguments")).alias("function")))

    start = F.array(message(F.lit("system"), F.lit("")), message(F.lit("user"), F.get("_states", F.lit(0))))
    turns_ = F.flatten(F.transform("_lines", lambda x, i: F.array(message(F.lit("assistant"), F.lit(""), calls=call(x, i)), message(F.lit("tool"), F.coalesce(F.get("_states", i + 1), F.lit("")), call_id=F.concat(F.lit("call_"), i)))))
    return once(rows, "conversation", F.concat(start, turns_)).select(key, "conversation")


def is_role(m: Column, role: str) -> Column:
    return m["role"] == role


def turns(messages: Column, role: str = "assistant") -> Column:
    return F.size(F.filter(messages, lambda m: is_role(m, role)))


def longest_prefix(messages: Column, role: str = "assistant") -> Column:
    """Characters of all messages before the last message of ``role``: the longest context it was given."""
    step = lambda acc, m: F.struct((acc["before"] + F.length(m["content"])).alias("before"), F.when(is_role(m, role), acc["before"]).otherwise(acc["most"]).alias("most"))
    start = F.struct(F.lit(0).alias("before"), F.lit(None).cast("int").alias("most"))
    return F.aggregate(messages, start, step, lambda acc: acc["most"])


def order_errors(messages: Column) -> Column:
    """Names of what is wrong with the order of the roles."""
    n = F.size(messages)
    neighbours = F.zip_with(F.slice(messages, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(messages, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a["role"] == b["role"])
    return F.array_compact(
        F.array(
            F.when(F.element_at(messages, 1)["role"] != "user", "does_not_begin_with_user"),
            F.when(F.element_at(messages, -1)["role"] != "assistant", "does_not_end_with_assistant"),
            F.when(F.exists(neighbours, lambda x: x), "role_repeats"),
            F.when(F.exists(messages, lambda m: F.trim(m["content"]) == ""), "empty_content"),
        )
    )


def leaks(c: Column) -> Column:
    found = F.lit(False)
    for mark in LEAK_MARKS:
        found = found | F.contains(c, F.lit(mark))
    return found


def export(conversations: DataFrame, key: str) -> DataFrame:
    """(key, sample): chats as JSON text; the content of a last message that ends the episode is cleared.

    Conversations with a leak mark or an empty assistant message are not exported.
    """
    kept = conversations.filter(~F.exists("messages", lambda m: leaks(m["content"]) | (is_role(m, "assistant") & (F.trim(m["content"]) == ""))))
    n = F.size("messages")
    shown = F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), F.when((i == n - 1) & is_role(m, "tool"), "").otherwise(m["content"]).alias("content")))
    return kept.select(key, F.to_json(F.struct(shown.alias("messages"))).alias("sample"))


def export_samples(trajectories: DataFrame, key: str, tools: str = "[]", reasoning: bool = False, messages: str = "conversation") -> DataFrame:
    """(key, sample): tool-calling samples as JSON text with ``messages`` and ``tools`` only.

    Assistant messages keep their call, its arguments as an object; their text and reasoning stay only with ``reasoning``.
    The last tool message is emptied, as it holds the result.
    """
    n = F.size(messages)
    none = F.lit(None).cast("string")

    def one(m: Column, i: Column) -> Column:
        by = is_role(m, "assistant")
        content = F.when(by, F.coalesce(m["content"], F.lit("")) if reasoning else F.lit("")).when(is_role(m, "tool") & (i == n - 1), "").otherwise(F.coalesce(m["content"], F.lit("")))
        calls = F.transform(m["tool_calls"], lambda c: F.struct(c["id"].alias("id"), F.lit("function").alias("type"), F.struct(c["function"]["name"].alias("name"), F.try_parse_json(c["function"]["arguments"]).alias("arguments")).alias("function")))
        return F.struct(m["role"].alias("role"), content.alias("content"), (F.when(by, m["reasoning_content"]) if reasoning else none).alias("reasoning_content"), F.when(is_role(m, "tool"), m["tool_call_id"]).alias("tool_call_id"), F.when(by, calls).alias("tool_calls"))

    return trajectories.select(key, F.to_json(F.struct(F.transform(messages, one).alias("messages"), F.parse_json(F.lit(tools)).alias("tools"))).alias("sample"))


SAMPLE = f"messages array<struct<role:string,content:string,reasoning_content:string,tool_call_id:string,tool_calls:{CALLS}>>"


def sample_errors(samples: DataFrame, key: str, reasoning: bool = False) -> DataFrame:
    """(key, errors): what keeps an exported JSON sample out of training; the array is empty for a good one."""
    parsed = F.from_json("sample", SAMPLE)["messages"]
    any_of = lambda test: F.coalesce(F.exists(parsed, test), F.lit(False))
    assistant = lambda test: any_of(lambda m: is_role(m, "assistant") & test(m))
    calls = lambda m: F.coalesce(F.array_size(m["tool_calls"]), F.lit(0))
    arguments = lambda m: F.get(m["tool_calls"], F.lit(0))["function"]["arguments"]
    found = [
        F.when(~F.array_sort(F.json_object_keys("sample")).eqNullSafe(F.array(F.lit("messages"), F.lit("tools"))), "keys"), F.when(F.coalesce(F.array_size(parsed), F.lit(0)) == 0, "no_messages"),
        F.when(any_of(lambda m: is_role(m, "tool") & (F.contains(m["content"], F.lit("Reward Details [SEP]")) | F.contains(m["content"], F.lit("Target [SEP] asin")))), "result_leak"),
        F.when(assistant(lambda m: calls(m) != 1), "not_one_call"), F.when(assistant(lambda m: ~F.coalesce(F.startswith(F.trim(arguments(m)), F.lit("{")), F.lit(False))), "arguments_no_object"),
    ]
    if not reasoning:
        found += [F.when(assistant(lambda m: ~F.coalesce(m["content"] == "", F.lit(False))), "assistant_text"), F.when(any_of(lambda m: m["reasoning_content"].isNotNull()) | F.contains("sample", F.lit("<think>")), "reasoning_leak")]
    return samples.select(key, F.array_compact(F.array(*found)).alias("errors"))


def sample_counts(samples: DataFrame) -> DataFrame:
    """One row: samples, and actions of assistants in them."""
    actions = F.size(F.filter(F.from_json("sample", SAMPLE)["messages"], lambda m: is_role(m, "assistant")))
    return samples.agg(F.count("*").alias("rows"), F.coalesce(F.sum(actions), F.lit(0)).alias("assistant_actions"))


def action_only_errors(messages: Column) -> Column:
    """Why messages are not those of actions only: reasoning, text or no call in an assistant's message."""
    by = lambda test: F.exists(messages, lambda m: is_role(m, "assistant") & F.coalesce(test(m), F.lit(False)))
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.array_compact(F.array(F.when(by(lambda m: filled(m["reasoning_content"])), "reasoning"), F.when(by(lambda m: filled(m["content"])), "text"), F.when(by(lambda m: F.coalesce(F.array_size(m["tool_calls"]), F.lit(0)) == 0), "no_call")))


def without_block(conversations: DataFrame, block: str, messages: str = "messages") -> tuple[DataFrame, DataFrame]:
    """The conversations without a block of their system message, and those that do not have exactly one such message with it exactly once."""
    systems = F.filter(messages, lambda m: is_role(m, "system"))
    content = F.get(systems, F.lit(0))["content"]
    times = (F.length(content) - F.length(F.replace(content, F.lit(block), F.lit("")))) / len(block)
    fine = F.coalesce((F.size(systems) == 1) & (times == 1), F.lit(False))
    cleaned = lambda m: F.concat(F.rtrim(F.replace(m["content"], F.lit(block), F.lit(""))), F.lit("\n"))
    rewritten = F.transform(messages, lambda m: m.withField("content", F.when(is_role(m, "system"), cleaned(m)).otherwise(m["content"])))
    return conversations.filter(fine).withColumn(messages, rewritten), conversations.filter(~fine)


def label_masks(conversations: DataFrame, key: str, longest: int | None = None, pad_to: int = 8) -> DataFrame:
    """(key, input_ids, labels, attention_mask): only assistant characters are learnt.

    Ids are code points; ``masks.encode_labelled`` takes a tokenizer. Whole conversations are masked, cut
    at ``longest`` if it is given, and padded to a multiple of ``pad_to``.
    """
    chars = lambda s: F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c))
    parts = F.transform("messages", lambda m: F.transform(chars(m["content"]), lambda i: F.struct(i.alias("id"), F.when(is_role(m, "assistant"), i).otherwise(IGNORE).alias("label"))))
    whole = F.flatten(parts)
    flat = once(conversations, "t", whole if longest is None else F.slice(whole, 1, longest))
    room = F.pmod(-F.size("t"), F.lit(pad_to))
    padded = lambda field, value: F.concat(F.transform("t", lambda x: x[field]), F.array_repeat(F.lit(value), room))
    return flat.select(key, padded("id", 0).alias("input_ids"), padded("label", IGNORE).alias("labels"), F.concat(F.transform("t", lambda x: F.lit(1)), F.array_repeat(F.lit(0), room)).alias("attention_mask"))


def mask_stats(masks: DataFrame) -> DataFrame:
    learnt = F.size(F.filter("labels", lambda x: x != IGNORE))
    return _totals(masks, learnt, _attended(), F.size("labels"))


def mask_totals(masks: DataFrame, limit: int) -> DataFrame:
    """The same of masks over whole conversations, with the samples longer than ``limit`` and their tokens beyond it."""
    learnt = F.size(F.filter("labels", lambda x: x != IGNORE))
    return length_totals(masks.select(_attended().alias("tokens"), learnt.alias("trained")), limit)


def length_totals(lengths: DataFrame, limit: int, pad_to: int = 8) -> DataFrame:
    """Totals of (tokens, trained) of whole samples; nothing is cut, what a cut at ``limit`` would lose is counted."""
    padded = F.col("tokens") + F.pmod(-F.col("tokens"), F.lit(pad_to))
    over = F.count_if(F.col("tokens") > limit).alias("samples_over"), F.sum(F.greatest(F.col("tokens") - limit, F.lit(0))).alias("tokens_over")
    return _totals(lengths, F.col("trained"), F.col("tokens"), padded, *over)


def _attended() -> Column:
    return F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)


def _totals(df: DataFrame, trained: Column, tokens: Column, padded: Column, *more: Column) -> DataFrame:
    out = df.agg(F.count("*").alias("samples"), F.sum(trained).alias("trained"), F.sum(tokens).alias("tokens"), F.sum(padded).alias("padded"), *more)
    return out.withColumn("fraction", F.round(F.col("trained") / F.nullif(F.col("tokens"), F.lit(0)), 6))
