"""Checks of trajectories over their messages: one row in, the reasons for rejection and the metrics out.

A trajectory is a row with an ordered array of messages. Every check is a higher-order function over that array, so
neighbouring messages are found by their place and nothing is shuffled. A null conversation has no messages.
Reasons are distinct and without an order; a trajectory is accepted if it has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import traces
from .conversations import LEAK_MARKS, once

# Tools with the argument they need, and marks of results that only the last tool message may hold.
TOOLS = {"search": "keywords", "click": "value"}
RESULT_MARKS = ("Reward Details [SEP]", "Target [SEP] asin")
PARTS = ("r_att", "r_option", "r_price", "r_type")


def when(condition: Column, reason: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), reason)


def reasons(*found: Column) -> Column:
    return F.array_compact(F.array(*found))


def identity(task: Column, low: int | None = None, high: int | None = None, expected: Column | None = None) -> Column:
    """The task lies in [low, high), and is the one expected."""
    inside = F.lit(True) if low is None else task >= low
    inside = inside if high is None else inside & (task < high)
    return reasons(when(~F.coalesce(inside & task.isNotNull(), F.lit(False)), "task_not_in_train_range"), *([] if expected is None else [when(~task.eqNullSafe(expected), "trajectory_task_id_mismatch")]))


def bare_values(values: Column) -> Column:
    """Letters and digits of option values, case and width ignored, in order."""
    plain = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.collate(F.regexp_replace(F.lower(v), r"[^\p{L}\p{N}]", ""), "UNICODE_CI"))
    return F.array_sort(plain)


def outcome(reward: Column, detail: Column, goal: Column, purchase: Column) -> Column:
    """Full marks, the wanted item, and exactly the wanted options."""
    one = lambda c: F.coalesce(c.cast("double") == 1, F.lit(False))
    return reasons(
        when(~one(reward), "reward_not_one"), when(F.coalesce(goal["asin"], F.lit("")) == "", "asin_mismatch"), when(~purchase["asin"].eqNullSafe(goal["asin"]), "asin_mismatch"),
        *(when(~one(detail[k]), f"{k}_not_full") for k in PARTS),
        when(bare_values(goal["goal_options"]) != bare_values(F.map_values(purchase["options"])), "exact_options_mismatch"),
    )


def diagnostics(row: Column, diag: Column, model: str | None = None, run: Column | None = None) -> Column:
    """What a diagnostics record says against its trajectory; ``diag`` is null where it is missing."""
    differs = lambda a, b: ~a.eqNullSafe(b)
    # a summary may leave fields out, but must not contradict
    against = lambda whole, summary, keys: F.exists(F.array(*(summary[k].isNotNull() & differs(F.to_json(F.struct(summary[k])), F.to_json(F.struct(whole[k]))) for k in keys)), lambda x: x)
    usual = F.coalesce(diag["termination_reason"] == "purchase", F.lit(False)) & F.coalesce(diag["completed_purchase"], F.lit(False))
    return reasons(
        when(diag.isNull(), "missing_diagnostics"), when(differs(diag["task_id"], row["task_id"]), "diagnostics_task_id_mismatch"), when(differs(diag["reward"], row["reward"]), "diagnostics_reward_mismatch"),
        when(differs(diag["reward_detail"], row["reward_detail"]), "diagnostics_reward_detail_mismatch"),
        when(diag["goal_summary"].isNull(), "missing_diagnostics_goal"), when(against(row["goal"], diag["goal_summary"], ("asin", "goal_options")), "diagnostics_goal_mismatch"),
        when(diag["purchase_summary"].isNull(), "missing_diagnostics_purchase"), when(against(row["purchase"], diag["purchase_summary"], ("asin", "options")), "diagnostics_purchase_mismatch"),
        *([] if model is None else [when(differs(diag["model_name"], F.lit(model)), "teacher_model_mismatch")]),
        when(differs(diag["thinking"], F.lit("enabled")), "teacher_thinking_not_enabled"),
        *([] if run is None else [when(differs(diag["run_name"], run), "diagnostics_rollout_mismatch")]),
        when(~usual, "not_completed_by_purchase"), when(F.coalesce(diag["invalid_tool_response_count"], F.lit(0)) != 0, "hidden_tool_retry"), when(F.size(F.coalesce(diag["tool_errors"], F.array())) > 0, "tool_error"),
    )


def shape(messages: Column, prompt_hash: str | None = None, instruction_hash: Column | None = None) -> Column:
    """System, user, then assistant and tool in turn to the end; the prompt and the instruction as expected."""
    roles = F.transform(messages, lambda m: m["role"])
    wanted = F.transform(messages, lambda _, i: F.when(i == 0, "system").when(i == 1, "user").when(i % 2 == 0, "assistant").otherwise("tool"))
    last = F.try_element_at(roles, F.lit(-1))
    count = lambda role: F.size(F.filter(roles, lambda r: r == role))
    first = lambda i: F.coalesce(F.get(messages, F.lit(i))["content"], F.lit(""))
    return reasons(
        when(F.size(messages) == 0, "missing_conversation"), when(~roles.eqNullSafe(wanted) | ~last.eqNullSafe(F.lit("tool")), "invalid_conversation_role_sequence"),
        when((count("system") != 1) | (count("user") != 1), "not_single_turn_conversation"), when(F.exists(messages, lambda m: m.isNull()), "non_object_message"),
        *([] if prompt_hash is None else [when((F.size(messages) > 0) & (F.sha2(first(0), 256) != prompt_hash), "system_prompt_mismatch")]),
        *([] if instruction_hash is None else [when((F.size(messages) > 1) & ~traces.instruction_hash(first(1)).eqNullSafe(instruction_hash), "instruction_task_mismatch")]),
    )


def _calls(messages: Column) -> Column:
    """What each assistant message asks for, with its neighbours."""
    at = F.transform(messages, lambda m, i: F.struct(m.alias("m"), F.get(messages, i - 1).alias("before"), F.get(messages, i + 1).alias("after")))
    asked = F.filter(at, lambda x: x["m"]["role"] == "assistant")
    return F.transform(asked, lambda x: F.struct(
        F.coalesce(F.array_size(x["m"]["tool_calls"]), F.lit(0)).alias("calls"), F.get(x["m"]["tool_calls"], F.lit(0)).alias("call"),
        F.try_parse_json(F.get(x["m"]["tool_calls"], F.lit(0))["function"]["arguments"]).alias("arguments"),
        F.coalesce(x["before"]["role"].isin("user", "tool"), F.lit(False)).alias("has_state"), x["before"]["content"].alias("state"),
        F.coalesce(x["after"]["role"] == "tool", F.lit(False)).alias("has_response"), x["after"]["tool_call_id"].alias("response_id"),
    ))


def _read(calls: Column) -> Column:
    """The same with the name, the needed argument, the state's controls, and the first check that fails, if any."""

    def one(x: Column) -> Column:
        name, arguments = x["call"]["function"]["name"], x["arguments"]
        whole = F.endswith(F.rtrim(x["call"]["function"]["arguments"]), F.lit("}"))  # the parser stops at the end of the value
        is_object = F.coalesce(F.startswith(F.schema_of_variant(arguments), F.lit("OBJECT")) & whole, F.lit(False))
        needed = lambda key: F.when(F.schema_of_variant(F.try_variant_get(arguments, f"$.{key}", "variant")) == "STRING", F.try_variant_get(arguments, f"$.{key}", "string"))
        argument = F.when(is_object, F.when(name == "search", needed(TOOLS["search"])).when(name == "click", needed(TOOLS["click"])))
        stop = (
            F.when(x["calls"] != 1, "assistant_not_exactly_one_tool").when(x["call"].isNull(), "invalid_tool_call_object").when(~F.coalesce(name.isin(*TOOLS), F.lit(False)), "unsupported_tool")
            .when(~is_object, "invalid_tool_arguments").when(F.coalesce(F.trim(argument), F.lit("")) == "", "missing_required_tool_argument")
        )
        state = F.when(x["has_state"], F.coalesce(x["state"], F.lit(""))).otherwise("")
        return F.struct(
            stop.alias("stop"), F.when((x["calls"] == 1) & x["call"].isNotNull(), F.coalesce(x["call"]["id"], F.lit(""))).alias("id"), name.alias("name"), argument.alias("argument"), state.alias("state"),
            traces.search_available(state).alias("search"), traces.clickables(state).alias("buttons"), x["has_state"].alias("has_state"), x["has_response"].alias("has_response"),
            (~x["response_id"].eqNullSafe(x["call"]["id"])).alias("other_id"), F.concat(name, F.lit("\u0001"), F.to_json(arguments)).alias("signature"),
        )

    return F.transform(calls, one)


def _wrong(x: Column) -> Column:
    """Reasons against one read call; those after a failed first check do not apply."""
    fine = x["stop"].isNull()
    readable = x["search"].isNotNull() & x["buttons"].isNotNull()
    offered = F.exists(x["buttons"], lambda b: F.collate(F.trim(b), "UNICODE_CI") == F.trim(x["argument"]))
    return reasons(
        x["stop"], when(x["id"] == "", "missing_tool_call_id"), when(fine & ~x["has_state"], "missing_preceding_state"), when(fine & ~readable, "unparseable_state_controls"),
        when(fine & readable & (x["name"] == "search") & ~x["search"], "search_when_unavailable"), when(fine & readable & (x["name"] == "click") & ~offered, "click_not_available"),
        when(fine & ~x["has_response"], "missing_tool_response"), when(fine & x["has_response"] & x["other_id"], "tool_call_id_mismatch"),
    )


def repeats(values: Column) -> Column:
    return F.size(values) - F.size(F.array_distinct(values))


def leakage(messages: Column) -> Column:
    """Marks of labels in what the model was shown at first, and of results in any tool message but the last."""
    holds = lambda m, marks: F.exists(F.array(*(F.contains(F.coalesce(m["content"], F.lit("")), F.lit(k)) for k in marks)), lambda x: x)
    early = F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))
    return reasons(
        when(F.exists(messages, lambda m: m["role"].isin("system", "user") & holds(m, LEAK_MARKS)), "privileged_label_leak"),
        when(F.exists(early, lambda m: (m["role"] == "tool") & holds(m, RESULT_MARKS)), "privileged_observation_leak"),
    )


def verify_messages(trajectories: DataFrame, key: str, messages: str = "conversation", prompt_hash: str | None = None, instruction_hash: Column | None = None) -> DataFrame:
    """(key, reasons, num_tool_calls, repeated_action_count): the checks of shape, of every action, and of leaks."""
    known = F.coalesce(F.col(messages), F.from_json(F.lit("[]"), trajectories.schema[messages].dataType))
    read = once(once(trajectories, "_m", known), "_a", _read(_calls(F.col("_m"))))
    acted = F.filter("_a", lambda x: x["stop"].isNull())
    ids = F.filter(F.transform("_a", lambda x: x["id"]), lambda i: i != "")
    pairs = F.transform(acted, lambda x: F.concat(F.sha2(x["state"], 256), x["signature"]))
    found = F.concat(
        shape(F.col("_m"), prompt_hash, instruction_hash), F.flatten(F.transform("_a", _wrong)), leakage(F.col("_m")),
        reasons(when(repeats(ids) > 0, "duplicate_tool_call_id"), when(repeats(pairs) > 0, "repeated_state_action_loop"), when(F.size(acted) == 0, "no_actions")),
    )
    signatures = F.transform(acted, lambda x: x["signature"])
    return read.select(*([key] if isinstance(key, str) else key), F.array_distinct(found).alias("reasons"), F.size(acted).alias("num_tool_calls"), repeats(signatures).alias("repeated_action_count"))


def action_statistics(trajectories: DataFrame, key: str, messages: str = "conversation") -> DataFrame:
    """(key, searches, clicks, distinct_actions, repeated): what was done, repeats counted over the whole conversation."""
    base = once(trajectories, "a", F.filter(_read(_calls(F.col(messages))), lambda x: x["stop"].isNull()))
    named = lambda n: F.size(F.filter("a", lambda x: x["name"] == n))
    signatures = F.transform("a", lambda x: x["signature"])
    return base.select(key, named("search").alias("searches"), named("click").alias("clicks"), F.size(F.array_distinct(signatures)).alias("distinct_actions"), repeats(signatures).alias("repeated"))
