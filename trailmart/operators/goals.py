"""Goals and training rows: what a task asks for, as structures and as JSON text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.traces import INSTRUCTION, control_block
from .sampling import weighted_draw

# The tools of an agent.
TOOLS = ("search", "click")


def goal(rows: DataFrame, key: str, name: str = "name", attributes: str = "attributes", options: str | None = None, instruction: str = "instruction") -> DataFrame:
    """(key, asin, category, name, instruction_text, attributes[, goal_options]) with missing texts as '' and attributes as JSON text.

    ``options``, if given, names the column of wanted options.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    more = [] if options is None else [F.to_json(F.coalesce(options, F.array().cast("array<string>"))).alias("goal_options")]
    return rows.select(key, "asin", text("category").alias("category"), text(name).alias("name"), F.col(instruction).alias("instruction_text"), F.to_json(attributes).alias("attributes"), *more)


def chosen_goals(goals: DataFrame, key: str, keep: Callable[[DataFrame], Column] | None = None, limit: int | None = None, weight: str | None = None, seed: int = 42) -> DataFrame:
    """Goals that a caller's test keeps; with ``limit`` so many of them, drawn by weight (1 if there is none)."""
    kept = goals if keep is None else goals.filter(keep(goals))
    if limit is None:
        return kept
    weighed = kept.withColumn("_weight", F.lit(1.0) if weight is None else F.col(weight))
    return weighted_draw(weighed, key, "_weight", limit, seed).drop("_weight")


def first_message(instruction: Column) -> Column:
    """What the user says at first: the instruction and the controls of the start page."""
    return F.concat(F.lit(INSTRUCTION), instruction, control_block(F.lit(True), F.array().cast("array<string>")))


def training_row(goals: DataFrame, prompt: str, key: str = "task_id", source: str = "shopping", agent: str = "tool_agent", ability: str = "shopping") -> DataFrame:
    """(key, data_source, agent_name, prompt, ability, ground_truth, extra_info) of each goal; the truth is JSON text.

    ``source``, ``agent`` and ``ability`` are the names by which a trainer finds its reward and its agent.
    """
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    fields = [F.col(c) for c in goals.columns if c not in (key, "attributes", "goal_options")]
    lists = [F.from_json(c, "array<string>").alias(c) for c in ("attributes", "goal_options") if c in goals.columns]
    truth = F.to_json(F.struct(F.col(key).alias("task_id"), F.struct(*fields, *lists).alias("goal")))
    extra = F.struct(F.col(key).alias("index"), F.col(key).alias("task_id"), F.lit(True).alias("need_tools_kwargs"), F.array(*map(F.lit, TOOLS)).alias("tool_selection"))
    return goals.select(
        key, F.lit(source).alias("data_source"), F.lit(agent).alias("agent_name"), F.array(message("system", F.lit(prompt)), message("user", first_message(F.col("instruction_text")))).alias("prompt"),
        F.lit(ability).alias("ability"), truth.alias("ground_truth"), extra.alias("extra_info"),
    )


def present(column: str) -> Column:
    """A structure as JSON text with only the fields it has; null for null."""
    return F.to_json(column)


def without_weights(details: Column) -> Column:
    """A map of scores without the keys of weights, which begin with w_."""
    return F.map_filter(details, lambda k, _: ~F.startswith(k, F.lit("w_")))


def start_payload(goals: DataFrame, key: str, persona: str | None = None) -> DataFrame:
    """(key, payload): what a new episode begins with, as JSON text; the persona only where it is known."""
    more = [] if persona is None else [F.col(persona).alias("user_persona")]
    return goals.select(key, F.to_json(F.struct(first_message(F.col("instruction_text")).alias("instruction"), F.lit(False).alias("done"), F.lit(0.0).alias("reward"), F.col(key).alias("idx"), *more)).alias("payload"))


def observation_text(parts: Column, rich: bool = False) -> Column:
    """The text of a page from its parts (text, button): visible texts with separators, buttons marked if ``rich``."""
    shown = F.transform(parts, lambda p: F.when(p["button"] & F.lit(rich), F.concat(F.lit("[button] "), p["text"], F.lit(" [button_]"))).otherwise(p["text"]))
    return F.array_join(F.filter(shown, lambda s: F.trim(s) != ""), " [SEP] ")


def shortened(text: Column, size: int = 100) -> Column:
    """The first characters of a text, for lists."""
    return F.substring(text, 1, size)


def zip_rows(left: Column, right: Column, names: tuple[str, str]) -> Column:
    """Two arrays by position as an array of pairs; null where they differ in length."""
    pairs = F.zip_with(left, right, lambda a, b: F.struct(a.alias(names[0]), b.alias(names[1])))
    return F.when(F.size(left) == F.size(right), pairs)
