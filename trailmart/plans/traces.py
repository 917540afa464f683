"""Agent traces and chats: actions, controls, verification, statistics, export and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import traces
from ..operators import conversations as conv
from ..operators import verification as ver
from ..sources import table


def trajectories(spark, sf_dir: str) -> DataFrame:
    """(doc_id, conversation) of each document that logs actions."""
    return conv.from_trace(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def trace_actions(spark, sf_dir: str) -> DataFrame:
    """Each logged action with its place, tool and argument."""
    lines = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(traces.ACTION_LINE), F.lit(0))).alias("place", "line"))
    return lines.select("doc_id", "place", traces.logged_tool("line").alias("tool"), traces.logged_argument("line").alias("argument"))


def trace_controls(spark, sf_dir: str) -> DataFrame:
    """The last search flag and the last buttons of each text that has either."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", traces.search_available("text").alias("search"), F.array_join(traces.clickables("text"), "|").alias("buttons"))
    return d.filter("search IS NOT NULL OR buttons IS NOT NULL")


def trace_reasons(spark, sf_dir: str) -> DataFrame:
    """(doc_id, reason): what verification over the messages finds; one row per reason."""
    return ver.verify_messages(trajectories(spark, sf_dir), "doc_id").select("doc_id", F.explode("reasons").alias("reason"))


def trace_metrics(spark, sf_dir: str) -> DataFrame:
    return ver.verify_messages(trajectories(spark, sf_dir), "doc_id").select("doc_id", "num_tool_calls", "repeated_action_count", (F.size("reasons") == 0).alias("accepted"))


def trace_statistics(spark, sf_dir: str) -> DataFrame:
    return ver.action_statistics(trajectories(spark, sf_dir), "doc_id")


def trace_neighbours(spark, sf_dir: str) -> DataFrame:
    """Each action with the state before it and the response after it, as lengths."""
    m = trajectories(spark, sf_dir).select("doc_id", "conversation", F.posexplode("conversation").alias("i", "m")).filter("m.role = 'assistant'")
    near = lambda d: F.length(F.get("conversation", F.col("i") + d)["content"])
    return m.select("doc_id", ((F.col("i") - 2) / 2).cast("int").alias("place"), near(-1).alias("state_chars"), near(1).alias("response_chars"))


def trace_samples(spark, sf_dir: str) -> DataFrame:
    """Traces exported as tool-calling samples."""
    return conv.export_samples(trajectories(spark, sf_dir), "doc_id")


def trace_sample_counts(spark, sf_dir: str) -> DataFrame:
    return conv.sample_counts(trace_samples(spark, sf_dir))


def trace_sample_errors(spark, sf_dir: str) -> DataFrame:
    """How many exported samples have each error; traces are exported without text and reasoning, so none has one of these."""
    errors = conv.sample_errors(trace_samples(spark, sf_dir), "doc_id")
    return errors.select(F.explode_outer("errors").alias("error")).groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("samples"))


def trace_contexts(spark, sf_dir: str) -> DataFrame:
    """Turns of each trace and the longest context before a turn."""
    t = trajectories(spark, sf_dir)
    return t.select("doc_id", conv.turns(F.col("conversation")).alias("turns"), conv.longest_prefix(F.col("conversation")).alias("longest_context"))


def trace_instructions(spark, sf_dir: str) -> DataFrame:
    """Digest of each instruction that a text states, and how many texts state it."""
    lines = table(spark, sf_dir, "documents", "text").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?md)^(Instruction: [^\n]*)$"), F.lit(1))).alias("line"))
    return lines.groupBy(traces.instruction_hash("line").alias("mark")).agg(F.count("*").alias("uses"))


_LINE = traces.ACTION_LINE.replace("(?md)", "(?m)")
_T = rf"""t AS (SELECT doc_id, regexp_extract_all(text, '{_LINE}') AS lines, list_transform(regexp_split_to_array(text, '{_LINE}'), lambda s: regexp_replace(regexp_replace(s, '\A\n', ''), '\n\z', '')) AS states FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '{_LINE}')),
    a AS (SELECT doc_id, CAST(unnest(range(len(lines))) AS INT) AS place, unnest(lines) AS line, unnest(states[:len(lines)]) AS state, unnest(states[2:]) AS response FROM t),
    x AS MATERIALIZED (SELECT *, CASE WHEN regexp_matches(line, '^(?:search|搜索)') THEN 'search' ELSE 'click' END AS tool, regexp_extract(line, '^[^\[“]*[\[“]([^\]”]+)', 1) AS argument FROM a)"""
_FLAG = r"lower(regexp_extract_all({0}, '(?i)搜索功能是否可用:\s*(True|False)', 1)[-1])"
_BUTTONS = r"TRY_CAST(regexp_extract_all({0}, '可点击的按钮:\s*(\[[^\n]*\])', 1)[-1] AS JSON)"
_LISTED = "(json_type({0}) = 'ARRAY' AND len(list_filter(CAST({0} AS JSON[]), lambda j: json_type(j) <> 'VARCHAR')) = 0)"
_Y = f"""z AS MATERIALIZED (SELECT *, {_FLAG.format('state')} AS flag, {_BUTTONS.format('state')} AS j FROM x),
    y AS MATERIALIZED (SELECT doc_id, state, tool, argument, flag, CASE WHEN {_LISTED.format('j')} THEN list_transform(CAST(j AS VARCHAR[]), lambda b: lower(trim(b))) END AS buttons FROM z)"""

ORACLES = {
    "trace_actions": f"WITH {_T} SELECT doc_id, place, tool, argument FROM x",
    "trace_controls": f"""WITH c AS (SELECT doc_id, {_FLAG.format('text')} = 'true' AS search, {_BUTTONS.format('text')} AS j FROM documents), d AS (SELECT doc_id, search, CASE WHEN {_LISTED.format('j')} THEN array_to_string(CAST(j AS VARCHAR[]), '|') END AS buttons FROM c)
        SELECT * FROM d WHERE search IS NOT NULL OR buttons IS NOT NULL""",
    "trace_reasons": f"""WITH {_T}, {_Y}
        SELECT DISTINCT doc_id, 'unparseable_state_controls' AS reason FROM y WHERE flag IS NULL OR buttons IS NULL
        UNION ALL SELECT DISTINCT doc_id, 'search_when_unavailable' FROM y WHERE flag = 'false' AND buttons IS NOT NULL AND tool = 'search'
        UNION ALL SELECT DISTINCT doc_id, 'click_not_available' FROM y WHERE flag IS NOT NULL AND buttons IS NOT NULL AND tool = 'click' AND NOT list_contains(buttons, lower(trim(argument)))
        UNION ALL SELECT doc_id, 'repeated_state_action_loop' FROM y GROUP BY doc_id HAVING count(*) > count(DISTINCT ROW(state, tool, argument))""",
    "trace_statistics": f"WITH {_T} SELECT doc_id, CAST(count(*) FILTER (tool = 'search') AS INT) AS searches, CAST(count(*) FILTER (tool = 'click') AS INT) AS clicks, CAST(count(DISTINCT ROW(tool, argument)) AS INT) AS distinct_actions, CAST(count(*) - count(DISTINCT ROW(tool, argument)) AS INT) AS repeated FROM x GROUP BY ALL",
    "trace_neighbours": f"WITH {_T} SELECT doc_id, place, CAST(length(state) AS INT) AS state_chars, CAST(length(response) AS INT) AS response_chars FROM x",
    "trace_sample_counts": f"WITH {_T} SELECT count(DISTINCT doc_id) AS rows, count(*) AS assistant_actions FROM x",
    "trace_sample_errors": f"WITH {_T} SELECT 'none' AS error, count(*) AS samples FROM t",
    "trace_contexts": f"WITH {_T}, c AS (SELECT doc_id, place, sum(length(state)) OVER (PARTITION BY doc_id ORDER BY place) AS before FROM x) SELECT doc_id, CAST(count(*) AS INT) AS turns, CAST(max(before) AS INT) AS longest_context FROM c GROUP BY ALL",
    "trace_instructions": r"WITH l AS (SELECT unnest(regexp_extract_all(text, '(?m)^(Instruction: [^\n]*)$', 1)) AS line FROM documents) SELECT sha256(regexp_replace(lower(substr(line, 14)), '[^\p{L}\p{N}]', '', 'g')) AS mark, count(*) AS uses FROM l GROUP BY ALL",
}
QUERIES = {f.__name__: f for f in (trace_actions, trace_controls, trace_reasons, trace_metrics, trace_statistics, trace_neighbours, trace_samples, trace_sample_counts, trace_sample_errors, trace_contexts, trace_instructions)}
