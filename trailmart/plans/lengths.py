"""Lengths of texts, conversations, and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import conversations as conv
from ..operators import masks, metrics
from ..sources import table
from ..streaming import events as ev

#: The reference's max_length of a training sample.
LIMIT = 8192


def _docs(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "source", "n_chars").filter("n_chars IS NOT NULL")


def _chats(spark, sf_dir: str) -> DataFrame:
    return conv.from_chat(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def _events(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def length_stats(spark, sf_dir: str) -> DataFrame:
    return metrics.length_summary(_docs(spark, sf_dir), F.col("n_chars"), "source")


def length_quantiles(spark, sf_dir: str) -> DataFrame:
    return metrics.ceil_quantiles(_docs(spark, sf_dir), "n_chars", [0.5, 0.9, 0.95, 0.99, 1.0])


def length_thresholds(spark, sf_dir: str) -> DataFrame:
    limits = (100, 1000, 10000, 30000)
    return _docs(spark, sf_dir).agg(*(F.count_if(F.col("n_chars") > x).alias(f"over_{x}") for x in limits))


def length_bins(spark, sf_dir: str) -> DataFrame:
    return metrics.bin_counts(_docs(spark, sf_dir), "n_chars", 0, 40000, 80)


def length_distribution(spark, sf_dir: str) -> DataFrame:
    return metrics.distribution(_docs(spark, sf_dir), "n_chars")


def chat_messages(spark, sf_dir: str) -> DataFrame:
    return _chats(spark, sf_dir).select("doc_id", F.posexplode("messages").alias("place", "m")).select("doc_id", "place", "m.role", F.length("m.content").alias("chars"))


def chat_contexts(spark, sf_dir: str) -> DataFrame:
    """Turns of each chat and the longest context before an assistant turn."""
    return _chats(spark, sf_dir).select("doc_id", conv.turns(F.col("messages")).alias("turns"), conv.longest_prefix(F.col("messages")).alias("longest_context"))


def chat_order_errors(spark, sf_dir: str) -> DataFrame:
    return _chats(spark, sf_dir).select("doc_id", F.explode(conv.order_errors(F.col("messages"))).alias("error"))


def chat_history(spark, sf_dir: str) -> DataFrame:
    """Each message with the two before it, joined."""
    m = _chats(spark, sf_dir).select("doc_id", F.posexplode("messages").alias("place", "m"))
    before = F.collect_list("m.content").over(Window.partitionBy("doc_id").orderBy("place").rowsBetween(-2, 0))
    return m.select("doc_id", "place", F.sha2(F.array_join(before, " [SEP] "), 256).alias("history"))


def chat_export(spark, sf_dir: str) -> DataFrame:
    return conv.export(_chats(spark, sf_dir), "doc_id")


def chat_mask_stats(spark, sf_dir: str) -> DataFrame:
    """Samples, trained, attended and padded characters of whole chats."""
    return conv.mask_stats(conv.label_masks(_chats(spark, sf_dir), "doc_id"))


def chat_mask_totals(spark, sf_dir: str) -> DataFrame:
    """Masks of whole chats in characters, and what a cut at the reference's 8192 would lose."""
    return conv.mask_totals(conv.label_masks(_chats(spark, sf_dir), "doc_id"), LIMIT)


def chat_encoded(spark, sf_dir: str) -> DataFrame:
    """Chats in ChatML by a tokenizer of bytes: tokens, and those that are learnt."""
    m = masks.encode_labelled(_chats(spark, sf_dir), "doc_id", "messages")
    return m.select("doc_id", F.size("input_ids").alias("tokens"), F.size(F.filter("labels", lambda y: y != conv.IGNORE)).alias("trained"), "error")


def event_hourly(spark, sf_dir: str) -> DataFrame:
    return ev.hourly(_events(spark, sf_dir))


def event_hourly_stream(spark, sf_dir: str) -> DataFrame:
    """The same counts, made by a stream that reads the log."""
    return ev.run_to_table(ev.hourly(ev.read_stream(spark, sf_dir)), "complete")


def event_sessions(spark, sf_dir: str) -> DataFrame:
    return ev.sessions(_events(spark, sf_dir))


def event_repeats(spark, sf_dir: str) -> DataFrame:
    """Events that repeat the user's event before them."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _events(spark, sf_dir).withColumn("now", F.struct("event_type", "props"))
    same = F.coalesce(F.lag("now").over(before) == F.col("now"), F.lit(False))
    return e.withColumn("repeat", same).select("event_id", "user_id", "event_type", "repeat")


def event_repeats_stream(spark, sf_dir: str) -> DataFrame:
    """The same, by a stateful operator on a stream."""
    return ev.run_to_table(ev.repeats_stream(ev.read_stream(spark, sf_dir)))


def event_ever_repeated(spark, sf_dir: str) -> DataFrame:
    """How often each user did what they had done before, and their distinct actions."""
    own = _events(spark, sf_dir).groupBy("user_id", "event_type", "props").agg(F.count("*").alias("n"))
    return own.groupBy("user_id").agg(F.sum("n").alias("actions"), F.count("*").alias("kinds"), F.sum(F.col("n") - 1).alias("repeated"))


def event_counters(spark, sf_dir: str) -> DataFrame:
    kinds = ["click", "error", "purchase", "signup", "view"]
    return _events(spark, sf_dir).groupBy("user_id").agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in kinds), F.count("*").alias("actions"))


_CHAT = r"""l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
    r AS (SELECT doc_id, i, CASE WHEN starts_with(line, '用户：') OR starts_with(line, 'User: ') THEN 'user' WHEN starts_with(line, '客服：') OR starts_with(line, 'Agent: ') THEN 'assistant' END AS role, regexp_replace(line, '^(?:用户：|客服：|User: |Agent: )', '') AS line FROM l),
    n AS (SELECT *, count(role) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r),
    m AS (SELECT doc_id, CAST(k - 1 AS INT) AS place, max(role) AS role, string_agg(line, chr(10) ORDER BY i) AS content, CAST(length(string_agg(line, chr(10) ORDER BY i)) AS INT) AS chars FROM n WHERE k > 0 GROUP BY doc_id, k)"""
_E = "e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)"
_HOURLY = "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL"
_REPEATS = "SELECT event_id, user_id, event_type, coalesce(lag(event_type) OVER w = event_type AND lag(props) OVER w = props, false) AS repeat FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
_Q = lambda p: f"round(quantile_cont(n_chars, {p}), 2)"

ORACLES = {
    "length_stats": f"SELECT source, min(n_chars) AS min, {_Q(0.5)} AS p50, {_Q(0.9)} AS p90, {_Q(0.95)} AS p95, {_Q(0.99)} AS p99, max(n_chars) AS max, round(avg(n_chars), 2) AS mean FROM documents WHERE n_chars IS NOT NULL GROUP BY ALL",
    "length_quantiles": "SELECT s::DOUBLE AS share, (SELECT min(v) FROM (SELECT n_chars AS v, count(*) OVER (ORDER BY n_chars) AS upto, count(*) OVER () AS total FROM documents WHERE n_chars IS NOT NULL) WHERE upto >= s::DOUBLE * total) AS value FROM (SELECT unnest([0.5, 0.9, 0.95, 0.99, 1.0]) AS s)",
    "length_thresholds": "SELECT " + ", ".join(f"count(*) FILTER (n_chars > {x}) AS over_{x}" for x in (100, 1000, 10000, 30000)) + " FROM documents",
    "length_bins": "SELECT CAST(least(81, floor(n_chars / 500) + 1) AS BIGINT) AS bin, count(*) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY ALL",
    "length_distribution": "SELECT n_chars AS value, round(max(c), 6) AS share FROM (SELECT n_chars, cume_dist() OVER (ORDER BY n_chars) AS c FROM documents WHERE n_chars IS NOT NULL) GROUP BY ALL",
    "chat_messages": f"WITH {_CHAT} SELECT doc_id, place, role, chars FROM m",
    "chat_contexts": f"WITH {_CHAT}, p AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m) SELECT doc_id, CAST(count(*) FILTER (role = 'assistant') AS INT) AS turns, CAST(max(before) FILTER (role = 'assistant') AS INT) AS longest_context FROM p GROUP BY ALL",
    "chat_order_errors": f"""WITH {_CHAT}, w AS (SELECT *, lag(role) OVER (PARTITION BY doc_id ORDER BY place) AS b, lead(role) OVER (PARTITION BY doc_id ORDER BY place) AS a FROM m)
        SELECT doc_id, 'does_not_begin_with_user' AS error FROM w WHERE b IS NULL AND role <> 'user' UNION ALL SELECT doc_id, 'does_not_end_with_assistant' FROM w WHERE a IS NULL AND role <> 'assistant'
        UNION ALL SELECT DISTINCT doc_id, 'role_repeats' FROM w WHERE b = role UNION ALL SELECT DISTINCT doc_id, 'empty_content' FROM w WHERE trim(content, ' ') = ''""",
    "chat_history": f"WITH {_CHAT} SELECT doc_id, place, sha256(array_to_string(list(content) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ' [SEP] ')) AS history FROM m",
    "chat_mask_stats": f"""WITH {_CHAT}, d AS (SELECT doc_id, sum(chars) AS tokens, coalesce(sum(chars) FILTER (role = 'assistant'), 0) AS trained FROM m GROUP BY ALL)
        SELECT count(*) AS samples, CAST(sum(trained) AS BIGINT) AS trained, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum((tokens + 7) // 8 * 8) AS BIGINT) AS padded, round(sum(trained) / sum(tokens), 6) AS fraction FROM d""",
    "chat_mask_totals": f"""WITH {_CHAT}, d AS (SELECT doc_id, sum(chars) AS tokens, coalesce(sum(chars) FILTER (role = 'assistant'), 0) AS trained FROM m GROUP BY ALL)
        SELECT count(*) AS samples, CAST(sum(trained) AS BIGINT) AS trained, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum((tokens + 7) // 8 * 8) AS BIGINT) AS padded,
            count(*) FILTER (tokens > {LIMIT}) AS samples_over, CAST(sum(greatest(tokens - {LIMIT}, 0)) AS BIGINT) AS tokens_over, round(sum(trained) / sum(tokens), 6) AS fraction FROM d""",
    "chat_encoded": f"""WITH {_CHAT}, d AS (SELECT doc_id, CAST(sum(strlen(content) + length(role) + 4 + CASE WHEN role = 'assistant' THEN {len(masks.EMPTY_THOUGHT)} ELSE 0 END) AS INT) AS tokens, coalesce(CAST(sum(strlen(content) + 2) FILTER (role = 'assistant') AS INT), 0) AS trained FROM m GROUP BY ALL)
        SELECT doc_id, CASE WHEN trained > 0 THEN tokens ELSE 0 END AS tokens, trained, CASE WHEN trained = 0 THEN 'no assistant message' END AS error FROM d""",
    "event_hourly": _HOURLY,
    "event_hourly_stream": _HOURLY,
    "event_sessions": f"WITH {_E}, s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS events FROM s GROUP BY user_id, k",
    "event_repeats": _REPEATS,
    "event_repeats_stream": _REPEATS,
    "event_ever_repeated": "SELECT user_id, CAST(sum(n) AS BIGINT) AS actions, count(*) AS kinds, CAST(sum(n - 1) AS BIGINT) AS repeated FROM (SELECT user_id, event_type, props, count(*) AS n FROM events GROUP BY ALL) GROUP BY ALL",
    "event_counters": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + ", count(*) AS actions FROM events GROUP BY ALL",
}
QUERIES = {f.__name__: f for f in (length_stats, length_quantiles, length_thresholds, length_bins, length_distribution, chat_messages, chat_contexts, chat_order_errors, chat_history, chat_export, chat_mask_stats, chat_mask_totals, chat_encoded, event_hourly, event_hourly_stream, event_sessions, event_repeats, event_repeats_stream, event_ever_repeated, event_counters)}
