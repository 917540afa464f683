"""Evaluation, verification and selection of rollouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import COLOURS, SIZES, attribute_share, colour_of, compliance_share, exact_share, size_of, token_set_share
from ..functions.text import path_parts, sql_tokens, token_overlap
from ..operators import metrics
from ..operators.sampling import first_per
from ..sources import table

NUMBER = "try_cast(regexp_extract(rollout_id, '([0-9]+)', 1) AS bigint)"


def rollouts(spark, sf_dir: str, *columns: str) -> DataFrame:
    """Rollout records, each once."""
    wanted = dict.fromkeys(["record_id", *columns])
    return table(spark, sf_dir, "rollouts", *wanted).dropDuplicates(["record_id"])


def results(spark, sf_dir: str) -> DataFrame:
    r = rollouts(spark, sf_dir, "task_id", "verifier", "reward", "reward_detail", "goal", "purchase")
    return r.select("record_id", F.col("task_id").cast("long").alias("task_id"), "verifier", "reward", "reward_detail", F.col("goal.asin").alias("goal_asin"), F.col("purchase.asin").alias("purchase_asin"))


def tasks(spark, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "tasks", "task_id", *columns).distinct()


def eval_metrics(spark, sf_dir: str) -> DataFrame:
    return metrics.evaluation(results(spark, sf_dir))


def eval_by_verifier(spark, sf_dir: str) -> DataFrame:
    return metrics.evaluation(results(spark, sf_dir), "verifier")


def eval_fixed_denominator(spark, sf_dir: str) -> DataFrame:
    """Over all tasks: the first record of each task, a missing one counts as not done."""
    first = first_per(results(spark, sf_dir).filter("task_id IS NOT NULL"), ["task_id"], ["record_id"])
    return metrics.evaluation(metrics.fixed_denominator(first, tasks(spark, sf_dir), "task_id"))


def reward_summary(spark, sf_dir: str) -> DataFrame:
    r = rollouts(spark, sf_dir, "reward", "reward_detail")
    return metrics.numeric_summary(r.select("reward", "reward_detail.*"), ["reward", "r_att", "r_option", "r_price", "r_type"])


def termination_rates(spark, sf_dir: str) -> DataFrame:
    return metrics.categorical_rates(rollouts(spark, sf_dir, "termination_reason"), "termination_reason")


def reward_spread(spark, sf_dir: str) -> DataFrame:
    return metrics.group_spread(rollouts(spark, sf_dir, "task_id", "reward").filter("task_id IS NOT NULL"), "task_id", "reward")


def token_sums(spark, sf_dir: str) -> DataFrame:
    """Usable token counts per verifier."""
    m = rollouts(spark, sf_dir, "verifier", "verification").select("verifier", F.explode("verification.metrics").alias("metric", "value"))
    usable = m.filter("metric IN ('prompt_tokens', 'completion_tokens') AND value >= 0 AND value < double('infinity')")
    return usable.groupBy("verifier", "metric").agg(F.sum(F.col("value").cast("long")).alias("tokens"), F.count("*").alias("records"))


def metric_summary(spark, sf_dir: str) -> DataFrame:
    m = rollouts(spark, sf_dir, "verification").select(F.explode("verification.metrics").alias("metric", "value"))
    finite = m.filter("value IS NOT NULL AND NOT isnan(value) AND abs(value) <> double('infinity')")
    return finite.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def rejection_histogram(spark, sf_dir: str) -> DataFrame:
    r = rollouts(spark, sf_dir, "verification").filter("NOT verification.accepted")
    return r.select(F.explode("verification.reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def accepted_distribution(spark, sf_dir: str) -> DataFrame:
    """Accepted records by difficulty, by domain and by option bucket, in one pass over the join."""
    t = first_per(tasks(spark, sf_dir, "difficulty", "domain", "option_bucket"), ["task_id"], ["difficulty", "domain", "option_bucket"])
    r = rollouts(spark, sf_dir, "task_id", "verification").filter("verification.accepted").select(F.col("task_id").cast("long").alias("task_id"))
    d, m, o = F.col("difficulty"), F.col("domain"), F.col("option_bucket")
    counts = r.join(t, "task_id").groupingSets([[d], [m], [o]], d, m, o).agg(F.grouping(d).alias("gd"), F.grouping(m).alias("gm"), F.count("*").alias("n"))
    label = F.when(F.col("gd") == 0, "difficulty").when(F.col("gm") == 0, "domain").otherwise("option_bucket")
    return counts.select(label.alias("label"), F.coalesce(d, m, o).alias("value"), "n")


def best_of_n(spark, sf_dir: str) -> DataFrame:
    """Of each task's accepted records the best: fewest repeats, tool calls and tokens, then the smaller record."""
    r = rollouts(spark, sf_dir, "task_id", "verification").filter("verification.accepted AND task_id IS NOT NULL")
    return r.groupBy(F.col("task_id").cast("long").alias("task_id")).agg(F.min(quality_order())["record_id"].alias("record_id"), F.count("*").alias("accepted"))


def quality_order():
    """Fewest repeats, tool calls and tokens, then the smaller record; unusable counts come last."""
    m = lambda k: F.expr(f"CASE WHEN verification.metrics['{k}'] >= 0 AND verification.metrics['{k}'] < double('infinity') THEN verification.metrics['{k}'] END")
    return F.struct(*(F.coalesce(m(k), F.lit(1e300)).alias(k) for k in ("repeated_action_count", "num_tool_calls", "completion_tokens")), F.col("record_id"))


def quota_per_difficulty(spark, sf_dir: str) -> DataFrame:
    """Of the best accepted record of each task, up to 100 per difficulty, in the same order as the best are chosen by."""
    t = first_per(tasks(spark, sf_dir, "difficulty"), ["task_id"], ["difficulty"]).filter("difficulty IS NOT NULL")
    r = rollouts(spark, sf_dir, "task_id", "verification").filter("verification.accepted AND task_id IS NOT NULL").withColumn("q", quality_order())
    best = r.groupBy(F.col("task_id").cast("long").alias("task_id")).agg(F.min("q").alias("q"))
    place = F.row_number().over(Window.partitionBy("difficulty").orderBy("q", "task_id"))
    return best.join(t, "task_id").withColumn("place", place).filter("place <= 100").select("difficulty", "task_id", F.col("q.record_id").alias("record_id"), "place")


def quota_shortage(spark, sf_dir: str) -> DataFrame:
    t = first_per(tasks(spark, sf_dir, "difficulty"), ["task_id"], ["difficulty"]).filter("difficulty IS NOT NULL")
    return t.groupBy("difficulty").agg(F.count("*").alias("tasks")).withColumn("shortage", F.greatest(F.lit(0).cast("long"), 600 - F.col("tasks")))


def missing_rollouts(spark, sf_dir: str) -> DataFrame:
    """Of the grid of all tasks and the rollouts 0 and 1, the cells without a record."""
    have = rollouts(spark, sf_dir, "task_id", "rollout_id").select(F.col("task_id").cast("long").alias("task_id"), F.expr(NUMBER).alias("rollout_no")).distinct()
    grid = tasks(spark, sf_dir).select("task_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("rollout_no"))
    return grid.join(have, ["task_id", "rollout_no"], "left_anti")


def task_rollout_pairing(spark, sf_dir: str) -> DataFrame:
    """How many tasks and task ids of records have both sides, or one only."""
    r = rollouts(spark, sf_dir, "task_id").filter("task_id IS NOT NULL").select(F.col("task_id").cast("long").alias("task_id")).distinct().withColumn("r", F.lit(1))
    t = tasks(spark, sf_dir).withColumn("t", F.lit(1))
    side = F.when(F.col("r").isNull(), "task only").when(F.col("t").isNull(), "record only").otherwise("both")
    return t.join(r, "task_id", "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def verify_outcome(spark, sf_dir: str) -> DataFrame:
    """(record_id, reason): why a record's outcome is not full; the options are compared as multisets."""
    r = rollouts(spark, sf_dir, "reward", "reward_detail", "goal", "purchase")
    not_full = lambda k: F.when(~F.coalesce(F.abs(F.col(f"reward_detail.{k}") - 1) < 1e-9, F.lit(False)), f"{k}_not_full")
    options = F.array_sort(F.coalesce(F.map_values("purchase.options"), F.array().cast("array<string>")))
    wanted = F.array_sort(F.coalesce("goal.goal_options", F.array().cast("array<string>")))
    reasons = F.array(
        F.when(~F.coalesce(F.abs(F.col("reward") - 1) < 1e-9, F.lit(False)), "reward_not_one"),
        F.when(~F.col("purchase.asin").eqNullSafe(F.col("goal.asin")), "asin_mismatch"),
        *(not_full(k) for k in ("r_att", "r_option", "r_price", "r_type")),
        F.when(options != wanted, "exact_options_mismatch"),
    )
    return r.select("record_id", F.explode(F.array_compact(reasons)).alias("reason"))


def goal_option_counts(spark, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir, "goal").select(F.explode("goal.goal_options").alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def _options(spark, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir, "goal", "purchase").filter("purchase IS NOT NULL").select("record_id", F.col("goal.goal_options").alias("wanted"), F.map_values("purchase.options").alias("bought"))


def option_compliance(spark, sf_dir: str) -> DataFrame:
    """Fuzzy shares of the wanted options that were bought, by both scorers."""
    return _options(spark, sf_dir).select("record_id", compliance_share("wanted", "bought").alias("partial"), token_set_share("wanted", "bought").alias("token_set"))


def option_compliance_exact(spark, sf_dir: str) -> DataFrame:
    """The share of wanted options that are bought to the letter or contained in what was bought; numbers must be equal."""
    return _options(spark, sf_dir).select("record_id", F.round(exact_share(F.col("wanted"), F.col("bought")), 6).alias("share"))


def _wanted_attributes(spark, sf_dir: str) -> DataFrame:
    """Each bought listing's attributes and title beside those of the wanted item's first listing."""
    p = table(spark, sf_dir, "products", "listing_id", "asin", "title", "attributes").filter("asin IS NOT NULL")
    first = first_per(p, ["asin"], ["listing_id"]).select("asin", "title", "attributes")
    r = rollouts(spark, sf_dir, "goal", "purchase").select("record_id", F.col("goal.asin").alias("wanted"), F.col("purchase.asin").alias("bought")).filter("wanted IS NOT NULL AND bought IS NOT NULL")
    named = lambda n: first.select(F.col("asin").alias(n), F.col("title").alias(f"{n}_title"), F.col("attributes").alias(f"{n}_attributes"))
    return r.join(named("wanted"), "wanted").join(named("bought"), "bought")


def attribute_compliance(spark, sf_dir: str) -> DataFrame:
    """Fuzzy shares of the wanted item's attributes that the bought one has, by both scorers."""
    texts = F.array("bought_title")
    a = _wanted_attributes(spark, sf_dir)
    return a.select("record_id", compliance_share("wanted_attributes", F.concat(texts, F.coalesce("bought_attributes", F.array().cast("array<string>")))).alias("partial"), attribute_share("wanted_attributes", "bought_attributes", texts).alias("token_set"))


def attribute_compliance_exact(spark, sf_dir: str) -> DataFrame:
    a = _wanted_attributes(spark, sf_dir)
    offered = F.concat(F.array("bought_title"), F.coalesce("bought_attributes", F.array().cast("array<string>")))
    return a.select("record_id", F.round(exact_share(F.col("wanted_attributes"), offered), 6).alias("share"))


def type_match(spark, sf_dir: str) -> DataFrame:
    """Whether a record bought the wanted item, or one of exactly the same category path."""
    p = table(spark, sf_dir, "products", "listing_id", "asin", "category").filter("asin IS NOT NULL")
    first = first_per(p, ["asin"], ["listing_id"]).select("asin", F.filter(F.transform(path_parts("category"), lambda c: F.regexp_replace(F.lower(c), r"[^0-9a-z\x{4e00}-\x{9fff}]", "")), lambda c: c != "").alias("path"))
    r = rollouts(spark, sf_dir, "goal", "purchase").select("record_id", F.col("goal.asin").alias("wanted"), F.col("purchase.asin").alias("bought"))
    both = r.join(first.select(F.col("asin").alias("wanted"), F.col("path").alias("a")), "wanted", "left").join(first.select(F.col("asin").alias("bought"), F.col("path").alias("b")), "bought", "left")
    same = (F.col("wanted") == F.col("bought")) | ((F.size("a") > 0) & (F.col("a") == F.col("b")))
    return both.select("record_id", F.coalesce(same, F.lit(False)).alias("matches"))


def title_overlap(spark, sf_dir: str) -> DataFrame:
    """The share of the wanted item's title tokens that the bought one has, and whether it is above a fifth."""
    a = _wanted_attributes(spark, sf_dir).select("record_id", token_overlap("wanted_title", "bought_title").alias("s"))
    return a.select("record_id", F.round("s", 6).alias("share"), (F.col("s") > 0.2).alias("alike"))


def success_histogram(spark, sf_dir: str) -> DataFrame:
    """Tasks by the number of their accepted records."""
    own = rollouts(spark, sf_dir, "task_id", "verification").filter("task_id IS NOT NULL").groupBy("task_id").agg(F.count_if("verification.accepted").alias("accepted"))
    return own.groupBy("accepted").agg(F.count("*").alias("tasks"))


def curation_totals(spark, sf_dir: str) -> DataFrame:
    """One row: records, accepted ones, tasks and those with an accepted record, and how the accepted ones hit item and options."""
    r = rollouts(spark, sf_dir, "task_id", "verification").filter("task_id IS NOT NULL")
    whole = r.withColumn("usable", F.col("verification.metrics")["exact_asin_match"].isin(0.0, 1.0))
    return whole.agg(
        F.count("*").alias("records"), F.count_if("verification.accepted").alias("accepted"), F.countDistinct("task_id").alias("tasks"), F.countDistinct(F.when(F.col("verification.accepted"), F.col("task_id"))).alias("passed_tasks"),
        F.round(F.avg(F.when(F.col("verification.accepted") & F.col("usable"), F.col("verification.metrics")["exact_asin_match"])), 6).alias("exact_item"),
    ).withColumn("rate", F.round(F.col("accepted") / F.nullif(F.col("records"), F.lit(0)), 6))


def option_colours(spark, sf_dir: str) -> DataFrame:
    """Colour and size class of each option value, and how many records bought it."""
    values = rollouts(spark, sf_dir, "purchase").select(F.explode(F.map_values("purchase.options")).alias("v")).select(F.lower("v").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return values.select("value", colour_of(F.col("value")).alias("colour"), size_of(F.col("value")).alias("size"), "n")


def step_histogram(spark, sf_dir: str) -> DataFrame:
    """Records by number of tool calls, empty counts included; the last bin, 1000, holds 1000 and more."""
    r = rollouts(spark, sf_dir, "verification").select(F.col("verification.metrics")["num_tool_calls"].alias("steps"))
    finite = r.filter("steps >= 0 AND steps < double('Infinity')")
    return metrics.dense_histogram(finite.select(F.least("steps", F.lit(1000)).alias("steps")), "steps")


def best_seen_reward(spark, sf_dir: str) -> DataFrame:
    """Per record the task's best reward, and what the record misses of it."""
    r = rollouts(spark, sf_dir, "task_id", "reward").filter("task_id IS NOT NULL AND reward IS NOT NULL").select("record_id", F.col("task_id").cast("long").alias("task_id"), "reward")
    best = r.groupBy("task_id").agg(F.max("reward").alias("best"))
    return r.join(best, "task_id").select("record_id", "best", F.round(F.col("best") - F.col("reward"), 6).alias("regret"))


_R = "r AS (SELECT DISTINCT ON (record_id) *, CAST(task_id AS BIGINT) AS tid, TRY_CAST(regexp_extract(rollout_id, '([0-9]+)', 1) AS BIGINT) AS rno FROM rollouts)"
_T = "t AS (SELECT DISTINCT ON (task_id) * FROM tasks)"


def _eval_sql(source: str, keys: str = "") -> str:
    parts = {"type": ("r_type", 0), "attribute": ("r_att", 0), "option": ("r_option", 1), "price": ("r_price", 0)}
    p = {n: f"CASE WHEN reward_detail IS NOT NULL THEN coalesce(reward_detail.{c}, {m}) ELSE 0 END" for n, (c, m) in parts.items()}
    mean = lambda e, n: f"coalesce(CAST(round(CAST(avg(CAST({e} AS DOUBLE)) AS DECIMAL(18, 9)), 4) AS DOUBLE), 0) AS {n}"
    full = "reward_detail IS NOT NULL AND " + " AND ".join(f"({e}) = 1" for e in p.values())
    columns = [mean("reward_detail IS NOT NULL", "done_rate"), mean("coalesce(reward, 0)", "loose"), mean(" * ".join(f"({e})" for e in p.values()), "hard"), mean(f"({full})", "success"), *(mean(e, n) for n, e in p.items()), mean("(reward_detail IS NOT NULL AND purchase.asin IS NOT DISTINCT FROM goal.asin)", "right_product")]
    return f"SELECT {keys + ', ' if keys else ''}count(*) AS samples, {', '.join(columns)} FROM {source}" + (f" GROUP BY {keys}" if keys else "")


def _summary_sql(rows: str, name: str) -> str:
    return f"SELECT {name}, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max FROM ({rows}) WHERE v IS NOT NULL AND isfinite(v) GROUP BY ALL"


_USABLE = lambda k: f"coalesce(CASE WHEN isfinite(verification.metrics['{k}']) AND verification.metrics['{k}'] >= 0 THEN verification.metrics['{k}'] END, 1e300)"
_NOT_ONE = lambda e: f"NOT coalesce(abs({e} - 1) < 1e-9, false)"

_PLAIN = lambda e: f"list_filter(list_transform(coalesce({e}, []), lambda v: regexp_replace(lower(v), '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}]', '', 'g')), lambda v: v <> '')"
_NUMBERS = lambda e: f"regexp_extract_all({e}, '[0-9]+')"
_SHARE = f"""round(CASE WHEN len(w) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(w, lambda x: CASE WHEN len({_NUMBERS('x')}) = 0 THEN contains(array_to_string(a, ''), x)
    ELSE len(list_filter(a, lambda y: {_NUMBERS('y')} = {_NUMBERS('x')} AND contains(y, x))) > 0 END)) / len(w) END, 6) AS share"""
_FIRST = "f AS (SELECT DISTINCT ON (asin) asin, title, attributes, category FROM products WHERE asin IS NOT NULL ORDER BY asin, listing_id)"
_PATH = "list_filter(list_transform(regexp_split_to_array({0}, '[›>/]+'), lambda c: regexp_replace(lower(c), '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}]', '', 'g')), lambda c: c <> '')"
_LIKE = lambda e, p: f"regexp_matches({e}, '{p}')"

ORACLES = {
    "option_compliance_exact": f"WITH {_R}, x AS (SELECT record_id, {_PLAIN('goal.goal_options')} AS w, {_PLAIN('map_values(purchase.options)')} AS a FROM r WHERE purchase IS NOT NULL) SELECT record_id, {_SHARE} FROM x",
    "attribute_compliance_exact": f"WITH {_R}, {_FIRST}, x AS (SELECT record_id, {_PLAIN('p.attributes')} AS w, {_PLAIN('list_concat([b.title], b.attributes)')} AS a FROM r JOIN f p ON p.asin = goal.asin JOIN f b ON b.asin = purchase.asin) SELECT record_id, {_SHARE} FROM x",
    "type_match": f"WITH {_R}, {_FIRST} SELECT record_id, coalesce(goal.asin = purchase.asin OR (len({_PATH.format('p.category')}) > 0 AND {_PATH.format('p.category')} = {_PATH.format('b.category')}), false) AS matches FROM r LEFT JOIN f p ON p.asin = goal.asin LEFT JOIN f b ON b.asin = purchase.asin",
    "title_overlap": f"WITH {_R}, {_FIRST}, x AS (SELECT record_id, {sql_tokens('p.title')} AS w, {sql_tokens('b.title')} AS a FROM r JOIN f p ON p.asin = goal.asin JOIN f b ON b.asin = purchase.asin), y AS (SELECT record_id, CASE WHEN len(w) = 0 THEN 0.2::DOUBLE ELSE len(list_intersect(w, a)) / len(w) END AS s FROM x) SELECT record_id, round(s, 6) AS share, s > 0.2 AS alike FROM y",
    "success_histogram": f"WITH {_R}, o AS (SELECT tid, count(*) FILTER (verification.accepted) AS accepted FROM r WHERE tid IS NOT NULL GROUP BY tid) SELECT accepted, count(*) AS tasks FROM o GROUP BY ALL",
    "curation_totals": f"""WITH {_R} SELECT count(*) AS records, count(*) FILTER (verification.accepted) AS accepted, count(DISTINCT tid) AS tasks, count(DISTINCT tid) FILTER (verification.accepted) AS passed_tasks,
        round(avg(verification.metrics['exact_asin_match']) FILTER (verification.accepted AND verification.metrics['exact_asin_match'] IN (0, 1)), 6) AS exact_item, round(count(*) FILTER (verification.accepted) / count(*), 6) AS rate FROM r WHERE tid IS NOT NULL""",
    "option_colours": f"WITH {_R}, v AS (SELECT lower(unnest(map_values(purchase.options))) AS value FROM r) SELECT value, CASE {' '.join(f"WHEN contains(value, '{c}') THEN '{c}'" for c in COLOURS)} ELSE 'not_matched' END AS colour, CASE {' '.join(f"WHEN {_LIKE('value', p)} THEN '{p}'" for p in SIZES)} WHEN regexp_matches(value, '^(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN 'numeric_size' ELSE 'not_matched' END AS size, count(*) AS n FROM v GROUP BY ALL",
    "eval_metrics": f"WITH {_R} {_eval_sql('r')}",
    "eval_by_verifier": f"WITH {_R} {_eval_sql('r', 'verifier')}",
    "eval_fixed_denominator": f"WITH {_R}, {_T}, f AS (SELECT DISTINCT ON (tid) * FROM r WHERE tid IS NOT NULL ORDER BY tid, record_id), j AS (SELECT f.* FROM t LEFT JOIN f ON t.task_id = f.tid) {_eval_sql('j')}",
    "reward_summary": f"WITH {_R} " + _summary_sql("SELECT 'reward' AS field, reward AS v FROM r" + "".join(f" UNION ALL SELECT '{k}', reward_detail.{k} FROM r" for k in ("r_att", "r_option", "r_price", "r_type")), "field"),
    "termination_rates": rf"WITH {_R} SELECT regexp_replace(coalesce(termination_reason, 'None'), '[^\p{{L}}\p{{N}}_-]', '_', 'g') AS value, round(count(*) / (SELECT count(*) FROM r), 6) AS rate FROM r GROUP BY ALL",
    "reward_spread": f"WITH {_R}, g AS (SELECT stddev_pop(reward) AS s, min(reward) = max(reward) AS z, count(reward) AS n FROM r WHERE tid IS NOT NULL GROUP BY tid) SELECT count(*) AS groups, round(avg(s), 6) AS mean_std, round(avg(CAST(z AS DOUBLE)), 6) AS zero_rate FROM g WHERE n > 1",
    "token_sums": f"WITH {_R}, m AS (SELECT verifier, unnest(map_keys(verification.metrics)) AS metric, unnest(map_values(verification.metrics)) AS value FROM r) SELECT verifier, metric, CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS tokens, count(*) AS records FROM m WHERE metric IN ('prompt_tokens', 'completion_tokens') AND isfinite(value) AND value >= 0 GROUP BY ALL",
    "metric_summary": f"WITH {_R} " + _summary_sql("SELECT unnest(map_keys(verification.metrics)) AS metric, unnest(map_values(verification.metrics)) AS v FROM r", "metric"),
    "rejection_histogram": f"WITH {_R} SELECT reason, count(*) AS n FROM (SELECT unnest(verification.reasons) AS reason FROM r WHERE NOT verification.accepted) GROUP BY ALL",
    "accepted_distribution": f"WITH {_R}, {_T}, j AS (SELECT difficulty, domain, option_bucket FROM r JOIN t ON t.task_id = r.tid WHERE verification.accepted)" + " UNION ALL ".join(f" SELECT '{c}' AS label, {c} AS value, count(*) AS n FROM j GROUP BY {c}" for c in ("difficulty", "domain", "option_bucket")),
    "best_of_n": f"WITH {_R} SELECT tid AS task_id, arg_min(record_id, ROW({', '.join(_USABLE(k) for k in ('repeated_action_count', 'num_tool_calls', 'completion_tokens'))}, record_id)) AS record_id, count(*) AS accepted FROM r WHERE verification.accepted AND tid IS NOT NULL GROUP BY tid",
    "quota_per_difficulty": f"""WITH {_R}, {_T}, b AS (SELECT tid, min(ROW({', '.join(_USABLE(k) for k in ('repeated_action_count', 'num_tool_calls', 'completion_tokens'))}, record_id)) AS q, arg_min(record_id, ROW({', '.join(_USABLE(k) for k in ('repeated_action_count', 'num_tool_calls', 'completion_tokens'))}, record_id)) AS record_id FROM r WHERE verification.accepted AND tid IS NOT NULL GROUP BY tid)
        SELECT difficulty, task_id, record_id, CAST(row_number() OVER (PARTITION BY difficulty ORDER BY q, task_id) AS INT) AS place FROM b JOIN t ON t.task_id = b.tid WHERE difficulty IS NOT NULL QUALIFY place <= 100""",
    "quota_shortage": f"WITH {_T} SELECT difficulty, count(*) AS tasks, greatest(0, 600 - count(*)) AS shortage FROM t WHERE difficulty IS NOT NULL GROUP BY ALL",
    "missing_rollouts": f"WITH {_R}, {_T} SELECT t.task_id, n AS rollout_no FROM t CROSS JOIN (SELECT CAST(unnest([0, 1]) AS BIGINT) AS n) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.tid = t.task_id AND r.rno = n)",
    "task_rollout_pairing": f"WITH {_R}, {_T}, x AS (SELECT DISTINCT tid FROM r WHERE tid IS NOT NULL) SELECT CASE WHEN tid IS NULL THEN 'task only' WHEN task_id IS NULL THEN 'record only' ELSE 'both' END AS side, count(*) AS n FROM t FULL JOIN x ON t.task_id = x.tid GROUP BY ALL",
    "verify_outcome": f"WITH {_R}" + " UNION ALL ".join(f" SELECT record_id, '{n}' AS reason FROM r WHERE {c}" for n, c in {"reward_not_one": _NOT_ONE("reward"), "asin_mismatch": "purchase.asin IS DISTINCT FROM goal.asin", **{f"{k}_not_full": _NOT_ONE(f"reward_detail.{k}") for k in ("r_att", "r_option", "r_price", "r_type")}, "exact_options_mismatch": "list_sort(coalesce(map_values(purchase.options), [])) <> list_sort(coalesce(goal.goal_options, []))"}.items()),
    "goal_option_counts": f"WITH {_R} SELECT value, count(*) AS n FROM (SELECT unnest(goal.goal_options) AS value FROM r) GROUP BY ALL",
    "step_histogram": f"WITH {_R}, s AS (SELECT CAST(least(verification.metrics['num_tool_calls'], 1000) AS BIGINT) AS v FROM r WHERE isfinite(verification.metrics['num_tool_calls']) AND verification.metrics['num_tool_calls'] >= 0) SELECT value, count(v) AS n FROM (SELECT unnest(range((SELECT min(v) FROM s), (SELECT max(v) FROM s) + 1)) AS value) LEFT JOIN s ON v = value GROUP BY ALL",
    "best_seen_reward": f"WITH {_R} SELECT record_id, max(reward) OVER (PARTITION BY tid) AS best, round(max(reward) OVER (PARTITION BY tid) - reward, 6) AS regret FROM r WHERE tid IS NOT NULL AND reward IS NOT NULL",
}
QUERIES = {f.__name__: f for f in (eval_metrics, eval_by_verifier, eval_fixed_denominator, reward_summary, termination_rates, reward_spread, token_sums, metric_summary, rejection_histogram, accepted_distribution, best_of_n, quota_per_difficulty, quota_shortage, missing_rollouts, task_rollout_pairing, verify_outcome, goal_option_counts, option_compliance, option_compliance_exact, attribute_compliance, attribute_compliance_exact, type_match, option_colours, title_overlap, success_histogram, curation_totals, step_histogram, best_seen_reward)}
