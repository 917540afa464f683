"""Catalogue, sampling and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import html_text
from ..functions.text import letters_and_digits, long_ids, nfkc_casefold, numbers, one_tag, path_parts, sql_words
from ..operators import catalog, goals, sampling
from ..sources import table
from .evaluation import tasks

#: Splits that training must not see.
HELD_OUT = ("eval", "online_dev", "test")


def listings(spark, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "products", "listing_id", *columns).dropDuplicates(["listing_id"])


def product_clean(spark, sf_dir: str) -> DataFrame:
    c = catalog.clean(listings(spark, sf_dir, "asin", "title", "brand", "category", "attributes"))
    return c.select("listing_id", "asin", "title", "brand", "category", F.size("attributes").cast("long").alias("attributes"))


def product_options(spark, sf_dir: str) -> DataFrame:
    return catalog.options(listings(spark, sf_dir, "customization_options"))


def option_values(spark, sf_dir: str) -> DataFrame:
    """How many listings offer each option value."""
    return catalog.options(listings(spark, sf_dir, "customization_options")).groupBy("name", "value").agg(F.countDistinct("listing_id").alias("listings"))


def first_listing(spark, sf_dir: str) -> DataFrame:
    """Of each asin the first listed row."""
    return sampling.first_per(listings(spark, sf_dir, "asin", "listed_at"), ["asin"], ["listed_at", "listing_id"]).select("asin", "listing_id")


def catalog_fingerprint(spark, sf_dir: str) -> DataFrame:
    return catalog.fingerprint(table(spark, sf_dir, "products", "listing_id", "title").distinct(), "listing_id", "title")


def attribute_shares(spark, sf_dir: str) -> DataFrame:
    rows = catalog.clean(listings(spark, sf_dir, "asin", "title", "brand", "category", "attributes"))
    return catalog.attribute_shares(rows, "category")


def _titles(spark, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir, "category", "title")


def title_terms(spark, sf_dir: str) -> DataFrame:
    """The five words that tell each title most from the others of its category."""
    return catalog.top_terms(_titles(spark, sf_dir), "category", "listing_id", "title", stop_words=catalog.STOP_WORDS)


def title_bigrams(spark, sf_dir: str) -> DataFrame:
    """The same with pairs of neighbouring words."""
    return catalog.top_terms(_titles(spark, sf_dir), "category", "listing_id", "title", stop_words=catalog.STOP_WORDS, ngrams=(2,))


def shop_reviews(spark, sf_dir: str) -> DataFrame:
    """Every shop with its listings and the documents about it."""
    d = table(spark, sf_dir, "documents", "shop_id", "text").groupBy("shop_id").agg(F.count("text").alias("documents"))
    p = table(spark, sf_dir, "products", "listing_id", "shop_id").distinct().groupBy("shop_id").agg(F.count("*").alias("listings"))
    s = table(spark, sf_dir, "shops", "shop_id", "platform").join(p, "shop_id", "left").join(d, "shop_id", "left")
    return s.select("shop_id", "platform", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("listings", "documents")))


def category_overlap(spark, sf_dir: str) -> DataFrame:
    """Path parts that each asked listing shares with the next one of its shop."""
    p = sampling.in_key_order(listings(spark, sf_dir, "shop_id", "category").filter("shop_id IS NOT NULL"), ["shop_id"], "listing_id", "n")
    after = p.select("shop_id", (F.col("n") - 1).alias("n"), F.col("category").alias("following"))
    both = p.join(after, ["shop_id", "n"]).filter("category IS NOT NULL AND following IS NOT NULL")
    return both.select("listing_id", F.size(F.array_intersect(path_parts("category"), path_parts("following"))).cast("long").alias("shared"))


def title_numbers(spark, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir, "title").select("listing_id", F.posexplode(numbers("title")).alias("place", "number"))


def document_ids(spark, sf_dir: str) -> DataFrame:
    """Long runs of digits that texts mention."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.explode(long_ids("text")).alias("asin"))


def instruction_dedup(spark, sf_dir: str) -> DataFrame:
    """The first task of each instruction, compared by lower-case letters and digits."""
    t = tasks(spark, sf_dir, "instruction").filter("instruction IS NOT NULL").withColumn("mark", F.sha2(letters_and_digits("instruction"), 256))
    return t.groupBy("mark").agg(F.min("task_id").alias("task_id"), F.count("*").alias("copies"))


def instruction_folded(spark, sf_dir: str) -> DataFrame:
    """The same with full Unicode folding, which SQL can't express."""
    t = tasks(spark, sf_dir, "instruction").filter("instruction IS NOT NULL").withColumn("mark", F.sha2(letters_and_digits("instruction", nfkc_casefold), 256))
    return t.groupBy("mark").agg(F.min("task_id").alias("task_id"), F.count("*").alias("copies"))


def unseen_train(spark, sf_dir: str) -> DataFrame:
    """Train tasks, in any writing of the tag, whose instruction no task of a held-out split has."""
    return _eligibility(spark, sf_dir).filter("state = 'eligible'").select("task_id").distinct()


def _eligibility(spark, sf_dir: str, low: int | None = None, high: int | None = None) -> DataFrame:
    return sampling.eligibility(_tagged(spark, sf_dir, "instruction"), "task_id", "split", "mark", "train", HELD_OUT, low, high)


def eligible_audit(spark, sf_dir: str) -> DataFrame:
    """Of the tasks from number 1000 on, how many are eligible, and how many are left out for which reason."""
    return _eligibility(spark, sf_dir, 1000).groupBy("state").agg(F.count("*").alias("tasks"))


def remaining_tasks(spark, sf_dir: str) -> DataFrame:
    """Eligible tasks that the stratified sample did not take, neither by their number nor by their instruction."""
    eligible = _eligibility(spark, sf_dir).filter("state = 'eligible'").select("task_id", "mark").distinct()
    taken = stratified_sample(spark, sf_dir).select("task_id").join(_tagged(spark, sf_dir, "instruction").select("task_id", "mark"), "task_id")
    return sampling.remaining(eligible, taken, "task_id", "mark").select("task_id")


def _tagged(spark, sf_dir: str, *columns: str) -> DataFrame:
    """Tasks with ``split``, the tag in one writing, and ``mark``, the digest of the instruction."""
    t = tasks(spark, sf_dir, "tag", *columns)
    return t.withColumn("split", one_tag("tag")).withColumn("mark", F.sha2(letters_and_digits("instruction"), 256))


def _strata(spark, sf_dir: str) -> DataFrame:
    columns = ["difficulty", "domain", "option_bucket"]
    return sampling.first_per(tasks(spark, sf_dir, *columns), ["task_id"], columns).dropna()


def largest_remainder(spark, sf_dir: str) -> DataFrame:
    counts = _strata(spark, sf_dir).groupBy("domain", "option_bucket").agg(F.count("*").alias("rows"))
    return sampling.largest_remainder(counts, ["domain", "option_bucket"], "rows", 500)


def stratified_sample(spark, sf_dir: str) -> DataFrame:
    return sampling.stratified_sample(_strata(spark, sf_dir), ["domain", "option_bucket"], "task_id", 500).select("task_id", "domain", "option_bucket")


def proportional_quotas(spark, sf_dir: str) -> DataFrame:
    return sampling.proportional_quotas(_strata(spark, sf_dir).groupBy("difficulty").agg(F.count("*").alias("n")), "difficulty", "n", 50)


def disjoint_splits(spark, sf_dir: str) -> DataFrame:
    return sampling.disjoint_splits(_strata(spark, sf_dir), "difficulty", "task_id", {"train": 0.8, "validation": 0.1, "reserve": 0.1}).select("task_id", "split")


def hash_split(spark, sf_dir: str) -> DataFrame:
    return sampling.hash_split(tasks(spark, sf_dir), "task_id", 100).select("task_id", "part")


def seeded_shuffle(spark, sf_dir: str) -> DataFrame:
    """The first 200 tasks of a drawn order."""
    return tasks(spark, sf_dir).orderBy(sampling.draw_order("task_id", 7), "task_id").limit(200)


def weighted_draw(spark, sf_dir: str) -> DataFrame:
    t = sampling.first_per(tasks(spark, sf_dir, "attribute_count"), ["task_id"], ["attribute_count"]).filter("attribute_count > 0")
    return sampling.weighted_draw(t, "task_id", "attribute_count", 100).select("task_id")


def cumulative_weights(spark, sf_dir: str) -> DataFrame:
    """Running totals of the tasks per domain, in order of the label."""
    counts = _strata(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("weight"))
    return counts.withColumn("upto", F.sum("weight").over(Window.orderBy("domain").rowsBetween(Window.unboundedPreceding, 0)))


LABELS = ("difficulty", "domain", "option_bucket")


def dedup_refill(spark, sf_dir: str) -> DataFrame:
    """Repeated train instructions and the backfill tasks of their stratum (three labels) that take their place; tags in any writing."""
    columns = ["source", "instruction", *LABELS]
    t = sampling.first_per(_tagged(spark, sf_dir, *columns), ["task_id"], ["tag", *columns]).filter(" AND ".join(f"{c} IS NOT NULL" for c in LABELS))
    return sampling.refill(t.filter("split = 'train' AND source <> 'backfill'"), t.filter("source = 'backfill' AND split <> 'train'"), list(LABELS), "task_id", "mark")


def pilot_choice(spark, sf_dir: str) -> DataFrame:
    """Sixty tasks: one of each domain (of more than sixty, those drawn first), then hard ones with several options of the largest domain, then any."""
    return sampling.pilot(_strata(spark, sf_dir), 60, "task_id", 3, cover=False).select("task_id", "domain")


def quota_splits(spark, sf_dir: str) -> DataFrame:
    """The stratified sample in three disjoint splits by quotas per difficulty that use it up."""
    sample = stratified_sample(spark, sf_dir).select("task_id").join(_strata(spark, sf_dir).select("task_id", "difficulty"), "task_id")
    n = {r.difficulty: r.n for r in sample.groupBy("difficulty").agg(F.count("*").alias("n")).collect()}
    quotas = {"train": {k: v - v // 5 - v // 10 for k, v in n.items()}, "validation": {k: v // 10 for k, v in n.items()}, "reserve": {k: v // 5 for k, v in n.items()}}
    return sampling.split_by_quotas(sample, "difficulty", "task_id", quotas).select("task_id", "difficulty", "split")


def label_counts(spark, sf_dir: str) -> DataFrame:
    """Tasks by each of three labels, in order."""
    s = _strata(spark, sf_dir)
    long = s.select(F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).alias("value")) for c in LABELS))).alias("x")).select("x.*")
    return long.groupBy("label", "value").agg(F.count("*").alias("n")).orderBy("label", "value")


def goal_rows(spark, sf_dir: str) -> DataFrame:
    """The goal of each task: its instruction with the item it asks for, without items that state no attributes."""
    p = table(spark, sf_dir, "products", "listing_id", "asin", "title", "category", "attributes").filter("asin IS NOT NULL")
    first = sampling.first_per(p, ["asin"], ["listing_id"])
    t = sampling.first_per(tasks(spark, sf_dir, "asin", "instruction"), ["task_id"], ["asin", "instruction"]).filter("instruction IS NOT NULL")
    named = t.join(first, "asin").withColumn("stated", F.filter("attributes", lambda a: a != "")).filter("size(stated) > 0")
    return goals.goal(named, "task_id", name="title", attributes="stated")


def training_rows(spark, sf_dir: str) -> DataFrame:
    """Goals as rows of a training set: prompt messages and the goal as JSON text."""
    return goals.training_row(goal_rows(spark, sf_dir), "You are a shopping agent.")


def training_row_digests(spark, sf_dir: str) -> DataFrame:
    """What SQL can repeat of them: the first message, and letters and digits of the goal."""
    rows = training_rows(spark, sf_dir)
    return rows.select("task_id", F.sha2(F.get("prompt", F.lit(1))["content"], 256).alias("prompt"), F.get_json_object("ground_truth", "$.goal.asin").alias("asin"), F.sha2(F.get_json_object("ground_truth", "$.goal.name"), 256).alias("name"))


def purchase_summaries(spark, sf_dir: str) -> DataFrame:
    """Goal and purchase of each record with only the fields they have, as JSON text."""
    r = table(spark, sf_dir, "rollouts", "record_id", "goal", "purchase").dropDuplicates(["record_id"])
    return r.select("record_id", goals.present("goal").alias("goal"), goals.present("purchase").alias("purchase"))


def domain_difficulty_counts(spark, sf_dir: str) -> DataFrame:
    return _strata(spark, sf_dir).groupBy("domain", "difficulty", "option_bucket").agg(F.count("*").alias("n"))


def manifest_union(spark, sf_dir: str) -> DataFrame:
    """One label per document: the last annotator's goes before, nulls are left out."""
    l = table(spark, sf_dir, "doc_labels").filter("verdict IS NOT NULL")
    return l.groupBy("doc_id").agg(F.max_by("verdict", F.struct("annotator", "verdict")).alias("verdict"))


def manifest_errors(spark, sf_dir: str) -> DataFrame:
    """Labels of unknown documents, and instructions that several tasks have."""
    unknown = table(spark, sf_dir, "doc_labels", "doc_id").distinct().join(table(spark, sf_dir, "documents", "doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("unknown document").alias("error"), "n")
    again = instruction_dedup(spark, sf_dir).filter("copies > 1").agg(F.count("*").alias("n")).select(F.lit("repeated instruction").alias("error"), "n")
    return unknown.unionByName(again)


def json_props(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_type", "props").withColumn("k", F.from_json("props", "k BIGINT")["k"])
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


def document_markup(spark, sf_dir: str) -> DataFrame:
    """The visible text of documents with markup."""
    return table(spark, sf_dir, "documents", "doc_id", "text").filter("text RLIKE '<[a-z/]'").select("doc_id", html_text("text").alias("visible"))


_P = "p AS (SELECT DISTINCT ON (listing_id) * FROM products)"
_CLEAN = "c AS (SELECT listing_id, asin, trim(title, ' ') AS title, coalesce(nullif(trim(brand, ' '), ''), 'N.A.') AS brand, lower(trim(coalesce(category, ''), ' ')) AS category, list_filter(list_transform(coalesce(attributes, []), lambda a: trim(a, ' ')), lambda a: a <> '') AS attributes FROM p WHERE asin IS NOT NULL AND lower(asin) NOT IN ('nan', '') AND length(asin) <= 20)"
_OPTIONS = "o AS (SELECT listing_id, lower(e.key) AS name, CAST(generate_subscripts(e.value, 1) - 1 AS INT) AS place, unnest(e.value) AS v FROM (SELECT listing_id, unnest(map_entries(customization_options)) AS e FROM p)), ov AS (SELECT listing_id, name, place, lower(replace(trim(v.value, ' '), '/', ' | ')) AS value, v.image AS image FROM o)"
_LETTERS = r"regexp_replace(lower(instruction), '[^\p{L}\p{N}]', '', 'g')"
_TAG = r"lower(regexp_replace(tag, '^[\s\x0b\p{Z}]+|[\s\x0b\p{Z}]+$', '', 'g'))"
_S = "s AS (SELECT DISTINCT task_id, difficulty, domain, option_bucket FROM tasks WHERE difficulty IS NOT NULL AND domain IS NOT NULL AND option_bucket IS NOT NULL)"
_ORDER = lambda seed: f"md5(CAST(task_id AS VARCHAR) || '|{seed}')"
_ALLOCATED = f"""WITH {_S}, g AS (SELECT domain, option_bucket, count(*) AS rows FROM s GROUP BY ALL),
    b AS (SELECT *, 500.0::DOUBLE * rows / sum(rows) OVER () AS ideal, least(rows, greatest(1, CAST(floor(500.0::DOUBLE * rows / sum(rows) OVER ()) AS BIGINT))) AS fl FROM g QUALIFY sum(rows) OVER () >= 500 AND count(*) OVER () <= 500),
    d AS (SELECT *, 500 - sum(fl) OVER () AS missing, row_number() OVER (PARTITION BY fl >= rows ORDER BY ideal - fl DESC, domain DESC, option_bucket DESC) AS k FROM b),
    u AS (SELECT domain, option_bucket, missing, ideal - fl + unnest(range(0, fl - 1)) AS gap FROM d WHERE missing < 0 AND fl > 1),
    m AS (SELECT domain, option_bucket, count(*) AS minus FROM (SELECT *, row_number() OVER (ORDER BY gap, domain, option_bucket) AS k FROM u QUALIFY k <= -missing) GROUP BY ALL),
    a AS (SELECT d.domain, d.option_bucket, rows, CAST(fl + (CASE WHEN fl < rows AND k <= missing THEN 1 ELSE 0 END) - coalesce(minus, 0) AS BIGINT) AS allocated FROM d LEFT JOIN m USING (domain, option_bucket))"""
_PART = f"CASE WHEN CAST('0x' || substr({_ORDER(42)}, 1, 8) AS BIGINT) % 1000 < 100 THEN 'test' ELSE 'train' END"

_GOALS = """f AS (SELECT DISTINCT ON (asin) * FROM products WHERE asin IS NOT NULL ORDER BY asin, listing_id), k AS (SELECT DISTINCT task_id, asin, instruction FROM tasks WHERE instruction IS NOT NULL),
    g AS (SELECT task_id, asin, coalesce(category, '') AS category, coalesce(title, '') AS name, instruction AS instruction_text, list_filter(attributes, lambda a: a <> '') AS attributes FROM k JOIN f USING (asin) WHERE len(list_filter(attributes, lambda a: a <> '')) > 0)"""
_STOP = ", ".join("'" + w + "'" for w in catalog.STOP_WORDS)


def _terms_sql(n: int) -> str:
    words = f"list_filter({sql_words('title')}, lambda w: w NOT IN ({_STOP}) AND NOT regexp_matches(w, '^[0-9]{{1,3}}$'))"
    return f"""WITH {_P}, w AS (SELECT category, listing_id, {words} AS ws FROM p WHERE category IS NOT NULL), t AS (SELECT category, listing_id, unnest(list_transform(range(1, len(ws) - {n} + 2), lambda i: array_to_string(ws[i:i + {n} - 1], ' '))) AS token FROM w),
        c AS (SELECT category, listing_id, token, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT category, count(*) AS n FROM w GROUP BY ALL),
        f AS (SELECT category, token, count(*) AS df, row_number() OVER (PARTITION BY category ORDER BY sum(tf) DESC, token) AS r FROM c GROUP BY category, token QUALIFY r <= 1000),
        x AS (SELECT c.category, listing_id, token, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN f USING (category, token) JOIN n USING (category)),
        s AS (SELECT category, listing_id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY category, listing_id)), 6) AS score FROM x)
        SELECT *, CAST(row_number() OVER (PARTITION BY category, listing_id ORDER BY score DESC, token) AS INT) AS place FROM s QUALIFY place <= 5"""


ORACLES = {
    "product_clean": f"WITH {_P}, {_CLEAN} SELECT listing_id, asin, title, brand, category, CAST(len(attributes) AS BIGINT) AS attributes FROM c",
    "product_options": f"WITH {_P}, {_OPTIONS} SELECT * FROM ov",
    "option_values": f"WITH {_P}, {_OPTIONS} SELECT name, value, count(DISTINCT listing_id) AS listings FROM ov GROUP BY ALL",
    "first_listing": f"WITH {_P} SELECT asin, arg_min(listing_id, ROW(listed_at, listing_id)) AS listing_id FROM p GROUP BY ALL",
    "catalog_fingerprint": f"WITH {_P}, e AS (SELECT listing_id // 1000 AS part, listing_id AS k, sha256(coalesce(title, '')) AS d FROM p), g AS (SELECT part, sha256(string_agg(d, '' ORDER BY k)) AS d, count(*) AS n FROM e GROUP BY part), b AS (SELECT part // 1000 AS block, sha256(string_agg(d, '' ORDER BY part)) AS d, sum(n) AS n FROM g GROUP BY block) SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(d, '' ORDER BY block)) AS sha256 FROM b",
    "attribute_shares": f"WITH {_P}, {_CLEAN}, x AS (SELECT DISTINCT category, listing_id, unnest(attributes) AS attribute FROM c), n AS (SELECT category, count(*) AS total FROM c GROUP BY ALL) SELECT x.category, attribute, count(*) AS listings, round(count(*) / any_value(total), 6) AS share FROM x JOIN n USING (category) GROUP BY ALL",
    "title_terms": _terms_sql(1),
    "title_bigrams": _terms_sql(2),
    "shop_reviews": "SELECT s.shop_id, platform, (SELECT count(DISTINCT listing_id) FROM products p WHERE p.shop_id = s.shop_id) AS listings, (SELECT count(text) FROM documents d WHERE d.shop_id = s.shop_id) AS documents FROM shops s",
    "category_overlap": f"WITH {_P}, n AS (SELECT listing_id, category, lead(category) OVER (PARTITION BY shop_id ORDER BY listing_id) AS f FROM p) SELECT listing_id, CAST(len(list_distinct(list_intersect(list_filter(list_transform(regexp_split_to_array(category, '[›>/]+'), lambda x: trim(x, ' ')), lambda x: x <> ''), list_filter(list_transform(regexp_split_to_array(f, '[›>/]+'), lambda x: trim(x, ' ')), lambda x: x <> '')))) AS BIGINT) AS shared FROM n WHERE category IS NOT NULL AND f IS NOT NULL",
    "title_numbers": rf"WITH {_P}, n AS (SELECT listing_id, regexp_extract_all(title, '[0-9]+(?:\.[0-9]+)?') AS n FROM p) SELECT listing_id, CAST(generate_subscripts(n, 1) - 1 AS INT) AS place, unnest(n) AS number FROM n",
    "document_ids": "SELECT DISTINCT doc_id, asin FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS asin FROM documents) WHERE length(asin) BETWEEN 10 AND 20",
    "instruction_dedup": f"SELECT sha256({_LETTERS}) AS mark, min(task_id) AS task_id, count(*) AS copies FROM (SELECT DISTINCT task_id, instruction FROM tasks WHERE instruction IS NOT NULL) GROUP BY ALL",
    "unseen_train": f"WITH t AS (SELECT DISTINCT task_id, {_TAG} AS split, {_LETTERS} AS m FROM tasks) SELECT DISTINCT task_id FROM t WHERE split = 'train' AND (m IS NULL OR m NOT IN (SELECT m FROM t WHERE split IN {HELD_OUT} AND m IS NOT NULL))",
    "eligible_audit": f"""WITH t AS (SELECT DISTINCT task_id, tag, {_TAG} AS split, instruction, {_LETTERS} AS m FROM tasks), h AS (SELECT DISTINCT m FROM t WHERE split IN {HELD_OUT} AND m IS NOT NULL)
        SELECT CASE WHEN split IS DISTINCT FROM 'train' THEN 'wrong tag' WHEN h.m IS NOT NULL THEN 'held-out instruction' ELSE 'eligible' END AS state, count(*) AS tasks FROM t LEFT JOIN h USING (m) WHERE task_id >= 1000 GROUP BY ALL""",
    "remaining_tasks": _ALLOCATED + f""", r AS (SELECT task_id, domain, option_bucket, row_number() OVER (PARTITION BY domain, option_bucket ORDER BY {_ORDER(42)}, task_id) AS place FROM s), c AS (SELECT task_id FROM r JOIN a USING (domain, option_bucket) WHERE place <= allocated),
        t AS (SELECT DISTINCT task_id, {_TAG} AS split, {_LETTERS} AS m FROM tasks), e AS (SELECT DISTINCT task_id, m FROM t WHERE split = 'train' AND (m IS NULL OR m NOT IN (SELECT m FROM t WHERE split IN {HELD_OUT} AND m IS NOT NULL)))
        SELECT task_id FROM e WHERE task_id NOT IN (SELECT task_id FROM c) AND (m IS NULL OR m NOT IN (SELECT m FROM t WHERE m IS NOT NULL AND task_id IN (SELECT task_id FROM c)))""",
    "label_counts": f"WITH {_S}" + " UNION ALL ".join(f" SELECT '{c}' AS label, {c} AS value, count(*) AS n FROM s GROUP BY {c}" for c in LABELS),
    "goal_rows": f"WITH {_GOALS} SELECT task_id, asin, category, name, instruction_text, to_json(attributes) AS attributes FROM g",
    "training_row_digests": f"WITH {_GOALS} SELECT task_id, sha256('Instruction: ' || instruction_text || chr(10) || chr(10) || '搜索功能是否可用: True' || chr(10) || chr(10) || '可点击的按钮: []') AS prompt, asin, sha256(name) AS name FROM g",
    "largest_remainder": _ALLOCATED + " SELECT * FROM a",
    "stratified_sample": _ALLOCATED + f", r AS (SELECT task_id, domain, option_bucket, row_number() OVER (PARTITION BY domain, option_bucket ORDER BY {_ORDER(42)}, task_id) AS place FROM s) SELECT task_id, domain, option_bucket FROM r JOIN a USING (domain, option_bucket) WHERE place <= allocated",
    "proportional_quotas": f"WITH {_S}, c AS (SELECT difficulty, count(*) AS n FROM s GROUP BY ALL), q AS (SELECT difficulty, 50 * n / sum(n) OVER () AS sh FROM c), f AS (SELECT *, floor(sh) AS fl, 50 - sum(floor(sh)) OVER () AS missing, row_number() OVER (ORDER BY sh - floor(sh) DESC, difficulty DESC) AS k FROM q) SELECT difficulty, CAST(fl + CASE WHEN k <= missing THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f",
    "disjoint_splits": f"WITH {_S}, r AS (SELECT task_id, row_number() OVER (PARTITION BY difficulty ORDER BY {_ORDER(42)}, task_id) AS place, count(*) OVER (PARTITION BY difficulty) AS n FROM s) SELECT task_id, CASE WHEN place <= floor(round(0.8 * n, 9)) THEN 'train' WHEN place <= floor(round(0.9 * n, 9)) THEN 'validation' ELSE 'reserve' END AS split FROM r",
    "hash_split": f"SELECT DISTINCT task_id, {_PART} AS part FROM tasks",
    "seeded_shuffle": f"SELECT task_id FROM (SELECT DISTINCT task_id FROM tasks) ORDER BY {_ORDER(7)}, task_id LIMIT 200",
    "cumulative_weights": f"WITH {_S}, c AS (SELECT domain, count(*) AS weight FROM s GROUP BY ALL) SELECT domain, weight, CAST(sum(weight) OVER (ORDER BY domain) AS BIGINT) AS upto FROM c",
    "dedup_refill": f"""WITH t AS (SELECT DISTINCT task_id, {_TAG} AS split, source, difficulty, domain, option_bucket, {_LETTERS} AS m FROM tasks WHERE difficulty IS NOT NULL AND domain IS NOT NULL AND option_bucket IS NOT NULL),
        w AS (SELECT * FROM t WHERE split = 'train' AND source <> 'backfill'), a AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY task_id) AS again FROM w WHERE m IS NOT NULL),
        b AS (SELECT DISTINCT ON (m) * FROM t WHERE source = 'backfill' AND split <> 'train' ORDER BY m, task_id), f AS (SELECT * FROM b WHERE m IS NULL OR m NOT IN (SELECT m FROM w WHERE m IS NOT NULL)),
        x AS (SELECT difficulty, domain, option_bucket, task_id AS removed, row_number() OVER (PARTITION BY difficulty, domain, option_bucket ORDER BY task_id) AS n FROM a WHERE again > 1), y AS (SELECT difficulty, domain, option_bucket, task_id AS added, row_number() OVER (PARTITION BY difficulty, domain, option_bucket ORDER BY task_id) AS n FROM f)
        SELECT removed, added FROM x LEFT JOIN y USING (difficulty, domain, option_bucket, n)""",
    "pilot_choice": f"""WITH {_S}, o AS (SELECT *, {_ORDER(3)} AS o FROM s), l AS (SELECT domain FROM s GROUP BY domain ORDER BY count(*) DESC, domain DESC LIMIT 1), b AS (SELECT DISTINCT ON (domain) task_id FROM o ORDER BY domain, o, task_id)
        SELECT task_id, domain FROM o ORDER BY CASE WHEN task_id IN (SELECT task_id FROM b) THEN 0 WHEN domain = (SELECT domain FROM l) AND difficulty = 'hard' AND option_bucket = 'multi' THEN 1 ELSE 2 END, o, task_id LIMIT 60""",
    "domain_difficulty_counts": f"WITH {_S} SELECT domain, difficulty, option_bucket, count(*) AS n FROM s GROUP BY ALL",
    "manifest_union": "SELECT doc_id, arg_max(verdict, ROW(annotator, verdict)) AS verdict FROM doc_labels WHERE verdict IS NOT NULL GROUP BY ALL",
    "manifest_errors": f"SELECT 'unknown document' AS error, count(DISTINCT doc_id) AS n FROM doc_labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'repeated instruction', count(*) FROM (SELECT {_LETTERS} AS m FROM (SELECT DISTINCT task_id, instruction FROM tasks WHERE instruction IS NOT NULL) GROUP BY m HAVING count(*) > 1)",
    "json_props": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS most FROM (SELECT event_type, CAST(props->>'k' AS BIGINT) AS k FROM events) GROUP BY ALL",
}
QUERIES = {f.__name__: f for f in (product_clean, product_options, option_values, first_listing, catalog_fingerprint, attribute_shares, title_terms, title_bigrams, shop_reviews, category_overlap, title_numbers, document_ids, instruction_dedup, instruction_folded, unseen_train, eligible_audit, remaining_tasks, quota_splits, label_counts, goal_rows, training_rows, training_row_digests, purchase_summaries, largest_remainder, stratified_sample, proportional_quotas, disjoint_splits, hash_split, seeded_shuffle, weighted_draw, cumulative_weights, dedup_refill, pilot_choice, domain_difficulty_counts, manifest_union, manifest_errors, json_props, document_markup)}
