"""Search queries. As queries serve all rows whose id is divisible by 100, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SQL_MACROS, joined_models, model_numbers, nfkc_casefold, query_text, search_tokens, sql_tokens
from ..operators.search import DEPTH, FIELD_WEIGHTS, SHIFTED_WEIGHTS, build_index, page_of, search, shuffled_first, swapped_pages
from ..sources import table

USED = FIELD_WEIGHTS


def searchable(spark, sf_dir: str) -> DataFrame:
    """Searchable text fields of each listing row; an index counts repeated rows once."""
    p = table(spark, sf_dir, "products", "listing_id", "title", "brand", "category", "attributes", "customization_options")
    entries = F.map_entries("customization_options")
    words = F.flatten(F.transform(entries, lambda e: F.concat(F.array(e["key"]), F.transform(F.coalesce(e["value"], F.array()), lambda v: v["value"]))))
    # the listings of these tables have no bullet points; a null field has no tokens
    return p.select("listing_id", "title", "brand", "category", joined_models(query_text("title")).alias("model"), F.array_join("attributes", " ").alias("attributes"), F.array_join(words, " ").alias("options"), F.lit(None).cast("string").alias("bullets"))


def asked(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tasks", "task_id", "instruction").filter("task_id % 100 = 0").distinct()


def _hits(spark, sf_dir: str, fold=F.lower, weights=USED) -> DataFrame:
    return search(build_index(searchable(spark, sf_dir), "listing_id", weights, fold), asked(spark, sf_dir), "task_id", "instruction", fold=fold)


def search_topk(spark, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select(F.col("query").alias("task_id"), F.col("doc").alias("listing_id"), "score", "rank")


def search_topk_folded(spark, sf_dir: str) -> DataFrame:
    """The same with full Unicode folding, which SQL can't express."""
    return _hits(spark, sf_dir, nfkc_casefold).select(F.col("query").alias("task_id"), F.col("doc").alias("listing_id"), "score", "rank")


def search_topk_shifted(spark, sf_dir: str) -> DataFrame:
    """The same with the weights that the reference's index gives in effect."""
    return _hits(spark, sf_dir, weights=SHIFTED_WEIGHTS).select(F.col("query").alias("task_id"), F.col("doc").alias("listing_id"), "score", "rank")


def search_shuffled(spark, sf_dir: str) -> DataFrame:
    """The first ten hits in drawn order."""
    return shuffled_first(_hits(spark, sf_dir), 10, 5).select(F.col("query").alias("task_id"), F.col("doc").alias("listing_id"), "rank")


def search_page(spark, sf_dir: str) -> DataFrame:
    """The second page of each query's hits, with the listings."""
    p = table(spark, sf_dir, "products", "listing_id", "title", "brand").distinct()
    hits = page_of(_hits(spark, sf_dir), 2).withColumnRenamed("doc", "listing_id")
    return hits.join(p, "listing_id").select(F.col("query").alias("task_id"), "listing_id", "title", "brand", "rank")


def search_swapped(spark, sf_dir: str) -> DataFrame:
    return swapped_pages(_hits(spark, sf_dir)).select(F.col("query").alias("task_id"), F.col("doc").alias("listing_id"), "rank")


def search_documents(spark, sf_dir: str) -> DataFrame:
    """The ten documents closest to each asked listing's title."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").filter("text IS NOT NULL")
    titles = table(spark, sf_dir, "products", "listing_id", "title").filter("listing_id % 100 = 0").distinct()
    hits = search(build_index(docs, "doc_id", {"text": 1.0}), titles, "listing_id", "title", depth=10)
    return hits.select(F.col("query").alias("listing_id"), F.col("doc").alias("doc_id"), "score", "rank")


def search_index_stats(spark, sf_dir: str) -> DataFrame:
    index = build_index(searchable(spark, sf_dir), "listing_id", USED)
    words = index.tokens.agg(F.count("*").alias("tokens"), F.sum("df").alias("postings"))
    return index.totals.crossJoin(F.broadcast(words)).select("docs", F.round("mean_length", 6).alias("mean_length"), "tokens", "postings")


def search_token_df(spark, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "products", "listing_id", "title").distinct()
    return titles.select("listing_id", F.explode(search_tokens("title")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def quick_query(spark, sf_dir: str) -> DataFrame:
    """Listings whose title, as a search text, is that of an asked listing."""
    p = table(spark, sf_dir, "products", "listing_id", "title").distinct().select("listing_id", query_text("title").alias("asked")).filter("asked <> ''")
    q = p.filter("listing_id % 100 = 0").select(F.col("listing_id").alias("query"), "asked")
    return q.join(p, "asked").select("query", "listing_id")


def quick_random(spark, sf_dir: str) -> DataFrame:
    """A drawn page of listings, as many as a search gives."""
    return table(spark, sf_dir, "products", "listing_id").distinct().orderBy(F.md5(F.concat(F.col("listing_id").cast("string"), F.lit("|9"))), "listing_id").limit(DEPTH)


def title_models(spark, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "products", "listing_id", "title").distinct()
    return titles.select("listing_id", F.explode(model_numbers("title")).alias("model"))


def quick_category(spark, sf_dir: str) -> DataFrame:
    """Listings of the very category of each asked listing."""
    p = table(spark, sf_dir, "products", "listing_id", "category").filter("category IS NOT NULL").distinct()
    q = p.filter("listing_id % 100 = 0").select(F.col("listing_id").alias("query"), "category")
    return q.join(p, "category").select("query", "listing_id")


def quick_attribute(spark, sf_dir: str) -> DataFrame:
    """Listings that have all attributes of an asked listing, as sets."""
    p = table(spark, sf_dir, "products", "listing_id", "attributes").distinct()
    pairs = p.select("listing_id", F.explode(F.array_distinct(F.filter("attributes", lambda a: a != ""))).alias("attribute"))
    q = pairs.filter("listing_id % 100 = 0").select(F.col("listing_id").alias("query"), "attribute")
    wanted = q.withColumn("wanted", F.count("*").over(Window.partitionBy("query")))
    met = wanted.join(pairs, "attribute").groupBy("query", "listing_id").agg(F.count("*").alias("met"), F.max("wanted").alias("wanted"))
    return met.filter("met = wanted").select("query", "listing_id")


_DOCS = """d AS (SELECT DISTINCT listing_id AS doc, title, brand, category, array_to_string(attributes, ' ') AS attributes, NULL::VARCHAR AS bullets,
    array_to_string(list_filter({MODELS}, lambda t: regexp_matches(t, '[a-z]') AND regexp_matches(t, '[0-9]')), ' ') AS model,
    array_to_string(flatten(list_transform(map_entries(customization_options), lambda e: list_concat([e.key], list_transform(coalesce(e.value, []), lambda v: v.value)))), ' ') AS options FROM products)""".replace("{MODELS}", sql_tokens("title"))


def _search_sql(docs: str, fields: dict[str, float], queries: str, depth: int) -> str:
    posts = " UNION ALL ".join(f"SELECT doc, unnest({sql_tokens(c)}) AS token, {w}::DOUBLE AS w FROM d" for c, w in fields.items())
    return f"""WITH {docs}, p AS ({posts}), t AS (SELECT doc, token, sum(w) AS tf FROM p GROUP BY ALL),
    l AS (SELECT d.doc, count(p.token) AS length FROM d LEFT JOIN p USING (doc) GROUP BY ALL), n AS (SELECT count(*) AS docs, avg(length) AS mean_length FROM l),
    f AS (SELECT token, count(*) AS df FROM t GROUP BY ALL), q AS ({queries}),
    s AS (SELECT q.query, t.doc, round(sum((CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) AS score
        FROM q JOIN f USING (token) JOIN t USING (token) JOIN l ON l.doc = t.doc CROSS JOIN n GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INT) AS rank FROM s QUALIFY rank <= {depth})"""


_TASKS = f"SELECT task_id AS query, unnest({sql_tokens('instruction')}) AS token FROM (SELECT DISTINCT task_id, instruction FROM tasks WHERE task_id % 100 = 0)"
_SEARCH = _search_sql(_DOCS, USED, _TASKS, 150)
_TITLES = f"SELECT listing_id AS query, unnest({sql_tokens('title')}) AS token FROM (SELECT DISTINCT listing_id, title FROM products WHERE listing_id % 100 = 0)"

ORACLES = {
    "search_topk": _SEARCH + " SELECT query AS task_id, doc AS listing_id, score, rank FROM r",
    "search_topk_shifted": _search_sql(_DOCS, SHIFTED_WEIGHTS, _TASKS, 150) + " SELECT query AS task_id, doc AS listing_id, score, rank FROM r",
    "search_shuffled": _SEARCH + " SELECT query AS task_id, doc AS listing_id, CAST(CASE WHEN rank <= 10 THEN row_number() OVER (PARTITION BY query, rank <= 10 ORDER BY md5(query::VARCHAR || '|' || doc::VARCHAR || '|5'), doc) ELSE rank END AS INT) AS rank FROM r",
    "quick_query": f"WITH p AS (SELECT DISTINCT listing_id, {SQL_MACROS['query_text'].format('title')} AS asked FROM products) SELECT q.listing_id AS query, p.listing_id FROM p JOIN p q USING (asked) WHERE q.listing_id % 100 = 0 AND asked <> ''",
    "quick_random": f"SELECT listing_id FROM (SELECT DISTINCT listing_id FROM products) ORDER BY md5(listing_id::VARCHAR || '|9'), listing_id LIMIT {DEPTH}",
    "search_page": _SEARCH + " SELECT query AS task_id, r.doc AS listing_id, title, brand, rank FROM r JOIN d USING (doc) WHERE rank BETWEEN 21 AND 40",
    "search_swapped": _SEARCH + """ SELECT query AS task_id, doc AS listing_id, CAST(CASE WHEN max(rank) OVER (PARTITION BY query) <= 40 OR rank > 40 THEN rank WHEN rank <= 20 THEN rank + 20 ELSE rank - 20 END AS INT) AS rank FROM r""",
    "search_documents": _search_sql("d AS (SELECT doc_id AS doc, text FROM documents WHERE text IS NOT NULL)", {"text": 1.0}, _TITLES, 10) + " SELECT query AS listing_id, doc AS doc_id, score, rank FROM r",
    "search_index_stats": _SEARCH + " SELECT docs, round(mean_length, 6) AS mean_length, (SELECT count(*) FROM f) AS tokens, (SELECT CAST(sum(df) AS BIGINT) FROM f) AS postings FROM n",
    "search_token_df": f"SELECT token, count(*) AS df FROM (SELECT listing_id, unnest({sql_tokens('title')}) AS token FROM (SELECT DISTINCT listing_id, title FROM products)) GROUP BY ALL",
    "title_models": f"SELECT listing_id, token AS model FROM (SELECT listing_id, unnest({sql_tokens('title')}) AS token FROM (SELECT DISTINCT listing_id, title FROM products)) WHERE regexp_matches(token, '[a-z]') AND regexp_matches(token, '[0-9]')",
    "quick_category": "WITH p AS (SELECT DISTINCT listing_id, category FROM products WHERE category IS NOT NULL) SELECT q.listing_id AS query, p.listing_id FROM p JOIN p q USING (category) WHERE q.listing_id % 100 = 0",
    "quick_attribute": """WITH p AS (SELECT DISTINCT listing_id, unnest(list_filter(attributes, lambda a: a <> '')) AS attribute FROM products), q AS (SELECT listing_id AS query, attribute FROM p WHERE listing_id % 100 = 0), w AS (SELECT query, count(*) AS wanted FROM q GROUP BY ALL)
        SELECT query, p.listing_id FROM q JOIN p USING (attribute) JOIN w USING (query) GROUP BY query, p.listing_id, wanted HAVING count(*) = wanted""",
}
QUERIES = {f.__name__: f for f in (search_topk, search_topk_folded, search_topk_shifted, search_shuffled, search_page, search_swapped, search_documents, search_index_stats, search_token_df, title_models, quick_query, quick_random, quick_category, quick_attribute)}
