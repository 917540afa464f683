"""Cleaning of catalogue listings, their options, fingerprints and attribute mining."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import option_value, word_sequence

#: Rows whose digests one task joins for a fingerprint.
FINGERPRINT_ROWS = 1000


def clean(products: DataFrame) -> DataFrame:
    """One row per listing with defaults: texts trimmed, no empty attributes, no listing without a usable asin."""
    usable = F.col("asin").isNotNull() & ~F.lower("asin").isin("nan", "") & (F.length("asin") <= 20)
    return products.filter(usable).select(
        "listing_id", "asin", F.trim("title").alias("title"), F.coalesce(F.nullif(F.trim("brand"), F.lit("")), F.lit("N.A.")).alias("brand"),
        F.lower(F.trim(F.coalesce("category", F.lit("")))).alias("category"),
        F.filter(F.transform(F.coalesce("attributes", F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != "").alias("attributes"),
    )


def options(products: DataFrame) -> DataFrame:
    """(listing_id, name, place, value, image): every option value; null lists are skipped."""
    entries = products.select("listing_id", F.explode(F.map_entries("customization_options")).alias("e")).filter("e.value IS NOT NULL")
    values = entries.select("listing_id", F.lower("e.key").alias("name"), F.posexplode("e.value").alias("place", "v"))
    return values.select("listing_id", "name", "place", option_value("v.value").alias("value"), F.col("v.image").alias("image"))


def fingerprint(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(rows, sha256): a digest over the rows' digests in order of the key, as a tree of three levels.

    Keys of one thousand, and thousands of one million, are joined in a task each; the last join has a digest per million keys.
    """
    each = rows.select(F.floor(F.col(key) / FINGERPRINT_ROWS).alias("part"), F.col(key).alias("k"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("d"))
    joined = lambda order: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["d"]), ""), 256)
    parts = each.groupBy("part").agg(joined(F.struct("k", "d")).alias("d"), F.count("*").alias("n"))
    blocks = parts.groupBy(F.floor(F.col("part") / FINGERPRINT_ROWS).alias("block")).agg(joined(F.struct("part", "d")).alias("d"), F.sum("n").alias("n"))
    return blocks.agg(F.sum("n").alias("rows"), joined(F.struct("block", "d")).alias("sha256"))


def attribute_shares(listings: DataFrame, by: str, digits: int = 6) -> DataFrame:
    """(by, attribute, listings, share): in how many listings of a group an attribute is stated."""
    pairs = listings.select(by, "listing_id", F.explode(F.array_distinct("attributes")).alias("attribute"))
    total = listings.groupBy(by).agg(F.countDistinct("listing_id").alias("all"))
    counts = pairs.groupBy(by, "attribute").agg(F.count("*").alias("listings"))
    return counts.join(total, by).select(by, "attribute", "listings", F.round(F.col("listings") / F.col("all"), digits).alias("share"))


# Words that say nothing about a product; whole numbers below a thousand are left out as well.
STOP_WORDS = tuple("a an and are as at be by for from has in is it its of on or that the this to was were will with you your not no can our we all more".split())


def terms(text, ngrams: Sequence[int] = (1,), stop_words: Sequence[str] = ()):
    """The n-grams of a text's words and character pairs in order, repeats included; stop words are left out before they are joined."""
    words = F.filter(word_sequence(text), lambda w: ~w.isin(*stop_words) & ~F.rlike(w, F.lit("^[0-9]{1,3}$"))) if stop_words else word_sequence(text)

    def grams(n: int):
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
        return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*map(grams, ngrams)))


def top_terms(docs: DataFrame, by: str, key: str, text: str, k: int = 5, features: int = 1000, stop_words: Sequence[str] = (), ngrams: Sequence[int] = (1,), digits: int = 6) -> DataFrame:
    """(by, key, token, score, place): the ``k`` terms of each text with the highest TF-IDF within its group.

    Only the ``features`` most frequent terms of a group count (by all their uses, then the smaller term); idf is smoothed, ln((1 + N) / (1 + df)) + 1,
    and the vector of a text has length 1. Ties go to the smaller term. Null texts and groups have no terms.
    """
    tokens = docs.select(by, key, F.explode(terms(text, ngrams, stop_words)).alias("token")).groupBy(by, key, "token").agg(F.count("*").alias("tf"))
    size = docs.groupBy(by).agg(F.count("*").alias("N"))
    df = tokens.groupBy(by, "token").agg(F.count("*").alias("df"), F.sum("tf").alias("uses"))
    frequent = df.withColumn("f", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("uses"), "token"))).filter(F.col("f") <= features).join(size, by)
    weighted = tokens.join(frequent.select(by, "token", (F.log((1 + F.col("N")) / (1 + F.col("df"))) + 1).alias("idf")), [by, "token"]).withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(by, key)))
    scored = weighted.withColumn("score", F.round(F.col("w") / norm, digits))
    place = F.row_number().over(Window.partitionBy(by, key).orderBy(F.desc("score"), "token"))
    return scored.withColumn("place", place).filter(F.col("place") <= k).select(by, key, "token", "score", "place")
