"""Statistics of evaluations, groups and lengths as single aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evaluation(results: DataFrame, *keys: str, digits: int = 4) -> DataFrame:
    """Means over saved results (reward, reward_detail, purchase_asin, goal_asin), per ``keys``.

    A result with a reward detail is done. A missing option part counts as 1, other missing parts as 0;
    without a detail all parts are 0. No rows give no groups, or one row of zeros without keys.
    """
    done = F.col("reward_detail").isNotNull()
    part = lambda name, missing: F.when(done, F.coalesce(F.col(f"reward_detail.{name}"), F.lit(missing))).otherwise(0.0)
    kind, attr, option, price = part("r_type", 0.0), part("r_att", 0.0), part("r_option", 1.0), part("r_price", 0.0)
    right = (done & F.col("purchase_asin").eqNullSafe(F.col("goal_asin"))).cast("double")
    mean = lambda c, name: F.coalesce(F.round(F.avg(c).cast("decimal(18,9)"), digits).cast("double"), F.lit(0.0)).alias(name)
    full = (done & (kind == 1) & (attr == 1) & (option == 1) & (price == 1)).cast("double")
    return results.groupBy(*keys).agg(
        F.count("*").alias("samples"), mean(done.cast("double"), "done_rate"), mean(F.coalesce("reward", F.lit(0.0)), "loose"), mean(kind * attr * option * price, "hard"), mean(full, "success"),
        mean(kind, "type"), mean(attr, "attribute"), mean(option, "option"), mean(price, "price"), mean(right, "right_product"),
    )


def fixed_denominator(results: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Each expected key with its result; a missing result counts as one that is not done."""
    return expected.join(results, key, "left")


def numeric_summary(df: DataFrame, fields: Sequence[str], digits: int = 6) -> DataFrame:
    """(field, n, mean, std, min, max) of the finite values of each field; std is that of the population."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields))).alias("e")).select("e.*")
    finite = long.filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")))
    return finite.groupBy("field").agg(F.count("*").alias("n"), F.round(F.avg("v"), digits).alias("mean"), F.round(F.stddev_pop("v"), digits).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def categorical_rates(df: DataFrame, field: str, digits: int = 6) -> DataFrame:
    """(value, rate) of a field; signs in the value's name become underscores, null is the name 'None'."""
    named = F.regexp_replace(F.coalesce(F.col(field).cast("string"), F.lit("None")), r"[^\p{L}\p{N}_-]", "_")
    counts = df.groupBy(named.alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("value", F.round(F.col("n") / F.col("total"), digits).alias("rate"))


def group_spread(df: DataFrame, group: str, value: str, digits: int = 6) -> DataFrame:
    """Mean deviation within groups of two or more, and the share of them without any."""
    own = df.groupBy(group).agg(F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n")).filter("n > 1")
    return own.agg(F.count("*").alias("groups"), F.round(F.avg("std"), digits).alias("mean_std"), F.round(F.avg((F.col("low") == F.col("high")).cast("double")), digits).alias("zero_rate"))


def length_summary(df: DataFrame, length: Column, *keys: str) -> DataFrame:
    """Minimum, interpolated percentiles, maximum and mean of a length."""
    p = F.percentile(length, F.array(*(F.lit(x) for x in (0.5, 0.9, 0.95, 0.99))))
    out = df.groupBy(*keys).agg(F.min(length).alias("min"), p.alias("p"), F.max(length).alias("max"), F.round(F.avg(length), 2).alias("mean"))
    return out.select(*keys, "min", *(F.round(F.col("p")[i], 2).alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99"))), "max", "mean")


def running_counts(df: DataFrame, column: str, slices: int = 1000) -> DataFrame:
    """(value, n, upto) of each distinct value of a numeric column: its rows, and the rows up to it.

    Sums run within slices of the range of values, and over the slices, so no task sorts all values.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("value").cast("double").alias("_low"), F.max("value").cast("double").alias("_high"))  # one row
    at = F.coalesce(F.floor((F.col("value").cast("double") - F.col("_low")) * (slices - 1) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))), F.lit(0))
    sliced = counts.crossJoin(F.broadcast(span)).select("value", "n", at.alias("_slice"))
    ahead = F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))  # over ``slices`` rows
    starts = sliced.groupBy("_slice").agg(F.sum("n").alias("_n")).select("_slice", F.coalesce(ahead, F.lit(0)).alias("_start"))
    own = F.sum("n").over(Window.partitionBy("_slice").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return sliced.withColumn("_own", own).join(starts, "_slice").select("value", "n", (F.col("_start") + F.col("_own")).alias("upto"))


def ceil_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """(share, value): the smallest value that at least that share of the rows does not exceed."""
    reached = running_counts(df, column)
    total = reached.agg(F.max("upto").alias("total"))
    asked = df.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    joined = reached.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(asked))
    return joined.filter(F.col("upto") >= F.col("share") * F.col("total")).groupBy("share").agg(F.min("value").alias("value"))


def trained_totals(df: DataFrame, length: str, trained: str, limit: int) -> DataFrame:
    """One row: samples, those at or over the limit, tokens, and trained tokens with their share."""
    out = df.agg(F.count("*").alias("samples"), F.count_if(F.col(length) >= limit).alias("samples_at_max"), F.sum(length).alias("tokens"), F.sum(trained).alias("trained"))
    return out.withColumn("fraction", F.round(F.col("trained") / F.nullif(F.col("tokens"), F.lit(0)), 6))


def dense_histogram(df: DataFrame, column: str) -> DataFrame:
    """(value, n) for each whole number from the smallest to the largest value, zeros included."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("value")).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("value").alias("low"), F.max("value").alias("high")).filter("low IS NOT NULL").select(F.explode(F.sequence("low", "high")).alias("value"))
    return span.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def bin_counts(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of equal bins; values outside fall into bin 0 and bins + 1."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.width_bucket(F.col(column).cast("double"), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def distribution(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """(value, share): the share of rows up to each value."""
    reached = running_counts(df, column)
    total = reached.agg(F.max("upto").alias("total"))
    return reached.crossJoin(F.broadcast(total)).select("value", F.round(F.col("upto") / F.col("total"), digits).alias("share"))
