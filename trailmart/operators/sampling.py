"""Allocation, sampling and splitting.

Orders are drawn from a digest of the key and a seed, so that a draw does not depend on partitions,
and SQL can repeat it. Strata are few and small; the windows over them come after an aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Keys of a range in which rows are ranked apart.
RANGE = 1024


def draw_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def ranked(df: DataFrame, by: Sequence[str], key: str, seed: int, name: str = "place") -> DataFrame:
    """The place of each row in the drawn order of its stratum.

    Rows are ranked within slices of the order, and slices are counted, so a hot stratum is many tasks.
    """
    digest = draw_order(key, seed)
    sliced = df.withColumn("_order", digest).withColumn("_slice", F.substring("_order", 1, 3))
    counts = sliced.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*by, "_slice", F.coalesce(ahead, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy("_order", key))
    placed = sliced.withColumn("_own", own).join(starts, [*by, "_slice"])
    return placed.select(*df.columns, (F.col("_start") + F.col("_own")).alias(name))


def largest_remainder(strata: DataFrame, keys: Sequence[str], size: str, total: int) -> DataFrame:
    """(keys, size, allocated): ``total`` shared out in proportion to sizes.

    Each stratum gets at least one and at most its size. Rounding leftovers go to the largest
    remainders (then the larger key); if the minimum of one overshoots, units are taken back
    where the excess is largest. A total above the rows or below the number of strata gives no row.
    """
    whole = strata.agg(F.sum(size).alias("_cap"), F.count("*").alias("_strata"))  # one row
    base = strata.crossJoin(F.broadcast(whole)).filter((F.col("_cap") >= total) & (F.col("_strata") <= total))
    base = base.withColumn("_ideal", F.lit(float(total)) * F.col(size) / F.col("_cap"))
    base = base.withColumn("_floor", F.least(F.col(size), F.greatest(F.lit(1), F.floor("_ideal"))))
    left = F.lit(total) - F.sum("_floor").over(Window.partitionBy(F.lit(0)))
    base = base.withColumn("_left", left)
    plus = F.row_number().over(Window.partitionBy(F.col("_floor") >= F.col(size)).orderBy(F.desc(F.col("_ideal") - F.col("_floor")), *(F.desc(k) for k in keys)))
    grown = base.withColumn("_plus", F.when((F.col("_floor") < F.col(size)) & (plus <= F.col("_left")), 1).otherwise(0))
    units = grown.filter("_left < 0 AND _floor > 1").select(*keys, "_left", (F.col("_ideal") - F.col("_floor")).alias("_gap"), F.explode(F.sequence(F.lit(0), F.least(F.col("_floor") - 2, -F.col("_left") - 1).cast("int"))).alias("_j"))  # no stratum gives back more than all have to
    taken = units.withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("_gap") + F.col("_j"), *keys))).filter("_k <= -_left")
    minus = taken.groupBy(*keys).agg(F.count("*").alias("_minus"))
    return grown.join(minus, list(keys), "left").select(*keys, size, (F.col("_floor") + F.col("_plus") - F.coalesce("_minus", F.lit(0))).cast("long").alias("allocated"))


def stratified_sample(df: DataFrame, keys: Sequence[str], key: str, total: int, seed: int = 42) -> DataFrame:
    """A sample of ``total`` rows with each stratum's share."""
    quota = largest_remainder(df.groupBy(*keys).agg(F.count("*").alias("rows")), keys, "rows", total)
    placed = ranked(df, keys, key, seed)
    return placed.join(quota.select(*keys, "allocated"), list(keys)).filter("place <= allocated").drop("place", "allocated")


def quota_sample(df: DataFrame, by: str, quotas: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Up to ``quota`` rows of each value of ``by``; ``quotas`` has (by, quota)."""
    return ranked(df, [by], key, seed).join(quotas, by).filter("place <= quota").drop("place", "quota")


def proportional_quotas(counts: DataFrame, by: str, n: str, total: int) -> DataFrame:
    """(by, quota): whole parts of the shares, leftovers to the largest fractions, then the larger name."""
    whole = counts.agg(F.sum(n).alias("_all"))
    share = counts.crossJoin(F.broadcast(whole)).withColumn("_share", F.lit(total) * F.col(n) / F.col("_all")).withColumn("_floor", F.floor("_share"))
    share = share.withColumn("_left", F.lit(total) - F.sum("_floor").over(Window.partitionBy(F.lit(0))))
    k = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("_share") - F.col("_floor")), F.desc(by)))
    return share.withColumn("_k", k).select(by, (F.col("_floor") + (F.col("_k") <= F.col("_left")).cast("int")).cast("long").alias("quota"))


def disjoint_splits(df: DataFrame, by: str, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Each row with its ``split``: consecutive ranges of the drawn order of each stratum; the last split takes the rest."""
    placed = ranked(df, [by], key, seed).join(df.groupBy(by).agg(F.count("*").alias("_n")), by)
    upto, split = 0.0, None
    for name, share in shares.items():
        upto += share
        test = F.col("place") <= F.floor(F.round(F.lit(upto) * F.col("_n"), 9))
        split = F.when(test, name) if split is None else split.when(test, name)
    return placed.withColumn("split", split.otherwise(list(shares)[-1])).drop("place", "_n")


def first_per(df: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each group, as an aggregate: no group is sorted or held."""
    columns = [c for c in df.columns if c not in by]
    least = F.min_by(F.struct(*columns), F.struct(*order)).alias("_row")
    return df.groupBy(*by).agg(least).select(*by, "_row.*")


def in_key_order(df: DataFrame, by: Sequence[str], key: str, name: str) -> DataFrame:
    """The place of each row in its stratum in order of a whole-number key, which must be unique.

    Rows are counted in ranges of ``RANGE`` keys, and ranked within a range, so no task sorts a whole stratum.
    """
    ranged = df.withColumn("_range", F.floor(F.col(key) / RANGE))
    counts = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*by, "_range", F.coalesce(ahead, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(key))
    return ranged.withColumn("_own", own).join(starts, [*by, "_range"]).select(*df.columns, (F.col("_start") + F.col("_own")).alias(name))


def refill(rows: DataFrame, pool: DataFrame, strata: Sequence[str], key: str, mark: str) -> DataFrame:
    """(removed, added): each repeated row beside the pool row of its stratum that takes its place.

    Of rows of one ``mark`` the smallest key stays. The n-th removed row of a stratum gets its n-th
    usable pool row, the first of its mark and of a mark that no kept row has; ``added`` is null if there is none.
    """
    kept = rows.groupBy(mark).agg(F.min(key).alias("_kept"))
    # the aggregate has one row per mark, so a hot mark is on one side only, where Spark splits it
    removed = rows.join(kept, mark).filter(F.col(key) > F.col("_kept"))
    fresh = first_per(pool.select(key, mark, *strata), [mark], [key]).join(kept, mark, "left_anti")
    left = in_key_order(removed.select(*strata, F.col(key).alias("removed")), strata, "removed", "_n")
    right = in_key_order(fresh.select(*strata, F.col(key).alias("added")), strata, "added", "_n")
    return left.join(right, [*strata, "_n"], "left").select("removed", "added")


def remaining(eligible: DataFrame, taken: DataFrame, key: str, mark: str) -> DataFrame:
    """Eligible rows that are not taken, neither by their key nor by their mark. A null mark is nobody's."""
    return eligible.join(taken.select(key).distinct(), key, "left_anti").join(taken.select(mark).filter(F.col(mark).isNotNull()).distinct(), mark, "left_anti")


def eligibility(tasks: DataFrame, key: str, split: str, mark: str, train: str, held_out: Sequence[str], low: int | None = None, high: int | None = None) -> DataFrame:
    """(key, mark, state) of the rows with keys in [low, high): 'wrong tag', 'held-out instruction' or 'eligible'."""
    inside = tasks if low is None else tasks.filter(F.col(key) >= low)
    inside = inside if high is None else inside.filter(F.col(key) < high)
    seen = tasks.filter(F.col(split).isin(*held_out) & F.col(mark).isNotNull()).select(mark).distinct().withColumn("_seen", F.lit(True))
    state = F.when(~F.coalesce(F.col(split) == train, F.lit(False)), "wrong tag").when(F.col("_seen"), "held-out instruction").otherwise("eligible")
    return inside.join(seen, mark, "left").select(key, mark, state.alias("state"))


def pilot(rows: DataFrame, size: int, key: str, seed: int = 42, domain: str = "domain", first: tuple[str, str] = ("difficulty", "hard"), second: tuple[str, str] = ("option_bucket", "multi"), cover: bool = True) -> DataFrame:
    """``size`` rows: one of each domain, then hard ones with several options of the largest domain, then any; each in drawn order.

    If there are more domains than rows are asked, that is an error; without ``cover`` it is the domains that are drawn first.
    """
    counts = rows.groupBy(domain).agg(F.count("*").alias("n"))
    if cover and counts.count() > size:
        raise ValueError("a pilot must cover every domain")
    largest = counts.orderBy(F.desc("n"), F.desc(domain)).limit(1).select(F.col(domain).alias("_largest"))  # one row
    drawn = rows.withColumn("_order", draw_order(key, seed))
    best = first_per(drawn.select(domain, key, "_order"), [domain], ["_order", key]).select(key).withColumn("_own", F.lit(True))
    wanted = F.coalesce((F.col(domain) == F.col("_largest")) & (F.col(first[0]) == first[1]) & (F.col(second[0]) == second[1]), F.lit(False))
    ranked_ = drawn.join(best, key, "left").crossJoin(F.broadcast(largest)).withColumn("_group", F.when(F.col("_own"), 0).when(wanted, 1).otherwise(2))
    return ranked_.orderBy("_group", "_order", key).limit(size).select(*rows.columns)


def split_by_quotas(rows: DataFrame, by: str, key: str, quotas: dict[str, dict[str, int]], mark: str | None = None, seed: int = 42) -> DataFrame:
    """Each row with its ``split``: consecutive ranges of the drawn order of each value of ``by``, as many as the quotas say.

    Repeated or null keys and marks, and quotas that do not use up every row exactly, are errors.
    """
    unique = [key] if mark is None else [key, mark]
    n = rows.agg(F.count("*").alias("rows"), *(F.countDistinct(c).alias(c) for c in unique)).first()
    if any(n[c] != n["rows"] for c in unique):
        raise ValueError("keys and marks must be there, and each once")
    asked = {v: sum(q.get(v, 0) for q in quotas.values()) for v in {v for q in quotas.values() for v in q}}
    have = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count("*").alias("n")).limit(len(asked) + 2).collect()}
    if {k: v for k, v in asked.items() if v} != have:
        raise ValueError(f"quotas {asked} do not use up the rows {have}")
    placed, split = ranked(rows, [by], key, seed), F.lit(None)
    for value in asked:
        upto = 0
        for name, own in quotas.items():
            low, upto = upto, upto + own.get(value, 0)
            split = F.when((F.col(by) == value) & (F.col("place") > low) & (F.col("place") <= upto), name).otherwise(split)
    return placed.withColumn("split", split).drop("place")


def hash_split(df: DataFrame, key: str, permille: int, seed: int = 42) -> DataFrame:
    """Rows with ``part`` 'test' for about ``permille`` of the keys, else 'train'; needs no shuffle."""
    bucket = F.pmod(F.conv(F.substring(draw_order(key, seed), 1, 8), 16, 10).cast("long"), F.lit(1000))
    return df.withColumn("part", F.when(bucket < permille, "test").otherwise("train"))


def weighted_draw(df: DataFrame, key: str, weight: str, count: int, seed: int = 42) -> DataFrame:
    """``count`` rows without replacement, each likelier by its weight (exponential keys)."""
    uniform = (F.conv(F.substring(draw_order(key, seed), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(16**12 + 1))
    return df.filter(F.col(weight) > 0).withColumn("_e", -F.log(uniform) / F.col(weight)).orderBy("_e", key).limit(count).drop("_e")
