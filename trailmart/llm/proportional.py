"""Draw a sample that meets target shares of categories, and report where it cannot.

Categories form a tree (difficulty > domain > option_bucket). Demand is set at the leaves; where a
leaf has fewer rows than its demand, the unmet quota goes top down: first to siblings (same
difficulty and domain), then to cousins (same difficulty), then to the rest of the tree, each
time in proportion to the spare rows there. At the leaves, rows are drawn by their dense rank in
a pseudo-random permutation. The rank of a row is the number of rows in earlier slices of the
permutation plus its rank in its own slice, so no task sorts a whole stratum.

* Labels that differ in case, width or outer white space are one label, also among the targets: rows that
  state one stratum are one target, with the sum of their shares and the largest of their minimums. Rows with a null or blank
  label in any column, or with a null key, take no part. A redelivered row counts once.
* What a leaf passes on, as it has too few rows, is its ``passed_on``: the strata that can't be met (``p2_found``)
  are those that passed on anything. Targets without rows, and an empty table, get 0 and pass on all.
* Ties in the permutation are impossible (the key breaks them); the draw is the same in every run.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import table

LABELS = ["difficulty", "domain", "option_bucket"]
#: The sample is this share of the rows that take part.
SAMPLE_SHARE = 5
#: Slices of the permutation in which rows are ranked apart, and the most targets a table may state.
SLICES, MOST_TARGETS = 4096, 100_000
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_PLAIN = "".join(map(chr, range(0x21, 0x7F)))


def one_label(c: Column) -> Column:
    """The label without differences of case, width and outer white space; blank gives null."""
    plain = F.lower(F.translate(c, _WIDE, _PLAIN))
    return F.nullif(F.regexp_replace(plain, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), F.lit(""))


def labelled(tasks: DataFrame) -> DataFrame:
    """(task_id, one-form labels) of the rows that take part, each task once."""
    return tasks.select("task_id", *(one_label(F.col(c)).alias(c) for c in LABELS)).dropna().distinct()


def demands(tasks: DataFrame, targets: DataFrame) -> DataFrame:
    """Each stated stratum (``stated``: its rows as written) with its demand and the number of its rows.

    Both sides of the join are aggregates by stratum; Spark chooses a broadcast only below its size threshold.
    """
    had = labelled(tasks).groupBy(*LABELS).agg(F.count("*").alias("available"))
    total = had.agg(F.expr(f"coalesce(sum(available), 0) div {SAMPLE_SHARE}").alias("sample_rows"))
    spelt = F.struct(*(F.col(c).alias(c) for c in LABELS))
    stated = targets.select(*(one_label(F.col(c)).alias(c) for c in LABELS), spelt.alias("stated"), "target_permille", "min_rows")
    stated = stated.groupBy(*LABELS).agg(F.collect_list("stated").alias("stated"), F.sum("target_permille").alias("permille"), F.max("min_rows").alias("least"))
    joined = stated.join(had, LABELS, "left").crossJoin(F.broadcast(total))  # total is one row
    share = F.expr("(cast(coalesce(permille, 0) AS bigint) * sample_rows + 999) div 1000")
    return joined.select(*LABELS, "stated", F.greatest(F.coalesce(F.col("least").cast("long"), F.lit(0)), share).alias("demand"), F.coalesce("available", F.lit(0)).alias("available"))


def _share_out(want: int, spare: list[int]) -> list[int]:
    """Split ``want`` in proportion to the spare rows, never more than there are; largest remainders first."""
    whole = sum(spare)
    want = min(want, whole)
    if want <= 0:
        return [0] * len(spare)
    given = [want * s // whole for s in spare]
    by_rest = sorted(range(len(spare)), key=lambda i: (-(want * spare[i] % whole), i))
    left = want - sum(given)
    while left:
        for i in by_rest:
            if left and given[i] < spare[i]:
                given[i] += 1
                left -= 1
    return given


def allocate(strata: pd.DataFrame) -> pd.DataFrame:
    """Fill the columns ``allocated`` and ``passed_on``; unmet quota goes to siblings, cousins, then all others."""
    strata = strata.sort_values(LABELS, kind="stable", na_position="last").reset_index(drop=True)
    if len(strata) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} target rows")
    room = strata.available.astype("int64").tolist()
    given = [min(d, a) for d, a in zip(strata.demand.astype("int64").tolist(), room, strict=True)]
    unmet = {i: int(d) - g for i, (d, g) in enumerate(zip(strata.demand, given, strict=True)) if d > g}
    passed_on = [unmet.get(i, 0) for i in range(len(strata))]
    for depth in (2, 1, 0):
        nodes: dict[tuple, list[int]] = {}
        for i, labels in enumerate(strata[LABELS].itertuples(index=False, name=None)):
            nodes.setdefault(labels[:depth], []).append(i)
        for members in nodes.values():
            want = sum(unmet.get(i, 0) for i in members)
            for i, n in zip(members, _share_out(want, [room[i] - given[i] for i in members]), strict=True):
                given[i] += n
                want -= n
            for i in members:  # what is left over moves up the tree, kept at the first member
                unmet.pop(i, None)
            if want > 0:
                unmet[members[0]] = want
    return strata.assign(allocated=given, passed_on=passed_on)


def allocation(tasks: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows of ``demands`` with ``allocated`` and ``passed_on``. One group of as many rows as the table of targets, whose size is checked."""
    wanted = demands(tasks, targets)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema) + ", allocated bigint, passed_on bigint"
    return wanted.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda rows: allocate(rows.drop(columns="_all")), schema)


def permuted_rank(rows: DataFrame, strata: list[str], key: str, seed: int = 42, slices: int = SLICES) -> DataFrame:
    """``rows`` with ``rank``: the place, from 1, in a pseudo-random permutation of its stratum."""
    order = F.xxhash64(F.lit(seed), key)
    sliced = rows.withColumn("_order", order).withColumn("_slice", F.shiftrightunsigned("_order", 64 - (slices - 1).bit_length()).cast("int"))
    counts = sliced.groupBy(*strata, "_slice").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*strata).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*strata, "_slice", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    own = Window.partitionBy(*strata, "_slice").orderBy("_order", key)
    ranked = sliced.withColumn("_own", F.row_number().over(own)).join(starts, [*strata, "_slice"])
    return ranked.select(*rows.columns, (F.col("_start") + F.col("_own")).alias("rank"))


def draw(tasks: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(task_id, labels) of the sample."""
    quota = allocation(tasks, targets).select(*LABELS, "allocated")
    ranked = permuted_rank(labelled(tasks), LABELS, "task_id", seed)
    return ranked.join(quota, LABELS).filter("rank <= allocated").select("task_id", *LABELS)


def _tables(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "tasks", "task_id", *LABELS), table(spark, sf_dir, "sample_targets")


def p2_found(spark, sf_dir: str) -> DataFrame:
    """The targets whose stratum passed on quota in the allocation, as it has fewer tasks than its demand."""
    short = allocation(*_tables(spark, sf_dir)).filter("passed_on > 0")
    return short.select(F.inline("stated")).select(*LABELS)


def p2_sample(spark, sf_dir: str) -> DataFrame:
    return draw(*_tables(spark, sf_dir))


def p2_allocation(spark, sf_dir: str) -> DataFrame:
    return allocation(*_tables(spark, sf_dir)).select(*LABELS, "demand", "available", "allocated", "passed_on")


def _label_sql(c: str) -> str:
    return rf"nullif(regexp_replace(lower(translate({c}, '{_WIDE}', '{_PLAIN.replace(chr(39), chr(39) * 2)}')), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '')"


ORACLES = {
    "p2_found": f"""
        WITH t AS (SELECT DISTINCT task_id, {", ".join(f"{_label_sql(c)} AS {c}" for c in LABELS)} FROM tasks),
        k AS (SELECT * FROM t WHERE task_id IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL" for c in LABELS)}),
        n AS (SELECT count(*) // {SAMPLE_SHARE} AS n FROM k),
        h AS (SELECT {", ".join(LABELS)}, count(*) AS had FROM k GROUP BY ALL)
        SELECT s.difficulty, s.domain, s.option_bucket FROM sample_targets s CROSS JOIN n LEFT JOIN h
        ON {" AND ".join(f"{_label_sql('s.' + c)} = h.{c}" for c in LABELS)}
        WHERE greatest(s.min_rows, (s.target_permille * n.n + 999) // 1000) > coalesce(h.had, 0)
    """
}
QUERIES = {"p2_found": p2_found, "p2_sample": p2_sample, "p2_allocation": p2_allocation}
