"""Choose the surviving value of each metric in a group of records of the same rollout.

The operator is a token-level consensus. The values of a group are written as tokens (digits,
point, sign), aligned progressively to a growing profile, every column of the profile is put to
a vote weighted by the records, and the existing value closest to the winning tokens survives.
All usable values vote. Two kinds of weights:

* ``STRICT`` (``p4_found``): the best record outweighs any number of lesser ones, as the stated rule
  asks. A weight is the record's place in the order of trust, time and key itself, and the weights for a
  token are compared by their greatest, so no number of lesser votes can add up to it.
* ``GRADED`` (``p4_consensus``): trust counts 1 / rank, halved for each ``HALF_LIFE`` days behind the group's
  newest record (and once if it has no date), and weights add up: lesser records that agree can outvote one.

A record is shuffled once, as one row with its metrics. A group of more than ``PART_ROWS`` records is voted
on in parts: a part sends the profile of a metric, whose size depends on how long a number is and not on
how many there are; profiles are aligned to each other, and the closest value is found by an aggregate.

Defined results: null, non-finite and negative values are not usable; an unknown or null verifier
comes last, then a null ``written_at``; ties go to the larger ``record_id``. Records without
task, rollout number or record_id are in no group; repeated rows count once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import table
from ..sources.tables import cut

#: Most records of a group that one task votes on at once; days that halve a graded weight; rank of an unknown verifier.
PART_ROWS, HALF_LIFE, LAST = 5000, 30.0, 2**31 - 1
GAP = ""
GROUP = ["task_id", "rollout_no"]


def tokens(value: float) -> list[str]:
    return list(repr(value))


class Votes:
    """How the weights of equal tokens combine: ``STRICT`` by the greatest, ``GRADED`` by the sum."""

    def __init__(self, combine: Callable, weight: Callable):
        self.combine, self.weight = combine, weight


def _graded(trust: int, at: int | None, record: int, newest: int | None) -> float:
    behind = 1.0 if at is None or newest is None else (newest - at) / 86_400_000_000 / HALF_LIFE
    return 0.5**behind / (trust if trust < LAST else 100)


STRICT = Votes(max, lambda trust, at, record, newest: (-trust, at is not None, at or 0, record))
GRADED = Votes(lambda a, b: a + b, _graded)

#: A profile: its columns, each with the weight of every token in it (or of a gap), and the weight of all values in it.
Profile = tuple[list[dict], object]


def profile(value: list[str], weight) -> Profile:
    return [{t: weight} for t in value], weight


def _winner(column: dict) -> str:
    return max(column, key=lambda t: (column[t], t))


def _align(a: list[dict], b: list[dict]) -> list[tuple[int, int]]:
    """Pairs of columns, -1 for none: the alignment with most columns won by the same token, then with most that share one."""
    n, m = len(a), len(b)
    left, right = [_winner(c) for c in a], [_winner(c) for c in b]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    fit = [[4 if left[i] == right[j] != GAP else 1 if a[i].keys() & b[j].keys() - {GAP} else -1 for j in range(m)] for i in range(n)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = max(below[j + 1] + fit[i][j], below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and best[i][j] == best[i + 1][j + 1] + fit[i][j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif i < n and best[i][j] == best[i + 1][j]:
            out.append((i, -1))
            i += 1
        else:
            out.append((-1, j))
            j += 1
    return out


def merge(a: Profile, b: Profile, votes: Votes) -> Profile:
    """Two profiles aligned to each other; every value of either votes in every column, with a token or a gap."""
    columns = []
    for i, j in _align(a[0], b[0]):
        column = dict(a[0][i]) if i >= 0 else {GAP: a[1]}
        for token, weight in (b[0][j] if j >= 0 else {GAP: b[1]}).items():
            column[token] = votes.combine(column[token], weight) if token in column else weight
        columns.append(column)
    return columns, votes.combine(a[1], b[1])


def consensus(profiles: Iterable[Profile], votes: Votes) -> Profile:
    """The profile of all, aligned one after the other."""
    whole = None
    for one in profiles:
        whole = one if whole is None else merge(whole, one, votes)
    return whole


def winners(whole: Profile) -> str:
    return "".join(t for t in map(_winner, whole[0]) if t != GAP)


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        ahead, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            ahead, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, ahead + (x != y))
    return row[-1]


#: A vote: the value, its weight, and its record's place in the order of priority.
Vote = tuple[float, object, tuple]


def weighed(cell: list[Vote], votes: Votes) -> list[Vote]:
    """The distinct values with their combined weights and best records, best first."""
    by_value: dict[float, list] = {}
    for value, weight, order in cell:
        had = by_value.get(value)
        if had is None:
            by_value[value] = [weight, order]
        else:
            had[0], had[1] = votes.combine(had[0], weight), max(had[1], order)
    return sorted(((v, w, o) for v, (w, o) in by_value.items()), key=lambda x: x[2], reverse=True)


def survivor(cell: list[Vote], votes: Votes) -> Vote:
    """The existing value closest to the consensus of all values, with its best record."""
    values = weighed(cell, votes)
    if len(values) == 1:  # the vote of one value is that value
        return values[0]
    agreed = winners(consensus((profile(tokens(v), w) for v, w, _ in values), votes))
    return min(values, key=lambda x: edits(repr(x[0]), agreed))  # of equally close ones the first, the best


def rollout_number(c) -> Column:
    """The number in a rollout id, in any of its writings."""
    return F.expr(f"try_cast(regexp_extract({c}, '([0-9]+)', 1) AS bigint)")


RECORD = [*GROUP, "part", "newest", "record_id", "trust", "at", "metrics"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of one group after the other, from rows in order of their group."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, group in groupby(rows, key=lambda r: r[:3]):
        yield key, list(group)


def _cells(rows: list[tuple], votes: Votes) -> dict[str, list[Vote]]:
    """The votes on each metric; a repeated row votes once."""
    out: dict[str, list[Vote]] = {}
    newest = max((r[3] for r in rows if r[3] is not None), default=None)
    for _, _, _, _, record, trust, at, metrics in {r[4]: r for r in rows}.values():
        weight, order = votes.weight(trust, at, record, newest), STRICT.weight(trust, at, record, newest)
        for metric, value in metrics:
            if math.isfinite(value) and value >= 0:
                out.setdefault(metric, []).append((value + 0.0, weight, order))
    return out


FOUND = "task_id long, rollout_no long, metric string, record_id long, value double"
PROFILE = "task_id long, rollout_no long, metric string, profile binary"


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _paged(rows: Iterator[tuple], kinds: list[pa.DataType], schema: str) -> Iterator[pa.RecordBatch]:
    names, page = [c.split()[0] for c in schema.split(", ")], []
    for row in rows:
        page.append(row)
        if len(page) == 10_000:
            yield _batch(page, kinds, names)
            page = []
    yield _batch(page, kinds, names)


def _voted(parts: DataFrame, votes: Votes) -> DataFrame:
    """Survivors of groups that are whole within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for (task, no, _), rows in _groups(batches):
                if len({r[4] for r in rows}) < 2:
                    continue
                for metric, cell in _cells(rows, votes).items():
                    value, _, order = survivor(cell, votes)
                    yield task, no, metric, order[3], value

        yield from _paged(found(), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64()], FOUND)

    return parts.mapInArrow(run, FOUND)


def _voted_in_parts(parts: DataFrame, votes: Votes) -> DataFrame:
    """Survivors of groups dealt to several tasks: profiles of the parts, their alignment, then the closest values."""
    import pickle

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for (task, no, _), rows in _groups(batches):
                for metric, cell in _cells(rows, votes).items():
                    yield task, no, metric, pickle.dumps(consensus((profile(tokens(v), w) for v, w, _ in weighed(cell, votes)), votes))

        yield from _paged(found(), [pa.int64(), pa.int64(), pa.string(), pa.binary()], PROFILE)

    def aligned(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = consensus((pickle.loads(p) for b in rows for p in b.column("profile").to_pylist()), votes)  # one at a time
        yield _batch([(*(k.as_py() for k in key), winners(whole))], [pa.int64(), pa.int64(), pa.string(), pa.string()], [*GROUP, "metric", "agreed"])

    agreed = parts.mapInArrow(profiles, PROFILE).groupBy(*GROUP, "metric").applyInArrow(aligned, "task_id long, rollout_no long, metric string, agreed string")
    cells = parts.select(*GROUP, "part", "newest", "record_id", "trust", "at", F.explode("metrics").alias("metric", "value"))

    def distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [edits(repr(v + 0.0), a) for v, a in zip(b.column("value").to_pylist(), b.column("agreed").to_pylist(), strict=True)]
            yield b.append_column("edits", pa.array(near, pa.int32()))

    fields = "task_id long, rollout_no long, metric string, value double, order struct<trust:int,dated:boolean,at:long,record_id:long>, agreed string"
    order = F.struct((-F.col("trust")).alias("trust"), F.col("at").isNotNull().alias("dated"), F.coalesce("at", F.lit(0)).alias("at"), "record_id")
    distinct = cells.groupBy(*GROUP, "metric", "value").agg(F.max(order).alias("order")).join(agreed, [*GROUP, "metric"])
    measured = distinct.select(*GROUP, "metric", "value", "order", "agreed").mapInArrow(distance, fields + ", edits int")
    best = measured.groupBy(*GROUP, "metric").agg(F.max_by(F.struct("order.record_id", "value"), F.struct((-F.col("edits")).alias("e"), "order")).alias("b"))
    return best.select(*GROUP, "metric", "b.record_id", "b.value")


def survivors(rollouts: DataFrame, verifiers: DataFrame, votes: Votes = STRICT, part_rows: int = PART_ROWS) -> DataFrame:
    """(task_id, rollout_no, metric, record_id, value) of each group of two or more records."""
    trust = verifiers.groupBy("verifier").agg(F.min("trust_rank").alias("trust_rank"))
    records = rollouts.select(
        F.col("record_id").cast("long").alias("record_id"), F.col("task_id").cast("long").alias("task_id"), rollout_number("rollout_id").alias("rollout_no"), "verifier",
        F.unix_micros(F.col("written_at").cast("timestamp")).alias("at"), F.col("verification.metrics").alias("metrics"),
    ).dropna(subset=["record_id", *GROUP])
    sizes = records.groupBy(*GROUP).agg(F.count("*").alias("n"), F.min("record_id").alias("low"), F.max("record_id").alias("high"), F.max("at").alias("newest"))
    large = cut(sizes.filter(F.col("n") > part_rows))
    usable = F.map_filter(F.coalesce("metrics", F.create_map().cast("map<string,double>")), lambda _, v: (v >= 0) & (v < float("inf")))
    ranked = records.join(trust, "verifier", "left").select(*GROUP, "record_id", F.coalesce("trust_rank", F.lit(LAST)).alias("trust"), "at", usable.alias("metrics"))
    if large.isEmpty():
        return _voted(_dealt(ranked.select("*", F.lit(0).alias("part"), F.col("at").alias("newest"))), votes)
    small = ranked.join(large, GROUP, "left_anti").select("*", F.lit(0).alias("part"), F.col("at").alias("newest"))
    part = F.pmod(F.xxhash64("record_id"), F.ceil(F.col("n") / part_rows)).cast("int").alias("part")
    hot = ranked.join(large.filter("low < high"), GROUP).select("*", part)
    return _voted(_dealt(small), votes).unionByName(_voted_in_parts(_dealt(hot), votes))


def _dealt(rows: DataFrame) -> DataFrame:
    """Each part of a group whole within a task, in order."""
    return rows.select(*RECORD).repartition(*GROUP, "part").sortWithinPartitions(*GROUP, "part")


def _chosen(spark, sf_dir: str, votes: Votes = STRICT) -> DataFrame:
    columns = ["record_id", "task_id", "rollout_id", "verifier", "written_at", "verification"]
    return survivors(table(spark, sf_dir, "rollouts", *columns), table(spark, sf_dir, "verifiers", "verifier", "trust_rank"), votes)


def p4_found(spark, sf_dir: str) -> DataFrame:
    return _chosen(spark, sf_dir).select("task_id", "rollout_no", "metric", "record_id")


def _built(chosen: DataFrame) -> DataFrame:
    merged = chosen.groupBy("task_id", "rollout_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    return merged.select("task_id", "rollout_no", F.to_json("metrics").alias("metrics"))


def p4_survivors(spark, sf_dir: str) -> DataFrame:
    """One built record of each group: every metric with its surviving value."""
    return _built(_chosen(spark, sf_dir))


def p4_consensus(spark, sf_dir: str) -> DataFrame:
    """The same where trust and recency are weights that add up, so that agreeing records can outvote a more trusted one."""
    return _built(_chosen(spark, sf_dir, GRADED))


ORACLES = {
    "p4_found": """
        WITH r AS (SELECT DISTINCT record_id, CAST(task_id AS BIGINT) AS task_id, TRY_CAST(regexp_extract(rollout_id, '([0-9]+)', 1) AS BIGINT) AS rollout_no, verifier, written_at, verification.metrics AS m FROM rollouts),
        k AS (SELECT * FROM r WHERE task_id IS NOT NULL AND rollout_no IS NOT NULL QUALIFY count(DISTINCT record_id) OVER (PARTITION BY task_id, rollout_no) > 1),
        e AS (SELECT k.*, unnest(map_keys(m)) AS metric, unnest(map_values(m)) AS value FROM k)
        SELECT e.task_id, e.rollout_no, e.metric, e.record_id FROM e LEFT JOIN verifiers v USING (verifier)
        WHERE value >= 0 AND isfinite(value)
        QUALIFY row_number() OVER (PARTITION BY e.task_id, e.rollout_no, e.metric ORDER BY v.trust_rank NULLS LAST, e.written_at DESC NULLS LAST, e.record_id DESC) = 1
    """
}
QUERIES = {"p4_found": p4_found, "p4_survivors": p4_survivors, "p4_consensus": p4_consensus}
