"""Find records of evaluation splits that also occur, exactly or almost, in the training split.

Texts are brought to their canonical form; records of one form are one class. Classes that state the
same numbers are a block and get minwise hashes of their character shingles, in bands; classes of different
splits that agree in a band and whose lengths allow it are candidates. Of these, the exact Jaccard similarity
of the shingles is taken, and what stays is checked by its edit distance. Last, the pairs of classes are
expanded to pairs of records, or counted per split and source from the sizes of the classes.

Parameters. Near means here at most ``MOST_EDITS`` single-character edits per character of the
longer text, as the task states it, so shingles are two characters long: a share of 0.15 edits
leaves a Jaccard similarity of at least ``WORST`` = (1 - 0.3) / (1 + 0.3) = 0.54. In blocks of up to ``SMALL_BLOCK``
classes a band has two hashes. Where numbers tell nothing apart, in large blocks (texts without numbers are one), a band
has a hash more for every fourfold size, which spares candidates. In a block of any size bands are as many as miss a pair
of that similarity with probability 0.0003, so the size decides on the work only. ``LEAST_JACCARD`` is well below ``WORST``.

* Null texts and records of other splits take no part; a repeated row counts once.
* Blank texts are one class and never a near match of another.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import spread, table
from ..sources.tables import cut
from .instructions import canonical, digest

TRAIN, HELD_OUT = ["train"], ["eval", "online_dev", "test"]
SHINGLE, LEAST_JACCARD, MOST_EDITS, WORST = 2, 0.4, 0.15, 0.54
SMALL_BLOCK, MOST_ROWS, MISSED = 200, 8, 0.0003


def bands_of(classes: int) -> tuple[int, int]:
    """(hashes of a band, bands) in a block of so many classes."""
    more = max(0, math.ceil(math.log(max(1, classes) / SMALL_BLOCK, 4)))
    rows = min(MOST_ROWS, 2 + more)
    return rows, math.ceil(math.log(MISSED) / math.log(1 - WORST**rows))


_SEEDS = np.random.default_rng(7).integers(1, 2**63, (2, MOST_ROWS * bands_of(2**62)[1]), dtype=np.uint64)
_SEEDS[0] |= np.uint64(1)


def shingles(fields: list[tuple[str, str]]) -> Counter:
    """Character shingles of each field; their order does not matter."""
    out: Counter = Counter()
    for k, v in fields:
        s = k + v
        out.update(s[i : i + SHINGLE] for i in range(max(1, len(s) - SHINGLE + 1)) if s)
    return out


def band_keys(grams: Counter, block: bytes, classes: int = 1) -> list[int]:
    """One 64-bit key per band, different in every block."""
    base = np.array([xxhash.xxh64_intdigest(g) for g in grams], np.uint64)
    if not len(base):
        return []
    rows, bands = bands_of(classes)
    mixed = base[:, None] * _SEEDS[0, : rows * bands] + _SEEDS[1, : rows * bands]
    mixed ^= mixed >> np.uint64(29)
    least = (mixed * np.uint64(0x9E3779B97F4A7C15)).min(axis=0)
    return [xxhash.xxh64_intdigest(block + least[b * rows : (b + 1) * rows].tobytes(), b) - 2**63 for b in range(bands)]


def jaccard(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    whole = sum(a.values()) + sum(b.values()) - both
    return both / whole if whole else 1.0


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance; a column of the table is the bits of one integer."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    rises, falls = full, 0  # where the table's column goes up and down by one
    for c in b:
        match = places.get(c, 0)
        diagonal = (((match & rises) + rises) ^ rises) | match | falls
        right_up, right_down = falls | ~(diagonal | rises) & full, rises & diagonal
        if right_up & top:
            distance += 1
        elif right_down & top:
            distance -= 1
        right_up = (right_up << 1 | 1) & full
        right_down = (right_down << 1) & full
        rises, falls = right_down | ~(diagonal | right_up) & full, right_up & diagonal
    return distance


def in_one_order(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> tuple[str, str]:
    """Both texts with their fields in one order, also where a name is misspelt."""
    if len(a) == 1 or len(b) == 1:
        return "".join(k + v for k, v in a), "".join(k + v for k, v in b)
    left, rest = [], list(b)
    named = {k: i for i, (k, _) in reversed(list(enumerate(b)))}
    taken = {named[k] for k, _ in a if k in named}
    partner = {k: b[named[k]] for k, _ in a if k in named}
    rest = [f for i, f in enumerate(b) if i not in taken]
    out_a, out_b = [], []
    for k, v in a:
        if k in partner:
            out_a.append(k + v)
            out_b.append("".join(partner.pop(k)))
        else:
            left.append((k, v))
    for k, v in left:
        out_a.append(k + v)
        if rest:
            best = min(range(len(rest)), key=lambda i: edit_distance(k + v, rest[i][0] + rest[i][1]))
            out_b.append("".join(rest.pop(best)))
    out_b += ["".join(f) for f in rest]
    return "".join(out_a), "".join(out_b)


def near(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> bool:
    size_a, size_b = (sum(len(k) + len(v) for k, v in x) for x in (a, b))
    longest = max(size_a, size_b)
    if abs(size_a - size_b) > MOST_EDITS * longest or not longest:
        return False
    if jaccard(shingles(a), shingles(b)) < LEAST_JACCARD:
        return False
    return edit_distance(*in_one_order(a, b)) <= MOST_EDITS * longest


FIELDS = "array<struct<k:string,v:string>>"
_ARROW_FIELDS = pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))


def one_tag(c):
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def classed(tasks: DataFrame) -> DataFrame:
    """(task_id, split, source, mark, block, fields) of each record that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [canonical(t) for t in batch.column(3).to_pylist()]
            fields = [[{"k": k, "v": v} for k, v in f.fields] for f in forms]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([digest(f.text) for f in forms], pa.binary()), pa.array([xxhash.xxh64_intdigest(f.numbers) - 2**63 for f in forms], pa.int64()), pa.array(fields, _ARROW_FIELDS)],
                names=["task_id", "split", "source", "mark", "block", "fields"],
            )

    rows = tasks.select(F.col("task_id").cast("long").alias("task_id"), one_tag("tag").alias("split"), "source", "instruction")
    rows = rows.filter(F.col("split").isin(TRAIN + HELD_OUT) & F.col("instruction").isNotNull() & F.col("task_id").isNotNull())
    return spread(rows).mapInArrow(run, f"task_id long, split string, source string, mark binary, block long, fields {FIELDS}")


BANDED = "mark binary, in_train boolean, held_out boolean, band long, size int"


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fields = [[(f["k"], f["v"]) for f in fs] for fs in batch.column("fields").to_pylist()]
        blocks = zip(fields, batch.column("block").to_pylist(), batch.column("classes").to_pylist(), strict=True)
        keys = [band_keys(shingles(fs), str(b).encode(), n) for fs, b, n in blocks]
        at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        size = np.array([sum(len(k) + len(v) for k, v in fs) for fs in fields], np.int32)
        taken = batch.select(["mark", "in_train", "held_out"]).take(pa.array(at))
        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([k for ks in keys for k in ks], pa.int64()), pa.array(size[at] if len(at) else [], pa.int32())], names=["mark", "in_train", "held_out", "band", "size"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = lambda fs: [(f["k"], f["v"]) for f in fs]
    for batch in batches:
        ok = [near(pairs(a), pairs(b)) for a, b in zip(batch.column("fields_t").to_pylist(), batch.column("fields_h").to_pylist(), strict=True)]
        yield batch.select(["mark_t", "mark_h"]).filter(pa.array(ok, pa.bool_()))


def candidate_pairs(texts: DataFrame) -> DataFrame:
    """(mark_t, mark_h): classes of different splits that agree in a band and whose lengths are within the limit."""
    banded = texts.mapInArrow(_bands, BANDED)
    left = banded.filter("in_train").select("band", F.col("mark").alias("mark_t"), F.col("size").alias("size_t"))
    right = banded.filter("held_out").select("band", F.col("mark").alias("mark_h"), F.col("size").alias("size_h"))
    near_sizes = F.abs(F.col("size_t") - F.col("size_h")) <= MOST_EDITS * F.greatest("size_t", "size_h")
    return left.join(right, "band").filter(F.col("mark_t") != F.col("mark_h")).filter(near_sizes).select("mark_t", "mark_h").distinct()


def class_texts(records: DataFrame) -> DataFrame:
    """(mark, block, in_train, held_out, classes, fields) of each class whose block has both train and held-out records."""
    train = F.col("split").isin(TRAIN)
    classes = records.groupBy("mark", "block").agg(F.bool_or(train).alias("in_train"), F.bool_or(~train).alias("held_out"))
    both_sides = classes.groupBy("block").agg(F.bool_or("in_train").alias("t"), F.bool_or("held_out").alias("h"), F.count("*").alias("classes")).filter("t AND h").select("block", "classes")
    alive = cut(classes.join(both_sides, "block"))
    texts = records.select("mark", "fields").join(alive.select("mark"), "mark", "left_semi").dropDuplicates(["mark"])
    return cut(texts.join(alive, "mark"))


def class_pairs(records: DataFrame) -> DataFrame:
    """(mark_t, mark_h): classes with train records beside the same or nearly the same classes with held-out ones."""
    texts = class_texts(records)
    full = candidate_pairs(texts).join(texts.select(F.col("mark").alias("mark_t"), F.col("fields").alias("fields_t")), "mark_t").join(texts.select(F.col("mark").alias("mark_h"), F.col("fields").alias("fields_h")), "mark_h")
    close = full.select("mark_t", "mark_h", "fields_t", "fields_h").mapInArrow(_confirm, "mark_t binary, mark_h binary")
    same = texts.filter("in_train AND held_out").select(F.col("mark").alias("mark_t"), F.col("mark").alias("mark_h"))
    return same.unionByName(close)


def _members(records: DataFrame) -> DataFrame:
    """(task_id, split, source, mark), each record once."""
    return records.select("task_id", "split", "source", "mark").distinct()


def overlaps(tasks: DataFrame) -> DataFrame:
    """(train_id, held_id, split, source) of every overlap; split and source are the held-out record's."""
    records = cut(classed(tasks))
    members = _members(records)
    train = members.filter(F.col("split").isin(TRAIN)).select(F.col("mark").alias("mark_t"), F.col("task_id").alias("train_id")).distinct()
    held = members.filter(F.col("split").isin(HELD_OUT)).select(F.col("mark").alias("mark_h"), F.col("task_id").alias("held_id"), "split", "source")
    return class_pairs(records).join(train, "mark_t").join(held, "mark_h").select("train_id", "held_id", "split", "source")


def overlap_classes(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (task_id, split, source, class_id), and pairs (train_class, held_class) of overlapping classes.

    A class is named by its smallest task; records of one class are the same but for their formatting.
    """
    records = cut(classed(tasks))
    members = _members(records)
    names = members.groupBy("mark").agg(F.min("task_id").alias("class_id"))
    pairs = class_pairs(records).join(names.select(F.col("mark").alias("mark_t"), F.col("class_id").alias("train_class")), "mark_t")
    pairs = pairs.join(names.select(F.col("mark").alias("mark_h"), F.col("class_id").alias("held_class")), "mark_h")
    return members.join(names, "mark").select("task_id", "split", "source", "class_id"), pairs.select("train_class", "held_class")


def _tasks(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tasks", "task_id", "tag", "source", "instruction")


def p7_found(spark, sf_dir: str) -> DataFrame:
    found = overlaps(_tasks(spark, sf_dir))
    return found.select(F.least("train_id", "held_id").alias("task_id_a"), F.greatest("train_id", "held_id").alias("task_id_b")).distinct()


def p7_report(spark, sf_dir: str) -> DataFrame:
    """Per split and source: overlapping held-out records, train records they overlap with, and pairs, from the sizes of the classes."""
    members, pairs = overlap_classes(_tasks(spark, sf_dir))
    train = members.filter(F.col("split").isin(TRAIN)).groupBy(F.col("class_id").alias("train_class")).agg(F.countDistinct("task_id").alias("n_t"))
    held = members.filter(F.col("split").isin(HELD_OUT)).groupBy(F.col("class_id").alias("held_class"), "split", "source").agg(F.countDistinct("task_id").alias("n_h"))
    met = pairs.join(train, "train_class").join(held, "held_class")
    by_held = met.groupBy("split", "source", "held_class").agg(F.max("n_h").alias("n_h"), F.sum("n_t").alias("n_t"))
    by_train = met.groupBy("split", "source", "train_class").agg(F.max("n_t").alias("n_t")).groupBy("split", "source").agg(F.sum("n_t").alias("train"))
    whole = by_held.groupBy("split", "source").agg(F.sum("n_h").alias("held_out"), F.sum(F.col("n_h") * F.col("n_t")).alias("pairs"))
    same = whole["split"].eqNullSafe(by_train["split"]) & whole["source"].eqNullSafe(by_train["source"])
    return whole.join(by_train, same).select(whole["split"], whole["source"], "held_out", "train", "pairs")


def p7_classes(spark, sf_dir: str) -> DataFrame:
    """Each record with its class and the number of classes of the other side that it overlaps with; pairs are not expanded."""
    members, pairs = overlap_classes(_tasks(spark, sf_dir))
    links = pairs.select(F.col("train_class").alias("class_id"), F.lit(True).alias("train_side")).unionByName(pairs.select(F.col("held_class").alias("class_id"), F.lit(False).alias("train_side")))
    counted = links.groupBy("class_id", "train_side").agg(F.count("*").alias("links"))
    sided = members.select("task_id", "split", "class_id", F.col("split").isin(TRAIN).alias("train_side")).distinct()
    return sided.join(counted, ["class_id", "train_side"], "left").select("task_id", "split", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p7_found": p7_found, "p7_report": p7_report, "p7_classes": p7_classes}
