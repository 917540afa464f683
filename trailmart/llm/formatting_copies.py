"""Collapse records that differ only in their formatting, and count the copies.

Each text is brought to canonical bytes. The tasks of a scan first collapse their own copies in a
trie, so a hot text leaves a task as one row. The rest is partitioned by radix: all rows are one bucket, and
a bucket of more than ``BUCKET_ROWS`` rows is split by the ``STRIDE`` bytes that follow the longest start common
to all its rows, again and again, until each fits. Every level holds the rows of the oversized buckets
only, and a shared start costs one level, however long. A task then counts the texts of its
buckets in one trie per bucket, whose terminal nodes hold the number of copies and the smallest key.

Rows of one text can't be told apart by further bytes; there are at most as many of them as scan
tasks (times the flushes of a trie), so such a bucket is small whatever the number of copies.

* Null texts are in no group; texts without letters and digits are one group.
* Repeated rows (the same key and text) count once: tries count deliveries, from which the repeated ones are taken,
  found among pairs of key and digest, so no text is shuffled for them. Ties do not exist, as the smallest key is kept.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import spread, table
from ..sources.tables import cut
from .instructions import canonical, digest

#: Most rows of a bucket, bytes by which an oversized one is split, and bytes a scan task keeps in its trie.
BUCKET_ROWS, STRIDE, TRIE_BYTES = 20_000, 12, 32_000_000
#: Up to so many oversized buckets (16 bytes each) are broadcast to their rows; more meet them in a join.
MOST_SENT = 100_000


class CountingTrie:
    """A path-compressed trie over bytes; terminal nodes count."""

    __slots__ = ("root", "size")

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]  # edge label, children by first byte, [smallest key, copies]
        self.size = 0

    def add(self, text: bytes, key: int, copies: int = 1) -> None:
        node, at, end = self.root, 0, len(text)
        while at < end:
            child = node[1].get(text[at])
            if child is None:
                child = [text[at:], {}, None]
                node[1][text[at]] = child
                self.size += end - at + 100
                node, at = child, end
                break
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k, most = 1, min(len(label), end - at)
            while k < most and label[k] == text[at + k]:
                k += 1
            upper = [label[:k], {label[k]: child}, None]
            child[0] = label[k:]
            node[1][text[at]] = upper
            self.size += 100
            node, at = upper, at + k
        if node[2] is None:
            node[2] = [key, copies]
        else:
            node[2][0] = min(node[2][0], key)
            node[2][1] += copies

    def items(self) -> Iterator[tuple[bytes, int, int]]:
        stack = [(b"", self.root)]
        while stack:
            head, node = stack.pop()
            text = head + node[0]
            if node[2] is not None:
                yield text, *node[2]
            stack.extend((text, c) for c in node[1].values())


LOCAL = "canon binary, first_key long, copies long"


def _columns(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _paged(trie: CountingTrie) -> Iterator[pa.RecordBatch]:
    kinds, names = [pa.int64(), pa.binary(), pa.binary(), pa.int64()], ["key", "mark", "canon", "copies"]
    page = []
    for canon, key, copies in trie.items():
        page.append((key, None, canon, copies))
        if len(page) == 5000:
            yield _columns(page, kinds, names)
            page = []
    yield _columns(page, kinds, names)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over the texts: a row (key, mark) for each, and rows (key, canon, copies) of the task's tries."""
    trie = CountingTrie()
    for batch in batches:
        keys, marks = batch.column(0).to_pylist(), []
        for key, text in zip(keys, batch.column(1).to_pylist(), strict=True):
            form = canonical(text).text
            marks.append(digest(form))
            trie.add(form.encode(), key)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary()), pa.nulls(len(keys), pa.binary()), pa.nulls(len(keys), pa.int64())], names=["key", "mark", "canon", "copies"])
        if trie.size > TRIE_BYTES:
            yield from _paged(trie)
            trie = CountingTrie()
    yield from _paged(trie)


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many bytes the least and the greatest text of a bucket share: all between them share as many."""
    for batch in batches:
        upto = [len(os.path.commonprefix((a, b))) for a, b in zip(batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True)]
        alike = [a == b for a, b in zip(batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(upto, pa.int32()), pa.array(alike, pa.bool_())], names=["bucket", "upto", "alike"])


def _starts(active: DataFrame) -> DataFrame:
    """(bucket, upto, alike): the length of the common start of each bucket, and whether it holds one text only."""
    bounds = active.groupBy("bucket").agg(F.min("canon").alias("low"), F.max("canon").alias("high"))
    return bounds.mapInArrow(_common, "bucket long, upto int, alike boolean")


def _sent(buckets: DataFrame) -> DataFrame:
    """Broadcast if they are few; all have been stored, so the count reads no text."""
    return F.broadcast(buckets) if buckets.count() <= MOST_SENT else buckets


def radix_buckets(local: DataFrame, bucket_rows: int = BUCKET_ROWS, stride: int = STRIDE) -> tuple[DataFrame, int]:
    """``local`` with ``bucket``, the radix bucket of each row, and the number of levels that took."""
    active = local.select(F.lit(0).cast("long").alias("bucket"), "canon", "first_key", "copies")
    columns, done, level = active.columns, [], 0
    if local.count() <= bucket_rows:
        return active, level
    while True:
        level += 1
        starts = cut(_starts(active))
        alike, others = starts.filter("alike").select("bucket"), starts.filter("NOT alike").select("bucket", "upto")
        if not alike.isEmpty():
            done.append(active.join(_sent(alike), "bucket", "left_semi"))
        split = active.join(_sent(others), "bucket")
        split = split.withColumn("bucket", F.xxhash64("bucket", F.expr(f"substring(canon, upto + 1, {stride})"))).select(columns)
        large = cut(split.groupBy("bucket").count().filter(F.col("count") > bucket_rows).select("bucket"))
        if large.isEmpty():
            done.append(split)
            break
        done.append(split.join(_sent(large), "bucket", "left_anti"))
        active = cut(split.join(_sent(large), "bucket", "left_semi"))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole, level


def counted_groups(local: DataFrame, bucket_rows: int = BUCKET_ROWS, stride: int = STRIDE) -> DataFrame:
    """(mark, first_key, copies) of each canonical text, from rows that scan tasks have collapsed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, bucket = CountingTrie(), None

        def out() -> Iterator[pa.RecordBatch]:
            yield _columns([(digest(t.decode()), k, n) for t, k, n in trie.items()], [pa.binary(), pa.int64(), pa.int64()], ["mark", "first_key", "copies"])

        for batch in batches:  # sorted by bucket: one trie is open at a time
            for b, *item in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if b != bucket:
                    yield from out()
                    trie, bucket = CountingTrie(), b
                trie.add(*item)
        yield from out()

    placed, _ = radix_buckets(local, bucket_rows, stride)
    return placed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "mark binary, first_key long, copies long")


def collapse_copies(df: DataFrame, key: str, column: str, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """The groups (mark, first_key, copies), and the rows (key, mark) they were made of."""
    texts = df.select(F.col(key).cast("long").alias("key"), F.col(column).alias("text")).dropna()
    read = cut(spread(texts).mapInArrow(_read, "key long, mark binary, canon binary, copies long"))
    local = read.filter("canon IS NOT NULL").select("canon", F.col("key").alias("first_key"), "copies")
    members = read.filter("mark IS NOT NULL").groupBy("key", "mark").agg(F.count("*").alias("deliveries"))
    again = members.filter("deliveries > 1").groupBy("mark").agg(F.sum(F.col("deliveries") - 1).alias("again"))
    counted = counted_groups(local, bucket_rows).join(again, "mark", "left")
    return counted.select("mark", "first_key", (F.col("copies") - F.coalesce("again", F.lit(0))).alias("copies")), members.select("key", "mark")


def p3_found(spark, sf_dir: str) -> DataFrame:
    """The kept task of each group beside each of its other tasks.

    The join's small side holds one row per group of copies; rows of a hot group are on the other
    side, whose skewed partitions Spark splits.
    """
    groups, rows = collapse_copies(table(spark, sf_dir, "tasks", "task_id", "instruction"), "task_id", "instruction")
    several = groups.filter("copies > 1").select("mark", "first_key")
    return rows.join(several, "mark").filter("key <> first_key").select(F.col("first_key").alias("kept_task_id"), F.col("key").alias("task_id"))


def p3_copies(spark, sf_dir: str) -> DataFrame:
    """Each task that is kept, with its number of copies."""
    groups, _ = collapse_copies(table(spark, sf_dir, "tasks", "task_id", "instruction"), "task_id", "instruction")
    return groups.select(F.col("first_key").alias("task_id"), "copies")


QUERIES = {"p3_found": p3_found, "p3_copies": p3_copies}
