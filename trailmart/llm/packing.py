"""Fill containers of fixed capacity with texts, leaving little space unused.

Texts are sized in tokens of each container's tokenizer, dealt to random groups of about
``GROUP_ROWS`` texts by a hash of their key, and each group is packed on its own by first-fit
decreasing. A tournament tree over the free space of the group's bins finds the first bin that
an item fits in, in logarithmic time. Groups are even whatever the keys' skew, as the hash only
sees the key of a text.

* A text larger than a container is cut: its full pieces take one container each, the rest is an item.
* A text of no tokens (null, empty) takes no space: one row with a null bin.
* Repeated rows are packed each on their own. Ties of size go by key, so the result is the same in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import spread, table
from .bpe import chunks, encoder, vocabulary_dir

#: Texts in a random group, and the most containers a table of containers may state.
GROUP_ROWS, MOST_CONTAINERS = 4096, 64
PACKED = "container string, bin long, doc_id long, piece int, first_token long, tokens int"


class FreeSpace:
    """A tournament tree of the free space of bins; each node holds the most of those below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.most = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Take ``size`` from the first bin that has it, and return the bin's number."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < size:
                at += 1
        most[at] -= size
        found = at - self.leaves
        while at > 1:
            at //= 2
            most[at] = max(most[2 * at], most[2 * at + 1])
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; every size is from 1 to the capacity."""
    space, out = FreeSpace(max(1, len(sizes)), capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = space.place(sizes[i])
    return out


def count_tokens(folder: str, tokenizers: list[str], texts: list[str | None]) -> dict[str, list[int]]:
    """The tokens of each text by each tokenizer; byte-level vocabularies share one split into words."""
    out, split = {}, None
    for name in dict.fromkeys(tokenizers):
        if name.startswith("piece_"):
            out[name] = [len(x) for x in _pieces(folder, name).encode([t or "" for t in texts], num_threads=1)]
        else:
            own = encoder(folder, name)
            split = own.split(texts) if split is None else split
            out[name] = own.sizes(split)
    return out


_MODELS: dict[tuple[str, str], object] = {}


def _pieces(folder: str, tokenizer: str):
    if (folder, tokenizer) not in _MODELS:
        import sentencepiece

        _MODELS[folder, tokenizer] = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{tokenizer}.model")
    return _MODELS[folder, tokenizer]


def token_sizes(documents: DataFrame, containers: list[tuple[str, str, int]]) -> DataFrame:
    """(doc_id, container, tokens) for each text and container, in one pass over the texts."""
    folder = vocabulary_dir(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, 1):
                counts = count_tokens(folder, [t for _, t, _ in containers], texts)
                for name, tokenizer, _ in containers:
                    sizes = pa.array(counts[tokenizer], pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([name] * len(texts)), sizes], names=["doc_id", "container", "tokens"])

    return spread(documents.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, container string, tokens long")


def pack(sizes: DataFrame, capacity: dict[str, int], groups: int, seed: int = 17) -> DataFrame:
    """Pack (doc_id, container, tokens) into bins; ``bin`` is unique within its container."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        group, name = int(key[0]), key[1]
        room = capacity[name]
        rows = rows.sort_values(["tokens", "doc_id"], ascending=[False, True])
        out, items = [], []
        full = 0
        for doc, tokens in zip(rows.doc_id.tolist(), rows.tokens.tolist(), strict=True):
            if not tokens:
                out.append((name, None, doc, 0, 0, 0))
                continue
            pieces = tokens // room if tokens > room else 0
            for p in range(pieces):
                out.append((name, full, doc, p, p * room, room))
                full += 1
            if tokens - pieces * room:
                items.append((doc, pieces, pieces * room, tokens - pieces * room))
        bins = first_fit_decreasing([x[3] for x in items], room)
        out += [(name, full + b, *x) for b, x in zip(bins, items, strict=True)]
        packed = pd.DataFrame(out, columns=[c.split()[0] for c in PACKED.split(", ")])
        packed["bin"] = packed["bin"].astype("Int64") + (group << 24)
        return packed

    salted = sizes.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)))
    return salted.groupBy("pack_group", "container").applyInPandas(run, PACKED)


def pack_documents(documents: DataFrame, pack_sizes: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    rows = pack_sizes.select("container", "tokenizer", "capacity").dropna().distinct().limit(MOST_CONTAINERS + 1).collect()
    if len(rows) > MOST_CONTAINERS or len({r.container for r in rows}) < len(rows):
        raise ValueError("containers must be few and have distinct names")
    containers = [(r.container, r.tokenizer, r.capacity) for r in rows]
    groups = max(1, -(-documents.count() // group_rows))  # a count of Parquet reads only its footers
    return pack(token_sizes(documents, containers), {name: room for name, _, room in containers}, groups)


def p9_packed(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


def p9_fill(spark, sf_dir: str) -> DataFrame:
    """Containers used by each kind, their tokens, the fewest containers that could hold as many tokens, and the share of the capacity that is filled."""
    room = table(spark, sf_dir, "pack_sizes", "container", "capacity")
    used = p9_packed(spark, sf_dir).filter("bin IS NOT NULL").groupBy("container", "bin").agg(F.sum("tokens").alias("tokens"))
    whole = used.groupBy("container").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return whole.join(F.broadcast(room.limit(MOST_CONTAINERS)), "container").withColumn("least", F.ceil(F.col("tokens") / F.col("capacity"))).withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))


QUERIES = {"p9_packed": p9_packed, "p9_fill": p9_fill}
