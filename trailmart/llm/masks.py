"""Masks of chats in tokens of a public vocabulary.

Each message is encoded on its own, as roles begin new tokens; only assistant tokens are learnt. Every chat
counts as a whole, in one map over the scan; what a cut at the limit would lose is counted beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators import conversations as conv
from ..plans.lengths import LIMIT
from ..sources import spread, table
from .bpe import encoder, vocabulary_dir


def token_lengths(conversations: DataFrame, key: str, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """(key, tokens, trained) of each conversation."""
    folder = vocabulary_dir(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder, tokenizer)
        for batch in batches:
            tokens, trained = [], []
            for messages in batch.column(1):
                found = messages.as_py()
                sizes = [len(ids) for ids in own.encode([m["content"] for m in found])]
                tokens.append(sum(sizes))
                trained.append(sum(n for n, m in zip(sizes, found, strict=True) if m["role"] == "assistant"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(trained, pa.int64())], names=[key, "tokens", "trained"])

    kind = conversations.schema[key].dataType.simpleString()
    return conversations.select(key, "messages").mapInArrow(run, f"`{key}` {kind}, tokens long, trained long")


def chat_mask_tokens(spark, sf_dir: str) -> DataFrame:
    """Samples, trained and padded tokens of whole chats, and what lies over the reference's 8192 tokens."""
    documents = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    return conv.length_totals(token_lengths(conv.from_chat(documents, "doc_id", "text"), "doc_id"), LIMIT)


QUERIES = {"chat_mask_tokens": chat_mask_tokens}
