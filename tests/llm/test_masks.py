import os

import pytest

from trailmart.llm import bpe, masks
from trailmart.operators import conversations as conv


@pytest.mark.skipif(not os.path.isdir(bpe.VOCABULARY_DIR), reason="no vocabulary files here")
def test_masks_count_tokens_of_whole_chats(spark):
    own = bpe.encoder(bpe.VOCABULARY_DIR, "byte_bpe_50k")
    asked, said = "tea please " * 5000, "好茶 ok " * 50
    docs = spark.createDataFrame([(1, f"User: {asked}\nAgent: {said}\nUser: bye"), (2, "客服：在"), (3, None)], "id long, text string")
    ids = [len(own.plain(w.encode())) for t in (asked, said, "bye") for w in own.words.findall(t)]
    whole, learnt = sum(ids), sum(len(own.plain(w.encode())) for w in own.words.findall(said))
    short = len(own.plain("在".encode()))
    lengths = masks.token_lengths(conv.from_chat(docs, "id", "text"), "id")
    assert {r.id: (r.tokens, r.trained) for r in lengths.collect()} == {1: (whole, learnt), 2: (short, short)}
    got = conv.length_totals(lengths, 8192).first()
    assert whole > 8192 and (got.samples_over, got.tokens_over) == (1, whole - 8192) and got.tokens == whole + short
