"""Encode texts with a public byte-level BPE by traversing a prefix-sharing trie of words.

The distinct words of a batch, sorted, are the preorder of their trie: what a word shares with
the one before it is the path of the trie that stays open, and only its other bytes are new nodes.
Each node holds the last token of the encoding of its prefix. That token is the one ending there
which is stable beside the last token of the node where it begins, so the encoding of a shared
prefix is computed once, and a word's ids are read off backwards along its path.

Two tokens are stable together if plain BPE leaves the joined bytes as these two tokens; answers
are remembered. Null and empty texts give an empty list; strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources import spread, table

#: Where the vocabulary files are, unless the setting below names another folder.
VOCABULARY_CONF = "trailmart.tokenizers"
VOCABULARY_DIR = "/opt/tokenizers"
#: Words kept with their ids between the batches of a task (then forgotten all at once), and longest such word.
CACHED_WORDS, CACHED_BYTES = 200_000, 256


def vocabulary_dir(spark) -> str:
    return spark.conf.get(VOCABULARY_CONF, VOCABULARY_DIR)


def word_pattern(folder: str) -> str:
    """The published split pattern that belongs to the vocabulary files."""
    spec = importlib.util.spec_from_file_location("vocabulary_files", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


class WordTrieEncoder:
    def __init__(self, folder: str, name: str):
        import regex

        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            self.rank = {base64.b64decode(token): int(number) for token, number in map(bytes.split, f)}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for token, number in self.rank.items():
            self.token[number] = token
        self.words = regex.compile(word_pattern(folder))
        lengths: dict[bytes, set[int]] = {}
        for token in self.rank:
            lengths.setdefault(token[-2:], set()).add(len(token))
        #: by the last two bytes: the lengths of longer tokens with that ending, longest first
        self.lengths = {tail: sorted(found, reverse=True) for tail, found in lengths.items() if len(tail) == 2}
        self.stable: dict[int, bool] = {}
        self.known: dict[bytes, list[int]] = {}

    def plain(self, data: bytes) -> list[int]:
        """BPE as it is defined: join the pair of lowest rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                number = self.rank.get(parts[i] + parts[i + 1])
                if number is not None and (best is None or number < best):
                    best, at = number, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def encode_words(self, words: set[bytes]) -> dict[bytes, list[int]]:
        """The ids of each distinct word."""
        rank, token, lengths, stable = self.rank, self.token, self.lengths, self.stable
        out: dict[bytes, list[int]] = {}
        before, last = b"", [-1]  # last[i]: last token of the encoding of the first i bytes
        for word in sorted(words):
            shared = len(os.path.commonprefix((before, word)))
            del last[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                for size in lengths.get(word[i - 2 : i], ()) if i > 1 else ():
                    if size > i:
                        continue
                    number = rank.get(word[i - size : i])
                    if number is None:
                        continue
                    ahead = last[i - size]
                    if ahead < 0:
                        break
                    pair = ahead << 20 | number
                    fits = stable.get(pair)
                    if fits is None:
                        fits = stable[pair] = self.plain(token[ahead] + token[number]) == [ahead, number]
                    if fits:
                        break
                else:
                    number = rank[word[i - 1 : i]]
                last.append(number)
            ids, i = [], len(word)
            while i:
                ids.append(last[i])
                i -= len(token[last[i]])
            ids.reverse()
            out[word] = ids
            before = word
        if len(stable) > 2_000_000:
            stable.clear()
        return out

    def split(self, texts: list[str | None]) -> list[list[bytes]]:
        """The words of each text; the same for every vocabulary of the split pattern."""
        return [[w.encode() for w in self.words.findall(t)] if t else [] for t in texts]

    def known_ids(self, split: list[list[bytes]]) -> dict[bytes, list[int]]:
        """The ids of all words of some texts (and of others that are remembered)."""
        known = self.known
        new = {w for ws in split for w in ws if w not in known}
        if not new:
            return known
        if len(known) > CACHED_WORDS:
            known.clear()
            new = {w for ws in split for w in ws}
        fresh = self.encode_words(new)
        long = {w: i for w, i in fresh.items() if len(w) > CACHED_BYTES}
        known.update((w, i) for w, i in fresh.items() if len(w) <= CACHED_BYTES)
        return known | long if long else known

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        split = self.split(texts)
        ids = self.known_ids(split)
        return [[i for w in ws for i in ids[w]] for ws in split]

    def sizes(self, split: list[list[bytes]]) -> list[int]:
        """How many ids each text has, from its words."""
        ids = self.known_ids(split)
        return [sum(len(ids[w]) for w in ws) for ws in split]


@lru_cache(4)
def encoder(folder: str, name: str) -> WordTrieEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordTrieEncoder(folder, name)


def chunks(batch: pa.RecordBatch, column: int, limit: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch with at most ``limit`` bytes of text (or one row), with their texts."""
    import pyarrow.compute as pc

    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
        part = batch.slice(at, end - at)
        yield part, part.column(column).to_pylist()
        at = end


def encode_documents(df: DataFrame, key: str, column: str, tokenizer: str = "byte_bpe_50k", out: str = "ids") -> DataFrame:
    """(key, ids): the token ids of every text; one map over the scan, each row on its own."""
    folder = vocabulary_dir(df.sparkSession)

    def run(batches):
        own = encoder(folder, tokenizer)
        for batch in batches:
            for part, texts in chunks(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.encode(texts), pa.list_(pa.int32()))], names=[key, out])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, column)).mapInArrow(run, f"`{key}` {kind}, `{out}` array<int>")


def p8_ids(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES = {"p8_ids": p8_ids}
