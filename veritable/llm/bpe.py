"""Byte-pair encoding and decoding of whole texts with a public vocabulary file.

A word's symbols are a doubly linked list; a priority queue holds the ranks of the pairs that can
merge. The lowest rank goes first, the leftmost of equal ones; an entry whose pair has changed
meanwhile is stale and skipped. Decoding concatenates vocabulary strings.

The vocabulary is one file of bounded size (checked), read on the driver and broadcast. Words that
return are looked up in a cache that each Python worker keeps between tasks; it is bounded by
`CACHE_WORDS`, which changes speed only.

Defined results: a null or blank text has no tokens and decodes to the empty text; special tokens
in a text become their own ids; equal rows give equal results; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from veritable.llm.common import schema

VOCABULARY_BYTES = 64 << 20
CACHE_WORDS = 250_000
#: White space as the vocabulary's pattern means it.
SPACE = r"\t-\r \x85\xa0  -     　"


def visible_bytes() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + others.index(b)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """Tables of a tokenizer file, as plain values that can be broadcast."""
    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"{path}: a vocabulary of over {VOCABULARY_BYTES} bytes is not broadcast")
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    pairs = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        merged = vocab[left + right]
        pairs[vocab[left] << 32 | vocab[right]] = (rank, merged)
    strings = {i: s for s, i in vocab.items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    strings.update((i, s) for s, i in special.items())
    return {
        "inner": [vocab.get(s) for s in visible_bytes()],
        "final": [vocab.get(s + suffix) for s in visible_bytes()],
        "pairs": pairs,
        "strings": strings,
        "special": special,
        "recent": {},
        "older": {},
    }


class Codec:
    """Encoder and decoder over the tables of load_vocabulary()."""

    def __init__(self, tables: dict):
        self.inner, self.final, self.pairs = tables["inner"], tables["final"], tables["pairs"]
        self.strings, self.special, self.tables = tables["strings"], tables["special"], tables
        self.word = regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
        ).findall
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def merge(self, word: str) -> tuple[int, ...]:
        data = word.encode("utf-8")
        symbols = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
        symbols = [s for s in symbols if s is not None]
        n, pairs = len(symbols), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [
            found[0] * n + i
            for i in range(n - 1)
            if (found := pairs.get(symbols[i] << 32 | symbols[i + 1])) is not None
        ]
        heapq.heapify(queue)
        while queue:
            rank, at = divmod(heapq.heappop(queue), n)
            left = symbols[at]
            right_at = after[at]
            if left is None or right_at >= n:
                continue
            found = pairs.get(left << 32 | symbols[right_at])
            if found is None or found[0] != rank:
                continue
            symbols[at], symbols[right_at] = found[1], None
            after[at] = follower = after[right_at]
            if follower < n:
                before[follower] = at
                found = pairs.get(symbols[at] << 32 | symbols[follower])
                if found is not None:
                    heapq.heappush(queue, found[0] * n + at)
            leader = before[at]
            if leader >= 0:
                found = pairs.get(symbols[leader] << 32 | symbols[at])
                if found is not None:
                    heapq.heappush(queue, found[0] * n + leader)
        return tuple(s for s in symbols if s is not None)

    def encode_word(self, word: str) -> tuple[int, ...]:
        """merge() through the cache: a full generation ages, and words met again move back up."""
        tables = self.tables
        ids = tables["recent"].get(word)
        if ids is None:
            ids = tables["older"].get(word)
            if ids is None:
                ids = self.merge(word)
            if len(word) <= 64:
                if len(tables["recent"]) >= CACHE_WORDS:
                    tables["older"], tables["recent"] = tables["recent"], {}
                tables["recent"][word] = ids
        return ids

    def encode_plain(self, text: str) -> Iterator[tuple[int, ...]]:
        if not text.isascii():
            # Lower case goes by single characters: the form of sigma never hangs on its neighbours.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return map(self.encode_word, self.word(text.lower()))

    def encode(self, text: str) -> np.ndarray:
        pieces = self.cut.split(text) if self.cut and "<" in text else [text]
        parts = (
            [(self.special[p],)] if p in self.special else self.encode_plain(p) for p in pieces if p
        )
        return np.fromiter(chain.from_iterable(chain.from_iterable(parts)), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


def tokenize(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, `ids` array<int> and `decoded`, the text that the ids stand for."""
    spark: SparkSession = docs.sparkSession
    tables = spark.sparkContext.broadcast(load_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tables.value)
        for batch in batches:
            encoded = [codec.encode(text or "") for text in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, encoded)], dtype=np.int32)
            values = np.concatenate(encoded) if encoded else np.zeros(0, dtype=np.int32)
            decoded = pa.array([codec.decode(ids) for ids in encoded], pa.string())
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, decoded], ["id", "ids", "decoded"])

    plain = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return plain.mapInArrow(run, schema(docs, [(id_column, "id")], "ids array<int>, decoded string")).withColumnRenamed("id", id_column)
