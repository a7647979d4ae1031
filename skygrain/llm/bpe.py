"""Byte-level BPE ids of a public tokenizer, encoded inside Spark tasks.

A text is cut into words by the tokenizer's pattern; each word's bytes are merged on a contiguous array of adjacent ranks:
hold the part boundaries and the rank of each adjacent pair, scan for the least rank, delete that boundary, refresh the two
neighbouring ranks, until no pair has a rank. The scan is quadratic in a word's length, so words beyond LONG bytes (runs of
one class without a blank) take the same merges from a heap. Words repeat, so each Python worker keeps a bounded memo.

The vocabulary file (0.8 MB, fixed) is read on the driver and broadcast, so workers need no file. Encoding is one narrow
map over the documents: no shuffle, and a text of any length stays whole.

Defined results: null and empty texts have the empty list; blank texts are encoded as they stand; strings that look like
special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the word pattern published with the byte-level vocabularies.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = os.environ.get("SKYGRAIN_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
LONG, MEMO = 200, 300_000
NONE = 1 << 60


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by repeated scans of a contiguous array of ranks."""
    bounds = list(range(len(word) + 1))
    pair = [ranks.get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    pair.append(NONE)
    while (least := min(pair)) != NONE:
        i = pair.index(least)
        del bounds[i + 1], pair[i]
        pair[i] = ranks.get(word[bounds[i] : bounds[i + 2]], NONE) if i + 2 < len(bounds) else NONE
        if i:
            pair[i - 1] = ranks.get(word[bounds[i - 1] : bounds[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in the same order, least rank first and leftmost among equals, from a heap of pairs."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2], NONE)) != NONE]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        # Stale if the left part is gone or either part has grown since.
        if not alive[i] or end[i] == n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]], NONE)) != NONE:
                heapq.heappush(heap, (r, i, end[stop]))
        p = before[i]
        if p >= 0 and (r := ranks.get(word[p:stop], NONE)) != NONE:
            heapq.heappush(heap, (r, p, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    def __init__(self, data: bytes):
        import regex

        self.ranks, self.words = read_ranks(data), regex.compile(WORDS)
        self.memo: dict[str, list[int]] = {}
        self.lengths = {rank: len(token) for token, rank in self.ranks.items()}

    def word(self, word: str) -> list[int]:
        ids = self.memo.get(word)
        if ids is None:
            raw = word.encode("utf-8", "replace")
            whole = self.ranks.get(raw)
            ids = [whole] if whole is not None else merge_short(raw, self.ranks) if len(raw) <= LONG else merge_long(raw, self.ranks)
            if len(raw) <= LONG:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            word, extend = self.word, out.extend
            for w in self.words.findall(text):
                extend(word(w))
        return out


_ENCODERS: dict[int, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(data)
    return _ENCODERS[key]


def vocabulary(spark: SparkSession, path: str = DEFAULT_VOCABULARY):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _udf(spark: SparkSession, kind: str, of: Callable[[list[int]], object], path: str) -> Callable[[Column], Column]:
    data = vocabulary(spark, path)

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(data.value)
        for texts in batches:
            yield pd.Series([of(own.encode(t)) for t in texts], dtype=object if kind.startswith("array") else "int32")

    return run


def ids_of(spark: SparkSession, path: str = DEFAULT_VOCABULARY) -> Callable[[Column], Column]:
    """Column function: text to array<int>."""
    return _udf(spark, "array<int>", lambda ids: ids, path)


def tokens_of(spark: SparkSession, path: str = DEFAULT_VOCABULARY) -> Callable[[Column], Column]:
    """Column function: text to its number of tokens."""
    return _udf(spark, "int", len, path)


def spread(docs: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer splits than there are cores, as small files do."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(2 * cores)


def encode(docs: DataFrame, key: str, text: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids) of every row."""
    return spread(docs.select(key, text)).select(key, ids_of(docs.sparkSession, path)(F.col(text)).alias("ids"))
