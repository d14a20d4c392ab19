"""Encoding with a public byte-level BPE vocabulary.

A text is split by the tokenizer's pattern. A short word's merges run on a
contiguous rank array: part boundaries and, beside each, the rank of the part pair
that starts there; the array is scanned for the minimum, the boundary between the
pair is deleted, and the two neighbouring ranks are made again. A long word, where
repeated scans would cost the square of its length, takes the merges from a heap of
the same ranks over linked parts; both give the same ids. Each Python worker keeps
the ids of words it has met, up to ``CACHED_WORDS``; that bounds memory only.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Place of the rank file; nothing of it is kept in this library.
RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes up to which a word is short.
SHORT = 128
CACHED_WORDS = 150_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file of lines ``base64(token) rank``."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short word, by a contiguous rank array."""
    none = len(ranks) + 1
    bounds = list(range(len(word) + 1))
    near = [ranks.get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while near:
        least = min(near)
        if least == none:
            break
        at = near.index(least)
        del bounds[at + 1], near[at]
        if at < len(near):
            near[at] = ranks.get(word[bounds[at] : bounds[at + 2]], none)
        if at:
            near[at - 1] = ranks.get(word[bounds[at - 1] : bounds[at + 1]], none)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word: the same merges, the least rank first and the leftmost of equals, from a heap."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of each part's start
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, at, end = heapq.heappop(heap)
        middle = after[at]
        if not alive[at] or middle >= n or after[middle] != end:
            continue  # one of its parts was merged since
        alive[middle] = False
        after[at] = end
        if end < n:
            before[end] = at
            rank = ranks.get(word[at : after[end]])
            if rank is not None:
                heapq.heappush(heap, (rank, at, after[end]))
        left = before[at]
        if left >= 0:
            rank = ranks.get(word[left:end])
            if rank is not None:
                heapq.heappush(heap, (rank, left, end))
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : after[at]]])
        at = after[at]
    return out


class Encoder:
    """Encodes texts; special tokens in a text are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8")
        whole = self.ranks.get(raw)
        if whole is not None:
            ids: tuple[int, ...] = (whole,)
        else:
            ids = tuple(merge_short(raw, self.ranks) if len(raw) <= SHORT else merge_long(raw, self.ranks))
        if len(raw) <= SHORT:
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for word in self.split(text):
            out += known.get(word) or self.word(word)
        return out


@lru_cache(1)
def _encoder(data: bytes, pattern: str) -> Encoder:
    return Encoder(read_ranks(data), pattern)


def encode_documents(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    ranks_path: str = RANKS_PATH,
    pattern: str = PATTERN,
) -> DataFrame:
    """(doc_id, ids) of every row, repeated rows and null ids included; null and empty texts give an empty list.

    Needs no shuffle: each partition streams through in Arrow batches. The
    vocabulary (its size is fixed) is broadcast.
    """
    with open(ranks_path, "rb") as f:
        data = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(data.value, pattern).encode
        for batch in batches:
            ids, ends = [], [0]
            flat: list[np.ndarray] = []
            total = 0
            for value in batch.column(1):
                raw = value.as_buffer()
                if raw is not None and raw.size:
                    ids = encode(raw.to_pybytes().decode("utf-8", "replace"))
                    flat.append(np.array(ids, np.int32))
                    total += len(ids)
                ends.append(total)
            values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    kind = documents.select(F.col(doc_id)).schema[0].dataType.simpleString()
    named = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return named.mapInArrow(run, f"doc_id {kind}, ids array<int>")
