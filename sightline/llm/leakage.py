"""Evaluation passages inside a corpus: sliding windows, found by SimHash or by shared shingles.

Words are compared without regard to case and to differences that are not seen
(``lookalike.words``). Each window of ``window`` words, of every passage and of every
text, gets a 64-bit SimHash over its shingles of five words, weighted by their
letters. A fingerprint is cut into ``radius + 1`` blocks; two fingerprints within
``radius`` bits agree in at least one block, so a lookup by each block finds all
passage windows within the radius. Candidates are verified exactly: the weighted
Jaccard similarity of the windows' shingles must reach ``similarity``, and windows
that agree word by word are counted apart.

Equal windows have equal fingerprints, so this finds every one of them
(``shared_passages``). But windows of 13 words have only nine shingles, and one changed
word turns more bits than a radius can hold: fingerprints lose most edited windows.
Without a radius, candidates are therefore found by shared shingles, which loses none: a
window of ``similarity`` to another shares so much weight with it that it shares one of
its shingles rarest among the items, of as little weight as may differ.

The corpus streams through once, in Arrow batches, without a shuffle; only hits
(document, item) are shuffled, after each batch has reduced them to a row a pair.
The items are a stated query set: they go to the workers in passes of at most
``items_per_pass`` items and some ``BYTES_PER_PASS``, so what is broadcast has a fixed bound at any number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import lookalike

WINDOW = 13
SHINGLE = 5
RADIUS = 3
SIMILARITY = 0.8
ITEMS_PER_PASS = 2000
#: Bytes of passages a pass may hold.
BYTES_PER_PASS = 16 << 20
#: Words of text handled at once; longer texts stand alone.
CHUNK_WORDS = 8_000
KNOWN_WORDS = 300_000
#: Postings of shingles followed at once.
STEP_POSTINGS = 100_000

HIT_SCHEMA = "doc_id {0}, item_id {1}, windows bigint, exact_windows bigint, similarity double"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads bits (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_sum(rows: np.ndarray, count: int) -> np.ndarray:
    """Sum of each ``count`` consecutive rows, by doubling."""
    n = len(rows) - count + 1
    out, power, done, at = None, rows, 0, 1
    while count:
        if count & 1:
            piece = power[done : done + n]
            out = piece.copy() if out is None else np.add(out, piece, out=out)
            done += at
        count >>= 1
        if count:
            power, at = power[:-at] + power[at:], at * 2
    return out


class Words:
    """Hashes and lengths of words; remembers those met, within a bound."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def of(self, text: str) -> list[tuple[int, int]]:
        known, out = self.known, []
        for w in lookalike.words(text):
            v = known.get(w)
            if v is None:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                v = known[w] = (xxhash.xxh3_64_intdigest(w), len(w))
            out.append(v)
        return out


class Windows:
    """Windows of one or more texts laid end to end.

    ``start``: where each window starts; ``owner``: the text it belongs to;
    ``prints``: its SimHash, if wanted; ``shingles``, ``weights``: by position.
    """

    def __init__(self, texts: list[list[tuple[int, int]]], window: int, prints: bool = True):
        counts = np.array([len(t) for t in texts], np.int64)
        pairs = np.array([p for t in texts for p in t], np.uint64).reshape(-1, 2)
        self.words, lengths = pairs[:, 0].copy(), pairs[:, 1].astype(np.int32)
        total = len(self.words)
        per = window - SHINGLE + 1  # shingles in a window
        self.per = per
        first = np.cumsum(counts) - counts
        has = np.maximum(counts - window + 1, 0)
        self.owner = np.repeat(np.arange(len(texts)), has)
        self.start = np.repeat(first - (np.cumsum(has) - has), has) + np.arange(has.sum())
        self.shingles, self.weights = np.zeros(total, np.uint64), np.zeros(total, np.int32)
        if total < window or not len(self.start):
            self.prints = np.zeros(0, np.uint64)
            return
        n = total - SHINGLE + 1
        mixed = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            mixed = _mix(mixed + self.words[k : k + n] + np.uint64(k + 1))
            self.weights[:n] += lengths[k : k + n]
        self.shingles[:n] = mixed
        if not prints:
            return
        bits = np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        signed = bits.astype(np.int32) * (2 * self.weights[:n, None]) - self.weights[:n, None]
        over = (sliding_sum(signed, per) > 0)[self.start]
        self.prints = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()


class ItemIndex:
    """Windows of the items, reachable by each block of their fingerprints, without a radius by their shingles."""

    def __init__(self, ids: list, passages: list[str | None], window: int, radius: int | None):
        words = Words()
        self.ids, self.window, self.radius = ids, window, radius
        self.windows = Windows([words.of(p or "") for p in passages], window, radius is not None)
        if radius is None:
            self._post()
            return
        self.bits = 64 // (radius + 1)
        self.blocks = []
        for b in range(radius + 1):
            key = self._block(self.windows.prints, b)
            order = np.argsort(key, kind="stable")
            starts = np.searchsorted(key[order], np.arange((1 << self.bits) + 1)) if self.bits <= 16 else None
            self.blocks.append((order, key[order], starts))

    def _post(self) -> None:
        """Positions of each shingle, and the window that starts at each position (-1: none)."""
        w = self.windows
        held = np.unique((w.start[:, None] + np.arange(w.per)).ravel())
        self.order = held[np.argsort(w.shingles[held], kind="stable")]
        self.known, self.first, self.count = np.unique(w.shingles[self.order], return_index=True, return_counts=True)
        self.starting = np.full(len(w.words), -1)
        self.starting[w.start] = np.arange(len(w.start))

    def sharing(self, texts: Windows, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text window, item window), each once: among them all of at least the similarity ``least``."""
        span, weights = np.arange(texts.per), texts.weights.astype(np.int64)
        at = np.minimum(np.searchsorted(self.known, texts.shingles), len(self.known) - 1)
        count = np.where(self.known[at] == texts.shingles, self.count[at], 0)
        whole, shared = (np.r_[0, np.cumsum(x)] for x in (weights, weights * (count > 0)))
        ends = texts.start + texts.per
        total = whole[ends] - whole[texts.start]
        live = np.flatnonzero(shared[ends] - shared[texts.start] >= (least - 1e-9) * total)
        for lo in range(0, len(live), CHUNK_WORDS):
            mine = live[lo : lo + CHUNK_WORDS]
            places = texts.start[mine][:, None] + span
            rarest = np.argsort(count[places], axis=1, kind="stable")
            places = np.take_along_axis(places, rarest, 1)
            before = np.cumsum(weights[places], axis=1) - weights[places]
            n = np.where(before <= (1 - least + 1e-9) * total[mine][:, None], count[places], 0)
            step = np.cumsum(n.sum(1)) // STEP_POSTINGS
            for some in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(step)) + 1):
                i, t = np.nonzero(n[some])
                i = some[i]
                many, begin = n[i, t], self.first[at[places[i, t]]]
                q = self.order[np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                starts = q[:, None] - span
                theirs = np.where(starts >= 0, self.starting[starts], -1).ravel()
                ours = np.repeat(np.repeat(mine[i], many), texts.per)[theirs >= 0]
                both = np.unique(ours * len(self.windows.start) + theirs[theirs >= 0])
                yield both // len(self.windows.start), both % len(self.windows.start)

    def _block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(b * self.bits)) & np.uint64((1 << self.bits) - 1)

    def within_radius(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (index into ``prints``, item window) within the radius, each once."""
        mine, theirs = [], []
        for b, (order, keys, starts) in enumerate(self.blocks):
            key = self._block(prints, b)
            if starts is not None:
                low, high = starts[key.astype(np.int64)], starts[key.astype(np.int64) + 1]
            else:
                low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            count = high - low
            some = np.flatnonzero(count)
            count, low = count[some], low[some]
            i = np.repeat(some, count)
            j = order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            near = np.bitwise_count(prints[i] ^ self.windows.prints[j]) <= self.radius
            mine.append(i[near])
            theirs.append(j[near])
        both = np.unique(np.stack([np.concatenate(mine), np.concatenate(theirs)]), axis=1)
        return both[0], both[1]

    def verify(self, texts: Windows, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact weighted Jaccard similarity of window pairs, and whether they agree word by word."""
        similarity, same, step = np.zeros(len(i)), np.zeros(len(i), bool), 50_000
        span, ws = np.arange(texts.per), np.arange(self.window)
        for at in range(0, len(i), step):
            s = slice(at, at + step)
            a, b = texts.start[i[s]], self.windows.start[j[s]]
            same[s] = (texts.words[a[:, None] + ws] == self.windows.words[b[:, None] + ws]).all(1)
            pa_, pb = a[:, None] + span, b[:, None] + span
            equal = texts.shingles[pa_][:, :, None] == self.windows.shingles[pb][:, None, :]
            wa, wb = texts.weights[pa_], self.windows.weights[pb]
            common = np.minimum((wa * equal.any(2)).sum(1), (wb * equal.any(1)).sum(1))
            similarity[s] = common / np.maximum(wa.sum(1) + wb.sum(1) - common, 1)
        return similarity, same


def _chunks(batch: pa.RecordBatch, words: Words) -> Iterator[tuple[list[int], list[list[tuple[int, int]]]]]:
    rows, texts, held = [], [], 0
    for row, value in enumerate(batch.column(1)):
        raw = value.as_buffer()
        if raw is None or not raw.size:
            continue
        of = words.of(raw.to_pybytes().decode("utf-8", "replace"))
        rows.append(row)
        texts.append(of)
        held += len(of)
        if held >= CHUNK_WORDS:
            yield rows, texts
            rows, texts, held = [], [], 0
    if rows:
        yield rows, texts


def leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    passage: str = "passage",
    window: int = WINDOW,
    radius: int | None = None,
    similarity: float = SIMILARITY,
    items_per_pass: int = ITEMS_PER_PASS,
) -> DataFrame:
    """(doc_id, item_id, windows, exact_windows, similarity) of every document and item that share text.

    ``windows``: window pairs of at least ``similarity``; ``exact_windows``: those that
    agree word by word; ``similarity``: the greatest. With a ``radius`` only window pairs
    whose fingerprints lie within it count, which loses edited ones. Null, empty and short texts and
    passages (under ``window`` words) have no windows and give no rows; repeated rows
    of a document or item change nothing; other columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kinds = (docs.schema[0].dataType.simpleString(), items.select(F.col(item_id)).schema[0].dataType.simpleString())
    schema = HIT_SCHEMA.format(*kinds)
    named = items.select(F.col(item_id).alias("item_id"), F.col(passage).alias("passage")).where("item_id IS NOT NULL AND passage IS NOT NULL").distinct()
    count, size = named.agg(F.count("*"), F.sum(F.octet_length("passage"))).first()
    passes = max(1, -(-count // items_per_pass), -(-(size or 0) // BYTES_PER_PASS))
    part = F.pmod(F.xxhash64("item_id", "passage"), F.lit(passes))
    hits = None
    for k in range(passes):
        rows = named.where(part == k).collect()  # about items_per_pass of them
        index = spark.sparkContext.broadcast(ItemIndex([r.item_id for r in rows], [r.passage for r in rows], window, radius))
        found = docs.mapInArrow(_searcher(index, similarity, docs, kinds[1]), schema)
        hits = found if hits is None else hits.unionByName(found)
    return hits.groupBy("doc_id", "item_id").agg(
        F.max("windows").alias("windows"), F.max("exact_windows").alias("exact_windows"), F.max("similarity").alias("similarity")
    )


def _searcher(index, least: float, docs: DataFrame, item_kind: str):
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    id_type, item_type = to_arrow_type(docs.schema[0].dataType), to_arrow_type(_parse_datatype_string(item_kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: ItemIndex = index.value
        words = Words()
        for batch in batches:
            for rows, texts in _chunks(batch, words):
                docs = Windows(texts, items.window, items.radius is not None)
                if not len(docs.start) or not len(items.windows.start):
                    continue
                found = []
                for i, j in [items.within_radius(docs.prints)] if items.radius is not None else items.sharing(docs, least):
                    alike, same = items.verify(docs, i, j)
                    keep = alike >= least
                    found.append((i[keep], j[keep], alike[keep], same[keep]))
                if not found:
                    continue
                i, j, alike, same = (np.concatenate(x) for x in zip(*found))
                pair, place = np.unique(np.stack([docs.owner[i], items.windows.owner[j]]), axis=1, return_inverse=True)
                n = pair.shape[1]
                top = np.zeros(n)
                np.maximum.at(top, place.ravel(), alike)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.array(rows, np.int64)[pair[0]])).cast(id_type),
                        pa.array([items.ids[x] for x in pair[1]], item_type),
                        pa.array(np.bincount(place.ravel(), minlength=n)),
                        pa.array(np.bincount(place.ravel(), same, minlength=n).astype(np.int64)),
                        pa.array(top),
                    ],
                    ["doc_id", "item_id", "windows", "exact_windows", "similarity"],
                )

    return run


def shared_passages(documents: DataFrame, items: DataFrame, **more) -> DataFrame:
    """(doc_id, item_id) that share at least ``window`` consecutive words."""
    return leaks(documents, items, **{"radius": RADIUS} | more).where("exact_windows > 0 AND doc_id IS NOT NULL").select("doc_id", "item_id")
