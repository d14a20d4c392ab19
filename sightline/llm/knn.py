"""The most similar vectors of every vector, by query-aware collision counting.

Each block of vectors keeps one sorted array per random projection. A query's window
in each array is centred on the query's own projection; a vector in at least
``THRESHOLD`` of the ``PROJECTIONS`` windows is verified by its exact cosine. Windows
begin narrow and are widened by virtual rehashing, until a query has ``k`` verified
vectors within the current radius or the radius is that of ``min_cosine``. Widened
windows add to the counts only what they gained.

How windows are walked: a block's vectors are numbered in the order of its first array,
which runs along the block's longest axis, and cut into stripes of ``STRIPE`` vectors. A
query looks only into the stripes its window of the first array reaches. In a stripe each
sorted array is held as the sets of vectors up to each of its marks, as bits, so a window is
the difference of two sets and 64 vectors are counted by each machine instruction. Windows
end at marks, which makes them at most two marks too wide, never too narrow.

Blocks: a query can only match what is near it, so vectors are first routed to cells
around centroids. The centroids are fitted on at most ``FIT_ROWS`` rows of a group;
every row is indexed. A vector lives in the cell of its nearest centroid and is also
sent, as a query, to each cell in which a vector within the radius may live, up to
``MARGIN`` standard deviations of the difference in distance such a vector can make;
the number of these cells has no cap. A pair is found from either side, so one that
a border parts is lost only if both lie further than that from it. There are as many cells
as their size asks for: where a group needs more than ``CELLS_MOST``, its cells have
cells of their own, fitted cell by cell on the executors. Cells with more vectors than a
block should hold (a crowd of like vectors), or more queries, are split into a grid of blocks by
hashes of the id; no pair is lost. How many a cell holds is estimated from the fitted
rows, three standard deviations up, so vectors are routed once.

Without a floor (``min_cosine`` None) the radius is each query's own. Windows and cells
are first widened to the query's whole cell (a part of it, if it is large), whose k-th
best cosine bounds the radius; then to every cell in which a vector within that radius
may live, by the same rule with ``WHOLE_MARGIN``. At such radii windows would hold most
of a block, so whole cells are verified, by matrix products. A query in a cell with too
few others meets its whole group, so each gets ``k`` neighbours where there are so many.

Exact copies would fill windows without end: of the vectors of a group that are equal
number by number only the ``k + 1`` least ids are searched. Similarities of copies tie and
ties fall to the least id, so mutual pairs lose nothing, and each further copy has the
neighbours of the last one that is searched; ``neighbours`` gives it these by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.session import cut

#: Rows of a group its centroids are fitted on, at most.
FIT_ROWS = 16_384
#: Vectors a cell should hold, and a block may hold.
CELL_ROWS = 3_000
BLOCK_ROWS = 12_000
#: Queries a block may hold.
QUERY_ROWS = 100_000
#: Cells of a level; with two levels 262,144 cells a group, whose centroids take 67 MB.
CELLS_MOST = 512
#: Rows each centroid of the second level is fitted on, about.
SUB_ROWS = 16
PROJECTIONS = 32
THRESHOLD = 20
#: Half a window, in standard deviations of the projected difference of a pair at the radius.
WIDTH = 1.25
#: The same in the first array when it picks stripes.
REACH = 3.0
#: Vectors of a stripe; marks of a sorted array.
STRIPE = 2_048
MARKS = 254
MARGIN = 1.5
#: The same without a floor, where true neighbours are rarely close; and queries of a block there.
WHOLE_MARGIN = 3.0
ASK_ROWS = 30_000
SEED = 20_240_229
#: Queries searched at once, and words of 64 pairs counted at once: the counters stay in a core's cache.
STEP_QUERIES = 4_096
STEP_WORDS = 16_384
#: Queries of a block that choose its radii.
SOUNDINGS = 128
#: Candidates are verified by matrix products where more than one word in so many has some.
DENSE = 3
#: Pairs multiplied out at once.
VERIFY_PAIRS = 1_000_000


def usable(vectors: DataFrame, entry_id: str, group: str, value: str, size: int) -> DataFrame:
    """(id, grp, value): usable rows, repeated rows once.

    Not usable: null ids, vectors that are null, not of ``size`` numbers, all zero, or
    with a null, NaN or infinite number. A null group is a group of its own.
    """
    v = F.col("value")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    named = vectors.select(F.col(entry_id).alias("id"), F.col(group).alias("grp"), F.col(value).alias("value"))
    return named.where(F.col("id").isNotNull() & (F.size(v) == size) & finite & F.exists(v, lambda x: x != 0)).distinct()


def searched(good: DataFrame, k: int) -> DataFrame:
    """(id, grp, value, same, place): of equal vectors the ``k + 1`` least ids, in their order."""
    place = F.row_number().over(Window.partitionBy("grp", "same").orderBy("id"))
    return good.withColumn("same", _same()).withColumn("place", place).where(F.col("place") <= k + 1)


def _same() -> Column:
    """128 hashed bits of the vector, which are sorted and joined in its place."""
    return F.struct(F.xxhash64("value").alias("a"), F.xxhash64(F.lit(SEED), "value").alias("b"))


def fit_centroids(sample: np.ndarray, cells: int, seed: int = SEED, rounds: int = 6) -> np.ndarray:
    """Centroids of unit vectors (Lloyd's rounds from random rows)."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=len(centres))
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
    return centres.astype(np.float32)


def _square_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)[None, :]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_square_distances(x[a : a + 4096], centres).argmin(1) for a in range(0, len(x), 4096)])


def _units(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _raw(batch: pa.RecordBatch, column: int, size: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


class Counts:
    """Counters of one word of pairs each, kept as bit planes and added to without carrying further than needed."""

    def __init__(self) -> None:
        self.free: dict[tuple[int, int], list[np.ndarray]] = {}

    def buffer(self, shape: tuple[int, int]) -> np.ndarray:
        held = self.free.setdefault(shape, [])
        return held.pop() if held else np.empty(shape, np.uint64)

    def release(self, *arrays: np.ndarray) -> None:
        for a in arrays:
            self.free.setdefault(a.shape, []).append(a)

    def add(self, planes: list[list[np.ndarray]], bits: np.ndarray, level: int = 0) -> None:
        """Adds ``bits`` times 2 ** level; three numbers of a level become one and a carry."""
        if len(planes) <= level:
            planes.append([])
        here = planes[level]
        here.append(bits)
        if len(here) == 3:
            a, b, c = here
            total = np.bitwise_xor(a, b, out=self.buffer(a.shape))
            np.bitwise_and(a, b, out=a)
            np.bitwise_and(total, c, out=b)
            np.bitwise_or(a, b, out=a)
            np.bitwise_xor(total, c, out=total)
            self.release(b, c)
            planes[level] = [total]
            self.add(planes, a, level + 1)

    def settle(self, planes: list[list[np.ndarray]]) -> list[np.ndarray]:
        """One number a level: the bit planes."""
        level = 0
        while level < len(planes):
            if len(planes[level]) == 2:
                a, b = planes[level]
                total = np.bitwise_xor(a, b, out=self.buffer(a.shape))
                np.bitwise_and(a, b, out=a)
                self.release(b)
                planes[level] = [total]
                self.add(planes, a, level + 1)
            level += 1
        return [p[0] for p in planes]

    def reached(self, planes: list[np.ndarray], threshold: int) -> np.ndarray:
        """Bits of the counters that are at least ``threshold``."""
        out = self.buffer(planes[0].shape)
        out.fill(np.uint64(0) if threshold >> len(planes) else ~np.uint64(0))
        for level, plane in enumerate(planes):
            (np.bitwise_and if threshold >> level & 1 else np.bitwise_or)(out, plane, out=out)
        return out


class Stripe:
    """Some vectors of a block: for each projection and mark the set of those before it."""

    def __init__(self, place: np.ndarray, low: np.float32, high: np.float32):
        """``place``: the mark each vector lies at, by projection; ``low``, ``high``: its span of the first array."""
        self.low, self.high = low, high
        n = place.shape[1]
        self.sets = np.empty((len(place), MARKS + 2, -(-n // 64)), np.uint64)
        member, rows = np.zeros((MARKS + 2, self.sets.shape[2] * 64), np.uint8), np.arange(n)
        for sets, mine in zip(self.sets, place):
            member[mine + 1, rows] = 1
            np.bitwise_or.accumulate(np.packbits(member, axis=1, bitorder="little").view(np.uint64), axis=0, out=sets)
            member[mine + 1, rows] = 0

    def count(self, counts: Counts, low: np.ndarray, high: np.ndarray, held: list[np.ndarray] | None = None, low_held: np.ndarray | None = None, high_held: np.ndarray | None = None) -> list[np.ndarray]:
        """Bit planes of how many windows of each query hold each vector; added to ``held``, of the windows held before, if given."""
        shape = low.shape[1], self.sets.shape[2]
        planes = [[p] for p in held] if held else []
        for j, sets in enumerate(self.sets):
            bits, other = counts.buffer(shape), counts.buffer(shape)
            for at, ends in enumerate((low, high) if held is None else (low, low_held, high_held, high)):
                np.take(sets, ends[j], axis=0, out=other if at else bits, mode="clip")
                if at:
                    np.bitwise_xor(bits, other, out=bits)
            counts.release(other)
            counts.add(planes, bits)
        return counts.settle(planes)


class Block:
    """One sorted array per projection over the vectors of a block, held by stripes of the first."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, count: int = PROJECTIONS, seed: int = SEED):
        self.single = x.astype(np.float32)
        self.directions = _directions(self.single, count, seed)
        projected = self.single @ self.directions.T
        order = np.argsort(projected[:, 0], kind="stable")
        self.ids, self.x, self.single, projected = ids[order], x[order], self.single[order], projected[order]
        self.low = projected.min(0)
        self.mark = np.maximum((projected.max(0) - self.low) / MARKS, np.float32(1e-9)) * np.float32(1.000001)
        place = np.minimum((projected - self.low) / self.mark, MARKS).astype(np.int64).T
        self.starts = np.arange(0, len(x), STRIPE)
        self.stripes = [Stripe(place[:, a : a + STRIPE], projected[a, 0], projected[min(a + STRIPE, len(x)) - 1, 0]) for a in self.starts]

    def windows(self, projected: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """First mark of each query's window in each sorted array, and the mark behind its last, by projection."""
        low = np.clip(np.floor((projected - half - self.low) / self.mark), 0, MARKS + 1)
        high = np.clip(np.floor((projected + half - self.low) / self.mark) + 1, 0, MARKS + 1)
        return np.ascontiguousarray(low.T.astype(np.intp)), np.ascontiguousarray(np.maximum(low, high).T.astype(np.intp))

    def colliding(self, q: np.ndarray, projected: np.ndarray, todo: np.ndarray, half: float, threshold: int, least: float, held: dict, counts: Counts, keep: bool, before: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) of the queries ``todo`` that share at least ``threshold`` windows of half-width ``half``, whose product is ``least`` or more.

        ``held``: by stripe, the queries counted at the half-width ``before`` and their bit
        planes, which are added to, and replaced if ``keep``.
        """
        first, reach = projected[:, 0], half * (REACH / WIDTH)
        mine, theirs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, stripe in enumerate(self.stripes):
            near = todo[(first[todo] + reach >= stripe.low) & (first[todo] - reach <= stripe.high)]
            known, planes_held = held.pop(n, (np.zeros(0, np.int64), []))
            again = np.isin(known, near, assume_unique=True)
            new = np.setdiff1d(near, known[again], assume_unique=True)
            parts = []
            step = max(1, STEP_WORDS // stripe.sets.shape[2])
            for at in range(0, len(new), step):
                some = new[at : at + step]
                parts.append((some, stripe.count(counts, *self.windows(projected[some], half))))
                self._verify(q, parts, n, threshold, least, counts, mine, theirs, keep)
            places = np.flatnonzero(again)
            for at in range(0, len(places), step):
                rows = places[at : at + step]
                some = known[rows]
                old = [np.take(p, rows, axis=0) for p in planes_held]
                parts.append((some, stripe.count(counts, *self.windows(projected[some], half), old, *self.windows(projected[some], before))))
                self._verify(q, parts, n, threshold, least, counts, mine, theirs, keep)
            if keep and parts:
                depth = max(len(p) for _, p in parts)
                full = [p + [np.zeros_like(p[0])] * (depth - len(p)) for _, p in parts]
                held[n] = np.concatenate([q for q, _ in parts]), [np.concatenate([p[level] for p in full]) for level in range(depth)]
        return np.concatenate(mine), np.concatenate(theirs)

    def _verify(self, q: np.ndarray, parts: list, n: int, threshold: int, least: float, counts: Counts, mine: list, theirs: list, keep: bool) -> None:
        some, planes = parts[-1]
        hit = counts.reached(planes, threshold)
        words = np.flatnonzero(hit)
        vectors = self.single[self.starts[n] : self.starts[n] + STRIPE]
        if len(words) * DENSE > hit.size:
            # where most words have candidates, products of all cost less than of each
            near = np.zeros((len(some), hit.shape[1] * 64), bool)
            np.greater_equal(q[some] @ vectors.T, np.float32(least), out=near[:, : len(vectors)])
            near &= np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little").view(bool)
            i, j = np.divmod(np.flatnonzero(near), near.shape[1])
        else:
            bits = np.flatnonzero(np.unpackbits(hit.ravel()[words].view(np.uint8), bitorder="little").view(bool))
            word = words[bits >> 6]
            i, j = word // hit.shape[1], word % hit.shape[1] * 64 + (bits & 63)
            near = _dots(q, some[i], vectors, j) >= np.float32(least)
            i, j = i[near], j[near]
        mine.append(some[i])
        theirs.append(self.starts[n] + j)
        counts.release(hit)
        if not keep:
            parts.pop()
            counts.release(*planes)

    def radii(self, ids: np.ndarray, q: np.ndarray, k: int, most: float) -> list[float]:
        """Radii of the virtual rehashing, up to ``most``: where some queries, taken evenly, have ``k`` vectors.

        They only save work: whatever they are, a query is widened until it has ``k`` or is at ``most``.
        """
        some = np.arange(0, len(q), max(1, len(q) // SOUNDINGS))
        s = q[some] @ self.single.T
        s[ids[some][:, None] == self.ids[None, :]] = -2
        if s.shape[1] <= k:
            return [most]
        full = np.sqrt(np.maximum(0, 2 - 2 * np.partition(s, -k, axis=1)[:, -k]))
        full = full[full <= most]
        if len(full) * 8 < len(some):
            return [most]
        steps = [float(r) * 1.02 + 1e-3 for r in np.quantile(full, [0.25, 0.5, 0.75, 0.95])]
        return [r for n, r in enumerate(steps) if r < most / 1.1 and (not n or r > steps[n - 1] * 1.05)] + [most]

    def search(self, ids: np.ndarray, q: np.ndarray, k: int, min_cosine: float, width: float = WIDTH, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, cosine): up to ``k`` verified vectors of each query, most similar first, ties by id."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        scale, counts = width / math.sqrt(q.shape[1]), Counts()
        radii = self.radii(ids, q.astype(np.float32), k, math.sqrt(max(0.0, 2 - 2 * min_cosine)))
        for at in range(0, len(q), STEP_QUERIES):
            mine, x = ids[at : at + STEP_QUERIES], q[at : at + STEP_QUERIES]
            single = x.astype(np.float32)
            projected = single @ self.directions.T
            todo, held = np.arange(len(mine)), {}
            for n, radius in enumerate(radii):
                last = n == len(radii) - 1
                least = max(min_cosine, 1 - radius * radius / 2)
                i, j = self.colliding(single, projected, todo, radius * scale, threshold, least - 1e-5, held, counts, not last, radii[n - 1] * scale if n else 0.0)
                other = mine[i] != self.ids[j]
                i, j = i[other], j[other]
                cosine = _dots(x, i, self.x, j)
                within = cosine >= least
                i, j, cosine = i[within], j[within], cosine[within]
                done = np.bincount(i, minlength=len(mine)) >= k
                take = np.ones(len(i), bool) if last else done[i]
                out.append(_best(mine[i[take]], self.ids[j[take]], cosine[take], k))
                todo = todo[~done[todo]]
                if not len(todo):
                    break
        return tuple(np.concatenate(o) for o in zip(*out))


def _dots(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, step: int = 50_000) -> np.ndarray:
    """Products of the rows ``i`` of ``x`` with the rows ``j`` of ``y``."""
    return np.concatenate([np.einsum("ij,ij->i", x[i[a : a + step]], y[j[a : a + step]]) for a in range(0, max(1, len(i)), step)])


def _best(a: np.ndarray, b: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` rows of each ``a`` of greatest ``cosine``, ties by ``b``."""
    order = np.lexsort((b, -cosine, a))
    a, b, cosine = a[order], b[order], cosine[order]
    begins = np.flatnonzero(np.r_[True, a[1:] != a[:-1]][: len(a)])
    keep = np.arange(len(a)) - np.repeat(begins, np.diff(np.r_[begins, len(a)])) < k
    return a[keep], b[keep], cosine[keep]


def _directions(x: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Orthonormal directions: the longest axis of ``x`` first, the others at random (more than its size repeat at random)."""
    size, rng = x.shape[1], np.random.default_rng(seed)
    spread = x[:: max(1, len(x) // 2_048)]
    axis = np.linalg.eigh(np.cov(spread.T) if len(spread) > 1 else np.eye(size))[1][:, -1:]
    rounds = []
    while sum(r.shape[1] for r in rounds) < count:
        first = axis if not rounds else rng.standard_normal((size, 1))
        rounds.append(np.linalg.qr(np.concatenate([first, rng.standard_normal((size, size - 1))], axis=1))[0])
    return np.ascontiguousarray(np.concatenate(rounds, axis=1)[:, :count].T, np.float32)


def neighbours(
    vectors: DataFrame,
    entry_id: str = "entry_id",
    group: str = "embedder_id",
    value: str = "value",
    size: int = 64,
    k: int = 10,
    min_cosine: float | None = 0.9,
    fit_rows: int = FIT_ROWS,
    cell_rows: int = CELL_ROWS,
    margin: float | None = None,
    cells_most: int = CELLS_MOST,
) -> DataFrame:
    """(grp, id, neighbour, cosine, rank): the ``k`` most similar vectors of each, within ``min_cosine`` if it is given.

    Most similar first, ties by the least id; only vectors of the same group are
    compared. Vectors with nothing within ``min_cosine`` give no rows, nor do unusable
    ones (see ``usable``). Ids are integers. Approximate: recall depends on ``margin``
    and the window settings, and is measured in the tests.
    """
    good = usable(vectors, entry_id, group, value, size)
    kept = cut(searched(good, k), "vectors")
    near = _nearest(kept, size, k, min_cosine, fit_rows, cell_rows, margin, cells_most)
    last = kept.where(F.col("place") == k + 1).select(F.col("grp").alias("g"), F.col("same").alias("s"), F.col("id").alias("last"))
    if last.isEmpty():
        return near
    near = cut(near, "near")
    further = good.select("id", "grp", _same().alias("same")).join(last, F.col("grp").eqNullSafe(F.col("g")) & (F.col("same") == F.col("s")) & (F.col("id") > F.col("last"))).select("g", "id", "last")
    theirs = near.join(last.select("g", "last"), F.col("grp").eqNullSafe(F.col("g")) & (F.col("id") == F.col("last")), "left_semi")
    lists = theirs.groupBy("grp", F.col("id").alias("_of")).agg(F.collect_list(F.struct("neighbour", "cosine", "rank")).alias("_rows"))
    rows = further.join(lists, F.col("grp").eqNullSafe(F.col("g")) & (F.col("_of") == F.col("last"))).select("grp", "id", F.explode("_rows").alias("_r"))
    return near.unionByName(rows.select("grp", "id", "_r.*"))


def _nearest(kept: DataFrame, size: int, k: int, min_cosine: float | None, fit_rows: int = FIT_ROWS, cell_rows: int = CELL_ROWS, margin: float | None = None, cells_most: int = CELLS_MOST) -> DataFrame:
    """``neighbours`` of the searched vectors."""
    good = kept.select("id", "grp", "value")
    counts = {r.grp: r.n for r in good.groupBy("grp").agg(F.count("*").alias("n")).collect()}  # groups are models: few
    most = 0.0 if min_cosine is None else math.sqrt(max(0.0, 2 - 2 * min_cosine))
    margin = margin if margin is not None else WHOLE_MARGIN if min_cosine is None else MARGIN
    model = _fit(good, size, counts, fit_rows, cell_rows, cells_most, most, margin)
    if min_cosine is None:
        once = _whole(good, good.sparkSession.sparkContext.broadcast({g: m.centres for g, m in model.items()}), counts, size, k, margin)
    else:
        once = _within(good, _deepen(good, model, size, cell_rows, cells_most, most, margin), size, k, min_cosine, margin)
    place = F.row_number().over(Window.partitionBy("grp", "a").orderBy(F.desc("cosine"), "b"))
    ranked = once.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("grp", F.col("a").alias("id"), F.col("b").alias("neighbour"), "cosine", "rank")


def _within(good: DataFrame, model: dict, size: int, k: int, min_cosine: float, margin: float) -> DataFrame:
    """(grp, a, b, cosine) of pairs within ``min_cosine``, each in both directions."""
    most = math.sqrt(max(0.0, 2 - 2 * min_cosine))
    sent = good.mapInArrow(_router(good.sparkSession.sparkContext.broadcast(model), size, most, margin), "grp string, cell int, part int, qpart int, id bigint, vec binary, role int")
    found = sent.groupBy("grp", "cell", "part", "qpart").applyInArrow(_searcher(size, k, min_cosine), "grp string, a bigint, b bigint, cosine double")
    # both directions from one pass over the blocks
    ways = F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = found.select("grp", ways.alias("_w"), "cosine").select("grp", "_w.a", "_w.b", "cosine")
    return both.groupBy("grp", "a", "b").agg(F.max("cosine").alias("cosine"))


class Cells:
    """Centroids of a group or of one of its cells, what each is expected to hold, and the cells below."""

    def __init__(self, sample: np.ndarray, centres: np.ndarray, share: float, most: float, margin: float):
        """``sample``: unit vectors, each standing for ``1 / share`` rows."""
        self.centres = centres
        self.gaps = np.sqrt(np.maximum(_square_distances(centres, centres), 0))
        i, cell, home = self.route(sample, most, margin)
        self.rows, self.asks = (_expected(np.bincount(c, minlength=len(centres)), share) for c in (home, cell))
        self.below: dict[int, Cells] = {}
        self.offset = 0

    def route(self, x: np.ndarray, most: float, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell) of every cell a row is sent to, and the home of every row."""
        d = _square_distances(x, self.centres)
        home = d.argmin(1)
        # a vector at the radius moves this difference by 2 * radius * gap / sqrt(size), one deviation
        slack = 2 * margin * most / math.sqrt(x.shape[1]) * self.gaps[home]
        i, cell = np.nonzero(d - d[np.arange(len(x)), home][:, None] <= slack)
        return i, cell, home

    def number(self, offset: int = 0) -> int:
        """Gives each cell that has none below it a number of its own; returns the next free one."""
        self.offset, offset = offset, offset + len(self.centres)
        for cells in self.below.values():
            offset = cells.number(offset)
        return offset


def _expected(held: np.ndarray, share: float) -> np.ndarray:
    """Rows of each cell from those of the sample, three standard deviations up; exact if all rows are in it."""
    return held / share + (3 * np.sqrt(held + 1) / share if share < 1 else 0)


def _whole(good: DataFrame, centres, counts: dict, size: int, k: int, margin: float) -> DataFrame:
    """(grp, a, b, cosine): candidates of each vector without a floor, among them its ``k`` best."""
    at_home = good.mapInArrow(_housed(centres, size), "grp string, cell int, id bigint, vec binary")
    sizes = at_home.groupBy("grp", "cell").agg(F.count("*").alias("n")).collect()  # at most CELLS_MOST a group
    large = [(r.grp, r.cell, -(-r.n // BLOCK_ROWS)) for r in sizes if r.n > BLOCK_ROWS]
    if large:
        parts = good.sparkSession.createDataFrame(large, "g string, c int, parts int")
        at_home = at_home.join(F.broadcast(parts), F.col("grp").eqNullSafe(F.col("g")) & (F.col("cell") == F.col("c")), "left")
        part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))
    else:
        part = F.lit(0)
    at_home = at_home.select("grp", "cell", part.cast("int").alias("part"), "id", "vec")
    bounded = cut(at_home.groupBy("grp", "cell", "part").applyInArrow(_bounder(size, k), "grp string, cell int, part int, id bigint, vec binary, bound double"), "bounds")

    # cells that lie near each other share a block
    blocks: dict = {}
    for grp, c in centres.value.items():
        held = {r.cell: r.n for r in sizes if r.grp == grp}
        block, room = -1, 0
        for cell in _chain(c):
            n = held.get(cell, 0)
            if n > BLOCK_ROWS:
                blocks[grp, cell] = (block + 1, -(-n // BLOCK_ROWS))
                block, room = block + -(-n // BLOCK_ROWS), 0
            elif n:
                if n > room:
                    block, room = block + 1, BLOCK_ROWS
                blocks[grp, cell] = (block, 1)
                room -= n
    asked = {grp: max(1, -(-n // ASK_ROWS)) for grp, n in counts.items()}
    plan = good.sparkSession.sparkContext.broadcast((blocks, asked))
    sent = bounded.mapInArrow(_sender(centres, plan, size, margin), "grp string, block int, qpart int, cell int, home int, id bigint, vec binary, bound double")
    return sent.groupBy("grp", "block", "qpart").applyInArrow(_verifier(centres, size, k, margin), "grp string, a bigint, b bigint, cosine double")


def _chain(centres: np.ndarray) -> list[int]:
    """The cells in an order in which each is followed by the nearest one left."""
    d = _square_distances(centres, centres)
    out = [0]
    d[:, 0] = np.inf
    while len(out) < len(centres):
        out.append(int(d[out[-1]].argmin()))
        d[:, out[-1]] = np.inf
    return out


def _reach(x: np.ndarray, home: np.ndarray, bound: np.ndarray, centres: np.ndarray, margin: float) -> np.ndarray:
    """Whether a vector at least as similar as ``bound`` may live in each cell."""
    d = _square_distances(x, centres)
    gaps = np.sqrt(np.maximum(_square_distances(centres, centres), 0))
    radius = np.sqrt(np.maximum(2 - 2 * bound, 0))
    slack = 2 * margin * radius[:, None] / math.sqrt(x.shape[1]) * gaps[home]
    near = (d - d[np.arange(len(x)), home][:, None] <= slack) | (bound < -1)[:, None]
    near[np.arange(len(x)), home] = True
    return near


def _binary(x: np.ndarray) -> pa.Array:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (4 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x.astype("<f4").tobytes())])


def _vectors(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """The numbers as they came."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, size)


def _singles(raw: np.ndarray) -> np.ndarray:
    return _units(raw).astype(np.float32)


def _by_group(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str | None, np.ndarray, np.ndarray]]:
    """(group, ids, numbers) of the rows (id, grp, value), some thousand at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, groups, x = batch.column(0).to_numpy(), batch.column(1).to_pylist(), _raw(batch, 2, size)
        for grp in dict.fromkeys(groups):
            rows = np.flatnonzero([g == grp for g in groups])
            for at in range(0, len(rows), 4096):
                yield grp, ids[rows[at : at + 4096]], x[rows[at : at + 4096]]


def _housed(centres, size: int):
    """Each vector with the cell of its nearest centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, ids, x in _by_group(batches, size):
            cell = nearest(_singles(x), centres.value[grp])
            yield pa.RecordBatch.from_arrays([pa.array([grp] * len(ids), pa.string()), pa.array(cell.astype(np.int32)), pa.array(ids.astype(np.int64)), _binary(x)], ["grp", "cell", "id", "vec"])

    return run


def _bounder(size: int, k: int):
    """Adds the ``k``-th best cosine among the rows, below which no neighbour lies; -2 where there are fewer."""

    def run(table: pa.Table) -> pa.Table:
        x = _singles(_vectors(table["vec"], size))
        bound = np.full(len(x), -2.0)
        if len(x) > k:
            step = max(1, VERIFY_PAIRS // len(x))
            for at in range(0, len(x), step):
                s = x[at : at + step] @ x.T
                s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
                bound[at : at + step] = np.partition(s, len(x) - k, axis=1)[:, len(x) - k]
        # a little lower, as the products are of single precision
        return table.append_column("bound", pa.array(np.where(bound < -1.5, -2.0, bound - 1e-5)))

    return run


def _sender(centres, plan, size: int, margin: float):
    """Each vector once for its own block and query part, and as a query to each block it may have neighbours in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, asked = plan.value
        for batch in batches:
            groups = batch.column("grp").to_pylist()
            for grp in dict.fromkeys(groups):
                rows = np.flatnonzero([g == grp for g in groups])
                mine = batch.take(pa.array(rows))
                raw, cell, part, ids, bound = _vectors(mine.column("vec"), size), *(mine.column(c).to_numpy() for c in ("cell", "part", "id", "bound"))
                c, parts = centres.value[grp], asked[grp]
                first = np.array([blocks.get((grp, i), (0, 0))[0] for i in range(len(c))])
                count = np.array([blocks.get((grp, i), (0, 0))[1] for i in range(len(c))])
                near = _reach(_singles(raw), cell, bound, c, margin)
                to = np.zeros((len(raw), int((first + count).max())), bool)
                for i in range(len(c)):
                    to[:, first[i] : first[i] + count[i]] |= near[:, i, None]
                i, block = np.nonzero(to)
                qpart = (ids % parts).astype(np.int32)
                n = len(raw)
                base = np.repeat(np.arange(n), parts)
                row = np.r_[i, base]
                for at in range(0, len(row), 50_000):
                    s = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([grp] * len(row[s]), pa.string()),
                            pa.array(np.r_[block, (first[cell] + part)[base]][s].astype(np.int32)),
                            pa.array(np.r_[qpart[i], np.tile(np.arange(parts), n)][s].astype(np.int32)),
                            pa.array(cell[row[s]].astype(np.int32)),
                            pa.array(np.r_[np.zeros(len(i)), np.ones(len(base))][s].astype(np.int32)),
                            pa.array(ids[row[s]].astype(np.int64)),
                            _binary(raw[row[s]]),
                            pa.array(bound[row[s]]),
                        ],
                        ["grp", "block", "qpart", "cell", "home", "id", "vec", "bound"],
                    )

    return run


def _verifier(centres, size: int, k: int, margin: float):
    def run(table: pa.Table) -> pa.Table:
        grp = table["grp"][0].as_py()
        raw, home, cell, ids, bound = _vectors(table["vec"], size), *(table[c].to_numpy() for c in ("home", "cell", "id", "bound"))
        base = np.flatnonzero(home == 1)
        base = base[np.argsort(cell[base], kind="stable")]
        ask = np.flatnonzero(home == 0)
        cells, starts = np.unique(cell[base], return_index=True)
        ends = np.r_[starts[1:], len(base)]
        exact = _units(raw[base])
        bases = exact.astype(np.float32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(ask), 2048):
            some = ask[at : at + 2048]
            sharp = _units(raw[some])
            q = sharp.astype(np.float32)
            near = _reach(q, cell[some], bound[some], centres.value[grp], margin)
            least = bound[some].astype(np.float32)
            pairs = []
            for c, a, b in zip(cells, starts, ends):
                who = np.flatnonzero(near[:, c])
                step = max(1, VERIFY_PAIRS // (b - a))
                for w in (who[o : o + step] for o in range(0, len(who), step)):
                    hit = np.flatnonzero(((q[w] @ bases[a:b].T) >= least[w, None]).ravel())
                    pairs.append((w[hit // (b - a)], a + hit % (b - a)))
            if not pairs:
                continue
            i, j = (np.concatenate(p) for p in zip(*pairs))
            other = ids[some[i]] != ids[base[j]]
            i, j = i[other], j[other]
            found.append(_best(ids[some[i]], ids[base[j]], _dots(sharp, i, exact, j), k))
        a, b, cosine = (np.concatenate(f) for f in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"grp": pa.array([grp] * len(a), pa.string()), "a": a, "b": b, "cosine": cosine})

    return run


def _fit(good: DataFrame, size: int, counts: dict, fit_rows: int, cell_rows: int, cells_most: int, most: float, margin: float) -> dict[str | None, Cells]:
    """Cells of each group, from a sample of about ``fit_rows`` rows picked by hash."""
    model = {}
    for grp, n in counts.items():
        share = min(1_000_000, math.ceil(1_000_000 * fit_rows / max(1, n))) / 1_000_000
        picked = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1_000_000)) < round(share * 1_000_000)
        rows = good.where(F.col("grp").eqNullSafe(F.lit(grp)) & picked).limit(2 * fit_rows).select("value").toArrow()
        x = _singles(_raw(rows.combine_chunks().to_batches()[0], 0, size)) if rows.num_rows else np.ones((1, size), np.float32)
        cells = int(min(cells_most, max(1, n // cell_rows), max(1, len(x) // 8)))
        model[grp] = Cells(x, fit_centroids(x, cells), share, most, margin)
    return model


def _deepen(good: DataFrame, model: dict[str | None, Cells], size: int, cell_rows: int, cells_most: int, most: float, margin: float) -> dict[str | None, Cells]:
    """The model with cells below those that are much larger than ``cell_rows``, fitted in parallel on a sample of each."""
    large = {(g, int(c)): float(m.rows[c]) for g, m in model.items() for c in np.flatnonzero(m.rows > 4 * cell_rows) if len(m.centres) == cells_most}
    if large:
        home = good.sparkSession.sparkContext.broadcast({g: m.centres for g, m in model.items()})
        share = min(1.0, SUB_ROWS / cell_rows)
        picked = F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.lit(1_000_000)) < round(share * 1_000_000)
        housed = good.where(picked).mapInArrow(_housed(home, size), "grp string, cell int, id bigint, vec binary")
        # at most cells_most * SUB_ROWS rows of a cell, however large
        order = Window.partitionBy("grp", "cell").orderBy(F.xxhash64("id", F.lit(SEED + 2)), "id")
        some = housed.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cells_most * SUB_ROWS).drop("_n")
        known = good.sparkSession.sparkContext.broadcast(large)

        def fit(table: pa.Table) -> pa.Table:
            grp, cell = table["grp"][0].as_py(), table["cell"][0].as_py()
            rows, x = known.value.get((grp, cell), 0), _singles(_vectors(table["vec"], size))
            cells = int(min(cells_most, rows // cell_rows, len(x) // 8))
            made = Cells(x, fit_centroids(x, max(1, cells)), min(1.0, len(x) / max(1.0, rows)), most, margin)
            cells = cells if cells > 1 else 0  # a cell that need not be split has none below
            return pa.table({"grp": pa.array([grp] * cells, pa.string()), "cell": pa.array([cell] * cells, pa.int32()), "centre": _binary(made.centres[:cells]), "asks": made.asks[:cells], "rows": made.rows[:cells]})

        fitted = some.groupBy("grp", "cell").applyInArrow(fit, "grp string, cell int, centre binary, asks double, rows double").toArrow()  # cells_most squared a group at most
        groups, cell = np.array(fitted["grp"].to_pylist(), object), fitted["cell"].to_numpy()
        for g, c in dict.fromkeys(zip(groups, cell.tolist())):
            mine = pa.array(np.flatnonzero((cell == c) & np.array([x == g for x in groups])))
            below = Cells(np.zeros((0, size), np.float32), _vectors(fitted["centre"].take(mine), size), 1.0, most, margin)
            below.rows, below.asks = fitted["rows"].take(mine).to_numpy(), fitted["asks"].take(mine).to_numpy()
            # queries that live elsewhere come on top
            below.asks = below.asks * max(1.0, model[g].asks[c] / max(1.0, model[g].rows[c]))
            model[g].below[c] = below
    for m in model.values():
        m.number()
    return model


def _router(model, size: int, most: float, margin: float):
    """Each vector to the blocks of its home, as one to be found, and of every cell in reach, as a query (role: 0 query, 1 both, 2 to be found)."""

    def blocks(cells: Cells, cell: np.ndarray, own: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, part, qpart, role): a large cell is a grid, in which every part meets every part of its queries."""
        parts = np.maximum(1, np.ceil(cells.rows[cell] / BLOCK_ROWS)).astype(np.int64)
        qparts = np.maximum(1, np.ceil(cells.asks[cell] / QUERY_ROWS)).astype(np.int64)
        rows = np.arange(len(cell))
        one = (parts == 1) & (qparts == 1)
        out = [(rows[one], np.zeros(one.sum(), np.int64), np.zeros(one.sum(), np.int64), own[one].astype(np.int64))]
        mine, asked = _scatter(ids, 1) % parts.astype(np.uint64), _scatter(ids, 2) % qparts.astype(np.uint64)
        for i in rows[~one]:
            out.append((np.full(parts[i], i), np.arange(parts[i]), np.full(parts[i], asked[i], np.int64), np.zeros(parts[i], np.int64)))
            if own[i]:
                out.append((np.full(qparts[i], i), np.full(qparts[i], mine[i], np.int64), np.arange(qparts[i]), np.full(qparts[i], 2)))
        return tuple(np.concatenate(o) for o in zip(*out))

    def sent(cells: Cells, x: np.ndarray, ids: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, cell number, part, qpart, role) of vectors, ``own``: whether they live here."""
        i, cell, home = cells.route(x, most, margin)
        here = (cell == home[i]) & own[i]
        deeper = np.isin(cell, list(cells.below)) if cells.below else np.zeros(len(cell), bool)
        top = np.flatnonzero(~deeper)
        row, part, qpart, role = blocks(cells, cell[top], here[top], ids[i[top]])
        yield i[top][row], cells.offset + cell[top][row], part, qpart, role
        for c in np.unique(cell[deeper]):
            some = np.flatnonzero(cell == c)
            for row, *rest in sent(cells.below[int(c)], x[i[some]], ids[i[some]], here[some]):
                yield i[some][row], *rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, ids, raw in _by_group(batches, size):
            row, cell, part, qpart, role = (np.concatenate(o) for o in zip(*sent(model.value[grp], _singles(raw), ids, np.ones(len(ids), bool))))
            for at in range(0, len(row), 50_000):
                s = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([grp] * len(row[s]), pa.string()), *(pa.array(c[s].astype(np.int32)) for c in (cell, part, qpart)), pa.array(ids[row[s]].astype(np.int64)), _binary(raw[row[s]]), pa.array(role[s].astype(np.int32))],
                    ["grp", "cell", "part", "qpart", "id", "vec", "role"],
                )

    return run


def _scatter(ids: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each id, for parts of even size."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.int64).view(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)


def _searcher(size: int, k: int, min_cosine: float):
    def run(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        role = table["role"].to_numpy()
        raw = _vectors(table["vec"], size)
        base = np.flatnonzero(role >= 1)
        ask = np.flatnonzero(role <= 1)
        base = base[np.unique(ids[base], return_index=True)[1]]
        grp = table["grp"][0].as_py()
        a, b, cosine = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(base) and len(ask):
            a, b, cosine = Block(ids[base], _units(raw[base])).search(ids[ask], _units(raw[ask]), k, min_cosine)
        return pa.table({"grp": pa.array([grp] * len(a), pa.string()), "a": a, "b": b, "cosine": cosine})

    return run


def mutual_pairs(vectors: DataFrame, entry_id: str = "entry_id", k: int = 10, min_cosine: float = 0.9, **more) -> DataFrame:
    """(entry_id_a, entry_id_b), smaller first: each among the ``k`` most similar of the other, within ``min_cosine``."""
    names = {n: more.pop(n, d) for n, d in (("group", "embedder_id"), ("value", "value"), ("size", 64))}
    kept = cut(searched(usable(vectors, entry_id, **names), k), "vectors")
    near = _nearest(kept, names["size"], k, min_cosine, **more)
    there = near.select(F.col("id").alias("a"), F.col("neighbour").alias("b"), "grp")
    back = near.select(F.col("neighbour").alias("a"), F.col("id").alias("b"), "grp")
    both = there.where("a < b").join(back, (there.a == back.a) & (there.b == back.b) & there.grp.eqNullSafe(back.grp), "left_semi")
    return both.select(F.col("a").alias("entry_id_a"), F.col("b").alias("entry_id_b")).distinct()
