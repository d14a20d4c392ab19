"""Exact and two-pass vector search for a stated set of queries against all rows.

The query vectors go to the workers in blocks of ``QUERY_BLOCK`` (a fixed bound);
each Arrow batch of the corpus is scored by one matrix product, and a task keeps the
top k of each query over its batches, so the shuffle holds at most
``k`` rows a query and task (and ties), however many rows the corpus has.

``store`` writes each vector beside its int8 codes, its 4-bit codes and its first
numbers as columns of their own, so a first pass reads a quarter, an eighth or a part of the bytes of an exact scan.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sightline.functions import vectors as V
from sightline.operators.ranking import page
from sightline.session import cut
from sightline.sources import files

QUERY_BLOCK = 2_000
#: How many times k a first pass keeps.
TWO_PASS = 5
MRL_DIMS, MRL_RESCORE = 64, 3

# Why a search gave nothing, most telling first.
EMPTY_REASONS = ["invalid_query", "zero_limit", "no_index", "dimension_mismatch", "empty_index", "all_deleted", "filter_rejected_all", "no_finite_score", "no_match"]


def _blocks(queries: DataFrame, query_id: str, value: str) -> Iterator[tuple[list, np.ndarray]]:
    rows = queries.select(F.col(query_id).alias("q"), F.col(value).alias("v")).where("v IS NOT NULL").distinct()
    parts = max(1, -(-rows.count() // QUERY_BLOCK))
    for p in range(parts):
        block = rows.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == p).collect() if parts > 1 else rows.collect()
        if block:
            x = np.array([r.v for r in block], np.float32)
            if not np.isfinite(x).all():
                raise ValueError("a query vector is not finite")
            yield [r.q for r in block], x


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, np.float32).reshape(len(column), -1)


def score_blocks(corpus: DataFrame, queries: DataFrame, k: int, doc_id: str, value: str, query_id: str, query_value: str, score) -> DataFrame:
    """(query_id, doc_id, score): the top ``k`` of each query in each task; ``score(rows, queries)`` gives the matrix."""
    return _scan(corpus.select(F.col(doc_id).alias("doc_id"), F.col(value).alias("v")), queries, k, query_id, query_value, lambda batch, q: score(_matrix(batch.column(1)), q))


def _scan(corpus: DataFrame, queries: DataFrame, k: int, query_id: str, query_value: str, score) -> DataFrame:
    """``score_blocks`` over (doc_id, v, ...), where ``score(batch, queries)`` gives the matrix."""
    spark = corpus.sparkSession
    named = corpus.where("doc_id IS NOT NULL AND v IS NOT NULL")
    doc_kind = named.schema["doc_id"].dataType.simpleString()
    query_type = queries.select(query_id).schema[0].dataType
    query_kind, query_arrow = query_type.simpleString(), to_arrow_type(query_type)
    out = None
    for ids, q in _blocks(queries, query_id, query_value):
        held = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            docs, cols, scores, waiting = [], [], [], 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                s = np.asarray(score(batch, q))
                s = np.where(np.isnan(s), -np.inf, s)
                if len(s) > k:
                    rows, mine = np.nonzero(s >= -np.partition(-s, k - 1, axis=0)[k - 1])  # ties at the edge stay in
                else:
                    rows, mine = np.nonzero(np.ones_like(s, bool))
                docs.append(batch.column(0).take(pa.array(rows)))
                cols.append(mine)
                scores.append(s[rows, mine])
                waiting += len(rows)
                if waiting > 8 * k * len(ids) + 100_000:
                    docs, cols, scores = ([x] for x in _edge(docs, cols, scores, k))
                    waiting = len(cols[0])
            if docs:
                doc, col, s = _edge(docs, cols, scores, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids, query_arrow).take(pa.array(col)), doc, pa.array(s.astype(np.float64))], ["query_id", "doc_id", "score"])

        part = named.mapInArrow(run, f"query_id {query_kind}, doc_id {doc_kind}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return corpus.sparkSession.createDataFrame([], f"query_id {query_kind}, doc_id {doc_kind}, score double")
    return out


def _edge(docs: list[pa.Array], cols: list[np.ndarray], scores: list[np.ndarray], k: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The rows of each query that score at least its ``k``-th."""
    doc, col, s = pa.concat_arrays(docs), np.concatenate(cols), np.concatenate(scores)
    order = np.lexsort((-s, col))
    begins = np.flatnonzero(np.r_[True, col[order][1:] != col[order][:-1]])
    size = np.diff(np.r_[begins, len(order)])
    least = np.repeat(s[order][begins + np.minimum(size, k) - 1], size)
    keep = order[s[order] >= least]
    return doc.take(pa.array(keep)), col[keep], s[keep]


def dot_scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    return rows.astype(np.float64) @ queries.T.astype(np.float64)


def ranked_top_k(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) from 0: score, then document id as a string; each document once, NaN worst."""
    once = scores.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return page(once, ["query_id"], [F.desc("score"), F.col("doc_id").cast("string")], k)


def exact_top_k(corpus: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", value: str = "embedding", query_id: str = "query_id", query_value: str = "embedding") -> DataFrame:
    """Top ``k`` by dot product of every query, over all rows. Filters belong on ``corpus``, where they are pushed down."""
    if k <= 0:
        return ranked_top_k(score_blocks(corpus.limit(0), queries, 1, doc_id, value, query_id, query_value, dot_scores), 0)
    return ranked_top_k(score_blocks(corpus, queries, k, doc_id, value, query_id, query_value, dot_scores), k)


def truncated_top_k(corpus: DataFrame, queries: DataFrame, k: int, dims: int = MRL_DIMS, rescore: int = MRL_RESCORE, doc_id: str = "doc_id", value: str = "embedding", query_id: str = "query_id", query_value: str = "embedding") -> DataFrame:
    """Scan by the first ``dims`` numbers, then exact scores of the top ``rescore * k``; ``dims`` of 0 is an error."""
    if dims <= 0:
        raise ValueError("at least one dimension is needed")
    first = score_blocks(corpus, queries, k * rescore, doc_id, value, query_id, query_value, lambda x, q: dot_scores(x[:, :dims], q[:, :dims]))
    return rescored(ranked_top_k(first, k * rescore), corpus, queries, k, doc_id, value, query_id, query_value)


def rescored(hits: DataFrame, corpus: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", value: str = "embedding", query_id: str = "query_id", query_value: str = "embedding") -> DataFrame:
    """Exact scores of hits (few), ranked anew: only the winners' vectors are joined."""
    docs = corpus.select(F.col(doc_id).alias("doc_id"), F.col(value).alias("_v"))
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_value).alias("_q"))
    exact = docs.join(hits.select("query_id", "doc_id"), "doc_id").join(q, "query_id").select("query_id", "doc_id", V.dot(F.col("_v"), F.col("_q")).alias("score"))
    return ranked_top_k(exact, k)


# -- stored codes ----------------------------------------------------------------------------


def scaled_codes(x: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes -levels..levels of each row, and the step of a row."""
    step = np.maximum(np.abs(x).max(1, initial=0), np.float32(1e-12)) / levels
    return np.rint(x / step[:, None]).astype(np.int8), step.astype(np.float32)


def store(corpus: DataFrame, path: str, dims: int = MRL_DIMS, doc_id: str = "doc_id", value: str = "embedding") -> DataFrame:
    """Writes (doc_id, v, int8, step8, int4, step4, head) and reads it back: the vector, its codes of one and of half a byte a number, its first ``dims`` numbers.

    Rows without id or vector are left out. All vectors must have one length.
    """
    named = corpus.select(F.col(doc_id).alias("doc_id"), F.col(value).cast("array<float>").alias("v")).where("doc_id IS NOT NULL AND v IS NOT NULL")
    kind = named.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            (c8, s8), (c4, s4) = scaled_codes(x, 127), scaled_codes(x, 7)
            head = x[:, :dims]
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * head.shape[1])
            columns = [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in c8], pa.binary()), pa.array(s8), pa.array(pack_rows(c4), pa.binary()), pa.array(s4), pa.ListArray.from_arrays(ends, pa.array(head.ravel(), pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "v", "int8", "step8", "int4", "step4", "head"])

    named.mapInArrow(run, f"doc_id {kind}, v array<float>, int8 binary, step8 float, int4 binary, step4 float, head array<float>").write.parquet(path)
    return corpus.sparkSession.read.parquet(path)


def pack_rows(codes: np.ndarray) -> list[bytes]:
    """``pack_nibbles`` of each row."""
    u = (codes.astype(np.int8) & 0xF).astype(np.uint8)
    u = np.pad(u, ((0, 0), (0, u.shape[1] % 2)))
    return [r.tobytes() for r in u[:, ::2] | u[:, 1::2] << 4]


def _coded(batch: pa.RecordBatch, q: np.ndarray, bits: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    if bits == 8:
        codes = raw.view(np.int8)
    else:
        codes = np.stack([raw & 0xF, raw >> 4], 2).reshape(len(raw), -1)[:, : q.shape[1]].astype(np.int8)
        codes[codes > 7] -= 16
    asked, step = scaled_codes(q, 127 if bits == 8 else 7)
    return (codes.astype(np.float32) @ asked.astype(np.float32).T) * batch.column(2).to_numpy()[:, None] * step


def stored_top_k(stored: DataFrame, queries: DataFrame, k: int, form: str = "int8", multiplier: int | None = None, query_id: str = "query_id", query_value: str = "embedding") -> DataFrame:
    """(query_id, doc_id, score, rank): a first pass over the ``form`` (int8, int4 or head) of a store keeps ``multiplier * k`` a query, whose vectors are then read and scored exactly."""
    columns = {"int8": ["int8", "step8"], "int4": ["int4", "step4"], "head": ["head"]}[form]
    keep = k * (multiplier or (MRL_RESCORE if form == "head" else TWO_PASS))
    seen = stored.select("doc_id", F.col(columns[0]).alias("v"), *columns[1:])
    if form == "head":
        first = _scan(seen, queries, keep, query_id, query_value, lambda b, q: dot_scores(x := _matrix(b.column(1)), q[:, : x.shape[1]]))
    else:
        bits = int(form[3:])
        first = _scan(seen, queries, keep, query_id, query_value, lambda b, q: _coded(b, q, bits))
    return rescored(ranked_top_k(first, keep), stored, queries, k, "doc_id", "v", query_id, query_value)


def two_pass_top_k(corpus: DataFrame, queries: DataFrame, k: int, bits: int = 8, multiplier: int = TWO_PASS, doc_id: str = "doc_id", value: str = "embedding", query_id: str = "query_id", query_value: str = "embedding") -> DataFrame:
    """A quantized scan keeps ``multiplier * k`` a query, which are rescored exactly. Without a store: codes are made as vectors are read."""
    levels = 127 if bits == 8 else 7

    def score(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        (a, sa), (b, sb) = scaled_codes(x, levels), scaled_codes(q, levels)
        return (a.astype(np.float32) @ b.astype(np.float32).T) * sa[:, None] * sb

    first = score_blocks(corpus, queries, k * multiplier, doc_id, value, query_id, query_value, score)
    return rescored(ranked_top_k(first, k * multiplier), corpus, queries, k, doc_id, value, query_id, query_value)


def pack_nibbles(codes: np.ndarray) -> bytes:
    """Codes -7..7, two to a byte, the first in the low half."""
    u = (codes.astype(np.int8) & 0xF).astype(np.uint8)
    u = np.pad(u, (0, len(u) % 2))
    return (u[::2] | u[1::2] << 4).tobytes()


def unpack_nibbles(data: bytes, size: int) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    u = np.stack([b & 0xF, b >> 4], 1).ravel()[:size].astype(np.int8)
    return np.where(u > 7, u - 16, u)


def empty_reason(queries_ok: bool, k: int, rows: int, live: int, passing: int, size_ok: bool, finite: int) -> str | None:
    """Why nothing came out, by fixed precedence; None if something can."""
    checks = [not queries_ok, k <= 0, rows is None, not size_ok, rows == 0, live == 0, passing == 0, finite == 0]
    return next((r for r, bad in zip(EMPTY_REASONS, checks) if bad), None)


# -- embedding what is new ------------------------------------------------------------------


def embed_cached(documents: DataFrame, cache: DataFrame, embed: Callable[[Column], Column], embedder_id: str, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((doc_id, content_hash, vector) of all documents, new cache entries (embedder_id, content_hash, vector)).

    Texts the cache (embedder_id, content_hash, vector) holds are not embedded again, and each new text is once, however
    many documents share it. Documents without text have no vector.
    """
    keyed = documents.select(F.col(doc_id).alias("doc_id"), F.sha2(F.col(text), 256).alias("content_hash"), F.col(text).alias("_text"))
    known = cache.where(F.col("embedder_id") == embedder_id).groupBy("content_hash").agg(F.min("vector").alias("vector"))
    todo = keyed.where("_text IS NOT NULL").groupBy("content_hash").agg(F.first("_text").alias("_text")).join(known, "content_hash", "left_anti")
    new = cut(todo.select(F.lit(embedder_id).alias("embedder_id"), "content_hash", embed(F.col("_text")).alias("vector")), "embedded")
    rows = keyed.drop("_text").join(known.unionByName(new.drop("embedder_id")), "content_hash", "left")
    return rows.select("doc_id", "content_hash", "vector"), new


# -- the base with its increments --------------------------------------------------------


def live_rows(base: DataFrame, appended: DataFrame, deleted: DataFrame | None = None, doc_id: str = "doc_id", seq: str = "seq") -> DataFrame:
    """Newest row of each document over a base and its increments, without those deleted."""
    rows = base.unionByName(appended)
    columns = [c for c in rows.columns if c != doc_id]
    newest = rows.groupBy(doc_id).agg(F.max_by(F.struct(*columns), seq).alias("_r")).select(doc_id, "_r.*")
    return newest if deleted is None else newest.join(deleted.select(doc_id).distinct(), doc_id, "left_anti")


def needs_compaction(base_rows: int, appended_rows: int, most: int = 1000, share: float = 0.10) -> bool:
    return appended_rows >= most or (base_rows > 0 and appended_rows / base_rows >= share)


def tombstone_ratio(rows: DataFrame, tombstone: str = "is_tombstone") -> DataFrame:
    return rows.agg((F.count_if(F.col(tombstone)) / F.greatest(F.count("*"), F.lit(1))).alias("ratio"))


# -- recall certificates ---------------------------------------------------------------------


def conformal_recall_lower_bound(recalls: Sequence[float], alpha: float) -> float:
    """With probability 1 - alpha the next query's recall is at least this."""
    n = len(recalls)
    at = math.floor(alpha * (n + 1))
    return 0.0 if at < 1 else sorted(recalls)[at - 1]


def hoeffding_lower_bound(recalls: Sequence[float], alpha: float) -> float:
    n = len(recalls)
    return max(0.0, sum(recalls) / n - math.sqrt(math.log(1 / alpha) / (2 * n))) if n else 0.0


def bernstein_lower_bound(recalls: Sequence[float], alpha: float) -> float:
    n = len(recalls)
    if n < 2:
        return 0.0
    mean = sum(recalls) / n
    var = sum((r - mean) ** 2 for r in recalls) / (n - 1)
    t = math.log(2 / alpha)
    return max(0.0, mean - math.sqrt(2 * var * t / n) - 7 * t / (3 * (n - 1)))


def certified_effort(by_effort: dict[int, Sequence[float]], target: float, alpha: float, bound=conformal_recall_lower_bound) -> int | None:
    """The least search effort whose certified recall reaches ``target``."""
    return next((e for e in sorted(by_effort) if bound(by_effort[e], alpha) >= target), None)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, recall) of found (query_id, doc_id) against the true neighbours."""
    hit = truth.select("query_id", "doc_id").join(found.select("query_id", "doc_id", F.lit(1).alias("_f")), ["query_id", "doc_id"], "left")
    return hit.groupBy("query_id").agg((F.count("_f") / F.count("*")).alias("recall"))


def quality_scores(hits: DataFrame, quality: DataFrame, queries: DataFrame, value: str = "embedding") -> DataFrame:
    """Adds ``quality_score`` of each hit, null where the quality tier lacks the document."""
    q = queries.select("query_id", F.col(value).alias("_q"))
    v = quality.select("doc_id", F.col(value).alias("_v"))
    return hits.join(v, "doc_id", "left").join(q, "query_id").withColumn("quality_score", V.dot(F.col("_v"), F.col("_q"))).drop("_v", "_q")


# -- approximate search by cells, with exact scores ---------------------------------------------

CELL_SAMPLE = 20_000


class CellIndex:
    """Vectors filed by their nearest of a few centroids; a search reads only the cells near its query.

    Centroids are fitted on at most ``CELL_SAMPLE`` rows picked by hash; every row is
    filed. Scores are exact, so only recall is approximate: it grows with ``probes``.
    """

    def __init__(self, centroids: np.ndarray, rows: DataFrame, doc_id: str, value: str):
        self.centroids, self.rows, self.doc_id, self.value = centroids, rows, doc_id, value

    @classmethod
    def build(cls, corpus: DataFrame, path: str, cells: int, doc_id: str = "doc_id", value: str = "embedding", seed: int = 42) -> CellIndex:
        n = max(1, corpus.count())
        share = F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1_000_000)) < min(1_000_000, -(-1_000_000 * CELL_SAMPLE // n))
        rows = corpus.where(F.col(value).isNotNull() & share).select(value).limit(2 * CELL_SAMPLE).collect()
        x = np.array([r[0] for r in rows], np.float32)
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
        for _ in range(8):
            near = (2 * x @ c.T - (c * c).sum(1)).argmax(1)
            sums, counts = np.zeros_like(c), np.bincount(near, minlength=len(c))
            np.add.at(sums, near, x)
            c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
        filed = corpus.where(F.col(value).isNotNull()).withColumn("cell", _nearest_cells(c, 1)(F.col(value))[0])
        filed.repartition("cell").write.partitionBy("cell").parquet(path)
        return cls(c, corpus.sparkSession.read.parquet(path), doc_id, value)

    def save(self, path: str) -> None:
        """Writes the centroids and what they were made for below ``path``, where ``rows`` were filed; written last, in one step."""
        spark = self.rows.sparkSession
        size = int(self.centroids.shape[1])
        text = json.dumps({"dimensions": size, "cells": len(self.centroids), "doc_id": self.doc_id, "value": self.value, "centroids": self.centroids.tolist()})
        if not files.write_new(spark, f"{path}/index.json", text):
            raise RuntimeError(f"an index is there already: {path}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CellIndex:
        """The index in ``path``; an error if it was not finished or its rows don't fit its header."""
        if not files.exists(spark, f"{path}/index.json"):
            raise ValueError(f"no finished index in {path}")
        head = json.loads(files.read_text(spark, f"{path}/index.json"))
        rows = spark.read.parquet(f"{path}/rows")
        if missing := {head["doc_id"], head["value"], "cell"} - set(rows.columns):
            raise ValueError(f"rows without {sorted(missing)}")
        centroids = np.array(head["centroids"], np.float32)
        if centroids.shape != (head["cells"], head["dimensions"]):
            raise ValueError("centroids don't fit the header")
        return cls(centroids, rows, head["doc_id"], head["value"])

    def search(self, queries: DataFrame, k: int, probes: int = 4, query_id: str = "query_id", query_value: str = "embedding") -> DataFrame:
        """(query_id, doc_id, score, rank) over the ``probes`` nearest cells of each query; vectors of another length are an error."""
        if bad := queries.where(F.col(query_value).isNotNull() & (F.size(query_value) != self.centroids.shape[1])).limit(1).count():
            raise ValueError(f"{bad} query vector has not {self.centroids.shape[1]} numbers")
        q = queries.select(F.col(query_id).alias("query_id"), F.col(query_value).alias("_q")).where("_q IS NOT NULL")
        q = q.withColumn("cell", F.explode(_nearest_cells(self.centroids, probes)(F.col("_q"))))
        rows = self.rows.select(F.col(self.doc_id).alias("doc_id"), F.col(self.value).alias("_v"), "cell")
        scored = rows.join(q, "cell").select("query_id", "doc_id", V.dot(F.col("_v"), F.col("_q")).alias("score"))
        return ranked_top_k(scored, k)


def _nearest_cells(centroids: np.ndarray, probes: int):
    @F.arrow_udf("array<int>")
    def run(values: pa.Array) -> pa.Array:
        x = _matrix(values)
        score = 2 * x @ centroids.T - (centroids * centroids).sum(1)
        n = min(probes, len(centroids))
        near = np.argsort(-score, axis=1)[:, :n].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(near.ravel()))

    return run
