"""Vector expressions, hash embedders and scalar quantization."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.text import fnv1a


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; null if either is null, the shorter is padded with nulls by zip_with."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if either has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    """Unit length; a vector without length stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x / n).cast("float"))).otherwise(a)


def truncate(a: Column, size: int) -> Column:
    """The first ``size`` numbers, normalised again."""
    return l2_normalize(F.slice(a, 1, size))


# -- hash embedders ------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W_]+")


def _tokens(text: str) -> list[str]:
    return [t for t in _TOKEN.findall(text) if len(t.encode()) >= 2]


def hash_vector(text: str, size: int = 64) -> list[float]:
    """Signed feature hashing: FNV-1a of each token picks bucket and sign; unit length."""
    v = np.zeros(size)
    for t in _tokens(text):
        h = fnv1a(t.encode())
        v[h % size] += 1 if h >> 63 else -1
    n = np.linalg.norm(v)
    return (v / n if n > 0 else v).astype(np.float32).tolist()


_MASK = 0xFFFFFFFFFFFFFFFF


def projected_vector(text: str, size: int = 64, seed: int = 42) -> list[float]:
    """A random +-1 vector per token from an xorshift stream, summed; unit length."""
    v = np.zeros(size)
    for t in _tokens(text):
        state = (seed ^ fnv1a(t.encode())) & _MASK | 1
        for d in range(size):
            state ^= state << 13 & _MASK
            state ^= state >> 7
            state ^= state << 17 & _MASK
            v[d] += 1 if state & 1 else -1
    n = np.linalg.norm(v)
    return (v / n if n > 0 else v).astype(np.float32).tolist()


def hash_embedding(text: Column, size: int = 64, projected: bool = False) -> Column:
    """Embedding of a text column without a model; its provenance is ``hash_control``, never semantic."""
    one = projected_vector if projected else hash_vector

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else one(t, size) for t in texts.to_pylist()], pa.list_(pa.float32()))

    return run(text)


def model_embedding(text: Column, load, size: int) -> Column:
    """A pluggable embedder: ``load()`` gives, once per worker, a function from texts to a matrix."""
    held: list = []

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(load())
        values = texts.to_pylist()
        some = [i for i, t in enumerate(values) if t is not None]
        found = np.asarray(held[0]([values[i] for i in some]), np.float32).reshape(-1, size) if some else []
        out: list = [None] * len(values)
        for i, v in zip(some, found):
            out[i] = v.tolist()
        return pa.array(out, pa.list_(pa.float32()))

    return run(text)


# -- scalar quantization ----------------------------------------------------------------


def fit_quantizer(vectors: DataFrame, value: str = "embedding", levels: int = 255) -> DataFrame:
    """One row (low array<double>, scale array<double>): range of each dimension in ``levels`` steps."""
    by = vectors.select(F.posexplode(value).alias("dim", "x")).where("x IS NOT NULL AND NOT isnan(x)").groupBy("dim").agg(F.min("x").cast("double").alias("low"), F.max("x").cast("double").alias("high"))
    step = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / levels).otherwise(F.lit(1.0))
    packed = by.agg(F.sort_array(F.collect_list(F.struct("dim", "low", step.alias("scale")))).alias("d"))
    return packed.select(F.transform("d", lambda x: x["low"]).alias("low"), F.transform("d", lambda x: x["scale"]).alias("scale"))


def quantize(v: Column, low: Column, scale: Column, levels: int = 255) -> Column:
    """Integer codes 0..levels of a vector."""
    parts = F.arrays_zip(v.alias("x"), low.alias("l"), scale.alias("s"))
    return F.transform(parts, lambda p: F.least(F.greatest(F.round((p["x"] - p["l"]) / p["s"]), F.lit(0.0)), F.lit(float(levels))).cast("smallint"))


def dequantize(codes: Column, low: Column, scale: Column) -> Column:
    return F.transform(F.arrays_zip(codes.alias("c"), low.alias("l"), scale.alias("s")), lambda p: p["l"] + p["c"] * p["s"])


def max_error(scale: Column) -> Column:
    """Greatest error of each dimension: half a step."""
    return F.transform(scale, lambda s: s / 2)
