"""Fusion of ranked lists and scores, for any number of queries at once.

A list is a DataFrame (query_id, doc_id, score); its order is that of the scores
unless it has a ``rank`` column (from 0). Within a list the first occurrence of a
document counts. All fusions are one union and one aggregation on (query, document),
so they combine on the map side and need no join per list.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.text import fnv1a_64
from sightline.operators.ranking import page

K = 60.0
EPSILON = 1e-12
NEGATIVE = float("-inf")


def _key(score: Column) -> Column:
    """Scores for ordering: NaN and null come last."""
    return F.coalesce(F.nanvl(score.cast("double"), F.lit(NEGATIVE)), F.lit(NEGATIVE))


def finite(x: Column) -> Column:
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def ranked(hits: DataFrame, by: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """(query, doc as string, score, rank): each document once, at its first place, ranks from 0 without gaps kept as given."""
    d = F.col(doc).cast("string")
    if "rank" not in hits.columns:
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(_key(F.col("score"))), d)) - 1)
    first = hits.groupBy(F.col(by), d.alias(doc)).agg(F.min_by("score", "rank").alias("score"), F.min("rank").cast("int").alias("rank"))
    return first


def sane_weight(w: float) -> float:
    return w if math.isfinite(w) and w > 0 else 1.0


def sane_k(k: float) -> float:
    return k if math.isfinite(k) and k >= 0 else K


def rrf(
    lists: Mapping[str, DataFrame],
    limit: int | None = None,
    offset: int = 0,
    k: float = K,
    weights: Mapping[str, float] | None = None,
    by: str = "query_id",
    doc: str = "doc_id",
    hash_ties: bool = False,
) -> DataFrame:
    """Reciprocal-rank fusion: sum of ``weight / (k + rank + 1)``.

    Order: fused score, documents in several lists first, lexical score, document id
    (or its FNV hash). Per list the rank and score come out as ``<name>_rank`` and
    ``<name>_score``. A list with weight 0 or less under the name ``graph`` is left out.
    """
    weights = dict(weights or {})
    k = sane_k(k)
    union = None
    for name, hits in lists.items():
        w = weights.get(name, 1.0)
        if name == "graph" and not w > 0:
            continue
        one = ranked(hits, by, doc).select(by, doc, F.lit(name).alias("list"), "rank", F.col("score").cast("double").alias("score"), F.lit(sane_weight(w)).alias("w"))
        union = one if union is None else union.unionByName(one)
    cells = []
    for name in lists:
        at = F.col("list") == name
        cells += [F.max(F.when(at, F.col("rank"))).alias(f"{name}_rank"), F.max(F.when(at, F.col("score"))).alias(f"{name}_score")]
    fused = union.groupBy(by, doc).agg(F.sum(F.col("w") / (k + F.col("rank") + 1)).alias("score"), (F.count("*") > 1).alias("in_both"), *cells)
    tie = F.coalesce("lexical_score", F.lit(NEGATIVE)) if "lexical" in lists else F.lit(0.0)
    last = [F.shiftrightunsigned(fnv1a_64(F.col(doc)), 32), fnv1a_64(F.col(doc)).bitwiseAND(F.lit(0xFFFFFFFF))] if hash_ties else []
    return page(fused, [by], [F.desc("score"), F.desc("in_both"), F.desc(_key(tie)), *last, F.col(doc)], limit, offset)


def with_spread(rows: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """``rows`` with _low, _high, _mean and _dev of ``value`` in their group, null keys a group too.

    One aggregation that combines on the map side and one join with a row a group; adaptive execution splits the rows
    of a hot group in that join, which it cannot do with a window over the group.
    """
    spread = rows.groupBy(*[F.col(b).alias(f"_by{n}") for n, b in enumerate(by)]).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_dev"))
    same = [F.col(b).eqNullSafe(F.col(f"_by{n}")) for n, b in enumerate(by)]
    return rows.join(spread, same).drop(*[f"_by{n}" for n in range(len(by))])


def pool_minmax(lists: Mapping[str, DataFrame], limit: int | None = None, offset: int = 0, weights: Mapping[str, float] | None = None, by: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Weighted sum of scores brought to [0, 1] within each list's pool; missing and flat pools count 0."""
    union = None
    for name, hits in lists.items():
        value = F.when(finite(F.col("score")), F.col("score").cast("double"))
        one = with_spread(ranked(hits, by, doc), [by], value)
        low, high = F.col("_low"), F.col("_high")
        scaled = F.when(high - low > EPSILON, F.coalesce((value - low) / (high - low), F.lit(0.0))).otherwise(F.lit(0.0))
        part = one.select(by, doc, F.lit(name).alias("list"), F.col("score").cast("double").alias("raw"), (scaled * sane_weight((weights or {}).get(name, 1.0))).alias("part"))
        union = part if union is None else union.unionByName(part)
    lexical = F.max(F.when(F.col("list") == "lexical", F.col("raw")))
    fused = union.groupBy(by, doc).agg(F.sum("part").alias("score"), (F.count("*") > 1).alias("in_both"), lexical.alias("_lexical"))
    return page(fused, [by], [F.desc("score"), F.desc("in_both"), F.desc(_key(F.col("_lexical"))), F.col(doc)], limit, offset).drop("_lexical")


def fuse(strategy: str, lists: Mapping[str, DataFrame], **more) -> DataFrame:
    """``pool_minmax`` where asked for and no graph list takes part, else RRF."""
    return pool_minmax(lists, **more) if strategy == "pool_minmax" and "graph" not in lists else rrf(lists, **more)


def candidate_count(limit: int, offset: int, multiplier: int) -> int:
    return min((limit + offset) * multiplier, 2**63 - 1)


def with_priors(fused: DataFrame, priors: DataFrame, cap: float = 0.05, by: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Adds each document's prior (doc, boost), held to ``cap`` either way, and ranks anew."""
    boost = F.least(F.greatest(F.coalesce("boost", F.lit(0.0)), F.lit(-cap)), F.lit(cap))
    out = fused.drop("rank").join(priors.select(F.col(doc).cast("string").alias(doc), "boost"), doc, "left")
    out = out.withColumn("score", F.col("score") + boost).drop("boost")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), doc)) - 1)


def source_label(lexical_rank: Column, semantic_rank: Column, hash_rank: Column | None = None) -> Column:
    """Where a fused hit came from."""
    hashed = hash_rank.isNotNull() if hash_rank is not None else F.lit(False)
    return F.when(lexical_rank.isNotNull() & (semantic_rank.isNotNull() | hashed), "hybrid").when(lexical_rank.isNotNull(), "lexical").when(semantic_rank.isNotNull(), "semantic_fast").when(hashed, "hash_control")


# -- federation -------------------------------------------------------------------------


def federated_rrf(shards: DataFrame, k: float = K, by: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Over (query, shard, shard_weight, doc, rank): summed contributions, number of shards, and the shard that gave most."""
    part = F.col("shard_weight") / (sane_k(k) + F.col("rank") + 1)
    rows = shards.select(by, F.col(doc).cast("string").alias(doc), "shard", "rank", part.alias("part"))
    fused = rows.groupBy(by, doc).agg(F.sum("part").alias("score"), F.count_distinct("shard").alias("shards"), F.min_by("shard", F.struct((-F.col("part")).alias("p"), F.col("rank"), F.col("shard"))).alias("primary_shard"))
    return page(fused, [by], [F.desc("score"), F.col(doc)])


def federated_weighted(shards: DataFrame, normalizer: str = "min_max", comb_mnz: bool = False, by: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Scores normalised per (query, shard), weighted and summed; CombMNZ also multiplies by the number of shards."""
    rows = normalized(shards, [by, "shard"], "score", normalizer)
    fused = rows.groupBy(by, F.col(doc).cast("string").alias(doc)).agg(F.sum(F.col("normalized") * F.col("shard_weight")).alias("score"), F.count_distinct("shard").alias("shards"))
    if comb_mnz:
        fused = fused.withColumn("score", F.col("score") * F.col("shards"))
    return page(fused, [by], [F.desc("score"), F.col(doc)])


def federated_coverage(shards: DataFrame, expected: Sequence[str], least: int = 1) -> DataFrame:
    """One row: how many of the expected shards answered, and whether that is enough."""
    answered = F.count_distinct(F.when(F.col("shard").isin(list(expected)), F.col("shard")))
    return shards.agg(answered.alias("answered"), F.lit(len(expected)).alias("expected"), (answered >= least).alias("sufficient"))


# -- normalisers: flat pools differ between them, on purpose ------------------------------------


def normalized(rows: DataFrame, by: Sequence[str], score: str = "score", method: str = "min_max") -> DataFrame:
    """Adds ``normalized``. min_max: flat pool 0.5, non-finite 0. z_score: clipped at 3 deviations and mapped to [0, 1], flat 0.5."""
    value = F.when(finite(F.col(score)), F.col(score).cast("double"))
    spread = ["_low", "_high", "_mean", "_dev"]
    rows = with_spread(rows, by, value)
    if method == "min_max":
        low, high = F.col("_low"), F.col("_high")
        out = F.when(value.isNull(), F.lit(0.0)).when(high - low > EPSILON, (value - low) / (high - low)).otherwise(F.lit(0.5))
    elif method == "z_score":
        mean, deviation = F.col("_mean"), F.col("_dev")
        z = F.least(F.greatest((value - mean) / deviation, F.lit(-3.0)), F.lit(3.0))
        out = F.when(value.isNull(), F.lit(0.0)).when(deviation > EPSILON, (z + 3) / 6).otherwise(F.lit(0.5))
    else:
        out = F.coalesce(value, F.lit(0.0))
    return rows.withColumn("normalized", out).drop(*spread)


def blend(fast: DataFrame, quality: DataFrame, alpha: float = 0.7, by: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """``alpha * quality + (1 - alpha) * fast`` of min-max scaled tiers (flat 1, non-finite 0); a one-sided document keeps its own."""
    alpha = min(max(alpha if math.isfinite(alpha) else 0.7, 0.0), 1.0)
    union = None
    for name, hits in (("fast", fast), ("quality", quality)):
        value = F.when(finite(F.col("score")), F.col("score").cast("double"))
        one = with_spread(ranked(hits, by, doc), [by], value)
        low, high = F.col("_low"), F.col("_high")
        scaled = F.when(value.isNull(), F.lit(0.0)).when(high - low > EPSILON, (value - low) / (high - low)).otherwise(F.lit(1.0))
        part = one.select(by, doc, F.lit(name).alias("tier"), scaled.alias("s"))
        union = part if union is None else union.unionByName(part)
    both = union.groupBy(by, doc).agg(F.max(F.when(F.col("tier") == "fast", F.col("s"))).alias("fast_score"), F.max(F.when(F.col("tier") == "quality", F.col("s"))).alias("quality_score"))
    score = F.coalesce(alpha * F.col("quality_score") + (1 - alpha) * F.col("fast_score"), F.col("quality_score"), F.col("fast_score"))
    return page(both.withColumn("score", score), [by], [F.desc("score"), F.col(doc)])


# -- measures over lists ------------------------------------------------------------------


def nqc(scores: DataFrame, by: str = "query_id", score: str = "score") -> DataFrame:
    """(query, cv): population deviation over mean of a query's scores, 0 if the mean is about 0."""
    good = scores.where(finite(F.col(score))).groupBy(by).agg(F.avg(score).alias("m"), F.stddev_pop(score).alias("s"))
    return good.select(by, F.when(F.abs("m") > EPSILON, F.col("s") / F.col("m")).otherwise(F.lit(0.0)).alias("cv"))


#: Queries whose commitment the adaptive weight remembers.
NQC_SAMPLE = 2048
#: Queries it must have seen before it weighs anything.
NQC_WARM_UP = 64


def dense_weights(commitment: DataFrame, sample: DataFrame, order: str, beta: float = 0.5, least: float = 0.3, by: str = "query_id", warm_up: int = NQC_WARM_UP) -> DataFrame:
    """(query, weight): ``1 - beta * CDF(cv)`` against the last ``NQC_SAMPLE`` finite cvs of ``sample`` by ``order``, held to [least, 1].

    Below ``warm_up`` cvs, and for ``beta`` of 0 or less, every weight is 1. Ties of ``order`` fall to the greater cv.
    """
    last = sample.where(finite(F.col("cv"))).orderBy(F.desc(order), F.desc("cv")).limit(NQC_SAMPLE).select("cv")
    seen = sorted(r.cv for r in last.collect())
    if len(seen) < max(1, warm_up) or beta <= 0:
        return commitment.select(by, F.lit(1.0).alias("weight"))
    below = F.size(F.filter(F.array(*[F.lit(x) for x in seen]), lambda x: x <= F.col("cv")))
    weight = F.least(F.greatest(1 - beta * below / len(seen), F.lit(least)), F.lit(1.0))
    return commitment.select(by, weight.alias("weight"))


def rank_changes(before: DataFrame, after: DataFrame, by: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """(query, promoted, demoted, stable): new documents are promoted, missing ones demoted."""
    a = ranked(before, by, doc).select(by, doc, F.col("rank").alias("was"))
    b = ranked(after, by, doc).select(by, doc, F.col("rank").alias("now"))
    both = a.join(b, [by, doc], "full_outer")
    up = F.col("was").isNull() | (F.col("now") < F.col("was"))
    down = F.col("now").isNull() | (F.col("now") > F.col("was"))
    return both.groupBy(by).agg(F.count_if(up).alias("promoted"), F.count_if(down).alias("demoted"), F.count_if(F.col("was") == F.col("now")).alias("stable"))


def kendall_tau(before: DataFrame, after: DataFrame, by: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """(query, tau) over the documents of both lists (result pages, so few); null for less than two."""
    a = ranked(before, by, doc).select(by, doc, F.col("rank").alias("was"))
    both = a.join(ranked(after, by, doc).select(by, doc, F.col("rank").alias("now")), [by, doc])
    lists = both.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("was", "now"))), lambda s: s["now"]).alias("now"))

    def concordance(x: Column, i: Column) -> Column:
        later = F.slice(F.col("now"), i + 2, F.size("now"))
        return F.aggregate(later, F.lit(0), lambda s, y: s + F.when(y > x, 1).otherwise(-1))

    total = F.aggregate(F.transform("now", concordance), F.lit(0), lambda s, x: s + x)
    n = F.size("now")
    return lists.select(by, F.when(n >= 2, total / (n * (n - 1) / 2)).alias("tau"))
