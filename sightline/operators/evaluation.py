"""Retrieval measures, bootstrap, calibration, conformal and off-policy estimates, robust statistics.

Runs are (query_id, doc_id, rank from 0), judgements (query_id, doc_id). Duplicate
documents of a run count once, at their first place.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.ranking import page


def _judged(run: DataFrame, relevant: DataFrame, k: int | None) -> DataFrame:
    """(query_id, rank, rel, relevant count) of each query with judgements; queries without hits keep one empty row."""
    first = run.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    rel = relevant.select("query_id", "doc_id").distinct()
    # one pass: mark both sides, then pair them by key
    both = first.join(rel.withColumn("_rel", F.lit(1)), ["query_id", "doc_id"], "left")
    totals = rel.groupBy("query_id").agg(F.count("*").alias("relevant"))
    rows = totals.join(both.where(F.col("rank") < k) if k is not None else both, "query_id", "left")
    return rows.select("query_id", "relevant", "rank", F.coalesce("_rel", F.lit(0)).alias("rel"))


def ndcg(run: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg): binary gain, discount log2(rank + 2), ideal over min(k, relevant)."""
    rows = _judged(run, relevant, k)
    gained = rows.groupBy("query_id", "relevant").agg(F.sum(F.when(F.col("rel") == 1, 1 / F.log2(F.col("rank") + 2)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("relevant")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return gained.select("query_id", (F.col("dcg") / ideal).alias("ndcg"))


def average_precision(run: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ap): precision at each relevant hit, over min(k, relevant)."""
    rows = _judged(run, relevant, k)
    seen = F.sum("rel").over(Window.partitionBy("query_id").orderBy("rank"))
    precision = F.when(F.col("rel") == 1, F.col("_seen") / (F.col("rank") + 1)).otherwise(0.0)
    return rows.withColumn("_seen", seen).groupBy("query_id", "relevant").agg(F.sum(precision).alias("s")).select("query_id", (F.col("s") / F.least(F.lit(k), F.col("relevant"))).alias("ap"))


def reciprocal_rank(run: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, rr): one over the place of the first relevant hit, 0 without."""
    return _judged(run, relevant, None).groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("rel") == 1, 1 / (F.col("rank") + 1))), F.lit(0.0)).alias("rr"))


def recall_at(run: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    return _judged(run, relevant, k).groupBy("query_id", "relevant").agg(F.sum("rel").alias("hits")).select("query_id", (F.col("hits") / F.col("relevant")).alias("recall"))


def measures(run: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg, ap, rr, recall), all from one pass."""
    rows = _judged(run, relevant, None)
    hit, within = F.col("rel") == 1, F.col("rank") < k
    rows = rows.withColumn("_seen", F.sum("rel").over(Window.partitionBy("query_id").orderBy("rank")))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("relevant")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    sums = rows.groupBy("query_id", "relevant").agg(
        F.sum(F.when(hit & within, 1 / F.log2(F.col("rank") + 2)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(hit & within, F.col("_seen") / (F.col("rank") + 1)).otherwise(0.0)).alias("gained"),
        F.coalesce(F.max(F.when(hit, 1 / (F.col("rank") + 1))), F.lit(0.0)).alias("rr"),
        F.count_if(hit & within).alias("hits"),
    )
    return sums.select("query_id", (F.col("dcg") / ideal).alias("ndcg"), (F.col("gained") / F.least(F.lit(k), F.col("relevant"))).alias("ap"), "rr", (F.col("hits") / F.col("relevant")).alias("recall"))


# -- bootstrap: over per-query values, which a driver-sized sample always is ----------------------------------


def _resampled_means(values: np.ndarray, count: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.array([values[rng.integers(0, len(values), len(values))].mean() for _ in range(count)])


def bootstrap_ci(values: Sequence[float], confidence: float = 0.95, count: int = 1000, seed: int = 42) -> dict | None:
    """Percentile interval of the mean, with linear interpolation; None without values."""
    x = np.asarray(values, float)
    if not len(x):
        return None
    means = _resampled_means(x, count, seed)
    tail = (1 - confidence) / 2
    low, high = np.quantile(means, [tail, 1 - tail])
    return {"mean": float(x.mean()), "low": float(low), "high": float(high), "standard_error": float(means.std(ddof=1)) if count > 1 else 0.0}


def bootstrap_compare(a: Sequence[float], b: Sequence[float], confidence: float = 0.95, count: int = 1000, seed: int = 42) -> dict:
    """Paired difference a - b: interval, and p by shifting to no difference, with one added."""
    if len(a) != len(b) or not len(a):
        raise ValueError("two runs over the same queries are needed")
    d = np.asarray(a, float) - np.asarray(b, float)
    ci = bootstrap_ci(d, confidence, count, seed)
    shifted = _resampled_means(d - d.mean(), count, seed)
    p = (1 + int((np.abs(shifted) >= abs(d.mean())).sum())) / (count + 1)
    return {**ci, "p": p, "significant": p < 1 - confidence}


def bootstrap_distributed(values: DataFrame, value: str, count: int, seed: int = 42) -> DataFrame:
    """(resample, mean) for samples too large for one machine: Poisson weights, so rows never meet."""
    named = values.select(F.col(value).alias("v"), F.monotonically_increasing_id().alias("id"))
    spread = named.select("v", "id", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("resample"))
    u = (F.pmod(F.xxhash64("v", "resample", "id", F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    # inverse of the Poisson(1) distribution
    weight, total = F.lit(0), 0.0
    for n in range(8):
        total += math.exp(-1) / math.factorial(n)
        weight = weight + F.when(u > total, 1).otherwise(0)
    return spread.withColumn("w", weight).groupBy("resample").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("mean"))


def comparison_report(a: dict[str, Sequence[float]], b: dict[str, Sequence[float]], **more) -> str:
    """A line of tab-separated values a metric."""
    lines = ["metric\tmean_diff\tlow\thigh\tp\tsignificant"]
    for m in sorted(a):
        r = bootstrap_compare(a[m], b[m], **more)
        lines.append(f"{m}\t{r['mean']:.6f}\t{r['low']:.6f}\t{r['high']:.6f}\t{r['p']:.4f}\t{str(r['significant']).lower()}")
    return "\n".join(lines)


#: Sizes of the quantile sketch and, as a power of two, of the distinct-count sketch.
KLL_K, HLL_LG = 800, 14


# -- spread and outliers ---------------------------------------------------------------------


def coefficient_of_variation(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., cv): population deviation over the mean's size, null at mean 0."""
    return rows.groupBy(*by).agg((F.stddev_pop(value) / F.nullif(F.abs(F.avg(value)), F.lit(0.0))).alias("cv"))


def iqr_fences(rows: DataFrame, value: str, by: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    """(by..., low, high, n): fences k interquartile ranges outside the quartiles; null for fewer than 4 values."""
    q = rows.groupBy(*by).agg(F.percentile(value, [0.25, 0.75]).alias("q"), F.count(value).alias("n"))
    q1, q3 = F.col("q")[0], F.col("q")[1]
    enough = F.col("n") >= 4
    return q.select(*by, F.when(enough, q1 - k * (q3 - q1)).alias("low"), F.when(enough, q3 + k * (q3 - q1)).alias("high"), "n")


def outliers(rows: DataFrame, value: str, by: Sequence[str], k: float = 1.5) -> DataFrame:
    """Rows outside their group's fences."""
    return rows.join(iqr_fences(rows, value, by, k).drop("n"), list(by)).where((F.col(value) < F.col("low")) | (F.col(value) > F.col("high"))).drop("low", "high")


def trimmed(rows: DataFrame, value: str, by: Sequence[str], k: float = 1.5) -> DataFrame:
    """Rows within their group's fences; groups of fewer than 4 stay whole."""
    return rows.join(iqr_fences(rows, value, by, k).drop("n"), list(by)).where(F.col("low").isNull() | F.col(value).between(F.col("low"), F.col("high"))).drop("low", "high")


def run_stability(rows: DataFrame, value: str, by: Sequence[str], least: int = 5, most_cv: float = 0.1) -> DataFrame:
    """(by..., kept, cv, stable): after trimming, enough values and a small enough variation."""
    t = trimmed(rows, value, by).groupBy(*by).agg(F.count(value).alias("kept"), (F.stddev_pop(value) / F.nullif(F.abs(F.avg(value)), F.lit(0.0))).alias("cv"))
    return t.withColumn("stable", (F.col("kept") >= least) & F.coalesce(F.col("cv") <= most_cv, F.lit(False)))


def robust_metrics(rows: DataFrame, label: str, value: str) -> DataFrame:
    """(label, n, median, mad, p50.., distinct): one aggregation with mergeable sketches, one for the MAD."""
    good = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    p = F.percentile_approx(value, [0.5, 0.9, 0.95, 0.99, 0.999], 10_000)
    first = good.groupBy(label).agg(F.count("*").alias("n"), p.alias("p"), F.min(value).alias("least"), F.max(value).alias("most"), F.approx_count_distinct(value, 0.0081).alias("distinct"))
    off = good.join(first.select(label, F.col("p")[0].alias("_m")), label).groupBy(label).agg((F.percentile_approx(F.abs(F.col(value) - F.col("_m")), 0.5, 10_000) * 1.4826).alias("mad"))
    names = ["p50", "p90", "p95", "p99", "p999"]
    return first.join(off, label).select(label, "n", "least", "most", "distinct", "mad", *[F.col("p")[i].alias(c) for i, c in enumerate(names)])


def metric_state(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., n, total, least, most, quantiles, distinct): states of a column that can be stored and merged.

    ``quantiles`` is a KLL sketch, ``distinct`` a HyperLogLog sketch. Nulls and NaN don't count.
    """
    good = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withColumn("_v", F.col(value).cast("double"))
    return good.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("_v").alias("total"), F.min("_v").alias("least"), F.max("_v").alias("most"), F.kll_sketch_agg_double("_v", F.lit(KLL_K)).alias("quantiles"), F.hll_sketch_agg(F.xxhash64("_v"), F.lit(HLL_LG)).alias("distinct")
    )


def merged_state(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """The states over ``by``, from those of parts, days or finer groups."""
    return states.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("quantiles", F.lit(KLL_K)).alias("quantiles"), F.hll_union_agg("distinct").alias("distinct")
    )


def state_metrics(states: DataFrame, by: Sequence[str], at: dict[str, float]) -> DataFrame:
    """(by..., n, mean, least, most, distinct, one column for each of ``at``): what states say, within a rank error of about 0.4 %."""
    picked = [F.kll_sketch_get_quantile_double("quantiles", F.lit(q)).alias(name) for name, q in at.items()]
    return states.select(*by, "n", (F.col("total") / F.col("n")).alias("mean"), "least", "most", F.hll_sketch_estimate("distinct").alias("distinct"), *picked)


def median_mad(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., median, mad_raw, mad): exact, in two passes."""
    good = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    m = good.groupBy(*by).agg(F.median(value).alias("median"))
    off = good.join(m, list(by)).groupBy(*by).agg(F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad_raw"))
    return off.withColumn("mad", F.col("mad_raw") * 1.4826)


def huber_mean(rows: DataFrame, by: Sequence[str], seq: str, value: str, k: float = 1.345, step: float = 0.01) -> DataFrame:
    """(by..., huber): a streaming estimate in order of ``seq``; the first value starts it. Order matters, so it cannot be merged."""
    seqs = F.transform(F.array_sort(F.collect_list(F.struct(seq, value))), lambda s: s[value].cast("double"))
    lists = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(seqs.alias("v"))
    clip = lambda r: F.least(F.greatest(r, F.lit(-k)), F.lit(k))
    return lists.select(*by, F.aggregate(F.slice("v", F.lit(2), F.size("v")), F.element_at("v", 1), lambda e, x: e + step * clip(x - e)).alias("huber"))


# -- calibration -----------------------------------------------------------------------------


def temperature(score: Column, t: float) -> Column:
    return F.when(_finite(score), 1 / (1 + F.exp(-score / t))).otherwise(F.lit(0.0))


def platt(score: Column, a: float, b: float) -> Column:
    return F.when(_finite(score), 1 / (1 + F.exp(-(a * score + b)))).otherwise(F.lit(0.0))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def fit_isotonic(pairs: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """Steps (from score, value) by pooling neighbours that violate the order; over a bounded set of scores."""
    blocks: list[list[float]] = []  # start, sum, weight
    merged: dict[float, list[float]] = {}
    for s, y in pairs:
        if math.isfinite(s) and math.isfinite(y):
            e = merged.setdefault(s, [0.0, 0])
            e[0] += y
            e[1] += 1
    for s in sorted(merged):
        blocks.append([s, *merged[s]])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] > blocks[-1][1] / blocks[-1][2]:
            _, y, n = blocks.pop()
            blocks[-1][1] += y
            blocks[-1][2] += n
    return [(s, y / n) for s, y, n in blocks]


def isotonic(score: Column, steps: Sequence[tuple[float, float]]) -> Column:
    """The value of the last step at or below the score; below all steps the first, non-finite 0."""
    if not steps:
        return F.lit(0.0)
    table = F.array(*[F.struct(F.lit(float(s)).alias("s"), F.lit(float(v)).alias("v")) for s, v in steps])
    below = F.filter(table, lambda e: e["s"] <= score)
    return F.when(_finite(score), F.when(F.size(below) > 0, F.element_at(below, -1)["v"]).otherwise(F.lit(float(steps[0][1])))).otherwise(F.lit(0.0))


def calibration_summary(rows: DataFrame, raw: str, calibrated: Column, label: str, bins: int = 10) -> DataFrame:
    """Two rows (stage, ece, brier, n): of the raw score, held to [0, 1], and of the calibrated one."""
    held = F.least(F.greatest(F.col(raw).cast("double"), F.lit(0.0)), F.lit(1.0))
    staged = rows.select(F.col(label).cast("double").alias("y"), F.explode(F.array(F.struct(F.lit("before").alias("stage"), held.alias("p")), F.struct(F.lit("after").alias("stage"), calibrated.cast("double").alias("p")))).alias("s"))
    good = staged.select("y", "s.stage", "s.p").where("p IS NOT NULL AND NOT isnan(p) AND y IS NOT NULL")
    per = good.groupBy("stage", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("c"), F.avg("y").alias("a"), F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("b"))
    return per.groupBy("stage").agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"), (F.sum("b") / F.sum("n")).alias("brier"), F.sum("n").alias("n"))


def expected_calibration_error(rows: DataFrame, predicted: str, label: str, bins: int = 10) -> DataFrame:
    """One row (ece): equal-width bins, weighted distance of confidence and accuracy."""
    b = F.least(F.floor(F.col(predicted) * bins), F.lit(bins - 1))
    per = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(predicted).alias("c"), F.avg(label).alias("a"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))


def brier_score(rows: DataFrame, predicted: str, label: str) -> DataFrame:
    return rows.agg(F.avg((F.col(predicted) - F.col(label)) * (F.col(predicted) - F.col(label))).alias("brier"))


# -- conformal ----------------------------------------------------------------------------------


def conformal_required_k(ranks: DataFrame, alpha: float, by: Sequence[str] = ()) -> DataFrame:
    """(by..., required_k, n): the rank that holds the answer with probability 1 - alpha; null if the sample is too small.

    Ranks are counted first, so a group's window runs over its different ranks only.
    """
    counts = ranks.where("rank IS NOT NULL").groupBy(*by, "rank").agg(F.count("*").alias("_c"))
    up = F.sum("_c").over(Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    stepped = counts.withColumn("_up", up).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    at = F.greatest(F.ceil((F.col("_n") + 1) * (1 - F.lit(alpha)) - 1e-9), F.lit(1))
    return stepped.groupBy(*by).agg(F.min(F.when((F.col("_up") >= at) & (at <= F.col("_n")), F.col("rank"))).alias("required_k"), F.max("_n").cast("int").alias("n"))


def conformal_interval(scores: DataFrame, alpha: float, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """(by..., low, high, n): the interval that holds the next score with probability 1 - alpha, half of alpha on either side.

    Ends are order statistics: place floor((n + 1) alpha / 2) and ceil((n + 1) (1 - alpha / 2)) from 1; null where the sample is too small for that.
    """
    counts = scores.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("_s")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    stepped = counts.withColumn("_up", F.sum("_c").over(w.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    first, last = F.floor((F.col("_n") + 1) * (alpha / 2) + 1e-9), F.ceil((F.col("_n") + 1) * (1 - alpha / 2) - 1e-9)
    low, high = F.min(F.when((F.col("_up") >= first) & (first >= 1), F.col("_s"))), F.min(F.when((F.col("_up") >= last) & (last <= F.col("_n")), F.col("_s")))
    return stepped.groupBy(*by).agg(low.alias("low"), high.alias("high"), F.max("_n").alias("n"))


def conformal_p_value(ranks: DataFrame, rank: int) -> DataFrame:
    return ranks.agg(((F.count_if(F.col("rank") >= rank) + 1) / (F.count("*") + 1)).alias("p"))


def mondrian_required_k(ranks: DataFrame, alpha: float, kind: str, least: int = 20) -> DataFrame:
    """(kind, required_k): per class with enough examples, else the global one."""
    overall = conformal_required_k(ranks, alpha).first()
    per = conformal_required_k(ranks, alpha, [kind])
    return per.select(kind, F.when(F.col("n") >= least, F.col("required_k")).otherwise(F.lit(overall.required_k)).alias("required_k"))


def adaptive_alpha(errors: DataFrame, seq: str, error: str, target: float, gamma: float = 0.01, by: Sequence[str] = ()) -> DataFrame:
    """(by..., alpha) after all outcomes in order: alpha moves by gamma * (target - error), held to [0, 1]."""
    lists = errors.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(seq, error))), lambda s: s[error].cast("double")).alias("e"))
    hold = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return lists.select(*by, F.aggregate("e", F.lit(float(target)), lambda a, e: hold(a + gamma * (target - e))).alias("alpha"))


# -- off-policy -----------------------------------------------------------------------------------


def off_policy(rows: DataFrame, by: Sequence[str] = (), clip: float = 10.0, doubly_robust: bool = False, least_ess: float = 10.0) -> DataFrame:
    """(by..., estimate, ess, low, high, reliable) from reward, logging_propensity, target_propensity (and reward_prediction)."""
    w = F.least(F.col("target_propensity") / F.col("logging_propensity"), F.lit(clip))
    good = rows.where("logging_propensity > 0").withColumn("_w", w)
    value = F.col("_w") * F.col("reward")
    if doubly_robust:
        value = F.col("reward_prediction") + F.col("_w") * (F.col("reward") - F.col("reward_prediction"))
    ess = F.sum("_w") * F.sum("_w") / F.sum(F.col("_w") * F.col("_w"))
    out = good.withColumn("_v", value).groupBy(*by).agg(F.avg("_v").alias("estimate"), ess.alias("ess"), (F.stddev_samp("_v") / F.sqrt(F.count("*"))).alias("se"))
    return out.select(*by, "estimate", "ess", (F.col("estimate") - 1.96 * F.col("se")).alias("low"), (F.col("estimate") + 1.96 * F.col("se")).alias("high"), (F.col("ess") >= least_ess).alias("reliable"))


# -- choosing parameters ------------------------------------------------------------------------------

MOST_POINTS = 1_000


def sweep(scores: DataFrame, relevant: DataFrame, grid: DataFrame, k: int = 10, folds: int = 5, seed: int = 42) -> DataFrame:
    """(point, ndcg, held_out): how each point of a grid of weights does over all queries, and over the folds in which it was the best of the others.

    ``scores`` (query_id, doc_id, list, score); ``grid`` (point, list, weight), at most ``MOST_POINTS`` points. A document's
    score at a point is the weighted sum of its scores; ties fall to the least id. ``held_out`` is the mean over the queries
    of the folds a point was chosen for on the remaining ones, null for points never chosen.
    """
    points = [r.point for r in grid.select("point").distinct().limit(MOST_POINTS + 1).collect()]
    if len(points) > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} points")
    # a row a point and list: bounded by the check above
    at = scores.join(F.broadcast(grid), "list").groupBy("point", "query_id", F.col("doc_id").cast("string").alias("doc_id")).agg(F.round(F.sum(F.col("score") * F.col("weight")), 9).alias("score"))
    run = page(at, ["point", "query_id"], [F.desc("score"), F.col("doc_id")], k)
    named = run.select(F.struct("point", "query_id").alias("query_id"), "doc_id", "rank")
    judged = relevant.select("query_id", "doc_id", F.explode(F.array(*[F.lit(p) for p in points])).alias("point")).select(F.struct("point", "query_id").alias("query_id"), "doc_id")
    per = ndcg(named, judged, k).select("query_id.*", "ndcg").withColumn("fold", F.pmod(F.xxhash64("query_id", F.lit(seed)), F.lit(folds)))
    sums = per.groupBy("point", "fold").agg(F.sum("ndcg").alias("s"), F.count("*").alias("n"))
    whole = Window.partitionBy("point")
    rest = sums.withColumn("train", F.round((F.sum("s").over(whole) - F.col("s")) / F.nullif(F.sum("n").over(whole) - F.col("n"), F.lit(0)), 12))
    best = rest.groupBy("fold").agg(F.max_by(F.struct("point", "s", "n"), F.struct("train", -F.col("point"))).alias("b")).groupBy(F.col("b.point").alias("point")).agg((F.sum("b.s") / F.sum("b.n")).alias("held_out"))
    return sums.groupBy("point").agg((F.sum("s") / F.sum("n")).alias("ndcg")).join(best, "point", "left")


# -- reports ----------------------------------------------------------------------------------------


def phase_budgets(timings: DataFrame, budget: DataFrame) -> DataFrame:
    """(phase, n, over, overshoot, utilisation): timings (phase, ms) against budgets (phase, budget_ms)."""
    both = timings.join(F.broadcast(budget), "phase")  # a row a phase
    over = F.greatest(F.col("ms") - F.col("budget_ms"), F.lit(0))
    return both.groupBy("phase").agg(F.count("*").alias("n"), F.count_if(F.col("ms") > F.col("budget_ms")).alias("over"), F.sum(over).alias("overshoot"), F.avg(F.col("ms") / F.col("budget_ms")).alias("utilisation"))


def opportunities(rows: DataFrame) -> DataFrame:
    """Adds ``ice`` = impact * confidence * ease per mille, best first."""
    return rows.withColumn("ice", F.col("impact") * F.col("confidence") * F.col("ease") / 1000).orderBy(F.desc("ice"), "name")


def quality_gate(metrics: DataFrame, limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """(metric, value, passed) against least and greatest allowed values."""
    ok = F.lit(True)
    for name, (low, high) in limits.items():
        here = F.col("metric") == name
        if low is not None:
            ok = ok & ~(here & (F.col("value") < low))
        if high is not None:
            ok = ok & ~(here & (F.col("value") > high))
    return metrics.withColumn("passed", ok & F.col("value").isNotNull())
