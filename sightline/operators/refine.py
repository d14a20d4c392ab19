"""Refinement of result lists: reranking, diversification, feedback expansion, smoothing, graph rank, priors.

Result lists are (query_id, doc_id, score, rank from 0); their length is a page or a
candidate pool, so sequential steps run per query, while everything that touches the
corpus or the graph stays a join or an aggregation.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import vectors as V
from sightline.operators.fusion import EPSILON, finite, with_spread
from sightline.operators.ranking import numbered
from sightline.session import cut

RERANK_MOST, RERANK_LEAST = 100, 5
HUBNESS_SAMPLE = 20_000


# -- reranking ---------------------------------------------------------------------


def rerank(hits: DataFrame, texts: DataFrame, queries: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], combine: str = "reorder", most: int = RERANK_MOST, least: int = RERANK_LEAST, k: float = 60.0) -> DataFrame:
    """Scores the first ``most`` hits of each query by ``scorer`` (queries, texts) and orders them anew.

    Queries with fewer than ``least`` hits, and any failure of the scorer, leave the
    order as it was. ``combine``: ``reorder``, or ``rrf`` of the old and new places.
    """
    inputs = hits.where(F.col("rank") < most).join(texts.select("doc_id", "text"), "doc_id", "left").join(queries.select("query_id", "query"), "query_id", "left")

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[["query_id", "doc_id"]].copy()
        try:
            out["rerank_score"] = np.asarray(scorer(pdf["query"].fillna("").tolist(), pdf["text"].fillna("").tolist()), float)
        except Exception:  # noqa: BLE001 - a failing model must not lose the results
            out["rerank_score"] = np.nan
        if len(pdf) < least or not np.isfinite(out["rerank_score"]).all():
            out["rerank_score"] = np.nan
        return out

    kinds = {f.name: f.dataType.simpleString() for f in hits.schema}
    scored = inputs.groupBy("query_id").applyInPandas(score, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, rerank_score double")
    both = hits.join(scored, ["query_id", "doc_id"], "left").withColumn("rerank_score", F.nanvl("rerank_score", F.lit(None).cast("double")))
    place = F.row_number().over(Window.partitionBy("query_id", F.col("rerank_score").isNotNull()).orderBy(F.desc("rerank_score"), "rank")) - 1
    both = both.withColumn("_new", F.when(F.col("rerank_score").isNotNull(), place).otherwise(F.col("rank")))
    order = F.asc("_new")
    if combine == "rrf":
        both = both.withColumn("_new", -(1 / (k + F.col("rank") + 1) + 1 / (k + F.col("_new") + 1)))
    final = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rerank_score").isNull(), order, "rank")) - 1
    return both.withColumn("new_rank", final).drop("_new")


def overlap_scorer(queries: list[str], texts: list[str]) -> list[float]:
    """A stand-in for a cross-encoder: share of the query's words in the text."""
    out = []
    for q, t in zip(queries, texts):
        words = set(q.lower().split())
        out.append(len(words & set(t.lower().split())) / max(1, len(words)))
    return out


# -- diversification --------------------------------------------------------------------


def mmr_order(relevance: np.ndarray, x: np.ndarray, k: int, trade: float) -> list[int]:
    """Greedy maximal marginal relevance; the first index wins ties. Flat relevance counts 1."""
    low, high = relevance.min(), relevance.max()
    rel = (relevance - low) / (high - low) if high - low > EPSILON else np.ones(len(relevance))
    lengths = np.linalg.norm(x, axis=1)
    unit = x / np.where(lengths > 0, lengths, 1)[:, None]
    left, picked, near = list(range(len(rel))), [], np.zeros(len(rel))
    while left and len(picked) < k:
        value = [trade * rel[i] - (1 - trade) * (near[i] if picked else 0.0) for i in left]
        best = left[int(np.argmax(value))]
        picked.append(best)
        left.remove(best)
        sims = unit @ unit[best]
        near = sims if len(picked) == 1 else np.maximum(near, sims)
    return picked


def mmr(hits: DataFrame, embeddings: DataFrame, k: int = 10, trade: float = 0.7, pool: int = 30, value: str = "embedding") -> DataFrame:
    """(query_id, doc_id, score, rank): the first ``pool`` hits of each query, diversified; hits without a vector have none in common."""
    rows = hits.where(F.col("rank") < pool).join(embeddings.select("doc_id", F.col(value).alias("_v")), "doc_id", "left")
    kinds = {f.name: f.dataType.simpleString() for f in hits.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        size = max((len(v) for v in pdf["_v"] if v is not None), default=1)
        x = np.array([np.zeros(size) if v is None else np.asarray(v, float) for v in pdf["_v"]])
        picked = mmr_order(np.nan_to_num(pdf["score"].to_numpy(float)), x, k, trade)
        out = pdf.loc[picked, ["query_id", "doc_id", "score"]]
        out["rank"] = np.arange(len(out))
        return out

    return rows.groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double, rank int")


# -- feedback expansion ---------------------------------------------------------------------


def expand_by_feedback(queries: DataFrame, hits: DataFrame, embeddings: DataFrame, alpha: float = 0.8, top: int = 5, least: int = 3, value: str = "embedding") -> DataFrame:
    """(query_id, embedding): ``alpha * query + (1 - alpha) * score-weighted centroid`` of the first ``top`` hits, normalised.

    Queries with fewer than ``least`` such hits keep their vector; ``alpha`` is held to [0.5, 1].
    """
    alpha = min(max(alpha, 0.5), 1.0)
    near = hits.where(F.col("rank") < top).select("query_id", "doc_id", F.greatest(F.col("score").cast("double"), F.lit(0.0)).alias("w"))
    parts = near.join(embeddings.select("doc_id", F.posexplode(value).alias("d", "x")), "doc_id")
    sums = parts.groupBy("query_id", "d").agg(F.sum(F.col("w") * F.col("x")).alias("s"), F.sum("w").alias("w"), F.count("*").alias("n"))
    centre = sums.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("d", (F.col("s") / F.nullif("w", F.lit(0.0))).alias("x")))).alias("c"), F.max("n").alias("n"))
    q = queries.select("query_id", F.col(value).alias("_q")).join(centre, "query_id", "left")
    mixed = F.zip_with("_q", F.transform("c", lambda e: e["x"]), lambda a, b: (alpha * a + (1 - alpha) * b).cast("float"))
    usable = (F.col("n") >= least) & F.forall(F.col("c"), lambda e: e["x"].isNotNull())
    return q.select("query_id", F.when(F.coalesce(usable, F.lit(False)), V.l2_normalize(mixed)).otherwise(F.col("_q")).alias(value))


# -- smoothing over neighbours ------------------------------------------------------------------


def smooth(hits: DataFrame, edges: DataFrame, alpha: float = 0.2, nearest: int = 10, mutual: bool = False) -> DataFrame:
    """Adds ``smoothed``: ``(1 - alpha) * score + alpha * mean`` of the pool's own similar neighbours among the ``nearest``.

    Edges are (src, dst, edge_type, ord from 0); hits without such a neighbour keep
    their score. ``mutual`` counts an edge only if its reverse is among the nearest too.
    """
    near = edges.where((F.col("edge_type") == "similar") & (F.col("ord") < nearest)).select("src", "dst").distinct()
    if mutual:
        near = near.join(near.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")
    other = hits.select("query_id", F.col("doc_id").alias("dst"), F.col("score").alias("_s"))
    found = hits.select("query_id", F.col("doc_id").alias("src")).join(near, "src").join(other, ["query_id", "dst"])
    means = found.groupBy("query_id", F.col("src").alias("doc_id")).agg(F.avg("_s").alias("_mean"))
    return hits.join(means, ["query_id", "doc_id"], "left").withColumn("smoothed", F.coalesce((1 - alpha) * F.col("score") + alpha * F.col("_mean"), F.col("score"))).drop("_mean")


def smooth_ranked(hits: DataFrame, edges: DataFrame, **more) -> DataFrame:
    """Smoothed scores with ranks to match, as fusion by rank needs."""
    out = smooth(hits, edges, **more).withColumn("score", F.col("smoothed")).drop("smoothed")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("doc_id").cast("string"))) - 1)


# -- hubness -----------------------------------------------------------------------------------


def hubness(corpus: DataFrame, sample: DataFrame, kq: int = 10, doc_id: str = "doc_id", value: str = "embedding") -> DataFrame:
    """(doc_id, r): mean of a document's ``kq`` greatest dot products with a stated sample of queries.

    The sample is broadcast in blocks of at most ``HUBNESS_SAMPLE`` queries, a pass over
    the corpus each, which carries every document's greatest scores so far; nothing is
    shuffled.
    """
    import pyarrow as pa

    named = corpus.select(F.col(doc_id).alias("doc_id"), F.col(value).alias("v")).where("v IS NOT NULL")
    kind = named.schema["doc_id"].dataType.simpleString()
    best = named.withColumn("top", F.array().cast("array<double>"))
    queries = sample.select(F.col(value).alias("v")).where("v IS NOT NULL").toLocalIterator()
    passes = 0
    while rows := list(islice(queries, HUBNESS_SAMPLE)):
        held = corpus.sparkSession.sparkContext.broadcast(np.array([r.v for r in rows], np.float64))

        def run(batches, held=held):
            q = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)
                s = np.hstack([batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1), x @ q.T])
                k = min(kq, s.shape[1])
                top = -np.partition(-s, k - 1, axis=1)[:, :k]
                tops = pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, k), pa.int32()), pa.array(top.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tops], ["doc_id", "v", "top"])

        best = (cut(best, "hubness") if passes else best).mapInArrow(run, f"doc_id {kind}, v {named.schema['v'].dataType.simpleString()}, top array<double>")
        passes += 1
    mean = F.aggregate("top", F.lit(0.0), lambda a, x: a + x) / F.size("top")
    return best.where(F.size("top") > 0).select("doc_id", mean.alias("r"))


def hubness_penalty(hits: DataFrame, hubs: DataFrame, beta: float = 0.5) -> DataFrame:
    """Scores less ``beta`` times the document's hubness; unknown documents lose nothing."""
    return hits.join(hubs, "doc_id", "left").withColumn("score", F.col("score") - beta * F.coalesce("r", F.lit(0.0))).drop("r")


# -- graph ---------------------------------------------------------------------------------------


def build_graph(edges: DataFrame) -> DataFrame:
    """(src, dst, edge_type, weight): usable edges; parallel edges of a type are summed."""
    good = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & finite(F.col("weight")) & (F.col("weight") > 0))
    return good.groupBy("src", "dst", "edge_type").agg(F.sum("weight").alias("weight"))


def personalized_pagerank(edges: DataFrame, hits: DataFrame, restart: float = 0.15, rounds: int = 20, tolerance: float = 1e-6, by: str | None = None) -> DataFrame:
    """(by, node, rank), summing to 1 for each query: seeds are its documents' greatest positive finite scores, dangling mass goes back to them.

    ``by`` names the query of a hit; without it all hits are one query's and only (node, rank) come out.
    A round is one join and one aggregation on (query, node), with map-side combine; a hub
    with very many edges is spread by its destinations. Each round is written to the
    shared folder, and the rounds stop early once little changes for any query.
    """
    graph = build_graph(edges).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    graph = cut(graph.join(graph.groupBy("src").agg(F.sum("weight").alias("_out")), "src").select("src", "dst", (F.col("weight") / F.col("_out")).alias("share")), "graph")
    sources = graph.select(F.col("src").alias("node")).distinct()
    nodes = sources.union(graph.select(F.col("dst").alias("node"))).distinct()
    query = F.col(by) if by else F.lit(0)
    seeds = hits.where(finite(F.col("score")) & (F.col("score") > 0)).groupBy(query.alias("_q"), F.col("doc_id").alias("node")).agg(F.max("score").alias("s")).join(nodes, "node", "left_semi")
    total = seeds.groupBy(F.col("_q").alias("_of")).agg(F.sum("s").alias("_total"))
    seeds = cut(seeds.join(total, F.col("_q").eqNullSafe(F.col("_of"))).select("_q", "node", (F.col("s") / F.col("_total")).alias("seed")), "seeds")
    rank = seeds.select("_q", "node", F.col("seed").alias("rank"))
    for _ in range(rounds):
        dangling = rank.join(sources, "node", "left_anti").groupBy(F.col("_q").alias("_of")).agg(F.sum("rank").alias("_d"))
        back = seeds.join(dangling, F.col("_q").eqNullSafe(F.col("_of")), "left")
        back = back.select("_q", "node", (F.col("seed") * (F.lit(restart) + (1 - restart) * F.coalesce("_d", F.lit(0.0)))).alias("m"), F.lit(0.0).alias("was"))
        moved = rank.join(graph, rank.node == graph.src).select("_q", F.col("dst").alias("node"), (F.col("rank") * F.col("share") * (1 - restart)).alias("m"), F.lit(0.0).alias("was"))
        before = rank.select("_q", "node", F.lit(0.0).alias("m"), F.col("rank").alias("was"))
        new = cut(moved.unionByName(back).unionByName(before).groupBy("_q", "node").agg(F.sum("m").alias("rank"), F.sum("was").alias("was")), "rank")
        change = new.groupBy("_q").agg(F.sum(F.abs(F.col("rank") - F.col("was"))).alias("c")).agg(F.max("c")).first()[0]
        rank = new.where("rank > 0").select("_q", "node", "rank")
        if (change or 0) < tolerance:
            break
    return rank.select(*([F.col("_q").alias(by)] if by else []), "node", "rank")


def graph_list(rank: DataFrame, query_id, limit: int) -> DataFrame:
    """Graph ranks as a third list for fusion."""
    return rank.orderBy(F.desc("rank"), F.col("node").cast("string")).limit(limit).select(F.lit(query_id).alias("query_id"), F.col("node").alias("doc_id"), F.col("rank").alias("score"))


# -- gates and priors --------------------------------------------------------------------------------


def short_circuit(kind: Column, lexical_hits: Column, k: Column) -> Column:
    """Whether the vector lane can be skipped: a query for a name or few words whose page is full already."""
    return kind.isin("identifier", "short_keyword") & (lexical_hits >= k)


def recency(age_seconds: Column, half_life_seconds: float, least: float = 0.0) -> Column:
    return F.greatest(F.exp(-F.lit(np.log(2.0)) * F.greatest(age_seconds, F.lit(0)) / half_life_seconds), F.lit(least))


def path_proximity(path: Column, reference: Column) -> Column:
    """Share of leading folders in common."""
    a, b = F.split(path, "/"), F.split(reference, "/")
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    lead = F.aggregate(same, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, x: F.struct((s["on"] & x).alias("on"), (s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n")), lambda s: s["n"])
    return lead / F.greatest(F.size(a), F.size(b), F.lit(1))


def project_affinity(project: Column, current: Column, bonus: float = 0.25) -> Column:
    return F.when(project == current, 1 + bonus).otherwise(F.lit(1.0))


def apply_priors(hits: DataFrame, multipliers: list[Column], depth: int = 100) -> DataFrame:
    """Multiplies the first ``depth`` hits' scores and ranks anew."""
    m = F.lit(1.0)
    for x in multipliers:
        m = m * F.coalesce(x, F.lit(1.0))
    out = hits.withColumn("score", F.when(F.col("rank") < depth, F.col("score") * m).otherwise(F.col("score")))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("doc_id").cast("string"))) - 1)


# Weight of a match by the kind of structure.
STRUCTURE_WEIGHTS = {"path": 0.20, "module": 0.35, "import": 0.35, "heading": 0.45, "type": 0.50, "function": 0.60, "class": 0.60}


def structure_boost(signals: Column, query_tokens: Column, cap: float = 1.0) -> Column:
    """Boost from code structure: signals array<struct<kind, name>>, lower-case query tokens; +0.2 for a part of 3 or more letters."""
    weights = F.create_map(*[F.lit(x) for pair in STRUCTURE_WEIGHTS.items() for x in pair])
    def one(s: Column) -> Column:
        name = F.lower(s["name"])
        whole = F.array_contains(query_tokens, name)
        part = F.exists(query_tokens, lambda t: (F.length(t) >= 3) & F.contains(name, t))
        return F.when(whole, F.element_at(weights, s["kind"])).when(part, F.lit(0.2)).otherwise(F.lit(0.0))

    return F.least(F.coalesce(F.aggregate(F.transform(signals, one), F.lit(0.0), lambda a, x: a + x), F.lit(0.0)), F.lit(cap))


# Weight of what a user did with a hit.
FEEDBACK_WEIGHTS = {"click": 1.0, "select": 3.0, "skip": -0.5}


def feedback_boosts(signals: DataFrame, now: float, half_life_hours: float = 168.0, rate: float = 0.1, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """(doc_id, boost): a fold over (kind, duration_secs, ts) in order; between signals a boost halves its distance to 1.

    A dwell over 30 s counts 2, a shorter one half a click. Boosts stay in [low, high].
    """
    w = F.create_map(*[F.lit(x) for pair in FEEDBACK_WEIGHTS.items() for x in pair])
    weight = F.when(F.col("kind") == "dwell", F.when(F.col("duration_secs") > 30, 2.0).otherwise(0.5)).otherwise(F.coalesce(F.element_at(w, F.col("kind")), F.lit(0.0)))
    lists = signals.where("doc_id IS NOT NULL AND ts IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ts").cast("double").alias("ts"), weight.alias("w")))).alias("s"))
    rest = lambda b, since: 1 + (b - 1) * F.exp(-F.lit(np.log(2.0)) * F.greatest(since, F.lit(0.0)) / (half_life_hours * 3600))
    hold = lambda b: F.least(F.greatest(b, F.lit(low)), F.lit(high))
    start = F.struct(F.lit(1.0).alias("b"), F.element_at("s", 1)["ts"].alias("t"))
    step = lambda a, x: F.struct(hold(rest(a["b"], x["ts"] - a["t"]) + rate * x["w"]).alias("b"), x["ts"].alias("t"))
    return lists.select("doc_id", F.aggregate("s", start, step, lambda a: rest(a["b"], F.lit(float(now)) - a["t"])).alias("boost"))


def apply_feedback(hits: DataFrame, boosts: DataFrame) -> DataFrame:
    out = hits.join(boosts, "doc_id", "left").withColumn("score", F.col("score") * F.coalesce("boost", F.lit(1.0))).drop("boost")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("doc_id").cast("string"))) - 1)


def explain_hits(components: DataFrame, k: float = 60.0) -> DataFrame:
    """(query_id, doc_id, final_score, components): per source its raw score, share of the pool, weight and contribution by rank."""
    value = F.when(finite(F.col("raw_score")), F.col("raw_score"))
    share = F.when(F.col("_high") - F.col("_low") > EPSILON, F.coalesce((value - F.col("_low")) / (F.col("_high") - F.col("_low")), F.lit(0.0))).otherwise(F.lit(0.5))
    spread = with_spread(components, ["query_id", "source"], value)
    place = F.col("_place_of_hit")
    rows = numbered(spread, ["query_id", "source"], [F.desc(F.coalesce(value, F.lit(float("-inf")))), F.col("doc_id").cast("string")], "_place_of_hit").select("query_id", "doc_id", "source", "raw_score", "weight", share.alias("normalized_score"), (F.col("weight") / (k + place)).alias("rrf_contribution"))
    parts = F.sort_array(F.collect_list(F.struct("source", "raw_score", "normalized_score", "weight", "rrf_contribution")))
    return rows.groupBy("query_id", "doc_id").agg(F.sum("rrf_contribution").alias("final_score"), parts.alias("components"))
