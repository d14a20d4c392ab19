"""Queries of vector search, fusion, refinement and evaluation, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import vectors as V
from sightline.operators import adaptive as A
from sightline.operators import evaluation as E
from sightline.operators import fusion as U
from sightline.operators import refine as R
from sightline.operators import vector_search as S
from sightline.plans.lexical_queries import CLASSES as _CLASSES
from sightline.plans.lexical_queries import fnv_sql as _fnv
from sightline.session import stored_once
from sightline.sources.tables import table


def _vectors(spark, folder):
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return v, v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding", "label")


def _lists(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Each source's list of scored hits; repeated rows once, unusable scores left out."""
    c = table(spark, folder, "score_components").where(U.finite(F.col("raw_score")))
    c = c.groupBy("query_id", "doc_id", "source").agg(F.max("raw_score").alias("score"))
    return {n: c.where(F.col("source") == s).select("query_id", "doc_id", "score") for n, s in (("lexical", "lexical"), ("semantic", "semantic_fast"), ("quality", "semantic_quality"))}


def _shards(spark, folder):
    c = table(spark, folder, "score_components").where(U.finite(F.col("raw_score")))
    rows = c.groupBy("query_id", "doc_id", F.col("source").alias("shard")).agg(F.max("raw_score").alias("score"), F.max("weight").alias("shard_weight"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), F.col("doc_id").cast("string"))) - 1
    return rows.withColumn("rank", rank)


def _stored(spark, folder):
    """The store of the vectors, made once."""
    return spark.read.parquet(stored_once(spark, "vectors", folder, lambda path: S.store(_vectors(spark, folder)[0], path, 32)))


def vec_exact(spark, folder):
    """Top 10 of all vectors for every hundredth."""
    v, q = _vectors(spark, folder)
    return S.exact_top_k(v, q, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def vec_truncated(spark, folder):
    """Top 10 by a scan of the stored first 32 dimensions, rescored."""
    return S.stored_top_k(_stored(spark, folder), _vectors(spark, folder)[1], 10, "head").select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def vec_int8(spark, folder):
    """Top 10 by a scan of stored int8 codes, rescored."""
    return S.stored_top_k(_stored(spark, folder), _vectors(spark, folder)[1], 10, "int8").select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def vec_int4(spark, folder):
    """Top 10 by a scan of stored 4-bit codes, rescored."""
    return S.stored_top_k(_stored(spark, folder), _vectors(spark, folder)[1], 10, "int4").select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def vec_filtered(spark, folder):
    """Top 10 within one label, by a filter below the scan."""
    v, q = _vectors(spark, folder)
    return S.exact_top_k(v.where("label = 3"), q, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def vec_live(spark, folder):
    """Live vectors over a base, later versions of half the labels and deletions of one."""
    v, _ = _vectors(spark, folder)
    base = v.select("doc_id", "label", F.lit(1).alias("seq"))
    later = v.where("label < 4").select("doc_id", (F.col("label") + 100).alias("label"), F.lit(2).alias("seq"))
    gone = v.where("label = 2").select("doc_id", F.lit(3).alias("seq"))
    return S.live_rows(base, later, gone).select("doc_id", "label")


def vec_cells(spark, folder):
    """Whether a search of three quarters of the cells finds nine of ten true neighbours of the query vectors, on average."""
    v, q = _vectors(spark, folder)
    at = stored_once(spark, "cells", folder, lambda path: S.CellIndex.build(v, f"{path}/rows", 12).save(path))
    found = S.CellIndex.load(spark, at).search(q, 10, 9)
    r = S.recall(found, S.exact_top_k(v, q, 10))
    return r.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("reached"))


def vec_quantizer(spark, folder):
    """Range and step of each dimension."""
    v, _ = _vectors(spark, folder)
    return V.fit_quantizer(v).select(F.posexplode(F.arrays_zip("low", "scale")).alias("dim", "q")).select("dim", F.round("q.low", 6).alias("low"), F.round("q.scale", 8).alias("scale"))


def vec_scalar(spark, folder):
    """Norm, truncated norm and cosine to the unit axis of every vector."""
    v, _ = _vectors(spark, folder)
    return v.select("doc_id", F.round(V.norm(F.col("embedding")), 5).alias("norm"), F.round(V.norm(V.truncate(F.col("embedding"), 16)), 4).alias("short_norm"), F.round(V.cosine(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)), 5).alias("halves"))


def vec_hash_embedding(spark, folder):
    """Hash embeddings of the documents."""
    return table(spark, folder, "documents").select("doc_id", V.hash_embedding(F.col("text")).alias("embedding"))


def fuse_rrf(spark, folder):
    """Lexical and vector lists fused by reciprocal rank, ten a query."""
    lists = _lists(spark, folder)
    f = U.rrf({"lexical": lists["lexical"], "semantic": lists["semantic"]}, limit=10)
    return f.select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank", "in_both", "lexical_rank", "semantic_rank")


def fuse_weighted_rrf(spark, folder):
    """Three lists with weights, the second page."""
    lists = _lists(spark, folder)
    f = U.rrf(lists, limit=5, offset=3, weights={"lexical": 0.5, "semantic": 1.0, "quality": 2.0})
    return f.select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


def fuse_pool_minmax(spark, folder):
    """Lexical and vector lists fused by scaled scores."""
    lists = _lists(spark, folder)
    f = U.fuse("pool_minmax", {"lexical": lists["lexical"], "semantic": lists["semantic"]}, limit=10)
    return f.select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


def vec_embed_cached(spark, folder):
    """Documents with a vector and new cache entries, where the texts of notes were embedded before."""
    d = table(spark, folder, "documents")
    embed = lambda c: V.hash_embedding(c, 16)
    none = spark.createDataFrame([], "embedder_id string, content_hash string, vector array<float>")
    _, cache = S.embed_cached(d.where("doc_type = 'note'"), none, embed, "hash-16")
    all_rows, new = S.embed_cached(d, cache, embed, "hash-16")
    counted = [("documents", all_rows), ("embedded", all_rows.where("vector IS NOT NULL")), ("added", new), ("cached", cache)]
    out = None
    for name, rows in counted:
        one = rows.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def online_blend_state(spark, folder):
    """Evidence of each query class, added up from the states of every phase."""
    s = table(spark, folder, "search_events").select(F.coalesce(F.lower(F.trim("query_class")), F.lit("none")).alias("query_class"), F.coalesce(F.lower(F.trim("phase")), F.lit("")).alias("phase"), F.lit(True).alias("one"))
    s = s.withColumn("quality_won", F.col("phase") == "refined")
    state = A.blend_state(s.where("phase = 'refined'"), A.blend_state(s.where("phase <> 'refined'")))
    return A.blend_evidence(state).select("query_class", "n", "w", "a", "b", F.round("mean", 9).alias("mean"), "warm")


def eval_sweep(spark, folder):
    """How five weights of the lexical and the semantic list do, and whether what folds choose holds."""
    lists = _lists(spark, folder)
    scores = None
    for name in ("lexical", "semantic"):
        one = U.normalized(lists[name], ["query_id"]).select("query_id", "doc_id", F.lit(name).alias("list"), F.col("normalized").alias("score"))
        scores = one if scores is None else scores.unionByName(one)
    grid = spark.createDataFrame([(n, name, w) for n in range(5) for name, w in (("lexical", n / 4), ("semantic", 1 - n / 4))], "point int, list string, weight double")
    r = E.sweep(scores, _run(spark, folder)[1].distinct(), grid)
    return r.select("point", F.round("ndcg", 6).alias("ndcg"), F.coalesce(F.col("held_out").between(0, 1), F.lit(True)).alias("sound"))


def fuse_hash_ties(spark, folder):
    """Lists of equal scores fused by reciprocal rank, ties by the hash of the document."""
    lists = _lists(spark, folder)
    flat = {n: lists[n].withColumn("score", F.lit(1.0)).withColumn("rank", F.lit(0)) for n in ("semantic", "quality")}
    return U.rrf(flat, limit=4, hash_ties=True).select("query_id", "doc_id", "rank")


def fuse_labels(spark, folder):
    """Where each fused hit came from, with priors of the explanations' order."""
    lists = _lists(spark, folder)
    f = U.rrf({"lexical": lists["lexical"], "semantic": lists["semantic"]})
    priors = table(spark, folder, "hit_explanations").groupBy("doc_id").agg((F.max("rank_after") / 100).alias("boost"))
    w = U.with_priors(f, priors, 0.08)
    return w.select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank", U.source_label(F.col("lexical_rank"), F.col("semantic_rank")).alias("label"))


def fuse_coverage(spark, folder):
    """How many of the expected shards answered."""
    return U.federated_coverage(_shards(spark, folder), ["lexical", "semantic_fast", "reranked", "archive"], 3)


def fuse_dense_weights(spark, folder):
    """Weight of the dense list of each query, against the spread of lexical scores seen."""
    cv = U.nqc(_lists(spark, folder)["lexical"]).withColumn("cv", F.round("cv", 9))
    return U.dense_weights(cv, cv, "query_id", 0.5, 0.6, warm_up=20).select("query_id", F.round("weight", 9).alias("weight"))


def fuse_blend(spark, folder):
    """Fast and quality tiers blended."""
    lists = _lists(spark, folder)
    b = U.blend(lists["semantic"], lists["quality"], 0.7)
    return b.select("query_id", "doc_id", F.round("score", 9).alias("score"))


def fuse_federated_rrf(spark, folder):
    """Sources as shards, fused by weighted reciprocal rank."""
    f = U.federated_rrf(_shards(spark, folder))
    return f.select("query_id", "doc_id", F.round("score", 9).alias("score"), "shards", "primary_shard")


def fuse_comb_mnz(spark, folder):
    """Sources as shards, scaled, weighted, and multiplied by how many hold the document."""
    f = U.federated_weighted(_shards(spark, folder), "min_max", comb_mnz=True)
    return f.select("query_id", "doc_id", F.round("score", 9).alias("score"), "shards")


def fuse_z_scores(spark, folder):
    """Scores of each list standardised."""
    z = U.normalized(_lists(spark, folder)["lexical"], ["query_id"], "score", "z_score")
    return z.select("query_id", "doc_id", F.round("normalized", 6).alias("z"))


def fuse_commitment(spark, folder):
    """Spread of each query's lexical scores."""
    return U.nqc(_lists(spark, folder)["lexical"]).select("query_id", F.round("cv", 6).alias("cv"))


def fuse_rank_changes(spark, folder):
    """What refinement moved, and Kendall's tau."""
    lists = _lists(spark, folder)
    return U.rank_changes(lists["semantic"], lists["quality"]).join(U.kendall_tau(lists["semantic"], lists["quality"]).select("query_id", F.round("tau", 6).alias("tau")), "query_id", "left")


def _run(spark, folder):
    run = U.ranked(_lists(spark, folder)["lexical"])
    h = table(spark, folder, "hit_explanations").where("rank_after <= 3").select("query_id", F.col("doc_id").cast("string").alias("doc_id"))
    return run, h


def eval_measures(spark, folder):
    """nDCG, average precision, reciprocal rank and recall at 10 of the lexical list."""
    m = E.measures(*_run(spark, folder), 10)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("ndcg", "ap", "rr", "recall")])


def eval_calibration(spark, folder):
    """Calibration error and Brier score of an event's value as a probability."""
    e = table(spark, folder, "events").select((F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(100.0)) / 100).alias("p"), F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("y"))
    ece = E.expected_calibration_error(e, "p", "y").select(F.round("ece", 6).alias("ece"))
    brier = E.brier_score(e, "p", "y").select(F.round("brier", 6).alias("brier"))
    return ece.select(F.lit("ece").alias("measure"), F.col("ece").alias("value")).unionByName(brier.select(F.lit("brier").alias("measure"), F.col("brier").alias("value")))


def eval_outliers(spark, folder):
    """Outlying order totals by priority, and how many stay."""
    o = table(spark, folder, "lineitem").select("l_returnflag", "l_extendedprice")
    t = E.run_stability(o, "l_extendedprice", ["l_returnflag"], 5, 0.6)
    return t.select("l_returnflag", "kept", F.round("cv", 6).alias("cv"), "stable")


def eval_median_mad(spark, folder):
    """Median and MAD of latency by phase."""
    s = table(spark, folder, "search_events").where("latency_us > 0").select(F.lower(F.trim("phase")).alias("phase"), "latency_us")
    return E.median_mad(s.where("phase IS NOT NULL"), ["phase"], "latency_us").select("phase", "median", "mad_raw")


def eval_off_policy(spark, folder):
    """Inverse-propensity and doubly robust estimates by status."""
    o = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("arm"), (F.col("o_orderkey") % 2).cast("double").alias("reward"), (F.lit(0.2) + (F.col("o_custkey") % 5) / 10).alias("logging_propensity"), (F.lit(0.1) + (F.col("o_custkey") % 7) / 10).alias("target_propensity"), F.lit(0.5).alias("reward_prediction"))
    a = E.off_policy(o, ["arm"]).select("arm", F.round("estimate", 6).alias("ips"), F.round("ess", 4).alias("ess"))
    b = E.off_policy(o, ["arm"], doubly_robust=True).select("arm", F.round("estimate", 6).alias("dr"))
    return a.join(b, "arm")


def eval_conformal(spark, folder):
    """Rank that holds the answer in nine of ten cases, by phase."""
    h = table(spark, folder, "hit_explanations").where("rank_after IS NOT NULL AND phase IS NOT NULL").select("phase", F.col("rank_after").alias("rank"))
    return E.conformal_required_k(h, 0.1, ["phase"])


def refine_mmr(spark, folder):
    """Diversified vector results."""
    v, q = _vectors(spark, folder)
    return R.mmr(S.exact_top_k(v, q, 30), v, 10).select("query_id", "doc_id", "rank")


def refine_feedback_expansion(spark, folder):
    """Query vectors moved toward the centre of their best results."""
    v, q = _vectors(spark, folder)
    e = R.expand_by_feedback(q, S.exact_top_k(v, q, 5), v)
    return e.select("query_id", F.round(F.element_at("embedding", 1).cast("double"), 5).alias("first"), F.round(V.norm(F.col("embedding")), 4).alias("norm"))


def refine_smoothing(spark, folder):
    """Vector results smoothed over similar neighbours in the pool (next ids stand for edges)."""
    v, q = _vectors(spark, folder)
    hits = S.exact_top_k(v, q, 50)
    edges = v.select(F.col("doc_id").alias("src"), F.explode(F.array(*[F.struct((F.col("doc_id") + d).alias("dst"), F.lit(i).alias("ord")) for i, d in enumerate((1, 2, 5, 7))])).alias("e")).select("src", "e.dst", "e.ord", F.lit("similar").alias("edge_type"))
    return R.smooth(hits, edges, 0.2, 3).select("query_id", "doc_id", F.round("smoothed", 6).alias("smoothed"))


def refine_hubness(spark, folder):
    """How near each vector is to a sample of queries."""
    v, q = _vectors(spark, folder)
    return R.hubness(v, q, 3).select("doc_id", F.round("r", 6).alias("r"))


def refine_pagerank(spark, folder):
    """Personalised rank of parts and suppliers from the dearest lines."""
    l = table(spark, folder, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("p"), F.concat(F.lit("s"), "l_suppkey").alias("s"), "l_extendedprice")
    edges = l.select(F.col("p").alias("src"), F.col("s").alias("dst"), F.lit("ref").alias("edge_type"), F.lit(1.0).alias("weight")).union(l.select("s", "p", F.lit("ref"), F.lit(1.0)))
    seeds = l.where("l_extendedprice > 90000").groupBy(F.col("p").alias("doc_id")).agg(F.max("l_extendedprice").alias("score"))
    rank = R.personalized_pagerank(edges, seeds, rounds=12, tolerance=0.0)
    return rank.select("node", F.round("rank", 9).alias("rank"))


def _pages(spark, folder):
    h = table(spark, folder, "hit_explanations").where("query_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("query_id", "doc_id").agg(F.max(F.coalesce("final_score", F.lit(0.0))).alias("score"))
    from pyspark.sql import Window

    return h.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("doc_id").cast("string"))) - 1)


def refine_rerank(spark, folder):
    """Hits ordered anew by the words they share with the title of the query's least document."""
    hits = _pages(spark, folder)
    docs = table(spark, folder, "documents").select("doc_id", "text", "title")
    queries = hits.groupBy("query_id").agg(F.min("doc_id").alias("doc_id")).join(docs, "doc_id").select("query_id", F.col("title").alias("query"))
    r = R.rerank(hits, docs, queries, R.overlap_scorer)
    return r.select("query_id", "doc_id", "rank", F.round("rerank_score", 9).alias("rerank_score"), "new_rank")


def refine_priors(spark, folder):
    """Hits after priors of age, place and project."""
    d = table(spark, folder, "documents").select("doc_id", "source", F.unix_timestamp("created_at").alias("at"))
    hits = _pages(spark, folder).join(d, "doc_id", "left")
    m = [0.5 + 0.5 * R.recency(F.lit(1_780_000_000) - F.col("at"), 86_400.0 * 90), 1 + R.path_proximity(F.col("source"), F.lit("workspace/atlas-notes")), R.project_affinity(F.col("source"), F.lit("chat"))]
    return R.apply_priors(hits, m, 8).select("query_id", "doc_id", F.round("score", 9).alias("score"))


def refine_feedback(spark, folder):
    """Hits after boosts by document."""
    hits = _pages(spark, folder)
    boosts = table(spark, folder, "documents").select("doc_id", (1 + F.length("doc_type") / 10).alias("boost")).where("boost IS NOT NULL")
    return R.apply_feedback(hits, boosts).select("query_id", "doc_id", F.round("score", 9).alias("score"))


def refine_mutual(spark, folder):
    """Vector results smoothed over neighbours that have each other, ranked anew."""
    v, q = _vectors(spark, folder)
    hits = S.exact_top_k(v, q, 50)
    edges = v.select(F.col("doc_id").alias("src"), F.explode(F.array(*[F.struct((F.col("doc_id") + d).alias("dst"), F.lit(i).alias("ord")) for i, d in enumerate((1, -1, 3))])).alias("e")).select("src", "e.dst", "e.ord", F.lit("similar").alias("edge_type"))
    return R.smooth_ranked(hits, edges, alpha=0.3, nearest=3, mutual=True).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def refine_hub_penalty(spark, folder):
    """Vector results less the hubness of each."""
    v, q = _vectors(spark, folder)
    return R.hubness_penalty(S.exact_top_k(v, q, 20), R.hubness(v, q, 3), 0.5).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def refine_structure(spark, folder):
    """Boost of each document whose code names what its title says."""
    from sightline.functions import text as X

    d = table(spark, folder, "documents").select("doc_id", X.code_structure(F.col("text")).alias("s"), X.tokens(F.col("title")).alias("t"))
    return d.select("doc_id", F.round(R.structure_boost(F.col("s"), F.col("t")), 6).alias("boost"))


def refine_short_circuit(spark, folder):
    """Queries whose vector search can be skipped."""
    from sightline.operators.query_language import query_class_column

    e = table(spark, folder, "eval_items").select("item_id", query_class_column(F.col("query")).alias("kind"), F.length("query").alias("n"))
    return e.select("item_id", R.short_circuit(F.col("kind"), F.col("n"), F.lit(12)).alias("skip"))


def refine_explanations(spark, folder):
    """Contributions of each source to each hit."""
    c = table(spark, folder, "score_components").groupBy("query_id", "doc_id", "source").agg(F.max(F.when(U.finite(F.col("raw_score")), F.col("raw_score"))).alias("raw_score"), F.max("weight").alias("weight"))
    return R.explain_hits(c).select("query_id", "doc_id", F.round("final_score", 9).alias("final_score"), F.size("components").alias("sources"))


def online_blend(spark, folder):
    """Blend factor of each query class from won refinements."""
    s = table(spark, folder, "search_events").select(F.coalesce(F.lower(F.trim("query_class")), F.lit("none")).alias("query_class"), (F.coalesce(F.lower(F.trim("phase")), F.lit("")) == "refined").alias("quality_won"))
    return A.adaptive_blend(s).select("query_class", F.round("alpha", 9).alias("alpha"))


def online_k(spark, folder):
    """Posterior fusion constant of each label of events."""
    return A.adaptive_k(table(spark, folder, "events"), "value", ["event_type"]).select("event_type", F.round("k", 6).alias("k"))


def online_phase_gate(spark, folder):
    """Decision of each user's gate over their events."""
    e = table(spark, folder, "events").select("user_id", "event_id", (F.lit(0.5) + F.col("value") / 60).alias("f"))
    return A.phase_gate(e, ["user_id"], "event_id", "f")


def online_circuit_breaker(spark, folder):
    """State of each user's breaker after their events."""
    e = table(spark, folder, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("ok"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return A.circuit_breaker(e, ["user_id"], "event_id", "ok", "ms", failures=2)


QUERIES = {f.__name__: f for f in (
    vec_exact, vec_truncated, vec_int8, vec_int4, vec_filtered, vec_live, vec_cells, vec_embed_cached, vec_quantizer, vec_scalar, vec_hash_embedding,
    fuse_rrf, fuse_weighted_rrf, fuse_pool_minmax, fuse_hash_ties, fuse_labels, fuse_coverage, fuse_dense_weights, fuse_blend, fuse_federated_rrf, fuse_comb_mnz, fuse_z_scores, fuse_commitment, fuse_rank_changes,
    eval_measures, eval_calibration, eval_outliers, eval_median_mad, eval_off_policy, eval_conformal, eval_sweep,
    refine_mmr, refine_feedback_expansion, refine_smoothing, refine_hubness, refine_pagerank, refine_explanations,
    refine_rerank, refine_priors, refine_feedback, refine_mutual, refine_hub_penalty, refine_structure, refine_short_circuit,
    online_blend, online_blend_state, online_k, online_phase_gate, online_circuit_breaker,
)}

_V = """
    v AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS e, label FROM embeddings),
    q AS (SELECT doc_id AS query_id, e FROM v WHERE doc_id % 100 = 0)"""
_TOP = """SELECT query_id, doc_id, round(score, 6) AS score, rank FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id::VARCHAR) - 1 AS rank FROM {0}) WHERE rank < {1}"""
_ALL = "scored AS (SELECT query_id, doc_id, list_dot_product(v.e, q.e) AS score FROM v, q)"
_L = """
    c AS (SELECT query_id, doc_id::VARCHAR AS doc_id, source, max(raw_score) AS score, max(weight) AS weight FROM score_components
          WHERE raw_score IS NOT NULL AND NOT isnan(raw_score) AND NOT isinf(raw_score) GROUP BY ALL),
    l AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) - 1 AS rank,
                 min(score) OVER (PARTITION BY query_id, source) AS low, max(score) OVER (PARTITION BY query_id, source) AS high,
                 avg(score) OVER (PARTITION BY query_id, source) AS mean, stddev_pop(score) OVER (PARTITION BY query_id, source) AS dev FROM c)"""
_EXACT = f"WITH {_V}, {_ALL} {_TOP.format('scored', 10)}"

_SPACE = "'[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+'"
_PAGE = """
    g AS (SELECT query_id, doc_id, max(coalesce(final_score, 0)) AS score FROM hit_explanations WHERE query_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL),
    page AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id::VARCHAR) - 1 AS rank FROM g)"""


def _pagerank_sql(rounds: int) -> str:
    step = """r{1} AS MATERIALIZED (SELECT node, sum(m) AS r FROM (
        SELECT dst AS node, r * share * 0.85::DOUBLE AS m FROM r{0} JOIN e ON src = node
        UNION ALL SELECT node, seed * (0.15::DOUBLE + 0.85::DOUBLE * coalesce((SELECT sum(r) FROM r{0} WHERE node NOT IN (SELECT src FROM e)), 0)) FROM seeds) GROUP BY 1)"""
    return f"""
        WITH l AS (SELECT 'p' || l_partkey AS p, 's' || l_suppkey AS s, l_extendedprice AS x FROM lineitem),
        a AS (SELECT p AS src, s AS dst FROM l UNION ALL SELECT s, p FROM l), w AS (SELECT src, dst, count(*) AS n FROM a GROUP BY ALL),
        e AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM w),
        d AS (SELECT p AS node, max(x) AS s FROM l WHERE x > 90000 GROUP BY 1), seeds AS MATERIALIZED (SELECT node, s / sum(s) OVER () AS seed FROM d), r0 AS (SELECT node, seed AS r FROM seeds),
        {", ".join(step.format(n, n + 1) for n in range(rounds))}
        SELECT node, round(r, 9) AS rank FROM r{rounds} WHERE r > 0"""


def _structure_sql() -> str:
    from sightline.functions.text import STRUCTURE

    parts = " UNION ALL ".join(f"SELECT doc_id, {R.STRUCTURE_WEIGHTS[k]} AS w, lower(unnest(regexp_extract_all(text, '{p.replace('(?md)', '(?m)')}', 1))) AS name FROM documents" for k, p in STRUCTURE.items())
    return f"""
        WITH t AS (SELECT doc_id, regexp_extract_all(replace(lower(title), 'ς', 'σ'), '[\\p{{L}}\\p{{N}}]+') AS t, text FROM documents), n AS ({parts}),
        b AS (SELECT n.doc_id, sum(CASE WHEN list_contains(t, name) THEN w WHEN len(list_filter(t, lambda x: length(x) >= 3 AND contains(name, x))) > 0 THEN 0.2 ELSE 0.0 END) AS b FROM n JOIN t USING (doc_id) GROUP BY 1)
        SELECT doc_id, round(least(coalesce(b, 0), 1)::DOUBLE, 6) AS boost FROM t LEFT JOIN b USING (doc_id)"""


def _breaker_sql() -> str:
    """Steps through each user's events: bad and good in a row, since when it is open, and how many were skipped."""
    state = "CASE WHEN r.state = 'open' AND x.ms - r.since >= 30000 THEN 'half_open' ELSE r.state END"
    return f"""
        WITH RECURSIVE s AS (SELECT user_id, event_type <> 'error' AS ok, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
        r(user_id, n, state, bad, good, since, skipped) AS (
            SELECT DISTINCT user_id, 0::BIGINT, 'closed', 0, 0, 0::BIGINT, 0 FROM s
            UNION ALL SELECT user_id, n, CASE WHEN st = 'open' THEN 'open' WHEN st = 'closed' THEN CASE WHEN NOT ok AND bad + 1 >= 2 THEN 'open' ELSE 'closed' END ELSE CASE WHEN NOT ok THEN 'open' WHEN good + 1 >= 3 THEN 'closed' ELSE 'half_open' END END,
                CASE WHEN st = 'open' THEN bad WHEN st = 'closed' AND NOT ok AND bad + 1 < 2 THEN bad + 1 ELSE 0 END, CASE WHEN st = 'open' THEN good WHEN st = 'half_open' AND ok AND good + 1 < 3 THEN good + 1 ELSE 0 END,
                CASE WHEN st <> 'open' AND NOT ok AND (st = 'half_open' OR bad + 1 >= 2) THEN ms ELSE since END, skipped + (st = 'open')::INT
            FROM (SELECT x.user_id, x.n, x.ok, x.ms, r.bad, r.good, r.since, r.skipped, {state} AS st FROM r JOIN s x ON x.user_id = r.user_id AND x.n = r.n + 1))
        SELECT user_id, state, skipped FROM r JOIN (SELECT user_id, max(n) AS n FROM s GROUP BY 1) USING (user_id, n)"""


ORACLE = {
    "vec_scalar": f"""
        WITH {_V}, n AS (SELECT doc_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v)
        SELECT doc_id, round(norm, 5) AS norm, 1.0::DOUBLE AS short_norm, round(list_cosine_similarity(e[1:32], e[33:64]), 5) AS halves FROM n""",
    "fuse_weighted_rrf": f"""
        WITH {_L}, f AS (SELECT query_id, doc_id, sum(CASE source WHEN 'lexical' THEN 0.5 WHEN 'semantic_fast' THEN 1.0 ELSE 2.0 END / (61.0::DOUBLE + rank)) AS score, count(*) > 1 AS many,
                max(CASE WHEN source = 'lexical' THEN score END) AS lex FROM l WHERE source IN ('lexical', 'semantic_fast', 'semantic_quality') GROUP BY ALL)
        SELECT query_id, doc_id, round(score, 9) AS score, rank FROM
            (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, many DESC, coalesce(lex, '-inf'::DOUBLE) DESC, doc_id) - 1 AS rank FROM f) WHERE rank >= 3 AND rank < 8""",
    "refine_feedback_expansion": f"""
        WITH {_V}, {_ALL}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id::VARCHAR) AS n FROM scored),
        x AS (SELECT query_id, greatest(score, 0) AS w, unnest(range(64)) AS d, unnest(e) AS x FROM h JOIN v USING (doc_id) WHERE n <= 5),
        c AS (SELECT query_id, d, sum(w * x) / sum(w) AS x FROM x GROUP BY ALL),
        m AS (SELECT query_id, d, 0.8 * q.e[d + 1] + 0.2 * x AS x FROM c JOIN q USING (query_id))
        SELECT query_id, round(sum(CASE WHEN d = 0 THEN x END) / sqrt(sum(x * x)), 5) AS first, 1.0::DOUBLE AS norm FROM m GROUP BY query_id""",
    "vec_exact": _EXACT,
    "vec_int8": _EXACT,
    "vec_int4": _EXACT,
    "vec_embed_cached": """
        WITH n AS (SELECT DISTINCT text FROM documents WHERE doc_type = 'note' AND text IS NOT NULL)
        SELECT 'documents' AS what, count(*) AS n FROM documents UNION ALL SELECT 'embedded', count(text) FROM documents
        UNION ALL SELECT 'added', count(DISTINCT text) - (SELECT count(*) FROM n) FROM documents UNION ALL SELECT 'cached', count(*) FROM n""",
    "online_blend_state": """
        SELECT coalesce(lower(trim(query_class)), 'none') AS query_class, count(*) AS n, count_if(lower(trim(phase)) = 'refined') AS w, 7.0::DOUBLE + count_if(lower(trim(phase)) = 'refined') AS a,
            3.0::DOUBLE + count(*) - count_if(lower(trim(phase)) = 'refined') AS b, round((7.0::DOUBLE + count_if(lower(trim(phase)) = 'refined')) / (10.0::DOUBLE + count(*)), 9) AS mean, count(*) >= 50 AS warm FROM search_events GROUP BY 1""",
    "eval_sweep": f"""
        WITH {_L}, s AS (SELECT query_id, doc_id, source, CASE WHEN high - low > 1e-12 THEN (score - low) / (high - low) ELSE 0.5 END AS s FROM l WHERE source IN ('lexical', 'semantic_fast')),
        f AS (SELECT p.point, query_id, doc_id, round(sum(s * CASE source WHEN 'lexical' THEN p.point / 4 ELSE 1 - p.point / 4 END), 9) AS f FROM s, range(5) p(point) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY point, query_id ORDER BY f DESC, doc_id) - 1 AS rank FROM f),
        rel AS (SELECT DISTINCT query_id, doc_id::VARCHAR AS doc_id FROM hit_explanations WHERE rank_after <= 3), n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
        g AS (SELECT r.point, r.query_id, sum(1 / log2(rank + 2)) AS dcg FROM r JOIN rel USING (query_id, doc_id) WHERE rank < 10 GROUP BY ALL)
        SELECT p.point::INT AS point, round(avg(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg, true AS sound
        FROM n CROSS JOIN range(5) p(point) LEFT JOIN g ON g.query_id = n.query_id AND g.point = p.point GROUP BY 1""",
    "vec_live": "SELECT vec_id AS doc_id, CASE WHEN label < 4 THEN label + 100 ELSE label END AS label FROM embeddings WHERE label <> 2",
    "vec_cells": "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 100 = 0",
    "fuse_hash_ties": f"""
        WITH {_L}, f AS (SELECT query_id, doc_id, count(*) AS n FROM l WHERE source IN ('semantic_fast', 'semantic_quality') GROUP BY ALL), h AS (SELECT *, {_fnv("hex(encode(doc_id))")} AS h FROM f)
        SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, h, doc_id) - 1 AS rank FROM h QUALIFY rank < 4""",
    "fuse_labels": f"""
        WITH {_L}, p AS (SELECT doc_id::VARCHAR AS doc_id, least(greatest(max(rank_after) / 100, -0.08), 0.08) AS boost FROM hit_explanations GROUP BY 1),
        f AS (SELECT query_id, doc_id, sum(1 / (61.0::DOUBLE + rank)) AS score, bool_or(source = 'lexical') AS a, bool_or(source = 'semantic_fast') AS b FROM l WHERE source IN ('lexical', 'semantic_fast') GROUP BY ALL),
        s AS (SELECT query_id, doc_id, score + coalesce(boost, 0) AS score, CASE WHEN a AND b THEN 'hybrid' WHEN a THEN 'lexical' ELSE 'semantic_fast' END AS label FROM f LEFT JOIN p USING (doc_id))
        SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank, label FROM s""",
    "fuse_coverage": """
        SELECT count(DISTINCT source) AS answered, 4 AS expected, count(DISTINCT source) >= 3 AS sufficient FROM score_components WHERE source IN ('lexical', 'semantic_fast', 'reranked', 'archive') AND NOT isnan(raw_score) AND NOT isinf(raw_score)""",
    "fuse_dense_weights": f"""
        WITH {_L}, n AS (SELECT query_id, round(CASE WHEN abs(avg(score)) > 1e-12 THEN stddev_pop(score) / avg(score) ELSE 0 END, 9) AS cv FROM l WHERE source = 'lexical' GROUP BY 1),
        s AS (SELECT cv FROM n ORDER BY query_id DESC, cv DESC LIMIT 2048)
        SELECT query_id, round(CASE WHEN (SELECT count(*) FROM s) < 20 THEN 1.0 ELSE least(greatest(1 - 0.5::DOUBLE * (SELECT count(*) FROM s WHERE s.cv <= n.cv) / (SELECT count(*) FROM s), 0.6), 1) END, 9) AS weight FROM n""",
    "refine_rerank": f"""
        WITH {_PAGE}, w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), {_SPACE}), lambda x: x <> '')) AS t, list_distinct(list_filter(string_split_regex(lower(coalesce(title, '')), {_SPACE}), lambda x: x <> '')) AS q FROM documents),
        a AS (SELECT query_id, min(doc_id) AS first, count(*) AS n FROM page GROUP BY 1),
        s AS (SELECT p.query_id, p.doc_id, p.rank, CASE WHEN p.rank < 100 AND a.n >= 5 THEN len(list_intersect(q.q, t.t)) / greatest(1, len(q.q)) END AS s FROM page p JOIN a USING (query_id) JOIN w q ON q.doc_id = a.first JOIN w t ON t.doc_id = p.doc_id)
        SELECT query_id, doc_id, rank, round(s, 9) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY s IS NULL, s DESC, rank) - 1 AS new_rank FROM s""",
    "refine_priors": f"""
        WITH {_PAGE}, x AS (SELECT p.*, source, floor(epoch(created_at))::BIGINT AS born FROM page p LEFT JOIN documents d USING (doc_id)),
        m AS (SELECT *, coalesce(0.5 + 0.5 * exp(-ln(2) * greatest(1780000000 - born, 0) / (86400.0 * 90)), 1) * coalesce(1 + (CASE WHEN source = 'workspace/atlas-notes' THEN 2 WHEN split_part(source, '/', 1) = 'workspace' THEN 1 ELSE 0 END) / greatest(len(string_split(source, '/')), 2), 1)
            * CASE WHEN source = 'chat' THEN 1.25 ELSE 1.0 END AS m FROM x)
        SELECT query_id, doc_id, round(CASE WHEN rank < 8 THEN score * m ELSE score END, 9) AS score FROM m""",
    "refine_feedback": f"WITH {_PAGE} SELECT query_id, doc_id, round(score * coalesce(1 + length(doc_type) / 10, 1), 9) AS score FROM page LEFT JOIN documents USING (doc_id)",
    "refine_mutual": f"""
        WITH {_V}, {_ALL}, h AS (SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id::VARCHAR) AS n FROM scored) WHERE n <= 50),
        m AS (SELECT a.query_id, a.doc_id, avg(b.score) AS mean FROM h a JOIN h b ON a.query_id = b.query_id AND b.doc_id - a.doc_id IN (1, -1) GROUP BY ALL)
        SELECT h.query_id, h.doc_id, round(coalesce((1 - 0.3::DOUBLE) * score + 0.3::DOUBLE * mean, score), 6) AS score FROM h LEFT JOIN m ON m.query_id = h.query_id AND m.doc_id = h.doc_id""",
    "refine_hub_penalty": f"""
        WITH {_V}, {_ALL}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC) AS place FROM scored), r AS (SELECT doc_id, avg(score) AS r FROM n WHERE place <= 3 GROUP BY doc_id)
        SELECT query_id, doc_id, round(score - 0.5 * r, 6) AS score FROM scored JOIN r USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id::VARCHAR) <= 20""",
    "refine_pagerank": _pagerank_sql(12),
    "refine_structure": _structure_sql(),
    "refine_short_circuit": "SELECT item_id, kind IN ('identifier', 'short_keyword') AND length(query) >= 12 AS skip FROM (" + _CLASSES + ") JOIN eval_items USING (item_id)",
    "online_circuit_breaker": _breaker_sql(),
    "vec_filtered": f"WITH {_V}, scored AS (SELECT query_id, doc_id, list_dot_product(v.e, q.e) AS score FROM v, q WHERE label = 3) {_TOP.format('scored', 10)}",
    "vec_truncated": f"""
        WITH {_V}, first AS (SELECT query_id, doc_id, list_dot_product(v.e[1:32], q.e[1:32]) AS score, list_dot_product(v.e, q.e) AS exact FROM v, q),
        kept AS (SELECT query_id, doc_id, exact AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id::VARCHAR) AS n FROM first) WHERE n <= 30)
        {_TOP.format('kept', 10)}""",
    "vec_quantizer": f"""
        WITH {_V}, x AS (SELECT unnest(range(0, 64))::INT AS dim, unnest(e) AS x FROM v)
        SELECT dim, round(min(x), 6) AS low, round((max(x) - min(x)) / 255, 8) AS scale FROM x GROUP BY dim""",
    "fuse_rrf": f"""
        WITH {_L}, f AS (SELECT query_id, doc_id, sum(1 / (61.0::DOUBLE + rank)) AS score, count(*) > 1 AS in_both,
                max(CASE WHEN source = 'lexical' THEN rank END)::INT AS lexical_rank, max(CASE WHEN source = 'semantic_fast' THEN rank END)::INT AS semantic_rank,
                max(CASE WHEN source = 'lexical' THEN score END) AS lex FROM l WHERE source IN ('lexical', 'semantic_fast') GROUP BY ALL)
        SELECT query_id, doc_id, round(score, 9) AS score, rank, in_both, lexical_rank, semantic_rank FROM
            (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, in_both DESC, coalesce(lex, '-inf'::DOUBLE) DESC, doc_id) - 1 AS rank FROM f) WHERE rank < 10""",
    "fuse_pool_minmax": f"""
        WITH {_L}, f AS (SELECT query_id, doc_id, sum(CASE WHEN high - low > 1e-12 THEN (score - low) / (high - low) ELSE 0 END) AS score, count(*) > 1 AS in_both,
                max(CASE WHEN source = 'lexical' THEN score END) AS lex FROM l WHERE source IN ('lexical', 'semantic_fast') GROUP BY ALL)
        SELECT query_id, doc_id, round(score, 9) AS score, rank FROM
            (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, in_both DESC, coalesce(lex, '-inf'::DOUBLE) DESC, doc_id) - 1 AS rank FROM f) WHERE rank < 10""",
    "fuse_blend": f"""
        WITH {_L}, s AS (SELECT query_id, doc_id, source, CASE WHEN high - low > 1e-12 THEN (score - low) / (high - low) ELSE 1 END AS s FROM l),
        b AS (SELECT query_id, doc_id, max(CASE WHEN source = 'semantic_fast' THEN s END) AS f, max(CASE WHEN source = 'semantic_quality' THEN s END) AS q
              FROM s WHERE source IN ('semantic_fast', 'semantic_quality') GROUP BY ALL)
        SELECT query_id, doc_id, round(coalesce(0.7 * q + (1 - 0.7) * f, q, f)::DOUBLE, 9) AS score FROM b""",
    "fuse_federated_rrf": f"""
        WITH {_L} SELECT query_id, doc_id, round(sum(weight / (61.0::DOUBLE + rank)), 9) AS score, count(*) AS shards,
            first(source ORDER BY weight / (61.0::DOUBLE + rank) DESC, rank, source) AS primary_shard FROM l GROUP BY query_id, doc_id""",
    "fuse_comb_mnz": f"""
        WITH {_L} SELECT query_id, doc_id, round(sum(weight * CASE WHEN high - low > 1e-12 THEN (score - low) / (high - low) ELSE 0.5 END) * count(*), 9) AS score, count(*) AS shards
        FROM l GROUP BY query_id, doc_id""",
    "fuse_z_scores": f"""
        WITH {_L} SELECT query_id, doc_id::BIGINT AS doc_id, round(CASE WHEN dev > 1e-12 THEN (least(greatest((score - mean) / dev, -3), 3) + 3) / 6 ELSE 0.5 END, 6) AS z FROM l WHERE source = 'lexical'""",
    "fuse_commitment": f"""
        WITH {_L} SELECT query_id, round(CASE WHEN abs(avg(score)) > 1e-12 THEN stddev_pop(score) / avg(score) ELSE 0 END, 6) AS cv FROM l WHERE source = 'lexical' GROUP BY query_id""",
    "fuse_rank_changes": f"""
        WITH {_L}, a AS (SELECT query_id, doc_id, rank FROM l WHERE source = 'semantic_fast'), b AS (SELECT query_id, doc_id, rank FROM l WHERE source = 'semantic_quality'),
        j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, a.rank AS was, b.rank AS now FROM a FULL JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
        t AS (SELECT x.query_id, sum(sign(x.was - y.was) * sign(x.now - y.now)) / count(*) AS tau FROM j x JOIN j y ON x.query_id = y.query_id AND x.was < y.was
              WHERE x.now IS NOT NULL AND y.now IS NOT NULL GROUP BY 1),
        k AS (SELECT query_id, count(*) FILTER (was IS NULL OR now < was) AS promoted, count(*) FILTER (now IS NULL OR now > was) AS demoted, count(*) FILTER (was = now) AS stable FROM j GROUP BY 1)
        SELECT k.query_id, promoted, demoted, stable, round(tau, 6) AS tau FROM k LEFT JOIN t ON k.query_id = t.query_id""",
    "eval_measures": f"""
        WITH {_L}, rel AS (SELECT DISTINCT query_id, doc_id::VARCHAR AS doc_id FROM hit_explanations WHERE rank_after <= 3),
        n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
        r AS (SELECT l.query_id, l.rank, rel.doc_id IS NOT NULL AS hit FROM l LEFT JOIN rel ON rel.query_id = l.query_id AND rel.doc_id = l.doc_id WHERE source = 'lexical'),
        p AS (SELECT *, sum(hit::INT) OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM r),
        m AS (SELECT query_id, sum(CASE WHEN hit AND rank < 10 THEN 1 / log2(rank + 2) ELSE 0 END) AS dcg, sum(CASE WHEN hit AND rank < 10 THEN seen / (rank + 1) ELSE 0 END) AS ap,
              max(CASE WHEN hit THEN 1.0::DOUBLE / (rank + 1) ELSE 0 END) AS rr, count_if(hit AND rank < 10) AS hits FROM p GROUP BY 1)
        SELECT n.query_id, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg,
               round(coalesce(ap, 0) / least(10, n), 6) AS ap, round(coalesce(rr, 0), 6) AS rr, round(coalesce(hits, 0) / n, 6) AS recall
        FROM n LEFT JOIN m ON n.query_id = m.query_id""",
    "eval_calibration": """
        WITH e AS (SELECT least(greatest(value, 0), 100) / 100 AS p, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM events),
        b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS c, avg(y) AS a FROM e GROUP BY 1)
        SELECT 'ece' AS measure, round(sum(n * abs(c - a)) / sum(n), 6) AS value FROM b UNION ALL SELECT 'brier', round(avg((p - y) * (p - y)), 6) FROM e""",
    "eval_outliers": """
        WITH f AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem GROUP BY 1),
        k AS (SELECT l.l_returnflag, l_extendedprice AS v FROM lineitem l JOIN f USING (l_returnflag) WHERE l_extendedprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))
        SELECT l_returnflag, count(*) AS kept, round(stddev_pop(v) / abs(avg(v)), 6) AS cv, count(*) >= 5 AND stddev_pop(v) / abs(avg(v)) <= 0.6 AS stable FROM k GROUP BY 1""",
    "eval_median_mad": """
        WITH s AS (SELECT lower(trim(phase)) AS phase, latency_us AS v FROM search_events WHERE latency_us > 0 AND phase IS NOT NULL),
        m AS (SELECT phase, median(v) AS median FROM s GROUP BY 1)
        SELECT phase, any_value(median) AS median, median(abs(v - median)) AS mad_raw FROM s JOIN m USING (phase) GROUP BY phase""",
    "eval_off_policy": """
        WITH o AS (SELECT o_orderstatus AS arm, (o_orderkey % 2)::DOUBLE AS r, least((0.1::DOUBLE + (o_custkey % 7) / 10) / (0.2::DOUBLE + (o_custkey % 5) / 10), 10) AS w FROM orders)
        SELECT arm, round(avg(w * r), 6) AS ips, round(sum(w) * sum(w) / sum(w * w), 4) AS ess, round(avg(0.5 + w * (r - 0.5)), 6) AS dr FROM o GROUP BY 1""",
    "eval_conformal": """
        WITH h AS (SELECT phase, rank_after AS rank FROM hit_explanations WHERE rank_after IS NOT NULL AND phase IS NOT NULL),
        l AS (SELECT phase, list(rank ORDER BY rank) AS r, count(*) AS n FROM h GROUP BY 1)
        SELECT phase, CASE WHEN ceil((n + 1) * 0.9::DOUBLE - 1e-9) <= n THEN r[ceil((n + 1) * 0.9::DOUBLE - 1e-9)::INT] END AS required_k, n FROM l""",
    "refine_hubness": f"""
        WITH {_V}, {_ALL}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC) AS place FROM scored)
        SELECT doc_id, round(avg(score), 6) AS r FROM n WHERE place <= 3 GROUP BY doc_id""",
    "refine_smoothing": f"""
        WITH {_V}, {_ALL}, h AS (SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id::VARCHAR) AS n FROM scored) WHERE n <= 50),
        m AS (SELECT a.query_id, a.doc_id, avg(b.score) AS mean FROM h a JOIN h b ON a.query_id = b.query_id AND b.doc_id - a.doc_id IN (1, 2, 5) GROUP BY ALL)
        SELECT h.query_id, h.doc_id, round(coalesce(0.8 * score + 0.2 * mean, score), 6) AS smoothed FROM h LEFT JOIN m ON m.query_id = h.query_id AND m.doc_id = h.doc_id""",
    "refine_explanations": """
        WITH c AS (SELECT query_id, doc_id, source, max(CASE WHEN NOT isnan(raw_score) AND NOT isinf(raw_score) THEN raw_score END) AS s, max(weight) AS w FROM score_components GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY coalesce(s, '-inf'::DOUBLE) DESC, doc_id::VARCHAR) AS n FROM c)
        SELECT query_id, doc_id, round(sum(w / (60.0::DOUBLE + n)), 9) AS final_score, count(*)::INT AS sources FROM r GROUP BY query_id, doc_id""",
    "online_blend": """
        WITH s AS (SELECT coalesce(lower(trim(query_class)), 'none') AS query_class, count(*) AS n, count_if(coalesce(lower(trim(phase)), '') = 'refined') AS w FROM search_events GROUP BY 1),
        t AS (SELECT sum(n) AS tn, sum(w) AS tw FROM s)
        SELECT query_class, round(least(greatest(CASE WHEN n >= 50 THEN (7.0::DOUBLE + w) / (10.0::DOUBLE + n) WHEN tn >= 50 THEN (7.0::DOUBLE + tw) / (10.0::DOUBLE + tn) ELSE 0.7 END, 0.1), 0.95)::DOUBLE, 9) AS alpha FROM s, t""",
    "online_k": """
        SELECT event_type, round(least(greatest((0.6::DOUBLE + sum(value) / 225) / (0.01::DOUBLE + count(value) / 225.0::DOUBLE), 1), 200), 6) AS k FROM events GROUP BY 1""",
    "online_phase_gate": """
        WITH e AS (SELECT user_id, event_id, least(greatest(0.5::DOUBLE + value / 60, 0.01), 100) AS f FROM events),
        w AS (SELECT user_id, row_number() OVER o AS n, sum(ln(f)) OVER o AS s, avg((f > 1)::INT) OVER o AS up FROM e WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
        d AS (SELECT user_id, n, CASE WHEN s >= ln(20) - 1e-12 THEN 'always_refine' WHEN s <= -ln(20) + 1e-12 THEN 'skip_quality' WHEN n >= 500 THEN CASE WHEN up >= 0.5 THEN 'always_refine' ELSE 'skip_quality' END END AS d FROM w)
        SELECT user_id, coalesce(arg_min(d, n) FILTER (d IS NOT NULL), 'undecided') AS decision, min(n) FILTER (d IS NOT NULL) AS at FROM d GROUP BY 1""",
}
