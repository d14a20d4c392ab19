import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from sightline.operators import evaluation as E
from sightline.operators import fusion as U
from sightline.operators import lexical as L
from sightline.operators import query_language as Q
from sightline.operators import refine as R
from sightline.operators import vector_search as S


def hits(spark, data):
    return spark.createDataFrame([(0, str(d), s) for d, s in data], "query_id int, doc_id string, score double")


# -- lexical ---------------------------------------------------------------------


def test_length_buckets(spark):
    df = spark.createDataFrame([(n,) for n in (0, 31, 40, 41, 42, 56, 59, 60, 1000)], "n bigint")
    got = [r[0] for r in df.coalesce(1).select(L.quantized_length(F.col("n"))).collect()]
    assert got == [0, 31, 40, 40, 42, 56, 56, 60, 984]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("1", "a b b"), ("2", "b c"), ("3", None)], "doc_id string, text string")
    q = spark.createDataFrame([(7, "B b")], "query_id int, query string")
    got = L.search_queries(L.build_index(docs), q, 5).orderBy("rank").collect()
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    one = lambda tf, n: idf * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * n / (5 / 3)))
    assert [(r.doc_id, r.rank) for r in got] == [("1", 0), ("2", 1)]
    assert [r.score for r in got] == pytest.approx([one(2, 3), one(1, 2)], abs=1e-8)


def test_deleted_documents_do_not_match_but_count(spark):
    docs = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b")], "doc_id string, text string")
    index = L.build_index(docs)
    q = spark.createDataFrame([(0, "a")], "query_id int, query string")
    before = L.search_queries(index, q, 5).where("doc_id = '1'").first().score
    index.live = spark.createDataFrame([("1",), ("3",)], "doc_id string")
    got = L.search_queries(index, q, 5).collect()
    assert [(r.doc_id, r.score) for r in got] == [("1", before)]


DOCS = [("1", "the quick brown fox", 5), ("2", "quick the fox brown", 15), ("3", "a brown bear", 25), ("4", "working worker works", None)]


@pytest.mark.parametrize(
    "query,want",
    [
        ("fox", ["1", "2"]), ('"quick brown"', ["1"]), ('"quick fox"~1', ["1", "2"]), ("+brown -fox", ["3"]), ("brown AND bear OR worker", ["3", "4"]),
        ("size:[5 TO 15]", ["1", "2"]), ("size:>5", ["2", "3"]), ("size: IN [5 25]", ["1", "3"]), ("wor*", ["4"]), ('"brown be"*', ["3"]), ("-brown", ["4"]), ("*", ["1", "2", "3", "4"]), ("", []), ("(", []),
    ],
)
def test_query_language(spark, query, want):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string, size int")
    parsed = Q.LenientParser({"content": 1.0}, {"size": int}).parse(query)
    got = Q.Compiler(L.build_index(docs), docs).compile(parsed.query)
    assert sorted(r.doc_id for r in got.collect()) == want


def test_too_many_expanded_terms_are_an_error(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string, size int")
    with pytest.raises(ValueError):
        L.expand_glob(L.build_index(docs), "content", "*", limit=3)


def test_parsers_and_classes(spark):
    cases = {
        "HTTPServer": "identifier", "foo.": "identifier", "std::fmt how to use it now": "natural_language", "std::fmt": "identifier", "Hello": "short_keyword", "HELLO": "short_keyword",
        "camelCase": "identifier", "bd-123": "identifier", "my-project-789": "identifier", "well-known": "short_keyword", "-12": "short_keyword", "fn main": "identifier", "fn": "short_keyword",
        "impl Trait for X y": "identifier", "a b c": "short_keyword", "a b c d": "natural_language", "a_b c": "short_keyword", " \t": "empty", "Ünïcode": "short_keyword", "üÜ": "identifier", "Foo1": "identifier",
    }
    assert {q: Q.query_class(q) for q in cases} == cases
    got = spark.createDataFrame([(q,) for q in cases], "q string").select("q", Q.query_class_column(F.col("q")).alias("k")).collect()
    assert {r.q: r.k for r in got} == cases
    assert [Q.query_class(q) for q in ("", "foo_bar", "src/main.rs", "two words", "how do i fix this thing")] == ["empty", "identifier", "identifier", "short_keyword", "natural_language"]
    n = Q.parse_negation(r'a -b NOT "c d" \-e')
    assert (n.positive, n.terms, n.phrases) == ("a -e", ["b"], ["c d"])
    deep = Q.LenientParser().parse("(" * 100 + "a" + ")" * 100)
    assert deep.diagnostics
    assert Q.LenientParser().parse("x" * 20_000).truncated
    with pytest.raises(ValueError):
        Q.check_capabilities(Q.Phrase(("a", "b"), (("prefix", 1.0),)), {"prefix"})
    c = Q.ConversationParser({"content": 1.0}).parse("a b OR c").query
    assert isinstance(c, Q.Boolean) and len(c.must) == 2
    assert [Q.wildcard_kind(w) for w in ("a", "a*", "*a", "*a*", "a*b")] == ["exact", "prefix", "suffix", "substring", "complex"]


# -- vectors ---------------------------------------------------------------------


def test_exact_and_two_pass_search_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (5, x[5].tolist())], "doc_id int, embedding array<float>")
    q = df.where("doc_id < 6").select(F.col("doc_id").alias("query_id"), "embedding")
    truth = {i: [int(j) for j in np.lexsort((np.arange(300).astype(str), -(x.astype(float) @ x[i])))[:5]] for i in range(6)}
    for got in (S.exact_top_k(df, q, 5), S.two_pass_top_k(df, q, 5, 8), S.two_pass_top_k(df, q, 5, 4, 20), S.truncated_top_k(df, q, 5, 12, 20)):
        found = {}
        for r in got.orderBy("rank").collect():
            found.setdefault(r.query_id, []).append(r.doc_id)
        assert found == truth
    assert S.exact_top_k(df, q, 0).count() == 0
    with pytest.raises(ValueError):
        S.truncated_top_k(df, q, 5, 0)


def test_nibbles_and_certificates():
    codes = np.array([-7, 7, 0, 3, -1])
    assert (S.unpack_nibbles(S.pack_nibbles(codes), 5) == codes).all()
    r = [0.9, 1.0, 0.8, 1.0, 0.95, 1.0, 0.9, 1.0, 1.0]
    assert S.conformal_recall_lower_bound(r, 0.1) == 0.8 and S.conformal_recall_lower_bound(r[:3], 0.1) == 0
    assert 0 < S.hoeffding_lower_bound(r * 20, 0.1) < np.mean(r)
    assert S.certified_effort({10: [0.5] * 20, 50: [0.95] * 20}, 0.9, 0.1) == 50


def test_increments_supersede_and_delete(spark):
    base = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "doc_id string, v int, seq int")
    new = spark.createDataFrame([("a", 2, 2), ("c", 1, 3)], "doc_id string, v int, seq int")
    assert rows(S.live_rows(base, new, spark.createDataFrame([("b",)], "doc_id string")).select("doc_id", "v")) == [("a", 2), ("c", 1)]


# -- fusion -------------------------------------------------------------------------


def test_rrf_by_hand_with_duplicates_and_ties(spark):
    lex = hits(spark, [("10", 5.0), ("2", 5.0), ("10", 1.0), ("x", float("nan"))])
    sem = hits(spark, [("2", 0.9), ("9", 0.9)])
    got = U.rrf({"lexical": lex, "semantic": sem}).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["2", "10", "9", "x"]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61) and got[0].in_both and not got[1].in_both
    assert [r.doc_id for r in U.rrf({"lexical": lex, "semantic": sem}, limit=2, offset=1).orderBy("rank").collect()] == ["10", "9"]
    assert U.rrf({"lexical": lex.limit(0), "semantic": sem}).count() == 2
    assert U.rrf({"lexical": lex.limit(0), "semantic": sem.limit(0)}).count() == 0
    assert {r.doc_id for r in U.rrf({"lexical": lex, "semantic": sem}, hash_ties=True).collect()} == {"2", "10", "9", "x"}


def test_flat_pools_differ_by_fusion(spark):
    flat = hits(spark, [("a", 3.0), ("b", 3.0)])
    assert {r.score for r in U.pool_minmax({"lexical": flat, "semantic": flat}).collect()} == {0.0}
    assert {r.score for r in U.blend(flat, flat).collect()} == {1.0}
    assert {r.normalized for r in U.normalized(flat, ["query_id"]).collect()} == {0.5}
    assert {r.normalized for r in U.normalized(flat, ["query_id"], method="z_score").collect()} == {0.5}


def test_blend_keeps_one_sided_scores(spark):
    got = {r.doc_id: r.score for r in U.blend(hits(spark, [("a", 1.0), ("b", 0.0)]), hits(spark, [("a", 0.0), ("c", 2.0)]), 0.7).collect()}
    assert got == pytest.approx({"a": 0.3, "b": 0.0, "c": 1.0})


def test_kendall_and_rank_changes(spark):
    a, b = hits(spark, [("a", 3.0), ("b", 2.0), ("c", 1.0)]), hits(spark, [("c", 3.0), ("b", 2.0), ("a", 1.0), ("d", 0.5)])
    assert U.kendall_tau(a, b).first().tau == -1
    r = U.rank_changes(a, b).first()
    assert (r.promoted, r.demoted, r.stable) == (2, 1, 1)
    assert U.kendall_tau(a, hits(spark, [("a", 1.0)])).first().tau is None


def test_dense_weights(spark):
    cv = spark.createDataFrame([(0, 0.1), (1, 5.0)], "query_id int, cv double")
    sample = spark.createDataFrame([(x / 10, x) for x in range(10)] + [(float("nan"), 99), (None, 98)], "cv double, at int")
    got = {r.query_id: r.weight for r in U.dense_weights(cv, sample, "at", 0.5, 0.3, warm_up=10).collect()}
    assert got == pytest.approx({0: 0.9, 1: 0.5})
    for more in ({"warm_up": 11}, {"warm_up": 10, "beta": 0.0}):
        assert [r.weight for r in U.dense_weights(cv, sample, "at", **more).collect()] == [1.0, 1.0]


def test_dense_weights_take_the_last_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(U, "NQC_SAMPLE", 4)
    cv = spark.createDataFrame([(0, 0.5)], "query_id int, cv double")
    sample = spark.createDataFrame([(0.1 if x < 20 else 0.9, x) for x in range(24)], "cv double, at int").repartition(6)
    assert U.dense_weights(cv, sample, "at", warm_up=1).first().weight == 1.0
    assert U.dense_weights(cv, sample.withColumn("at", -F.col("at")), "at", warm_up=1).first().weight == 0.5


# -- refinement ------------------------------------------------------------------------


def test_mmr_equals_the_greedy_rule():
    assert R.mmr_order(np.array([1.0, 0.9, 0.5]), np.array([[1, 0], [1, 0.01], [0, 1]], float), 3, 0.5) == [0, 2, 1]
    assert R.mmr_order(np.array([1.0, 1.0]), np.zeros((2, 2)), 5, 0.7) == [0, 1]


def test_pagerank_equals_power_iteration(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", "ref", rng.choice([1.0, 2.0, -1.0])) for _ in range(30)] + [("n1", "sink", "ref", 1.0)]
    df = spark.createDataFrame(edges, "src string, dst string, edge_type string, weight double")
    seeds = hits(spark, [("n1", 2.0), ("n2", 1.0), ("absent", 9.0), ("n3", float("nan"))])
    got = {r.node: r.rank for r in R.personalized_pagerank(df, seeds).collect()}
    w, nodes = {}, set()
    for s, d, _, x in edges:
        if x > 0:
            w[s, d] = w.get((s, d), 0) + x
            nodes |= {s, d}
    seed = {n: v for n, v in (("n1", 2.0), ("n2", 1.0)) if n in nodes}
    seed = {n: v / sum(seed.values()) for n, v in seed.items()}
    rank = dict(seed)
    for _ in range(20):
        new = dict.fromkeys(nodes, 0.0)
        dangling = 0.0
        for n, r in rank.items():
            out = {d: x for (s, d), x in w.items() if s == n}
            if not out:
                dangling += r
            for d, x in out.items():
                new[d] += 0.85 * r * x / sum(out.values())
        for n, s in seed.items():
            new[n] += s * (0.15 + 0.85 * dangling)
        rank = new
    assert sum(got.values()) == pytest.approx(1, abs=1e-6)
    assert got == pytest.approx({n: r for n, r in rank.items() if r > 0}, abs=1e-5)
    assert R.personalized_pagerank(df, seeds.limit(0)).count() == 0


def test_smoothing_and_mutual_edges(spark):
    h = hits(spark, [("a", 1.0), ("b", 0.0), ("c", 0.5)])
    e = spark.createDataFrame([("a", "b", "similar", 0), ("b", "a", "similar", 0), ("a", "c", "similar", 1), ("c", "zzz", "similar", 0)], "src string, dst string, edge_type string, ord int")
    got = {r.doc_id: r.smoothed for r in R.smooth(h, e, 0.5).collect()}
    assert got == pytest.approx({"a": 0.5 + 0.125, "b": 0.5, "c": 0.5})
    assert {r.doc_id: r.smoothed for r in R.smooth(h, e, 0.5, mutual=True).collect()} == pytest.approx({"a": 0.5, "b": 0.5, "c": 0.5})


def test_reranking_failures_leave_the_order(spark):
    h = hits(spark, [(str(i), 1.0 - i / 10) for i in range(6)]).withColumn("rank", F.col("doc_id").cast("int"))
    texts = spark.createDataFrame([(str(i), "w " * (i + 1)) for i in range(6)], "doc_id string, text string")
    q = spark.createDataFrame([(0, "w")], "query_id int, query string")
    up = R.rerank(h, texts, q, lambda qs, ts: [float(len(t)) for t in ts])
    assert [r.doc_id for r in up.orderBy("new_rank").collect()] == ["5", "4", "3", "2", "1", "0"]

    def broken(qs, ts):
        raise RuntimeError

    assert [r.doc_id for r in R.rerank(h, texts, q, broken).orderBy("new_rank").collect()] == [str(i) for i in range(6)]


def test_feedback_boosts_decay_and_stay_in_bounds(spark):
    week = 168 * 3600.0
    s = spark.createDataFrame([("a", "select", None, 0.0), ("b", "skip", None, 0.0), ("c", "dwell", 40.0, 0.0)] + [("d", "select", None, float(i)) for i in range(50)], "doc_id string, kind string, duration_secs double, ts double")
    got = {r.doc_id: r.boost for r in R.feedback_boosts(s, week).collect()}
    assert got["a"] == pytest.approx(1.15) and got["b"] == pytest.approx(0.975) and got["c"] == pytest.approx(1.1) and 1.4 < got["d"] <= 1.501


def test_priors(spark):
    df = spark.createDataFrame([("/a/b/c", "/a/b/d")], "p string, r string")
    assert df.select(R.path_proximity(F.col("p"), F.col("r"))).first()[0] == pytest.approx(3 / 4)
    assert df.select(R.recency(F.lit(10.0), 10.0)).first()[0] == pytest.approx(0.5)


# -- evaluation ---------------------------------------------------------------------------


def test_measures_by_hand(spark):
    run = spark.createDataFrame([(0, "a", 0), (0, "b", 1), (0, "a", 2), (0, "c", 3), (2, "z", 0)], "query_id int, doc_id string, rank int")
    rel = spark.createDataFrame([(0, "b"), (0, "c"), (0, "q"), (1, "x")], "query_id int, doc_id string")
    got = {r.query_id: r for r in E.measures(run, rel, 10).collect()}
    ideal = sum(1 / math.log2(i + 2) for i in range(3))
    assert set(got) == {0, 1} and got[1].ndcg == got[1].rr == got[1].recall == 0
    assert got[0].ndcg == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / ideal)
    assert got[0].ap == pytest.approx((1 / 2 + 2 / 4) / 3) and got[0].rr == 0.5 and got[0].recall == pytest.approx(2 / 3)


def test_bootstrap(spark):
    x = np.random.default_rng(0).normal(1, 1, 200).tolist()
    ci = E.bootstrap_ci(x)
    assert ci["low"] < np.mean(x) < ci["high"] and E.bootstrap_ci([]) is None
    assert E.bootstrap_compare(x, [v - 1 for v in x])["significant"] and not E.bootstrap_compare(x, x)["significant"]
    means = E.bootstrap_distributed(spark.createDataFrame([(v,) for v in x], "v double"), "v", 200)
    spread = [r.mean for r in means.collect()]
    assert abs(np.mean(spread) - np.mean(x)) < 0.05 and 0.04 < np.std(spread) < 0.11
    assert "ndcg\t" in E.comparison_report({"ndcg": x}, {"ndcg": x})


def test_calibration(spark):
    steps = E.fit_isotonic([(1, 0), (2, 1), (3, 0), (4, 1)])
    assert steps == [(1, 0), (2, 0.5), (4, 1)]
    df = spark.createDataFrame([(0.0,), (2.5,), (9.0,), (float("nan"),)], "s double").coalesce(1)
    assert [r[0] for r in df.select(E.isotonic(F.col("s"), steps)).collect()] == [0, 0.5, 1, 0]
    assert df.select(E.platt(F.col("s"), 1, 0)).first()[0] == 0.5


def test_conformal(spark):
    ranks = spark.createDataFrame([("a", i) for i in range(1, 20)] + [("b", 3)], "kind string, rank int")
    got = {r.kind: r.required_k for r in E.conformal_required_k(ranks, 0.1, ["kind"]).collect()}
    assert got == {"a": 18, "b": None}
    assert {r.kind: r.required_k for r in E.mondrian_required_k(ranks, 0.1, "kind", 10).collect()}["b"] == 18
    assert E.conformal_p_value(ranks.where("kind = 'a'"), 19).first().p == pytest.approx(2 / 20)


def test_robust_statistics(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 2, 3, 4, 100])] + [("b", 0, None)], "k string, seq int, v double")
    m = E.median_mad(df, ["k"], "v").first()
    assert (m.median, m.mad_raw) == (3, 1)
    assert [r.v for r in E.outliers(df.where("k = 'a'"), "v", ["k"]).collect()] == [100]
    est = 1.0
    for v in (2, 3, 4, 100):
        est += 0.01 * max(-1.345, min(1.345, v - est))
    assert E.huber_mean(df, ["k"], "seq", "v").first().huber == pytest.approx(est)
    r = E.robust_metrics(df, "k", "v").first()
    assert (r.n, r.p50, r.least, r.most, r["distinct"]) == (5, 3, 1, 100, 5)


def test_a_store_holds_codes_of_fewer_bytes_and_finds_the_same(spark):
    from sightline.session import shared_dir
    from sightline.sources import files

    x = np.random.default_rng(3).normal(size=(800, 33)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None)], "doc_id bigint, embedding array<float>")
    at = shared_dir(spark, "store")
    stored = S.store(df, at, 16)
    assert stored.count() == 800
    row = stored.where("doc_id = 7").first()
    assert np.abs(np.frombuffer(row.int8, np.int8) * row.step8 - x[7]).max() <= row.step8 / 2 + 1e-6
    assert (S.unpack_nibbles(row.int4, 33) == np.rint(x[7] / row.step4)).all() and row.int4 == S.pack_nibbles(S.unpack_nibbles(row.int4, 33)) and len(row.int4) == 17
    q = df.where("doc_id < 5").select(F.col("doc_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.doc_id) for r in S.exact_top_k(df, q, 10).collect()}
    found = {form: {(r.query_id, r.doc_id) for r in S.stored_top_k(stored, q, 10, form).collect()} for form in ("int8", "int4", "head")}
    assert found["int8"] == exact and len(found["int4"] & exact) >= 48
    assert found["head"] == {(r.query_id, r.doc_id) for r in S.truncated_top_k(df, q, 10, 16).collect()}
    # a first pass reads its own column only
    plan = S._scan(stored.select("doc_id", F.col("int8").alias("v"), "step8"), q, 5, "query_id", "embedding", lambda b, q: S._coded(b, q, 8))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,int8:binary,step8:float>" in plan
    index = S.CellIndex.build(df, f"{at}-cells/rows", 6)
    index.save(f"{at}-cells")
    again = S.CellIndex.load(spark, f"{at}-cells")
    assert {(r.query_id, r.doc_id) for r in again.search(q, 10, 6).collect()} == exact
    with pytest.raises(ValueError):
        again.search(q.withColumn("embedding", F.slice("embedding", 1, 5)), 10)
    with pytest.raises(ValueError):
        S.CellIndex.load(spark, at)
    with pytest.raises(RuntimeError):
        index.save(f"{at}-cells")


def test_each_task_keeps_the_best_over_its_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(i, [float(i % 50), 1.0]) for i in range(200)], "doc_id bigint, embedding array<float>").coalesce(1)
        q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "query_id bigint, embedding array<float>")
        rows = S.score_blocks(df, q, 3, "doc_id", "embedding", "query_id", "embedding", S.dot_scores).collect()
        assert {(r.query_id, r.doc_id) for r in rows} == {(1, i) for i in (49, 99, 149, 199)} | {(2, i) for i in (0, 50, 100, 150)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_written_index_scores_as_the_one_in_memory(spark, data):
    from sightline.operators import lexical as L
    from sightline.session import shared_dir

    d = spark.read.parquet(f"{data}/documents.parquet")
    e = spark.read.parquet(f"{data}/eval_items.parquet")
    index = L.build_index(d, fields={"content": "text", "title": "title"})
    at = shared_dir(spark, "index")
    index.write(at)
    a, b = (sorted(map(tuple, L.search_queries(i, e, 5, "item_id", "query", L.FIELD_BOOSTS).collect())) for i in (index, L.LexicalIndex.read(spark, at)))
    assert a == b and a
