import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sightline.operators import adaptive as A
from sightline.operators import jobs as J
from sightline.operators import telemetry as M


def test_phase_gate_decides_at_the_first_crossing(spark):
    df = spark.createDataFrame([("up", i, 2.0) for i in range(10)] + [("down", i, 0.5) for i in range(10)] + [("flat", i, 1.0) for i in range(10)], "k string, s int, f double")
    got = {r.k: (r.decision, r["at"]) for r in A.phase_gate(df, ["k"], "s", "f").collect()}
    assert got == {"up": ("always_refine", 5), "down": ("skip_quality", 5), "flat": ("undecided", None)}
    assert {r.k: r.decision for r in A.phase_gate(df, ["k"], "s", "f", timeout=8).collect()}["flat"] == "skip_quality"


def confirmed(at, pending, run, wanted, needed):
    if wanted == at:
        return at, None, 0
    run = run + 1 if pending == wanted else 1
    return (wanted, None, 0) if run >= needed else (at, wanted, run)


def test_ewma_and_pressure_states_equal_loops(spark):
    rng = random.Random(2)
    data = [(k, i, min(100.0, max(0.0, 80 + 45 * math.sin(i / 9) + rng.uniform(-25, 25)))) for k in "abcdefgh" for i in range(10 + 7 * (ord(k) - 97))]
    df = spark.createDataFrame(data, "k string, s int, v double")
    got = {r.k: r.ewma for r in A.ewma(df, ["k"], "s", "v").collect()}
    state = {r.k: r.state for r in A.pressure_states(df, ["k"], "s", "v").collect()}
    level = lambda p, margin: sum(p >= x - margin for x in (70, 85, 95))
    for k in "abcdefgh":
        e, m = None, (0, None, 0)
        for _, _, v in [d for d in data if d[0] == k]:
            e = v if e is None else 0.3 * v + 0.7 * e
            up = level(e, 0)
            m = confirmed(*m, up if up > m[0] else level(e, 5) if up < m[0] else m[0], 3)
        assert got[k] == pytest.approx(e) and state[k] == A.STATES[m[0]]
    assert len(set(state.values())) > 1


def test_degradation_moves_one_step_at_a_time(spark):
    aims = {  # by pressure: plain, circuit open, high watermark, saturated
        "normal": (0, 1, 1, 2), "constrained": (1, 2, 1, 2), "degraded": (2, 3, 2, 3), "emergency": (3, 3, 3, 4),
    }
    rng, data = random.Random(5), []
    for k in range(30):
        s, b, o = "normal", None, False
        for i in range(40):
            if rng.random() < 0.15:
                s, b, o = rng.choice([*aims, None]), rng.choice([None, "ok", "high_watermark", "saturated"]), rng.choice([True, False, None])
            data.append((k, i, s, b, o))
    df = spark.createDataFrame(data, "k int, i int, s string, b string, o boolean")
    for profile, worse, better in (("performance", 2, 3), ("strict", 1, 3), ("degraded", 2, 5)):
        got = {r.k: r.mode for r in A.degradation(df, ["k"], "i", "s", "b", "o", profile).collect()}
        for k in range(30):
            m = (0, None, 0)
            for _, _, s, b, o in [d for d in data if d[0] == k]:
                aim = aims[s or "normal"][3 if b == "saturated" else 1 if o else 2 if b == "high_watermark" else 0]
                wanted = m[0] + (aim > m[0]) - (aim < m[0])
                m = confirmed(*m, wanted, worse if wanted > m[0] else better)
            assert got[k] == A.MODES[m[0]]
    emergency = spark.createDataFrame([(0, i, "emergency") for i in range(3)], "k int, i int, s string")
    assert A.degradation(emergency, ["k"], "i", "s").first().mode == "embed_deferred"
    assert A.degradation(emergency, ["k"], "i", "s", override="paused").first().mode == "paused"


def test_conjugate_updates(spark):
    df = spark.createDataFrame([("a", i % 4 != 0) for i in range(100)] + [("b", True)], "query_class string, quality_won boolean")
    got = {r.query_class: r.alpha for r in A.adaptive_blend(df).collect()}
    assert got == pytest.approx({"a": 82 / 110, "b": 83 / 111})
    assert A.adaptive_k(spark.createDataFrame([(80.0,)] * 9, "k double")).first().k == pytest.approx((0.6 + 720 / 225) / (0.01 + 9 / 225))


def test_typing_plan_and_guard(spark):
    df = spark.createDataFrame([("s", 0, "a"), ("s", 100, "ab"), ("s", 200, "abcd"), ("s", 900, "abcdef"), ("s", 1000, "xy")], "session string, ts_ms bigint, query string")
    got = [(r.action, r.reuse, r.refine) for r in A.typing_plan(df).orderBy("ts_ms").collect()]
    assert got == [("skip", False, False), ("lexical_prefix", False, False), ("lexical_hash", True, True), ("hybrid_fast", True, False), ("lexical_prefix", False, True)]
    g = spark.createDataFrame([("k", i, 1.0 if i > 4 else 0.0) for i in range(10)], "k string, s int, e double")
    assert A.calibration_guard(g, ["k"], "s", "e", 0.5, least=5).first().state == "fallback"


def test_replay_and_sequences(spark):
    c = spark.createDataFrame([(1, ["a"]), (3, ["a"]), (3, ["a"]), (4, []), (6, ["b"])], "commit_seq bigint, operations array<string>")
    assert rows(J.replay(c, 2)) == [(1, "already_applied"), (3, "applied"), (4, "empty"), (6, "out_of_order")]


def test_changes_between_snapshots(spark):
    schema = "file_id string, size_bytes int, mtime_ns int, content_hash string"
    old = spark.createDataFrame([("d/a", 1, 1, "h1"), ("d/b", 1, 1, "h2"), ("d/c", 1, 1, "h3"), ("d/e", 1, 1, "h4"), ("d/t", 1, 1, "h5"), ("d/x", 1, 1, None)], schema)
    new = spark.createDataFrame([("d/a", 1, 1, "h1"), ("d/b", 2, 2, "h9"), ("d/c2", 1, 5, "h3"), ("z/e", 1, 5, "h4"), ("d/t", 1, 9, "h5"), ("n", 1, 1, "h7")], schema)
    got = {r.file_id: (r.change, r.moved_from) for r in J.detect_changes(old, new).collect()}
    assert got == {"d/a": ("unchanged", None), "d/b": ("modify", None), "d/c2": ("rename", "d/c"), "z/e": ("move", "d/e"), "d/t": ("touch", None), "n": ("create", None), "d/x": ("delete", None)}
    assert J.detect_changes(old.limit(0), new.limit(0)).count() == 0


def test_upserts(spark):
    schema = "doc_id string, content_hash string, updated_at int"
    store = spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], schema)
    nxt, out = J.upsert_documents(store, spark.createDataFrame([("a", "1", 2), ("b", "2", 2), ("c", "9", 2), ("c", "3", 3)], schema))
    assert rows(out) == [("a", "unchanged"), ("b", "updated"), ("c", "inserted")]
    assert rows(nxt) == [("a", "1", 1), ("b", "2", 2), ("c", "3", 3)]


JOBS = "doc_id string, embedder_id string, content_hash string, priority int, submitted_at bigint, status string, retry_count int, worker_id string, started_at bigint"


def test_job_queue_life(spark):
    jobs = spark.createDataFrame([("a", "e", "h0", 0, 1, "pending", 0, None, None), ("b", "e", "h", 5, 9, "pending", 2, None, None), ("c", "e", "h", 0, 0, "completed", 0, None, None)], JOBS)
    req = spark.createDataFrame([("a", "e", "h1", 1, 5), ("c", "e", "h", 0, 5), ("d", "hash", "h", 0, 5)], "doc_id string, embedder_id string, content_hash string, priority int, submitted_at bigint")
    after = J.enqueue(jobs, req)
    assert rows(after.select("doc_id", "content_hash", "status")) == [("a", "h1", "pending"), ("b", "h", "pending"), ("c", "h", "completed")]
    taken = J.claim(after, "w", 1, 100)
    assert [r.doc_id for r in taken.collect()] == ["b"]
    working = after.join(taken.select("doc_id"), "doc_id", "left_anti").unionByName(taken)
    bad = J.finish(working, spark.createDataFrame([("b", "e", "failed")], "doc_id string, embedder_id string, outcome string"), 200)
    assert bad.where("doc_id = 'b'").first().status == "failed"
    assert J.resurrect(bad).where("doc_id = 'b'").first().status == "pending"
    assert J.reclaim(working, 10**6).where("doc_id = 'b'").first().status == "pending"
    assert J.queue_depth(working).first().pending == 1


def test_ingest(spark):
    docs = spark.createDataFrame([("a", "Hello **there** friend"), ("b", "ok"), ("c", None)], "doc_id string, content string")
    store = spark.createDataFrame([], "doc_id string, content string, content_hash string, updated_at bigint")
    nxt, jobs, out = J.ingest(store, docs, spark.createDataFrame([], JOBS), ["fast", "hash"], 7)
    assert rows(out) == [("a", "inserted"), ("b", "skipped"), ("c", "skipped")]
    assert [r.content for r in nxt.collect()] == ["Hello there friend"] and [r.embedder_id for r in jobs.collect()] == ["fast"]


def test_audit_coverage_staleness(spark):
    f = lambda *r: spark.createDataFrame(list(r), "file_key string, content_hash string, deleted_ts bigint")
    got = rows(J.audit_index(f(("a", "1", None), ("b", "2", None), ("n", "1", None)), f(("a", "1", None), ("b", "1", None), ("v", "1", None)), f(("a", "0", None), ("o", "1", None))))
    assert got == [("a", "index_outdated", "reindex"), ("b", "catalog_outdated", "reindex"), ("n", "missing_from_catalog", "reindex"), ("o", "orphan_in_index", "remove"), ("v", "vanished", "remove")]
    ids = lambda *x: spark.createDataFrame([(i, "h") for i in x], "doc_id int, content_hash string")
    assert [J.coverage(ids(1, 2), ids(*x)).first().relation for x in ((1, 2), (1,), (1, 2, 3), (1, 3), (9,))] == ["complete", "subset", "superset", "overlap", "disjoint"]
    assert J.coverage(ids(1).limit(0), ids(1)).first().relation == "zero_live"
    assert J.staleness(ids(1, 2, 3, 4), ids(1, 2, 3)).first().action == "incremental"


def test_sessions_are_inclusive_at_the_gap(spark):
    h = spark.createDataFrame([("q", 0), ("q", 300_000), ("q", 600_001), ("r", 5)], "query string, ts_ms bigint")
    assert rows(J.search_sessions(h)) == [("q", 0, 300_000, 2), ("q", 600_001, 600_001, 1), ("r", 5, 5, 1)]


def test_file_classification(spark):
    df = spark.createDataFrame([(bytearray(b"hello\n"),), (bytearray(b"PK\x03\x04zz"),), (bytearray(b"a\x00b"),), (bytearray(b""),), (bytearray(b"\x01\x02\x03abc"),)], "content binary").coalesce(1)
    assert [r[0].kind for r in df.select(J.sniff(F.col("content"))).collect()] == ["text", "archive", "binary", "text", "corrupt"]
    p = spark.createDataFrame([("a/node_modules/x.js",), ("a/x.min.js",), ("src/x.py",), ("t.tmp",)], "p string").coalesce(1)
    assert [r[0] for r in p.select(J.artifact_action(F.col("p"), F.lit(10))).collect()] == ["skip", "metadata_only", "index_full", "skip"]


def test_windows_percentiles_and_rates(spark):
    df = spark.createDataFrame([("p", "i", 10 * n, 1, 1, 60_000 * n) for n in range(20)], "project_key string, instance_id string, latency_us bigint, result_count bigint, memory_bytes bigint, ts_ms bigint")
    for exact in (True, False):
        r = M.search_summaries(df, {"1w": M.WINDOWS["1w"]}, exact).first()
        assert (r.events, r.p50_us, r.p95_us, r.p99_us) == (20, 90, 180, 190)
    t = M.throughput(df, ["latency_us"]).first()
    assert t.latency_us_per_s == pytest.approx(190 / (19 * 60))
    assert M.throughput(df.limit(1), ["latency_us"]).first().latency_us_per_s is None
    assert df.select(M.bucket_start(F.lit(-5), 10)).first()[0] == 0


def test_anomalies_open_and_resolve(spark):
    w = spark.createDataFrame([("fleet", None, d, 100, 50 if d == 3 else 10, 100) for d in range(5)], "scope string, project_key string, window_start bigint, total bigint, failed bigint, p95_us bigint")
    now = M.anomalies(M.evaluate_slo(w))
    assert [(r.metric, r.window_start, r.severity) for r in now.collect()] == [("error_rate", 3, "critical")]
    later = M.anomalies(M.evaluate_slo(w.withColumn("failed", F.lit(10).cast("bigint"))), now)
    assert [r.state for r in later.collect()] == ["resolved"] and M.by_severity(now, 1).count() == 1


def test_instances(spark):
    s = spark.createDataFrame([("a", "running", 0), ("a", "healthy", 100), ("b", "stopped", 0)], "instance_id string, state string, ts_ms bigint")
    assert rows(M.lifecycle(s, 50_000).select("instance_id", "state")) == [("a", "stale"), ("b", "stopped")]
    chain = [(f"s{i}", f"k{j}") for i in range(30) for j in (i, i + 1)] + [("z", "kz"), (None, "k"), ("y", None)]
    got = {r.sighting: r.instance for r in M.reconcile_instances(spark.createDataFrame(chain, "sighting string, key string")).collect()}
    assert {got[f"s{i}"] for i in range(30)} == {"s0"} and got["z"] == "z" and got["y"] == "y"
    rules = spark.createDataFrame([("^web", "p1", 0.9), ("1$", "p2", 0.9), ("db", "p3", 0.5)], "pattern string, project_key string, confidence double")
    hosts = spark.createDataFrame([("web1",), ("db2",), ("x",)], "host string")
    assert rows(M.attribute_projects(hosts, rules)) == [("db2", "p3", 0.5, False), ("web1", "p1", 0.9, True), ("x", None, 0.0, False)]


def test_batches_are_admitted_whole_or_not(spark):
    e = M.simulate(spark, 3, 4)
    assert e.count() == 12 and rows(e) == rows(M.simulate(spark, 3, 4))
    known = e.where("event_id = 'e1'").select("event_id")
    assert M.admit_batch(e.union(e), known, 0, 100).count() == 11
    with pytest.raises(OverflowError):
        M.admit_batch(e, known, 95, 100)
    assert not math.isnan(M.fleet(spark.createDataFrame([("healthy", 1, 2)], "state string, documents int, pending_jobs int")).first().documents)
