"""Queries of the job queue, the document store, file classification and the ordered state machines, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import text as X
from sightline.operators import adaptive as A
from sightline.operators import evaluation as E
from sightline.operators import jobs as J
from sightline.operators import refine as R
from sightline.sources.tables import table

#: The time the queue's queries look from: 2000-01-01.
NOW = 946_684_800_000


def _jobs(spark, folder, doc: str = "o_orderkey"):
    """The orders as jobs."""
    o = table(spark, folder, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "processing").otherwise("pending")
    level = F.left("o_orderpriority", F.lit(1))
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return o.select(
        F.col(doc).alias("doc_id"), F.concat(F.lit("e"), level).alias("embedder_id"), F.sha2(F.col("o_custkey").cast("string"), 256).alias("content_hash"), level.cast("int").alias("priority"),
        state.alias("status"), F.pmod("o_custkey", F.lit(4)).cast("int").alias("retry_count"), at.alias("submitted_at"), F.when(state == "processing", at).alias("started_at"), F.when(state == "processing", "w0").alias("worker_id"), "o_totalprice",
    )


def jobs_claim(spark, folder):
    """The next 100 jobs that are due, of customers without an active one."""
    return J.claim(_jobs(spark, folder, "o_custkey"), "w1", 100, NOW).select("doc_id", "embedder_id", "priority", "submitted_at", "status", "worker_id", "started_at")


def _finished(spark, folder):
    jobs = _jobs(spark, folder)
    outcome = F.when(F.col("o_totalprice") < 100_000, "completed").when(F.col("o_totalprice") < 300_000, "failed").otherwise("skipped")
    return J.finish(jobs, jobs.select("doc_id", "embedder_id", outcome.alias("outcome")), NOW)


def jobs_finish(spark, folder):
    """Every job after its outcome: done, skipped, waiting for another try, or failed for good."""
    return _finished(spark, folder).select("doc_id", "embedder_id", "status", "retry_count", "submitted_at")


def jobs_recovery(spark, folder):
    """Jobs by state and tries after silent workers lost theirs and failed ones got another round."""
    jobs = J.resurrect(J.reclaim(_finished(spark, folder).unionByName(_jobs(spark, folder)), NOW, 86_400_000))
    return jobs.groupBy("status", "retry_count", F.col("worker_id").isNull().alias("free")).agg(F.count("*").alias("jobs"))


def jobs_enqueue(spark, folder):
    """The queue after requests for changed, unchanged and hash-embedded documents."""
    jobs = _jobs(spark, folder)
    changed = F.when(F.col("o_totalprice") > 200_000, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash"))
    wanted = jobs.select("doc_id", F.when(F.col("priority") == 5, "hash").otherwise(F.col("embedder_id")).alias("embedder_id"), changed.alias("content_hash"), "priority", F.lit(NOW).cast("bigint").alias("submitted_at"))
    return J.enqueue(jobs, wanted).select("doc_id", "embedder_id", "content_hash", "status", "submitted_at")


def jobs_depth(spark, folder):
    """Jobs of each state, and whether the queue holds enough to push back."""
    return J.queue_depth(_jobs(spark, folder))


def _stored(spark, folder):
    d = table(spark, folder, "documents")
    return d.select("doc_id", "doc_type", "lang", "title", "source", "created_at", "text", X.content_hash(F.col("text")).alias("content_hash"), F.unix_millis("created_at").alias("updated_at"))


def jobs_upsert(spark, folder):
    """What becomes of every document when all are offered to a store that lacks some and has others with another text."""
    d = _stored(spark, folder)
    store = d.where("created_at IS NOT NULL").select("doc_id", F.when(F.col("doc_type") == "note", F.lit("old")).otherwise(F.col("content_hash")).alias("content_hash"), "updated_at")
    nxt, outcomes = J.upsert_documents(store, d.select("doc_id", "content_hash", F.coalesce("updated_at", F.lit(0)).alias("updated_at")))
    return nxt.join(outcomes, "doc_id", "left").select("doc_id", "content_hash", "outcome")


def jobs_audit(spark, folder):
    """Files whose file system, catalog and index states disagree."""
    d = _stored(spark, folder).withColumn("file_key", F.col("doc_id").cast("string"))
    catalog = d.where("created_at IS NOT NULL").select("file_key", F.when(F.col("doc_type") == "code", F.lit("old")).otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("lang") == "de", F.lit(1)).alias("deleted_ts"))
    index = d.where("source IS NOT NULL").select("file_key", F.when(F.col("doc_type") == "log", F.lit("old")).otherwise(F.col("content_hash")).alias("content_hash"))
    return J.audit_index(d.where("title IS NOT NULL").select("file_key", "content_hash"), catalog, index)


def jobs_dedup(spark, folder):
    """Whether each document must be embedded, against what was embedded last."""
    d = _stored(spark, folder).where("text IS NOT NULL")
    status = d.where("title IS NOT NULL").select("doc_id", F.lit("fast").alias("embedder_id"), F.when(F.col("lang") == "en", F.col("content_hash")).otherwise(X.content_hash(F.col("title"))).alias("content_hash"))
    return J.dedup_decisions(d.select("doc_id", F.lit("fast").alias("embedder_id"), "content_hash"), status)


def jobs_pending_embeddings(spark, folder):
    """Documents the fast embedder has not embedded."""
    d = _stored(spark, folder)
    status = d.select("doc_id", F.when(F.col("lang") == "de", "slow").otherwise("fast").alias("embedder_id"), F.when(F.col("title").isNull(), "failed").otherwise("embedded").alias("status"))
    return J.pending_embeddings(d.select("doc_id"), status, "fast")


def jobs_commits(spark, folder):
    """Records of the feed by the outcome of their replay as commits beyond number 500."""
    c = table(spark, folder, "fsfs_catalog_changelog").select(F.col("stream_seq").alias("commit_seq"), F.filter(F.array("change_kind"), lambda k: k.isNotNull()).alias("operations"))
    return J.replay(c, 500).groupBy("outcome").agg(F.count("*").alias("records"), F.min("commit_seq").alias("first"), F.max("commit_seq").alias("last"))


def jobs_changelog_batch(spark, folder):
    """The next 200 records of the feed after number 700."""
    c = table(spark, folder, "fsfs_catalog_changelog").select("stream_seq").distinct()
    return J.changelog_batch(c, 700, 200)


def jobs_history(spark, folder):
    """The 20 latest different searches that begin with a."""
    h = table(spark, folder, "search_events").where("ts_ms IS NOT NULL AND query_hash IS NOT NULL").select(F.col("query_hash").alias("query"), "ts_ms")
    return J.history_with_prefix(h, "a", 20)


def jobs_index_report(spark, folder):
    """Documents that an index build cannot take as they are."""
    return J.index_report(table(spark, folder, "documents"))


def jobs_sniff(spark, folder):
    """What each document's bytes look like."""
    d = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", J.sniff(F.encode("text", "UTF-8")).alias("s"))
    return d.select("doc_id", "s.nulls", F.round("s.non_printable", 6).alias("non_printable"), F.round("s.high", 6).alias("high"), "s.kind", "s.action")


def jobs_artifacts(spark, folder):
    """What is indexed of files named after the documents."""
    d = table(spark, folder, "documents").select("doc_id", "n_chars", F.concat(F.coalesce("source", F.lit("src")), F.lit("/"), F.coalesce("doc_type", F.lit("x.zip")), F.when(F.col("doc_type") == "log", ".log").when(F.col("doc_type") == "commit", ".lock").when(F.col("doc_type") == "raw", ".tmp").otherwise(".md")).alias("path"))
    return d.select("doc_id", J.artifact_action(F.col("path"), F.col("n_chars") * 100_000).alias("action"))


def jobs_discovered(spark, folder):
    """Documents below the roots that are included."""
    d = table(spark, folder, "documents").select("doc_id", F.col("source").alias("path"))
    return J.discovered(d, ["workspace/", "chat"], ["workspace/atlas"])


def jobs_shadow(spark, folder):
    """How far the lexical and the semantic order of each query agree."""
    c = table(spark, folder, "score_components").where("raw_score IS NOT NULL AND NOT isnan(raw_score) AND abs(raw_score) < double('infinity')").groupBy("query_id", "doc_id", "source").agg(F.max("raw_score").alias("score"))
    from pyspark.sql import Window

    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "doc_id")) - 1)
    return J.shadow_compare(c.where("source = 'lexical'"), c.where("source = 'semantic_fast'"), 0.05)


def jobs_conversation(spark, folder):
    """Identity, preview and title prefixes of the documents as messages."""
    m = table(spark, folder, "documents").select(F.col("source").alias("source_id"), F.lit(7).alias("conversation_id"), F.col("doc_id").alias("msg_idx"), "title", F.col("text").alias("content"))
    return J.conversation_columns(m).select("identity", "preview", "title_prefix")


# -- ordered state machines ------------------------------------------------------------------------


def _steps(spark, folder):
    return table(spark, folder, "events").select("user_id", "event_id", "event_type", "value", F.least(F.col("value"), F.lit(100.0)).alias("score"))


def online_pressure_state(spark, folder):
    """Smoothed value and pressure state of each user after their events, under the strict profile."""
    e = _steps(spark, folder)
    return A.ewma(e, ["user_id"], "event_id", "score").select("user_id", F.round("ewma", 9).alias("ewma")).join(A.pressure_states(e, ["user_id"], "event_id", "score", "strict"), "user_id")


def online_degradation(spark, folder):
    """Mode of each user after their events as signals."""
    state = F.when(F.col("value") >= 60, "emergency").when(F.col("value") >= 30, "degraded").when(F.col("value") >= 15, "constrained").otherwise("normal")
    back = F.when(F.col("event_type") == "error", "saturated").when(F.col("event_type") == "view", "high_watermark").otherwise("normal")
    e = _steps(spark, folder).select("user_id", "event_id", state.alias("state"), back.alias("back"), (F.col("event_type") == "click").alias("open"))
    return A.degradation(e, ["user_id"], "event_id", "state", "back", "open", "strict")


def online_guard(spark, folder):
    """Whether each user's errors are trusted."""
    return A.calibration_guard(_steps(spark, folder), ["user_id"], "event_id", "score", 30.0, least=10, breaches=4)


def online_alpha(spark, folder):
    """Adaptive error level of each user after their events."""
    e = _steps(spark, folder).select("user_id", "event_id", (F.col("event_type") == "error").cast("double").alias("error"))
    return E.adaptive_alpha(e, "event_id", "error", 0.2, 0.05, ["user_id"]).select("user_id", F.round("alpha", 9).alias("alpha"))


def online_huber(spark, folder):
    """Streaming robust mean of each user's values."""
    return E.huber_mean(_steps(spark, folder), ["user_id"], "event_id", "value", 5.0, 0.1).select("user_id", F.round("huber", 9).alias("huber"))


def online_feedback(spark, folder):
    """Boost of each user's document after clicks, purchases and errors."""
    kind = F.when(F.col("event_type") == "click", "click").when(F.col("event_type") == "purchase", "select").when(F.col("event_type") == "error", "skip").when(F.col("event_type") == "view", "dwell").otherwise("other")
    s = _steps(spark, folder).select(F.col("user_id").alias("doc_id"), kind.alias("kind"), F.col("value").alias("duration_secs"), (F.col("event_id") * 3600.0).alias("ts"))
    return R.feedback_boosts(s, 40_000_000.0).select("doc_id", F.round("boost", 9).alias("boost"))


def online_typing(spark, folder):
    """What each keystroke of the evaluation queries starts: their first eight characters typed one by one."""
    q = table(spark, folder, "eval_items").where("query IS NOT NULL")
    keys = q.select("item_id", F.posexplode(F.sequence(F.lit(1), F.lit(8))).alias("at", "n"), "query").select(F.col("item_id").alias("session"), (F.col("at") * F.lit(120) + F.when(F.col("at") >= 5, 400).otherwise(0)).cast("bigint").alias("ts_ms"), F.left("query", F.col("n")).alias("query"))
    return A.typing_plan(keys).select("session", "ts_ms", "action", "reuse", "refine")


def online_loss(spark, folder):
    """The action of least expected loss for each event."""
    e = _steps(spark, folder).select("event_id", F.col("value").alias("loss_wait"), F.lit(8.0).alias("loss_refine"), (20 - F.col("value")).alias("loss_skip"), (F.col("event_type") != "signup").alias("calibrated"))
    return A.least_expected_loss(e, ["wait", "refine", "skip"]).select("event_id", "action")


# -- reports -----------------------------------------------------------------------------------------


def eval_calibrators(spark, folder):
    """Temperature and Platt scaled scores of all hits, and the value of a step function fitted by pooling violators."""
    e = _steps(spark, folder).select("event_id", F.floor(F.least(F.col("value"), F.lit(60.0))).cast("double").alias("score"), (F.col("event_type").isin("purchase", "click")).cast("double").alias("won"))
    # the sums of each score are few: scores are whole numbers up to 60
    sums = e.groupBy("score").agg(F.sum("won").alias("won"), F.count("*").alias("n")).collect()
    steps = E.fit_isotonic([(r.score, y) for r in sums for y in [1.0] * int(r.won) + [0.0] * int(r.n - r.won)])
    return e.select("event_id", F.round(E.temperature(F.col("score"), 7.0), 9).alias("temperature"), F.round(E.platt(F.col("score"), 0.3, -2.0), 9).alias("platt"), F.round(E.isotonic(F.col("score"), steps), 9).alias("isotonic"))


def eval_calibration_summary(spark, folder):
    """Calibration error and Brier score of the events' scores before and after Platt scaling."""
    e = _steps(spark, folder).select((F.col("value") / 50).alias("raw"), (F.col("event_type") == "purchase").cast("double").alias("won"))
    c = E.calibration_summary(e, "raw", E.platt(F.col("raw"), 0.5, -1.5), "won")
    return c.select("stage", F.round("ece", 9).alias("ece"), F.round("brier", 9).alias("brier"), "n")


def eval_interval(spark, folder):
    """The interval that holds nine of ten of each user's next values."""
    return E.conformal_interval(_steps(spark, folder), 0.1, "value", ["user_id"])


def eval_states(spark, folder):
    """Counts, means, ends, and whether quantiles and numbers of different values lie near the true ones, from the states of users merged to kinds of events."""
    e = _steps(spark, folder)
    parts = E.metric_state(e, ["event_type", "user_id"], "value")
    m = E.state_metrics(E.merged_state(parts, ["event_type"]), ["event_type"], {"p50": 0.5, "p95": 0.95})
    ranks = e.join(m, "event_type").groupBy("event_type").agg(
        F.first("n").alias("n"), F.round(F.first("mean"), 6).alias("mean"), F.first("least").alias("least"), F.first("most").alias("most"),
        (F.abs(F.avg((F.col("value") <= F.col("p50")).cast("double")) - 0.5) < 0.01).alias("p50_near"), (F.abs(F.avg((F.col("value") <= F.col("p95")).cast("double")) - 0.95) < 0.01).alias("p95_near"),
        (F.abs(F.first("distinct") / F.count_distinct("value") - 1) < 0.05).alias("distinct_near"),
    )
    return ranks


def eval_mondrian(spark, folder):
    """The rank that holds an answer nine times in ten, by phase, and the p-value of rank 3."""
    h = table(spark, folder, "hit_explanations").select("phase", F.col("rank_after").alias("rank")).where("phase IS NOT NULL")
    p = E.conformal_p_value(h.where("rank IS NOT NULL"), 3).first().p
    return E.mondrian_required_k(h, 0.1, "phase", 400).withColumn("p", F.round(F.lit(p), 9))


def eval_budgets(spark, folder):
    """Kinds of events against their budgets."""
    e = _steps(spark, folder)
    budget = e.select(F.col("event_type").alias("phase"), (F.length("event_type") * 2).cast("double").alias("budget_ms")).distinct()
    b = E.phase_budgets(e.select(F.col("event_type").alias("phase"), F.col("value").alias("ms")), budget)
    return b.select("phase", "n", "over", F.round("overshoot", 4).alias("overshoot"), F.round("utilisation", 6).alias("utilisation"))


def eval_opportunities(spark, folder):
    """Parts by impact, confidence and ease."""
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("name"), F.col("p_retailprice").alias("impact"), F.col("p_size").alias("confidence"), F.length("p_name").alias("ease"))
    return E.opportunities(p).select("name", F.round("ice", 6).alias("ice"))


def eval_gate(spark, folder):
    """Whether mean values of each kind of event lie within their limits."""
    m = _steps(spark, folder).groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 9).alias("value"))
    return E.quality_gate(m, {"error": (None, 20.0), "click": (25.0, None), "view": (0.0, 100.0)})


def eval_trimmed(spark, folder):
    """Number and sum of each user's values within and outside their fences."""
    e = _steps(spark, folder).select("user_id", "value")
    kept = E.trimmed(e, "value", ["user_id"]).groupBy("user_id").agg(F.count("*").alias("kept"), F.round(F.sum("value"), 4).alias("total"))
    out = E.outliers(e, "value", ["user_id"]).groupBy("user_id").agg(F.count("*").alias("outside"))
    return kept.join(out, "user_id", "left").select("user_id", "kept", "total", F.coalesce("outside", F.lit(0)).alias("outside"))


QUERIES = {f.__name__: f for f in (
    jobs_claim, jobs_finish, jobs_recovery, jobs_enqueue, jobs_depth, jobs_upsert, jobs_audit, jobs_dedup, jobs_pending_embeddings, jobs_commits, jobs_changelog_batch, jobs_history, jobs_index_report, jobs_sniff, jobs_artifacts,
    jobs_discovered, jobs_shadow, jobs_conversation,
    online_pressure_state, online_degradation, online_guard, online_alpha, online_huber, online_feedback, online_typing, online_loss,
    eval_calibrators, eval_calibration_summary, eval_interval, eval_states, eval_mondrian, eval_budgets, eval_opportunities, eval_gate, eval_trimmed,
)}

_JOBS = """
    j AS (SELECT o_orderkey, o_custkey, 'e' || left(o_orderpriority, 1) AS embedder_id, sha256(o_custkey::VARCHAR) AS content_hash, left(o_orderpriority, 1)::INT AS priority,
                 CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'processing' ELSE 'pending' END AS status, (o_custkey % 4)::INT AS retry_count, epoch_ms(o_orderdate) AS submitted_at, o_totalprice FROM orders)"""
_FINISHED = f"""{_JOBS},
    o AS (SELECT *, CASE WHEN o_totalprice < 100000 THEN 'completed' WHEN o_totalprice < 300000 THEN 'failed' ELSE 'skipped' END AS outcome FROM j),
    f AS (SELECT o_orderkey AS doc_id, embedder_id, submitted_at AS was, CASE WHEN status <> 'processing' THEN status WHEN outcome = 'failed' AND retry_count + 1 < 3 THEN 'pending' ELSE outcome END AS status,
                 retry_count + (status = 'processing' AND outcome = 'failed')::INT AS retry_count, status AS before,
                 CASE WHEN status = 'processing' AND outcome = 'failed' AND retry_count + 1 < 3 THEN 946684800000 + least(1000 * pow(2, retry_count), 30000)::BIGINT ELSE submitted_at END AS submitted_at FROM o)"""
_STORED = "d AS (SELECT doc_id, doc_type, lang, title, source, created_at, text, sha256(text) AS h FROM documents)"
_STEPS = "s AS (SELECT user_id, event_id, event_type, value, least(value, 100.0) AS score, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"
_LAST = "SELECT user_id, max(n) AS n FROM s GROUP BY 1"


def _fold(start: str, step: str, out: str) -> str:
    """SQL that steps through each user's events: ``start`` and ``step`` give the state's columns, of x (event) and r (state)."""
    return f"""
        WITH RECURSIVE {_STEPS}, r AS (
            SELECT user_id, n, {start} FROM s x WHERE n = 1
            UNION ALL SELECT x.user_id, x.n, {step} FROM r JOIN s x ON x.user_id = r.user_id AND x.n = r.n + 1
        ) SELECT user_id, {out} FROM r JOIN ({_LAST}) USING (user_id, n)"""


def _machine(wanted: str, needed: str) -> tuple[str, str]:
    """First and later (at, pending, run) of a machine that moves once the same was wanted ``needed`` times in a row."""
    run = f"CASE WHEN r.pending = ({wanted}) THEN r.run + 1 ELSE 1 END"
    step = f"""CASE WHEN ({wanted}) <> r.held AND {run} >= {needed} THEN ({wanted}) ELSE r.held END, CASE WHEN ({wanted}) = r.held OR {run} >= {needed} THEN -1 ELSE ({wanted}) END,
        CASE WHEN ({wanted}) = r.held OR {run} >= {needed} THEN 0 ELSE {run} END"""
    begin = step.replace("r.held", "0").replace("r.pending", "-1").replace("r.run", "0")
    return begin, step


def _pressure_sql() -> str:
    level = lambda e, m: f"(({e}) >= {60 - m})::INT + (({e}) >= {75 - m})::INT + (({e}) >= {90 - m})::INT"

    def wanted(e: str) -> str:
        return f"CASE WHEN {level(e, 0)} > r.held THEN {level(e, 0)} WHEN {level(e, 0)} < r.held THEN {level(e, 5)} ELSE r.held END"

    e = "(0.3::DOUBLE * x.score + 0.7::DOUBLE * r.e)"
    begin, step = _machine(wanted("x.score"), "3")[0], _machine(wanted(e), "3")[1]
    return _fold(f"x.score::DOUBLE AS e, {begin}", f"{e}, {step}", "round(e, 9) AS ewma, ['normal', 'constrained', 'degraded', 'emergency'][held + 1] AS state").replace("r AS (", "r(user_id, n, e, held, pending, run) AS (")


def _degradation_sql() -> str:
    aims = {"normal": (0, 1, 1, 2), "constrained": (1, 2, 1, 2), "degraded": (2, 3, 2, 3), "emergency": (3, 3, 3, 4)}
    of = {k: f"CASE x.event_type WHEN 'error' THEN {v[3]} WHEN 'click' THEN {v[1]} WHEN 'view' THEN {v[2]} ELSE {v[0]} END" for k, v in aims.items()}
    aim = f"CASE WHEN x.value >= 60 THEN {of['emergency']} WHEN x.value >= 30 THEN {of['degraded']} WHEN x.value >= 15 THEN {of['constrained']} ELSE {of['normal']} END"
    wanted = f"r.held + sign(({aim}) - r.held)::INT"
    begin, step = _machine(wanted, f"CASE WHEN ({wanted}) > r.held THEN 1 ELSE 3 END")
    return _fold(begin, step, "['normal', 'embed_deferred', 'lexical_only', 'metadata_only', 'paused'][held + 1] AS mode").replace("r AS (", "r(user_id, n, held, pending, run) AS (")


ORACLE = {
    "jobs_claim": f"""
        WITH {_JOBS} SELECT o_custkey AS doc_id, embedder_id, priority, submitted_at, 'processing' AS status, 'w1' AS worker_id, 946684800000 AS started_at FROM j
        WHERE status = 'pending' AND submitted_at <= 946684800000 AND NOT EXISTS (SELECT 1 FROM j a WHERE a.o_custkey = j.o_custkey AND a.embedder_id = j.embedder_id AND a.status = 'processing')
        ORDER BY priority DESC, submitted_at, o_custkey, embedder_id LIMIT 100""",
    "jobs_finish": f"WITH {_FINISHED} SELECT doc_id, embedder_id, status, retry_count, submitted_at FROM f",
    "jobs_recovery": f"""
        WITH {_FINISHED}, u AS (SELECT status, retry_count, before, was FROM f UNION ALL SELECT status, retry_count, status, submitted_at FROM j),
        c AS (SELECT CASE WHEN status = 'processing' AND was < 946684800000 - 86400000 THEN 'pending' ELSE status END AS status, retry_count,
                     before <> 'processing' OR (status = 'processing' AND was < 946684800000 - 86400000) AS free FROM u)
        SELECT CASE status WHEN 'failed' THEN 'pending' ELSE status END AS status, CASE status WHEN 'failed' THEN 0 ELSE retry_count END AS retry_count, free, count(*) AS jobs FROM c GROUP BY ALL""",
    "jobs_enqueue": f"""
        WITH {_JOBS}, w AS (SELECT o_orderkey AS doc_id, embedder_id, content_hash || CASE WHEN o_totalprice > 200000 THEN 'x' ELSE '' END AS content_hash FROM j WHERE priority <> 5),
        n AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.o_orderkey = w.doc_id AND j.embedder_id = w.embedder_id AND j.content_hash = w.content_hash))
        SELECT o_orderkey AS doc_id, embedder_id, content_hash, status, submitted_at FROM j
        WHERE NOT (status = 'pending' AND EXISTS (SELECT 1 FROM n WHERE n.doc_id = o_orderkey AND n.embedder_id = j.embedder_id))
        UNION ALL SELECT doc_id, embedder_id, content_hash, 'pending', 946684800000 FROM n""",
    "jobs_depth": f"""
        WITH {_JOBS} SELECT count_if(status = 'pending') AS pending, count_if(status = 'processing') AS processing, count_if(status = 'completed') AS completed, 0::BIGINT AS failed, 0::BIGINT AS skipped,
        count_if(status = 'pending') >= 10000 AS backpressured FROM j""",
    "jobs_upsert": f"""
        WITH {_STORED} SELECT doc_id, h AS content_hash, CASE WHEN created_at IS NULL THEN 'inserted' WHEN (CASE WHEN doc_type = 'note' THEN 'old' ELSE h END) IS NOT DISTINCT FROM h THEN 'unchanged' ELSE 'updated' END AS outcome FROM d""",
    "jobs_audit": f"""
        WITH {_STORED}, k AS (SELECT doc_id::VARCHAR AS file_key, title IS NOT NULL AS fs, created_at IS NOT NULL AND lang IS DISTINCT FROM 'de' AS cat, source IS NOT NULL AS idx, h AS fh,
            CASE WHEN doc_type = 'code' THEN 'old' ELSE h END AS ch, CASE WHEN doc_type = 'log' THEN 'old' ELSE h END AS ih FROM d),
        f AS (SELECT file_key, CASE WHEN fs AND NOT cat THEN 'missing_from_catalog' WHEN NOT fs AND cat THEN 'vanished' WHEN fs AND cat AND fh IS DISTINCT FROM ch THEN 'catalog_outdated'
            WHEN cat AND NOT idx THEN 'missing_from_index' WHEN NOT cat AND idx THEN 'orphan_in_index' WHEN cat AND idx AND ch IS DISTINCT FROM ih THEN 'index_outdated' END AS finding FROM k)
        SELECT file_key, finding, CASE WHEN finding IN ('vanished', 'orphan_in_index') THEN 'remove' ELSE 'reindex' END AS action FROM f WHERE finding IS NOT NULL""",
    "jobs_dedup": f"""
        WITH {_STORED} SELECT doc_id, 'fast' AS embedder_id, CASE WHEN title IS NULL THEN 'new' WHEN (CASE WHEN lang = 'en' THEN h ELSE sha256(title) END) = h THEN 'skip' ELSE 'changed' END AS decision FROM d WHERE text IS NOT NULL""",
    "jobs_pending_embeddings": "SELECT doc_id FROM documents WHERE lang IS NOT DISTINCT FROM 'de' OR title IS NULL",
    "jobs_commits": """
        WITH c AS (SELECT stream_seq, max((change_kind IS NOT NULL)::INT) AS ops FROM fsfs_catalog_changelog WHERE stream_seq IS NOT NULL GROUP BY 1),
        n AS (SELECT stream_seq, row_number() OVER (ORDER BY stream_seq) AS place FROM c WHERE stream_seq > 500),
        g AS (SELECT min(stream_seq) AS gap FROM n WHERE stream_seq <> 500 + place),
        o AS (SELECT stream_seq, CASE WHEN stream_seq <= 500 THEN 'already_applied' WHEN stream_seq >= gap THEN 'out_of_order' WHEN ops = 0 THEN 'empty' ELSE 'applied' END AS outcome FROM c, g)
        SELECT outcome, count(*) AS records, min(stream_seq) AS first, max(stream_seq) AS last FROM o GROUP BY 1""",
    "jobs_changelog_batch": "SELECT DISTINCT stream_seq FROM fsfs_catalog_changelog WHERE stream_seq > 700 ORDER BY 1 LIMIT 200",
    "jobs_history": "SELECT query_hash AS query, max(ts_ms) AS ts_ms FROM search_events WHERE ts_ms IS NOT NULL AND starts_with(query_hash, 'a') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "jobs_index_report": "SELECT doc_id, 'no text' AS problem FROM documents WHERE text IS NULL OR trim(text, ' ') = ''",
    "jobs_sniff": """
        WITH b AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n, regexp_extract_all(hex(encode(text)), '..') AS p FROM documents WHERE text IS NOT NULL),
        c AS (SELECT doc_id, h, n, len(list_filter(p, lambda x: x = '00')) AS nulls, len(list_filter(p, lambda x: regexp_matches(x, '^(0[0-8BCEF]|1.|7F)$'))) / greatest(n, 1) AS odd,
                     len(list_filter(p, lambda x: x[1] >= '8')) / greatest(n, 1) AS high FROM b),
        k AS (SELECT *, CASE WHEN n = 0 THEN 'text' WHEN regexp_matches(h, '^(504B0304|1F8B|377ABCAF|425A68|FD377A)') THEN 'archive' WHEN nulls > 0 THEN 'binary' WHEN odd > 0.3 THEN 'corrupt' WHEN odd > 0.05 THEN 'partial' ELSE 'text' END AS kind FROM c)
        SELECT doc_id, nulls::INT AS nulls, round(odd, 6) AS non_printable, round(high, 6) AS high, kind, CASE kind WHEN 'text' THEN 'index' WHEN 'partial' THEN 'index_partial' WHEN 'corrupt' THEN 'quarantine' ELSE 'skip' END AS action FROM k""",
    "jobs_artifacts": """
        WITH p AS (SELECT doc_id, n_chars * 100000 AS size, coalesce(source, 'src') || '/' || coalesce(doc_type, 'x.zip') || CASE doc_type WHEN 'log' THEN '.log' WHEN 'commit' THEN '.lock' WHEN 'raw' THEN '.tmp' ELSE '.md' END AS path FROM documents)
        SELECT doc_id, CASE WHEN regexp_matches(path, '(\\.(tmp|swp|part)|~)$|(^|/)\\.(cache|git)(/|$)') THEN 'skip'
            WHEN regexp_matches(path, '\\.(zip|tar|gz|bz2|xz|7z|jar)$|(\\.min\\.(js|css)|\\.lock|_pb2\\.py|\\.generated\\.[a-z]+)$') OR (regexp_matches(path, '\\.log(\\.\\d+)?$') AND size > 50000000) THEN 'metadata_only'
            WHEN regexp_matches(path, '(^|/)(node_modules|vendor|third_party|\\.venv|target|dist)(/|$)') THEN 'skip' ELSE 'index_full' END AS action FROM p""",
    "jobs_discovered": """
        SELECT doc_id, source AS path FROM documents WHERE (starts_with(source, 'workspace/') AND NOT starts_with(source, 'workspace/atlas')) OR starts_with(source, 'chat')""",
    "jobs_shadow": """
        WITH c AS (SELECT query_id, doc_id, source, max(raw_score) AS score FROM score_components WHERE NOT isnan(raw_score) AND NOT isinf(raw_score) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS rank FROM c),
        b AS (SELECT coalesce(a.query_id, z.query_id) AS query_id, a.rank IS NOT DISTINCT FROM z.rank AS same, coalesce(abs(a.score - z.score) <= 0.05 * greatest(abs(a.score), abs(z.score), 1e-12), false) AS near
              FROM (FROM r WHERE source = 'lexical') a FULL JOIN (FROM r WHERE source = 'semantic_fast') z ON a.query_id = z.query_id AND a.doc_id = z.doc_id)
        SELECT query_id, CASE WHEN bool_and(same) THEN 'rank_exact' WHEN bool_and(near) THEN 'score_epsilon' ELSE 'diverged' END AS verdict FROM b GROUP BY 1""",
    "jobs_conversation": """
        WITH w AS (SELECT *, regexp_extract_all(replace(lower(title), 'ς', 'σ'), '[\\p{L}\\p{N}]+') AS words FROM documents)
        SELECT coalesce(source, '') || ':7:' || doc_id AS identity, left(text, 200) || CASE WHEN length(text) > 200 THEN '…' ELSE '' END AS preview,
            coalesce(array_to_string(flatten(list_transform(list_filter(words, lambda x: length(x) >= 2), lambda x: list_transform(range(2, least(length(x), 20) + 1), lambda n: left(x, n)))), ' '), '') AS title_prefix FROM w""",
    "online_pressure_state": _pressure_sql(),
    "online_degradation": _degradation_sql(),
    "online_guard": _fold(
        "0 AS run, false AS fell", "CASE WHEN x.n > 10 AND x.score > 30 THEN r.run + 1 ELSE 0 END, r.fell OR (CASE WHEN x.n > 10 AND x.score > 30 THEN r.run + 1 ELSE 0 END) >= 4",
        "CASE WHEN fell THEN 'fallback' WHEN n < 10 THEN 'watching' ELSE 'trusted' END AS state"),
    "online_alpha": _fold(
        "least(greatest(0.2::DOUBLE + 0.05::DOUBLE * (0.2 - (x.event_type = 'error')::INT), 0), 1) AS a", "least(greatest(r.a + 0.05::DOUBLE * (0.2 - (x.event_type = 'error')::INT), 0), 1)", "round(a, 9) AS alpha"),
    "online_huber": _fold("x.value AS e", "r.e + 0.1::DOUBLE * least(greatest(x.value - r.e, -5.0), 5.0)", "round(e, 9) AS huber"),
    "online_feedback": "SELECT user_id AS doc_id, boost FROM (" + _fold(
        "least(greatest(1 + 0.1::DOUBLE * ({w}), 0.5), 2) AS b, x.event_id * 3600.0::DOUBLE AS t".replace("{w}", "CASE x.event_type WHEN 'click' THEN 1.0 WHEN 'purchase' THEN 3.0 WHEN 'error' THEN -0.5 WHEN 'view' THEN CASE WHEN x.value > 30 THEN 2.0 ELSE 0.5 END ELSE 0.0 END"),
        "least(greatest(1 + (r.b - 1) * exp(-ln(2) * (x.event_id * 3600.0::DOUBLE - r.t) / (168.0 * 3600)) + 0.1::DOUBLE * (CASE x.event_type WHEN 'click' THEN 1.0 WHEN 'purchase' THEN 3.0 WHEN 'error' THEN -0.5 WHEN 'view' THEN CASE WHEN x.value > 30 THEN 2.0 ELSE 0.5 END ELSE 0.0 END), 0.5), 2), x.event_id * 3600.0::DOUBLE",
        "round(1 + (b - 1) * exp(-ln(2) * (40000000.0 - t) / (168.0 * 3600)), 9) AS boost") + ")",
    "online_typing": """
        WITH k AS (SELECT item_id AS session, (n - 1) * 120 + CASE WHEN n >= 6 THEN 400 ELSE 0 END AS ts_ms, left(query, n) AS query FROM eval_items, range(1, 9) r(n) WHERE query IS NOT NULL),
        l AS (SELECT *, length(trim(query, ' ')) AS n, lag(query) OVER w AS last, lead(ts_ms) OVER w AS following FROM k WINDOW w AS (PARTITION BY session ORDER BY ts_ms))
        SELECT session, ts_ms, CASE WHEN n < 2 THEN 'skip' WHEN n = 2 THEN 'lexical_prefix' WHEN n <= 4 THEN 'lexical_hash' ELSE 'hybrid_fast' END AS action,
            coalesce(starts_with(query, last) AND length(last) >= 2, false) AS reuse, n >= 2 AND coalesce(following - ts_ms >= 300, true) AS refine FROM l""",
    "online_loss": """
        SELECT event_id, CASE WHEN event_type = 'signup' THEN 'wait' WHEN value <= least(8.0, 20 - value) THEN 'wait' WHEN 8.0 <= 20 - value THEN 'refine' ELSE 'skip' END AS action FROM events""",
    "eval_calibrators": """
        WITH e AS (SELECT event_id, floor(least(value, 60.0)) AS score, (event_type IN ('purchase', 'click'))::INT AS won FROM events),
        p AS (SELECT score, sum(won) AS won, count(*) AS n FROM e GROUP BY 1),
        c AS (SELECT score, sum(won) OVER (ORDER BY score) AS w, sum(n) OVER (ORDER BY score) AS m, sum(won) OVER (ORDER BY score) - won AS w0, sum(n) OVER (ORDER BY score) - n AS m0 FROM p),
        lows AS (SELECT i.score, a.score AS first, min((b.w - a.w0) / (b.m - a.m0)) AS low FROM c i JOIN c a ON a.score <= i.score JOIN c b ON b.score >= i.score GROUP BY ALL),
        f AS (SELECT score, max(low) AS fitted FROM lows GROUP BY 1)
        SELECT event_id, round(1 / (1 + exp(-score / 7.0)), 9) AS temperature, round(1 / (1 + exp(-(0.3::DOUBLE * score - 2.0))), 9) AS platt, round(fitted, 9) AS isotonic FROM e JOIN f USING (score)""",
    "eval_calibration_summary": """
        WITH e AS (SELECT value / 50 AS raw, (event_type = 'purchase')::INT AS y FROM events), p AS (SELECT 'before' AS stage, least(greatest(raw, 0), 1) AS p, y FROM e UNION ALL SELECT 'after', 1 / (1 + exp(-(0.5::DOUBLE * raw - 1.5))), y FROM e),
        b AS (SELECT stage, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS c, avg(y) AS a, sum((p - y) * (p - y)) AS b FROM p GROUP BY ALL)
        SELECT stage, round(sum(n * abs(c - a)) / sum(n), 9) AS ece, round(sum(b) / sum(n), 9) AS brier, sum(n)::BIGINT AS n FROM b GROUP BY 1""",
    "eval_interval": """
        WITH l AS (SELECT user_id, list(value ORDER BY value) AS v, count(*) AS n FROM events GROUP BY 1)
        SELECT user_id, CASE WHEN floor((n + 1) * 0.05::DOUBLE + 1e-9) >= 1 THEN v[floor((n + 1) * 0.05::DOUBLE + 1e-9)::INT] END AS low, CASE WHEN ceil((n + 1) * 0.95::DOUBLE - 1e-9) <= n THEN v[ceil((n + 1) * 0.95::DOUBLE - 1e-9)::INT] END AS high, n FROM l""",
    "eval_states": """
        SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, true AS p50_near, true AS p95_near, true AS distinct_near FROM events GROUP BY 1""",
    "eval_mondrian": """
        WITH h AS (SELECT phase, rank_after AS rank FROM hit_explanations WHERE phase IS NOT NULL AND rank_after IS NOT NULL),
        o AS (SELECT rank, row_number() OVER (ORDER BY rank) AS i, count(*) OVER () AS n FROM h), g AS (SELECT min(rank) FILTER (i >= ceil((n + 1) * 0.9::DOUBLE - 1e-9)) AS k FROM o),
        q AS (SELECT phase, rank, row_number() OVER (PARTITION BY phase ORDER BY rank) AS i, count(*) OVER (PARTITION BY phase) AS n FROM h)
        SELECT phase, CASE WHEN max(n) >= 400 THEN min(rank) FILTER (i >= ceil((n + 1) * 0.9::DOUBLE - 1e-9)) ELSE (SELECT k FROM g) END AS required_k,
            round((SELECT (count_if(rank >= 3) + 1) / (count(*) + 1) FROM h), 9) AS p FROM q GROUP BY phase""",
    "eval_budgets": """
        SELECT event_type AS phase, count(*) AS n, count_if(value > 2.0 * length(event_type)) AS over, round(sum(greatest(value - 2.0 * length(event_type), 0)), 4) AS overshoot, round(avg(value / (2.0 * length(event_type))), 6) AS utilisation FROM events GROUP BY 1""",
    "eval_opportunities": "SELECT p_partkey AS name, round(p_retailprice * p_size * length(p_name) / 1000, 6) AS ice FROM part",
    "eval_gate": """
        WITH m AS (SELECT event_type AS metric, round(avg(value), 9) AS value FROM events GROUP BY 1)
        SELECT metric, value, NOT (metric = 'error' AND value > 20) AND NOT (metric = 'click' AND value < 25) AND NOT (metric = 'view' AND (value < 0 OR value > 100)) AS passed FROM m""",
    "eval_trimmed": """
        WITH q AS (SELECT user_id, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, count(*) AS n FROM events GROUP BY 1),
        i AS (SELECT user_id, value, n < 4 OR value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) AS inside FROM events JOIN q USING (user_id))
        SELECT user_id, count_if(inside) AS kept, round(sum(value) FILTER (inside), 4) AS total, count_if(NOT inside) AS outside FROM i GROUP BY 1""",
}
