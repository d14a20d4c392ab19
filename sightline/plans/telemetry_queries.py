"""Queries of telemetry, jobs and incremental indexing, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import text as X
from sightline.operators import jobs as J
from sightline.operators import telemetry as M
from sightline.sources.tables import table


def _events(spark, folder):
    return M.distinct_events(table(spark, folder, "search_events"))


def _every(spark, folder):
    """All events; a latency that was not measured is null, which percentiles pass over."""
    return _events(spark, folder).withColumn("latency_us", F.expr("CASE WHEN latency_us > 0 THEN latency_us END"))


def _failed():
    return F.coalesce(F.lower(F.trim("phase")) == "refinement_failed", F.lit(False))


def _summaries(events):
    s = M.search_summaries(events)
    return s.select("project_key", "instance_id", "window", "window_start", "events", "p50_us", "p95_us", "p99_us", F.round("avg_results", 6).alias("avg_results"))


def tele_summaries(spark, folder):
    """Statistics of every project, instance and window size, over all events."""
    return _summaries(_every(spark, folder))


def tele_latest_summaries(spark, folder):
    """The newest day and week of every project and instance."""
    s = M.latest_summaries(M.search_summaries(_every(spark, folder), {"24h": M.DAY, "1w": 7 * M.DAY}))
    return s.select("project_key", "instance_id", "window", "window_start", "events", "p95_us")


def _slo(spark, folder):
    return M.evaluate_slo(M.slo_windows(_every(spark, folder), _failed(), M.DAY), "24h", objective=0.95)


def tele_slo(spark, folder):
    """Failures, latency and health per project and fleet, by day, over all events."""
    rounded = [F.round(c, 9).alias(c) for c in ("error_rate", "budget_consumed", "latency_ratio")]
    return _slo(spark, folder).select("scope", "project_key", "window_start", "total", "failed", "p95_us", *rounded, "health", "reason")


def tele_anomalies(spark, folder):
    """Fleet and project days whose errors or latencies are twice those before, over all events."""
    a = M.anomalies(M.evaluate_slo(M.slo_windows(_every(spark, folder), _failed(), M.DAY), "24h"))
    return a.select("scope", "project_key", "metric", "window_start", F.round("observed", 9).alias("observed"), F.round("baseline", 9).alias("baseline"), "severity")


def tele_open_anomalies(spark, folder):
    """Anomalies that opened and that were resolved, where those with a small deviation were open before and only great ones count now, worst first."""
    slo = _slo(spark, folder)
    before, now = M.anomalies(slo), M.anomalies(slo, factor=3.0)
    both = M.anomalies(slo, before, 3.0)
    worst = M.by_severity(now, 25).select("scope", "project_key", "metric", "window_start", F.lit(True).alias("listed"))
    key = ["scope", "metric", "window_start"]
    named = [both[k] == worst[k] for k in key] + [both["project_key"].eqNullSafe(worst["project_key"])]
    return both.join(worst, named, "left").select(both["scope"], both["project_key"], both["metric"], both["window_start"], both["state"], F.coalesce("listed", F.lit(False)).alias("listed"))


def tele_latest(spark, folder):
    """Newest event of each instance."""
    e = _events(spark, folder).where("ts_ms IS NOT NULL AND instance_id IS NOT NULL")
    # of events at one time the greatest id counts
    once = e.groupBy("instance_id", "ts_ms").agg(F.max("event_id").alias("event_id"))
    return M.latest_per_instance(once).select("instance_id", "ts_ms", "event_id")


def tele_trend(spark, folder):
    """The last three memory samples of each instance in the last day of the feed."""
    e = _events(spark, folder).where("memory_bytes IS NOT NULL AND ts_ms IS NOT NULL AND instance_id IS NOT NULL")
    samples = e.groupBy("project_key", "instance_id", "ts_ms").agg(F.max("memory_bytes").alias("memory_bytes"))
    now = samples.agg(F.max("ts_ms")).first()[0] or 0
    return M.resource_trend(samples, now, M.DAY, 3)


def _signals(spark, folder):
    e = _events(spark, folder).where("ts_ms IS NOT NULL AND instance_id IS NOT NULL")
    state = F.when(F.lower(F.trim("phase")) == "refinement_failed", "stopped").otherwise("healthy")
    return e.groupBy("instance_id", "ts_ms").agg(F.max(state).alias("state"))


def tele_lifecycle(spark, folder):
    """State of each instance after its last signal, three days silent is stale."""
    s = _signals(spark, folder)
    return M.lifecycle(s, s.agg(F.max("ts_ms")).first()[0] or 0, 3 * M.DAY)


def tele_fleet(spark, folder):
    """Totals over all instances."""
    n = _events(spark, folder).where("instance_id IS NOT NULL").groupBy("instance_id").agg(F.sum("result_count").alias("documents"), F.count_if(F.col("latency_us").isNull()).alias("pending_jobs"))
    return M.fleet(tele_lifecycle(spark, folder).join(n, "instance_id"))


def tele_attribution(spark, folder):
    """Which rule names the project of each source of documents."""
    hosts = table(spark, folder, "documents").where("source IS NOT NULL").select(F.col("source").alias("host")).distinct()
    rules = spark.createDataFrame([("^workspace/", "work", 0.5), ("notes", "notes", 0.9), ("atlas", "atlas", 0.9), ("chat", "talk", 0.7)], "pattern string, project_key string, confidence double")
    return M.attribute_projects(hosts, rules)


def tele_admitted(spark, folder):
    """Events of failed searches that are new beside those of reranked ones, each once."""
    e = table(spark, folder, "search_events").where("event_id IS NOT NULL")
    return M.admit_batch(e.where("result_count IS NOT NULL"), e.where(F.lower(F.trim("phase")) == "reranked"), 0, 10**9).select("event_id", "result_count")


def tele_rolling(spark, folder):
    """Events of each project in the week before the feed's end."""
    e = _events(spark, folder).where("ts_ms IS NOT NULL")
    now = e.agg(F.max("ts_ms")).first()[0] or 0
    return e.where(M.rolling(F.col("ts_ms"), now, 7 * M.DAY)).groupBy("project_key").agg(F.count("*").alias("events"))


def tele_throughput(spark, folder):
    """Rise of a counter per second for each user."""
    e = table(spark, folder, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "event_id")
    return M.throughput(e, ["event_id"], ["user_id"]).select("user_id", F.round("event_id_per_s", 9).alias("per_s"))


def tele_retention(spark, folder):
    """Events kept and thinned by age."""
    e = table(spark, folder, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return M.retain(e, 1_706_745_600_000, 20 * M.DAY, 7 * M.DAY, 10, "event_id")


def tele_sessions(spark, folder):
    """Repeats of a query hash within five minutes as one entry."""
    h = _events(spark, folder).where("ts_ms IS NOT NULL AND query_hash IS NOT NULL").select(F.col("query_hash").alias("query"), "ts_ms")
    return J.search_sessions(h)


def tele_instances(spark, folder):
    """Instances joined through shared projects."""
    e = table(spark, folder, "search_events").where("instance_id IS NOT NULL AND project_key IS NOT NULL").select(F.col("instance_id").alias("sighting"), F.col("project_key").alias("key")).distinct()
    return M.reconcile_instances(e)


def jobs_ledger(spark, folder):
    """First holder, copies and times of every content."""
    d = table(spark, folder, "documents").where("text IS NOT NULL AND created_at IS NOT NULL").select("doc_id", "created_at", X.content_hash(F.col("text")).alias("content_hash"))
    return J.content_ledger(d).select("content_hash", "first_doc_id", "seen_count")


def _snapshots(spark, folder):
    d = table(spark, folder, "documents").where("text IS NOT NULL")
    rows = d.select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), "doc_id").alias("file_id"), F.coalesce("n_chars", F.lit(0)).alias("size_bytes"), F.lit(1).cast("bigint").alias("mtime_ns"), X.content_hash(F.col("text")).alias("content_hash"), "doc_id")
    old = rows.where("doc_id % 7 <> 0")
    new = rows.where("doc_id % 5 <> 0").withColumn("mtime_ns", F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1).cast("bigint")).withColumn("content_hash", F.when(F.col("doc_id") % 6 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")))
    return old.drop("doc_id"), new.drop("doc_id")


def jobs_changes(spark, folder):
    """Changes between two snapshots of files."""
    return J.detect_changes(*_snapshots(spark, folder)).groupBy("change").agg(F.count("*").alias("files"))


def jobs_staleness(spark, folder):
    """How far an index of a snapshot is behind, and what to do."""
    old, new = (s.withColumnRenamed("file_id", "doc_id") for s in _snapshots(spark, folder))
    return J.staleness(new, old).select("new", "changed", "deleted", "total", F.round("share", 9).alias("share"), "action")


def jobs_coverage(spark, folder):
    """Relation of two sets of documents."""
    old, new = (s.withColumnRenamed("file_id", "doc_id") for s in _snapshots(spark, folder))
    return J.coverage(new, old)


def jobs_replay(spark, folder):
    """Outcome of each record of the feed against a watermark."""
    c = table(spark, folder, "fsfs_catalog_changelog").where("stream_seq IS NOT NULL").select(F.col("stream_seq"), J.classify_sequence(F.col("stream_seq"), F.lit(500)).alias("outcome"))
    return c.groupBy("outcome").agg(F.count("*").alias("records"))


def jobs_status(spark, folder):
    """Orders by state and priority."""
    o = table(spark, folder, "orders")
    return J.status_counts(o, "o_orderstatus", ["o_orderpriority"], ("O", "F", "P"))


QUERIES = {f.__name__: f for f in (
    tele_summaries, tele_latest_summaries, tele_slo, tele_anomalies, tele_open_anomalies, tele_latest, tele_trend, tele_lifecycle, tele_fleet, tele_attribution, tele_admitted, tele_rolling,
    tele_throughput, tele_retention, tele_sessions, tele_instances, jobs_ledger, jobs_changes, jobs_staleness, jobs_coverage, jobs_replay, jobs_status,
)}

_E = "e AS (SELECT DISTINCT * FROM search_events WHERE event_id IS NOT NULL), u AS (SELECT * REPLACE (CASE WHEN latency_us > 0 THEN latency_us END AS latency_us) FROM e)"
_WINDOWS = "(VALUES ('1m', 60000::BIGINT), ('15m', 900000), ('1h', 3600000), ('6h', 21600000), ('24h', 86400000), ('3d', 259200000), ('1w', 604800000)) w(name, ms)"
_SLO = f"""{_E}, b AS (SELECT project_key, latency_us, ts_ms - ts_ms % 86400000 AS window_start, coalesce(lower(trim(phase)) = 'refinement_failed', false) AS failed FROM u WHERE ts_ms IS NOT NULL),
    s AS (SELECT 'project' AS scope, project_key, window_start, count(*) AS total, count_if(failed) AS failed, quantile_disc(latency_us, 0.95) AS p95_us FROM b GROUP BY ALL
          UNION ALL SELECT 'fleet', NULL, window_start, count(*), count_if(failed), quantile_disc(latency_us, 0.95) FROM b GROUP BY window_start)"""
_RATES = f"""{_SLO}, r AS (SELECT scope, project_key, window_start, 'error_rate' AS metric, failed / total AS rate FROM s UNION ALL SELECT scope, project_key, window_start, 'p95_latency', p95_us::DOUBLE FROM s),
    m AS (SELECT *, avg(rate) OVER (PARTITION BY scope, project_key, metric ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM r)"""
_LIFE = f"""{_E}, g AS (SELECT instance_id, ts_ms, max(CASE WHEN lower(trim(phase)) = 'refinement_failed' THEN 'stopped' ELSE 'healthy' END) AS state FROM e WHERE ts_ms IS NOT NULL AND instance_id IS NOT NULL GROUP BY ALL),
    life AS (SELECT instance_id, max(ts_ms) AS last_ms, CASE WHEN arg_max(state, ts_ms) <> 'stopped' AND (SELECT max(ts_ms) FROM g) - max(ts_ms) > 3 * 86400000 THEN 'stale' ELSE arg_max(state, ts_ms) END AS state FROM g GROUP BY 1)"""
_SNAP = """
    d AS (SELECT coalesce(source, 'none') || '/' || doc_id AS id, doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL),
    o AS (SELECT id, h, 1 AS t FROM d WHERE doc_id % 7 <> 0),
    n AS (SELECT id, CASE WHEN doc_id % 6 = 0 THEN h || 'x' ELSE h END AS h, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS t FROM d WHERE doc_id % 5 <> 0),
    j AS (SELECT coalesce(o.id, n.id) AS id, o.id IS NOT NULL AS was, n.id IS NOT NULL AS now, o.h AS oh, n.h AS nh, o.t AS ot, n.t AS nt FROM o FULL JOIN n ON o.id = n.id)"""

ORACLE = {
    "tele_summaries": f"""
        WITH {_E} SELECT project_key, instance_id, name AS "window", ts_ms - ts_ms % ms AS window_start, count(*) AS events, quantile_disc(latency_us, 0.5) AS p50_us,
            quantile_disc(latency_us, 0.95) AS p95_us, quantile_disc(latency_us, 0.99) AS p99_us, round(avg(result_count), 6) AS avg_results
        FROM u, {_WINDOWS} WHERE ts_ms IS NOT NULL GROUP BY project_key, instance_id, name, ts_ms - ts_ms % ms""",
    "tele_latest_summaries": f"""
        WITH {_E}, w AS (SELECT project_key, instance_id, name AS "window", ts_ms - ts_ms % ms AS window_start, count(*) AS events, quantile_disc(latency_us, 0.95) AS p95_us
            FROM u, (VALUES ('24h', 86400000::BIGINT), ('1w', 604800000)) v(name, ms) WHERE ts_ms IS NOT NULL GROUP BY project_key, instance_id, name, ts_ms - ts_ms % ms)
        FROM w QUALIFY row_number() OVER (PARTITION BY project_key, instance_id, "window" ORDER BY window_start DESC) = 1""",
    "tele_slo": f"""
        WITH {_SLO}, c AS (SELECT *, failed / total / (1 - 0.95::DOUBLE) AS used, p95_us / 150000 AS ratio FROM s)
        SELECT scope, project_key, window_start, total, failed, p95_us, round(failed / total, 9) AS error_rate, round(least(used, 1), 9) AS budget_consumed, round(ratio, 9) AS latency_ratio,
            CASE WHEN used >= 1 OR ratio >= 2 THEN 'critical' WHEN used >= 0.5 OR ratio >= 1 THEN 'warning' ELSE 'healthy' END AS health,
            CASE WHEN used >= 0.5 THEN 'error budget' WHEN ratio >= 1 THEN 'latency' ELSE 'within objectives' END AS reason FROM c""",
    "tele_anomalies": f"""
        WITH {_RATES} SELECT scope, project_key, metric, window_start, round(rate, 9) AS observed, round(base, 9) AS baseline, CASE WHEN rate / base >= 3 THEN 'critical' ELSE 'warning' END AS severity
        FROM m WHERE base > 0 AND rate >= 2 * base""",
    "tele_open_anomalies": f"""
        WITH {_RATES}, o AS (SELECT *, CASE WHEN rate >= 3 * base THEN 'open' ELSE 'resolved' END AS state, CASE WHEN rate / base >= 4.5 THEN 1 ELSE 2 END AS severity FROM m WHERE base > 0 AND rate >= 2 * base)
        SELECT scope, project_key, metric, window_start, state, state = 'open' AND row_number() OVER (PARTITION BY state ORDER BY severity, window_start DESC, scope, project_key NULLS FIRST, metric) <= 25 AS listed FROM o""",
    "tele_latest": f"WITH {_E} SELECT instance_id, ts_ms, event_id FROM (SELECT instance_id, ts_ms, max(event_id) AS event_id FROM e WHERE ts_ms IS NOT NULL AND instance_id IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY ts_ms DESC) = 1",
    "tele_trend": f"""
        WITH {_E}, s AS (SELECT project_key, instance_id, ts_ms, max(memory_bytes) AS memory_bytes FROM e WHERE memory_bytes IS NOT NULL AND ts_ms IS NOT NULL AND instance_id IS NOT NULL GROUP BY ALL)
        FROM s WHERE ts_ms > (SELECT max(ts_ms) FROM s) - 86400000 QUALIFY row_number() OVER (PARTITION BY project_key, instance_id ORDER BY ts_ms DESC) <= 3""",
    "tele_lifecycle": f"WITH {_LIFE} SELECT instance_id, state, last_ms FROM life",
    "tele_fleet": f"""
        WITH {_LIFE}, n AS (SELECT instance_id, sum(result_count) AS documents, count_if(latency_us IS NULL) AS pending_jobs FROM e WHERE instance_id IS NOT NULL GROUP BY 1)
        SELECT count(*) AS instances, count_if(state = 'healthy') AS healthy, count_if(state = 'stale') AS stale, coalesce(sum(documents), 0)::BIGINT AS documents, coalesce(sum(pending_jobs), 0)::BIGINT AS pending_jobs FROM life JOIN n USING (instance_id)""",
    "tele_attribution": """
        WITH r AS (FROM (VALUES ('^workspace/', 'work', 0.5::DOUBLE), ('notes', 'notes', 0.9), ('atlas', 'atlas', 0.9), ('chat', 'talk', 0.7)) v(pattern, project_key, confidence)),
        h AS (SELECT DISTINCT source AS host FROM documents WHERE source IS NOT NULL),
        m AS (SELECT host, project_key, r.confidence, max(r.confidence) OVER (PARTITION BY host) AS best FROM h LEFT JOIN r ON regexp_matches(host, pattern))
        SELECT host, min(project_key) AS project_key, coalesce(max(best), 0) AS confidence, count(DISTINCT project_key) > 1 AS collision FROM m WHERE confidence IS NOT DISTINCT FROM best GROUP BY 1""",
    "tele_admitted": """
        SELECT DISTINCT event_id, result_count FROM search_events WHERE event_id IS NOT NULL AND result_count IS NOT NULL AND event_id NOT IN (SELECT event_id FROM search_events WHERE lower(trim(phase)) = 'reranked' AND event_id IS NOT NULL)""",
    "tele_rolling": f"WITH {_E} SELECT project_key, count(*) AS events FROM e WHERE ts_ms > (SELECT max(ts_ms) FROM e) - 604800000 GROUP BY 1",
    "tele_instances": f"""
        WITH g AS (SELECT DISTINCT instance_id AS i, project_key AS k FROM search_events WHERE instance_id IS NOT NULL AND project_key IS NOT NULL), l0 AS (SELECT DISTINCT i, i AS l FROM g),
        {", ".join(f"l{n + 1} AS MATERIALIZED (SELECT g.i, min(p.l) AS l FROM g JOIN (SELECT k, min(l) AS l FROM g JOIN l{n} USING (i) GROUP BY 1) p USING (k) GROUP BY 1)" for n in range(12))}
        SELECT i AS sighting, l AS instance FROM l12""",
    "tele_throughput": """
        SELECT user_id, CASE WHEN count(*) >= 2 AND max((epoch_us(ts) // 1000)) > min((epoch_us(ts) // 1000)) THEN round((arg_max(event_id, ts) - arg_min(event_id, ts)) / ((max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000))) / 1000), 9) END AS per_s FROM events GROUP BY 1""",
    "tele_retention": """
        SELECT event_id, (epoch_us(ts) // 1000) AS ts_ms FROM events WHERE 1706745600000 - (epoch_us(ts) // 1000) <= 20 * 86400000 AND (1706745600000 - (epoch_us(ts) // 1000) <= 7 * 86400000 OR event_id % 10 = 0)""",
    "tele_sessions": f"""
        WITH {_E}, h AS (SELECT query_hash AS query, ts_ms FROM e WHERE ts_ms IS NOT NULL AND query_hash IS NOT NULL),
        n AS (SELECT *, coalesce((ts_ms - lag(ts_ms) OVER (PARTITION BY query ORDER BY ts_ms) > 300000)::INT, 1) AS new FROM h),
        s AS (SELECT *, sum(new) OVER (PARTITION BY query ORDER BY ts_ms) AS s FROM n)
        SELECT query, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS searches FROM s GROUP BY query, s""",
    "jobs_ledger": """
        SELECT sha256(text) AS content_hash, first(doc_id ORDER BY created_at, doc_id) AS first_doc_id, count(*) AS seen_count FROM documents WHERE text IS NOT NULL AND created_at IS NOT NULL GROUP BY 1""",
    "jobs_changes": f"""
        WITH {_SNAP}, k AS (SELECT id, coalesce(nh, oh) AS h, CASE WHEN NOT was THEN 'create' WHEN NOT now THEN 'delete' WHEN ot = nt THEN 'unchanged' WHEN oh = nh THEN 'touch' ELSE 'modify' END AS change FROM j),
        g AS (SELECT h, min(id) AS id FROM k WHERE change = 'delete' GROUP BY h HAVING count(*) = 1), c AS (SELECT h, min(id) AS id FROM k WHERE change = 'create' GROUP BY h HAVING count(*) = 1),
        p AS (SELECT c.id AS new, g.id AS old FROM c JOIN g USING (h))
        SELECT CASE WHEN p.new IS NULL THEN change WHEN regexp_replace(p.new, '[^/]*$', '') = regexp_replace(p.old, '[^/]*$', '') THEN 'rename' ELSE 'move' END AS change, count(*) AS files
        FROM k LEFT JOIN p ON p.new = k.id WHERE k.id NOT IN (SELECT old FROM p) GROUP BY 1""",
    "jobs_staleness": f"""
        WITH {_SNAP}, s AS (SELECT count_if(NOT was) AS new, count_if(was AND now AND oh <> nh) AS changed, count_if(NOT now) AS deleted, count_if(now) AS total FROM j)
        SELECT *, round((new + changed + deleted) / total, 9) AS share, CASE WHEN new + changed + deleted = 0 THEN 'none' WHEN (new + changed + deleted) / total >= 0.3 THEN 'full_rebuild' ELSE 'incremental' END AS action FROM s""",
    "jobs_coverage": f"""
        WITH {_SNAP}, s AS (SELECT count_if(now) AS live, count_if(was) AS indexed, count_if(was AND now) AS common FROM j)
        SELECT *, CASE WHEN live = 0 THEN 'zero_live' WHEN common = live AND common = indexed THEN 'complete' WHEN common = 0 THEN 'disjoint' WHEN common = indexed THEN 'subset' WHEN common = live THEN 'superset' ELSE 'overlap' END AS relation,
            floor(common * 1000000 / live)::BIGINT AS ppm FROM s""",
    "jobs_replay": """
        SELECT CASE WHEN stream_seq <= 500 THEN 'duplicate' WHEN stream_seq = 501 THEN 'apply_next' ELSE 'gap' END AS outcome, count(*) AS records FROM fsfs_catalog_changelog WHERE stream_seq IS NOT NULL GROUP BY 1""",
    "jobs_status": """
        SELECT o_orderpriority, count_if(o_orderstatus = 'O') AS "O", count_if(o_orderstatus = 'F') AS "F", count_if(o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""",
}
