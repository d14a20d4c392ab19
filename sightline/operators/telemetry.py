"""Telemetry: windows, percentiles, service levels, anomalies, resources and instances.

All windows and scopes of a rollup come from one pass over the events (a row per
window size, combined on the map side) rather than a pass each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.session import cut

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
# The window sizes of summaries.
WINDOWS = {"1m": MINUTE, "15m": 15 * MINUTE, "1h": HOUR, "6h": 6 * HOUR, "24h": DAY, "3d": 3 * DAY, "1w": 7 * DAY}
# Share of the error budget's period that a window stands for.
WINDOW_FRACTION = {name: ms / (30 * DAY) for name, ms in WINDOWS.items()}


def bucket_start(ts: Column, size: int) -> Column:
    """Start of the tumbling window; times of 0 and before fall in the one at 0."""
    return F.when(ts <= 0, F.lit(0).cast("bigint")).otherwise(ts - F.pmod(ts, F.lit(size).cast("bigint")))


def rolling(ts: Column, now: int, size: int) -> Column:
    """Whether a time lies in the window of ``size`` that ends with ``now``."""
    return ts.between(now - size + 1, now)


def nearest_rank(value: Column | str, p: float) -> Column:
    """Exact percentile at rank ceil(n p); null for nothing. For groups that fit a task; else use sketches."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value if isinstance(value, str) else value._jc.toString()})")


def distinct_events(events: DataFrame) -> DataFrame:
    """Each ``event_id`` once; of different rows under one id the least counts."""
    names = [c for c in events.columns if c != "event_id"]
    return events.where("event_id IS NOT NULL").groupBy("event_id").agg(F.min(F.struct(*names)).alias("_r")).select("event_id", "_r.*")


def _statistics(exact: bool) -> list[Column]:
    def p(value: str, at: float) -> Column:
        return nearest_rank(value, at) if exact else F.percentile_approx(value, at, 10_000)

    return [
        F.count("*").alias("events"),
        p("latency_us", 0.5).alias("p50_us"),
        p("latency_us", 0.95).alias("p95_us"),
        p("latency_us", 0.99).alias("p99_us"),
        F.avg("result_count").alias("avg_results"),
        F.avg("memory_bytes").alias("avg_memory"),
        p("memory_bytes", 0.95).alias("p95_memory"),
    ]


def search_summaries(events: DataFrame, windows: dict[str, int] | None = None, exact: bool = True) -> DataFrame:
    """(project_key, instance_id, window, window_start, statistics...) for all window sizes.

    ``exact`` percentiles hold a group's different values in one task; ``exact=False``
    takes mergeable rank summaries, for groups of any size.
    """
    sizes = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(ms).cast("bigint").alias("ms")) for n, ms in (windows or WINDOWS).items()])
    rows = events.where("ts_ms IS NOT NULL").select("project_key", "instance_id", "latency_us", "result_count", "memory_bytes", "ts_ms", F.explode(sizes).alias("w"))
    start = F.when(F.col("ts_ms") <= 0, F.lit(0).cast("bigint")).otherwise(F.col("ts_ms") - F.pmod("ts_ms", F.col("w.ms")))
    return rows.groupBy("project_key", "instance_id", F.col("w.window").alias("window"), start.alias("window_start")).agg(*_statistics(exact))


def latest_summaries(summaries: DataFrame) -> DataFrame:
    """Newest window of each project, instance and size."""
    keys = ["project_key", "instance_id", "window"]
    rest = [c for c in summaries.columns if c not in keys]
    return summaries.groupBy(*keys).agg(F.max_by(F.struct(*rest), "window_start").alias("_r")).select(*keys, "_r.*")


# -- service levels -----------------------------------------------------------------------


def slo_windows(events: DataFrame, failed: Column, size: int, p: float = 0.95) -> DataFrame:
    """(scope, project_key, window_start, total, failed, p95_us) per project and for the fleet (scope 'fleet', null project)."""
    rows = events.where("ts_ms IS NOT NULL").select("project_key", "latency_us", bucket_start(F.col("ts_ms"), size).alias("window_start"), failed.alias("_failed"))
    sets = rows.groupingSets([["project_key", "window_start"], ["window_start"]], "project_key", "window_start")
    whole = F.when(F.grouping("project_key") == 1, "fleet").otherwise("project")
    counted = sets.agg(whole.alias("scope"), F.count("*").alias("total"), F.count_if("_failed").alias("failed"), F.percentile_approx("latency_us", p, 10_000).alias("p95_us"))
    return counted.select("scope", "project_key", "window_start", "total", "failed", "p95_us")


def evaluate_slo(windows: DataFrame, window: str = "1h", objective: float = 0.995, latency_target_us: int = 150_000, least: int = 1) -> DataFrame:
    """Adds error_rate, budget_consumed in [0, 1], burn_rate, latency_ratio, health and reason."""
    rate = F.when(F.col("total") > 0, F.col("failed") / F.col("total")).otherwise(F.lit(0.0))
    consumed = F.least(F.greatest(F.col("error_rate") / (1 - objective), F.lit(0.0)), F.lit(1.0))
    out = windows.withColumn("error_rate", rate).withColumn("budget_consumed", consumed)
    out = out.withColumn("burn_rate", F.col("error_rate") / (1 - objective)).withColumn("budget_per_window", F.col("budget_consumed") * WINDOW_FRACTION[window])
    out = out.withColumn("latency_ratio", F.col("p95_us") / latency_target_us)
    bad = (F.col("budget_consumed") >= 1) | (F.col("latency_ratio") >= 2)
    warn = (F.col("budget_consumed") >= 0.5) | (F.col("latency_ratio") >= 1)
    health = F.when(F.col("total") < least, "no_data").when(bad, "critical").when(warn, "warning").otherwise("healthy")
    reason = F.when(F.col("total") < least, "too few events").when(F.col("budget_consumed") >= 0.5, "error budget").when(F.col("latency_ratio") >= 1, "latency").otherwise("within objectives")
    return out.withColumn("health", health).withColumn("reason", reason)


def anomalies(evaluated: DataFrame, open_before: DataFrame | None = None, factor: float = 2.0) -> DataFrame:
    """(scope, project_key, metric, window_start, baseline, observed, deviation, severity, state).

    The baseline is the mean of the scope's earlier windows. With the anomalies open
    before, those that no longer hold come out as ``resolved``.
    """
    keys = ["scope", "project_key"]
    metrics = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("observed")) for m, c in (("error_rate", "error_rate"), ("p95_latency", "p95_us"))]))
    rows = evaluated.select(*keys, "window_start", metrics.alias("m")).select(*keys, "window_start", "m.*")
    base = F.avg("observed").over(Window.partitionBy(*keys, "metric").orderBy("window_start").rowsBetween(Window.unboundedPreceding, -1))
    found = rows.withColumn("baseline", base).where((F.col("baseline") > 0) & (F.col("observed") >= factor * F.col("baseline")))
    found = found.withColumn("deviation", F.col("observed") / F.col("baseline"))
    severity = F.when(F.col("deviation") >= 3 * factor / 2, "critical").otherwise("warning")
    now = found.select(*keys, "metric", "window_start", "baseline", "observed", "deviation", severity.alias("severity"), F.lit("open").alias("state"))
    if open_before is None:
        return now
    key = [*keys, "metric", "window_start"]
    match = [open_before[k].eqNullSafe(now[k]) for k in key]
    gone = open_before.join(now.select(*key), match, "left_anti").withColumn("state", F.lit("resolved"))
    return now.unionByName(gone.select(*now.columns))


# Order of severities.
SEVERITY = ["critical", "warning", "info"]


def by_severity(found: DataFrame, limit: int | None = None) -> DataFrame:
    """Open anomalies, worst and newest first."""
    place = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("severity"))
    out = found.where("state = 'open'").orderBy(F.when(place == 0, 99).otherwise(place), F.desc("window_start"), "scope", "project_key", "metric")
    return out if limit is None else out.limit(limit)


# -- resources and instances --------------------------------------------------------------


def resource_trend(samples: DataFrame, now: int, size: int, limit: int) -> DataFrame:
    """The last ``limit`` samples of each instance in the window, oldest first."""
    newest = F.row_number().over(Window.partitionBy("project_key", "instance_id").orderBy(F.desc("ts_ms")))
    return samples.where(rolling(F.col("ts_ms"), now, size)).withColumn("_n", newest).where(F.col("_n") <= limit).drop("_n").orderBy("project_key", "instance_id", "ts_ms")


def throughput(snapshots: DataFrame, counters: Sequence[str], by: Sequence[str] = ("project_key", "instance_id")) -> DataFrame:
    """(by..., one rate per second for each counter): last less first over the time between; null below 2 rows or without time."""
    per = []
    for c in counters:
        rise = F.max_by(c, "ts_ms") - F.min_by(c, "ts_ms")
        elapsed = (F.max("ts_ms") - F.min("ts_ms")) / 1000
        per.append(F.when((F.count("*") >= 2) & (elapsed > 0), rise / elapsed).alias(f"{c}_per_s"))
    return snapshots.groupBy(*by).agg(*per)


def retain(rows: DataFrame, now: int, keep_ms: int, thin_after_ms: int, stride: int, id_column: str = "sample_id") -> DataFrame:
    """Rows young enough; of those older than ``thin_after_ms`` every ``stride``-th by id."""
    age = F.lit(now) - F.col("ts_ms")
    return rows.where((age <= keep_ms) & ((age <= thin_after_ms) | (F.pmod(F.col(id_column), F.lit(stride)) == 0)))


def admit_batch(batch: DataFrame, known: DataFrame, queue_depth: int, threshold: int) -> DataFrame:
    """New events of a batch, each id once; a batch that would pass the threshold is refused as a whole."""
    new = distinct_events(batch).join(known.select("event_id"), "event_id", "left_anti")
    if queue_depth + new.count() > threshold:
        raise OverflowError("the batch would exceed the queue")
    return new


def upsert_latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Newest row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def latest_per_instance(samples: DataFrame) -> DataFrame:
    return upsert_latest(samples, ["instance_id"], "ts_ms")


def lifecycle(signals: DataFrame, now: int, stale_ms: int = 30_000) -> DataFrame:
    """(instance_id, state, last_ms): the last signal's state, or ``stale`` after a silent gap; stopped stays stopped."""
    last = signals.groupBy("instance_id").agg(F.max_by("state", "ts_ms").alias("state"), F.max("ts_ms").alias("last_ms"))
    stale = (F.lit(now) - F.col("last_ms") > stale_ms) & (F.col("state") != "stopped")
    return last.withColumn("state", F.when(stale, "stale").otherwise(F.col("state")))


MOST_RULES = 1_000


def attribute_projects(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, project_key, confidence, collision): best rule (pattern, project_key, confidence) of each host; ties of projects collide.

    Rules are a configured list; each host meets them in one pass, without a join.
    """
    known = rules.limit(MOST_RULES + 1).collect()
    if len(known) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    table = F.array(*[F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.project_key).alias("project_key"), F.lit(float(r.confidence)).alias("confidence")) for r in known])
    hit = F.filter(table, lambda r: F.call_function("rlike", F.col("host"), r["pattern"]))
    best = F.array_max(F.transform(hit, lambda r: r["confidence"]))
    top = F.array_sort(F.array_distinct(F.transform(F.filter(hit, lambda r: r["confidence"] == best), lambda r: r["project_key"])))
    return hosts.select("host", F.when(F.size(top) > 0, F.element_at(top, 1)).alias("project_key"), F.coalesce(best, F.lit(0.0)).alias("confidence"), (F.size(top) > 1).alias("collision"))


def fleet(instances: DataFrame) -> DataFrame:
    """One row of totals over (state, documents, pending_jobs)."""
    return instances.agg(F.count("*").alias("instances"), F.count_if(F.col("state") == "healthy").alias("healthy"), F.count_if(F.col("state") == "stale").alias("stale"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("pending_jobs"), F.lit(0)).alias("pending_jobs"))


def reconcile_instances(sightings: DataFrame, rounds: int | None = None) -> DataFrame:
    """(sighting, instance): sightings (sighting, key) that share an identity key, directly or through others, are one instance.

    ``instance`` is the least sighting of all that are joined. Each sighting is linked to
    the least one of its keys; then large stars and small stars in turn hook every sighting
    to the least neighbour until each hangs on one that hangs on none, which takes rounds
    that grow with the logarithm of a chain's length. Each round is written to the shared
    folder. With ``rounds`` given, links not settled after so many raise an error.
    """
    links = cut(sightings.where("sighting IS NOT NULL AND key IS NOT NULL").select("sighting", "key").distinct(), "links")
    least = links.groupBy("key").agg(F.min("sighting").alias("v"))
    edges = cut(links.join(least, "key").where("sighting > v").select(F.col("sighting").alias("u"), "v").distinct(), "edges")
    done = 0
    while not _settled(edges):
        if rounds is not None and done >= rounds:
            raise RuntimeError(f"instances have not settled after {rounds} rounds")
        edges, done = cut(_small_star(_large_star(edges)), "edges"), done + 1
    every = sightings.where("sighting IS NOT NULL").select("sighting").distinct()
    return every.join(edges.withColumnRenamed("u", "sighting"), "sighting", "left").select("sighting", F.coalesce("v", "sighting").alias("instance"))


def _settled(edges: DataFrame) -> bool:
    """Whether each child (u) has one parent (v), which is nobody's child."""
    several = edges.groupBy("u").count().where("count > 1").select("u")
    return several.unionByName(edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi")).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each greater neighbour of a sighting to the least of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each lesser neighbour of a sighting, and the sighting, to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    lesser = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lesser.unionByName(least.withColumnRenamed("m", "v")).distinct()


def simulate(spark, instances: int, events_each: int, start_ms: int = 1_700_000_000_000, seed: int = 7) -> DataFrame:
    """Deterministic search events of several instances, for tests."""
    ids = spark.range(instances * events_each)
    h = lambda n: F.pmod(F.xxhash64("id", F.lit(seed + n)), F.lit(1_000_000))
    phases = F.array(*[F.lit(p) for p in ("initial", "refined", "reranked", "refinement_failed")])
    return ids.select(
        F.concat(F.lit("e"), F.col("id")).alias("event_id"),
        F.concat(F.lit("p"), F.pmod("id", F.lit(3))).alias("project_key"),
        F.concat(F.lit("i"), F.pmod("id", F.lit(instances))).alias("instance_id"),
        F.element_at(phases, (F.pmod(h(1), F.lit(4)) + 1).cast("int")).alias("phase"),
        (h(2) % 200_000 + 100).alias("latency_us"),
        (h(3) % 50).alias("result_count"),
        (h(4) * 1000).alias("memory_bytes"),
        (F.lit(start_ms) + F.floor(F.col("id") / instances) * 1000).alias("ts_ms"),
    )
