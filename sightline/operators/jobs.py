"""Document store, embedding jobs, change detection, staleness and history, as table-to-table functions.

Each function takes the present table and a batch and returns the next table (or a
decision table), so it serves batch jobs and ``foreachBatch`` alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_RETRIES, BASE_DELAY_MS, MOST_DELAY_MS = 3, 1_000, 30_000
VISIBILITY_MS, STALE_MS, BACKPRESSURE = 30_000, 300_000, 10_000


# -- sequences and replay ---------------------------------------------------------


def classify_sequence(seq: Column, last: Column) -> Column:
    """duplicate / apply_next / gap, against the last applied number (null: nothing applied)."""
    before = F.coalesce(last, F.lit(0))
    return F.when(seq <= before, "duplicate").when(seq == before + 1, "apply_next").otherwise("gap")


def replay(commits: DataFrame, watermark: int, seq: str = "commit_seq", operations: str = "operations") -> DataFrame:
    """(seq, outcome): applied up to the first gap, already_applied, empty, out_of_order beyond a gap.

    The gap is the least number whose predecessor is missing, found by a join on the
    number, so no task sees the whole feed.
    """
    once = commits.where(F.col(seq).isNotNull()).groupBy(seq).agg(F.max(F.size(operations)).alias("_ops"))
    new = once.where(F.col(seq) > watermark)
    after = new.select((F.col(seq) + 1).alias(seq))
    gap = new.where(F.col(seq) != watermark + 1).join(after, seq, "left_anti").agg(F.min(seq)).first()[0]
    beyond = F.col(seq) >= F.lit(gap) if gap is not None else F.lit(False)
    outcome = F.when(F.col(seq) <= watermark, "already_applied").when(beyond, "out_of_order").when(F.col("_ops") <= 0, "empty").otherwise("applied")
    return once.select(seq, outcome.alias("outcome"))


def changelog_batch(changelog: DataFrame, after: int, limit: int) -> DataFrame:
    return changelog.where(F.col("stream_seq") > after).orderBy("stream_seq").limit(limit)


def dirty_files(catalog: DataFrame, limit: int) -> DataFrame:
    """Files waiting for work, oldest first."""
    return catalog.where("deleted_ts IS NULL AND pipeline_status IN ('pending', 'failed')").orderBy("updated_ts", "file_key").limit(limit)


def drop_old_tombstones(catalog: DataFrame, before: int) -> DataFrame:
    return catalog.where(F.col("deleted_ts").isNull() | (F.col("deleted_ts") >= before))


# -- change detection ---------------------------------------------------------------


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_id, change, moved_from) between snapshots (file_id, size_bytes, mtime_ns, content_hash).

    Same size and time is unchanged without a look at the hash; a new file with the
    hash of exactly one vanished file is that file renamed (same folder) or moved.
    """
    a = old.select("file_id", F.struct("size_bytes", "mtime_ns", "content_hash").alias("a"))
    b = new.select("file_id", F.struct("size_bytes", "mtime_ns", "content_hash").alias("b"))
    both = a.join(b, "file_id", "full_outer")
    same = (F.col("a.size_bytes") == F.col("b.size_bytes")) & (F.col("a.mtime_ns") == F.col("b.mtime_ns"))
    equal = F.col("a.content_hash").eqNullSafe(F.col("b.content_hash"))
    kind = F.when(F.col("a").isNull(), "create").when(F.col("b").isNull(), "delete").when(same, "unchanged").when(equal, "touch").otherwise("modify")
    marked = both.select("file_id", kind.alias("change"), F.coalesce("b.content_hash", "a.content_hash").alias("h"))
    gone = marked.where("change = 'delete' AND h IS NOT NULL").groupBy("h").agg(F.min("file_id").alias("moved_from"), F.count("*").alias("n")).where("n = 1")
    came = marked.where("change = 'create' AND h IS NOT NULL").groupBy("h").agg(F.min("file_id").alias("file_id"), F.count("*").alias("n")).where("n = 1")
    pairs = came.select("h", "file_id").join(gone.select("h", "moved_from"), "h").select("file_id", "moved_from")
    folder = lambda c: F.regexp_replace(c, r"[^/]*$", "")
    out = marked.join(pairs, "file_id", "left").join(pairs.select(F.col("moved_from").alias("file_id"), F.lit(True).alias("_left")), "file_id", "left")
    change = F.when(F.col("_left"), "moved_away").when(F.col("moved_from").isNull(), F.col("change")).when(folder(F.col("file_id")) == folder(F.col("moved_from")), "rename").otherwise("move")
    return out.select("file_id", change.alias("change"), "moved_from").where("change <> 'moved_away'")


def audit_index(files: DataFrame, catalog: DataFrame, index: DataFrame) -> DataFrame:
    """(file_key, finding, action) of files whose file system, catalog and index states disagree."""
    f = files.select("file_key", F.col("content_hash").alias("fh"), F.lit(True).alias("in_fs"))
    c = catalog.where("deleted_ts IS NULL").select("file_key", F.col("content_hash").alias("ch"), F.lit(True).alias("in_catalog"))
    i = index.select("file_key", F.col("content_hash").alias("ih"), F.lit(True).alias("in_index"))
    rows = f.join(c, "file_key", "full_outer").join(i, "file_key", "full_outer")
    fs, cat, idx = (F.coalesce(x, F.lit(False)) for x in ("in_fs", "in_catalog", "in_index"))
    finding = (
        F.when(fs & ~cat, "missing_from_catalog").when(~fs & cat, "vanished").when(fs & cat & ~F.col("fh").eqNullSafe(F.col("ch")), "catalog_outdated")
        .when(cat & ~idx, "missing_from_index").when(~cat & idx, "orphan_in_index").when(cat & idx & ~F.col("ch").eqNullSafe(F.col("ih")), "index_outdated")
    )
    action = F.when(F.col("finding").isin("missing_from_catalog", "catalog_outdated", "missing_from_index", "index_outdated"), "reindex").otherwise("remove")
    return rows.withColumn("finding", finding).where("finding IS NOT NULL").select("file_key", "finding", action.alias("action"))


# -- documents and content hashes -------------------------------------------------------


def dedup_decisions(incoming: DataFrame, status: DataFrame) -> DataFrame:
    """(doc_id, embedder_id, decision): skip / new / changed, against the hash embedded last."""
    have = status.select("doc_id", "embedder_id", F.col("content_hash").alias("_h"))
    both = incoming.join(have, ["doc_id", "embedder_id"], "left")
    return both.select("doc_id", "embedder_id", F.when(F.col("_h").isNull(), "new").when(F.col("_h") == F.col("content_hash"), "skip").otherwise("changed").alias("decision"))


def content_ledger(documents: DataFrame, hash_column: str = "content_hash", seen: str = "created_at") -> DataFrame:
    """(hash, first_doc_id, seen_count, first_seen, last_seen); map-side combine, so a hash of very many copies is no hot spot."""
    first = F.min(F.struct(F.col(seen), F.col("doc_id")))
    return documents.where(F.col(hash_column).isNotNull()).groupBy(hash_column).agg(first["doc_id"].alias("first_doc_id"), F.count("*").alias("seen_count"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"))


def upsert_documents(store: DataFrame, batch: DataFrame, key: str = "doc_id", hash_column: str = "content_hash", order: str = "updated_at") -> tuple[DataFrame, DataFrame]:
    """(next store, (doc_id, outcome)): inserted / updated / unchanged; of a batch's rows with one id the newest counts."""
    columns = [c for c in store.columns if c != key]
    new = batch.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_new"))
    both = store.select(key, F.struct(*columns).alias("_old")).join(new, key, "full_outer")
    same = F.col(f"_old.{hash_column}").eqNullSafe(F.col(f"_new.{hash_column}"))
    outcome = F.when(F.col("_new").isNull(), None).when(F.col("_old").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    both = both.withColumn("outcome", outcome)
    keep = F.when(F.col("outcome").isin("inserted", "updated"), F.col("_new")).otherwise(F.col("_old"))
    nxt = both.withColumn("_row", keep).select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])
    return nxt, both.where("outcome IS NOT NULL").select(key, "outcome")


def delete_documents(store: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return store.join(ids.select(key).distinct(), key, "left_anti")


def status_counts(rows: DataFrame, status: str = "status", by: Sequence[str] = (), states: Sequence[str] = ("pending", "processing", "completed", "failed", "skipped")) -> DataFrame:
    """One column of counts for each state."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col(status) == s).alias(s) for s in states])


def pending_embeddings(documents: DataFrame, status: DataFrame, embedder: str) -> DataFrame:
    done = status.where((F.col("embedder_id") == embedder) & (F.col("status") == "embedded")).select("doc_id")
    return documents.join(done, "doc_id", "left_anti")


# -- the job queue ----------------------------------------------------------------------------


def enqueue(jobs: DataFrame, requests: DataFrame, hash_embedders: Sequence[str] = ("hash",)) -> DataFrame:
    """Jobs after requests (doc_id, embedder_id, content_hash, priority, submitted_at): a pending job with another hash is replaced, the same hash is one job, hash embedders get none."""
    wanted = requests.where(~F.col("embedder_id").isin(list(hash_embedders)))
    wanted = wanted.groupBy("doc_id", "embedder_id").agg(F.max_by(F.struct("content_hash", "priority", "submitted_at"), "submitted_at").alias("_r")).select("doc_id", "embedder_id", "_r.*")
    active = jobs.where("status IN ('pending', 'processing', 'completed')").select("doc_id", "embedder_id", "content_hash")
    new = wanted.join(active.distinct(), ["doc_id", "embedder_id", "content_hash"], "left_anti")
    stale = new.select("doc_id", "embedder_id", F.lit(True).alias("_replaced"))
    kept = jobs.join(stale, ["doc_id", "embedder_id"], "left").where(~(F.coalesce("_replaced", F.lit(False)) & (F.col("status") == "pending"))).drop("_replaced")
    fresh = new.withColumns({"status": F.lit("pending"), "retry_count": F.lit(0), "worker_id": F.lit(None).cast("string"), "started_at": F.lit(None).cast("bigint")})
    return kept.unionByName(fresh, allowMissingColumns=True)


def claim(jobs: DataFrame, worker: str, count: int, now: int) -> DataFrame:
    """The next ``count`` jobs: pending, due by ``now``, none active for the document and embedder; by priority, then age."""
    active = jobs.where("status = 'processing'").select("doc_id", "embedder_id").distinct()
    free = jobs.where((F.col("status") == "pending") & (F.col("submitted_at") <= now)).join(active, ["doc_id", "embedder_id"], "left_anti")
    picked = free.orderBy(F.desc("priority"), "submitted_at", "doc_id", "embedder_id").limit(count)
    return picked.withColumns({"status": F.lit("processing"), "worker_id": F.lit(worker), "started_at": F.lit(now)})


def retry_delay(retries: Column) -> Column:
    return F.least(F.lit(BASE_DELAY_MS) * F.pow(F.lit(2.0), retries), F.lit(float(MOST_DELAY_MS))).cast("bigint")


def finish(jobs: DataFrame, outcomes: DataFrame, now: int) -> DataFrame:
    """Jobs after outcomes (doc_id, embedder_id, outcome: completed / failed / skipped); failures retry with a growing delay, then stay failed."""
    both = jobs.join(outcomes, ["doc_id", "embedder_id"], "left")
    mine = F.col("outcome").isNotNull() & (F.col("status") == "processing")
    failed = mine & (F.col("outcome") == "failed")
    again = failed & (F.col("retry_count") + 1 < MAX_RETRIES)
    status = F.when(again, "pending").when(mine, F.col("outcome")).otherwise(F.col("status"))
    at = F.when(again, F.lit(now) + retry_delay(F.col("retry_count"))).otherwise(F.col("submitted_at"))
    return both.withColumns({"submitted_at": at, "status": status, "retry_count": F.col("retry_count") + failed.cast("int")}).drop("outcome")


def reclaim(jobs: DataFrame, now: int, stale_ms: int = STALE_MS) -> DataFrame:
    """Jobs whose worker went silent are pending again."""
    stale = (F.col("status") == "processing") & (F.col("started_at") < now - stale_ms)
    return jobs.withColumns({"worker_id": F.when(~stale, F.col("worker_id")), "status": F.when(stale, "pending").otherwise(F.col("status"))})


def resurrect(jobs: DataFrame) -> DataFrame:
    """Failed jobs get a new round of tries."""
    dead = F.col("status") == "failed"
    return jobs.withColumns({"retry_count": F.when(dead, 0).otherwise(F.col("retry_count")), "status": F.when(dead, "pending").otherwise(F.col("status"))})


def queue_depth(jobs: DataFrame) -> DataFrame:
    counts = status_counts(jobs)
    return counts.withColumn("backpressured", F.col("pending") >= BACKPRESSURE)


def ingest(store: DataFrame, documents: DataFrame, jobs: DataFrame, embedders: Sequence[str], now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Canonicalise, hash, upsert and enqueue: (next store, next jobs, outcomes). Documents whose canonical text is empty are skipped."""
    from sightline.functions.text import canonicalize, content_hash

    rows = documents.withColumn("content", canonicalize(F.col("content"))).withColumn("content_hash", content_hash(F.col("content"))).withColumn("updated_at", F.lit(now).cast("bigint"))
    good = rows.where("content <> ''")
    nxt, outcomes = upsert_documents(store, good.select(*store.columns))
    todo = good.join(outcomes.where("outcome <> 'unchanged'"), "doc_id", "left_semi")
    kinds = F.explode(F.array(*[F.lit(e) for e in embedders]))
    wanted = todo.select("doc_id", "content_hash", F.lit(0).alias("priority"), F.lit(now).cast("bigint").alias("submitted_at"), kinds.alias("embedder_id"))
    skipped = rows.where("content = '' OR content IS NULL").select("doc_id", F.lit("skipped").alias("outcome"))
    return nxt, enqueue(jobs, wanted), outcomes.unionByName(skipped)


# -- staleness and history ------------------------------------------------------------------------


def staleness(documents: DataFrame, indexed: DataFrame, full_rebuild: float = 0.30) -> DataFrame:
    """One row: new, changed, deleted, total, share and action (none / incremental / full_rebuild)."""
    a = documents.select("doc_id", F.col("content_hash").alias("a"))
    b = indexed.select("doc_id", F.col("content_hash").alias("b"))
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), "doc_id", "full_outer")
    counts = both.agg(F.count_if(F.col("_b").isNull()).alias("new"), F.count_if(F.col("_a") & F.col("_b") & ~F.col("a").eqNullSafe(F.col("b"))).alias("changed"), F.count_if(F.col("_a").isNull()).alias("deleted"), F.count("_a").alias("total"))
    share = (F.col("new") + F.col("changed") + F.col("deleted")) / F.greatest("total", F.lit(1))
    return counts.withColumn("share", share).withColumn("action", F.when(F.col("share") == 0, "none").when(F.col("share") >= full_rebuild, "full_rebuild").otherwise("incremental"))


def coverage(live: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: live, indexed, common, relation of the two sets, and coverage in parts per million."""
    both = live.select("doc_id", F.lit(1).alias("l")).distinct().join(indexed.select("doc_id", F.lit(1).alias("i")).distinct(), "doc_id", "full_outer")
    c = both.agg(F.count("l").alias("live"), F.count("i").alias("indexed"), F.count_if(F.col("l").isNotNull() & F.col("i").isNotNull()).alias("common"))
    relation = (
        F.when(F.col("live") == 0, "zero_live").when((F.col("common") == F.col("live")) & (F.col("common") == F.col("indexed")), "complete")
        .when(F.col("common") == 0, "disjoint").when(F.col("common") == F.col("indexed"), "subset").when(F.col("common") == F.col("live"), "superset").otherwise("overlap")
    )
    return c.withColumn("relation", relation).withColumn("ppm", F.when(F.col("live") > 0, F.floor(F.col("common") * 1_000_000 / F.col("live"))))


def search_sessions(history: DataFrame, window_ms: int = 300_000) -> DataFrame:
    """(query, first_ms, last_ms, searches): repeats of a query within the window of the last are one entry.

    Searches are first counted in slots half a window long: those of a slot are one entry whatever else there is. Only
    slots are then put in order, so what one task holds of a query is bounded by its time, not by its searches.
    """
    slot = F.floor(F.col("ts_ms") / max(1, window_ms // 2)) if window_ms > 0 else F.col("ts_ms")
    slots = history.where("ts_ms IS NOT NULL").groupBy("query", slot.alias("_slot")).agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count("*").alias("searches"))
    w = Window.partitionBy("query").orderBy("_slot")
    new = F.coalesce((F.col("first_ms") - F.lag("last_ms").over(w) > window_ms).cast("int"), F.lit(1))
    marked = slots.withColumn("_new", new).withColumn("_s", F.sum("_new").over(w))
    return marked.groupBy("query", "_s").agg(F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.sum("searches").alias("searches")).drop("_s")


def history_with_prefix(history: DataFrame, prefix: str, limit: int) -> DataFrame:
    last = history.where(F.startswith("query", F.lit(prefix))).groupBy("query").agg(F.max("ts_ms").alias("ts_ms"))
    return last.orderBy(F.desc("ts_ms"), "query").limit(limit)


def truncate_history(history: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` entries."""
    return history.orderBy(F.desc("ts_ms"), "query").limit(keep)


def merge_due(segments: Column, cooled_ms: Column, least: int = 4, cooldown_ms: int = 300_000) -> Column:
    return (segments >= least) & (cooled_ms >= cooldown_ms)


def visibility_due(oldest_ms: Column, now: Column, most_ms: int = 1_000) -> Column:
    return now - oldest_ms >= most_ms


# -- file classification ----------------------------------------------------------------------------


def sniff(content: Column) -> Column:
    """(nulls, non_printable, high, kind, action) of a file's first bytes, given as binary."""
    h = F.hex(content)
    n = F.greatest(F.length(content), F.lit(1))
    pairs = F.regexp_extract_all(h, F.lit("(..)"), F.lit(1))
    share = lambda p: F.size(F.filter(pairs, lambda x: x.rlike(p))) / n
    nulls, odd, high = F.size(F.filter(pairs, lambda x: x == "00")), share("^(0[0-8BCEF]|1.|7F)$"), share("^[89A-F]")
    archive = h.rlike("^(504B0304|1F8B|377ABCAF|425A68|FD377A)")
    kind = F.when(F.length(content) == 0, "text").when(archive, "archive").when(nulls > 0, "binary").when(odd > 0.3, "corrupt").when(odd > 0.05, "partial").otherwise("text")
    action = F.when(kind == "text", "index").when(kind == "partial", "index_partial").when(kind == "corrupt", "quarantine").otherwise("skip")
    return F.struct(nulls.alias("nulls"), odd.alias("non_printable"), high.alias("high"), kind.alias("kind"), action.alias("action"))


def artifact_action(path: Column, size: Column, override: Column | None = None) -> Column:
    """index_full / metadata_only / skip for giant logs, vendored trees, generated files, archives and transient files."""
    vendored = path.rlike(r"(^|/)(node_modules|vendor|third_party|\.venv|target|dist)(/|$)")
    generated = path.rlike(r"(\.min\.(js|css)|\.lock|_pb2\.py|\.generated\.[a-z]+)$")
    transient = path.rlike(r"(\.(tmp|swp|part)|~)$|(^|/)\.(cache|git)(/|$)")
    archive = path.rlike(r"\.(zip|tar|gz|bz2|xz|7z|jar)$")
    log = path.rlike(r"\.log(\.\d+)?$") & (size > 50_000_000)
    found = F.when(transient, "skip").when(archive | log | generated, "metadata_only").when(vendored, "skip").otherwise("index_full")
    return F.coalesce(override, found) if override is not None else found


def discovered(files: DataFrame, include: Sequence[str], exclude: Sequence[str]) -> DataFrame:
    """Files below an included root and below no excluded one; the longer of two matching roots decides."""
    longest = lambda roots: F.coalesce(F.greatest(F.lit(-1), *[F.when(F.startswith("path", F.lit(r)), F.lit(len(r))).otherwise(F.lit(-1)) for r in roots]), F.lit(-1))
    return files.where((longest(include) > longest(exclude)) & (longest(include) >= 0))


# -- small records ------------------------------------------------------------------------------------


def index_report(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, problem) of rows an index build cannot take as they are: no id, repeated id, no text."""
    many = documents.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.count("*").alias("n")).where("n > 1").select(F.col(doc_id), F.lit("repeated id").alias("problem"))
    alone = F.when(F.col(doc_id).isNull(), "no id").when(F.col(text).isNull() | (F.trim(text) == ""), "no text")
    return documents.select(F.col(doc_id), alone.alias("problem")).where("problem IS NOT NULL").unionByName(many)


def build_history(builds: DataFrame, index: str, limit: int) -> DataFrame:
    """The newest builds of an index."""
    return builds.where(F.col("index_name") == index).orderBy(F.desc("built_at"), F.desc("build_id")).limit(limit)


def bookmarks_after(bookmarks: DataFrame, changes: DataFrame) -> DataFrame:
    """Bookmarks (doc_id, query, note, created_at) after changes with ``action`` add or remove; the newest change of a mark counts."""
    newest = changes.groupBy("doc_id", "query").agg(F.max_by(F.struct("note", "created_at", "action"), "created_at").alias("_c")).select("doc_id", "query", "_c.*")
    kept = bookmarks.join(newest.select("doc_id", "query"), ["doc_id", "query"], "left_anti")
    return kept.unionByName(newest.where("action = 'add'").drop("action").select(*bookmarks.columns))


def conversation_columns(messages: DataFrame, prefix_chars: int = 20, preview_chars: int = 200) -> DataFrame:
    """Adds identity, preview and the prefix columns of conversation messages (source_id, conversation_id, msg_idx, title, content)."""
    from sightline.functions.text import edge_ngrams, prefix_source, preview

    return messages.withColumns({
        "identity": F.concat_ws(":", F.coalesce("source_id", F.lit("")), F.col("conversation_id").cast("string"), F.col("msg_idx").cast("string")),
        "preview": preview(F.col("content"), preview_chars),
        "title_prefix": F.concat_ws(" ", edge_ngrams(F.col("title"), 2, prefix_chars)),
        "content_prefix": F.concat_ws(" ", edge_ngrams(prefix_source(F.col("content")), 2, prefix_chars)),
    })


def shadow_compare(primary: DataFrame, shadow: DataFrame, epsilon: float = 1e-4) -> DataFrame:
    """(query_id, verdict) of two engines' hits (query_id, doc_id, score, rank): rank_exact, score_epsilon or diverged."""
    a = primary.select("query_id", "doc_id", F.col("score").alias("a"), F.col("rank").alias("ra"))
    b = shadow.select("query_id", "doc_id", F.col("score").alias("b"), F.col("rank").alias("rb"))
    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    near = F.abs(F.col("a") - F.col("b")) <= epsilon * F.greatest(F.abs("a"), F.abs("b"), F.lit(1e-12))
    per = both.groupBy("query_id").agg(F.bool_and(F.col("ra").eqNullSafe(F.col("rb"))).alias("ranks"), F.bool_and(F.coalesce(near, F.lit(False))).alias("scores"))
    return per.select("query_id", F.when(F.col("ranks"), "rank_exact").when(F.col("scores"), "score_epsilon").otherwise("diverged").alias("verdict"))
