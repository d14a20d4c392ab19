"""Structured Streaming: event ingest, windowed rollups, change feeds and stateful operators.

Each stream does the same as a batch operator; the tests run both over the same
rows. State is kept per key and bounded: by a watermark, or by one small row a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sightline.operators.changefeed import BucketedTable, catalog_changes
from sightline.operators.segments import SegmentedIndex
from sightline.sources import frames


def read_parquet_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream; the schema is that of the files already there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def envelope_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Telemetry envelopes from text files."""
    return frames.envelopes(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def distinct_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event id once, however often it is sent within ``delay``; state older than that is dropped."""
    timed = events.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", delay)
    return timed.dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(project_key, window_start, events, failed, p95_us) of closed windows; late events beyond ``delay`` are left out."""
    timed = events.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", delay)
    failed = F.count_if(F.lower(F.trim("phase")) == "refinement_failed")
    out = timed.groupBy("project_key", F.window("event_time", size).alias("w")).agg(F.count("*").alias("events"), failed.alias("failed"), F.percentile_approx("latency_us", 0.95, 1000).alias("p95_us"))
    return out.select("project_key", F.unix_millis("w.start").alias("window_start"), "events", "failed", "p95_us")


def apply_changelog(feed: DataFrame, path: str, checkpoint: str, buckets: int = 64, available_now: bool = True) -> StreamingQuery:
    """Keeps the catalog table in ``path`` current; a batch that is repeated after a failure leads to the same state."""

    def run(batch: DataFrame, _: int) -> None:
        table = BucketedTable(batch.sparkSession, path, "file_key", ["revision", "stream_seq"], ["change_kind"], buckets)
        table.apply(catalog_changes(batch))

    return _start(feed.writeStream.foreachBatch(run), checkpoint, available_now)


def refresh_index(documents: DataFrame, path: str, checkpoint: str, fields: dict[str, str] | None = None, doc_id: str = "doc_id", fan_out: int = 8, available_now: bool = True) -> StreamingQuery:
    """Keeps the segmented index in ``path`` current with a stream of new and changed documents, merging segments as they add up.

    Of a batch's rows with one id any one counts. A batch that is repeated after a failure replaces its own documents, which changes no result.
    """

    def run(batch: DataFrame, _: int) -> None:
        index = SegmentedIndex(batch.sparkSession, path, fields, doc_id)
        rows = batch.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id])
        if rows.isEmpty():
            return
        index.add(rows)
        if due := index.due(fan_out):
            index.merge(due)

    return _start(documents.writeStream.foreachBatch(run), checkpoint, available_now)


def each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """``step`` over every batch, with its number, which stays the same if the batch is repeated."""
    return _start(stream.writeStream.foreachBatch(step), checkpoint, available_now)


def to_parquet(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    return _start(stream.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint, available_now)


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def each_batch_output(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Updated rows of each batch below ``path``, a folder for each; a repeated batch replaces its own."""
    return each_batch_mode(stream, lambda b, n: b.write.mode("overwrite").parquet(f"{path}/batch={n}"), checkpoint, available_now)


def each_batch_mode(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, mode: str = "update") -> StreamingQuery:
    return _start(stream.writeStream.outputMode(mode).foreachBatch(step), checkpoint, available_now)


# -- folds that keep their state between batches -------------------------------------------


class Fold(StatefulProcessor):
    """A step over a key's rows in order; the state is one row a key.

    ``start`` and ``step(state, row) -> state`` work on tuples of the state schema;
    rows of a batch are ordered by ``order`` and rows at or before the last order seen
    are repeats, which change nothing.
    """

    def __init__(self, schema: str, start: tuple, step: Callable[[tuple, dict], tuple], order: str, out: list[str], key: str):
        self.schema, self.start, self.step = schema, start, step
        self.order, self.out, self.key = order, out, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", f"_last BIGINT, {self.schema}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else (None, *self.start)
        last, state = held[0], tuple(held[1:])
        for row in sorted((r for pdf in rows for r in pdf.to_dict("records")), key=lambda r: r[self.order]):
            if last is None or row[self.order] > last:
                last, state = int(row[self.order]), self.step(state, row)
        self.state.update((last, *state))
        yield pd.DataFrame([dict(zip([self.key, *self.out], [key[0], *state]))])

    def close(self) -> None:
        pass


def fold_stream(stream: DataFrame, key: str, fold: Fold, out_schema: str) -> DataFrame:
    """The state of each key after every batch that had rows of it (needs the RocksDB state store)."""
    return stream.groupBy(key).transformWithStateInPandas(fold, out_schema, "Update", "None")


def ewma_fold(key: str, order: str, value: str, alpha: float = 0.3) -> Fold:
    def step(state: tuple, row: dict) -> tuple:
        return (float(row[value]) if state[0] is None else alpha * float(row[value]) + (1 - alpha) * state[0],)

    return Fold("ewma DOUBLE", (None,), step, order, ["ewma"], key)


def breaker_step(state: tuple, ok: bool, ms: int, failures: int = 5, probe_ms: int = 30_000, successes: int = 3) -> tuple:
    """One outcome of a circuit breaker: (state, bad, good, since, skipped)."""
    name, bad, good, since, skipped = state
    if name == "open":
        if ms - since < probe_ms:
            return name, bad, good, since, skipped + 1
        name, bad, good = "half_open", 0, good
    if name == "closed":
        if ok:
            return "closed", 0, 0, since, skipped
        return ("open", 0, 0, ms, skipped) if bad + 1 >= failures else ("closed", bad + 1, 0, since, skipped)
    if not ok:
        return "open", 0, 0, ms, skipped
    return ("closed", 0, 0, since, skipped) if good + 1 >= successes else ("half_open", 0, good + 1, since, skipped)


def breaker_fold(key: str, order: str, ok: str, ms: str, **limits) -> Fold:
    return Fold("state STRING, bad INT, good INT, since BIGINT, skipped INT", ("closed", 0, 0, 0, 0), lambda s, r: breaker_step(s, bool(r[ok]), int(r[ms]), **limits), order, ["state", "bad", "good", "since", "skipped"], key)


class LiveResults:
    """A bounded buffer of the newest rows of a stream, for a screen: lossy drops the oldest, else a full buffer refuses.

    ``order`` is the column that says which rows of a batch are newest. ``dropped`` counts all rows that are not shown any more.
    """

    def __init__(self, order: str, size: int = 1000, lossy: bool = True):
        self.order, self.size, self.lossy = order, size, lossy
        self.rows: list[tuple[int, dict]] = []
        self.sequence = self.dropped = 0

    def add(self, row: dict) -> bool:
        if len(self.rows) >= self.size:
            if not self.lossy:
                return False
            self.rows.pop(0)
            self.dropped += 1
        self.sequence += 1
        self.rows.append((self.sequence, row))
        return True

    def after(self, cursor: int) -> tuple[list[dict], int]:
        return [r for n, r in self.rows if n > cursor], self.sequence

    def step(self, batch: DataFrame, _: int) -> None:
        """For ``each_batch``: adds a batch, oldest first; of a lossy buffer only the newest ``size`` rows are fetched.

        A buffer that is not lossy takes a batch whole or raises, so that the stream repeats it once ``taken`` made room.
        """
        count = batch.count()
        if not self.lossy and len(self.rows) + count > self.size:
            raise BufferError(f"{count} rows for {self.size - len(self.rows)} free places")
        newest = batch.orderBy(F.desc(self.order)).limit(self.size).collect()
        self.sequence += count - len(newest)
        self.dropped += count - len(newest)
        for row in reversed(newest):
            self.add(row.asDict())

    def taken(self, cursor: int) -> None:
        """Frees the rows up to ``cursor``, which a reader has had."""
        self.rows = [(n, r) for n, r in self.rows if n > cursor]
