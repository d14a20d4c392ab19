import pytest
import json

from conftest import rows
from sightline.operators import adaptive as A
from sightline.operators.changefeed import BucketedTable, catalog_changes
from sightline.session import shared_dir
from sightline.sources import frames
from sightline.streaming import streams as S

FEED = "stream_seq bigint, file_key string, revision bigint, change_kind string"


def test_streamed_change_feed_equals_one_batch(spark):
    src, path = shared_dir(spark, "feed"), shared_dir(spark, "t")
    feed = [(i, f"f{i % 7}", i % 11, ("create", "modify", "delete")[i % 3]) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(feed[k::3], FEED).coalesce(1).write.mode("append").parquet(src)
    S.apply_changelog(S.read_parquet_stream(spark, src, 1), path, shared_dir(spark, "c"), 4).awaitTermination()
    table = BucketedTable(spark, path, "file_key", ["revision", "stream_seq"], ["change_kind"])
    whole = BucketedTable(spark, shared_dir(spark, "t"), "file_key", ["revision", "stream_seq"], ["change_kind"])
    whole.apply(catalog_changes(spark.createDataFrame(feed, FEED)))
    assert len(table.versions()) == 3
    assert rows(table.state().drop("bucket")) == rows(whole.state().drop("bucket"))


def test_events_sent_again_count_once(spark):
    src, out = shared_dir(spark, "events"), shared_dir(spark, "out")
    line = lambda i: json.dumps({"v": 1, "ts": "2026-01-01T00:00:00Z", "kind": "search", "event": {"event_id": f"e{i % 5}", "phase": "initial", "latency_us": i}})
    spark.createDataFrame([(line(i),) for i in range(15)] + [("not json",)], "value string").write.text(src)
    events = frames.search_events(S.envelope_stream(spark, src))
    S.to_parquet(S.distinct_events(events), out, shared_dir(spark, "c")).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [f"e{i}" for i in range(5)]


def test_windows_close_behind_the_watermark(spark):
    src, out = shared_dir(spark, "events"), shared_dir(spark, "out")
    schema = "project_key string, phase string, latency_us bigint, ts_ms bigint"
    hour = 3_600_000
    spark.createDataFrame([("p", "initial", 5, hour * h + 1) for h in range(1, 8)], schema).coalesce(1).write.parquet(src)
    S.to_parquet(S.windowed_counts(S.read_parquet_stream(spark, src)), out, shared_dir(spark, "c")).awaitTermination()
    got = rows(spark.read.parquet(out).select("window_start", "events"))
    assert got and all(n == 1 for _, n in got) and min(got)[0] == hour


def test_breaker_steps_equal_the_batch_fold(spark):
    outcomes = [(k, i, (i * 7 + k) % 3 != 0, i * 9_000) for k in range(4) for i in range(60)]
    df = spark.createDataFrame(outcomes, "k int, seq bigint, ok boolean, ms bigint")
    got = {r.k: (r.state, r.skipped) for r in A.circuit_breaker(df, ["k"], "seq", "ok", "ms", failures=1, successes=2).collect()}
    for k in range(4):
        state = ("closed", 0, 0, 0, 0)
        for _, _, ok, ms in [o for o in outcomes if o[0] == k]:
            state = S.breaker_step(state, ok, ms, failures=1, successes=2)
        assert got[k] == (state[0], state[4])


def test_a_live_buffer_drops_or_refuses():
    lossy, strict = S.LiveResults("i", 2), S.LiveResults("i", 2, lossy=False)
    for i in range(3):
        lossy.add({"i": i})
    assert [strict.add({"i": i}) for i in range(3)] == [True, True, False]
    assert lossy.after(1) == ([{"i": 1}, {"i": 2}], 3) and lossy.dropped == 1


def test_a_live_buffer_keeps_the_newest_rows_of_a_batch(spark):
    df = spark.createDataFrame([((i * 7) % 20,) for i in range(20)], "i int").repartition(5)
    lossy, strict = S.LiveResults("i", 3), S.LiveResults("i", 25, lossy=False)
    lossy.step(df, 0)
    assert [r["i"] for _, r in lossy.rows] == [17, 18, 19] and lossy.dropped == 17 and lossy.sequence == 20
    strict.step(df, 0)
    with pytest.raises(BufferError):
        strict.step(df, 1)
    rows, cursor = strict.after(0)
    assert [r["i"] for r in rows] == list(range(20)) and cursor == 20
    strict.taken(cursor)
    strict.step(df, 1)
    assert len(strict.rows) == 20 and strict.dropped == 0


def test_frames_round_trip_and_are_validated(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1)], "doc_id string, rank int")
    lines = [frames.frame("s", 0, "started"), *sorted(r.value for r in frames.encode_frames(df, "s").collect()), frames.frame("s", 3, "terminal")]
    assert frames.validate_frames(lines) == [] and frames.decode_frame(lines[1])["payload"]["doc_id"] == "a"
    assert len(frames.validate_frames(lines[1:])) == 1 and len(frames.validate_frames(lines[:-2])) == 1


def test_output_formats(spark):
    assert frames.toon("hits", [{"id": "a,b", "n": 1}, {"id": None, "n": 2.5}]) == 'hits[2]{id,n}:\n  "a,b",1\n  null,2.5'
    df = spark.createDataFrame([("a", 0)], "doc_id string, rank int")
    for form in ("jsonl", "csv", "table", "toon"):
        frames.write(df, shared_dir(spark, form), form)


def test_streamed_folds_equal_the_batch_folds(spark):
    src, out = shared_dir(spark, "keys"), shared_dir(spark, "out")
    schema = "k string, seq bigint, v double"
    data = [(k, i, ((i * 37 + len(k)) % 11) / 10) for k in ("a", "bb") for i in range(20)]
    for part in (data[::2], data[1::2]):  # the second file's rows lie between those of the first
        spark.createDataFrame(sorted(part, key=lambda r: r[1]), schema).coalesce(1).write.mode("append").parquet(src)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = S.fold_stream(S.read_parquet_stream(spark, src), "k", S.ewma_fold("k", "seq", "v"), "k string, ewma double")
    S.each_batch_output(stream, out, shared_dir(spark, "c")).awaitTermination()
    got = {r.k: r.ewma for r in spark.read.parquet(out).collect()}
    want = {r.k: r.ewma for r in A.ewma(spark.createDataFrame(data, schema), ["k"], "seq", "v").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_a_stream_of_documents_keeps_a_segmented_index_current(spark, tmp_path):
    from sightline.operators import lexical as L
    from sightline.operators.segments import SegmentedIndex

    source, index = str(tmp_path / "in"), SegmentedIndex(spark, shared_dir(spark, "live"), {"content": "text"})
    for n, rows in enumerate([[("a", "red"), ("b", "red")], [("a", "blue"), (None, "red")], [("c", "red")]]):
        spark.createDataFrame(rows, "doc_id string, text string").coalesce(1).write.mode("append").parquet(source)
        S.refresh_index(S.read_parquet_stream(spark, source), index.path, str(tmp_path / "checkpoint"), {"content": "text"}, fan_out=2).awaitTermination()
        assert index.version() >= n + 1
    q = spark.createDataFrame([(1, "red")], "item_id int, query string")
    assert {r.doc_id for r in L.search_queries(index.open(), q, 9, "item_id", "query").collect()} == {"b", "c"}
    assert len(index.manifest()["segments"]) < 3
