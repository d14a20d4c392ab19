import json
import random

import pytest

from conftest import rows
from sightline.operators.incremental import IncrementalRun, committed_positions, descend, height, pending_records, tree
from sightline.session import shared_dir
from sightline.sources import files

CHECKPOINT = "consumer_id string, last_applied_seq bigint, updated_ts bigint, run_state string"


def test_pending_equals_brute_force(spark):
    rng = random.Random(3)
    seqs = [rng.randrange(-50, 5000) for _ in range(900)] + [7] * 300 + [None] * 5
    log = spark.createDataFrame([(s, "x") for s in seqs], "stream_seq bigint, _key string")
    runs = [
        (" A ", 100, 1, "committed"), ("a", 3000, 2, "committed"), ("a", 4000, 3, "failed"),
        ("b", None, 9, "committed"), ("c", 99_999, 1, "committed"), ("d", 10, None, "committed"),
        ("e", -60, 5, "committed"), ("f", 64, 1, "committed"), ("f", 63, 1, "committed"), (None, 1, 1, "committed"),
    ]
    where = {"a": 3000, "b": None, "c": 99_999, "d": 10, "e": -60, "f": 64}
    want = sorted(((c, s) for c, p in where.items() for s in set(seqs) - {None} if p is None or s > p), key=repr)
    got = pending_records(spark, log, spark.createDataFrame(runs * 2, CHECKPOINT), width=16, fanout=4)
    assert rows(got) == want


def test_pending_of_empty_tables(spark):
    log = spark.createDataFrame([], "stream_seq bigint")
    runs = spark.createDataFrame([("a", 1, 1, "committed")], CHECKPOINT)
    assert rows(pending_records(spark, log, runs)) == []
    assert rows(pending_records(spark, spark.createDataFrame([(1,)], "stream_seq bigint"), runs.limit(0))) == []


def test_positions_of_huge_keys_stay_exact(spark):
    top = 2**62
    log = spark.createDataFrame([(top + i,) for i in range(-3, 4)], "stream_seq bigint")
    runs = spark.createDataFrame([("a", top, 1, "committed")], CHECKPOINT)
    assert [r[1] - top for r in rows(pending_records(spark, log, runs))] == [1, 2, 3]


def test_committed_positions(spark):
    runs = [("x", 5, 1, "committed"), ("X ", 9, 2, "failed"), ("y", None, 3, None)]
    assert rows(committed_positions(spark.createDataFrame(runs, CHECKPOINT))) == [("x", 5), ("y", None)]


def test_descent_finds_changed_leaves_only(spark):
    old = spark.createDataFrame([(i, i) for i in range(0, 400)], "_key bigint, _row bigint")
    new = spark.createDataFrame([(i, i + (i == 130)) for i in range(0, 410)], "_key bigint, _row bigint")
    levels = height(new, "_key", 10, 4)[0]
    got = descend(tree(new, "_key", "_row", levels, 10, 4), tree(old, "_key", "_row", levels, 10, 4), fanout=4)
    assert rows(got) == [(13,), (40,)]


def test_runs_process_each_record_once(spark):
    path, seen = shared_dir(spark, "runs"), []
    job = IncrementalRun(spark, path, "id", width=8, fanout=4)
    schema = "id bigint, v string, _row string"

    def process(df):
        seen.append(rows(df))
        return df

    one = [(i, "a", None) for i in range(50)] + [(3, "a", None), (None, "n", None)]
    job.run(spark.createDataFrame(one, schema).drop("_row"), process)
    assert [r[0] for r in sorted(seen[-1])] == list(range(50))
    two = [(i, "b" if i == 20 else "a", None) for i in range(60)]
    df = spark.createDataFrame(two, schema).drop("_row")

    def broken(_):
        raise ValueError("lost")

    with pytest.raises(ValueError):
        job.run(df, broken)
    got = job.run(df, process)
    assert sorted(seen[-1]) == [(20, "b"), *[(i, "a") for i in range(50, 60)]]
    assert sorted(map(tuple, got.collect())) == sorted(seen[-1])
    job.run(df, process)
    assert seen[-1] == []


def test_unchanged_groups_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(IncrementalRun, "RUNS_MOST", 3)
    job, seen = IncrementalRun(spark, shared_dir(spark, "runs"), "id", width=4, fanout=2), []

    def process(df):
        seen.append(rows(df))
        return df

    table, want = {}, []
    for n in range(6):
        new = {100 * n + i: f"v{n}" for i in range(30)} | ({5: f"again{n}"} if n % 2 else {})
        table |= new
        want.append(sorted(new.items()))
        # rows that repeat change no outcome
        job.run(spark.createDataFrame([*table.items(), *list(table.items())[: 7 * n]], "id bigint, _all string"), process)
    assert [sorted(s) for s in seen] == want
    runs = [len(json.loads(files.read_text(spark, f"{job.path}/runs/{n:08d}.json"))["runs"]) for n in range(1, 7)]
    assert runs[0] == 1 and max(runs) == 3 and 1 in runs[1:]
    # the second run wrote only the digests of the groups it changed
    second = json.loads(files.read_text(spark, f"{job.path}/runs/00000002.json"))
    written = spark.read.parquet(f"{job.path}/records/run={second['levels'][0].split('/')[0]}")
    assert written.count() < 60 and written.where("_key BETWEEN 20 AND 29").count() == 0


def test_a_table_that_ever_was_empty(spark):
    job = IncrementalRun(spark, shared_dir(spark, "runs"), "id")
    empty = spark.createDataFrame([], "id bigint, v string")
    assert rows(job.run(empty, lambda d: d)) == [] and rows(job.run(empty, lambda d: d)) == []
    assert rows(job.run(spark.createDataFrame([(1, "a")], "id bigint, v string"), lambda d: d)) == [(1, "a")]
    assert rows(job.run(empty, lambda d: d)) == []


def test_pending_publishes_output_and_tree_together(spark, monkeypatch):
    path = shared_dir(spark, "pending")
    log = spark.createDataFrame([(i,) for i in range(100)], "stream_seq bigint")
    runs = spark.createDataFrame([("a", 49, 1, "committed")], CHECKPOINT)
    write = files.write_new
    monkeypatch.setattr(files, "write_new", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        pending_records(spark, log, runs, width=8, fanout=4, path=path)
    assert files.list_names(spark, f"{path}/runs") == []
    monkeypatch.setattr(files, "write_new", write)
    for n in (1, 2):
        got = pending_records(spark, log, runs, width=8, fanout=4, path=path)
        assert [r[1] for r in rows(got)] == list(range(50, 100))
        published = json.loads(files.read_text(spark, f"{path}/runs/{n:08d}.json"))
        assert rows(spark.read.parquet(published["output"])) == rows(got)
        assert spark.read.parquet(published["tree"]).count() == 13
        saved = published["tree"].replace("/tree/", "/saved/")
        assert spark.read.parquet(saved).count() == 7
