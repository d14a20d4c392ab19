import random
from concurrent.futures import ThreadPoolExecutor

from conftest import rows
from sightline.operators import changefeed
from sightline.operators.changefeed import BucketedTable, catalog_changes, current_catalog, winning_changes
from sightline.session import shared_dir
from sightline.sources import files

SCHEMA = "stream_seq bigint, file_key string, revision bigint, change_kind string, pipeline_status string"


def brute(changes):
    best = {}
    for seq, key, rev, kind, _ in changes:
        if key is None or rev is None or kind is None:
            continue
        mark = (rev, seq is not None, seq or 0, kind.strip().lower())
        best[key] = max(best.get(key, mark), mark)
    return sorted(((k, m[2] if m[1] else None) for k, m in best.items() if m[3] != "delete"), key=repr)


def feed(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(["create", "modify", " Modify", "DELETE", "delete ", None])
        key = rng.choice(["hot"] * 5 + [f"f{rng.randrange(20)}", None, ""])
        out.append((rng.choice([i, i, None]), key, rng.choice([None, *range(6)]), kind, rng.choice(["ok", None])))
    return out + out[: n // 3]


def test_current_state_equals_brute_force(spark):
    changes = feed(300, 1)
    df = spark.createDataFrame(changes, SCHEMA)
    for batches in (1, 2, 5):
        assert rows(current_catalog(spark, df, shared_dir(spark, "t"), 4, batches)) == brute(changes)


def test_batches_in_any_order_and_repeated_lead_to_the_same_state(spark):
    changes = feed(200, 2)
    parts = [changes[150:], changes[:70], changes[60:160], changes[:70]]
    table = BucketedTable(spark, shared_dir(spark, "t"), "file_key", ["revision", "stream_seq"], ["change_kind"], 4)
    for part in parts:
        table.apply(catalog_changes(spark.createDataFrame(part, SCHEMA)))
    got = table.state().where("change_kind <> 'delete'").select("file_key", "stream_seq")
    assert rows(got) == brute(changes)
    assert table.versions() == [1, 2, 3, 4]


def test_only_touched_buckets_are_replaced_and_old_versions_stay_readable(spark):
    table = BucketedTable(spark, shared_dir(spark, "t"), "file_key", ["revision", "stream_seq"], ["change_kind"], 16)
    first = [(i, f"f{i}", 1, "create", None) for i in range(100)]
    table.apply(catalog_changes(spark.createDataFrame(first, SCHEMA)))
    before = table.manifest()["parts"]
    table.apply(catalog_changes(spark.createDataFrame([(200, "f3", 2, "delete", None)], SCHEMA)))
    after = table.manifest()["parts"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert table.state(1).where("file_key = 'f3'").first().change_kind == "create"
    # a late change with a lower revision does not revive the deleted file
    table.apply(catalog_changes(spark.createDataFrame([(300, "f3", 1, "modify", None)], SCHEMA)))
    assert table.state().where("file_key = 'f3'").first().change_kind == "delete"


def test_empty_feed_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows(current_catalog(spark, empty, shared_dir(spark, "t"))) == []
    odd = spark.createDataFrame([(1, "a", 1, "create", "x", 5)], SCHEMA + ", bucket int")
    assert rows(current_catalog(spark, odd, shared_dir(spark, "t"))) == [("a", 1)]


def test_two_writers_cannot_commit_the_same_version(spark):
    table = BucketedTable(spark, shared_dir(spark, "t"), "file_key", ["revision"], ["change_kind"], 2)
    assert table._commit(0, {"parts": {}}) == 1
    try:
        table._commit(0, {"parts": {}})
        raise AssertionError("second commit went through")
    except RuntimeError:
        pass


def test_ties_fall_to_the_greatest_payload(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", None, "z")], "k string, o int, p string")
    assert rows(winning_changes(df, "k", ["o"], ["p"])) == [("a", 1, "y")]


def test_the_query_merges(spark, monkeypatch):
    merged = []
    merge = BucketedTable._merge
    monkeypatch.setattr(BucketedTable, "_merge", lambda self, *a: merged.append(1) or merge(self, *a))
    changes = feed(300, 5)
    assert rows(current_catalog(spark, spark.createDataFrame(changes, SCHEMA), shared_dir(spark, "t"))) == brute(changes)
    assert merged == [1]


def test_buckets_follow_the_number_of_keys(spark, monkeypatch):
    monkeypatch.setattr(changefeed, "BUCKET_ROWS", 10)
    monkeypatch.setattr(changefeed, "FEWEST", 1)
    table = BucketedTable(spark, shared_dir(spark, "t"), "file_key", ["revision", "stream_seq"], ["change_kind"])
    seen, changes = [], []
    for n in (15, 40, 200, 5):
        new = [(i, f"f{i}", 1, "create", None) for i in range(len(changes), len(changes) + n)]
        changes += new
        table.apply(catalog_changes(spark.createDataFrame(new, SCHEMA)))
        seen.append(table.manifest()["buckets"])
    assert seen == [2, 2, 32, 32] and sum(table.manifest()["rows"].values()) == 260
    assert rows(table.state().select("file_key", "stream_seq")) == brute(changes)


def test_vacuum_deletes_what_no_kept_manifest_names(spark):
    table = BucketedTable(spark, shared_dir(spark, "t"), "file_key", ["revision", "stream_seq"], ["change_kind"], 2)
    for n in range(4):
        table.apply(catalog_changes(spark.createDataFrame([(n, f"f{i}", n, "modify", None) for i in range(20)], SCHEMA)))
    files.write_new(spark, f"{table.path}/data/underway/part", "x")
    assert len(table.vacuum(keep=2)) == 2 and table.versions() == [3, 4]
    assert table.state().where("revision = 3").count() == 20 and table.state(3).where("revision = 2").count() == 20
    assert table.vacuum(keep=2, grace_ms=-10_000) == ["underway"]


def test_only_one_of_many_writers_publishes_a_file(spark):
    path = f"{shared_dir(spark, 't')}/claim.json"
    texts = [str(n) * 10_000 for n in range(8)]
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda t: files.write_new(spark, path, t), texts))
    assert sum(won) == 1 and files.read_text(spark, path) == texts[won.index(True)]
    assert not files.write_new(spark, path, "late") and files.list_names(spark, path.rsplit("/", 1)[0]) == ["claim.json"]
