import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from sightline.llm import knn

SCHEMA = "entry_id bigint, embedder_id string, value array<float>, id int"


def clustered(n, seed=0, size=64):
    """Unit-free vectors of a crowded topic and scattered ones, many with near partners."""
    rng = np.random.default_rng(seed)
    topic = rng.normal(size=size)
    x = rng.normal(size=(n, size))
    x[: n // 3] += 3 * topic
    for i in range(0, n - 1, 2):
        if rng.random() < 0.5:
            x[i + 1] = x[i] + rng.normal(size=size) * rng.choice([0.05, 0.2, 0.4])
    return x * rng.uniform(0.1, 10, size=(n, 1))


def truth(x, ids, k, least):
    """Per id the list of (neighbour, cosine), ties by id."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    out = {}
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i and s[i, j] >= least), key=lambda j: (-round(s[i, j], 12), ids[j]))[:k]
        out[ids[i]] = [ids[j] for j in order]
    return out


def cosine(x, a, b):
    return x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) + 1e-6


def frame(spark, x, ids, group="e"):
    return spark.createDataFrame([(int(i), group, [float(v) for v in r], 0) for i, r in zip(ids, x)], SCHEMA)


def test_recall_against_brute_force(spark):
    x = clustered(3000)
    ids = list(range(3000))
    want = truth(x, ids, 10, 0.9)
    got = {}
    for r in knn.neighbours(frame(spark, x, ids), cell_rows=100).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    pairs = {(a, b) for a, bs in want.items() for b in bs}
    found = {(a, b) for a, bs in got.items() for b in bs}
    assert len(pairs) > 300
    # where a true neighbour is missed the next one moves up, which is no other error
    assert len(pairs & found) / len(pairs) >= 0.97 and all(cosine(x, a, b) >= 0.9 for a, b in found)


def test_mutual_pairs_and_split_cells(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 150)
    monkeypatch.setattr(knn, "QUERY_ROWS", 400)
    x = clustered(900, 1)
    ids = list(range(900))
    want = truth(x, ids, 10, 0.9)
    mutual = {(a, b) for a, bs in want.items() for b in bs if a < b and a in want[b]}
    got = [tuple(r) for r in knn.mutual_pairs(frame(spark, x, ids), cell_rows=10_000).collect()]
    assert len(got) == len(set(got)) and len(mutual & set(got)) / len(mutual) >= 0.97
    assert all(a < b and cosine(x, a, b) >= 0.9 for a, b in got)


def test_lower_radius_finds_more(spark):
    x = clustered(800, 2)
    want = truth(x, list(range(800)), 5, 0.6)
    near = knn.neighbours(frame(spark, x, range(800)), k=5, min_cosine=0.6, cell_rows=200)
    found = {(r.id, r.neighbour) for r in near.collect()}
    pairs = {(a, b) for a, bs in want.items() for b in bs}
    assert len(pairs & found) / len(pairs) >= 0.9


def test_unusable_repeated_and_foreign_rows(spark):
    one = [1.0] * 64
    bad = [(1, "e", one, 0), (1, "e", one, 0), (2, "e", [2.0] * 64, 0), (3, "f", one, 0), (4, "e", None, 0), (5, "e", [], 0), (6, "e", [1.0] * 32, 0), (7, "e", [0.0] * 64, 0), (8, "e", [float("nan")] * 64, 0), (9, "e", [float("inf")] * 64, 0), (None, "e", one, 0), (10, None, one, 0), (11, None, one, 0), (12, "e", [None] * 64, 0)]
    df = spark.createDataFrame(bad, SCHEMA)
    assert rows(knn.mutual_pairs(df)) == [(1, 2), (10, 11)]
    assert rows(knn.mutual_pairs(df.limit(0))) == []
    assert rows(knn.mutual_pairs(df.where("entry_id = 7"))) == []


def test_very_many_copies_keep_the_answer_of_ties_by_id(spark):
    one, two = [1.0] * 64, [1.0] * 63 + [1.05]
    df = spark.createDataFrame([(i, "e", one, 0) for i in range(400)] + [(1000 + i, "e", two, 0) for i in range(3)], SCHEMA)
    got = set(rows(knn.mutual_pairs(df, k=5)))
    assert {(a, b) for a, b in got if b < 400} == {(a, b) for a in range(6) for b in range(a + 1, 6)}
    assert {p for p in got if p[0] >= 1000} == {(1000, 1001), (1000, 1002), (1001, 1002)}


def counted(block, q, half, threshold, *more):
    i, j = block.colliding(q, q @ block.directions.T, np.arange(len(q)), half, threshold, -np.inf, *more)
    return set(zip(i.tolist(), block.ids[j].tolist()))


@pytest.mark.parametrize("stripe,dense", [(64, 3), (100, 0), (2_048, 10**6)])
def test_windows_count_what_plain_counting_counts(monkeypatch, stripe, dense):
    monkeypatch.setattr(knn, "STRIPE", stripe)
    monkeypatch.setattr(knn, "DENSE", dense)
    monkeypatch.setattr(knn, "STEP_WORDS", 7)
    monkeypatch.setattr(knn, "REACH", 100.0)
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(300, 16)).astype(np.float32), rng.normal(size=(20, 16)).astype(np.float32)
    block = knn.Block(np.arange(300), x, 12, 1)
    gap = np.abs((q @ block.directions.T)[:, None, :] - (x @ block.directions.T)[None])
    got = counted(block, q, 0.7, 7, {}, knn.Counts(), False)
    # windows end at marks: never narrower than asked for, at most a mark wider on either side
    exact, wider = (set(zip(*(n.tolist() for n in np.nonzero((gap <= w).sum(2) >= 7)))) for w in (0.7, 0.7 + 1.01 * block.mark))
    assert exact <= got <= wider and exact
    # widened windows count what they would have counted at once, for the queries that are left
    held, counts = {}, knn.Counts()
    counted(block, q, 0.3, 7, held, counts, True)
    i, j = block.colliding(q, q @ block.directions.T, np.arange(5, 20), 0.7, 7, -np.inf, held, counts, False, 0.3)
    assert set(zip(i.tolist(), block.ids[j].tolist())) == {p for p in got if p[0] >= 5}


def test_stripes_out_of_reach_are_passed_over():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(9_000, 16)).astype(np.float32)
    x[:, 0] *= 40
    block, q = knn.Block(np.arange(9_000), x, 12, 1), x[:50]
    seen = []
    for s in block.stripes:
        s.count = lambda *a, _count=s.count, **k: seen.append(a[1].shape[1]) or _count(*a, **k)
    got = counted(block, q, 0.7, 9, {}, knn.Counts(), False)
    assert sum(seen) < 50 * len(block.stripes) / 2 and {(i, i) for i in range(50)} <= got


@pytest.mark.parametrize("blocks", [None, 60])
def test_cells_below_cells(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(knn, "BLOCK_ROWS", blocks)
    x = clustered(3000, 9)
    want = truth(x, list(range(3000)), 10, 0.9)
    made = []
    deepen = knn._deepen
    monkeypatch.setattr(knn, "_deepen", lambda *a: made.append(deepen(*a)) or made[-1])
    df = frame(spark, x, range(3000)).union(frame(spark, x[:40], range(3000, 3040), None))
    found = {(r.id, r.neighbour) for r in knn.neighbours(df, cell_rows=25, cells_most=8).where("grp IS NOT NULL").collect()}
    pairs = {(a, b) for a, bs in want.items() for b in bs}
    assert len(made[0]["e"].below) > 3 and len(pairs & found) / len(pairs) >= 0.97


@pytest.mark.parametrize("n", [1, 2])
def test_tiny_tables(spark, n):
    x = np.ones((n, 64))
    assert len(rows(knn.mutual_pairs(frame(spark, x, range(n))))) == n - 1


def lists(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append(r.neighbour)
    return out


@pytest.mark.parametrize("split", [False, True])
def test_without_a_floor_every_vector_has_k_neighbours(spark, monkeypatch, split):
    if split:
        monkeypatch.setattr(knn, "BLOCK_ROWS", 150)
        monkeypatch.setattr(knn, "ASK_ROWS", 400)
    x = clustered(1500, 4)
    want = truth(x, list(range(1500)), 10, -1)
    got = lists(knn.neighbours(frame(spark, x, range(1500)), min_cosine=None, cell_rows=400 if split else 100))
    assert set(got) == set(want) and all(len(set(bs)) == 10 for bs in got.values())
    assert sum(len(set(got[a]) & set(want[a])) for a in want) / 15_000 >= 0.97


def test_the_query_has_no_floor(spark, data):
    from sightline.llm import queries

    near = queries.p1_neighbours(spark, data)
    assert near.groupBy("grp", "id").count().where("count < 10").count() == 0 and near.where("cosine < 0.9").count() > 0


@pytest.mark.parametrize("least", [None, 0.9])
def test_every_copy_of_a_vector_has_neighbours(spark, least):
    x = np.concatenate([np.tile(np.arange(1.0, 65), (60, 1)), clustered(120, 5)])
    ids = np.random.default_rng(6).permutation(180)
    near = knn.neighbours(frame(spark, x, ids), k=5, min_cosine=least)
    got, copies = lists(near), sorted(int(i) for i in ids[:60])
    assert {i: got[i] for i in copies} == {i: [j for j in copies[:6] if j != i][:5] for i in copies}
    assert near.count() == sum(map(len, got.values())) and near.where(F.abs(F.col("cosine") - 1) < 1e-6).count() >= 300
    assert least or set(got) == {int(i) for i in ids}
