import random

import pytest
from conftest import rows

from sightline.llm import rankfuse

HITS = "query_id bigint, doc_id bigint, final_score double, hits int"
PARTS = "query_id bigint, doc_id bigint, source string, raw_score double, weight double, scores string"
BAD = (None, float("nan"), float("inf"), float("-inf"))


def random_case(seed, queries=40, most=9):
    rng = random.Random(seed)
    hits, parts = [], []
    for q in range(queries):
        weights = {s: rng.choice([0.25, 0.5, 1.0]) for s in rng.sample(["lexical", "fast", "quality", None], rng.randrange(1, 5))}
        for d in range(rng.randrange(1, most)):
            hits.append((q, d, rng.choice([None, rng.random(), 0.5]), 0))
            for s, w in weights.items():
                if rng.random() < 0.85:
                    parts.append((q, d, s, rng.choice([*BAD, rng.randrange(3), rng.random() * 100]), w, ""))
    parts = [(q, d, s, float(r) if r is not None else None, w, x) for q, d, s, r, w, x in parts]
    return hits + hits[::3], parts + parts[::4]


def brute(hits, parts):
    final, score, weight = {}, {}, {}
    for q, d, f, _ in hits:
        final.setdefault(q, {})[d] = max(final.get(q, {}).get(d, float("-inf")), float("-inf") if f is None else f)
    for q, d, s, r, w, _ in parts:
        weight.setdefault(q, {})[s] = w
        if r is not None and r == r and abs(r) != float("inf"):
            score[q, d, s] = r
    out = []
    for q, docs in final.items():
        if len(docs) < 2:
            continue
        get = lambda d, s: score.get((q, d, s), float("-inf"))  # noqa: B023, E731
        for a in docs:
            wins = all(sum(w for s, w in weight.get(q, {}).items() if get(a, s) > get(b, s)) > sum(w for s, w in weight.get(q, {}).items() if get(b, s) > get(a, s)) for b in docs if b != a)
            if wins and any(docs[b] > docs[a] for b in docs if b != a):
                out.append((q, a))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [0, 1])
def test_preferred_equals_brute_force(spark, seed):
    hits, parts = random_case(seed)
    want = brute(hits, parts)
    assert want
    assert rows(rankfuse.preferred(spark.createDataFrame(hits, HITS), spark.createDataFrame(parts, PARTS))) == want


def test_a_query_with_very_many_hits_is_played_in_parts(spark, monkeypatch):
    monkeypatch.setattr(rankfuse, "PART", 4)
    hits, parts = random_case(3, queries=6, most=90)
    for q in range(6):  # a hit that every source puts first
        hits.append((q, 500 + q, 0.01, 0))
        parts += [(q, 500 + q, s, 1e6, w, "") for s, w in {p[2]: p[4] for p in parts if p[0] == q}.items()]
    want = brute(hits, parts)
    assert len(want) >= 4
    df = spark.createDataFrame(hits, HITS), spark.createDataFrame(parts, PARTS)
    assert rows(rankfuse.preferred(*df)) == want
    ranks = rankfuse.ranking(*df).collect()
    for q in range(6):
        mine = sorted((r.rank, -r.fused_score, r.doc_id) for r in ranks if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and mine == sorted(mine, key=lambda m: (m[1], m[2]))


def test_no_source_decides_by_its_range(spark):
    parts = [(0, d, s, v, 1.0, "") for d, (a, b, c) in enumerate([(1e9, 0.1, 0.1), (9e8, 0.9, 0.8), (5.0, 0.5, 0.5), (7.0, 0.4, 0.4)]) for s, v in zip("abc", (a, b, c))]
    got = rankfuse.ranking(spark.createDataFrame([(0, d, 0.0, 0) for d in range(4)], HITS), spark.createDataFrame(parts, PARTS))
    assert got.where("rank = 1").first().doc_id == 1
    assert all(0 < r.fused_score < 1 for r in got.collect())


def test_edges(spark):
    hits = spark.createDataFrame([(0, 1, 0.5, 0), (1, 1, None, 0), (1, 2, 0.1, 0), (None, 3, 1.0, 0), (2, None, 1.0, 0)], HITS)
    none = spark.createDataFrame([], PARTS)
    assert rows(rankfuse.preferred(hits, none)) == [] and rankfuse.ranking(hits, none).count() == 3
    assert rows(rankfuse.preferred(hits.limit(0), none)) == [] and rankfuse.ranking(hits.limit(0), none).count() == 0
    flat = spark.createDataFrame([(1, 1, "s", 2.0, 1.0, ""), (1, 2, "s", 2.0, 1.0, "")], PARTS)
    assert rows(rankfuse.preferred(hits, flat)) == []
    better = spark.createDataFrame([(1, 1, "s", 3.0, 1.0, ""), (1, 2, "s", 2.0, None, "")], PARTS)
    assert rows(rankfuse.preferred(hits, better)) == [(1, 1)]


def test_a_hot_query_is_joined_without_gathering_it(spark, monkeypatch):
    from sightline.operators import ranking

    monkeypatch.setattr(ranking, "HOT_ROWS", 5)
    hits, parts = random_case(4, queries=30, most=12)
    df = spark.createDataFrame(hits, HITS), spark.createDataFrame(parts, PARTS)
    assert rows(rankfuse.preferred(*df)) == brute(hits, parts)
