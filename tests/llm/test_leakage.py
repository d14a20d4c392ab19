import random

import numpy as np
from sightline.llm import leakage
from sightline.llm.lookalike import words

VOCAB = [f"w{i}x" for i in range(400)] + ["the", "of", "naïve", "БОР", "Ωmega"]


def corpus(seed=0):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices(VOCAB, k=rng.randrange(8, 40)))) for i in range(12)]
    docs = []
    for d in range(120):
        base = rng.choices(VOCAB, k=rng.randrange(0, 120))
        if d % 3 == 0:
            w = rng.choice(items)[1].split()
            n = rng.randrange(10, 16)
            at = rng.randrange(0, max(1, len(w) - n))
            base[5:5] = [x.upper() if rng.random() < 0.3 else x for x in w[at : at + n]]
        docs.append((d, rng.choice([" ", ", ", " "]).join(base)))
    return docs + [(200, None), (201, ""), (202, "one word")], items + [(50, None), (51, ""), (52, "short")]


def brute(docs, items, window=13):
    grams = {}
    for i, p in items:
        w = words(p or "")
        for k in range(len(w) - window + 1):
            grams.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words(t or "")
        for k in range(len(w) - window + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + window]), ())}
    return out


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, item_id int"), spark.createDataFrame(items, "item_id bigint, passage string")


def test_shared_passages_equal_brute_force(spark):
    docs, items = corpus()
    want = brute(docs, items)
    assert len(want) > 5
    d, i = frames(spark, docs, items)
    assert {tuple(r) for r in leakage.shared_passages(d, i).collect()} == want


def test_passes_and_repeated_rows_change_nothing(spark):
    docs, items = corpus(1)
    d, i = frames(spark, docs * 2, items * 2)
    got = [tuple(r) for r in leakage.shared_passages(d, i, items_per_pass=3).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items)


def test_unseen_differences_and_case_do_not_count(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    hidden = passage.replace("e", "е").replace("two", "t​wo").replace("six", "ｓｉｘ").upper()
    d, i = frames(spark, [(1, "x " + hidden + " y"), (2, passage.replace("seven", "zeven"))], [(9, passage)])
    assert [tuple(r) for r in leakage.shared_passages(d, i).collect()] == [(1, 9)]


def test_edited_passages_are_near_hits(spark):
    passage = " ".join(f"longword{k}abc" for k in range(40))
    edited = passage.replace("longword39abc", "other")
    d, i = frames(spark, [(1, edited)], [(9, passage)])
    r = leakage.leaks(d, i).first()
    assert r.similarity == 1 and r.exact_windows == 27 and r.windows >= 27


def test_blocks_find_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(0)
    index = leakage.ItemIndex([1], ["a"], 13, 3)
    index.windows.prints = rng.integers(0, 2**63, 500, dtype=np.uint64)
    index.__init__([1], ["a"], 13, 3)
    index.windows.prints = rng.integers(0, 2**63, 500, dtype=np.uint64)
    index.blocks = []
    for b in range(4):
        key = index._block(index.windows.prints, b)
        order = np.argsort(key, kind="stable")
        index.blocks.append((order, key[order], np.searchsorted(key[order], np.arange(65537))))
    flips = np.array([sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(500)], dtype=np.uint64)
    prints = index.windows.prints ^ flips
    i, j = index.within_radius(prints)
    all_i, all_j = np.nonzero(np.bitwise_count(prints[:, None] ^ index.windows.prints[None, :]) <= 3)
    assert set(zip(i, j)) == set(zip(all_i, all_j)) and len(i) == len(set(zip(i, j)))


def test_empty_tables(spark):
    docs, items = corpus(2)
    d, i = frames(spark, docs, items)
    assert leakage.shared_passages(d.limit(0), i).collect() == []
    assert leakage.shared_passages(d, i.limit(0)).collect() == []


def alike(a, b, window=13, shingle=5):
    """Weighted Jaccard similarities of all windows of two word lists."""
    out = []
    for i in range(len(a) - window + 1):
        for j in range(len(b) - window + 1):
            x, y = ([tuple(t[k + o : k + o + shingle]) for o in range(window - shingle + 1)] for t, k in ((a, i), (b, j)))
            wx, wy = ([sum(map(len, s)) for s in t] for t in (x, y))
            common = min(sum(w for s, w in zip(x, wx) if s in y), sum(w for s, w in zip(y, wy) if s in x))
            out.append(common / (sum(wx) + sum(wy) - common))
    return out


def test_edited_copies_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leakage, "STEP_POSTINGS", 50, raising=False)
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices(VOCAB, k=rng.randrange(30, 50)))) for i in range(15)] + [(90, "la " * 20)]
    docs = []
    for i, p in items:
        w = p.split()
        edited = [f"new{k}" if k % 13 == 6 else x for k, x in enumerate(w)]
        docs.append((i, " ".join(["before", *edited, "after"])))
        docs.append((100 + i, " ".join(w[3:15] + ["cut"] + w[15:])))
    want = {}
    for d, t in docs:
        for i, p in items:
            if s := [x for x in alike(words(t), words(p)) if x >= 0.8]:
                want[d, i] = (len(s), round(max(s), 9))
    got = {(r.doc_id, r.item_id): (r.windows, round(r.similarity, 9)) for r in leakage.leaks(*frames(spark, docs, items)).collect()}
    assert len(want) > 15 and got == want
    inexact = [r for r in leakage.leaks(*frames(spark, docs, items)).collect() if r.exact_windows == 0]
    assert inexact
