import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from sightline.operators import jobs as J
from sightline.operators import vector_search as S
from sightline.operators.generations import Generations
from sightline.session import shared_dir


def test_activation_rollback_time_travel_and_retention(spark):
    g = Generations(spark, shared_dir(spark, "gen"))
    assert g.current() is None and g.as_of(5) is None
    for name, v in (("one", 1), ("two", 2), ("three", 3)):
        spark.createDataFrame([(v,)], "v int").write.parquet(f"{g.folder(name)}/docs")
    g.activate("one", 10, ["docs"])
    g.activate("two", 20, ["docs"])
    with pytest.raises(ValueError):
        g.activate("three", 5)
    with pytest.raises(ValueError):
        g.activate("three", 30, ["lexical"])
    assert (g.current(), g.as_of(15), g.table("docs", 12).first().v) == ("two", "one", 1)
    assert g.rollback(30) == "one" and g.table("docs").first().v == 1
    g.activate("three", 40)
    assert g.retain(1, 1000, 100) == ["one", "two"] and g.current() == "three"


def test_cells_find_near_vectors(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 16))
    x = centres[rng.integers(0, 8, 600)] + 0.2 * rng.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "doc_id int, embedding array<float>")
    q = df.where("doc_id < 10").select(F.col("doc_id").alias("query_id"), "embedding")
    index = S.CellIndex.build(df, shared_dir(spark, "cells"), 16)
    assert index.rows.count() == 600
    truth = S.exact_top_k(df, q, 10)
    assert np.mean([r.recall for r in S.recall(index.search(q, 10, 4), truth).collect()]) >= 0.9
    assert rows(index.search(q, 10, 16).select("query_id", "doc_id")) == rows(truth.select("query_id", "doc_id"))


def test_small_records(spark):
    docs = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z"), ("b", " "), ("c", "ok")], "doc_id string, text string")
    assert rows(J.index_report(docs)) == [("a", "repeated id"), ("b", "no text"), (None, "no id")]
    marks = spark.createDataFrame([("a", "q", "n", 1), ("b", "q", "n", 1)], "doc_id string, query string, note string, created_at int")
    new = spark.createDataFrame([("a", "q", "", 5, "remove"), ("c", "q", "m", 2, "add"), ("c", "q", "k", 3, "add")], "doc_id string, query string, note string, created_at int, action string")
    assert rows(J.bookmarks_after(marks, new)) == [("b", "q", "n", 1), ("c", "q", "k", 3)]
    hits = lambda *x: spark.createDataFrame(list(x), "query_id int, doc_id string, score double, rank int")
    got = J.shadow_compare(hits((0, "a", 1.0, 0), (1, "a", 1.0, 0), (1, "b", 1.0, 1), (2, "a", 1.0, 0)), hits((0, "a", 2.0, 0), (1, "b", 1.0, 0), (1, "a", 1.0, 1), (2, "z", 1.0, 0)))
    assert rows(got) == [(0, "rank_exact"), (1, "score_epsilon"), (2, "diverged")]
    m = spark.createDataFrame([("s", 7, 1, "Hi there", "hello world")], "source_id string, conversation_id int, msg_idx int, title string, content string")
    r = J.conversation_columns(m).first()
    assert r.identity == "s:7:1" and r.title_prefix.startswith("hi th the")
