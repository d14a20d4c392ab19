import pytest
from conftest import rows

from sightline.operators import lexical as L
from sightline.operators.segments import SegmentedIndex
from sightline.session import shared_dir

SCHEMA = "doc_id string, text string"


def hits(spark, index, query):
    q = spark.createDataFrame([(1, query)], "item_id int, query string")
    return {r.doc_id for r in L.search_queries(index, q, 50, "item_id", "query").collect()}


def docs(spark, some):
    return spark.createDataFrame(list(some.items()), SCHEMA)


def test_updates_and_deletes_show_at_once_and_old_versions_stay(spark):
    index = SegmentedIndex(spark, shared_dir(spark, "segments"))
    assert index.open() is None and index.due() == []
    index.add(docs(spark, {"a": "red fox", "b": "red hen", "c": None}))
    index.add(docs(spark, {"a": "blue fox", "d": "red dog"}))
    assert hits(spark, index.open(), "red") == {"b", "d"} and hits(spark, index.open(), "blue fox") == {"a"}
    index.delete(docs(spark, {"b": "", "zz": ""}))
    assert hits(spark, index.open(), "red") == {"d"} and hits(spark, index.open(1), "red") == {"a", "b"}
    index.add(docs(spark, {"b": "red again"}))
    assert hits(spark, index.open(), "red") == {"b", "d"} and hits(spark, index.open(), "hen") == set()
    # dead documents count in statistics until a merge drops them
    assert index.open().statistics.first().docs == 6
    index.merge(index.due(dead_share=0.1))
    assert len(index.manifest()["segments"]) == 1 and index.open().statistics.first().docs == 4
    assert hits(spark, index.open(), "red") == {"b", "d"} and hits(spark, index.open(3), "red") == {"d"}


def test_a_grown_and_merged_index_equals_one_built_at_once(spark):
    texts = {str(i): " ".join(w for j, w in enumerate("alpha beta gamma delta epsilon zeta".split()) if (i * 7 + j) % 3) + f" n{i}" for i in range(40)}
    index, at = SegmentedIndex(spark, shared_dir(spark, "segments")), 0
    for n in (3, 3, 3, 3, 20, 8):
        index.add(docs(spark, dict(list(texts.items())[at : at + n])))
        at += n
    due = index.due(fan_out=4)
    assert [s["docs"] for s in due] == [3, 3, 3, 3]
    index.merge(due)
    assert [s["docs"] for s in index.manifest()["segments"]] == [12, 20, 8] and index.due(fan_out=4) == []
    q = spark.createDataFrame([(1, "alpha n5"), (2, "zeta gamma")], "item_id int, query string")
    whole = L.build_index(docs(spark, texts))
    a, b = (rows(L.search_queries(i, q, 9, "item_id", "query")) for i in (whole, index.open()))
    assert a == b and len(a) == 18


def test_one_of_two_writers_is_refused_and_fields_are_fixed(spark):
    path = shared_dir(spark, "segments")
    index = SegmentedIndex(spark, path)
    index.add(docs(spark, {"a": "x"}))
    index.version = lambda: 0
    with pytest.raises(RuntimeError):
        index._commit(0, {"segments": [], "tombstones": [], "next": 1})
    with pytest.raises(ValueError):
        SegmentedIndex(spark, path, {"content": "title"})
    assert hits(spark, SegmentedIndex(spark, path).open(), "x") == {"a"}
