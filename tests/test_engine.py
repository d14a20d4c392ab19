from pyspark.sql import functions as F

from sightline.functions import vectors as V
from sightline.operators.refine import overlap_scorer
from sightline.plans.engine import Engine, Settings
from sightline.session import shared_dir

DOCS = [
    ("1", "the quick brown fox jumps", "fox", 10), ("2", "lazy dogs sleep all day", "dogs", 20), ("10", "a fox and a dog are friends", "friends", 30),
    ("4", None, None, 40), ("5", "", "", 50), ("6", "quick quick quick answers about search engines", "answers", 60),
]


def engine(spark, **more):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string, title string, size int")
    return Engine(spark, **more).index(docs)


def ids(df):
    return [r.doc_id for r in df.orderBy("rank").collect()]


def test_hybrid_search_finds_and_orders(spark):
    r = engine(spark).search("quick fox", 3)
    assert ids(r.initial)[0] == "1" and r.refined is None and r.query_class == "short_keyword"


def test_empty_query_and_zero_limit(spark):
    e = engine(spark)
    assert ids(e.search("  ", 3).initial) == [] and ids(e.search("fox", 0).initial) == []


def test_exclusion_filters_both_lanes(spark):
    assert "10" not in ids(engine(spark).search("fox -friends", 5).initial)
    assert "1" not in ids(engine(spark).search("fox", 5, where=F.col("size") > 15).initial)


def test_refinement_and_reranking(spark):
    embed = lambda q: V.hash_vector(q, 64)
    e = engine(spark, embed=embed, embed_quality=embed, scorer=overlap_scorer)
    e.quality = e.fast
    r = e.search("quick fox", 3)
    assert r.refined is not None and ids(r.refined)[0] == "1"
    assert r.changes.count() == 1 and r.reranked.count() == r.refined.count()


def test_written_index_gives_the_same_results(spark):
    e = engine(spark)
    path = shared_dir(spark, "index")
    e.write(path)
    again = Engine(spark).open(path)
    assert ids(again.search("quick fox", 3).initial) == ids(e.search("quick fox", 3).initial)


def test_strategies_and_snippets(spark):
    e = engine(spark, settings=Settings(strategy="pool_minmax", diversify=True))
    r = e.search("quick", 3, metadata=True)
    assert {"size", "title"} <= set(r.initial.columns)
    s = e.snippets("quick", r.initial.select("doc_id", "rank")).where("doc_id = '1'").first().snippet
    assert "<b>quick</b>" in s
