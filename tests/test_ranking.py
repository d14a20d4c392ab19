from conftest import rows
from pyspark.sql import functions as F

from sightline.operators import ranking


def test_pages(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "k string, v int")
    assert rows(ranking.page(df, ["k"], [F.desc("v")], 2, 1)) == [("a", 2, 2), ("a", 3, 1)]
    assert ranking.page(df, ["k"], [F.desc("v")], 0).count() == 0
    assert ranking.page(df, ["k"], [F.desc("v")]).count() == 6
    assert "WindowGroupLimit" in spark._jvm.PythonSQLUtils.explainString(ranking.page(df, ["k"], [F.desc("v")], 2)._jdf.queryExecution(), "simple")


def test_hot_keys_join_like_others(spark, monkeypatch):
    df = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1), ("none", 2)], "k string, v int")
    info = df.where("k <> 'none'").groupBy("k").agg(F.count("*").alias("n"))
    plain = rows(ranking.join_by_key(df, info, ["k"], "n"))
    monkeypatch.setattr(ranking, "HOT_ROWS", 10)
    assert rows(ranking.join_by_key(df, info, ["k"], "n")) == plain and len(plain) == 51


def test_places_are_right_when_ranges_part_a_key(spark):
    from pyspark.sql import functions as F
    from sightline.operators.ranking import numbered

    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        data = [(k, (i * 37) % 101) for k, n in (("hot", 300), ("cold", 3), (None, 20)) for i in range(n)]
        got = numbered(spark.createDataFrame(data, "k string, v int"), ["k"], [F.desc("v")]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for k in ("hot", "cold", None):
        mine = sorted((r.place, r.v) for r in got if r.k == k)
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1)) and [v for _, v in mine] == sorted((v for x, v in data if x == k), reverse=True)
