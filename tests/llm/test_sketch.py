import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from sightline.llm import sketch


def test_every_value_is_within_the_error_of_its_bucket(spark):
    rng = random.Random(0)
    values = [s * 10 ** rng.uniform(-8, 15) for s in (1, -1) for _ in range(500)] + [0.0, 1.0, -1.0, 1e300, 1e-300, -3e-200]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", sketch.bucket(F.col("v")).alias("b")).withColumn("e", sketch.bucket_value(F.col("b"))).collect()
    assert all(abs(r.e - r.v) <= 0.01 * abs(r.v) * (1 + 1e-9) for r in got)
    ordered = sorted(got, key=lambda r: r.v)
    assert all(a.b <= b.b for a, b in zip(ordered, ordered[1:]))
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "v double")
    assert [r[0] for r in odd.select(sketch.bucket(F.col("v"))).collect()] == [None] * 3


def test_merged_sketches_equal_one_and_stay_within_the_error(spark):
    rng = np.random.default_rng(1)
    data = [(g, d, float(v)) for g in "ab" for d in range(5) for v in rng.lognormal(5, 3, 200) * rng.choice([1, -1], 200)]
    df = spark.createDataFrame(data, "g string, day int, v double")
    at = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    days = sketch.sketch(df, ["g", "day"], "v")
    merged = rows(sketch.percentiles(sketch.merge(days, ["g"]), ["g"], at))
    assert merged == rows(sketch.percentiles(sketch.sketch(df, ["g"], "v"), ["g"], at))
    for g, n, *found in merged:
        x = sorted(v for k, _, v in data if k == g)
        assert n == len(x)
        for q, e in zip(at.values(), found):
            true = x[int(q * (n - 1))]
            assert abs(e - true) <= 0.01 * abs(true) + 1e-9


EVENTS = "event_id string, project_key string, query_class string, phase string, latency_us bigint, ts_ms bigint, day string, n int"
DAY = 86_400_000


def events():
    out = []
    for d in range(6):
        for i in range(30):
            out.append((f"e{d}-{i}", "p", " A ", "Initial", 1000 * (3 if d == 4 else 1) + i, d * DAY + i, "x", 0))
    few = [(f"f{i}", "p", "a", "initial", 9000, 9 * DAY + i, "x", 0) for i in range(11)]
    odd = [("o1", None, "a", "initial", 5, 0, "x", 0), ("o2", "p", "a", "initial", None, 0, "x", 0), ("o3", "p", "a", "initial", -1, 0, "x", 0), ("o4", "p", "a", "initial", 5, None, "x", 0), ("o5", "q", None, None, 5, 0, "x", 0)]
    return out + out[:50] + few + odd


def test_slow_days(spark):
    df = spark.createDataFrame(events(), EVENTS)
    assert rows(sketch.slow_days(df)) == [("p", "a", "initial", "1970-01-05")]
    assert rows(sketch.slow_days(df, least=11)) == [("p", "a", "initial", "1970-01-05"), ("p", "a", "initial", "1970-01-10")]
    assert rows(sketch.slow_days(df.limit(0))) == []
    assert rows(sketch.slow_days(df.where("event_id = 'o5'"), least=1, factor=1.0)) == [("q", None, None, "1970-01-01")]


def test_each_event_counts_once(spark):
    df = spark.createDataFrame([("a", "p", "x", "y", 5, 0, "", 0)] * 3 + [("a", "p", "x", "y", 7, 0, "", 0)] + [(None, "p", "x", "y", 5, 0, "", 0)] * 2, EVENTS)
    assert sorted(r.latency_us for r in sketch.usable_events(df).collect()) == [5, 5]


@pytest.mark.parametrize("error", [0.001, 0.05])
def test_other_errors(spark, error):
    df = spark.createDataFrame([(float(v),) for v in range(1, 500)], "v double")
    got = df.select("v", sketch.bucket_value(sketch.bucket(F.col("v"), error), error).alias("e")).collect()
    assert all(abs(r.e - r.v) <= error * r.v * (1 + 1e-9) for r in got)


def test_medians_of_even_numbers_are_means_of_the_middle_two(spark):
    days = [("d%d" % i, "p", "a", "b", v, DAY * (i < 12), "", 0) for i, v in enumerate([100] * 6 + [400] * 6 + [100] * 40)]
    df = spark.createDataFrame(days, EVENTS)
    assert rows(sketch.slow_days(df)) == [("p", "a", "b", "1970-01-02")]
    # of the group's 24 values too: its median is 250, not 100
    even = spark.createDataFrame([("d%d" % i, "p", "a", "b", v, DAY * (i < 12), "", 0) for i, v in enumerate([400] * 12 + [100] * 12)], EVENTS)
    assert rows(sketch.slow_days(even)) == [] and rows(sketch.slow_days(even, factor=1.55)) == [("p", "a", "b", "1970-01-02")]


def test_percentiles_between_ranks(spark):
    x = sorted(float(v) for v in np.random.default_rng(2).integers(1, 10_000, 37))
    df = spark.createDataFrame([("g", v) for v in x], "g string, v double")
    got = sketch.percentiles(sketch.sketch(df, ["g"], "v"), ["g"], {"a": 0.5, "b": 0.9, "c": 0.0, "d": 1.0}, between=True).first()
    for name, q in zip("abcd", (0.5, 0.9, 0.0, 1.0)):
        assert abs(got[name] - np.quantile(x, q)) <= 0.01 * np.quantile(x, q) * (1 + 1e-9)
