"""Percentiles from counts in signed logarithmic buckets of fixed relative width.

With a relative error ``a`` the buckets are the powers of ``(1 + a) / (1 - a)``; the
value returned for a bucket lies within ``a`` of everything in it, relative to the
value. Sketches are tables of (group, bucket, count): those of separate partitions,
days or projects are combined by adding matching buckets, which loses nothing. The
number of buckets of a group is bounded by the range of a double (some 142,000 at 1 %,
below a thousand for latencies), never by its rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERROR = 0.01
#: Values nearer to zero than this, the least that a double holds in full precision, count as zero.
SMALLEST = 2.2250738585072014e-308


def _gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def bucket(value: Column, error: float = ERROR) -> Column:
    """Signed bucket number: 0 for zero, growing with the value; null for null, NaN and infinite values."""
    v = value.cast("double")
    base = math.floor(math.log(SMALLEST) / math.log(_gamma(error))) - 1
    size = F.ceil(F.log(F.abs(v)) / F.lit(math.log(_gamma(error)))).cast("int") - F.lit(base)
    usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.when(usable, F.when(F.abs(v) < SMALLEST, F.lit(0)).when(v < 0, -size).otherwise(size)).cast("int")


def bucket_value(number: Column, error: float = ERROR) -> Column:
    """The value that stands for a bucket, within ``error`` of each value in it."""
    g = _gamma(error)
    base = math.floor(math.log(SMALLEST) / math.log(g)) - 1
    size = F.lit(2 / (1 + g)) * F.exp((F.abs(number) + F.lit(base)) * F.lit(math.log(g)))
    return F.when(number == 0, F.lit(0.0)).when(number < 0, -size).otherwise(size)


def sketch(df: DataFrame, keys: Sequence[str], value: str, error: float = ERROR) -> DataFrame:
    """(keys..., bucket, n): counts by bucket, combined on the map side; values without a bucket don't count."""
    numbered = df.select(*keys, bucket(F.col(value), error).alias("bucket")).where("bucket IS NOT NULL")
    return numbered.groupBy(*keys, "bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sketch over ``keys``, from a finer one: matching buckets are added."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, keys: Sequence[str], at: dict[str, float], error: float = ERROR, between: bool = False) -> DataFrame:
    """(keys..., n, one column for each of ``at``): the value at rank ``floor(q * (n - 1))`` from 0.

    With ``between`` the value at ``q * (n - 1)`` itself, between the two ranks beside it, so that the median of
    an even number is the mean of the middle two; as a mean of two values within ``error`` it is so too, if they have one sign.

    One pass over each group's buckets in order; a group has boundedly many.
    """
    order = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    ranked = sketches.withColumn("_to", F.sum("n").over(order)).withColumn("_n", F.sum("n").over(whole))

    def picked(rank: Column) -> Column:
        return F.min(F.when(F.col("_to") > rank, F.col("bucket")))

    places = {name: F.lit(q) * (F.col("_n") - 1) for name, q in at.items()}
    low = [picked(F.floor(p)).alias(f"_low_{name}") for name, p in places.items()]
    high = [picked(F.ceil(p)).alias(f"_high_{name}") for name, p in places.items()] if between else []
    out = ranked.groupBy(*keys).agg(F.max("_n").alias("n"), *low, *high)

    def value(name: str, q: float) -> Column:
        first = bucket_value(F.col(f"_low_{name}"), error)
        if not between:
            return first
        part = F.lit(q) * (F.col("n") - 1)
        return first + (bucket_value(F.col(f"_high_{name}"), error) - first) * (part - F.floor(part))

    return out.select(*keys, "n", *[value(name, q).alias(name) for name, q in at.items()])


GROUP = ["project_key", "query_class", "phase"]


def usable_events(events: DataFrame) -> DataFrame:
    """(project_key, query_class, phase, day, latency_us): usable events, each ``event_id`` once.

    ``latency_us`` above 0, ``project_key`` and ``ts_ms`` not null; ``query_class``
    and ``phase`` trimmed and in lower case; ``day`` the UTC date. Of different rows
    under one ``event_id`` the least counts; rows without an ``event_id`` count once
    for each different row.
    """
    blanks = F.lit(" \t\n\r\f\v")
    good = events.where("latency_us > 0 AND project_key IS NOT NULL AND ts_ms IS NOT NULL")
    day = F.date_from_unix_date(F.floor(F.col("ts_ms") / 86_400_000).cast("int"))
    named = good.select(
        "event_id",
        "project_key",
        F.lower(F.trim("query_class", blanks)).alias("query_class"),
        F.lower(F.trim("phase", blanks)).alias("phase"),
        day.alias("day"),
        "latency_us",
    )
    values = ["project_key", "query_class", "phase", "day", "latency_us"]
    once = F.coalesce("event_id", F.to_json(F.struct(*values)))
    kept = named.groupBy(once.alias("_event")).agg(F.min(F.struct(*values)).alias("_row"))
    return kept.select("_row.*")


def daily_sketch(events: DataFrame, error: float = ERROR) -> DataFrame:
    """(project_key, query_class, phase, day, bucket, n) of the usable events."""
    return sketch(usable_events(events), [*GROUP, "day"], "latency_us", error)


def slow_days(events: DataFrame, least: int = 12, factor: float = 2.0, error: float = ERROR) -> DataFrame:
    """(project_key, query_class, phase, day): days whose median is at least ``factor`` times the group's.

    Only days with ``least`` usable events are looked at. The median of an even number is the
    mean of the middle two, each within ``error``. The group's sketch is the
    sum of its days' sketches; both medians come from one shuffle by group. Null
    ``query_class`` and ``phase`` are groups of their own. No rows for an empty table.
    """
    days = daily_sketch(events, error)
    by_day = Window.partitionBy(*GROUP, "day")
    by_group = Window.partitionBy(*GROUP)
    up_to = Window.unboundedPreceding
    ranked = (
        days.repartition(*GROUP)
        .withColumn("_all_to", F.sum("n").over(by_group.orderBy("bucket").rangeBetween(up_to, 0)))
        .withColumn("_all", F.sum("n").over(by_group))
        .withColumn("_low", _middle("_all_to", "_all", F.floor).over(by_group))
        .withColumn("_high", _middle("_all_to", "_all", F.ceil).over(by_group))
        .withColumn("_day_to", F.sum("n").over(by_day.orderBy("bucket").rowsBetween(up_to, 0)))
        .withColumn("_day", F.sum("n").over(by_day))
    )
    medians = ranked.groupBy(*GROUP, "day").agg(
        F.max("_day").alias("n"), _middle("_day_to", "_day", F.floor).alias("day_low"), _middle("_day_to", "_day", F.ceil).alias("day_high"), F.max("_low").alias("all_low"), F.max("_high").alias("all_high")
    )

    def mean(which: str) -> Column:
        return (bucket_value(F.col(f"{which}_low"), error) + bucket_value(F.col(f"{which}_high"), error)) / 2

    slow = (F.col("n") >= least) & (mean("day") >= F.lit(factor) * mean("all"))
    return medians.where(slow).select(*GROUP, F.date_format("day", "yyyy-MM-dd").alias("day"))


def _middle(up_to: str, total: str, side) -> Column:
    """The bucket of the lower (``side`` floor) or upper (ceil) middle value."""
    return F.min(F.when(F.col(up_to) > side((F.col(total) - 1) / 2), F.col("bucket")))
