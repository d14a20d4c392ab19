"""Ranks within keys, and joins that hold when one key has a great share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot beyond so many rows, and beyond this share of all: there are fewer than 1000 such keys at any size.
HOT_ROWS, HOT_SHARE = 100_000, 0.001


def page(rows: DataFrame, by: Sequence[str], order: Sequence[Column], limit: int | None = None, offset: int = 0, name: str = "rank") -> DataFrame:
    """Rows of each key with their rank from 0 in ``name``: those from ``offset`` on, at most ``limit``.

    With a limit each task keeps only its own first rows of a key before the shuffle
    (a window group limit, which Spark plans for a plain bound on row_number).
    """
    ranked = rows.withColumn("_row", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    if limit is not None:
        ranked = ranked.where(F.col("_row") <= F.lit(offset + max(limit, 0)))
    if offset or limit == 0:
        ranked = ranked.where(F.col("_row") > offset)
    return ranked.withColumn(name, F.col("_row") - 1).drop("_row")


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place from 1 in their key's order, in ``name``.

    Rows are sorted in ranges of key and order, which may part a key, and are written so; a
    range's places are shifted by the key's rows in the ranges before. No task holds more than a range, however hot a key is.
    Null keys are a key too.
    """
    from sightline.session import cut

    ranged = cut(rows.repartitionByRange(*[F.col(b) for b in by], *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_size")).withColumn("_above", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    shifts = sizes.select(*[F.col(b).alias(f"_by{n}") for n, b in enumerate(by)], F.col("_range").alias("_of"), "_above")
    same = [F.col("_range") == F.col("_of"), *[F.col(b).eqNullSafe(F.col(f"_by{n}")) for n, b in enumerate(by)]]
    placed = ranged.withColumn("_place", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)))
    return placed.join(shifts, same).withColumn(name, F.col("_place") + F.col("_above")).drop("_range", "_of", "_place", "_above", *[f"_by{n}" for n in range(len(by))])


def join_by_key(rows: DataFrame, info: DataFrame, keys: Sequence[str], count: str, how: str = "inner") -> DataFrame:
    """``rows`` with the one row of ``info`` for their key; ``info.count`` has the number of rows of the key.

    Rows of hot keys, which hashing would put into one task, stay where they are: the
    hot keys' info is broadcast (fewer than 1000 rows, see ``HOT_SHARE``). The rest is
    an ordinary join. ``info`` should be written or cached.
    """
    total = info.agg(F.sum(count)).first()[0] or 0
    hot = info.where(F.col(count) > max(HOT_ROWS, HOT_SHARE * total))
    if not hot.limit(1).count():
        return rows.join(info, list(keys), how)
    cold = rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti").join(info, list(keys), how)
    return cold.unionByName(rows.join(F.broadcast(hot), list(keys)))
