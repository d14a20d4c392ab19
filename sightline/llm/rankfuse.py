"""One ranking from several scores whose units and ranges differ.

Within a query, the scores of each source are standardised by their median and their
median absolute deviation, which outliers hardly move; a logistic curve squashes the
result into (0, 1), so that no source counts for more than its weight however far a
score lies off; the squashed values are combined by a weighted geometric mean over
the query's sources. A missing score takes the least value.

``ranking`` gives that order of all hits of a query. ``preferred`` gives the hits that come first in
the order of every pair they are in. Of two scores the median is their mean and the median
absolute deviation half their difference, so standardised they are plus and minus
``1 / MAD_SCALE``, whatever the source's unit, and 0 if they are equal; the geometric means of
their squashed values put first the hit whose higher scores have more weight, exactly.

A hit that is first in all its pairs survives any knock-out of pairs, also
one held in parts, so parts of bounded size are played apart, their winners again, and
so on; the last survivor then meets all hits of its query.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators.ranking import join_by_key, numbered
from sightline.session import cut

#: Hits of a query that meet in one knock-out.
PART = 512
#: Squashed value of a missing score, and the least of a present one.
LEAST = 1e-6
#: Makes the MAD an estimate of the standard deviation of normal data.
MAD_SCALE = 1.4826
#: Accuracy of the medians of groups too large to be exact: 1 / ACCURACY in rank.
ACCURACY = 10_000


def _finite(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def clean_components(components: DataFrame, key: Sequence[str], source: str, score: str, weight: str) -> DataFrame:
    """(key..., source, score, weight), repeated rows once; scores that are no finite number are null, such weights 0."""
    usable = F.coalesce(_finite(F.col(weight).cast("double")), F.lit(0.0))
    named = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))  # rows without a source have one of their own
    columns = [*key, named.alias("source"), _finite(F.col(score).cast("double")).alias("score"), usable.alias("weight")]
    return components.where(" AND ".join(f"{k} IS NOT NULL" for k in key)).select(*columns).distinct()


def source_statistics(clean: DataFrame, query: str) -> DataFrame:
    """(query, source, weight, middle, scale, n): median and scaled MAD of each source's scores in a query.

    Medians come from mergeable rank summaries, exact for groups of ordinary size.
    """
    keys = [query, "source"]
    middle = cut(clean.groupBy(*keys).agg(F.max("weight").alias("weight"), F.percentile_approx("score", 0.5, ACCURACY).alias("middle"), F.count("*").alias("n")), "medians")
    off = join_by_key(clean.drop("weight"), middle, keys, "n").select(*keys, F.abs(F.col("score") - F.col("middle")).alias("off"))
    scale = off.groupBy(*keys).agg((F.percentile_approx("off", 0.5, ACCURACY) * MAD_SCALE).alias("scale"))
    return cut(middle.join(scale, keys), "scales")


def squashed(score: Column, middle: Column, scale: Column) -> Column:
    """The standardised score in (0, 1). Where most scores are equal (MAD 0), others count as 3 deviations off."""
    off = F.when(scale > 0, (score - middle) / scale).otherwise(F.signum(score - middle) * 3)
    return F.least(F.greatest(1 / (1 + F.exp(-off)), F.lit(LEAST * 2)), F.lit(1 - LEAST))


def fused(hits: DataFrame, components: DataFrame, query: str = "query_id", doc: str = "doc_id", source: str = "source", score: str = "raw_score", weight: str = "weight") -> DataFrame:
    """Every hit once: (query, doc, fused).

    Rows of ``components`` that are no hit's still shape their source's median. Hits without any source get the least
    score; hits whose query or document is null are left out. Sums of doubles depend on the order of
    their parts, which shuffles don't keep: scores are rounded to 9 places, so equal hits tie on every run.
    """
    one = hits.where(f"{query} IS NOT NULL AND {doc} IS NOT NULL").groupBy(query, doc).agg(F.count("*").alias("_rows"))
    clean = cut(clean_components(components, [query, doc], source, score, weight), "components")
    stats = source_statistics(clean, query)
    totals = cut(stats.groupBy(query).agg(F.sum("weight").alias("_total"), F.sum("n").alias("_n")), "totals")
    value = F.ln(squashed(F.col("score"), F.col("middle"), F.col("scale")))
    scored = join_by_key(clean.where("score IS NOT NULL").drop("weight"), stats, [query, "source"], "n")
    # repeated (query, doc, source) with different scores: the greatest holds
    held = scored.groupBy(query, doc, "source").agg(F.max(value).alias("_ln"), F.max("weight").alias("weight"))
    sums = held.groupBy(query, doc).agg(F.sum(F.col("weight") * F.col("_ln")).alias("_sum"), F.sum("weight").alias("_held"))
    rows = join_by_key(one.join(sums, [query, doc], "left"), totals, [query], "_n", "left")
    missing = (F.col("_total") - F.coalesce("_held", F.lit(0.0))) * F.ln(F.lit(LEAST))
    mean = F.exp((F.coalesce("_sum", F.lit(0.0)) + missing) / F.col("_total"))
    return rows.select(query, doc, F.round(F.when(F.col("_total") > 0, mean).otherwise(F.lit(LEAST)), 9).alias("fused"))


def ranking(hits: DataFrame, components: DataFrame, query: str = "query_id", doc: str = "doc_id", **names: str) -> DataFrame:
    """(query, doc, fused_score, rank): the fused order of each query's hits, from 1; equal scores by document.

    Hits are sorted in ranges of (query, score, document), which may part a query and part
    equal scores; a range's ranks are shifted by the query's hits in the ranges before.
    So no task holds more than a range, whatever a query has.
    """
    ranked = numbered(fused(hits, components, query, doc, **names), [query], [F.desc("fused"), F.col(doc)], "rank")
    return ranked.select(query, doc, F.col("fused").alias("fused_score"), "rank")


#: Squashed values of a pair's scores: the higher, the lower, and either of two equal ones.
HIGHER, LOWER = (1 / (1 + math.exp(-z / MAD_SCALE)) for z in (1, -1))


def first_of_pair(one: Column, other: Column, weights: Column) -> Column:
    """Whether the hit of the scores ``one`` comes before that of ``other`` in the fused order of the two alone.

    Scores and weights are in the order of the query's sources. A source's weight goes with the squashed value its
    score has in the pair; the weighted geometric means are compared by their logarithms, without the
    sources that score both alike, which add the same to either. False if neither comes first.
    """
    sides = F.zip_with(F.zip_with(one, other, lambda x, y: F.when(x > y, 1).when(x < y, -1).otherwise(0)), weights, lambda side, w: F.struct(side.alias("side"), w.alias("w")))
    start = F.struct(F.lit(0.0).alias("high"), F.lit(0.0).alias("low"))

    def step(t: Column, s: Column) -> Column:
        return F.when(s["side"] == 1, F.struct((t["high"] + s["w"]).alias("high"), t["low"].alias("low"))).when(s["side"] == -1, F.struct(t["high"].alias("high"), (t["low"] + s["w"]).alias("low"))).otherwise(t)

    def first(t: Column) -> Column:
        return t["high"] * math.log(HIGHER) + t["low"] * math.log(LOWER) > t["low"] * math.log(HIGHER) + t["high"] * math.log(LOWER)

    return F.coalesce(F.aggregate(sides, start, step, first), F.lit(False))


def _winner(entries: Column, weights: Column) -> Column:
    """Survivor of a knock-out among ``entries`` (doc, scores, final), which meet in order."""
    rest = F.slice(entries, F.lit(2), F.size(entries))
    return F.aggregate(rest, F.element_at(entries, 1), lambda held, new: F.when(first_of_pair(new["scores"], held["scores"], weights), new).otherwise(held))


def preferred(hits: DataFrame, components: DataFrame, query: str = "query_id", doc: str = "doc_id", final: str = "final_score", source: str = "source", score: str = "raw_score", weight: str = "weight") -> DataFrame:
    """(query, doc): hits that come before each other hit of their query in the order of the two, although another's ``final`` is greater.

    A missing, null, NaN or infinite score is lower than any other, and two such are
    equal; a null or NaN ``final`` is lower than any other. Queries with one hit give none.
    """
    one = hits.where(f"{query} IS NOT NULL AND {doc} IS NOT NULL").groupBy(query, doc).agg(F.max(F.when(~F.isnan(F.col(final)), F.col(final))).alias("final"))
    clean = clean_components(components, [query, doc], source, score, weight)
    held = clean.where("score IS NOT NULL").groupBy(query, doc, "source").agg(F.max("score").alias("score"))
    scores = held.groupBy(query, doc).agg(F.map_from_entries(F.collect_list(F.struct("source", "score"))).alias("scores"))
    listed = clean.groupBy(query, "source").agg(F.max("weight").alias("weight")).groupBy(query).agg(F.sort_array(F.collect_list(F.struct("source", "weight"))).alias("_list"))
    entries = cut(one.join(scores, [query, doc], "left"), "hits")
    queries = cut(entries.groupBy(query).agg(F.count("*").alias("hits")).where("hits > 1").join(listed, query).select(query, "hits", F.col("_list.source").alias("sources"), F.col("_list.weight").alias("weights")), "queries")
    most = queries.agg(F.max("hits")).first()[0] or 1
    parts = F.ceil(F.col("hits") / PART)
    inorder = F.transform("sources", lambda s: F.coalesce(F.element_at("scores", s), F.lit(float("-inf"))))
    entry = F.struct(F.col(doc).alias("doc"), inorder.alias("scores"), "final")
    placed = join_by_key(entries, queries, [query], "hits").select(query, F.pmod(F.xxhash64(doc), parts).alias("part"), entry.alias("entry"))
    left = placed
    while True:
        played = left.groupBy(query, "part").agg(F.collect_list("entry").alias("entries")).join(queries.select(query, "hits", "weights"), query)
        left = played.select(query, "hits", "weights", "part", _winner(F.col("entries"), F.col("weights")).alias("entry"))
        most = -(-most // PART)
        if most <= 1:
            break
        left = left.select(query, F.floor(F.col("part") / PART).alias("part"), "entry")
    # the survivor against all hits, part by part: a query with very many hits is not one task
    champion = left.select(query, "weights", F.col("entry").alias("best"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))
    met = placed.join(champion, [query, "part"]).where("entry.doc <> best.doc")
    beaten = first_of_pair(F.col("best.scores"), F.col("entry.scores"), F.col("weights"))
    higher = F.coalesce(F.col("entry.final") > F.coalesce(F.col("best.final"), F.lit(float("-inf"))), F.lit(False)) | (F.col("entry.final").isNotNull() & F.col("best.final").isNull())
    judged = met.groupBy(query, F.col("best.doc").alias(doc)).agg(F.bool_and(beaten).alias("all_beaten"), F.bool_or(higher).alias("one_higher"))
    return judged.where("all_beaten AND one_higher").select(query, doc)
