"""BM25 over postings tables.

An index is postings (field, term, doc_id, tf, length, positions), the term dictionary
(field, term, df), field lengths (field, doc_id, length) and statistics (field, docs, total). A posting
has its document's length with it, so scoring needs one join. Queries are a
table too, so one plan ranks any number of queries: query terms are joined to the
postings, scores are summed per (query, document) with map-side combine, and the
top k of each query is taken with a partial limit before its shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import text as X
from sightline.operators.ranking import page
from sightline.session import cut

K1, B = 1.2, 0.75
FIELD_BOOSTS = {"content": 1.0, "title": 2.0}


def quantized_length(length: Column) -> Column:
    """A length rounded down to the bucket that one byte can hold: exact up to 40, then 8 buckets for each doubling."""
    over = length - 24
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(over, F.lit(8)))) - 3).cast("bigint")
    return F.when(over < 8, length).otherwise(length - F.pmod(over, step)).cast("bigint")


def idf(df: Column, docs: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5))


def length_norm(length: Column, average: Column) -> Column:
    return K1 * (1 - B + B * quantized_length(length) / average)


def term_score(tf: Column, df: Column, docs: Column, length: Column, average: Column) -> Column:
    """Weight ``idf * (1 + k1)`` times ``tf / (tf + norm)``."""
    return idf(df, docs) * (1 + K1) * (tf / (tf + length_norm(length, average)))


@dataclass
class LexicalIndex:
    """Tables of an index; ``live`` (doc_id) names the documents that may match, None for all.

    Statistics include deleted documents until the index is written anew.
    """

    postings: DataFrame
    lengths: DataFrame
    statistics: DataFrame
    live: DataFrame | None = None
    terms: DataFrame | None = None

    def write(self, path: str) -> None:
        """Postings sorted by term within files, so that a query's terms prune row groups; a hot term is parted by document."""
        self.postings.repartitionByRange("field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id").write.partitionBy("field").parquet(f"{path}/postings")
        written = self.postings.sparkSession.read.parquet(f"{path}/postings")
        # a task's terms are whole but at the ends of its range: counted once more after a small shuffle
        written.groupBy("field", "term").agg(F.count("*").alias("df")).sortWithinPartitions("field", "term").write.partitionBy("field").parquet(f"{path}/terms")
        self.lengths.write.partitionBy("field").parquet(f"{path}/lengths")
        self.statistics.write.parquet(f"{path}/statistics")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> LexicalIndex:
        tables = {t: spark.read.parquet(f"{path}/{t}") for t in ("postings", "lengths", "statistics", "terms")}
        return cls(**tables)


def build_index(documents: DataFrame, doc_id: str = "doc_id", fields: Mapping[str, str] | None = None, positions: bool = True, once: bool = False) -> LexicalIndex:
    """Index of the text columns ``fields`` ({field: column}); null texts are empty, null ids are left out.

    A row is a document. Rows that repeat an id are documents that count under one: its scores add up (``index_report`` finds them).

    ``once`` writes the words of the texts to the shared folder, for an index whose tables are all
    needed, as ``write`` needs them: texts are then analyzed once.
    """
    fields = fields or {"content": "text"}
    parts = [documents.where(F.col(doc_id).isNotNull()).select(F.lit(name).alias("field"), F.col(doc_id).cast("string").alias("doc_id"), X.tokens(F.coalesce(F.col(column), F.lit(""))).alias("terms")) for name, column in fields.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    if once:
        rows = cut(rows, "words")
    lengths = rows.select("field", "doc_id", F.size("terms").cast("bigint").alias("length"))
    statistics = lengths.groupBy("field").agg(F.count("*").alias("docs"), F.sum("length").alias("total"))
    columns = "field string, term string, doc_id string, tf bigint, length bigint" + (", positions array<int>" if positions else "")
    return LexicalIndex(rows.mapInArrow(_poster(positions), columns), lengths, statistics)


def _poster(positions: bool):
    """The postings of each row's words, without a shuffle: a document's words are together as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not size.sum():
                continue
            words = lists.flatten().dictionary_encode()
            code, doc = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(size)), size)
            place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
            short = pc.less_equal(pc.binary_length(words.dictionary), X.MAX_TERM_BYTES).to_numpy(zero_copy_only=False)[code]
            code, doc, place = code[short], doc[short], place[short]
            order = np.lexsort((code, doc))  # stable: places of a word stay in order
            code, doc, place = code[order], doc[order], place[order]
            starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])][: len(code)])
            tf = np.diff(np.r_[starts, len(code)])
            of = pa.array(doc[starts])
            out = [batch.column("field").take(of), words.dictionary.take(pa.array(code[starts])), batch.column("doc_id").take(of), pa.array(tf), pa.array(size[doc[starts]])]
            if positions:
                out.append(pa.ListArray.from_arrays(pa.array(np.r_[starts, len(code)].astype(np.int32)), pa.array(place.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, ["field", "term", "doc_id", "tf", "length", "positions"][: len(out)])

    return run


def document_frequencies(index: LexicalIndex) -> DataFrame:
    """(field, term, df), from the dictionary where there is one."""
    if index.terms is not None:
        return index.terms
    return index.postings.groupBy("field", "term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame, query_id: str, query: str, fields: Mapping[str, float]) -> DataFrame:
    """(query_id, field, term, boost): distinct terms of each query in each field."""
    boosts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(float(b)).alias("boost")) for f, b in fields.items()]))
    each = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(X.tokens(F.col(query)))).alias("term"))
    return each.select("query_id", "term", boosts.alias("_f")).select("query_id", F.col("_f.field").alias("field"), "term", F.col("_f.boost").alias("boost"))


def score_terms(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of every document with any of its query's terms.

    Sums of doubles depend on the order of their parts, which shuffles don't keep;
    scores are rounded to 9 places so that equal documents tie on every run.

    The terms asked for get their frequencies from the dictionary, and meet the postings in one
    join. Without a dictionary postings are first cut down to those terms and counted.
    """
    hits = index.postings.select("field", "term", "doc_id", "tf", "length")
    df = index.terms
    if df is None:
        hits = hits.join(terms.select("field", "term").distinct(), ["field", "term"], "left_semi")
        df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    weighted = terms.join(df, ["field", "term"]).join(F.broadcast(index.statistics), "field")  # statistics: a row a field
    scored = hits.join(weighted, ["field", "term"])
    if index.live is not None:
        scored = scored.join(index.live, "doc_id", "left_semi")
    one = term_score(F.col("tf"), F.col("df"), F.col("docs"), F.col("length"), F.col("total") / F.col("docs")) * F.col("boost")
    return scored.groupBy("query_id", "doc_id").agg(F.round(F.sum(one), 9).alias("score"))


def top_k(scores: DataFrame, k: int, offset: int = 0, by: str | None = "query_id", score: str = "score", doc: str = "doc_id") -> DataFrame:
    """Ranks from 0 by score, then document id as a string; NaN and null scores come last."""
    order = [F.desc(F.coalesce(F.nanvl(F.col(score), F.lit(float("-inf"))), F.lit(float("-inf")))), F.col(doc).cast("string")]
    if by is None:
        return scores.orderBy(*order).offset(offset).limit(k)
    return page(scores, [by], order, k, offset)


def search_queries(index: LexicalIndex, queries: DataFrame, k: int, query_id: str = "query_id", query: str = "query", fields: Mapping[str, float] | None = None, offset: int = 0) -> DataFrame:
    """(query_id, doc_id, score, rank) of the top ``k`` of each query; terms are alternatives."""
    terms = query_terms(queries, query_id, query, fields or {"content": 1.0})
    return top_k(score_terms(index, terms), k, offset)


def match_counts(index: LexicalIndex, queries: DataFrame, query_id: str = "query_id", query: str = "query", fields: Mapping[str, float] | None = None) -> DataFrame:
    """(query_id, matches): exact number of documents that match each query."""
    terms = query_terms(queries, query_id, query, fields or {"content": 1.0})
    found = index.postings.join(terms, ["field", "term"]).select("query_id", "doc_id")
    if index.live is not None:
        found = found.join(index.live, "doc_id", "left_semi")
    return found.distinct().groupBy("query_id").agg(F.count("*").alias("matches"))


# -- the term dictionary --------------------------------------------------------------


def terms_with_prefix(index: LexicalIndex, field: str, prefix: str) -> DataFrame:
    return document_frequencies(index).where((F.col("field") == field) & F.col("term").startswith(prefix))


def terms_between(index: LexicalIndex, field: str, low: str, high: str) -> DataFrame:
    return document_frequencies(index).where((F.col("field") == field) & F.col("term").between(low, high))


def expand_glob(index: LexicalIndex, field: str, pattern: str, limit: int = 16_384) -> DataFrame:
    """Terms that match a pattern of ``*`` and ``?``; more than ``limit`` are an error, not a cut."""
    from sightline.operators.query_language import glob_regex

    found = document_frequencies(index).where((F.col("field") == field) & F.col("term").rlike(glob_regex(pattern)))
    n = len(found.select("term").limit(limit + 1).collect())
    if n > limit:
        raise ValueError(f"{pattern!r} matches more than {limit} terms")
    return found


# -- maintenance ----------------------------------------------------------------------


def segment_statistics(documents: DataFrame, segment: str = "segment", tombstone: str = "is_tombstone", size: str = "bytes") -> DataFrame:
    """(segment, live, tombstones, density, bytes) of each segment."""
    dead = F.count_if(F.col(tombstone))
    return documents.groupBy(segment).agg((F.count("*") - dead).alias("live"), dead.alias("tombstones"), (dead / F.count("*")).alias("density"), F.sum(size).alias("bytes"))


def compaction_due(statistics: DataFrame, density: float = 0.20, fan_out: int = 8) -> DataFrame:
    """Segments whose tombstones, or whose number once it reaches ``fan_out``, ask for compaction."""
    many = F.lit(statistics.limit(fan_out).count() >= fan_out)
    return statistics.where((F.col("density") >= density) | many)


def sqlite_like_rank(scores: DataFrame, score: str = "score") -> DataFrame:
    """Full-text rank as embedded databases give it: the negated BM25 score, smallest first."""
    return scores.withColumn("rank_value", -F.col(score))
