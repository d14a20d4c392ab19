"""The engine's face: an index of documents, and progressive hybrid search over it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import text as X
from sightline.functions import vectors as V
from sightline.operators import fusion as U
from sightline.operators import lexical as L
from sightline.operators import query_language as Q
from sightline.operators import refine as R
from sightline.operators import vector_search as S


@dataclass
class Settings:
    """What a user of the engine may set."""

    fields: dict[str, float] = field(default_factory=lambda: dict(L.FIELD_BOOSTS))
    strategy: str = "rrf"
    rrf_k: float = U.K
    weights: dict[str, float] = field(default_factory=dict)
    multiplier: int = 3
    blend: float = 0.7
    dims: int = 64
    diversify: bool = False
    fast_only: bool = False


@dataclass
class SearchResult:
    """``initial`` comes from the fast tier alone; ``refined`` is None where no quality tier takes part."""

    initial: DataFrame
    refined: DataFrame | None = None
    reranked: DataFrame | None = None
    changes: DataFrame | None = None
    query_class: str = "empty"


class Engine:
    """Documents (doc_id, text, title and typed columns), their postings and one or two tiers of vectors."""

    def __init__(
        self,
        spark: SparkSession,
        settings: Settings | None = None,
        embed: Callable[[str], list[float]] | None = None,
        embed_quality: Callable[[str], list[float]] | None = None,
        scorer: Callable[[list[str], list[str]], list[float]] | None = None,
    ):
        self.spark, self.settings = spark, settings or Settings()
        self.embed = embed or (lambda q: V.hash_vector(q, self.settings.dims))
        self.provenance = "semantic_fast" if embed else "hash_control"
        self.embed_quality, self.scorer = embed_quality, scorer
        self.documents: DataFrame | None = None

    # -- building ----------------------------------------------------------------

    def index(self, documents: DataFrame, fast: DataFrame | None = None, quality: DataFrame | None = None, edges: DataFrame | None = None) -> Engine:
        """Takes documents and, if given, their vectors (doc_id, embedding); without, text is embedded by hashing."""
        named = documents.withColumn("doc_id", F.col("doc_id").cast("string"))
        if "title" not in named.columns:
            named = named.withColumn("title", F.element_at(F.split("text", "\n"), 1))
        self.documents = named.where("doc_id IS NOT NULL")
        self.lexical = L.build_index(self.documents, fields={"content": "text", "title": "title"})
        text = self.documents.select("doc_id", V.hash_embedding(F.coalesce(F.col("text"), F.lit("")), self.settings.dims).alias("embedding"))
        self.fast = fast.withColumn("doc_id", F.col("doc_id").cast("string")) if fast is not None else text
        self.quality = quality.withColumn("doc_id", F.col("doc_id").cast("string")) if quality is not None else None
        self.edges = edges
        return self

    def write(self, path: str) -> None:
        """Writes the index; a search then reads only its queries' terms and vectors."""
        self.documents.write.parquet(f"{path}/documents")
        self.lexical.write(f"{path}/lexical")
        self.fast.write.parquet(f"{path}/fast")
        if self.quality is not None:
            self.quality.write.parquet(f"{path}/quality")

    def open(self, path: str, quality: bool = False) -> Engine:
        read = self.spark.read.parquet
        self.documents, self.fast, self.edges = read(f"{path}/documents"), read(f"{path}/fast"), None
        self.lexical = L.LexicalIndex.read(self.spark, f"{path}/lexical")
        self.quality = read(f"{path}/quality") if quality else None
        return self

    # -- searching ---------------------------------------------------------------

    def lexical_hits(self, query: str, limit: int) -> DataFrame:
        """(query_id, doc_id, score, rank) by the lenient query language."""
        parsed = Q.LenientParser(self.settings.fields).parse(query)
        scores = Q.Compiler(self.lexical, self.documents).compile(parsed.query)
        return L.top_k(scores.withColumn("query_id", F.lit(0)), limit)

    def _query_vector(self, vector: list[float]) -> DataFrame:
        return self.spark.createDataFrame([(0, [float(x) for x in vector])], "query_id int, embedding array<float>")

    def search(self, query: str, k: int = 10, where=None, metadata: bool = False) -> SearchResult:
        """Progressive hybrid search; an empty query or ``k`` of 0 gives no rows.

        ``where`` (a Column over the documents) restricts both lanes before they rank.
        """
        s = self.settings
        canonical = X.canonical_query(query)
        kind = Q.query_class(canonical)
        if kind == "empty" or k <= 0:
            return SearchResult(self.documents.limit(0).select(F.lit(0).alias("query_id"), "doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")))
        negated = Q.parse_negation(canonical)
        positive = negated.positive or canonical
        base = U.candidate_count(k, 0, s.multiplier)
        lexical_budget, semantic_budget = Q.budgets(base, kind)
        lexical = self.lexical_hits(canonical, max(lexical_budget, 1))
        corpus = self.fast
        if where is not None:
            allowed = self.documents.where(where).select("doc_id")
            lexical, corpus = lexical.join(allowed, "doc_id", "left_semi"), corpus.join(allowed, "doc_id", "left_semi")
        vector = self._query_vector(self.embed(positive))
        semantic = Q.drop_excluded(S.exact_top_k(corpus, vector, max(semantic_budget, 1)), self.documents, negated)
        if self.edges is not None:
            semantic = R.smooth_ranked(semantic, self.edges)
        lists = {"lexical": lexical, "semantic" if self.provenance != "hash_control" else "hash": semantic}
        if self.edges is not None:
            seeds = lexical.select("doc_id", "score").unionByName(semantic.select("doc_id", "score"))
            lists["graph"] = R.graph_list(R.personalized_pagerank(self.edges, seeds), 0, base)
        more = {} if s.strategy == "pool_minmax" and "graph" not in lists else {"k": s.rrf_k}
        initial = U.fuse(s.strategy, lists, limit=k, weights=s.weights, **more)
        result = SearchResult(self._hydrated(initial) if metadata else initial, query_class=kind)
        if not s.fast_only and self.quality is not None and self.embed_quality is not None and self.provenance != "hash_control":
            q = self._query_vector(self.embed_quality(positive))
            scored = S.quality_scores(semantic.select("query_id", "doc_id"), self.quality, q).where("quality_score IS NOT NULL").select("query_id", "doc_id", F.col("quality_score").alias("score"))
            blended = U.blend(semantic, scored, s.blend)
            refined = U.fuse(s.strategy, {"lexical": lexical, "semantic": blended.select("query_id", "doc_id", "score")}, limit=k, weights=s.weights, **more)
            result.refined = self._hydrated(refined) if metadata else refined
            result.changes = U.rank_changes(initial, refined)
        last = result.refined if result.refined is not None else initial
        if self.scorer is not None:
            queries = self.spark.createDataFrame([(0, positive)], "query_id int, query string")
            result.reranked = R.rerank(last.select("query_id", "doc_id", "score", "rank"), self.documents, queries, self.scorer)
        elif s.diversify:
            result.reranked = R.mmr(last.select("query_id", "doc_id", "score", "rank"), self.fast, k)
        return result

    def _hydrated(self, hits: DataFrame) -> DataFrame:
        """Columns of the winners only."""
        return hits.join(self.documents, "doc_id", "left")

    def snippets(self, query: str, hits: DataFrame) -> DataFrame:
        """Adds a snippet to each hit of a page."""
        terms = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        wanted = L.query_terms(terms, "query_id", "query", {"content": 1.0}).select("term")
        df = self.lexical.postings.where("field = 'content'").join(wanted, "term", "left_semi").groupBy("term").agg((1 / (1 + F.count("*"))).alias("w"))
        weights = {r.term: r.w for r in df.collect()}  # a row for each of the query's terms
        column = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.expr("map()").cast("map<string,double>")
        return hits.join(self.documents.select("doc_id", "text"), "doc_id", "left").withColumn("snippet", X.snippet(F.col("text"), column)).drop("text")
