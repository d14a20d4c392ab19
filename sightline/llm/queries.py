"""Queries of the llm operators, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import bpe, canonical, knn, leakage, lookalike, rankfuse, sketch
from sightline.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Cached vectors that are each among the most similar of the other."""
    return knn.mutual_pairs(table(spark, folder, "cache_entries"))


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every usable cached vector, however far, with their cosines."""
    near = knn.neighbours(table(spark, folder, "cache_entries"), min_cosine=None)
    return near.select("grp", "id", "neighbour", F.round("cosine", 6).alias("cosine"), "rank")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and days whose median latency is twice the group's."""
    return sketch.slow_days(table(spark, folder, "search_events"))


PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def p4_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Latency percentiles of every group and day."""
    days = sketch.daily_sketch(table(spark, folder, "search_events"))
    return sketch.percentiles(days, [*sketch.GROUP, "day"], PERCENTILES)


def p4_overall(spark: SparkSession, folder: str) -> DataFrame:
    """Latency percentiles of every group over all days, from the daily sketches."""
    days = sketch.daily_sketch(table(spark, folder, "search_events"))
    return sketch.percentiles(sketch.merge(days, sketch.GROUP), sketch.GROUP, PERCENTILES)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Hits that their query's sources prefer to each other, though another has a greater final score."""
    return rankfuse.preferred(table(spark, folder, "hit_explanations"), table(spark, folder, "score_components"))


def p5_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """One order of every query's hits, from all its sources."""
    return rankfuse.ranking(table(spark, folder, "hit_explanations"), table(spark, folder, "score_components")).withColumn("fused_score", F.round("fused_score", 6))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_documents(table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold evaluation passages."""
    return leakage.shared_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """How much of which passage each document holds, slightly edited copies included."""
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that look the same with different characters."""
    return canonical.same_look_pairs(table(spark, folder, "documents"))


def p8_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the canonical member of its class."""
    return canonical.canonical_texts(table(spark, folder, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_neighbours": p1_neighbours,
    "p4_found": p4_found,
    "p4_daily": p4_daily,
    "p4_overall": p4_overall,
    "p5_found": p5_found,
    "p5_ranking": p5_ranking,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_found": p8_found,
    "p8_canonical": p8_canonical,
}



def _look_sql(text: str, table: dict[str, str | None]) -> str:
    """``text`` with single characters translated, joined forms spelt out and characters without width dropped."""
    single = {k: v for k, v in table.items() if v is not None and len(v) == 1}
    dropped = [k for k, v in table.items() if v is None]
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    out = f"translate({text}, {quote(''.join([*single, *dropped]))}, {quote(''.join(single.values()))})"
    for char, parts in table.items():
        if parts is not None and len(parts) > 1:
            out = f"replace({out}, {quote(char)}, {quote(parts)})"
    return f"nfc_normalize({out})"


def _grams_sql(table_name: str, key: str, text: str) -> str:
    words = {chr(k): v for k, v in lookalike.word_table().items() if v is None or v != chr(k)}
    parts = f"regexp_extract_all({_look_sql(text, words)}, '[\\p{{L}}\\p{{N}}]+')"
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i + 12], ' ') AS gram
        FROM (SELECT {key}, {parts} AS w FROM {table_name} WHERE {text} IS NOT NULL), range(1, 100000) r(i) WHERE i + 12 <= len(w)"""


def _sketch_sql(keys: str) -> str:
    g = (1 + sketch.ERROR) / (1 - sketch.ERROR)
    picked = ", ".join(f"2 / (1 + {g!r}::DOUBLE) * exp(min(b) FILTER (up > floor({q} * (n - 1))) * ln({g!r}::DOUBLE)) AS {name}" for name, q in PERCENTILES.items())
    return f"""
        WITH good AS (
            SELECT DISTINCT event_id, project_key, lower(trim(query_class)) AS query_class, lower(trim(phase)) AS phase, make_timestamp(ts_ms * 1000)::DATE AS day, latency_us
            FROM search_events WHERE latency_us > 0 AND project_key IS NOT NULL AND ts_ms IS NOT NULL
        ), buckets AS (SELECT {keys}, ceil(ln(latency_us::DOUBLE) / ln({g!r}::DOUBLE)) AS b, count(*) AS c FROM good GROUP BY ALL),
        ranked AS (SELECT *, sum(c) OVER (PARTITION BY {keys} ORDER BY b) AS up, sum(c) OVER (PARTITION BY {keys}) AS n FROM buckets)
        SELECT {keys}, max(n)::BIGINT AS n, {picked} FROM ranked GROUP BY {keys}"""


ORACLE: dict[str, str] = {
    "p4_daily": _sketch_sql("project_key, query_class, phase, day"),
    "p4_overall": _sketch_sql("project_key, query_class, phase"),
    "p7_found": f"""
        WITH d AS ({_grams_sql("documents", "doc_id", "text")}), e AS ({_grams_sql("eval_items", "item_id", "passage")})
        SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (gram)""",
    "p8_found": f"""
        WITH d AS (SELECT doc_id, text, {_look_sql("text", lookalike.character_map())} AS look FROM documents WHERE regexp_matches(text, '[^\\s\\p{{Z}}\\p{{Cc}}\\p{{Cf}}]'))
        SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b ON a.look = b.look AND a.text <> b.text AND a.doc_id < b.doc_id""",
    "p8_canonical": f"""
        WITH d AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, '[^\\s\\p{{Z}}\\p{{Cc}}\\p{{Cf}}]') THEN {_look_sql("text", lookalike.character_map())} END AS look FROM documents),
        c AS (SELECT look, min(text) AS canonical FROM d WHERE look IS NOT NULL GROUP BY look)
        SELECT doc_id, text, coalesce(canonical, text) AS canonical FROM d LEFT JOIN c USING (look)""",
    "p1_found": """
        WITH good AS (
            SELECT DISTINCT entry_id, embedder_id, value::DOUBLE[] AS value FROM cache_entries
            WHERE len(value) = 64 AND len(list_filter(value, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(value, lambda x: x <> 0)) > 0
        ), near AS (
            SELECT a.entry_id AS a, b.entry_id AS b, list_cosine_similarity(a.value, b.value) AS cosine
            FROM good a JOIN good b ON a.embedder_id = b.embedder_id AND a.entry_id <> b.entry_id
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS place FROM near WHERE cosine >= 0.9
        )
        SELECT x.a AS entry_id_a, x.b AS entry_id_b
        FROM ranked x JOIN ranked y ON x.a = y.b AND x.b = y.a
        WHERE x.a < x.b AND x.place <= 10 AND y.place <= 10""",
    "p1_neighbours": """
        WITH good AS (
            SELECT DISTINCT entry_id, embedder_id, value::DOUBLE[] AS value FROM cache_entries
            WHERE entry_id IS NOT NULL AND len(value) = 64 AND len(list_filter(value, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(value, lambda x: x <> 0)) > 0
        ), near AS (
            SELECT a.embedder_id AS grp, a.entry_id AS id, b.entry_id AS neighbour, round(list_cosine_similarity(a.value, b.value), 12) AS cosine
            FROM good a JOIN good b ON a.embedder_id IS NOT DISTINCT FROM b.embedder_id AND a.entry_id <> b.entry_id
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, neighbour) AS rank FROM near)
        SELECT grp, id, neighbour, round(cosine, 6) AS cosine, rank::INTEGER AS rank FROM ranked WHERE rank <= 10""",
    "p5_ranking": """
        WITH hits AS (SELECT DISTINCT query_id, doc_id FROM hit_explanations WHERE query_id IS NOT NULL AND doc_id IS NOT NULL),
        clean AS (
            SELECT DISTINCT query_id, doc_id, source, CASE WHEN NOT isnan(raw_score) AND NOT isinf(raw_score) THEN raw_score END AS score,
                   CASE WHEN weight IS NULL OR isnan(weight) OR isinf(weight) THEN 0 ELSE weight END AS weight
            FROM score_components WHERE query_id IS NOT NULL AND doc_id IS NOT NULL
        ), middles AS (SELECT query_id, source, max(weight) AS weight, quantile_disc(score, 0.5) AS middle FROM clean GROUP BY ALL),
        scales AS (
            SELECT query_id, source, 1.4826 * quantile_disc(abs(score - middle), 0.5) AS scale
            FROM clean c JOIN middles m USING (query_id, source) GROUP BY ALL
        ), values_ AS (
            SELECT c.query_id, c.doc_id, c.source, max(m.weight) AS weight,
                   max(ln(least(greatest(1 / (1 + exp(-(CASE WHEN scale > 0 THEN (score - middle) / scale ELSE sign(score - middle) * 3 END))), 2e-6), 1 - 1e-6))) AS v
            FROM clean c JOIN middles m ON m.query_id = c.query_id AND m.source IS NOT DISTINCT FROM c.source
            JOIN scales s ON s.query_id = c.query_id AND s.source IS NOT DISTINCT FROM c.source WHERE score IS NOT NULL GROUP BY ALL
        ), sums AS (SELECT query_id, doc_id, sum(weight * v) AS total, sum(weight) AS held FROM values_ GROUP BY ALL),
        whole AS (SELECT query_id, sum(weight) AS weight FROM middles GROUP BY ALL),
        fused AS (
            SELECT h.query_id, h.doc_id, round(CASE WHEN w.weight > 0 THEN exp((coalesce(total, 0) + (w.weight - coalesce(held, 0)) * ln(1e-6)) / w.weight) ELSE 1e-6 END, 9) AS f
            FROM hits h LEFT JOIN sums s USING (query_id, doc_id) LEFT JOIN whole w USING (query_id)
        )
        SELECT query_id, doc_id, round(f, 6) AS fused_score, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, doc_id) AS rank FROM fused""",
    "p4_found": """
        WITH good AS (
            SELECT DISTINCT event_id, project_key, lower(trim(query_class)) AS query_class, lower(trim(phase)) AS phase,
                   strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, latency_us
            FROM search_events WHERE latency_us > 0 AND project_key IS NOT NULL AND ts_ms IS NOT NULL
        ), days AS (
            SELECT project_key, query_class, phase, day, count(*) AS n, median(latency_us) AS middle FROM good GROUP BY ALL
        ), wholes AS (
            SELECT project_key, query_class, phase, median(latency_us) AS middle FROM good GROUP BY ALL
        )
        SELECT d.project_key, d.query_class, d.phase, d.day
        FROM days d JOIN wholes w ON d.project_key = w.project_key
         AND d.query_class IS NOT DISTINCT FROM w.query_class AND d.phase IS NOT DISTINCT FROM w.phase
        WHERE d.n >= 12 AND d.middle >= 2 * w.middle""",
    "p5_found": """
        WITH hits AS (
            SELECT query_id, doc_id, coalesce(max(final_score), '-inf'::DOUBLE) AS final_score
            FROM hit_explanations WHERE query_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL
        ), sources AS (
            SELECT query_id, source, max(weight) AS weight FROM score_components GROUP BY ALL
        ), scores AS (
            SELECT query_id, doc_id, source, max(CASE WHEN NOT isnan(raw_score) AND NOT isinf(raw_score) THEN raw_score END) AS raw_score
            FROM score_components GROUP BY ALL
        ), grid AS (
            SELECT h.query_id, h.doc_id, h.final_score, s.source, s.weight, coalesce(c.raw_score, '-inf'::DOUBLE) AS score
            FROM hits h JOIN sources s USING (query_id) LEFT JOIN scores c USING (query_id, doc_id, source)
        ), met AS (
            SELECT a.query_id, a.doc_id AS one, b.doc_id AS other, max(a.final_score) < max(b.final_score) AS above,
                   sum(CASE WHEN a.score > b.score THEN a.weight ELSE 0 END) > sum(CASE WHEN a.score < b.score THEN a.weight ELSE 0 END) AS beats
            FROM grid a JOIN grid b ON a.query_id = b.query_id AND a.source = b.source AND a.doc_id <> b.doc_id
            GROUP BY ALL
        )
        SELECT query_id, one AS doc_id FROM met GROUP BY query_id, one HAVING bool_and(beats) AND bool_or(above)""",
}
