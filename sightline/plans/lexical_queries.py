"""Queries of text analysis, lexical retrieval and filters over documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import text as X
from sightline.operators import lexical as L
from sightline.operators import query_language as Q
from sightline.operators.segments import SegmentedIndex
from sightline.session import stored_once
from sightline.sources.tables import table

FIELDS = {"content": "text", "title": "title"}


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _index(spark: SparkSession, folder: str) -> L.LexicalIndex:
    """The written index of the documents, made once and read by every query."""
    at = stored_once(spark, "lexical", folder, lambda path: L.build_index(_documents(spark, folder), fields=FIELDS, once=True).write(path))
    return L.LexicalIndex.read(spark, at)


def text_tokens(spark, folder):
    """Tokens, different tokens and longest token of every document."""
    t = _documents(spark, folder).select("doc_id", X.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("different"), F.array_max(F.transform("t", F.length)).alias("longest"))


def text_preview(spark, folder):
    """Cleaned previews, content hashes and whether a text is a bare acknowledgement."""
    d = _documents(spark, folder)
    clean = X.normalize_whitespace(F.col("text"))
    return d.select("doc_id", X.preview(clean, 80).alias("preview"), X.content_hash(F.col("text")).alias("hash"), X.is_low_signal(F.col("text")).alias("low_signal"), X.truncate_chars(clean, 40).alias("head"))


def text_edge_ngrams(spark, folder):
    """Prefixes of title words with the number of titles that hold them."""
    d = _documents(spark, folder).select("doc_id", F.explode(F.array_distinct(X.edge_ngrams(F.col("title"), 2, 8))).alias("ngram"))
    return d.groupBy("ngram").agg(F.count("*").alias("documents"))


def text_canonical(spark, folder):
    """Canonical text of every document."""
    return _documents(spark, folder).select("doc_id", X.canonicalize(F.col("text")).alias("canonical"))


def text_chunks(spark, folder):
    """Chunks of every document."""
    d = _documents(spark, folder).select("doc_id", F.explode(X.chunks(F.col("text"))).alias("c"))
    return d.select("doc_id", "c.ordinal", "c.start", "c.end", "c.tokens")


def text_fingerprints(spark, folder):
    """Fingerprints of every document."""
    return _documents(spark, folder).select("doc_id", X.fingerprint(F.col("text")).alias("f")).select("doc_id", "f.*")


def text_hyphen_cjk(spark, folder):
    """Terms of the analyzer for compounds and scripts without spaces, with their frequency."""
    d = _documents(spark, folder).select("doc_id", F.explode(X.hyphen_cjk(F.col("text"))).alias("t"))
    return d.groupBy(F.col("t.term").alias("term")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


def text_code_structure(spark, folder):
    """Names defined, imported or used as headings, by kind."""
    d = _documents(spark, folder).select("doc_id", F.explode(X.code_structure(F.col("text"))).alias("s"))
    return d.groupBy(F.col("s.kind").alias("kind"), F.col("s.name").alias("name")).agg(F.count("*").alias("n"))


def text_redaction(spark, folder):
    """Sources and titles as a log may show them."""
    d = _documents(spark, folder)
    return d.select(
        "doc_id", X.redact(F.col("source"), F.lit("user_path"), "log").alias("source"), X.redact(F.col("title"), F.lit("query_text"), "log", 10).alias("title"), X.redact(F.col("lang"), F.lit("credential"), "evidence").alias("lang"),
        X.redact(F.col("title"), F.col("doc_type"), "display").alias("kind"), X.path_classes(F.col("source")).alias("classes"), X.is_hard_deny(F.col("source")).alias("denied"),
    )


def query_classes(spark, folder):
    """Class and candidate budgets of the evaluation queries."""
    e = table(spark, folder, "eval_items")
    kind = Q.query_class_column(F.col("query"))
    lexical, semantic = Q.candidate_budgets(F.lit(30), F.col("kind"))
    return e.select("item_id", kind.alias("kind")).select("item_id", "kind", lexical.alias("lexical"), semantic.alias("semantic"))


def lex_document_frequencies(spark, folder):
    """Document and corpus frequency of every term."""
    return L.build_index(_documents(spark, folder), positions=False).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def lex_bm25(spark, folder):
    """Top 10 documents of every evaluation query by BM25 over content and title."""
    hits = L.search_queries(_index(spark, folder), table(spark, folder, "eval_items"), 10, "item_id", "query", L.FIELD_BOOSTS)
    return hits.select(F.col("query_id").alias("item_id"), "doc_id", F.round("score", 6).alias("score"), "rank")


def lex_match_counts(spark, folder):
    """Exact number of matches of every evaluation query."""
    return L.match_counts(_index(spark, folder), table(spark, folder, "eval_items"), "item_id", "query").select(F.col("query_id").alias("item_id"), "matches")


def _compiled(spark, folder, query: str) -> DataFrame:
    compiler = Q.Compiler(_index(spark, folder), _documents(spark, folder))
    return compiler.compile(Q.LenientParser(typed={"n_chars": int}).parse(query).query)


def lex_boolean(spark, folder):
    """Documents of a Boolean query with a range, by constant and term scores."""
    found = _compiled(spark, folder, "+workspace -content:cursor n_chars:[200 TO 2000}")
    return found.select("doc_id", F.lit(True).alias("found"))


def lex_phrase(spark, folder):
    """Documents with a phrase in content or title."""
    return _compiled(spark, folder, '"the workspace"').select("doc_id", F.lit(True).alias("found"))


def lex_glob(spark, folder):
    """Documents with a term that matches a pattern."""
    return _compiled(spark, folder, "content:work*e").select("doc_id", "score")


def lex_set(spark, folder):
    """Documents of a set of lengths: constant scores."""
    return _compiled(spark, folder, "n_chars: IN [100 200 300 400 500]").select("doc_id", "score")


def lex_exclusion(spark, folder):
    """Top hits of a query without those whose text holds an excluded word."""
    d = _documents(spark, folder)
    parsed = Q.parse_negation("workspace -cursor")
    compiler = Q.Compiler(_index(spark, folder), d)
    hits = compiler.compile(Q.Term(parsed.positive, (("content", 1.0),)))
    return Q.drop_excluded(hits, d, parsed).select("doc_id")


def lex_filtered(spark, folder):
    """Documents that pass a chain of metadata filters; null metadata passes, missing keys do not."""
    d = _documents(spark, folder)
    pairs = F.map_filter(F.create_map(F.lit("doc_type"), F.col("doc_type"), F.lit("created_at"), F.unix_timestamp("created_at").cast("string")), lambda k, v: v.isNotNull())
    meta = F.when(F.col("source").isNotNull(), pairs)
    return d.select("doc_id", meta.alias("m")).where(Q.all_of([Q.doc_type_filter(F.col("m"), ["note", "issue"]), Q.date_range_filter(F.col("m"), 1_700_000_000, None)])).select("doc_id")


def lex_snippets(spark, folder):
    """Snippets of the best document of each evaluation query."""
    d = _documents(spark, folder)
    index = _index(spark, folder)
    e = table(spark, folder, "eval_items")
    top = L.search_queries(index, e, 1, "item_id", "query")
    terms = L.query_terms(e, "item_id", "query", {"content": 1.0}).select("query_id", "term")
    df = L.document_frequencies(index).where("field = 'content'").select("term", "df")
    weights = terms.join(df, "term").groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", (1 / (1 + F.col("df"))).alias("w")))).alias("weights"))
    hits = top.join(weights, "query_id").join(d.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), "doc_id")
    return hits.select(F.col("query_id").alias("item_id"), "doc_id", X.snippet(F.col("text"), F.col("weights")).alias("snippet"))


def lex_scores(spark, folder):
    """Scores of the documents with a word, its weight doubled in titles and raised by a boost."""
    return _compiled(spark, folder, "workspace^1.5").select("doc_id", F.round("score", 6).alias("score"))


def lex_phrase_prefix(spark, folder):
    """Documents with a phrase whose last word is only begun."""
    return _compiled(spark, folder, 'content:"the work"*').select("doc_id", F.lit(True).alias("found"))


def lex_boosted(spark, folder):
    """Scores of alternatives, one of them a set with a constant score, boosted."""
    found = _compiled(spark, folder, "content:cursor OR n_chars: IN [100 200 300]").select("doc_id", "score")
    return found.select("doc_id", F.round("score", 6).alias("score"))


def lex_conversation(spark, folder):
    """Documents of a conversation query: all words, one of two alternatives, one word left out."""
    parsed = Q.ConversationParser({"content": 1.0}).parse("the cursor OR workspace -branch")
    return Q.Compiler(_index(spark, folder), _documents(spark, folder)).compile(parsed.query).select("doc_id", F.lit(True).alias("found"))


def lex_prefix_terms(spark, folder):
    """Terms of contents that begin with work, those between m and n, with their frequencies."""
    index = _index(spark, folder)
    return L.terms_with_prefix(index, "content", "work").unionByName(L.terms_between(index, "content", "m", "n")).select("field", "term", "df")


def lex_all_but(spark, folder):
    """All documents but those with a word."""
    return _compiled(spark, folder, "-content:the").select("doc_id", "score")


def lex_allowed(spark, folder):
    """Top hits of every evaluation query among the English documents."""
    hits = L.search_queries(_index(spark, folder), table(spark, folder, "eval_items"), 10, "item_id", "query", L.FIELD_BOOSTS)
    allowed = _documents(spark, folder).where("lang = 'en'").select(F.col("doc_id").cast("string").alias("doc_id"))
    return Q.allow_list(hits, allowed).select(F.col("query_id").alias("item_id"), "doc_id", "rank")


def lex_deleted(spark, folder):
    """Matches of every evaluation query without deleted documents, whose words still count in statistics."""
    index = _index(spark, folder)
    index.live = _documents(spark, folder).where("lang IS DISTINCT FROM 'de'").select(F.col("doc_id").cast("string").alias("doc_id"))
    e = table(spark, folder, "eval_items")
    top = L.search_queries(index, e, 3, "item_id", "query").select(F.col("query_id").alias("item_id"), "doc_id", F.round("score", 6).alias("score"))
    return top.join(L.match_counts(index, e, "item_id", "query").withColumnRenamed("query_id", "item_id"), "item_id")


def lex_statistics(spark, folder):
    """Documents and words of each field, and the compaction its documents by type would need if unnamed ones were deleted."""
    d = _documents(spark, folder).select(F.coalesce("doc_type", F.lit("none")).alias("segment"), F.col("title").isNull().alias("is_tombstone"), F.octet_length("text").alias("bytes"))
    s = L.segment_statistics(d)
    due = L.compaction_due(s, 0.3, 100).select("segment", F.lit(True).alias("due"))
    parts = s.join(due, "segment", "left").select("segment", "live", "tombstones", F.round("density", 6).alias("density"), "bytes", F.coalesce("due", F.lit(False)).alias("due"))
    fields = _index(spark, folder).statistics.select(F.col("field").alias("segment"), F.col("docs").alias("live"), F.lit(0).cast("bigint").alias("tombstones"), F.lit(0.0).alias("density"), F.col("total").alias("bytes"), F.lit(False).alias("due"))
    return parts.unionByName(fields)


def lex_conversations_filter(spark, folder):
    """Documents as conversation messages that pass the structured filters."""
    d = _documents(spark, folder).select("doc_id", F.col("doc_type").alias("agent"), F.col("source").alias("workspace"), F.unix_timestamp("created_at").alias("created_at"), F.col("lang").alias("source_id"), F.lit("local").alias("origin_kind"))
    return d.where(Q.conversation_filter(["note", "issue", "commit"], (), 1_700_000_000, None, "en")).select("doc_id")


def lex_segments(spark, folder):
    """Top 3 documents of every evaluation query in an index that grew by three batches, two of which were merged, and had documents replaced."""
    d = _documents(spark, folder)
    kind = F.coalesce("doc_type", F.lit("none"))

    def grow(path: str) -> None:
        index = SegmentedIndex(spark, path, FIELDS)
        index.add(d.where(kind == "note").withColumn("text", F.lit("an older text")))
        index.add(d.where(kind <= "issue"))
        index.add(d.where((kind > "issue") | (kind == "note")))
        index.merge(index.manifest()["segments"])

    index = SegmentedIndex(spark, stored_once(spark, "segments", folder, grow)).open()
    hits = L.search_queries(index, table(spark, folder, "eval_items"), 3, "item_id", "query", L.FIELD_BOOSTS)
    return hits.select(F.col("query_id").alias("item_id"), "doc_id", F.round("score", 6).alias("score"), "rank")


QUERIES = {f.__name__: f for f in (
    text_tokens, text_preview, text_edge_ngrams, text_canonical, text_chunks, text_fingerprints, text_hyphen_cjk, text_code_structure, text_redaction, query_classes,
    lex_document_frequencies, lex_bm25, lex_match_counts, lex_boolean, lex_phrase, lex_glob, lex_set, lex_exclusion, lex_filtered, lex_snippets,
    lex_scores, lex_phrase_prefix, lex_boosted, lex_conversation, lex_prefix_terms, lex_all_but, lex_allowed, lex_deleted, lex_statistics, lex_conversations_filter, lex_segments,
)}

def fnv_sql(hexed: str, start: str = "14695981039346656037") -> str:
    """SQL for FNV-1a of bytes given in hex."""
    return f"""list_reduce(list_prepend({start}::UHUGEINT, list_transform(range(length({hexed}) // 2), lambda i: ('0x' || substring({hexed}, 2 * i + 1, 2))::UTINYINT::UHUGEINT)),
        lambda a, b: (xor(a, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"""


_TOK = "regexp_extract_all(replace(lower({}), 'ς', 'σ'), '[\\p{{L}}\\p{{N}}]+')"
_TOKENS = f"""
    toks AS (SELECT doc_id::VARCHAR AS doc_id, 'content' AS field, unnest({_TOK.format("coalesce(text, '')")}) AS term FROM documents
             UNION ALL SELECT doc_id::VARCHAR, 'title', unnest({_TOK.format("coalesce(title, '')")}) FROM documents)"""

#: SQL for the class of every evaluation query: (item_id, kind).
CLASSES = """WITH q AS (SELECT item_id, regexp_replace(coalesce(query, ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS q FROM eval_items),
        k AS (SELECT item_id, CASE WHEN q = '' THEN 'empty'
            WHEN NOT regexp_matches(q, '[\\s\\p{Z}]') AND (contains(q, '/') OR contains(q, chr(92)) OR contains(q, '.') OR contains(q, '_') OR contains(q, '::') OR regexp_matches(q, '^[A-Za-z0-9_-]+-[0-9]+$')
                 OR (regexp_matches(q, '\\p{Ll}') AND regexp_matches(q, '\\p{Lu}') AND NOT regexp_matches(q, '^\\p{Lu}\\p{Ll}*$'))) THEN 'identifier'
            WHEN starts_with(q, 'fn ') OR starts_with(q, 'struct ') OR starts_with(q, 'impl ') THEN 'identifier'
            WHEN len(string_split_regex(q, '[\\s\\p{Z}]+')) <= 3 THEN 'short_keyword' ELSE 'natural_language' END AS kind FROM q)
        SELECT item_id, kind FROM k"""
_STATS = f"""{_TOKENS},
        tf AS (SELECT field, term, doc_id, count(*) AS tf FROM toks GROUP BY ALL),
        df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
        len AS (SELECT d.doc_id::VARCHAR AS doc_id, f.field, coalesce(n, 0) AS n FROM documents d CROSS JOIN (VALUES ('content'), ('title')) f(field)
                LEFT JOIN (SELECT doc_id, field, count(*) AS n FROM toks GROUP BY ALL) x ON x.doc_id = d.doc_id::VARCHAR AND x.field = f.field),
        stats AS (SELECT field, count(*) AS docs, sum(n) / count(*) AS average FROM len GROUP BY field),
        norms AS (SELECT doc_id, field, CASE WHEN n < 32 THEN n ELSE n - (n - 24) % pow(2, floor(log2(n - 24)) - 3)::BIGINT END AS q FROM len)"""
_TERM = "ln(1 + (docs - df + 0.5) / (df + 0.5)) * 2.2 * (tf / (tf + 1.2 * (0.25 + 0.75 * q / average)))"
_ASKED = f"""{_STATS},
        q AS (SELECT DISTINCT item_id, term, field, CASE field WHEN 'title' THEN 2.0 ELSE 1.0 END AS boost
              FROM (SELECT item_id, unnest({_TOK.format("query")}) AS term FROM eval_items) CROSS JOIN (VALUES ('content'), ('title')) f(field))"""
_SCORED = f"scored AS (SELECT item_id, doc_id, round(sum(boost * {_TERM}), 9) AS score FROM q JOIN tf USING (field, term) JOIN df USING (field, term) JOIN norms USING (field, doc_id) JOIN stats USING (field) GROUP BY ALL)"

ORACLE = {
    "text_tokens": f"""
        SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE len(t) END AS tokens, CASE WHEN text IS NULL THEN NULL ELSE len(list_distinct(t)) END AS different,
               list_max(list_transform(t, lambda x: length(x))) AS longest
        FROM (SELECT doc_id, text, {_TOK.format("text")} AS t FROM documents)""",
    "text_preview": """
        SELECT doc_id, left(c, 80) || CASE WHEN length(c) > 80 THEN '…' ELSE '' END AS preview, sha256(text) AS hash, left(c, 40) AS head,
               lower(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) IN ('ok', 'done', 'done.', 'got it', 'got it.', 'understood', 'understood.', 'sure', 'sure.', 'yes', 'no', 'thanks', 'thanks.', 'thank you', 'thank you.') AS low_signal
        FROM (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS c FROM documents)""",
    "text_edge_ngrams": f"""
        WITH words AS (SELECT doc_id, unnest({_TOK.format("title")}) AS w FROM documents),
             grams AS (SELECT DISTINCT doc_id, left(w, n::INT) AS ngram FROM words, range(2, 9) r(n) WHERE n <= length(w))
        SELECT ngram, count(*) AS documents FROM grams GROUP BY ngram""",
    "text_redaction": f"""
        WITH d AS (SELECT doc_id, source, title, lang, hex(encode(source)) AS hs, hex(encode(lang)) AS hl, lower(replace(source, chr(92), '/')) AS p FROM documents),
        m AS (SELECT *, {fnv_sql("hs", "17723295103990026253")} AS s, {fnv_sql("hl", "17723295103990026253")} AS l, contains(p, '.env') OR contains(p, '.npmrc') OR contains(p, '.pypirc') OR contains(p, '.netrc') OR contains(p, '.docker/config.json') AS a,
                     contains(p, '.ssh/') OR contains(p, 'id_rsa') OR contains(p, 'id_ed25519') OR contains(p, 'id_ecdsa') OR contains(p, '.gnupg/') AS b,
                     contains(p, '.aws/credentials') OR contains(p, '.config/gcloud/') OR contains(p, '.azure/') AS c, contains(p, 'cookie') OR contains(p, 'session') AS e FROM d)
        SELECT doc_id, CASE WHEN source IS NOT NULL THEN '<HASH:' || lpad(lower(to_hex(s::UBIGINT)), 16, '0') || '>' END AS source, CASE WHEN length(title) > 10 THEN left(title, 10) || '...' ELSE title END AS title,
            CASE WHEN lang IS NOT NULL THEN '<MASKED:' || lpad(lower(to_hex((l % 4294967296)::UBIGINT)), 8, '0') || '>' END AS lang, NULL::VARCHAR AS kind,
            CASE WHEN source IS NOT NULL THEN list_filter([CASE WHEN a THEN 'credential' END, CASE WHEN b THEN 'private_key' END, CASE WHEN c THEN 'cloud_secret' END, CASE WHEN e THEN 'session_artifact' END,
                CASE WHEN NOT (a OR b OR c OR e) AND contains(p, '/') THEN 'user_path' END], lambda k: k IS NOT NULL) END AS classes,
            regexp_matches(replace(source, chr(92), '/'), '\\.ssh/|\\.gnupg/|\\.aws/credentials|\\.config/gcloud/|\\.azure/|\\.kube/config|\\.docker/config\\.json|\\.npmrc|\\.pypirc|\\.netrc|\\.env|id_rsa|id_ed25519|id_ecdsa') AS denied FROM m""",
    "text_fingerprints": f"""
        WITH d AS (SELECT doc_id, text, hex(encode(text)) AS h, list_filter(string_split_regex(text, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+'), lambda w: w <> '') AS w FROM documents),
        p AS (SELECT doc_id, unnest(CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS part FROM d),
        u AS (SELECT part, {fnv_sql("h")} AS f FROM (SELECT DISTINCT part, hex(encode(part)) AS h FROM p)),
        v AS (SELECT doc_id, b, sum(((f::UBIGINT >> b::UBIGINT) % 2)::INT) AS ups, count(*) AS n FROM p JOIN u USING (part), range(64) r(b) GROUP BY ALL),
        s AS (SELECT doc_id, bit_or(CASE WHEN 2 * ups > n THEN 1::UBIGINT << b::UBIGINT ELSE 0::UBIGINT END)::HUGEINT AS x FROM v GROUP BY 1),
        e AS (SELECT doc_id, text, w, {fnv_sql("h")}::HUGEINT AS y FROM d)
        SELECT e.doc_id, CASE WHEN text IS NULL THEN NULL WHEN y >= 9223372036854775808 THEN (y - 18446744073709551616)::BIGINT ELSE y::BIGINT END AS hash,
            CASE WHEN text IS NULL THEN NULL WHEN x >= 9223372036854775808 THEN (x - 18446744073709551616)::BIGINT ELSE coalesce(x, 0)::BIGINT END AS simhash, length(text)::INT AS chars, len(w)::INT AS words
        FROM e LEFT JOIN s USING (doc_id)""",
    "text_code_structure": """
        SELECT kind, name, count(*) AS n FROM (
            SELECT 'function' AS kind, unnest(regexp_extract_all(text, '(?:fn|def|func|function)\\s+([A-Za-z_]\\w*)', 1)) AS name FROM documents
            UNION ALL SELECT 'class', unnest(regexp_extract_all(text, 'class\\s+([A-Za-z_]\\w*)', 1)) FROM documents
            UNION ALL SELECT 'type', unnest(regexp_extract_all(text, '(?:struct|enum|trait|interface|type)\\s+([A-Za-z_]\\w*)', 1)) FROM documents
            UNION ALL SELECT 'module', unnest(regexp_extract_all(text, '(?:mod|module|package|namespace)\\s+([A-Za-z_][\\w.]*)', 1)) FROM documents
            UNION ALL SELECT 'import', unnest(regexp_extract_all(text, '(?:import|use|include|require)\\s+([A-Za-z_][\\w.:]*)', 1)) FROM documents
            UNION ALL SELECT 'heading', unnest(regexp_extract_all(text, '(?m)^#{1,6}\\s+(.+)$', 1)) FROM documents) GROUP BY ALL""",
    "query_classes": f"""
        SELECT item_id, kind, CASE kind WHEN 'empty' THEN 0 WHEN 'identifier' THEN 60 WHEN 'short_keyword' THEN 30 ELSE 15 END AS lexical,
               CASE kind WHEN 'empty' THEN 0 WHEN 'identifier' THEN 15 WHEN 'short_keyword' THEN 30 ELSE 60 END AS semantic FROM ({CLASSES})""",
    "lex_document_frequencies": f"""
        WITH {_TOKENS} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM toks WHERE field = 'content' GROUP BY term""",
    "lex_bm25": f"""
        WITH {_ASKED}, {_SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank FROM scored)
        SELECT item_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank < 10""",
    "lex_segments": f"""
        WITH {_ASKED}, {_SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank FROM scored)
        SELECT item_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank < 3""",
    "lex_allowed": f"""
        WITH {_ASKED}, {_SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank FROM scored)
        SELECT item_id, doc_id, rank FROM ranked WHERE rank < 10 AND doc_id IN (SELECT doc_id::VARCHAR FROM documents WHERE lang = 'en')""",
    "lex_deleted": f"""
        WITH {_ASKED}, {_SCORED.replace("FROM q JOIN tf", "FROM (FROM q WHERE field = 'content') q JOIN tf")}, l AS (FROM scored WHERE doc_id IN (SELECT doc_id::VARCHAR FROM documents WHERE lang IS DISTINCT FROM 'de'))
        SELECT item_id, doc_id, round(score, 6) AS score, count(*) OVER (PARTITION BY item_id) AS matches FROM l QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 3""",
    "lex_scores": f"""
        WITH {_STATS} SELECT doc_id, round(sum(1.5 * CASE field WHEN 'title' THEN 2.0 ELSE 1.0 END * {_TERM}), 6) AS score
        FROM tf JOIN df USING (field, term) JOIN norms USING (field, doc_id) JOIN stats USING (field) WHERE term = 'workspace' GROUP BY doc_id""",
    "lex_boosted": f"""
        WITH {_STATS}, p AS (SELECT doc_id, {_TERM} AS s FROM tf JOIN df USING (field, term) JOIN norms USING (field, doc_id) JOIN stats USING (field) WHERE term = 'cursor' AND field = 'content'
            UNION ALL SELECT doc_id::VARCHAR, 1.0 FROM documents WHERE n_chars IN (100, 200, 300))
        SELECT doc_id, round(sum(s), 6) AS score FROM p GROUP BY 1""",
    "lex_phrase_prefix": f"""
        SELECT doc_id::VARCHAR AS doc_id, true AS found FROM documents WHERE contains(' ' || array_to_string({_TOK.format("coalesce(text, '')")}, ' ') || ' ', ' the work')""",
    "lex_conversation": f"""
        WITH {_TOKENS}, c AS (SELECT doc_id, bool_or(term = 'the') AS a, bool_or(term IN ('cursor', 'workspace')) AS b, bool_or(term = 'branch') AS x FROM toks WHERE field = 'content' GROUP BY 1)
        SELECT doc_id, true AS found FROM c WHERE a AND b AND NOT x""",
    "lex_prefix_terms": f"""
        WITH {_TOKENS}, d AS (SELECT field, term, count(DISTINCT doc_id) AS df FROM toks WHERE field = 'content' GROUP BY ALL)
        FROM d WHERE starts_with(term, 'work') UNION ALL FROM d WHERE encode(term) >= encode('m') AND encode(term) <= encode('n')""",
    "lex_all_but": f"""
        WITH {_TOKENS} SELECT doc_id::VARCHAR AS doc_id, 1.0::DOUBLE AS score FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT doc_id FROM toks WHERE field = 'content' AND term = 'the')""",
    "lex_statistics": f"""
        WITH {_TOKENS}, s AS (SELECT coalesce(doc_type, 'none') AS segment, count_if(title IS NOT NULL) AS live, count_if(title IS NULL) AS tombstones, count_if(title IS NULL) / count(*) AS density, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY 1)
        SELECT segment, live, tombstones, round(density, 6) AS density, bytes, density >= 0.3 AS due FROM s
        UNION ALL SELECT f, (SELECT count(*) FROM documents), 0, 0.0, (SELECT count(*) FROM toks WHERE field = f), false FROM (VALUES ('content'), ('title')) v(f)""",
    "lex_conversations_filter": "SELECT doc_id FROM documents WHERE doc_type IN ('note', 'issue', 'commit') AND epoch(created_at) >= 1700000000 AND lang = 'en'",
    "lex_match_counts": f"""
        WITH {_TOKENS}, q AS (SELECT DISTINCT item_id, unnest({_TOK.format("query")}) AS term FROM eval_items)
        SELECT item_id, count(DISTINCT doc_id) AS matches FROM q JOIN toks USING (term) WHERE field = 'content' GROUP BY item_id""",
    "lex_boolean": f"""
        WITH {_TOKENS}
        SELECT DISTINCT doc_id, true AS found FROM toks
        WHERE term = 'workspace' AND doc_id NOT IN (SELECT doc_id FROM toks WHERE field = 'content' AND term = 'cursor')""",
    "lex_phrase": f"""
        SELECT doc_id::VARCHAR AS doc_id, true AS found FROM documents
        WHERE contains(' ' || array_to_string({_TOK.format("coalesce(text, '')")}, ' ') || ' ', ' the workspace ')
           OR contains(' ' || array_to_string({_TOK.format("coalesce(title, '')")}, ' ') || ' ', ' the workspace ')""",
    "lex_glob": f"""
        WITH {_TOKENS} SELECT DISTINCT doc_id, 1.0::DOUBLE AS score FROM toks WHERE field = 'content' AND regexp_matches(term, '^work.*e$')""",
    "lex_set": """SELECT doc_id::VARCHAR AS doc_id, 1.0::DOUBLE AS score FROM documents WHERE n_chars IN (100, 200, 300, 400, 500)""",
    "lex_exclusion": f"""
        WITH {_TOKENS} SELECT DISTINCT t.doc_id FROM toks t JOIN documents d ON d.doc_id::VARCHAR = t.doc_id
        WHERE field = 'content' AND term = 'workspace' AND NOT regexp_matches(lower(d.text), '(^|[^\\p{{L}}\\p{{N}}_])cursor($|[^\\p{{L}}\\p{{N}}_])')""",
    "lex_filtered": """
        SELECT doc_id FROM documents
        WHERE source IS NULL OR (doc_type IN ('note', 'issue') AND created_at IS NOT NULL AND epoch(created_at) >= 1700000000)""",
}
