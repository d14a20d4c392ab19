"""Query strings: classes, negation, the lenient parser, the conversation parser, and their compilation to plans.

Parsing is driver-side work on one short string. A parsed query is compiled to
DataFrames over a ``LexicalIndex``: every leaf gives (doc_id, score), Boolean nodes
combine them by joins and unions.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import text as X
from sightline.operators.lexical import LexicalIndex, document_frequencies, expand_glob, length_norm, idf, K1

MAX_QUERY_CHARS = 10_000
MAX_DEPTH = 64

# -- classes ----------------------------------------------------------------------------

# What makes a single word an identifier, and how any query for a definition begins.
SEPARATORS = ["/", "\\", ".", "_", "::"]
TICKET = r"^[A-Za-z0-9_-]+-[0-9]+$"
DEFINITIONS = ["fn ", "struct ", "impl "]
# Budgets of each class, as multiples of the base.
LEXICAL_BUDGET = {"empty": 0.0, "identifier": 2.0, "short_keyword": 1.0, "natural_language": 0.5}
SEMANTIC_BUDGET = {"empty": 0.0, "identifier": 0.5, "short_keyword": 1.0, "natural_language": 2.0}


def query_class(query: str) -> str:
    """empty, identifier, short_keyword (up to three words) or natural_language.

    A single word is an identifier if it has a separator, if it has letters of both cases and is no word
    with a capital (all but the first in lower case), or if it ends in a hyphen and digits.
    """
    q = query.strip()
    if not q:
        return "empty"
    words = q.split()
    cases = any(c.islower() for c in q) and any(c.isupper() for c in q) and not (q[0].isupper() and all(c.islower() for c in q[1:]))
    if len(words) == 1 and (any(x in q for x in SEPARATORS) or cases or re.match(TICKET, q)) or q.startswith(tuple(DEFINITIONS)):
        return "identifier"
    return "short_keyword" if len(words) <= 3 else "natural_language"


def query_class_column(query: Column) -> Column:
    """``query_class`` of a column; null counts as empty."""
    space = r"[\s\p{Z}]+"
    q = F.regexp_replace(F.coalesce(query, F.lit("")), rf"^{space}|{space}$", "")
    words = F.size(F.split(q, space))
    cases = q.rlike(r"\p{IsLowercase}") & q.rlike(r"\p{IsUppercase}") & ~q.rlike(r"^\p{IsUppercase}\p{IsLowercase}*$")
    named = (words == 1) & (q.rlike("|".join(re.escape(x) for x in SEPARATORS)) | cases | q.rlike(TICKET)) | q.rlike("^(?:" + "|".join(DEFINITIONS) + ")")
    return F.when(q == "", "empty").when(named, "identifier").when(words <= 3, "short_keyword").otherwise("natural_language")


def budgets(base: int, kind: str) -> tuple[int, int]:
    """Lexical and semantic candidates for a query of a class."""
    return -int(-base * LEXICAL_BUDGET[kind] // 1), -int(-base * SEMANTIC_BUDGET[kind] // 1)


def candidate_budgets(base: Column, kind: Column) -> tuple[Column, Column]:
    def times(table: dict[str, float]) -> Column:
        m = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
        return F.ceil(base * F.element_at(m, kind)).cast("bigint")

    return times(LEXICAL_BUDGET), times(SEMANTIC_BUDGET)


# Thousandths of the candidate budget by intent (lexical, semantic).
INTENT_BUDGETS = {"identifier": (6000, 2000), "balanced": (4000, 4000), "natural_language": (2000, 8000), "fallback": (3000, 1000), "malformed": (2000, 0)}


def plan_budget(query: str, limit: int, parsed_ok: bool = True, confident: bool = True) -> dict:
    """Intent of a query and the lane budgets it gets, for a page of ``limit``."""
    kind = query_class(query)
    intent = "malformed" if not parsed_ok else "fallback" if not confident else {"identifier": "identifier", "natural_language": "natural_language"}.get(kind, "balanced")
    lexical, semantic = INTENT_BUDGETS[intent]
    return {"intent": intent, "lexical": limit * lexical // 1000, "semantic": limit * semantic // 1000, "k": limit}


def explain_class(query: str) -> str:
    q = query.strip()
    if not q:
        return "empty"
    if len(q) > 1 and q[0] == q[-1] == '"':
        return "phrase"
    return "simple" if len(q.split()) == 1 else "boolean"


# -- negation -----------------------------------------------------------------------------


@dataclass
class NegatedQuery:
    positive: str
    terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)


def parse_negation(query: str) -> NegatedQuery:
    r"""Splits ``-term``, ``-"phrase"`` and ``NOT "phrase"`` off; ``\-word`` is a literal word."""
    out, rest = NegatedQuery(""), []
    for m in re.finditer(r'(NOT\s+|(?<!\S)-)"([^"]*)"|(?<!\S)NOT\s+(\S+)|(?<!\S)-(\S+)|(?<!\S)\\(-\S+)|\S+', query):
        if m[2] is not None:
            out.phrases.append(m[2])
        elif m[3] or m[4]:
            out.terms.append(m[3] or m[4])
        else:
            rest.append(m[5] or m[0])
    out.positive = " ".join(rest)
    return out


def drop_excluded(hits: DataFrame, documents: DataFrame, negated: NegatedQuery, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Hits whose text holds none of the excluded terms and phrases; a missing text keeps its hit."""
    excluded = [*negated.terms, *negated.phrases]
    if not excluded:
        return hits
    named = documents.select(F.col(doc_id).cast("string").alias("_doc"), F.col(text).alias("_text"))
    bad = F.lit(False)
    for term in excluded:
        bad = bad | X.contains_excluded(F.col("_text"), term)
    joined = hits.join(named, F.col("doc_id").cast("string") == F.col("_doc"), "left")
    return joined.where(F.col("_text").isNull() | ~bad).drop("_doc", "_text")


# -- syntax trees ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Empty:
    pass


@dataclass(frozen=True)
class All:
    pass


@dataclass(frozen=True)
class Term:
    term: str
    fields: tuple[tuple[str, float], ...]


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    fields: tuple[tuple[str, float], ...]
    slop: int = 0
    prefix: bool = False


@dataclass(frozen=True)
class Range:
    field: str
    low: object = None
    high: object = None
    include_low: bool = True
    include_high: bool = True


@dataclass(frozen=True)
class InSet:
    field: str
    values: tuple


@dataclass(frozen=True)
class Glob:
    pattern: str
    fields: tuple[tuple[str, float], ...]


@dataclass(frozen=True)
class Boost:
    child: object
    factor: float


@dataclass(frozen=True)
class Boolean:
    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()


@dataclass
class Parsed:
    query: object
    diagnostics: list[str]
    truncated: bool


def canonical(q):
    """The same query with duplicates removed and Boolean levels in one order; scores stay the same."""
    if isinstance(q, Boost):
        child = canonical(q.child)
        return child if q.factor == 1 else Boost(child, q.factor)
    if isinstance(q, (Term, Phrase, Glob)):
        return replace(q, fields=tuple(dict.fromkeys(q.fields)))
    if isinstance(q, InSet):
        return replace(q, values=tuple(sorted(set(q.values), key=repr)))
    if isinstance(q, Boolean):
        must, should, without = ([canonical(c) for c in part] for part in (q.must, q.should, q.must_not))
        if not must and not without and len(should) == 1:
            return should[0]
        flat = []
        for c in should:
            flat += c.should if isinstance(c, Boolean) and not c.must and not c.must_not else [c]
        return Boolean(tuple(sorted(must, key=repr)), tuple(sorted(flat, key=repr)), tuple(sorted(set(without), key=repr)))
    return q


def check_capabilities(q, positionless: set[str]) -> None:
    """Raises for a phrase on a field without positions."""
    if isinstance(q, Phrase) and len(q.terms) > 1 and (bad := [f for f, _ in q.fields if f in positionless]):
        raise ValueError(f"no positions for a phrase in {bad}")
    for c in [getattr(q, "child", None), *getattr(q, "must", ()), *getattr(q, "should", ()), *getattr(q, "must_not", ())]:
        if c is not None:
            check_capabilities(c, positionless)


_WORDS = re.compile(r"[^\W_]+")


def _terms(text: str) -> list[str]:
    return [t.translate({ord("ς"): "σ"}) for t in _WORDS.findall(text.lower())]


class LenientParser:
    """Alternatives by default, AND binds tighter; never fails, notes what it mended.

    ``a b``, ``a AND b``, ``(a OR b)``, ``+a -b NOT c``, ``field:value``,
    ``field:[a TO b}``, ``field: IN [a b]``, ``"a b"~2``, ``"a b"*``, ``a^2``, ``*``.
    A bare word that the analyzer splits is a phrase.
    """

    TOKEN = re.compile(
        r"""\s*(?:(?P<open>\()|(?P<close>\))|(?P<sign>[+-](?=\S))
        |(?P<set>(?P<sf>\w+):\s*IN\s*\[(?P<sv>[^\]]*)\])
        |(?P<range>(?P<rf>\w+):\s*(?P<rl>[\[{])\s*(?P<lo>\S+)\s+TO\s+(?P<hi>[^\s\]}]+)\s*(?P<rr>[\]}]))
        |(?P<bound>(?P<bf>\w+):(?P<op>[<>]=?)(?P<bv>[^\s()]+))
        |(?:(?P<field>\w+):)?(?:"(?P<phrase>[^"]*)"?(?:~(?P<slop>\d+))?(?P<prefix>\*)?|(?P<word>[^\s()"^]+))(?:\^(?P<boost>[\d.]+))?
        |(?P<odd>.))""",
        re.X,
    )

    def __init__(self, fields: dict[str, float] | None = None, typed: dict[str, type] | None = None):
        self.fields = tuple((fields or {"content": 1.0, "title": 2.0}).items())
        self.typed = typed or {}

    def parse(self, query: str) -> Parsed:
        notes: list[str] = []
        cut = len(query) > MAX_QUERY_CHARS
        tokens = [m for m in self.TOKEN.finditer(query[:MAX_QUERY_CHARS].rstrip()) if m[0].strip()]
        self._notes, self._at, self._tokens = notes, 0, tokens
        node = self._alternatives(0)
        while self._at < len(tokens):  # a stray closing parenthesis
            notes.append("unbalanced parenthesis")
            self._at += 1
            more = self._alternatives(0)
            node = Boolean(should=(node, more)) if not isinstance(more, Empty) else node
        return Parsed(canonical(self._repair(node)), notes, cut)

    def _repair(self, node):
        """Only exclusions: everything but those."""
        if isinstance(node, Boolean) and node.must_not and not node.must and not node.should:
            return Boolean(must=(All(),), must_not=node.must_not)
        return node

    def _word(self) -> str | None:
        return self._tokens[self._at]["word"] if self._at < len(self._tokens) else None

    def _alternatives(self, depth: int):
        groups: list[list[tuple[str, object]]] = [[]]
        joined = False
        while self._at < len(self._tokens):
            t = self._tokens[self._at]
            if t["close"]:
                break
            word = t["word"] if not t["field"] and not t["boost"] else None
            if word in ("OR", "||"):
                self._at, joined = self._at + 1, False
                continue
            if word in ("AND", "&&"):
                self._at, joined = self._at + 1, True
                continue
            occur = "should"
            if t["sign"]:
                occur = "must" if t["sign"] == "+" else "not"
                self._at += 1
            elif word in ("NOT", "!"):
                occur = "not"
                self._at += 1
            node = self._primary(depth)
            if node is None:
                continue
            if joined and groups[-1]:
                groups[-1].append((occur, node))
            else:
                groups.append([(occur, node)])
            joined = False
        must, should, without = [], [], []
        for g in groups:
            if len(g) == 1:
                {"must": must, "should": should, "not": without}[g[0][0]].append(g[0][1])
            elif g:
                should.append(self._repair(Boolean(must=tuple(n for o, n in g if o != "not"), must_not=tuple(n for o, n in g if o == "not"))))
        if not must and not should and not without:
            return Empty()
        if len(should) == 1 and not must and not without:
            return should[0]
        return Boolean(tuple(must), tuple(should), tuple(without))

    def _typed(self, name: str, value: str):
        if value == "*":
            return None
        try:
            return self.typed.get(name, str)(value)
        except ValueError:
            self._notes.append(f"{value!r} is no {self.typed[name].__name__}")
            return None

    def _primary(self, depth: int):
        if self._at >= len(self._tokens):
            return None
        t = self._tokens[self._at]
        self._at += 1
        if t["open"]:
            if depth >= MAX_DEPTH:
                self._notes.append("too deep")
                return None
            node = self._repair(self._alternatives(depth + 1))
            if self._at < len(self._tokens):
                self._at += 1
            else:
                self._notes.append("unclosed parenthesis")
            return None if isinstance(node, Empty) else node
        if t["set"]:
            return InSet(t["sf"], tuple(self._typed(t["sf"], v) for v in t["sv"].split()))
        if t["range"]:
            return Range(t["rf"], self._typed(t["rf"], t["lo"]), self._typed(t["rf"], t["hi"]), t["rl"] == "[", t["rr"] == "]")
        if t["bound"]:
            v, op = self._typed(t["bf"], t["bv"]), t["op"]
            return Range(t["bf"], v, None, op == ">=") if op[0] == ">" else Range(t["bf"], None, v, True, op == "<=")
        if t["odd"] or t["sign"] or t["close"]:
            self._notes.append(f"ignored {t[0].strip()!r}")
            return None
        fields = ((t["field"], 1.0),) if t["field"] else self.fields
        if t["field"] in self.typed:
            node = InSet(t["field"], (self._typed(t["field"], t["word"] or t["phrase"] or ""),))
        elif t["phrase"] is not None:
            terms = tuple(_terms(t["phrase"]))
            node = Empty() if not terms else Term(terms[0], fields) if len(terms) == 1 and not t["prefix"] else Phrase(terms, fields, int(t["slop"] or 0), bool(t["prefix"]))
        elif t["word"] == "*":
            node = All()
        elif "*" in t["word"] or "?" in t["word"].rstrip("?"):
            node = Glob(t["word"].lower(), fields)
        else:
            terms = tuple(_terms(t["word"]))
            node = None if not terms else Term(terms[0], fields) if len(terms) == 1 else Phrase(terms, fields)
        if node is None or isinstance(node, Empty):
            return None
        if t["boost"]:
            try:
                return Boost(node, float(t["boost"]))
            except ValueError:
                self._notes.append(f"bad boost {t['boost']!r}")
        return node


# -- the conversation parser -----------------------------------------------------------------


def wildcard_kind(word: str) -> str:
    inner = word.strip("*")
    if "*" in inner or "?" in inner:
        return "complex"
    return {(False, False): "exact", (False, True): "prefix", (True, False): "suffix", (True, True): "substring"}[word.startswith("*"), word.endswith("*")]


def glob_regex(pattern: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


class ConversationParser:
    """All words must match; OR binds tighter than AND; ``NOT``/``-`` exclude; wildcards; filters are added as musts."""

    def __init__(self, fields: dict[str, float] | None = None):
        self.fields = tuple((fields or {"title": 1.0, "content": 1.0}).items())

    def _leaf(self, raw: str):
        if raw.startswith('"'):
            terms = tuple(t for t, _ in X.hyphen_cjk_tokens(raw.strip('"')) if "-" not in t)
            return None if not terms else Phrase(terms, self.fields) if len(terms) > 1 else Term(terms[0], self.fields)
        if wildcard_kind(raw) != "exact" and raw.strip("*?"):
            return Glob(raw.lower(), self.fields)
        found = X.hyphen_cjk_tokens(raw)
        terms = list(dict.fromkeys(t for t, _ in found))
        if not terms:
            return None
        compound = [t for t in terms if "-" in t] or terms
        leaves = tuple(Term(t, self.fields) for t in compound)
        return leaves[0] if len(leaves) == 1 else Boolean(must=leaves)

    def parse(self, query: str, filters: tuple = ()) -> Parsed:
        words = re.findall(r'-?"[^"]*"?|\S+', query[:MAX_QUERY_CHARS])
        must, without, notes = list(filters), [], []
        pending: list | None = None
        exclude = False
        for w in words:
            if w in ("AND", "&&"):
                continue
            if w in ("OR", "||"):
                pending = [must.pop()] if len(must) > len(filters) else []
                continue
            if w == "NOT":
                exclude = True
                continue
            if w.startswith("-") and len(w) > 1:
                exclude, w = True, w[1:]
            leaf = self._leaf(w)
            if leaf is None:
                notes.append(f"ignored {w!r}")
            elif exclude:
                without.append(leaf)
            elif pending is not None:
                before = pending[0].should if pending and isinstance(pending[0], Boolean) and pending[0].should else tuple(pending)
                must.append(Boolean(should=(*before, leaf)))
            else:
                must.append(leaf)
            pending, exclude = None, False
        if not must and without:
            must = [All()]
        return Parsed(canonical(Boolean(must=tuple(must), must_not=tuple(without))) if must else Empty(), notes, len(query) > MAX_QUERY_CHARS)


# -- compilation ---------------------------------------------------------------------------------


class Compiler:
    """Turns a syntax tree into a DataFrame (doc_id, score) over an index and a documents table.

    ``documents`` (doc_id and typed columns) serves ranges, sets and match-all.
    """

    def __init__(self, index: LexicalIndex, documents: DataFrame, doc_id: str = "doc_id"):
        self.index = index
        self.documents = documents.withColumn("_id", F.col(doc_id).cast("string"))
        self.doc_id = doc_id

    def _flat(self, where: Column | None = None) -> DataFrame:
        rows = self.documents if where is None else self.documents.where(where)
        return rows.select(F.col("_id").alias("doc_id"), F.lit(1.0).alias("score")).where("doc_id IS NOT NULL")

    def _none(self) -> DataFrame:
        return self._flat(F.lit(False))

    def _live(self, rows: DataFrame) -> DataFrame:
        return rows if self.index.live is None else rows.join(self.index.live, "doc_id", "left_semi")

    def _weighted(self, hits: DataFrame, weight: DataFrame, boost: float) -> DataFrame:
        """Scores of ``hits`` (field, doc_id, tf, length), by ``weight`` (field, idf): one row a field."""
        stats = self.index.statistics.select("field", (F.col("total") / F.col("docs")).alias("_avg"))
        rows = hits.join(F.broadcast(weight), "field").join(F.broadcast(stats), "field")  # a row a field
        score = F.col("idf") * (1 + K1) * (F.col("tf") / (F.col("tf") + length_norm(F.col("length"), F.col("_avg")))) * boost
        return rows.select("doc_id", score.alias("score"))

    def _idf(self, terms: list[str], name: str) -> DataFrame:
        """(field, idf): sum of the terms' idf in a field; a term that occurs nowhere counts as rarest."""
        df = document_frequencies(self.index).where((F.col("field") == name) & F.col("term").isin(terms))
        stats = self.index.statistics.where(F.col("field") == name)
        each = stats.withColumn("term", F.explode(F.array(*[F.lit(t) for t in terms]))).join(df, ["field", "term"], "left")
        return each.groupBy("field").agg(F.sum(idf(F.coalesce("df", F.lit(0)), F.col("docs"))).alias("idf"))

    def _term(self, q: Term) -> DataFrame:
        out = None
        for name, boost in q.fields:
            hits = self.index.postings.where((F.col("field") == name) & (F.col("term") == q.term)).select("field", "doc_id", "tf", "length")
            part = self._weighted(hits, self._idf([q.term], name), boost)
            out = part if out is None else out.unionByName(part)
        return self._live(out.groupBy("doc_id").agg(F.sum("score").alias("score")))

    def _phrase(self, q: Phrase) -> DataFrame:
        out = None
        for name, boost in q.fields:
            posts = self.index.postings.where(F.col("field") == name)
            rows = None
            for i, t in enumerate(q.terms):
                match = F.col("term").startswith(t) if q.prefix and i == len(q.terms) - 1 else F.col("term") == t
                one = posts.where(match).groupBy("field", "doc_id").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias(f"p{i}"), *([F.max("length").alias("length")] if i == 0 else []))
                rows = one if rows is None else rows.join(one, ["field", "doc_id"])
            if q.slop == 0 or len(q.terms) == 1:
                starts = F.filter("p0", lambda p: _all([F.array_contains(F.col(f"p{i}"), p + i) for i in range(1, len(q.terms))]))
                tf = F.size(starts).cast("bigint")
            else:
                tf = _sloppy(q.slop)(F.array(*[f"p{i}" for i in range(len(q.terms))]))
            hits = rows.select("field", "doc_id", tf.alias("tf"), "length").where("tf > 0")
            part = self._weighted(hits, self._idf(list(q.terms), name), boost)
            out = part if out is None else out.unionByName(part)
        return self._live(out.groupBy("doc_id").agg(F.sum("score").alias("score")))

    def _glob(self, q: Glob) -> DataFrame:
        """Expanded terms score a constant, like every rewritten set of terms."""
        out = None
        for name, boost in q.fields:
            terms = expand_glob(self.index, name, q.pattern).select("field", "term")
            part = self.index.postings.join(terms, ["field", "term"], "left_semi").select("doc_id").distinct().withColumn("score", F.lit(float(boost)))
            out = part if out is None else out.unionByName(part)
        return self._live(out.groupBy("doc_id").agg(F.sum("score").alias("score")))

    def _boolean(self, q: Boolean) -> DataFrame:
        parts = [(self.compile(c), True) for c in q.must] + [(self.compile(c), False) for c in q.should]
        if not parts:
            return self._none()
        union = None
        for d, must in parts:
            d = d.select("doc_id", "score", F.lit(1 if must else 0).alias("_must"))
            union = d if union is None else union.unionByName(d)
        rows = union.groupBy("doc_id").agg(F.sum("score").alias("score"), F.sum("_must").alias("_musts")).where(F.col("_musts") == len(q.must)).drop("_musts")
        for c in q.must_not:
            rows = rows.join(self.compile(c).select("doc_id"), "doc_id", "left_anti")
        return rows

    def _range(self, q: Range) -> DataFrame:
        c, where = F.col(q.field), F.col(q.field).isNotNull()
        if q.low is not None:
            where = where & ((c >= F.lit(q.low)) if q.include_low else (c > F.lit(q.low)))
        if q.high is not None:
            where = where & ((c <= F.lit(q.high)) if q.include_high else (c < F.lit(q.high)))
        return self._live(self._flat(where))

    def compile(self, q) -> DataFrame:
        if isinstance(q, Term):
            return self._term(q)
        if isinstance(q, Phrase):
            return self._phrase(q)
        if isinstance(q, Glob):
            return self._glob(q)
        if isinstance(q, Boolean):
            return self._boolean(q)
        if isinstance(q, Range):
            return self._range(q)
        if isinstance(q, InSet):
            return self._live(self._flat(F.col(q.field).isin(*[v for v in q.values if v is not None])))
        if isinstance(q, Boost):
            child = self.compile(q.child)
            return child.withColumn("score", F.col("score") * max(0.0, q.factor))
        return self._live(self._flat()) if isinstance(q, All) else self._none()


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def sloppy_count(positions: list[list[int]], slop: int) -> int:
    """Occurrences of a phrase whose words may be moved by ``slop`` places in all."""
    n = 0
    for start in positions[0]:
        at, moved = start, 0
        for later in positions[1:]:
            after = [p for p in later if p > at]
            if not after:
                moved = slop + 1
                break
            moved += min(after) - at - 1
            at = min(after)
        n += moved <= slop
    return n


def _sloppy(slop: int):
    @F.arrow_udf("bigint")
    def run(positions: pa.Array) -> pa.Array:
        return pa.array([sloppy_count(p, slop) for p in positions.to_pylist()], pa.int64())

    return run


# -- filters ---------------------------------------------------------------------------------------


def all_of(filters: list[Column]) -> Column:
    return _all(filters)


def any_of(filters: list[Column]) -> Column:
    """No filter at all lets everything through."""
    out = F.lit(not filters)
    for c in filters:
        out = out | c
    return out


def doc_type_filter(metadata: Column, kinds: list[str]) -> Column:
    """A null map passes, a map without the key does not."""
    return metadata.isNull() | F.coalesce(F.element_at(metadata, "doc_type").isin(kinds), F.lit(False))


def date_range_filter(metadata: Column, low: int | None, high: int | None) -> Column:
    at = F.element_at(metadata, "created_at").cast("bigint")
    inside = F.lit(True)
    if low is not None:
        inside = inside & (at >= low)
    if high is not None:
        inside = inside & (at <= high)
    return metadata.isNull() | F.coalesce(inside & at.isNotNull(), F.lit(False))


def allow_list(hits: DataFrame, allowed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return hits.join(allowed.select(doc_id).distinct(), doc_id, "left_semi")


def conversation_filter(agents: list[str] = (), workspaces: list[str] = (), low: int | None = None, high: int | None = None, source: str = "all") -> Column:
    """Columns agent, workspace, created_at, origin_kind, source_id; ``source``: all, local, remote or an id."""
    parts = []
    if agents:
        parts.append(F.col("agent").isin(list(agents)))
    if workspaces:
        parts.append(F.col("workspace").isin(list(workspaces)))
    if low is not None:
        parts.append(F.col("created_at") >= low)
    if high is not None:
        parts.append(F.col("created_at") <= high)
    if source in ("local", "remote"):
        parts.append(F.col("origin_kind") == source)
    elif source != "all":
        parts.append(F.col("source_id") == source)
    return all_of(parts)


def expand_query(query: str, expander=None) -> list[str]:
    """Up to three variants from a pluggable expander; without one, the query alone."""
    variants = [query] if expander is None else [query, *expander(query)][:4]
    return [unicodedata.normalize("NFC", v) for v in dict.fromkeys(variants)]
