"""Scalar text expressions. Everything that SQL functions can say stays a Column; the rest are Arrow functions."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as padding around a code such as a change kind or a consumer id.
BLANKS = " \t\n\r\f\v"

# Replies that carry no content of their own, as whole texts without regard to ASCII case.
LOW_SIGNAL = ["ok", "done", "done.", "got it", "got it.", "understood", "understood.", "sure", "sure.", "yes", "no", "thanks", "thanks.", "thank you", "thank you."]

MAX_CHARS = 2000
CODE_HEAD, CODE_TAIL = 20, 10
MAX_TERM_BYTES = 65_530
MAX_COMPOUND_BYTES = 256


# -- analysis ---------------------------------------------------------------------


def fold(text: Column) -> Column:
    """Lower case; a final sigma is the same letter as any other."""
    return F.translate(F.lower(text), "ς", "σ")


def tokens(text: Column) -> Column:
    """Default analyzer: runs of letters and digits in lower case, in order. Null gives null, empty gives []."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def admitted(terms: Column) -> Column:
    """Drops over-long terms; used with positions taken before, so that gaps stay."""
    return F.filter(terms, lambda t: F.octet_length(t) <= MAX_TERM_BYTES)


def edge_ngrams(text: Column, low: int = 2, high: int = 20) -> Column:
    """Every prefix of ``low`` to ``high`` characters of each word."""
    long = F.filter(tokens(text), lambda w: F.length(w) >= low)
    return F.flatten(F.transform(long, lambda w: F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.length(w))), lambda n: F.substring(w, F.lit(1), n))))


def preview(text: Column, chars: int = 200) -> Column:
    """The first characters, with an ellipsis if more follow."""
    return F.concat(F.left(text, F.lit(chars)), F.when(F.length(text) > chars, F.lit("…")).otherwise(F.lit("")))


def prefix_source(text: Column, most: int = 4096) -> Column:
    """The longest whole characters within the first ``most`` bytes."""
    return F.when(F.octet_length(text) <= most, text).otherwise(_prefix_bytes(text, F.lit(most)))


@F.arrow_udf(T.StringType())
def _prefix_bytes(text: pa.Array, most: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t.encode()[:n].decode("utf-8", "ignore") for t, n in zip(text.to_pylist(), most.to_pylist())], pa.string())


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_low_signal(text: Column) -> Column:
    """Whether the whole text, but for white space around it, is a bare acknowledgement; other punctuation keeps it ("Thanks!")."""
    return F.trim(text, F.lit(BLANKS)).rlike(rf"(?i)\A(?:{'|'.join(re.escape(t) for t in LOW_SIGNAL)})\z")


def truncate_chars(text: Column, most: int = MAX_CHARS) -> Column:
    return F.left(text, F.lit(most))


# -- canonical documents and queries ------------------------------------------------

_FENCE = re.compile(r"^\s*(```|~~~)\s*(\S*)")
_PREFIX = re.compile(r"^\s*(?:#{1,6}\s+|>\s?|[-*+]\s+|\d+[.)]\s+)")
_LINK = re.compile(r"!?\[([^\]]*)\]\([^)]*\)")
_EMPHASIS = [re.compile(r"\*\*(.+?)\*\*"), re.compile(r"__(.+?)__"), re.compile(r"(?<![\w*])\*([^*\s][^*]*)\*(?![\w*])"), re.compile(r"(?<![\w_])_([^_\s][^_]*)_(?![\w_])")]
_CODE = re.compile(r"`([^`]*)`")


def strip_markdown_line(line: str) -> str:
    """A line without heading, quote and list marks, emphasis, link targets and inline code marks."""
    while (cut := _PREFIX.sub("", line, count=1)) != line:
        line = cut
    line = _LINK.sub(r"\1", line)
    for mark in _EMPHASIS:
        line = mark.sub(r"\1", line)
    return _CODE.sub(r"\1", line)


def collapse_code(lines: list[str], language: str) -> list[str]:
    """A fenced block of more than head + tail lines keeps those, with a note of how many were left out."""
    tag = [f"[code: {language}]"] if language else []
    if len(lines) <= CODE_HEAD + CODE_TAIL:
        return tag + lines
    return tag + lines[:CODE_HEAD] + [f"[... {len(lines) - CODE_HEAD - CODE_TAIL} lines omitted ...]"] + lines[-CODE_TAIL:]


def canonical_text(text: str, most: int = MAX_CHARS) -> str:
    """NFC, markdown stripped, long code collapsed, white space collapsed, bare acknowledgements dropped, cut to ``most`` characters."""
    out: list[str] = []
    block: list[str] | None = None
    language = ""
    for line in unicodedata.normalize("NFC", text).splitlines():
        fence = _FENCE.match(line)
        if fence and block is None:
            block, language = [], fence[2]
        elif fence:
            out += collapse_code(block, language)
            block = None
        elif block is not None:
            block.append(line)
        else:
            out.append(strip_markdown_line(line))
    if block is not None:
        out += collapse_code(block, language)
    flat = " ".join(" ".join(out).split())
    return "" if flat.isascii() and flat.lower() in LOW_SIGNAL else flat[:most]


def canonical_query(query: str, most: int = MAX_CHARS) -> str:
    return unicodedata.normalize("NFC", query).strip()[:most]


@F.arrow_udf(T.StringType())
def canonicalize(text: pa.Array) -> pa.Array:
    """``canonical_text`` of a column; null stays null. (SQL has no NFC and no line state.)"""
    return pa.array([None if t is None else canonical_text(t) for t in text.to_pylist()], pa.string())


# -- the analyzer for code and scripts without spaces --------------------------------

_UNIT = re.compile(r"[0-9A-Za-z]+(?:-[0-9A-Za-z]+)*|[぀-ヿ㐀-鿿豈-﫿가-힯]+|[^\W_]+")


def hyphen_cjk_tokens(text: str) -> list[tuple[str, int]]:
    """(term, position): hyphenated compounds and their parts share a position, runs of Han, kana and Hangul give bigrams."""
    out, position = [], 0
    for unit in _UNIT.findall(text):
        if unit[0] >= "぀" and len(unit) > 1 and _UNIT.fullmatch(unit) and not unit[0].isascii():
            grams = [unit[i : i + 2] for i in range(len(unit) - 1)]
        else:
            grams = [unit]
        for gram in grams:
            folded = "".join(c.lower() if c.isascii() else c for c in gram)
            terms = [folded, *(folded.split("-") if "-" in folded else [])]
            out += [(t, position) for t in terms if len(t.encode()) <= MAX_COMPOUND_BYTES]
            position += 1
    return out


TOKEN = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("position", T.IntegerType())]))


@F.arrow_udf(TOKEN)
def hyphen_cjk(text: pa.Array) -> pa.Array:
    """``hyphen_cjk_tokens`` of a column; null stays null."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("position", pa.int32())]))
    return pa.array([None if t is None else [{"term": a, "position": p} for a, p in hyphen_cjk_tokens(t)] for t in text.to_pylist()], kind)


_CODE_TOKEN = re.compile(r"[\w$@#][\w$@#.:/-]*", re.ASCII)
CODE_TOKEN = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def code_token_list(text: str) -> list[dict]:
    """Tokens that keep the punctuation of identifiers, with line (from 1) and byte span."""
    out, line, at = [], 1, 0
    for row in text.split("\n"):
        for m in _CODE_TOKEN.finditer(row):
            start = at + len(row[: m.start()].encode())
            out.append({"term": m[0].lower(), "line": line, "start": start, "end": start + len(m[0])})
        line, at = line + 1, at + len(row.encode()) + 1
    return out


@F.arrow_udf(CODE_TOKEN)
def code_tokens(text: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("term", pa.string()), ("line", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    return pa.array([None if t is None else code_token_list(t) for t in text.to_pylist()], kind)


# -- chunks --------------------------------------------------------------------------

CHUNK = T.ArrayType(T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("tokens", T.IntegerType()), T.StructField("text", T.StringType())]))


def chunk_list(text: str, window: int = 768, overlap: int = 96) -> list[dict]:
    """Windows of ``window`` bytes at character boundaries, each overlapping the one before."""
    raw, out, at = text.encode(), [], 0

    def boundary(i: int) -> int:
        while 0 < i < len(raw) and raw[i] & 0xC0 == 0x80:
            i -= 1
        return i

    while at < len(raw):
        end = boundary(min(len(raw), at + window))
        piece = raw[at:end].decode()
        out.append({"ordinal": len(out), "start": at, "end": end, "tokens": len(_CODE_TOKEN.findall(piece)), "text": piece})
        if end == len(raw):
            break
        at = max(boundary(end - overlap), at + 1)
    return out


@F.arrow_udf(CHUNK)
def chunks(text: pa.Array) -> pa.Array:
    """``chunk_list`` of a column; the whole text is covered. Null stays null, empty gives []."""
    kind = pa.list_(pa.struct([("ordinal", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("tokens", pa.int32()), ("text", pa.string())]))
    return pa.array([None if t is None else chunk_list(t) for t in text.to_pylist()], kind)


# -- hashes and fingerprints -----------------------------------------------------------

FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def fnv1a(data: bytes) -> int:
    """FNV-1a of some bytes."""
    return int(fnv1a_all([data])[0])


def fnv1a_all(data: list[bytes], start: int = FNV_OFFSET) -> np.ndarray:
    """FNV-1a of each: one byte of all of them at a time, longest first, so that those still running lie together."""
    size = np.fromiter(map(len, data), np.int64, len(data))
    order = np.argsort(-size, kind="stable")
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    first, left = (np.cumsum(size) - size)[order], size[order]
    running = np.searchsorted(-left, -np.arange(1, left[0] + 1 if len(left) else 1), "right")
    h, prime = np.full(len(data), start, np.uint64), np.uint64(FNV_PRIME)
    for at, n in enumerate(running):
        h[:n] = (h[:n] ^ flat[first[:n] + at]) * prime
    out = np.empty_like(h)
    out[order] = h
    return out


def signed(h: int) -> int:
    """An unsigned 64-bit number as the BIGINT of the same bits."""
    return h - (1 << 64) if h >> 63 else h


@F.arrow_udf(T.LongType())
def fnv1a_64(text: pa.Array) -> pa.Array:
    """FNV-1a of the UTF-8 bytes, as the BIGINT of the same bits."""
    return pa.array(fnv1a_all(_bytes(text)).view(np.int64), pa.int64(), mask=text.is_null().to_numpy(zero_copy_only=False))


def _bytes(text: pa.Array) -> list[bytes]:
    return text.fill_null("").cast(pa.binary()).to_pylist()


def simhashes(texts: list[str]) -> np.ndarray:
    """64-bit SimHash of each text over its shingles of three words (single words if there are fewer)."""
    parts: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for n, text in enumerate(texts):
        words = text.split()
        mine = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or words
        parts += [m.encode() for m in mine]
        counts[n] = len(mine)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(fnv1a_all(parts).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ups = np.add.reduceat(bits, (np.cumsum(counts) - counts)[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * ups > counts[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def simhash(text: str) -> int:
    return int(simhashes([text])[0])


FINGERPRINT = T.StructType([T.StructField("hash", T.LongType()), T.StructField("simhash", T.LongType()), T.StructField("chars", T.IntegerType()), T.StructField("words", T.IntegerType())])


@F.arrow_udf(FINGERPRINT)
def fingerprint(text: pa.Array) -> pa.Array:
    """Hash, SimHash and size of each text; null stays null."""
    texts = text.fill_null("").to_pylist()
    parts = [fnv1a_all(_bytes(text)).view(np.int64), simhashes(texts).view(np.int64), np.array([len(t) for t in texts], np.int32), np.array([len(t.split()) for t in texts], np.int32)]
    return pa.StructArray.from_arrays([pa.array(x) for x in parts], ["hash", "simhash", "chars", "words"], mask=text.is_null())


def needs_reembedding(old: Column, new: Column, threshold: float = 8 / 64, chars: float = 0.2) -> Column:
    """Whether a document changed enough: unchanged no, its length by more than ``chars`` yes, else by SimHash distance."""
    grown = F.abs(new["chars"] - old["chars"]) / F.greatest(old["chars"], F.lit(1))
    far = F.bit_count(old["simhash"].bitwiseXOR(new["simhash"])) / 64
    return F.when(old["hash"] == new["hash"], False).when(grown > chars, True).otherwise(far > threshold)


# -- negation ----------------------------------------------------------------------------


def contains_excluded(text: Column, term: str) -> Column:
    """Whether ``text`` holds a term to leave out; word-like terms need word boundaries, others match anywhere."""
    folded = unicodedata.normalize("NFC", term).lower()
    if re.fullmatch(r"[\w\s]+", folded):
        body = r"\s+".join(re.escape(w) for w in folded.split())
        return F.lower(text).rlike(rf"(?<![\p{{L}}\p{{N}}_]){body}(?![\p{{L}}\p{{N}}_])")
    return F.contains(F.lower(text), F.lit(folded))


# -- code structure -----------------------------------------------------------------------

# What marks a definition or import, by kind.
STRUCTURE = {
    "function": r"(?:fn|def|func|function)\s+([A-Za-z_]\w*)",
    "class": r"class\s+([A-Za-z_]\w*)",
    "type": r"(?:struct|enum|trait|interface|type)\s+([A-Za-z_]\w*)",
    "module": r"(?:mod|module|package|namespace)\s+([A-Za-z_][\w.]*)",
    "import": r"(?:import|use|include|require)\s+([A-Za-z_][\w.:]*)",
    "heading": r"(?md)^#{1,6}\s+(.+)$",
}


def code_structure(content: Column) -> Column:
    """array<struct<kind, name>>: names defined or imported in the text and its headings."""

    def named(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(content, F.lit(pattern), 1), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    return F.concat(*[named(kind, pattern) for kind, pattern in STRUCTURE.items()])


# -- redaction ------------------------------------------------------------------------------

# What a class of data becomes on each surface.
REDACTION = """
class                   log          evidence     explain      display      repro_pack
credential              drop         mask         drop         drop         mask
private_key             drop         drop         drop         drop         drop
cloud_secret            drop         mask         drop         drop         mask
session_artifact        drop         drop         drop         drop         drop
personal_data           hash         hash         truncate     truncate     hash
financial_data          hash         hash         drop         drop         hash
health_data             hash         hash         drop         drop         hash
sensitive_file_content  drop         mask         drop         drop         mask
user_path               hash         hash         truncate     passthrough  hash
query_text              truncate     truncate     passthrough  passthrough  truncate
operational             passthrough  passthrough  passthrough  passthrough  passthrough
"""
# Characters a truncated value keeps, and where the hash of masks begins.
TRUNCATED, MASK_SEED = 64, 0xF5F5CAFEBABED00D

# What in a path, without regard to case, tells its data classes; other paths with a folder are user_path.
SENSITIVE_PATHS = {
    "private_key": [".ssh/", "id_rsa", "id_ed25519", "id_ecdsa", ".gnupg/"],
    "cloud_secret": [".aws/credentials", ".config/gcloud/", ".azure/"],
    "credential": [".env", ".npmrc", ".pypirc", ".netrc", ".docker/config.json"],
    "session_artifact": ["cookie", "session"],
}
# Paths whose content is never kept, shown or sent; case counts.
HARD_DENY = [".ssh/", ".gnupg/", ".aws/credentials", ".config/gcloud/", ".azure/", ".kube/config", ".docker/config.json", ".npmrc", ".pypirc", ".netrc", ".env", "id_rsa", "id_ed25519", "id_ecdsa"]
#: The order in which a path's classes are listed.
CLASS_ORDER = ["credential", "private_key", "cloud_secret", "session_artifact", "user_path"]


def redaction_rules() -> dict[tuple[str, str], str]:
    """(class, surface) to what is done."""
    head, *lines = [line.split() for line in REDACTION.strip().split("\n")]
    return {(kind, surface): action for kind, *actions in lines for surface, action in zip(head[1:], actions)}


def _seeded(digits: int):
    @F.arrow_udf(T.StringType())
    def run(value: pa.Array) -> pa.Array:
        low = fnv1a_all(_bytes(value), MASK_SEED) & np.uint64((1 << 4 * digits) - 1)
        return pa.array([f"{h:0{digits}x}" for h in low.tolist()], pa.string(), mask=value.is_null().to_numpy(zero_copy_only=False))

    return run


def redact(value: Column, data_class: Column, surface: str, keep: int = TRUNCATED, rules: dict[tuple[str, str], str] | None = None) -> Column:
    """The value as ``surface`` may see it: dropped (null), masked, hashed, cut or whole.

    Pairs without a rule, unknown classes and surfaces, and null classes drop the value. Equal values have equal masks.
    """
    out = F.lit(None).cast("string")
    for (kind, where), action in (redaction_rules() if rules is None else rules).items():
        if where != surface or action == "drop":
            continue
        new = {
            "mask": lambda: F.concat(F.lit("<MASKED:"), _seeded(8)(value), F.lit(">")),
            "hash": lambda: F.concat(F.lit("<HASH:"), _seeded(16)(value), F.lit(">")),
            "truncate": lambda: F.when(F.length(value) > keep, F.concat(F.left(value, F.lit(keep)), F.lit("..."))).otherwise(value),
            "passthrough": lambda: value,
        }[action]()
        out = F.when(data_class == kind, new).otherwise(out)
    return out


def path_classes(path: Column) -> Column:
    """The data classes of a path, in the order of ``CLASS_ORDER``; [] for a bare name. Null gives null."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    lower = F.lower(plain)

    def holds(text: Column, parts: list[str]) -> Column:
        return text.rlike("|".join(re.escape(p) for p in parts))

    marks = {kind: holds(lower, parts) for kind, parts in SENSITIVE_PATHS.items()}
    none = ~F.greatest(*marks.values())
    marks["user_path"] = none & F.contains(plain, F.lit("/"))
    listed = F.filter(F.array(*[F.when(marks[k], F.lit(k)) for k in CLASS_ORDER]), lambda k: k.isNotNull())
    return F.when(path.isNotNull(), listed)


def is_hard_deny(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike("|".join(re.escape(p) for p in HARD_DENY))


# -- snippets ----------------------------------------------------------------------------------


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#x27;")


_WORD = re.compile(r"[^\W_]+")


def snippet_of(text: str, weights: dict[str, float], most: int = 200, fallback: bool = True) -> str | None:
    """The window of at most ``most`` bytes whose distinct matched terms weigh most, earliest on ties, matches in <b>.

    ``weights``: 1 / (1 + document frequency) by term. Without a match: the escaped prefix, or None.
    """
    found = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(text)]
    ends = [0]
    for a, b in zip([0, *[f[1] for f in found]], [f[1] for f in found]):
        ends.append(ends[-1] + len(text[a:b].encode()))
    begins = [ends[i + 1] - len(text[f[0] : f[1]].encode()) for i, f in enumerate(found)]
    best, best_span, last = 0.0, None, 0
    for i in range(len(found)):
        if found[i][2] not in weights:
            continue
        last = max(last, i)
        while last + 1 < len(found) and ends[last + 2] - begins[i] <= most:
            last += 1
        score = sum(weights[t] for t in {f[2] for f in found[i : last + 1]} if t in weights)
        if score > best:
            best, best_span = score, (i, last)
    if best_span is None:
        if not fallback:
            return None
        return _escape(text.encode()[:most].decode("utf-8", "ignore"))
    i, j = best_span
    out, at = [], found[i][0]
    for a, b, t in found[i : j + 1]:
        out.append(_escape(text[at:a]))
        out.append(f"<b>{_escape(text[a:b])}</b>" if t in weights else _escape(text[a:b]))
        at = b
    return "".join(out)


def snippet(text: Column, weights: Column, most: int = 200, fallback: bool = True) -> Column:
    """``snippet_of`` for rows of few hits; ``weights`` is a map<string, double>."""

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array, maps: pa.Array) -> pa.Array:
        return pa.array([None if t is None else snippet_of(t, dict(m or []), most, fallback) for t, m in zip(texts.to_pylist(), maps.to_pylist())], pa.string())

    return run(text, weights)

