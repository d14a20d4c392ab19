import pytest
from pyspark.sql import functions as F

from sightline.functions import text as X
from sightline.functions import vectors as V


def column(spark, values, expression, schema="t string"):
    df = spark.createDataFrame([(v,) for v in values], schema).coalesce(1)
    return [r[0] for r in df.select(expression).collect()]


def test_default_analyzer(spark):
    got = column(spark, ["Foo-bar, BAZ_1!", "ΟΔΟΣ οδος", "", None, "日本 語"], X.tokens(F.col("t")))
    assert got == [["foo", "bar", "baz", "1"], ["οδοσ", "οδοσ"], [], None, ["日本", "語"]]


def test_hyphen_and_cjk_analyzer():
    assert X.hyphen_cjk_tokens("Foo-Bar baz") == [("foo-bar", 0), ("foo", 0), ("bar", 0), ("baz", 1)]
    assert X.hyphen_cjk_tokens("日本語 x") == [("日本", 0), ("本語", 1), ("x", 2)]
    assert X.hyphen_cjk_tokens("a" * 300) == []


def test_canonical_text_strips_markdown_and_collapses_code():
    assert X.canonical_text("# Title\n\n- **bold** and *it* [link](http://x) `code`") == "Title bold and it link code"
    code = "```py\n" + "\n".join(f"l{i}" for i in range(50)) + "\n```"
    got = X.canonical_text(code)
    assert "l19" in got and "l20 " not in got and "l40" in got and "20 lines omitted" in got
    assert [X.canonical_text(t) for t in ("OK", "Done.", "Got it.", " understood ", "THANK YOU.")] == [""] * 5
    assert [X.canonical_text(t) for t in ("Thanks!", "Great!", "lgtm", "cool", "ok ok")] == ["Thanks!", "Great!", "lgtm", "cool", "ok ok"]
    assert X.canonical_text("") == "" and len(X.canonical_text("x" * 9000)) == 2000


def test_chunks_cover_the_whole_text():
    text = "é" * 900 + "abc " * 400
    parts = X.chunk_list(text)
    raw = text.encode()
    assert parts[0]["start"] == 0 and parts[-1]["end"] == len(raw)
    assert all(a["end"] - b["start"] >= 95 and a["end"] > b["start"] for a, b in zip(parts, parts[1:]))
    assert all(raw[p["start"] : p["end"]].decode() == p["text"] for p in parts) and X.chunk_list("") == []


def test_edge_ngrams_and_preview(spark):
    assert column(spark, ["Hello a"], X.edge_ngrams(F.col("t"), 2, 4)) == [["he", "hel", "hell"]]
    assert column(spark, ["abcdef", "abc", None], X.preview(F.col("t"), 3)) == ["abc…", "abc", None]
    assert column(spark, ["é" * 3000, "short"], X.prefix_source(F.col("t"))) == ["é" * 2048, "short"]


def test_fnv_and_fingerprints(spark):
    assert X.fnv1a(b"") == 0xCBF29CE484222325 and X.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    data = [b"", b"a", "läng".encode() * 50, b"foobar"]
    slow = []
    for d in data:
        h = X.FNV_OFFSET
        for b in d:
            h = (h ^ b) * X.FNV_PRIME % 2**64
        slow.append(h)
    assert X.fnv1a_all(data).tolist() == slow and X.fnv1a_all([]).tolist() == []
    text = "one two three four five"
    votes = [0] * 64
    for p in ("one two three", "two three four", "three four five"):
        votes = [v + (1 if X.fnv1a(p.encode()) >> b & 1 else -1) for b, v in enumerate(votes)]
    assert X.simhashes(["", text, "x", text]).tolist() == [0, (want := sum(1 << b for b in range(64) if votes[b] > 0)), X.fnv1a(b"x"), want]
    assert column(spark, ["a", None], X.fnv1a_64(F.col("t"))) == [X.signed(0xAF63DC4C8601EC8C), None]
    df = spark.createDataFrame([("the cat sat on the mat today", "the cat sat on the mat today"), ("abc", "abcd" * 9), ("one two three four", "one two three fore")], "a string, b string")
    df = df.select(X.fingerprint(F.col("a")).alias("a"), X.fingerprint(F.col("b")).alias("b"))
    assert [r[0] for r in df.select(X.needs_reembedding(F.col("a"), F.col("b"))).collect()][:2] == [False, True]


def test_exclusion_respects_word_boundaries(spark):
    texts = ["a cat sat", "concatenate", "CAT!", None]
    assert column(spark, texts, X.contains_excluded(F.col("t"), "cat")) == [True, False, True, None]
    assert column(spark, ["c++ code"], X.contains_excluded(F.col("t"), "c++")) == [True]


def test_snippet_picks_the_heaviest_window_and_escapes():
    text = "x " * 200 + "rare <b> common " + "y " * 200 + "common"
    got = X.snippet_of(text, {"rare": 0.5, "common": 0.1})
    assert "<b>rare</b> &lt;b&gt; <b>common</b>" in got
    assert X.snippet_of("a < b", {"zzz": 1.0}) == "a &lt; b" and X.snippet_of("a", {"z": 1.0}, fallback=False) is None


def test_low_signal_column_agrees(spark):
    texts = ["OK", " done. ", "Thanks!", "thank you", "no way", "", None, "Understood."]
    assert column(spark, texts, X.is_low_signal(F.col("t"))) == [True, True, False, True, False, False, None, True]


def test_redaction(spark):
    h = X.MASK_SEED
    for b in "väl".encode():
        h = (h ^ b) * X.FNV_PRIME % 2**64
    shown = lambda kind, surface, **more: column(spark, ["väl", None, "x" * 70], X.redact(F.col("t"), F.lit(kind), surface, **more))
    assert shown("credential", "evidence")[:2] == [f"<MASKED:{h & 0xFFFFFFFF:08x}>", None] and shown("user_path", "log")[0] == f"<HASH:{h:016x}>"
    assert shown("query_text", "log") == ["väl", None, "x" * 64 + "..."] and shown("operational", "log")[0] == "väl"
    # what has no rule is dropped
    for kind, surface in (("credential", "log"), ("unheard_of", "log"), (None, "log"), ("operational", "elsewhere")):
        assert shown(kind, surface) == [None] * 3
    assert shown("credential", "log", rules={("credential", "log"): "passthrough"})[0] == "väl"
    assert len(X.redaction_rules()) == 55


def test_path_classes(spark):
    paths = ["/home/u/.ssh/ID_RSA", "C:\\u\\.AWS\\credentials", "/x/.env", "/src/a.py", "a.py", "/x/session/.env", None]
    assert column(spark, paths, X.path_classes(F.col("t"))) == [["private_key"], ["cloud_secret"], ["credential"], ["user_path"], [], ["credential", "session_artifact"], None]
    assert column(spark, paths, X.is_hard_deny(F.col("t"))) == [True, False, True, False, False, True, None]


def test_code_structure(spark):
    got = column(spark, ["# Head\nfn run() {}\nclass A:\nimport os"], X.code_structure(F.col("t")))[0]
    assert {(r.kind, r.name) for r in got} >= {("function", "run"), ("class", "A"), ("import", "os"), ("heading", "Head")}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(V.dot(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("b")), V.l2_normalize(F.col("a"))).collect()
    assert got[0][0] == 24 and got[0][1] == pytest.approx(0.96) and got[0][2] == pytest.approx([0.6, 0.8])
    assert got[1][1] == 0 and got[1][2] == [0, 0]


def test_quantizer_error_is_within_half_a_step(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(50)], "id int, embedding array<float>")
    fit = V.fit_quantizer(df).first()
    low, scale = (F.array(*[F.lit(float(x)) for x in v]) for v in (fit.low, fit.scale))
    back = df.select("embedding", V.dequantize(V.quantize(F.col("embedding"), low, scale), low, scale).alias("b")).collect()
    assert max(abs(x - y) - s / 2 for r in back for x, y, s in zip(r.embedding, r.b, fit.scale)) < 1e-6


def test_hash_embedders():
    a = V.hash_vector("hello world", 32)
    assert sum(x * x for x in a) == pytest.approx(1, abs=1e-6) and a == V.hash_vector("world hello", 32)
    assert V.hash_vector("a", 8) == [0.0] * 8
    assert sum(x * x for x in V.projected_vector("hello", 16)) == pytest.approx(1, abs=1e-6)
