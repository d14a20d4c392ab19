import unicodedata as U

from conftest import rows
from sightline.llm import canonical, lookalike

ALIKE = [
    ["Post a note", "Рost а nоte", "Ｐｏｓｔ a note", "Post a note", "Po­st a​ note﻿"],
    ["café ﬁle", "café file"],
    ["ガラス", "ｶﾞﾗｽ", "ガラス"],
    ["한글", U.normalize("NFD", "한글")],
    ["Việt ệ", U.normalize("NFD", "Việt ệ"), "Việt ệ"],
    ["ёлка", "ë" + "лкa"],
    ["ΑΒΓ", "ABГ"],
]
APART = ["post a note", "Post a  note", "Post a\nnote", "Post a note.", "cafe file", "Post a n0te", "カラス", "Post a note 1", "Post a note 2", "a\tb", "a b"]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, skeleton string")


def test_pairs_of_texts_that_look_the_same(spark):
    texts = [t for group in ALIKE for t in group] + APART + [None, "", "  ", "  ", "​"]
    want, at = set(), 0
    for group in ALIKE:
        ids = range(at, at + len(group))
        want |= {(a, b) for a in ids for b in ids if a < b}
        at += len(group)
    got = [tuple(r) for r in canonical.same_look_pairs(table(spark, texts)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_the_python_form_agrees():
    for group in ALIKE:
        assert len({lookalike.look(t) for t in group}) == 1
    assert len({lookalike.look(t) for t in APART}) == len(APART)


def test_identical_texts_are_no_pairs_and_repeated_rows_count_once(spark):
    df = table(spark, ["ok", "ok", "οk", "ok"])
    assert rows(canonical.same_look_pairs(df.union(df))) == [(0, 2), (1, 2), (2, 3)]


def test_canonical_member_is_joined_back(spark):
    df = table(spark, ["ok", "οk", None, "", "other", "ok"])
    got = {r.doc_id: r.canonical for r in canonical.canonical_texts(df).collect()}
    assert got == {0: "ok", 1: "ok", 2: None, 3: "", 4: "other", 5: "ok"}


def test_a_very_long_text_and_an_empty_table(spark):
    long = "é" * 40_000
    df = table(spark, [long, U.normalize("NFD", long), long + "x"])
    assert rows(canonical.same_look_pairs(df)) == [(0, 1)]
    assert rows(canonical.same_look_pairs(df.limit(0))) == []
    assert rows(canonical.canonical_texts(df.limit(0))) == []


def test_different_letters_of_an_alphabet_stay_different():
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя"):
        assert len({lookalike.words(c)[0] for c in alphabet}) == len(alphabet)
        assert all(lookalike.words(c) == lookalike.words(c.upper()) for c in alphabet if c not in "γνυ")
    assert lookalike.words("Νow it") == lookalike.words("now it") != lookalike.words("now lt")


def test_words_disregard_case_and_look():
    assert lookalike.words("Вот ВОТ вот") == ["bot"] * 3 or len(set(lookalike.words("Вот ВОТ вот"))) == 1
    assert lookalike.words("BOT")[0] == lookalike.words("ВОТ")[0]
