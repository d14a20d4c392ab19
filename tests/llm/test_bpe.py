import random

import pytest
from sightline.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    with open(bpe.RANKS_PATH, "rb") as f:
        return bpe.read_ranks(f.read())


def texts(n=300):
    rng = random.Random(5)
    pool = ["the ", "日本", " \n", "\t", "é", "é", "'ll", "123456", "<|endoftext|>", "👩‍👩‍👧", " ", "a" * 40, "ﬁ", "\x00", "мир", "    "]
    return ["".join(rng.choices(pool, k=rng.randrange(0, 60))) for _ in range(n)]


def test_ids_equal_the_public_library(ranks):
    import tiktoken

    ours = bpe.Encoder(ranks)
    theirs = tiktoken.Encoding("x", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in texts():
        assert ours.encode(t) == theirs.encode_ordinary(t)


def test_long_words_merge_like_short_ones(ranks):
    rng = random.Random(1)
    for _ in range(30):
        word = "".join(rng.choices("abcde123日é", k=rng.randrange(2, 300))).encode()
        assert bpe.merge_long(word, ranks) == bpe.merge_short(word, ranks)


def test_a_very_long_word_takes_no_quadratic_time(ranks):
    ids = bpe.Encoder(ranks).encode("x1" * 50_000)
    back = {v: k for k, v in ranks.items()}
    assert b"".join(back[i] for i in ids).decode() == "x1" * 50_000


def test_documents_with_null_empty_and_repeated_rows(spark, ranks):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "hello world", 9), (3, "hello world", 9), (None, " ", 9)], "doc_id bigint, text string, ids int")
    got = {(r.doc_id, tuple(r.ids)) for r in bpe.encode_documents(df).collect()}
    hello = tuple(bpe.Encoder(ranks).encode("hello world"))
    assert got == {(1, ()), (2, ()), (3, hello), (None, tuple(bpe.Encoder(ranks).encode(" ")))}
    assert bpe.encode_documents(df).count() == 5
    assert bpe.encode_documents(df.limit(0)).collect() == []
    assert bpe.encode_documents(df).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
