import unicodedata as U

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import bpe, leakage, lookalike


@pytest.fixture(scope="module")
def encoders():
    import tiktoken

    with open(bpe.RANKS_PATH, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return bpe.Encoder(ranks), tiktoken.Encoding("x", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(text=st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=200))
def test_ids_equal_the_public_library_on_any_text(encoders, text):
    assert encoders[0].encode(text) == encoders[1].encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=100))
def test_look_is_stable_and_blind_to_what_is_not_seen(text):
    once = lookalike.look(text)
    assert lookalike.look(U.normalize("NFD", text)) == once
    assert lookalike.look("​".join(text)) == lookalike.look("​".join(once)) or "​" in text
    assert lookalike.words(text.upper().lower()) == lookalike.words(text.upper().lower().upper().lower())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(-9, 9), min_size=3, max_size=3), min_size=1, max_size=30), st.integers(1, 13))
def test_sliding_sums(rows, count):
    import numpy as np

    x = np.array(rows)
    if count <= len(x):
        want = np.array([x[i : i + count].sum(0) for i in range(len(x) - count + 1)])
        assert (leakage.sliding_sum(x, count) == want).all()
