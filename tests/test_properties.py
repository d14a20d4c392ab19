import math

from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.functions import text as X
from sightline.operators import evaluation as E
from sightline.operators import query_language as Q
from sightline.operators.vector_search import pack_nibbles, unpack_nibbles

QUERY = st.text(alphabet=st.sampled_from(list('ab "()[]{}:+-*?~^\\<>=0159TO ANDORINnot日é')), max_size=60)


@settings(max_examples=300, deadline=None)
@given(QUERY)
def test_parsers_never_fail(query):
    parsed = Q.LenientParser(typed={"a": int}).parse(query)
    assert Q.canonical(parsed.query) == parsed.query
    Q.ConversationParser().parse(query)
    Q.parse_negation(query)
    assert Q.query_class(query) in Q.LEXICAL_BUDGET


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=3000))
def test_chunks_and_canonical_text(text):
    parts, raw = X.chunk_list(text), text.encode("utf-8", "ignore") if text.isascii() else text.encode()
    assert (b"" if not parts else raw[: parts[0]["end"]] + b"".join(raw[a["end"] : b["end"]] for a, b in zip(parts, parts[1:]))) == raw
    once = X.canonical_text(text)
    assert len(once) <= X.MAX_CHARS and "\n" not in once


@given(st.lists(st.integers(-7, 7), max_size=40))
def test_nibbles_round_trip(codes):
    import numpy as np

    assert unpack_nibbles(pack_nibbles(np.array(codes, int)), len(codes)).tolist() == codes


@given(st.lists(st.tuples(st.floats(allow_nan=True, allow_infinity=True), st.floats(-5, 5)), max_size=40))
def test_isotonic_steps_rise(pairs):
    steps = E.fit_isotonic(pairs)
    assert all(a[0] < b[0] and a[1] <= b[1] + 1e-9 for a, b in zip(steps, steps[1:]))
    assert all(math.isfinite(s) for s, _ in steps)


@given(st.lists(st.lists(st.integers(0, 12), max_size=5, unique=True).map(sorted), min_size=1, max_size=4), st.integers(0, 5))
def test_slop_only_adds_matches(positions, slop):
    assert Q.sloppy_count(positions, slop) <= Q.sloppy_count(positions, slop + 1)
