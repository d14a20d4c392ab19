import numpy as np
import pytest

from sightline.operators import refine as R


@pytest.mark.parametrize("block", [7, 20, 20_000])
def test_hubness_takes_any_number_of_queries(spark, monkeypatch, block):
    monkeypatch.setattr(R, "HUBNESS_SAMPLE", block)
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(30, 8)), rng.normal(size=(20, 8))
    docs = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, None)], "doc_id bigint, embedding array<double>")
    sample = spark.createDataFrame([([float(v) for v in r],) for r in q] + [(None,)], "embedding array<double>")
    got = {r.doc_id: r.r for r in R.hubness(docs, sample, 3).collect()}
    assert got == {i: pytest.approx(np.sort(s)[-3:].mean()) for i, s in enumerate(x @ q.T)}
    assert R.hubness(docs, sample.limit(0), 3).count() == 0
