"""Order statistics by products of packed vectors, against sorted exact distances and against counting."""

import numpy as np
import pytest

from quire.operators import quantile
from quire.operators.simjoin import block_distances


@pytest.mark.parametrize("metric", ["cosine", "euclid"])
def test_ranks_by_products(metric):
    rng = np.random.default_rng(1)
    L, R = rng.standard_normal((40, 24)), rng.standard_normal((900, 24)).astype(np.float32)
    R[:300], R[300], L[3], L[5] = R[600:], 0, 0, R[9]                   # ties, zero vectors, an equal one
    ln, rn = np.sqrt((L * L).sum(1)), np.sqrt((R.astype(float) ** 2).sum(1))
    want = np.sort(block_distances(metric, L, ln, R.astype(float), rn), axis=1)
    ranks = [1, 2, 225, 226, 227, 600, 900]
    for r, (i, d) in zip(ranks, quantile._smallest(metric, L, ln, R, rn, ranks, quantile._side(metric, R, rn)), strict=True):
        assert (i == np.arange(40)).all() and (d == want[:, r - 1]).all()


def test_products_and_counts_agree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vec = [[float(x) for x in v] for v in rng.standard_normal((60, 16)).astype(np.float32)]
    Q = spark.createDataFrame([(i, v) for i, v in enumerate(vec[:12])] + [(3, vec[3]), (None, vec[4]), (50, None)], "ques_id long, vec array<double>").repartition(3)
    D = spark.createDataFrame([(i, v) for i, v in enumerate(vec[12:])] + [(90, None)], "demo_id long, vec array<double>").repartition(2)
    rows = lambda: sorted(tuple(r) for r in quantile.order_statistics(Q, D, [12, 13], "cosine").collect())
    called = []
    counts = quantile._by_counts
    monkeypatch.setattr(quantile, "_by_counts", lambda q, *a: called.append(q.count()) or counts(q, *a))
    got = rows()
    assert called == [2] and len({r[0] for r in got}) == 12             # only the repeated id is counted
    monkeypatch.setattr(quantile, "HELD_VALUES", 0)
    assert rows() == got and called == [2, 15 - 1]
