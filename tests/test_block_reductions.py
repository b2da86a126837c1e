"""Blocks of dense vectors give a task's nearest pairs, counts or links instead of all its pairs."""

import numpy as np
import pytest

from quire.operators import blockpairs, graph, simjoin
from quire.operators.blockpairs import block_pairs_join


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(blockpairs, "LEAST_ROWS", 64)


def _vectors(n, seed, dim=16):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    x[n // 2:n // 2 + 5] = x[:5]                               # equal vectors tie
    x[n - 1] = 0.0
    return x


def _table(spark, x, name, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], f"{name} long, vec array<double>")


def _dist(a, b, metric):
    n = [np.sqrt(np.cumsum(x * x, axis=1)[:, -1]) for x in (a, b)]          # left to right
    return blockpairs.exact_distances(metric, np.repeat(a, len(b), 0).T, np.repeat(n[0], len(b)), np.tile(b, (len(a), 1)).T,
                                      np.tile(n[1], len(a))).reshape(len(a), len(b))


def _components(n, near):
    parent = list(range(n))
    for i, j in zip(*np.nonzero(near)):
        a, b = sorted((parent[i], parent[j]))
        parent = [a if x == b else x for x in parent]
    return dict(enumerate(parent))


@pytest.mark.parametrize("metric,radius", [("cosine", 0.8), ("euclid", 4.5)])
def test_nearest_and_counts(spark, metric, radius):
    q, d = _vectors(400, 1), _vectors(150, 2)
    d[:5] = q[:5]
    Q, D, x = _table(spark, q, "ques_id"), _table(spark, d, "demo_id"), _dist(d, q, metric)
    want = {(i, int(j), x[i, j]) for i in range(len(d)) for j in np.lexsort((np.arange(len(q)), x[i]))[:3] if x[i, j] <= radius}
    pairs = simjoin.pair_distances(Q, D, radius, metric, nearest=3)
    assert 3 * len(d) < (x <= radius).sum() and pairs.count() < (x <= radius).sum() // 2
    cover = simjoin.knn_cover(Q, D, radius, 3, metric, dedup=False)
    assert {(r["demo_id"], r["ques_id"], r["dist"]) for r in cover.collect()} == want
    n = {r["ques_id"]: r["n"] for r in simjoin.pair_counts(Q, D, radius, metric).collect()}
    assert n == {j: int(c) for j, c in enumerate((x <= radius).sum(axis=0)) if c}


@pytest.mark.parametrize("metric,radius", [("cosine", 0.4), ("euclid", 3.2)])
def test_links_join_what_pairs_join(spark, metric, radius):
    v = _vectors(500, 3)
    x = _dist(v, v, metric)
    near = np.triu(x <= radius, 1)
    V = _table(spark, v, "id")
    links = block_pairs_join(V, V, "id", "id", radius, metric, "vec", True, False, 16, links=True)
    assert 0 < links.count() < near.sum()
    want = _components(len(v), near)
    assert 20 < len(set(want.values())) < 480
    assert {r["id"]: r["cluster_id"] for r in graph.cluster_similar(V, radius, metric).collect()} == want


def test_far_links(spark):
    v = _vectors(300, 4)[:299]
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    x = _dist(v, v, "euclid")
    k0 = 0.57
    far = np.triu((x == 0) | (1.0 / np.where(x == 0, 1.0, x) <= k0), 1)
    want = _components(len(v), far)
    assert 1 < len(set(want.values())) < 299
    assert {r["id"]: r["cluster_id"] for r in graph.cluster_diverse(_table(spark, v, "id"), k0).collect()} == want
