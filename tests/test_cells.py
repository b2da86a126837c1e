"""Similar and diverse clustering of dense regions against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import graph


def frame(spark, x, odd=()):
    rows = [(7 * i - 30, [float(a) for a in v]) for i, v in enumerate(x)] + [(100_000 + i, v) for i, v in enumerate(odd)]
    return spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)


def distance(metric, a, b):
    if metric == "euclid":
        return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))
    na, nb = math.hypot(*a), math.hypot(*b)
    return 1.0 - (sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0)


def components(rows, linked):
    label = {i: i for i, _ in rows}
    for i, _ in rows:
        if label[i] == i:
            todo = [(i, dict(rows)[i])]
            while todo:
                _, a = todo.pop()
                for j, b in rows:
                    if label[j] == j and j > i and linked(a, b):
                        label[j] = i
                        todo.append((j, b))
    return label


def points(seed, dim):
    """Tight groups of many sizes, some a little more than the radius apart, chains, equal points."""
    rng = np.random.default_rng(seed)
    c = rng.uniform(-2, 2, (6, dim))
    dense = np.concatenate([m + rng.uniform(-.25, .25, (20, dim)) / math.sqrt(dim) for m in c])
    line = c[0] + np.outer(np.arange(12) * .45, np.eye(dim)[0])
    return np.concatenate([dense, line, np.tile(c[1], (8, 1)), rng.uniform(-3, 3, (15, dim))])


@pytest.mark.parametrize("dim,metric,eps", [(2, "euclid", .5), (3, "euclid", .2), (2, "cosine", .002), (20, "euclid", .5), (20, "cosine", .05), (3, "euclid", 0.0), (2, "cosine", 1.2)])
def test_similar(spark, dim, metric, eps):
    df = frame(spark, points(dim, dim), odd=[[0.0] * dim, [0.0] * dim])
    rows = sorted((r["id"], r["vec"]) for r in df.collect())
    got = {r["id"]: r["cluster_id"] for r in graph.cluster_similar(df, eps, metric).collect()}
    assert got == components(rows, lambda a, b: distance(metric, a, b) <= eps)


def test_twenty_thousand_near_identical_points(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([np.full((20_000, 8), .5) + rng.uniform(-.01, .01, (20_000, 8)), np.full((30, 8), 5.0), [[.5] * 7 + [.8]], [[2.0] * 8]])
    df = frame(spark, x)
    cells = graph._cells(df, .4, "euclid").cache()
    edges = graph.similar_cell_edges(cells, .4, "euclid")
    n = cells.select("cell").distinct().count()
    assert edges.count() <= n * n
    sizes = sorted(r["count"] for r in graph.cluster_similar(df, .4, "euclid").groupBy("cluster_id").count().collect())
    assert sizes == [1, 30, 20_001]


def test_null_vectors_are_alone(spark):
    df = frame(spark, np.zeros((3, 2)), odd=[None, None])
    assert sorted(r["cluster_id"] for r in graph.cluster_similar(df, .1, "euclid").collect()) == [-30, -30, -30, 100_000, 100_001]
    assert graph.cluster_similar(df.limit(0), .1, "euclid").count() == 0


@pytest.mark.parametrize("seed,k0", [(1, .4), (2, .25), (3, .3), (4, .55), (5, .2)])
def test_diverse_where_most_pairs_are_far(spark, seed, k0):
    """Points on a sphere of radius 1.9 / k0 / 2: no two are 2 / k0 apart, and far pairs are not the few."""
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((9, 5))
    x = np.repeat(c, 14, axis=0) + .02 * rng.standard_normal((126, 5)) if seed % 2 else rng.standard_normal((90, 5))
    x = x / np.linalg.norm(x, axis=1)[:, None] * .95 / k0
    x = np.concatenate([x, np.zeros((2, 5)), .02 * rng.standard_normal((4, 5)), x[:3]])
    df = frame(spark, x)
    rows = sorted((r["id"], r["vec"]) for r in df.collect())

    def linked(a, b):
        d = distance("euclid", a, b)
        return (0.0 if d == 0 else 1.0 / d) <= k0

    got = {r["id"]: r["cluster_id"] for r in graph.cluster_diverse(df, k0).collect()}
    assert got == components(rows, linked)


def test_bounds_join_parts(spark):
    """Two tight opposite groups are joined by bounds alone; a point in the middle stays open."""
    rng = np.random.default_rng(0)
    x = np.concatenate([np.array([1.0, 0]) + .01 * rng.standard_normal((40, 2)), np.array([-1.0, 0]) + .01 * rng.standard_normal((40, 2)), [[0.0, 0.0]]])
    df = frame(spark, x)
    part = {r["id"]: r["cluster_id"] for r in graph._far_parts(df, 1.5, -30).collect()}
    assert len(set(part.values())) == 2 and part[80 * 7 - 30] == 80 * 7 - 30
    assert set(graph.cluster_diverse(df, 1 / 1.5).groupBy("cluster_id").agg(F.count("*").alias("n")).toPandas()["n"]) == {80, 1}
