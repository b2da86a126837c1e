"""Tree and hashing joins, band counts and order statistics against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import bandcount, centretree, lsh, simjoin
from quire.operators.quantile import order_statistics


def frame(spark, x, name, start=0, odd=()):
    rows = [(start + i, [float(a) for a in v]) for i, v in enumerate(x)] + [(start + len(x) + i, v) for i, v in enumerate(odd)]
    return spark.createDataFrame(rows, f"{name} long, vec array<double>").repartition(3)


def clustered(n, dim=24, k=30, spread=0.03, seed=1):
    rng = np.random.default_rng(seed)
    c = np.random.default_rng(99).standard_normal((k, dim))       # the same clusters for every sample
    return c[rng.integers(0, k, n)] + spread * rng.standard_normal((n, dim))


def uniform(n, dim=24, seed=2):
    return np.random.default_rng(seed).standard_normal((n, dim))


def dist(metric, a, b):
    if metric == "euclid":
        return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return 1.0 - (sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0)


def brute(metric, left, right, r, self_join=False):
    rows_l, rows_r = ([(x[0], x[1]) for x in d.collect() if x[1] is not None] for d in (left, right))
    return {(i, j) for i, a in rows_l for j, b in rows_r if (not self_join or i < j) and dist(metric, a, b) <= r}


@pytest.mark.parametrize("metric,r", [("euclid", 0.5), ("euclid", 7.0), ("cosine", 0.01), ("cosine", 1.05)])
@pytest.mark.parametrize("make", [clustered, uniform])
def test_tree_join_is_exact(spark, metric, r, make):
    zero = [[0.0] * 24, None]
    left, right = frame(spark, make(60, seed=5), "a", odd=zero), frame(spark, make(150, seed=6), "b", 1000, odd=zero)
    got = [tuple(x) for x in simjoin.range_join(left, right, "a", "b", r, metric=metric, engine="tree", block_rows=20).select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(metric, left, right, r)


def test_tree_self_join_of_equal_vectors(spark):
    x = np.concatenate([np.ones((40, 16)), uniform(20, 16)])
    p = frame(spark, x, "a")
    got = [tuple(r) for r in simjoin.range_join(p, p.withColumnRenamed("a", "b"), "a", "b", 0.1, engine="tree", self_join=True, block_rows=7).select("a", "b").collect()]
    assert len(got) == 40 * 39 // 2 and set(got) == brute("euclid", p, p, 0.1, True)
    none = simjoin.range_join(p.limit(0), p.withColumnRenamed("a", "b"), "a", "b", 0.1, engine="tree")
    assert none.count() == 0 and simjoin.range_join(p, p.withColumnRenamed("a", "b").limit(0), "a", "b", 0.1, engine="tree").count() == 0


def test_the_tree_prunes_clusters_and_is_left_out_otherwise(spark):
    a, b = frame(spark, clustered(300, seed=5), "a"), frame(spark, clustered(1200, seed=6), "b")
    n = centretree.compared_pairs(a, b, "a", "b", 0.5).first()
    assert n["n_full"] == 300 * 1200 and n["n_compared"] < 0.1 * n["n_full"]
    assert centretree.build_tree(a, b, "a", "b", 0.5, "euclid") is not None
    u, v = frame(spark, uniform(300, 64), "a"), frame(spark, uniform(1200, 64, 7), "b")
    assert centretree.build_tree(u, v, "a", "b", 0.7, "cosine") is None
    same = {tuple(r) for r in simjoin.range_join(a, b, "a", "b", 0.5).select("a", "b").collect()}
    assert same == {tuple(r) for r in simjoin.range_join(a, b, "a", "b", 0.5, engine="block").select("a", "b").collect()} and same


def test_hashing_join_finds_nine_tenths(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("a"), F.col("embedding").cast("array<double>").alias("vec"))
    other = e.withColumnRenamed("a", "b")
    exact = {(r["a"], r["b"]): r["dist"] for r in simjoin.range_join(e, other, "a", "b", 0.55, metric="cosine", self_join=True).collect()}
    got = lsh.lsh_join(e, other, "a", "b", 0.55, self_join=True).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got})
    assert all(exact[r["a"], r["b"]] == r["dist"] for r in got)
    assert len(exact) > 100 and len(got) >= 0.9 * len(exact)
    # nearer pairs are compared for a small share of all pairs
    near = lsh.compared_pairs(e, other, 0.3, recall=0.9).first()["n_compared"]
    assert near < 0.25 * 2000 * 2000


def test_hashing_join_splits_a_hot_bucket(spark):
    x = np.concatenate([np.tile(np.arange(1.0, 33.0), (300, 1)), uniform(50, 32)])
    p = frame(spark, x, "a", odd=[[0.0] * 32, None])
    got = {tuple(r) for r in lsh.lsh_join(p, p.withColumnRenamed("a", "b"), "a", "b", 0.2, self_join=True, block_rows=40).select("a", "b").collect()}
    assert got == brute("cosine", p, p, 0.2, True) and len(got) >= 300 * 299 // 2
    two = {tuple(r) for r in lsh.lsh_join(p, p.withColumnRenamed("a", "b"), "a", "b", 0.2, self_join=True, hashes=2, probes=6).select("a", "b").collect()}
    assert two == got
    assert lsh.lsh_join(p.limit(0), p.withColumnRenamed("a", "b"), "a", "b", 0.2).count() == 0
    with pytest.raises(ValueError):
        lsh.lsh_join(p, p, "a", "a", 1.0)


def test_probes_replace_tables():
    assert lsh.tables_for(64, 0.4, 1, 8, 0.9) < lsh.tables_for(64, 0.4, 1, 1, 0.9)
    b = lsh.buckets(uniform(20, 16), 3, 2, 5)
    assert b.shape == (20, 15) and all(len(set(r)) == 15 for r in b.tolist())
    assert (lsh.buckets(uniform(20, 16), 3, 2, 1) == b.reshape(20, 3, 5)[:, :, 0]).all()


@pytest.mark.parametrize("radius", [0.0, 0.5, 3.0, 1e9])
def test_band_pairs(spark, radius):
    rng = np.random.default_rng(3)
    x, y = np.round(rng.uniform(0, 20, 150), 1).tolist(), np.round(rng.uniform(5, 25, 90), 1).tolist() + [7.0] * 60
    left = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "value double").repartition(5)
    right = spark.createDataFrame([(float(v),) for v in y] + [(None,)], "value double").repartition(4)
    want = sum(a - radius <= b <= a + radius for a in x for b in y)
    assert bandcount.band_pairs(left, right, radius).first()["n"] == want
    assert bandcount.band_pairs(left.limit(0), right, radius).first()["n"] == 0


def test_prune_counts(spark):
    q, d = uniform(60, 3), uniform(40, 3, 8)
    got = bandcount.prune_counts(frame(spark, q, "ques_id"), frame(spark, d, "demo_id"), 0.4, 0.2).first()
    dq, dd = np.linalg.norm(q - q[0], axis=1)[1:], np.linalg.norm(d - q[0], axis=1)
    own = sum(abs(dq[i] - dq[j]) <= 0.4 for i in range(59) for j in range(i + 1, 59))
    cross = int((np.abs(dq[:, None] - dd[None]) <= 0.2).sum())
    assert tuple(got) == (60 * 59 // 2, 59 + own, 60 * 40, 40 + cross)
    assert tuple(bandcount.prune_counts(frame(spark, q, "ques_id").limit(0), frame(spark, d, "demo_id"), 1, 1).first()) == (0, 0, 0, 0)


@pytest.mark.parametrize("metric", ["euclid", "cosine"])
def test_order_statistics(spark, metric):
    d = np.concatenate([np.round(uniform(150, 4), 1), np.tile([1.0, 0, 0, 0], (70, 1)), np.zeros((3, 4))])
    q = np.concatenate([np.round(uniform(15, 4, 4), 1), d[150:152], np.zeros((1, 4))])
    Q, D = frame(spark, q, "ques_id", odd=[None]), frame(spark, d, "demo_id", odd=[None])
    ranks = [1, 2, 60, 110, 223, 224]
    for parts, block in ((4, 50), (256, 16384)):
        got = {(r["ques_id"], r["rank"]): r["dist"] for r in order_statistics(Q, D, ranks, metric, parts=parts, demo_block=block).collect()}
        assert len(got) == 18 * 5
        for i, v in enumerate(q):
            want = sorted(dist(metric, v, w) for w in d)
            assert all(got[i, k] == pytest.approx(want[k - 1], abs=1e-12) for k in ranks[:-1])


def test_percentile_by_counting_equals_percentile_by_neighbours(spark):
    Q, D = frame(spark, uniform(25, 6), "ques_id"), frame(spark, uniform(120, 6, 9), "demo_id")
    for p in (0.0, 0.25, 0.9, 1.0):
        a, b = ({r["ques_id"]: r["pct"] for r in simjoin.dist_percentile(Q, D, p, "euclid", small_k=k).collect()} for k in (0, 1000))
        assert a == b and len(a) == 25
    one = D.limit(1)
    assert simjoin.dist_percentile(Q, one, 0.5, "euclid", small_k=0).count() == 25
