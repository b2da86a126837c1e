"""Sets of near questions a group, and nearest neighbours of dense vectors, from the blocks themselves."""

import numpy as np
from pyspark.sql import functions as F

from quire.operators import blockpairs, simjoin


def _tables(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((140, 32))
    x[3] = x[4] = 0.0
    x[20] = x[60]
    q = [(i, x[i].tolist()) for i in range(100)] + [(7, x[8].tolist()), (None, x[9].tolist()), (50, None)]
    d = [(i, x[i].tolist()) for i in range(60, 140)] + [(61, x[90].tolist()), (None, x[91].tolist()), (None, x[92].tolist())]
    g = [(i // 9 if i < 90 else None, i) for i in range(100)] + [(2, 1), (2, 1), (99, 500)]
    return (spark.createDataFrame(q, "ques_id long, vec array<double>"), spark.createDataFrame(d, "demo_id long, vec array<double>"),
            spark.createDataFrame(g, "group_id long, ques_id long"))


def _rows(df):
    return sorted(((r["group_id"], r["demo_id"], list(r["ques"])) for r in df.collect()), key=str)


def test_group_sets_equal_those_of_the_pairs(spark, monkeypatch):
    q, d, g = _tables(spark)
    for most in (512, 8):
        monkeypatch.setattr(simjoin, "SET_ROWS", most)
        for metric, radius in (("cosine", 0.95), ("euclid", 7.5)):
            want = _rows(simjoin.group_coverage(simjoin.pair_distances(q, d, radius, metric), g))
            assert want and _rows(simjoin.group_coverage_within(q, d, g, radius, metric)) == want


def test_group_sets_move_no_pairs(spark, monkeypatch):
    q, d, g = _tables(spark)
    d = d.where("demo_id is not null").dropDuplicates(["demo_id"])
    made = []
    plain = simjoin.pair_distances
    monkeypatch.setattr(simjoin, "pair_distances", lambda *a, **k: made.append(1) or plain(*a, **k))
    assert simjoin.group_coverage_within(q, d, g, 0.95, "cosine").count() and not made


def test_knn_of_dense_vectors_keeps_k_a_block(spark, monkeypatch):
    q, d, _ = _tables(spark)
    seen = []
    plain = blockpairs.block_pairs_join
    monkeypatch.setattr(simjoin, "block_pairs_join", lambda *a, **k: seen.append(k.get("nearest")) or plain(*a, **k))
    monkeypatch.setattr(blockpairs, "CHUNK", 4)
    got = {}
    for r in simjoin.knn_join(q, d, "ques_id", "demo_id", 3, metric="cosine").where(F.col("ques_id").isNotNull() & (F.col("ques_id") != 7)).collect():
        got.setdefault(r["ques_id"], []).append((r["rank"], r["demo_id"], round(r["dist"], 9)))
    assert seen == [3]
    vecs = [(r["demo_id"], np.array(r["vec"])) for r in d.collect()]
    for r in q.where("ques_id is not null and ques_id != 7 and vec is not null").collect():
        v = np.array(r["vec"])
        dist = []
        for i, y in vecs:
            norm = np.linalg.norm(v) * np.linalg.norm(y)
            dist.append((round(1.0 - (v @ y / norm if norm else 0.0), 9), -1 if i is None else i))
        want = [(k + 1, None if i < 0 else i, x) for k, (x, i) in enumerate(sorted(dist)[:3])]
        assert sorted(got[r["ques_id"]]) == want
