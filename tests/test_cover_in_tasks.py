"""Covers and balancing: clusters that one task passes over, against the rounds."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import assign, setcover


def _sorted(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def _edges():
    """Three clusters of sets that overlap; in the last one a set has two costs."""
    rng = random.Random(11)
    e = [(c, d, q) for c, nd, nq in ((1, 12, 40), (2, 30, 25), (3, 3, 5)) for d in range(nd) for q in rng.sample(range(nq), rng.randint(1, nq // 2))]
    sets = sorted({(c, d) for c, d, _ in e})
    return e, [(c, d, rng.randint(1, 6)) for c, d in sets] + [(3, 0, 2), (3, 0, 9)]


def _greedy(e, k, c):
    left, out = {q for x, _, q in e if x == c}, []
    cost = {d: min(w for x, y, w in k if (x, y) == (c, d)) for x, d, _ in e if x == c}
    while left:
        gain = {d: len(left & {q for x, y, q in e if (x, y) == (c, d)}) for d in cost}
        best = max(gain, key=lambda d: (gain[d] / cost[d], -d))
        out += [(c, best, gain[best] / w) for x, y, w in k if (x, y) == (c, best)]
        left -= {q for x, y, q in e if (x, y) == (c, best)}
    return out


def _balanced(e, c, order):
    sets = {d: {q for x, y, q in e if (x, y) == (c, d)} for d in order}
    most = len(set().union(*sets.values())) // len(sets)
    for k, d in enumerate(order):
        shared = sorted(q for q in sets[d] if any(q in sets[o] for o in order if o != d))
        drop = shared[:max(len(sets[d]) - most, 0)]
        if not k and not drop:
            break
        sets[d] -= set(drop)
    return sorted({q: (c, q, d) for d in order for q in sets[d]}.values())


def test_picks_of_the_sequential_rule(spark):
    e, k = _edges()
    got = setcover.set_cover(spark.createDataFrame(e, "cluster_id long, demo_id long, ques_id long"), spark.createDataFrame(k, "cluster_id long, demo_id long, set_cost int"))
    assert _sorted(got, "cluster_id", "demo_id", "score") == sorted(sum((_greedy(e, k, c) for c in (1, 2, 3)), []))


def test_a_larger_cluster_takes_rounds(spark, monkeypatch):
    e, k = ([r for r in x if r[0] == 3] + [(4, 1, 1)] for x in _edges())
    edges, costs = spark.createDataFrame(e, "cluster_id long, demo_id long, ques_id long"), spark.createDataFrame(k, "cluster_id long, demo_id long, set_cost int")
    monkeypatch.setattr(setcover, "TASK_EDGES", 1)
    monkeypatch.setattr(setcover, "HELD_ROUNDS", 1)
    picks = setcover.set_cover(edges, costs)
    assert _sorted(picks, "cluster_id", "demo_id", "score") == sorted(_greedy(e, k, 3) + _greedy(e, k, 4))


def test_owners_of_the_pass_in_pick_order(spark):
    e, _ = _edges()
    edges = spark.createDataFrame(e, "cluster_id long, demo_id long, ques_id long")
    picks = edges.select("cluster_id", "demo_id").distinct().withColumn("pick_no", -F.col("demo_id"))
    want = sorted(sum((_balanced(e, c, sorted({d for x, d, _ in e if x == c}, reverse=True)) for c in (1, 2, 3)), []))
    assert _sorted(assign.assign_balanced(picks, edges), "cluster_id", "ques_id", "demo_id") == want
    scored = picks.withColumn("score", -F.col("demo_id").cast("double") / 2).drop("pick_no")
    want = sorted(sum((_balanced(e, c, sorted({d for x, d, _ in e if x == c})) for c in (1, 2, 3)), []))
    assert _sorted(assign.assign_balanced(scored, edges), "cluster_id", "ques_id", "demo_id") == want


def test_overlapping_sets_take_no_rounds(spark, monkeypatch):
    """Every two sets share a question, so that rounds would come to one a pick."""
    n = 60
    e = [(7, d, min(a, b) * n + max(a, b)) for d in range(n) for a, b in ((d, x) for x in range(n)) if a != b]
    edges = spark.createDataFrame(e, "cluster_id long, demo_id long, ques_id long")
    costs = spark.createDataFrame([(7, d, 1 + d) for d in range(n)], "cluster_id long, demo_id long, set_cost int")
    monkeypatch.setattr(setcover, "_cover_in_rounds", None)
    monkeypatch.setattr(assign, "_balanced_in_rounds", None)
    picks = setcover.set_cover(edges, costs)
    assert [r["demo_id"] for r in picks.orderBy("round").collect()] == list(range(n - 1))
    assert assign.assign_balanced(picks, edges).count() == n * (n - 1) // 2


def test_packed_group_names(spark):
    """Groups are named by strings; a set without a cost is an error as before."""
    edges = spark.createDataFrame([("a-0", 1, 5), ("a-0", 2, 5), ("b-0", 2, 6)], "group_id string, demo_id long, ques_id long")
    costs = spark.createDataFrame([("a-0", 1, 3), ("a-0", 2, 2), ("b-0", 2, 2)], "group_id string, demo_id long, set_cost int")
    assert _sorted(setcover.set_cover(edges, costs, key="group_id"), "group_id", "demo_id", "score", "round") == [("a-0", 2, 0.5, 1), ("b-0", 2, 0.5, 1)]
    with pytest.raises(ValueError):
        setcover.set_cover(edges, costs.where("demo_id = 1"), key="group_id")
