"""Joins of dense vectors by pairs of blocks, edges contracted where they are read, labels beside edges."""

import numpy as np
import pytest

from quire.operators import blockpairs, centretree, graph, simjoin


def _vectors(spark, n, seed, dim=20):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[1] = 0
    x[3] = x[2]
    rows = [(i * 2 - 5, v.tolist()) for i, v in enumerate(x)]
    return rows, spark.createDataFrame([*rows, (9999, None)], "id long, vec array<double>").repartition(3)


@pytest.mark.parametrize("metric,radius", [("cosine", 0.8), ("cosine", 1.05), ("euclid", 5.5)])
def test_every_close_pair_once(spark, monkeypatch, metric, radius):
    monkeypatch.setattr(blockpairs, "LEAST_ROWS", 7)
    rows, df = _vectors(spark, 60, 3)
    right = df.withColumnRenamed("id", "id2")
    x, n = np.array([v for _, v in rows]), np.array([np.sqrt(np.cumsum(v2)[-1]) for v2 in (np.array(v) ** 2 for _, v in rows)])
    d = simjoin.block_distances(metric, x, n, x, n)
    want = {(rows[i][0], rows[j][0]): d[i, j] for i in range(60) for j in range(60) if d[i, j] <= radius}
    join = lambda **kw: blockpairs.block_pairs_join(df, right, "id", "id2", radius, metric, "vec", strict=False, min_dim=16, **kw)
    got = [tuple(r) for r in join(self_join=False).collect()]
    assert len(got) == len(want) and {(a, b): c for a, b, c in got} == want          # the same bits
    got = [tuple(r) for r in join(self_join=True).collect()]
    assert len(got) == len({x[:2] for x in got}) and {(a, b): c for a, b, c in got} == {k: v for k, v in want.items() if k[0] < k[1]}
    assert blockpairs.block_pairs_join(df.limit(0), right, "id", "id2", radius, metric, "vec", False, False, 16) is None


def test_dense_joins_move_a_vector_once_a_block(spark):
    """Before: a copy for each of nine neighbour cells, both triangles of a self join."""
    _, df = _vectors(spark, 80, 4)
    plan = simjoin.range_join(df, df.withColumnRenamed("id", "id2"), "id", "id2", 0.9, metric="cosine", self_join=True) \
        ._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow compare" in plan and "FlatMapCoGroups" not in plan


def test_components_of_contracted_edges(spark, monkeypatch):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(i + 1, i) for i in range(500, 560)] + [(None, 3), (7, 7)]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    stars = graph.star_edges(df)
    assert stars.count() <= 3 * 460 and "MapInArrow contract" in stars._jdf.queryExecution().optimizedPlan().toString()
    touched = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert {x for r in stars.collect() for x in r} == touched
    label = list(range(600))
    for _ in label:
        before = list(label)
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    got = {r["id"]: r["cluster_id"] for r in graph.connected_components(spark.range(600), df).collect()}
    assert got == dict(enumerate(label))
    repeated = [graph._contract(np.array([5, 9, 5]), np.array([9, 5, 1]))]
    assert [tuple(map(list, x)) for x in repeated] == [([5, 9], [1, 1])]


def test_losses_leave_edges_in_place(spark):
    edges = spark.range(50).selectExpr("id AS src", "id + 1 AS dst", "0.5 - id % 3 AS weight")
    labels = spark.range(60).selectExpr("id", "id div 2 AS cluster_id")
    out = graph.loss_linear(edges, labels)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    weight = lambda i: 0.5 - i % 3
    want = sum(weight(i) if weight(i) >= 0 and i // 2 != (i + 1) // 2 else -weight(i) if weight(i) < 0 and i // 2 == (i + 1) // 2 else 0 for i in range(50))
    assert out.first()["loss"] == pytest.approx(want)


def test_tree_sends_few_copies_where_it_does_not_prune(spark):
    """Before: a copy for each reached leaf, up to 1,024."""
    rows, df = _vectors(spark, 600, 5)
    right = df.withColumnRenamed("id", "id2")
    tree = centretree.build_tree(df, right, "id", "id2", 1.1, "cosine", always=True)
    lx, _ = centretree._sides(tree, df, right, "id", "id2", 1.1, "vec", centretree.COARSE)
    assert lx.groupBy("_lid").count().agg({"count": "max"}).first()[0] <= centretree.COARSE + 1
    key = lambda d: sorted((r["id"], r["id2"], r["dist"]) for r in d.collect())
    assert key(simjoin.range_join(df, right, "id", "id2", 1.1, metric="cosine", engine="tree")) == \
        key(simjoin.range_join(df, right, "id", "id2", 1.1, metric="cosine", engine="auto"))
