"""Clustering on packed neighbours against the joins and plain Python, and what it stores."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import complement, graph, simjoin
from quire.operators import neighbours as nb


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def graph_of(spark, seed, n, share):
    """Wide ids, repeated and reversed edges, loops, ends that are no nodes, nodes without edges."""
    rng = random.Random(seed)
    name = [rng.choice([-1, 1]) * (i * 1_000_003 + (1 << 40)) for i in range(n)]
    edges = [(name[a], name[b], round(rng.uniform(-.5, 1), 3)) for a in range(n - 3) for b in range(a + 1, n - 3) if rng.random() < share]
    edges += edges[:3] + [(b, a, w) for a, b, w in edges[3:6]] + [(name[0], name[0], 1.0)]
    edges += [(name[1], name[2], float("nan")), (name[1], None, 1.0), (name[3], name[4], None)]
    return (spark.createDataFrame([(x,) for x in name + name[:2]], "id long"),
            spark.createDataFrame(edges, "src long, dst long, weight double").repartition(3))


def in_turn(ids, edges, seed):
    near = {i: set() for i in ids}
    for a, b, w in edges:
        if b is not None and a != b and w is not None and w >= 0:
            near[a].add(b)
            near[b].add(a)
    pivot = {}
    for p in sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i)):
        if p not in pivot:
            for i in {p} | near[p]:
                pivot.setdefault(i, p)
    low = {}
    for i, p in pivot.items():
        low[p] = min(i, low.get(p, i))
    return {i: low[p] for i, p in pivot.items()}


@pytest.mark.parametrize("seed,n,share", [(1, 700, .02), (3, 300, .9)])
def test_pivots_as_in_turn(spark, seed, n, share):
    nodes, edges = graph_of(spark, seed, n, share)
    got = rows(graph.pivot_clusters(nodes, edges, [0, 5]), "seed", "id", "cluster_id")
    ids, listed = {r[0] for r in nodes.collect()}, [tuple(r) for r in edges.collect()]
    assert got == sorted((s, i, c) for s in (0, 5) for i, c in in_turn(ids, listed, s).items())


def test_blocks_hold_every_neighbour_once_or_with_each_weight(spark):
    ids = np.arange(0, 2 * 700, 2)
    edges = spark.createDataFrame([(0, 2, .5), (2, 0, .25), (2, 1398, 1.0), (4, 3, 1.0)], "src long, dst long, weight double")
    for weighted, want in ((False, [(0, 1, None), (1, 0, None), (1, 699, None), (699, 1, None)]),
                           (True, [(0, 1, .25), (0, 1, .5), (1, 0, .25), (1, 0, .5), (1, 699, 1.0), (699, 1, 1.0)])):
        got = []
        for r in nb.neighbour_blocks(edges, ids, weighted).collect():
            b = nb.Block(r.asDict(), len(ids))
            got += zip(b.nodes().tolist(), b.other.tolist(), b.weight.tolist() if weighted else [None] * len(b.other))
        assert sorted(got, key=str) == sorted(want, key=str)


def test_edges_are_not_stored_as_a_table(spark):
    def stored():
        top = spark.sparkContext.getCheckpointDir().replace("file:", "")
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(top) for f in files)

    n = 800
    edges = spark.range(n * n).select((F.col("id") / n).cast("long").alias("src"), (F.col("id") % n).alias("dst")) \
        .where("src < dst and crc32(cast(src * 1000 + dst as string)) % 2 = 0").withColumn("weight", F.lit(0.5))
    before = stored()
    graph.correlation_clustering(spark.range(n), edges, [0, 1]).count()
    assert stored() - before < 8 * edges.count()


def test_near_pairs_in_one_direction(spark):
    rng = random.Random(4)
    near = [(i, j) for i in range(40) for j in range(i + 1, 40) if rng.random() < .9]
    one = spark.createDataFrame(near, "u long, v long")
    ids = np.arange(40)
    blocks = nb.neighbour_blocks(complement.both_ways(one, "u", "v").toDF("src", "dst"), ids)
    labels = [complement._components_by_blocks(ids, blocks), *complement._pivots_by_blocks(spark.range(40), ids, blocks, [0, 1])]
    loss = [sum((x[i] == x[j]) == ((i, j) in near) for i in range(40) for j in range(i + 1, 40)) for x in labels]
    assert complement._losses_by_blocks(blocks, np.stack(labels)) == loss
    got = rows(complement.correlation_clustering_far(spark.range(40), one, [0, 1]), "id", "cluster_id")
    assert got == list(enumerate(labels[loss.index(min(loss))].tolist()))


def test_a_callers_distance_moves_no_pairs(spark):
    rng = random.Random(5)
    make = lambda n: [(rng.randrange(n), [rng.randrange(9) / 8 for _ in range(3)]) for _ in range(n)]  # noqa: E731 - ids repeat
    q, d = make(60), make(40)
    got = simjoin.pair_distances(spark.createDataFrame(q, "ques_id long, vec array<double>"), spark.createDataFrame(d, "demo_id long, vec array<double>"),
                                 .5, simjoin.MANHATTAN)
    top = next(x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)
    assert "_k0" in top
    far = lambda a, b: sum(abs(x - y) for x, y in zip(a, b))
    want = {(i, j, far(a, b)) for i, a in q for j, b in d if far(a, b) <= .5}
    assert {(r[0], r[1], r[2]) for r in got.select("ques_id", "demo_id", "dist").collect()} >= want
    once = {(r["ques_id"], r["demo_id"]) for r in got.collect()}
    assert once == {(i, j) for i, j, _ in want}
