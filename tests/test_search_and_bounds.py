"""Local search, lower bound, containment of large sets and a caller's distance against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import coverage, graph, simjoin
from quire.plans import reports


def refine(n, edges, label):
    """The same rule, one round at a time."""
    near = {i: {} for i in range(n)}
    for a, b, w in edges:
        near[a][b] = near[b][a] = w
    while True:
        wish = {}
        for u in range(n):
            pull = {}
            for v, w in near[u].items():
                pull[label[v]] = pull.get(label[v], 0.0) + w
            stay = round(pull.pop(label[u], 0.0), 9)
            best = max([(round(s, 9), -c) for c, s in pull.items() if round(s, 9) > 0], default=None)
            gain = round((best[0] if best else 0.0) - stay, 9)
            if gain > 0:
                wish[u] = (gain, ("old", -best[1]) if best else ("new", u))
        if not wish:
            return label
        name = {i: ("old", label[i]) for i in range(n)}
        for u, (gain, to) in wish.items():
            if all((wish[v][0], -v) < (gain, -u) for v in near[u] if v in wish):
                name[u] = to
        label = {i: min(j for j in range(n) if name[j] == name[i]) for i in range(n)}


def loss(edges, label):
    return sum(w if w > 0 and label[a] != label[b] else -w if w < 0 and label[a] == label[b] else 0 for a, b, w in edges)


@pytest.mark.parametrize("seed", [1, 2])
def test_local_search(spark, seed):
    rng = random.Random(seed)
    n = 24
    edges = [(a, b, round(rng.uniform(-1, 1), 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < .25]
    edges = [e for e in edges if e[2]]
    first = {i: i // 4 * 4 for i in range(n)}
    lab = spark.createDataFrame(list(first.items()), "id long, cluster_id long")
    e = spark.createDataFrame(edges + [(0, 5, float("nan"))], "src long, dst long, weight double")
    got = {r["id"]: r["cluster_id"] for r in graph.refine_clusters(lab, e).collect()}
    want = refine(n, edges, first)
    assert got == want and loss(edges, want) < loss(edges, first)
    none = spark.createDataFrame([], "src long, dst long, weight double")
    assert {r["id"]: r["cluster_id"] for r in graph.refine_clusters(lab, none).collect()} == first


def cheapest(sets, cost):
    """Least cost of sets that cover all, by trying every choice."""
    every = set().union(*sets.values())
    names = sorted(sets)
    return min(sum(cost[d] for k, d in enumerate(names) if m >> k & 1) for m in range(1 << len(names))
               if set().union(*[sets[d] for k, d in enumerate(names) if m >> k & 1]) == every)


def test_lower_bound(spark):
    rng = random.Random(5)
    for size in (1, 6, 9):
        sets = {d: set(rng.sample(range(12), rng.randint(1, 5))) for d in range(size)}
        cost = {d: rng.randint(1, 9) for d in sets}
        cover = spark.createDataFrame([(q, d) for d in sets for q in sets[d]] * 2, "ques_id long, demo_id long")
        demos = spark.createDataFrame(list(cost.items()) + [(99, 1)], "demo_id long, cost int")
        bounds = [reports.cover_lower_bound(cover, demos, rounds).first()["bound"] for rounds in (1, 8)]
        best = cheapest(sets, cost)
        assert 0 < bounds[0] <= bounds[1] + 1e-6 and bounds[1] <= best + 1e-6
        assert bounds[1] >= best / 5                        # a question is in few sets, a set holds at most five
    assert reports.cover_lower_bound(cover.limit(0), demos).first()["bound"] == 0


def test_containment_of_large_sets(spark):
    """Popular questions, equal sets, chains of supersets: any size bound and list bound gives the same."""
    rng = random.Random(3)
    sets = {}
    for d in range(70):
        sets[d] = set(range(6)) | set(rng.sample(range(6, 14), rng.randint(0, 5)))    # six questions that all hold
    sets |= {100 + d: set(range(d % 9 + 1)) for d in range(20)} | {200: set(range(14)), 201: set(range(14)), 202: {13}}
    cost = {d: rng.randint(1, 4) for d in sets}
    cc = spark.createDataFrame([(d % 2, d, q) for d in sets for q in sets[d]], "cluster_id long, demo_id long, ques_id long").repartition(4)
    cost_df = spark.createDataFrame(list(cost.items()), "demo_id long, cost int")
    for symmetric in (False, True):
        want = {(i % 2, i) for i in sets for j in sets if i % 2 == j % 2 and (j != i if symmetric else j > i) and cost[j] <= cost[i] and sets[i] <= sets[j]}
        for small, hot in ((1, 3), (0, 10_000), (7, 5)):
            got = coverage.dominated_demos(cc, cost_df, symmetric, max_subset_size=small, hot=hot)
            assert {(r["cluster_id"], r["demo_id"]) for r in got.collect()} == want


def test_callers_distance(spark):
    rng = random.Random(2)
    x = [(i, [round(rng.random(), 2) for _ in range(3)]) for i in range(80)] + [(80, None)]
    q, d = spark.createDataFrame(x[:50], "ques_id long, vec array<double>"), spark.createDataFrame(x[40:], "demo_id long, vec array<double>")
    l1 = lambda a, b: sum(abs(s - t) for s, t in zip(a, b))
    want = {(i, j) for i, a in x[:50] for j, b in x[40:] if b is not None and l1(a, b) <= .4}
    unbounded = simjoin.Metric("l1", simjoin.MANHATTAN.distance)
    for metric in (simjoin.MANHATTAN, unbounded):
        got = simjoin.pair_distances(q, d, .4, metric).collect()
        assert {(r["ques_id"], r["demo_id"]) for r in got} == want and len(got) == len(want)
    whole = simjoin.range_join(q, q.withColumnRenamed("ques_id", "b"), "ques_id", "b", .4, metric=unbounded, self_join=True, block_rows=9)
    assert whole.count() == sum(l1(a, b) <= .4 for i, a in x[:50] for j, b in x[:50] if i < j)


def test_diverse_under_a_callers_distance(spark):
    rng = random.Random(9)
    x = [(i, [rng.random(), rng.random()]) for i in range(30)] + [(30, [0.5, 0.5]), (31, [0.5, 0.5])]
    l1 = lambda a, b: sum(abs(s - t) for s, t in zip(a, b))
    for k0 in (1.1, 0.8):
        label = {i: i for i, _ in x}
        for _ in x:
            for i, a in x:
                for j, b in x:
                    if l1(a, b) == 0 or 1 / l1(a, b) <= k0:
                        label[i] = label[j] = min(label[i], label[j])
        points = spark.createDataFrame(x, "id long, vec array<double>")
        got = {r["id"]: r["cluster_id"] for r in graph.cluster_diverse(points, k0, metric=simjoin.MANHATTAN).collect()}
        assert got == label


def test_code_plan_leaves_small_clusters_out(spark):
    from quire import catalog
    from quire.plans import grouping
    from quire.sources import fixtures as fx
    sf = "/root/testdata/sf0.001"
    q, d = fx.vec_costs(fx.vec_questions(spark, sf), "ques_id"), fx.vec_costs(fx.vec_demos(spark, sf), "demo_id")
    plan = grouping.plan_groups(q, d, catalog.CODE_CFG, render_prompts=False)
    small = {r["ques_id"] for r in plan.unasked.where("reason = 'small_cluster'").collect()}
    asked = {r["ques_id"] for r in plan.groups.select(F.explode("ques").alias("ques_id")).collect()}
    sizes = graph.cluster_similar(q.select(F.col("ques_id").alias("id"), "vec"), catalog.CODE_CFG.k0, "euclid").groupBy("cluster_id").agg(F.collect_list("id").alias("ids")).collect()
    assert small == {i for r in sizes if len(r["ids"]) <= 2 for i in r["ids"]} and not small & asked and asked
