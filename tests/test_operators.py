"""Property tests of the iterative operators against plain-Python references."""

import random

import pytest

from pyspark.sql import functions as F

from quire.operators import assign, graph, packing, setcover, simjoin


def ranked_cover(sets, costs):
    """The rule by definition: rank all sets anew for each pick (new elements per cost, then id)."""
    left, order = set().union(*sets.values()), []
    while left:
        ratio, pick = min((-len(s & left) / costs[d], d) for d, s in sets.items())
        if not ratio:
            return []
        order.append(pick)
        left = left - sets[pick]
    return order


def _instances(seed, n_inst=12):
    rng = random.Random(seed)
    out = []
    for c in range(n_inst):
        n_q = rng.randint(1, 12)
        n_d = rng.randint(1, 8)
        sets = {}
        for d in range(n_d):
            sets[d] = {q for q in range(n_q) if rng.random() < 0.35}
        for q in range(n_q):  # keep it coverable
            if not any(q in s for s in sets.values()):
                sets[rng.randrange(n_d)].add(q)
        costs = {d: rng.randint(1, 6) + len(s) for d, s in sets.items()}
        out.append((c, sets, costs))
    return out


def test_set_cover_equals_sequential(spark):
    inst = _instances(3)
    edges = [(c, d, q) for c, sets, _ in inst for d, s in sets.items() for q in s]
    costs = [(c, d, cost) for c, _, cs in inst for d, cost in cs.items()]
    e = spark.createDataFrame(edges, "cluster_id long, demo_id long, ques_id long")
    k = spark.createDataFrame(costs, "cluster_id long, demo_id long, set_cost long")
    picks = setcover.with_pick_no(setcover.set_cover(e, k)).collect()
    got = {}
    for r in picks:
        got.setdefault(r["cluster_id"], []).append((r["pick_no"], r["demo_id"]))
    for c, sets, cs in inst:
        ids = sorted(sets)
        want = ranked_cover({d: sets[d] for d in ids}, cs)
        assert [d for _, d in sorted(got.get(c, []))] == want


def test_set_cover_uncoverable_universe(spark):
    e = spark.createDataFrame([(0, 1, 10), (0, 2, 11)], "cluster_id long, demo_id long, ques_id long")
    k = spark.createDataFrame([(0, 1, 3), (0, 2, 3)], "cluster_id long, demo_id long, set_cost long")
    u = spark.createDataFrame([(0, 10), (0, 11), (0, 12)], "cluster_id long, ques_id long")
    assert setcover.set_cover(e, k, universe=u).count() == 0


def test_assignment_is_partition(spark):
    inst = _instances(9)
    edges = [(c, d, q) for c, sets, _ in inst for d, s in sets.items() for q in s]
    costs = [(c, d, cost) for c, _, cs in inst for d, cost in cs.items()]
    e = spark.createDataFrame(edges, "cluster_id long, demo_id long, ques_id long")
    k = spark.createDataFrame(costs, "cluster_id long, demo_id long, set_cost long")
    picks = setcover.set_cover(e, k)
    for fn in (assign.assign_last, assign.assign_balanced):
        a = fn(picks, e).collect()
        owners = {(r["cluster_id"], r["ques_id"]): r["demo_id"] for r in a}
        assert len(owners) == len(a)
        universe = {(c, q) for c, d, q in edges}
        assert set(owners) == universe
        picked = {(r["cluster_id"], r["demo_id"]) for r in picks.collect()}
        for (c, q), d in owners.items():
            assert (c, d) in picked and (c, d, q) in set(edges)


def best_fit_decreasing(ids, weights, capacity):
    """Bin number per item, one item after the other."""
    loads, out = [], {}
    for w, i in sorted(zip([-w for w in weights], ids)):
        fits = [b for b, load in enumerate(loads) if load - w <= capacity]
        if fits:
            b = max(fits, key=lambda b: (loads[b], -b))
        else:
            b = len(loads)
            loads.append(0)
        loads[b] -= w
        out[i] = b
    return [out[i] for i in ids]


def test_balanced_assignment_is_the_pass_in_pick_order(spark):
    sets = {1: [1, 2, 6, 7], 2: [5], 3: [1, 5, 8, 9, 10]}
    e = spark.createDataFrame([(0, d, q) for d, qs in sets.items() for q in qs], "cluster_id long, demo_id long, ques_id long")
    p = spark.createDataFrame([(0, d, d) for d in sets], "cluster_id long, demo_id long, pick_no long")
    got = {}
    for r in assign.assign_balanced(p, e).collect():
        got.setdefault(r["demo_id"], set()).add(r["ques_id"])
    assert got == {1: {2, 6, 7}, 2: {5}, 3: {1, 8, 9, 10}}

    rng = random.Random(5)
    cover = {c: [sorted(rng.sample(range(14), rng.randint(1, 8))) for _ in range(rng.randint(1, 7))] for c in range(25)}
    rows = [(c, d, q) for c, ss in cover.items() for d, qs in enumerate(ss) for q in qs]
    e = spark.createDataFrame(rows, "cluster_id long, demo_id long, ques_id long")
    p = spark.createDataFrame(sorted({(c, d, d) for c, d, _ in rows}), "cluster_id long, demo_id long, pick_no long")
    want = {}
    for c, ss in cover.items():
        left = [set(x) for x in ss]
        avg = len(set().union(*left)) // len(left)
        for at, s in enumerate(left):
            free = [q for q in sorted(s) if sum(q in t for t in left) > 1][:max(len(s) - avg, 0)]
            s -= set(free)
            if at == 0 and not free:
                break
        for d, s in enumerate(left):
            want |= {(c, q): d for q in s}
    assert {(r["cluster_id"], r["ques_id"]): r["demo_id"] for r in assign.assign_balanced(p, e).collect()} == want


def test_correlation_of_the_full_signed_graph(spark):
    # a chain is one component, but its ends repel: the pieces lose less
    n = 12
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n - 1)], "src long, dst long, weight double")
    nodes = spark.range(n).select("id")
    lab = {r["id"]: r["cluster_id"] for r in graph.correlation_clustering(nodes, edges, [0, 1, 2], absent_weight=-1.0).collect()}
    assert len(set(lab.values())) > 1

    def loss(x):
        return sum((abs(i - j) == 1) != (x[i] == x[j]) for i in range(n) for j in range(i))
    runs = {}
    for r in graph.pivot_clusters(nodes, edges, [0, 1, 2]).collect():
        runs.setdefault(r["seed"], {})[r["id"]] = r["cluster_id"]
    assert loss(lab) <= min([loss(x) for x in runs.values()] + [loss([0] * n)])
    one = {r["cluster_id"] for r in graph.correlation_clustering(nodes, edges, [0, 1, 2]).collect()}
    assert one == {0}


def test_packing_rule_and_budget(spark):
    rng = random.Random(1)
    items = [(0, i, rng.choice([5, 10, 10, 20, 35, 70])) for i in range(60)]
    df = spark.createDataFrame(items, "cluster_id long, demo_id long, weight long")
    got = {r["demo_id"]: r["bin_no"] for r in packing.pack_groups(df, 50.0).collect()}
    want = best_fit_decreasing([i for _, i, _ in items], [w for _, _, w in items], 50.0)
    assert [got[i] for _, i, _ in items] == want
    loads = {}
    for _, i, w in items:
        loads.setdefault(got[i], []).append(w)
    for ws in loads.values():
        assert sum(ws) <= 50 or len(ws) == 1


def test_packing_is_the_sequential_rule_at_any_size(spark):
    rng = random.Random(2)
    items = [(c, i, rng.randint(0, 130) if c else rng.choice([7, 11, 30])) for c in range(3) for i in range(2000)]
    df = spark.createDataFrame(items, "cluster_id long, demo_id long, weight long")
    got = {(r["cluster_id"], r["demo_id"]): r["bin_no"] for r in packing.pack_groups(df.repartition(7), 100.0).collect()}
    for c in range(3):
        mine = [(i, w) for k, i, w in items if k == c]
        want = best_fit_decreasing([i for i, _ in mine], [w for _, w in mine], 100)
        assert [got[(c, i)] for i, _ in mine] == want


def _union_find(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    comp = {}
    for i in range(n):
        comp.setdefault(find(i), []).append(i)
    return {i: min(m) for m in comp.values() for i in m}


def test_components_match_union_find(spark):
    rng = random.Random(11)
    n = 200
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(150)] + [(i, i + 1) for i in range(50, 90)]
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    e = spark.createDataFrame(edges, "src long, dst long")
    got = {r["id"]: r["cluster_id"] for r in graph.connected_components(nodes, e).collect()}
    assert got == _union_find(n, edges)


def _seq_pivot(n, edges, prio):
    adj = {i: set() for i in range(n)}
    for a, b in edges:
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    left = set(range(n))
    lab = {}
    for v in sorted(range(n), key=prio):
        if v in left:
            members = {v} | (adj[v] & left)
            for m in members:
                lab[m] = min(members)
            left -= members
    return lab


def test_pivot_matches_sequential(spark):
    import hashlib
    rng = random.Random(2)
    n = 60
    edges = list({(min(a, b), max(a, b)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(120))
                  if a != b})
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    e = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, weight double")
    got = graph.pivot_clusters(nodes, e, [4]).collect()
    prio = {i: (hashlib.md5(f"4:{i}".encode()).hexdigest(), i) for i in range(n)}
    want = _seq_pivot(n, edges, lambda v: prio[v])
    assert {r["id"]: r["cluster_id"] for r in got} == want


def test_diverse_one_component_and_identical(spark):
    pts = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [3.0, 0.0]), (4, [1.0, 1.0])],
                                "id long, vec array<double>")
    # k0 = 1 -> far means d >= 1; points 1/3 are 3 apart (>= 2): one component
    got = {r["id"]: r["cluster_id"] for r in graph.cluster_diverse(pts, 1.0).collect()}
    assert set(got.values()) == {1}
    # all within 1/k0 of each other: only identical vectors group
    got = {r["id"]: r["cluster_id"] for r in graph.cluster_diverse(pts, 0.1).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_range_join_matches_brute_force(spark):
    rng = random.Random(4)
    vecs = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(120)]
    df = spark.createDataFrame(vecs, "id long, vec array<double>")
    for metric, radius in (("euclid", 2.0), ("cosine", 0.4)):
        got = {(r["id"], r["id2"]) for r in simjoin.range_join(
            df, df.withColumnRenamed("id", "id2"), "id", "id2", radius, metric=metric, self_join=True).collect()}
        want = set()
        for i, a in vecs:
            for j, b in vecs:
                if i < j:
                    if metric == "euclid":
                        d = sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5
                    else:
                        na = sum(x * x for x in a) ** 0.5
                        nb = sum(x * x for x in b) ** 0.5
                        d = 1 - sum(x * y for x, y in zip(a, b)) / (na * nb)
                    if d <= radius:
                        want.add((i, j))
        assert got == want


def test_partition_independence(spark):
    inst = _instances(21)
    edges = [(c, d, q) for c, sets, _ in inst for d, s in sets.items() for q in s]
    costs = [(c, d, cost) for c, _, cs in inst for d, cost in cs.items()]
    results = []
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        e = spark.createDataFrame(edges, "cluster_id long, demo_id long, ques_id long").repartition(parts)
        k = spark.createDataFrame(costs, "cluster_id long, demo_id long, set_cost long")
        results.append(sorted(tuple(r) for r in setcover.with_pick_no(setcover.set_cover(e, k)).select("cluster_id", "demo_id", "pick_no")
                              .collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def _diverse_brute(vecs, k0):
    n = len(vecs)
    edges = []
    for i in range(n):
        for j in range(i + 1, n):
            d = sum((a - b) ** 2 for a, b in zip(vecs[i][1], vecs[j][1])) ** 0.5
            if d == 0 or 1.0 / d <= k0:
                edges.append((i, j))
    lab = _union_find(n, edges)
    return {vecs[i][0]: vecs[lab[i]][0] for i in range(n)}


def _ball(rng, n, dim):
    out = []
    for i in range(n):
        g = [rng.gauss(0, 1) for _ in range(dim)]
        norm = sum(x * x for x in g) ** 0.5
        scale = rng.random() ** (1.0 / dim) / norm
        out.append((i, [x * scale for x in g]))
    return out


def test_diverse_middle_regime_matches_brute_force(spark):
    # points in a unit ball: no pair is 2/k0 apart and the spread exceeds 1/(2 k0), so
    # k0 = 0.625 takes the antipode far-pair join, k0 = 0.833 the complement search
    rng = random.Random(8)
    for dim, k0 in ((2, 0.625), (6, 0.625), (2, 0.833)):
        vecs = _ball(rng, 150, dim)
        vecs += [(150, list(vecs[3][1])), (151, list(vecs[7][1]))]   # identical vectors
        df = spark.createDataFrame(vecs, "id long, vec array<double>")
        got = {r["id"]: r["cluster_id"] for r in graph.cluster_diverse(df, k0).collect()}
        assert got == _diverse_brute(vecs, k0)


def test_skew_hot_cell_salted_blocks(spark):
    # most vectors identical (one hot cell); tiny blocks force several salts per side
    rng = random.Random(6)
    base = [rng.gauss(0, 1) for _ in range(32)]
    vecs = [(i, base if i % 4 else [rng.gauss(0, 1) for _ in range(32)]) for i in range(120)]
    df = spark.createDataFrame(vecs, "id long, vec array<double>")
    got = {(r["id"], r["id2"]) for r in simjoin.range_join(
        df, df.withColumnRenamed("id", "id2"), "id", "id2", 0.3, metric="cosine", self_join=True,
        engine="block", block_rows=8).collect()}
    want = set()
    for i, a in vecs:
        for j, b in vecs:
            if i < j:
                na = sum(x * x for x in a) ** 0.5
                nb = sum(x * x for x in b) ** 0.5
                if 1 - sum(x * y for x, y in zip(a, b)) / (na * nb) <= 0.3:
                    want.add((i, j))
    assert got == want and len(got) > 4000


def test_skew_one_demo_covers_everything(spark):
    edges = [(0, 99, q) for q in range(300)] + [(0, d, d) for d in range(30)]
    costs = [(0, 99, 500)] + [(0, d, 2) for d in range(30)]
    e = spark.createDataFrame(edges, "cluster_id long, demo_id long, ques_id long")
    k = spark.createDataFrame(costs, "cluster_id long, demo_id long, set_cost long")
    picks = setcover.with_pick_no(setcover.set_cover(e, k)).collect()
    ids = list(range(30)) + [99]
    want = ranked_cover({x: {q for _, d, q in edges if d == x} for x in ids}, {x: 500.0 if x == 99 else 2.0 for x in ids})
    assert [r["demo_id"] for r in sorted(picks, key=lambda r: r["pick_no"])] == want
    a = assign.assign_last(setcover.set_cover(e, k), e).collect()
    assert len(a) == 300


def test_empty_inputs(spark):
    vecs = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "id long, vec array<double>")
    none = vecs.where("id < 0")
    q = vecs.withColumnRenamed("id", "ques_id")
    d = none.withColumnRenamed("id", "demo_id")
    assert simjoin.range_join(q, d, "ques_id", "demo_id", 1.0).count() == 0
    assert simjoin.knn_join(q, d, "ques_id", "demo_id", 2).count() == 0
    assert simjoin.knn_cover(q, d, 1.0, 3, "euclid").count() == 0
    assert graph.cluster_diverse(none, 0.5).count() == 0
    e = spark.createDataFrame([], "cluster_id long, demo_id long, ques_id long")
    k = spark.createDataFrame([], "cluster_id long, demo_id long, set_cost long")
    assert setcover.set_cover(e, k).count() == 0
    assert packing.pack_groups(spark.createDataFrame([], "cluster_id long, demo_id long, weight long"), 10.0).count() == 0


def test_row_number_within_matches_window(spark):
    from pyspark.sql import Window as W

    from quire.operators.ordering import row_number_within
    rng = random.Random(12)
    rows = [(0 if rng.random() < 0.6 else rng.randrange(1, 6), rng.random(), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, s double, i long")
    got = {(r["k"], r["i"]): r["row_no"] for r in row_number_within(df, ["k"], [F.col("s").desc(), F.col("i")],
                                                                     n_parts=7).collect()}
    want = {(r["k"], r["i"]): r["rn"] for r in df.withColumn(
        "rn", F.row_number().over(W.partitionBy("k").orderBy(F.col("s").desc(), "i"))).collect()}
    assert got == want


def test_running_sums_per_key(spark):
    from pyspark.sql import Window as W

    from quire.operators.evaluate import running_sums
    rng = random.Random(13)
    rows = [("big" if rng.random() < 0.7 else f"t{rng.randrange(4)}", i, rng.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(rows, "t string, g long, x long")
    for keys in ([], ["t"]):
        got = {(r["t"], r["g"]): r["cum_x"] for r in running_sums(df, ["g"], ["x"], n_parts=5, keys=keys).collect()}
        w = (W.partitionBy(*keys) if keys else W).orderBy("g").rowsBetween(W.unboundedPreceding, 0)
        want = {(r["t"], r["g"]): r["c"] for r in df.withColumn("c", F.sum("x").over(w)).collect()}
        assert got == want


def test_thirty_attempt_limit(spark):
    from quire.operators import evaluate
    prompts = spark.createDataFrame([(1, ["1", "0"]), (2, ["0"])], "group_id long, answers array<string>")
    bad = [(1, a, "garbage") for a in range(1, 31)]
    rows = bad + [(1, 31, "Yes\nNo"), (2, 30, "No")]
    resp = spark.createDataFrame(rows, "group_id long, attempt int, text string")
    first = {r["group_id"]: r["attempt"] for r in evaluate.first_valid_reply(prompts, resp).collect()}
    assert first == {2: 30}          # the 31st attempt of prompt 1 is past the limit
    m = evaluate.eval_er(prompts, resp).first()
    assert (m["tp"], m["fp"], m["tn"], m["fn"], m["unanswered"]) == (0, 0, 1, 0, 1)


def test_set_cover_ties_and_zero_cost(spark):
    # equal scores pick the lowest id first; a zero cost counts as 1
    e = spark.createDataFrame([(0, 5, 1), (0, 3, 2), (0, 9, 3), (0, 9, 4)],
                              "cluster_id long, demo_id long, ques_id long")
    k = spark.createDataFrame([(0, 5, 1), (0, 3, 1), (0, 9, 0)], "cluster_id long, demo_id long, set_cost long")
    got = [r["demo_id"] for r in sorted(setcover.with_pick_no(setcover.set_cover(e, k)).collect(),
                                       key=lambda r: r["pick_no"])]
    assert got == [9, 3, 5]


def test_packing_exact_fill_and_equal_weights(spark):
    items = [(0, i, 25) for i in range(4)] + [(0, 10, 50)]
    df = spark.createDataFrame(items, "cluster_id long, demo_id long, weight long")
    got = {r["demo_id"]: r["bin_no"] for r in packing.pack_groups(df, 50.0).collect()}
    assert got == {10: 0, 0: 1, 1: 1, 2: 2, 3: 2}


def test_block_join_lopsided_and_neighbour_hot_cells(spark):
    # a hot cluster of left rows next to a sparse right cell, plus the reverse
    rng = random.Random(21)
    base = [rng.gauss(0, 1) for _ in range(20)]
    left = [(i, [x + rng.gauss(0, 0.01) for x in base]) for i in range(150)] + \
        [(1000 + i, [rng.gauss(0, 1) for _ in range(20)]) for i in range(20)]
    right = [(5000 + i, [x + rng.gauss(0, 0.3) for x in base]) for i in range(6)] + \
        [(6000 + i, [rng.gauss(0, 1) for _ in range(20)]) for i in range(40)]
    L = spark.createDataFrame(left, "lid long, vec array<double>")
    R = spark.createDataFrame(right, "rid long, vec array<double>")
    for metric, radius in (("euclid", 2.0), ("cosine", 0.3)):
        got = {(r["lid"], r["rid"]) for r in simjoin.range_join(L, R, "lid", "rid", radius, metric=metric,
                                                                 engine="block", block_rows=7).collect()}
        want = set()
        for i, a in left:
            for j, b in right:
                if metric == "euclid":
                    d = sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5
                else:
                    na = sum(x * x for x in a) ** 0.5
                    nb = sum(x * x for x in b) ** 0.5
                    d = 1 - sum(x * y for x, y in zip(a, b)) / (na * nb)
                if d <= radius:
                    want.add((i, j))
        assert got == want and len(got) > 100


def test_dominated_demos_both_paths(spark):
    from quire.operators.coverage import dominated_demos
    rng = random.Random(31)
    edges, costs = [], []
    for d in range(40):
        qs = rng.sample(range(12), rng.randint(1, 4))
        edges += [(0, d, q) for q in qs]
        costs.append((d, rng.randint(1, 5)))
    # a second cluster holding the same question ids: supersets there must not count
    edges += [(1, 100 + d, q) for d in range(3) for q in range(12)]
    costs += [(100 + d, 0) for d in range(3)]
    e = spark.createDataFrame(edges, "cluster_id long, demo_id long, ques_id long")
    c = spark.createDataFrame(costs, "demo_id long, cost int")
    sets, clus = {}, {}
    for c_, d, q in edges:
        sets.setdefault(d, set()).add(q)
        clus[d] = c_
    cost = dict(costs)
    want = {d for d in sets if any(j > d and clus[j] == clus[d] and sets[d] <= sets[j] and cost[j] <= cost[d]
                                   for j in sets)}
    for limit in (12, 2, 0):   # by subsets, by the size of each set, by the anchor question
        got = {r["demo_id"] for r in dominated_demos(e, c, max_subset_size=limit).collect()}
        assert got == want and want


def test_plan_violations_all_checks(spark):
    from quire.plans.reports import plan_violations
    gq = spark.createDataFrame([("g1", 1), ("g1", 2), ("g2", 2), ("g3", 4)], "group_id string, ques_id long")
    gd = spark.createDataFrame([("g1", 10), ("g2", 11), ("g4", 12)], "group_id string, demo_id long")
    q = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 5)], "ques_id long, cost int")
    d = spark.createDataFrame([(10, 50), (11, 1), (12, 1)], "demo_id long, cost int")
    cover = spark.createDataFrame([(1, 10), (2, 10), (2, 11)], "ques_id long, demo_id long")
    forbidden = spark.createDataFrame([(1, 2)], "q1 long, q2 long")
    v = {r["check"]: r["n"] for r in plan_violations(gq, gd, q, d, k2=40, t_cost=0, cover=cover, cover_cnt=1,
                                                     forbidden=forbidden).collect()}
    assert v == {"question_repeated": 1, "question_unassigned": 1, "under_covered": 1, "over_budget": 1,
                 "forbidden_pair": 1, "empty_group": 2}


def test_affinity_modes(spark):
    pairs = spark.createDataFrame([(1, 2, 0.2), (1, 3, 0.9)], "src long, dst long, dist double")
    def w(mode, kind):
        return [r["weight"] for r in graph.affinity_edges(pairs, 0.5, mode=mode, kind=kind).orderBy("dst").collect()]
    assert w("binary", "diverse") == [0.0, 1.0]
    assert w("sign", "similar") == [1.0, -1.0]
    assert [round(x, 6) for x in w("weight", "diverse")] == [0.8, 0.1]
    assert w("weight", "similar") == [0.2, 0.9]


def test_numbering_keeps_every_row_of_large_keys(spark):
    from quire.operators.evaluate import running_sums
    from quire.operators.ordering import row_number_within
    rows = spark.range(600_000).select((F.col("id") % 3).alias("k"), F.hash("id").alias("v"), "id", F.lit(1).alias("one"), F.lit("x").alias("unused"))
    out = row_number_within(rows, ["k"], [F.col("v"), F.col("id")], n_parts=16)
    got = out.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("row_no").alias("d"), F.max("row_no").alias("m")).collect()
    assert [(r["n"], r["d"], r["m"]) for r in got] == [(200_000,) * 3] * 3
    sums = running_sums(rows, ["id"], ["one"], n_parts=16)
    r = sums.agg(F.count("*").alias("n"), F.max("cum_one").alias("m"), F.count_distinct("cum_one").alias("d")).first()
    assert (r["n"], r["m"], r["d"]) == (600_000,) * 3


def test_zero_vector_cosine(spark):
    for dim in (3, 64):
        v = spark.createDataFrame([(1, [0.0] * dim), (2, [1.0] * dim)], "id long, vec array<double>")
        got = simjoin.range_join(v.withColumnRenamed("id", "l"), v.withColumnRenamed("id", "r"), "l", "r", 1.0, "cosine").collect()
        assert {(x["l"], x["r"]): round(x["dist"], 6) for x in got} == {(1, 1): 1.0, (1, 2): 1.0, (2, 1): 1.0, (2, 2): 0.0}


def test_set_cover_needs_costs(spark):
    e = spark.createDataFrame([(0, 1, 10), (0, 2, 11)], "cluster_id long, demo_id long, ques_id long")
    for rows in ([(0, 1, 3)], [(0, 1, 3), (0, 2, None)]):
        with pytest.raises(ValueError, match="no cost"):
            setcover.set_cover(e, spark.createDataFrame(rows, "cluster_id long, demo_id long, set_cost long"))


def test_json_reply_is_strict(spark):
    from quire.functions.replies import parse_json_reply
    texts = ['{"Question1": "yes"} ', '{"Question1":"yes"} Hope this helps', "{'Question1':'yes'}", '{"Question1": ']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(parse_json_reply(F.col("t"))).collect()]
    assert got == [{"Question1": "yes"}, None, None, None]
