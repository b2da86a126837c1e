"""Graph operators: connected components (G3), similar / diverse clustering (G1, G2),
splitting (G4), parallel pivot correlation clustering (G5), edge/label helpers
(G6-G10) and correlation losses (A14-A17, U4).

Graphs are an edge table ``edges(src, dst, weight)`` with ``src < dst`` plus an
explicit ``nodes(id)`` table (a node without edges is still a node).  Cluster ids
are the smallest member id.  Every iteration is a DataFrame round with a
reliable checkpoint; no adjacency list is ever collected.
"""

from __future__ import annotations

import math
import warnings
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.vectors import euclid
from quire.operators import neighbours as nb
from quire.operators.blockpairs import block_pairs_join, unite
from quire.session import cut_lineage

# ---------------------------------------------------------------------------
# G3 connected components: large-star / small-star alternation
# ---------------------------------------------------------------------------


def _canon(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    return edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()


_FOREST_EDGES = 1 << 20     # edges contracted at once


def _contract(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars with the components of the given edges: (node, smallest node of its component)."""
    ids, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    a, b = at[:len(hi)], at[len(hi):]
    parent = unite(np.arange(len(ids)), a, b)
    leaf = np.flatnonzero(parent != np.arange(len(ids)))
    return ids[leaf], ids[parent[leaf]]


def star_edges(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Edges ``(src, dst)`` with the same touched nodes and components, at most one a node and partition: each task
    contracts the edges that it reads, so that no list of all edges is moved or stored."""
    kept = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src != dst")
    if any(kind not in ("bigint", "int", "smallint", "tinyint") for _, kind in kept.dtypes):
        return kept
    kept = kept.select(F.col("src").cast("long"), F.col("dst").cast("long"))

    def contract(batches):
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        new, n = [], 0
        for batch in batches:
            new.append(tuple(batch.column(i).to_numpy() for i in (0, 1)))
            n += batch.num_rows
            if n >= _FOREST_EDGES:
                held = _contract(*(np.concatenate(x) for x in zip(held, *new)))
                new, n = [], 0
        if new:
            held = _contract(*(np.concatenate(x) for x in zip(held, *new)))
        for i in range(0, len(held[0]), _FOREST_EDGES):
            yield pa.RecordBatch.from_arrays([pa.array(x[i:i + _FOREST_EDGES]) for x in held], names=["src", "dst"])

    return kept.mapInArrow(contract, "src long, dst long")


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 10000) -> DataFrame:
    """``nodes(id)``, ``edges(src, dst)`` -> ``(id, cluster_id)``, cluster_id = min id.

    Large-star: every node links its larger neighbours to its minimum neighbour;
    small-star: every node links its smaller neighbours (and itself) to the minimum
    among them.  Converges to stars centred on each component's minimum in
    O(log^2 n) rounds.  Each task first contracts its own edges."""
    E = cut_lineage(_canon(star_edges(edges)))
    rnd = 0
    while True:
        rnd += 1
        both = E.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            E.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        m = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(m, "u").select(
            F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        ms = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(ms, "hi").select(F.col("lo").alias("x"), F.col("m").alias("y")) \
            .unionByName(ms.select(F.col("hi").alias("x"), F.col("m").alias("y")))
        E2 = cut_lineage(_canon(small, "x", "y"))
        # exact set comparison in one job: rows present on one side only
        diff = E2.withColumn("_n", F.lit(1)).join(E.withColumn("_o", F.lit(1)), ["hi", "lo"], "full_outer") \
            .where(F.col("_n").isNull() | F.col("_o").isNull())
        changed = 0 if diff.isEmpty() else 1
        E = E2
        if changed == 0:
            break
        if rnd >= max_rounds:
            warnings.warn(f"connected_components: {rnd} rounds; continuing", RuntimeWarning)
            max_rounds *= 2
    lab = E.groupBy("hi").agg(F.min("lo").alias("m"))
    ids = nodes.select("id").distinct()
    centre = E.select(F.col("lo").alias("hi")).distinct().join(lab, "hi", "left_anti")
    labels = lab.select(F.col("hi").alias("id"), F.col("m").alias("cluster_id")).unionByName(
        centre.select(F.col("hi").alias("id"), F.col("hi").alias("cluster_id")))
    return ids.join(labels, "id", "left").select(
        "id", F.coalesce(F.col("cluster_id"), F.col("id")).alias("cluster_id"))


def components(nodes: DataFrame, edges: DataFrame, is_non_value: Column | None = None) -> DataFrame:
    """G3 as in the reference: edges with weight < 0 or a non-value (NaN/NULL) are dropped."""
    bad = (F.col("weight") < 0) | F.isnan("weight") | F.col("weight").isNull()
    if is_non_value is not None:
        bad = bad | is_non_value
    return connected_components(nodes, edges.where(~bad))


# ---------------------------------------------------------------------------
# G1 / G2 clustering of points (DBSCAN with min_samples = 1 = components)
# ---------------------------------------------------------------------------


def _cells(points: DataFrame, eps: float, metric: str) -> DataFrame:
    """``points(id, vec)`` with ``cell``, the smallest id of its cell: points whose distances are all within ``eps``.

    A cell is a cube of diameter eps (in the chord space for cosine).  A zero vector under
    cosine has distance 1 to everything, itself included, so it is a cell of its own."""
    from quire.functions.vectors import norm, unit

    v = F.col("vec").cast("array<double>")
    space = unit(v) if metric == "cosine" else v
    key = v                                       # only equal vectors are within 0
    if eps > 0:
        side = F.lit((math.sqrt(2.0 * eps) if metric == "cosine" else eps) * (1 - 1e-9)) / F.sqrt(F.size("vec"))
        key = F.transform(space, lambda x: F.floor(x / side))
    alone = (norm(v) == 0) if metric == "cosine" else F.lit(False)
    keyed = points.select("id", "vec", key.alias("_key"), F.when(alone, F.col("id")).alias("_own"))
    first = keyed.groupBy("_key", "_own").agg(F.min("id").alias("cell"))
    return keyed.join(first, keyed["_key"].eqNullSafe(first["_key"]) & keyed["_own"].eqNullSafe(first["_own"])).select("id", "vec", "cell")


def _close_cells(points: DataFrame, pairs: DataFrame, eps: float, metric: str, block_rows: int) -> DataFrame:
    """``(src, dst)`` of the cell ``pairs`` that hold two points within ``eps``: one row a pair, whatever
    the number of points.  A point takes part only if the other cell's ball can hold a partner."""
    from quire.operators.simjoin import _block_fn, _prep, _working_radius, _space_distance

    inner = _block_fn(metric, eps, 0.0, 0, False, False)
    reach = _working_radius(metric, eps) * (1 + 1e-9) + 1e-12
    p = _prep(points, "id", "vec").join(points.select("id", "cell"), "id")
    n = points.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("_b"))
    pairs = pairs.join(n.select(F.col("cell").alias("src"), F.col("_b").alias("_bs")), "src") \
        .join(n.select(F.col("cell").alias("dst"), F.col("_b").alias("_bd")), "dst")

    def side(own: str, other: str, radius: str, mine: str, theirs: str, salt: str, spread: str) -> DataFrame:
        at = pairs.select("src", "dst", F.col(own).alias("cell"), F.col(f"_{other}").alias("_o"), F.col(radius).alias("_r"),
                          F.col(mine).alias("_m"), F.col(theirs).alias("_t"))
        near = p.join(at, "cell").where(_space_distance(metric, F.col("_v"), F.col("_o")) <= F.col("_r") + F.lit(reach))
        same = [F.col(c).alias(c) for c in ("src", "dst", "_v", "_n")]      # columns of their own on each side
        return near.select(*same, F.col("id").alias("_lid" if own == "src" else "_rid"),
                           F.pmod(F.xxhash64("id"), F.col("_m")).cast("int").alias(salt),
                           F.explode(F.sequence(F.lit(0), F.col("_t") - 1)).alias(spread))

    def any_pair(key, l, r):
        found = inner(l, r)
        return found.iloc[:1].assign(src=key[0], dst=key[1])[["src", "dst"]].astype("int64")

    keys = ["src", "dst", "_ls", "_rs"]
    left = side("src", "dv", "_dr", "_bs", "_bd", "_ls", "_rs")
    right = side("dst", "sv", "_sr", "_bd", "_bs", "_rs", "_ls")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(any_pair, "src long, dst long").distinct()


def similar_cell_edges(cells: DataFrame, eps: float, metric: str, n_pivots: int = 2, block_rows: int = 2048) -> DataFrame:
    """``(src, dst)`` links between the cells of ``cells(id, vec, cell)``, enough to connect all cells that pairs within
    ``eps`` connect: at most one for each two cells.

    Cells that first points within eps connect are linked; of the others, only pairs in
    different components whose balls can hold a pair within eps are searched."""
    from quire.operators.simjoin import _space_distance, _working_radius, range_join, range_links

    reps = cut_lineage(cells.where(F.col("id") == F.col("cell")).select("id", "vec"))
    other = reps.withColumnRenamed("id", "id2")
    edges = cut_lineage(range_links(reps, "id", eps, metric=metric, n_pivots=n_pivots))
    wide = cells.join(reps.select(F.col("id").alias("cell"), F.col("vec").alias("_c")), "cell")
    radius = cut_lineage(wide.where(F.col("id") != F.col("cell")).groupBy("cell").agg(
        F.max(_space_distance(metric, F.col("vec"), F.col("_c"))).alias("_r")))
    most = radius.agg(F.max("_r").alias("r")).first()["r"]
    if not most:
        return edges
    comp = cut_lineage(connected_components(reps.select("id"), edges))
    # first points within eps + both radii; one of the two cells has more than one place
    reach = _working_radius(metric, eps) + 2.0 * most
    far = reach * reach / 2.0 if metric == "cosine" else reach
    several = reps.join(radius.select(F.col("cell").alias("id")), "id", "left_semi")
    cand = range_join(several, other, "id", "id2", min(far, 2.0) if metric == "cosine" else far, metric=metric, n_pivots=n_pivots) \
        .where(F.col("id") != F.col("id2"))
    cand = cand.select(F.least("id", "id2").alias("src"), F.greatest("id", "id2").alias("dst")).distinct()
    for c, v, r, k in (("src", "_sv", "_sr", "_sc"), ("dst", "_dv", "_dr", "_dc")):
        cand = cand.join(reps.select(F.col("id").alias(c), F.col("vec").cast("array<double>").alias(v)), c) \
            .join(comp.select(F.col("id").alias(c), F.col("cluster_id").alias(k)), c) \
            .join(radius.select(F.col("cell").alias(c), F.col("_r").alias(r)), c, "left")
    cand = cand.withColumns({"_sr": F.coalesce("_sr", F.lit(0.0)), "_dr": F.coalesce("_dr", F.lit(0.0))})
    gap = _space_distance(metric, F.col("_sv"), F.col("_dv"))
    cand = cand.where((F.col("_sc") != F.col("_dc")) &
                      (gap <= F.lit(_working_radius(metric, eps) * (1 + 1e-9) + 1e-9) + F.col("_sr") + F.col("_dr")))
    cand = cut_lineage(cand.drop("_sc", "_dc"))
    if cand.isEmpty():
        return edges
    return edges.unionByName(_close_cells(cells, cand, eps, metric, block_rows))


def cluster_similar(points: DataFrame, eps: float, metric: str, id_col: str = "id", vec_col: str = "vec",
                    n_pivots: int = 2) -> DataFrame:
    """G1: components of the graph ``dist <= eps``, without listing all its pairs: points of one cell are
    connected at once, and cells are linked by one pair at most (``similar_cell_edges``)."""
    p = points.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    cells = cut_lineage(_cells(p.where(F.col("vec").isNotNull()), eps, metric))
    edges = similar_cell_edges(cells, eps, metric, n_pivots)
    lab = connected_components(cells.select(F.col("cell").alias("id")), edges)
    placed = cells.select("id", "cell").join(lab.select(F.col("id").alias("cell"), "cluster_id"), "cell").select("id", "cluster_id")
    return placed.unionByName(p.where(F.col("vec").isNull()).select("id", F.col("id").alias("cluster_id")))


def cluster_diverse(points: DataFrame, k0: float, id_col: str = "id", vec_col: str = "vec",
                    n_pivots: int = 2, metric=None) -> DataFrame:
    """Components of the graph "far or identical": ``if(d = 0, 0, 1/d) <= k0``.

    1. identical vectors are one node (their smallest id);
    2. if two nodes are >= 2/k0 apart every node is adjacent to one of them: one
       component (found by pivot -> farthest -> farthest);
    3. if every node is within 1/(2 k0) of the centroid no pair is far: the
       components are the identical-vector groups;
    4. otherwise, when the far pairs are the sparse side, they are found exactly by a
       range join of the centred points with their negation and linked by connected
       components; else parts are joined by bounds between nodes of a tree of centres,
       and what these leave open is decided by the near pairs (closer than 1/k0) of the
       points outside the largest part: a point is linked to a part it is not near all of.

    With a ``metric`` of the caller's (``simjoin.Metric``) only 1. and the near pairs of all points
    are used, since the bounds are those of Euclid."""
    from quire.operators.simjoin import BLOCK_MIN_DIM, range_join

    pts = points.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    reps = pts.groupBy("vec").agg(F.min("id").alias("rep"))
    member = pts.join(reps, "vec").select("id", "rep")
    P = cut_lineage(reps.select(F.col("rep").alias("id"), "vec"))
    n = P.count()
    r = 1.0 / k0 if k0 > 0 else float("inf")

    def finish(rep_labels: DataFrame) -> DataFrame:
        return member.join(rep_labels.select(F.col("id").alias("rep"), "cluster_id"), "rep") \
            .select("id", "cluster_id")

    if n <= 1:
        return finish(P.select("id", F.col("id").alias("cluster_id")))
    if metric is not None:
        from quire.operators.complement import both_ways, complement_components

        near = range_join(P, P.withColumnRenamed("id", "id2"), "id", "id2", r * (1 + 1e-9), metric=metric, self_join=True, n_pivots=n_pivots)
        near = near.where((F.col("dist") > 0) & ((F.lit(1.0) / F.col("dist")) > F.lit(k0)))
        return finish(complement_components(P.select("id"), cut_lineage(both_ways(near, "id", "id2"))))
    first = P.select(F.min_by("vec", F.struct(F.xxhash64("id"), F.col("id"))).alias("v"),
                     F.min("id").alias("lowest")).first()
    start, lowest = list(first["v"]), first["lowest"]
    dim = len(start)
    # pass 1: farthest point from the start, and the centroid (one aggregate)
    slit = F.array(*[F.lit(float(x)) for x in start])
    row = P.select(F.max_by("vec", F.struct(euclid(F.col("vec"), slit), F.col("id"))).alias("a"),
                   F.array(*[F.avg(F.col("vec")[i]) for i in range(dim)]).alias("c")).first()
    a, centroid = list(row["a"]), list(row["c"])
    # pass 2: farthest distance from a, and the radius around the centroid (one aggregate)
    alit = F.array(*[F.lit(float(x)) for x in a])
    clit = F.array(*[F.lit(float(x)) for x in centroid])
    row = P.select(F.max(euclid(F.col("vec"), alit)).alias("dab"), F.max(euclid(F.col("vec"), clit)).alias("rho")).first()
    dab, rho = float(row["dab"]), float(row["rho"])
    if dab >= 2.0 * r * (1 + 1e-9):
        return finish(P.select("id", F.lit(lowest).cast("long").alias("cluster_id")))
    if 2.0 * rho < r * (1 - 1e-9):
        return finish(P.select("id", F.col("id").alias("cluster_id")))
    # 4a. far pairs directly: with x~ = x - centroid and |x~| <= rho, a far pair
    #     (|x - y| >= r) has |x~ + y~|^2 = 2|x~|^2 + 2|y~|^2 - |x - y|^2 <= 4 rho^2 - r^2,
    #     so it is a NEAR pair between the centred points and their negation.
    R = math.sqrt(max(0.0, 4.0 * rho * rho * (1 + 1e-9) - r * r)) * (1 + 1e-9) + 1e-12
    if R < r:
        # dense vectors: each task compares its blocks and gives links for their far pairs
        links = block_pairs_join(P, P, "id", "id", r, "euclid", "vec", True, False, BLOCK_MIN_DIM, links=True, far=True)
        if links is not None:
            return finish(connected_components(P.select("id"), links))
        clit = F.array(*[F.lit(float(x)) for x in centroid])
        cen = P.select("id", F.zip_with("vec", clit, lambda x, c: x - c).alias("vec"))
        neg = cen.select(F.col("id").alias("id2"), F.transform("vec", lambda x: -x).alias("vec"))
        cand = range_join(cen, neg, "id", "id2", R, metric="euclid", n_pivots=n_pivots) \
            .where(F.col("id") < F.col("id2")).select("id", "id2")
        far = cand.join(P.select("id", F.col("vec").alias("_a")), "id") \
            .join(P.select(F.col("id").alias("id2"), F.col("vec").alias("_b")), "id2") \
            .withColumn("d", euclid(F.col("_a"), F.col("_b"))) \
            .where((F.col("d") == 0) | ((F.lit(1.0) / F.col("d")) <= F.lit(k0)))
        labels = connected_components(P.select("id"), far.select(F.col("id").alias("src"), F.col("id2").alias("dst")))
        return finish(labels)
    # 4b. dense far graph: bounds between nodes of a tree join most points at once; near pairs are listed
    #     only for points outside the largest part, and decide the rest by counts
    from quire.operators.complement import complement_components

    start = cut_lineage(_far_parts(P, r, lowest))
    parts = start.groupBy("cluster_id").agg(F.count("*").alias("n"))
    largest = parts.orderBy(F.desc("n"), "cluster_id").first()
    asks = cut_lineage(P.join(start.where(F.col("cluster_id") != largest["cluster_id"]).select("id"), "id", "left_semi")
                       if largest["n"] > 1 else P)
    if asks.isEmpty():
        return finish(start)
    near = range_join(asks, P.withColumnRenamed("id", "id2"), "id", "id2", r * (1 + 1e-9), metric="euclid", n_pivots=n_pivots)
    near = near.where((F.col("id") != F.col("id2")) & (F.col("dist") > 0) & ((F.lit(1.0) / F.col("dist")) > F.lit(k0)))
    near = cut_lineage(near.select(F.col("id").alias("u"), F.col("id2").alias("v")))
    return finish(complement_components(P.select("id"), near, start, asks.select("id")))


def _far_parts(points: DataFrame, r: float, lowest: int) -> DataFrame:
    """``(id, cluster_id)``: parts of ``points(id, vec)`` that pairs at least ``r`` apart connect, as far as bounds tell.

    A point x is linked to every point of a leaf of centre c and radius R if ``|x - c| - R >= r``, so the
    leaf's points are connected through x: one link a point and such leaf, for points that are
    connected through their own leaf only distinct links between leaves.  cluster_id = smallest member."""
    from quire.operators import centretree as ct

    alone = points.select("id", F.col("id").alias("cluster_id"))
    tree = ct.build_tree(points, points, "id", "id", r, "euclid", always=True)
    if tree is None:
        return alone
    placed = cut_lineage(ct._placed(tree, points, "vec").select("id", "vec", F.col("_at.leaf").alias("leaf"), F.col("_at.b").alias("b")))
    ball = placed.groupBy("leaf").agg(F.max("b").alias("r")).collect()          # bounded by the number of centres
    leaves = np.array([x["leaf"] for x in ball], np.int64)
    centres = np.stack([tree.fine[n // ct.FINE][n % ct.FINE] for n in leaves])
    radii = np.array([x["r"] for x in ball])
    margin = 1e-6 * (1.0 + r + float(np.abs(centres).max()))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def far(v: pd.Series) -> pd.Series:
        ok = ct._dist(ct._rows(v), centres) - radii[None, :] >= r + margin
        return pd.Series([leaves[row].tolist() for row in ok])

    seen = placed.select("id", "leaf", F.explode(far("vec")).alias("other"))
    seen = cut_lineage(seen)
    whole = cut_lineage(seen.select(F.col("other").alias("leaf")).distinct())   # leaves that some point is far from
    node = lambda c: F.lit(lowest - 1).cast("long") - F.col(c)  # noqa: E731 - leaves as nodes below all ids
    links = seen.join(whole.withColumn("_w", F.lit(True)), "leaf", "left") \
        .select(F.when(F.col("_w"), node("leaf")).otherwise(F.col("id")).alias("src"), node("other").alias("dst")).distinct()
    members = placed.select("id", "leaf").join(whole, "leaf", "left_semi")
    lone = placed.select("id").join(members.select("id"), "id", "left_anti")
    nodes = whole.select(node("leaf").alias("id")).unionByName(lone)
    lab = cut_lineage(connected_components(nodes, links))
    got = members.select("id", node("leaf").alias("_n")).unionByName(lone.select("id", F.col("id").alias("_n"))) \
        .join(lab.select(F.col("id").alias("_n"), F.col("cluster_id").alias("_part")), "_n")
    low = got.groupBy("_part").agg(F.min("id").alias("cluster_id"))
    return got.join(low, "_part").select("id", "cluster_id")


def cluster_random(points: DataFrame, id_col: str = "id") -> DataFrame:
    """Every question in one cluster (labelled 0)."""
    return points.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("cluster_id"))


# ---------------------------------------------------------------------------
# G4-G9 helpers
# ---------------------------------------------------------------------------


BROADCAST_ROWS = 1 << 22    # labels sent whole to every task at most


def _beside_edges(labels: DataFrame) -> DataFrame:
    """Labels to be joined to edges, of which there may be many a node: broadcast while they are few, so that the
    edges stay where they are."""
    return F.broadcast(labels) if labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else labels


def split_clusters(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """Split each cluster into its positively connected parts (weight >= 0, no NaN);
    the node set is unchanged by construction."""
    c = clusters.select("id", "cluster_id")
    near = _beside_edges(c)
    pos = edges.where((F.col("weight") >= 0) & ~F.isnan("weight")) \
        .join(near.select(F.col("id").alias("src"), F.col("cluster_id").alias("_cs")), "src") \
        .join(near.select(F.col("id").alias("dst"), F.col("cluster_id").alias("_cd")), "dst") \
        .where(F.col("_cs") == F.col("_cd"))
    return connected_components(c.select("id"), pos.select("src", "dst"))


def affinity_edges(pairs: DataFrame, k0: float, mode: str = "sign", kind: str = "diverse") -> DataFrame:
    """Threshold affinity over ``pairs(src, dst, dist)``.

    diverse: ``dist >= k0`` is affine; similar: ``dist <= k0``.  ``mode``: ``binary``
    (1/0), ``sign`` (+1/-1) or ``weight`` (``1 - dist`` for diverse, ``dist`` for similar, for
    every pair)."""
    ok = F.col("dist") >= k0 if kind == "diverse" else F.col("dist") <= k0
    if mode == "binary":
        w = F.when(ok, F.lit(1.0)).otherwise(F.lit(0.0))
    elif mode == "sign":
        w = F.when(ok, F.lit(1.0)).otherwise(F.lit(-1.0))
    elif mode == "weight":
        w = F.lit(1.0) - F.col("dist") if kind == "diverse" else F.col("dist")
    else:
        raise ValueError(f"unknown affinity mode {mode!r}")
    return pairs.select("src", "dst", w.alias("weight"))


def edge_transform(edges: DataFrame, fn) -> DataFrame:
    """``weight <- fn(weight)`` for a ``Column -> Column`` function."""
    return edges.withColumn("weight", fn(F.col("weight")))


def label_nodes(nodes: DataFrame, labels: DataFrame, missing: str = "noise") -> DataFrame:
    """Attach labels; a node without one gets -1 (``missing='noise'``) or fails."""
    j = nodes.select("id").join(labels.select("id", "cluster_id"), "id", "left")
    fill = F.lit(-1).cast("long") if missing == "noise" else \
        F.raise_error(F.concat(F.lit("node without label: "), F.col("id").cast("string")))
    return j.select("id", F.coalesce(F.col("cluster_id"), fill).alias("cluster_id"))


def clusters_by_size(labels: DataFrame, keep_noise: bool = True) -> DataFrame:
    """One row per cluster, largest first (ties: smallest member)."""
    lab = labels if keep_noise else labels.where(F.col("cluster_id") != -1)
    return lab.groupBy("cluster_id").agg(F.count("*").alias("size"), F.min("id").alias("min_member")) \
        .orderBy(F.col("size").desc(), F.col("min_member"))


# ---------------------------------------------------------------------------
# G5 parallel pivot correlation clustering
# ---------------------------------------------------------------------------


def _prio(seed: Column, ident: Column) -> Column:
    """Seeded priority ``(md5('seed:id'), id)`` -- reproducible in any SQL engine."""
    return F.struct(F.md5(F.concat(seed.cast("string"), F.lit(":"), ident.cast("string"))).alias("h"),
                    ident.alias("i"))


def _attracting(edges: DataFrame) -> DataFrame:
    return edges.where((F.col("weight") >= 0) & ~F.isnan("weight")).select("src", "dst")


def _priority_order(nodes: DataFrame, ids: np.ndarray, seeds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The numbered nodes by priority, first to last, and the rank of each; a row a seed."""
    order = nodes.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct() \
        .withColumn("seed", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in seeds]))) \
        .orderBy("seed", _prio(F.col("seed"), F.col("id"))).select("seed", "id").toArrow()
    seed, node = (order.column(c).to_numpy() for c in ("seed", "id"))
    by_rank = np.stack([nb.find(ids, node[seed == s]) for s in seeds]).astype(np.int32)
    rank = np.empty_like(by_rank)
    np.put_along_axis(rank, by_rank, np.arange(len(ids), dtype=np.int32)[None, :], axis=1)
    return by_rank, rank


def _pivots_by_blocks(nodes: DataFrame, ids: np.ndarray, blocks: DataFrame, seeds: list[int]) -> DataFrame:
    """``pivot_clusters`` on the packed neighbours: a round is two passes over them."""
    sc, n, out = nodes.sparkSession.sparkContext, len(ids), len(ids)
    by_rank, rank = _priority_order(nodes, ids, seeds)
    active, pivot = np.ones(rank.shape, bool), np.zeros(rank.shape, bool)
    while active.any():
        held = sc.broadcast(np.where(active, rank, out).astype(np.int32))

        def beaten(b: nb.Block, s: int) -> np.ndarray:
            at = held.value[s]
            return b.over(np.minimum, at, out) < at[b.first:b.first + len(b.degree)]

        found = active & ~nb.node_bits(blocks, n, len(seeds), beaten)
        held.destroy()
        held = sc.broadcast(found)
        gone = nb.node_bits(blocks, n, len(seeds), lambda b, s: b.over(np.logical_or, held.value[s], False))
        held.destroy()
        pivot |= found
        active &= ~(found | gone)
    held = sc.broadcast((ids, np.where(pivot, rank, out).astype(np.int32), by_rank))

    def attach(b: nb.Block):
        known, at, by = held.value
        for s, label in enumerate(seeds):
            best = b.over(np.minimum, at[s], out)
            mine = np.flatnonzero((at[s][b.first:b.first + len(b.degree)] == out) & (best < out))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), label, np.int64)), pa.array(known[mine + b.first]), pa.array(known[by[s][best[mine]]])],
                                             names=["seed", "id", "pivot"])

    attached = cut_lineage(nb.each_block(blocks, n, attach, "seed long, id long, pivot long"))
    held.destroy()
    every = nodes.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct() \
        .withColumn("seed", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in seeds])))
    lab = every.join(attached, ["seed", "id"], "left").select("seed", "id", F.coalesce("pivot", "id").alias("pivot"))
    low = lab.groupBy("seed", "pivot").agg(F.min("id").alias("cluster_id"))
    return lab.join(low, ["seed", "pivot"]).select("seed", "id", "cluster_id")


def pivot_clusters(nodes: DataFrame, edges: DataFrame, seeds: list[int], max_rounds: int = 10000) -> DataFrame:
    """Sequential pivot clustering on positive edges (weight >= 0), one run per seed,
    computed in parallel rounds: a node whose priority beats every active neighbour is
    a pivot; pivots and their neighbours leave; finally each node joins its
    lowest-priority neighbouring pivot.  Output ``(seed, id, cluster_id)``.

    The edges are stored once, as packed neighbours; beyond ``neighbours.MOST_NODES`` nodes as a table."""
    ids = nb.numbered(nodes)
    if ids is not None and len(ids):
        return _pivots_by_blocks(nodes, ids, nb.neighbour_blocks(_attracting(edges), ids), seeds)
    return _pivots_by_joins(nodes, edges, seeds, max_rounds)


def _pivots_by_joins(nodes: DataFrame, edges: DataFrame, seeds: list[int], max_rounds: int = 10000) -> DataFrame:
    pos = edges.where((F.col("weight") >= 0) & ~F.isnan("weight"))
    E = pos.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(
        pos.select(F.col("dst").alias("u"), F.col("src").alias("v"))).where(F.col("u") != F.col("v")).distinct()
    E = cut_lineage(E)
    seed_arr = F.array(*[F.lit(int(x)).cast("long") for x in seeds])
    active = cut_lineage(nodes.select("id").distinct().withColumn("seed", F.explode(seed_arr))
                         .withColumn("p", _prio(F.col("seed"), F.col("id"))))
    pivots = []
    rnd = 0
    while not active.isEmpty():
        rnd += 1
        a_u = active.select("seed", F.col("id").alias("u"), F.col("p").alias("pu"))
        a_v = active.select("seed", F.col("id").alias("v"), F.col("p").alias("pv"))
        nmin = E.join(a_u, "u").join(a_v, ["seed", "v"]).groupBy("seed", "u").agg(F.min("pv").alias("nmin"))
        piv = a_u.join(nmin, ["seed", "u"], "left").where(F.col("nmin").isNull() | (F.col("pu") < F.col("nmin"))) \
            .select("seed", F.col("u").alias("id"), F.col("pu").alias("p"))
        # cached, not checkpointed: its lineage starts at this round's checkpointed
        # ``active``; the next checkpoint materialises it
        piv = piv.persist()
        pivots.append(piv)
        gone = piv.select("seed", "id").unionByName(
            E.join(piv.select("seed", F.col("id").alias("u")), "u").select("seed", F.col("v").alias("id")))
        active = cut_lineage(active.join(gone, ["seed", "id"], "left_anti"))
        if rnd >= max_rounds:
            warnings.warn("pivot_clusters: many rounds; continuing", RuntimeWarning)
            max_rounds *= 2
    P = pivots[0]
    for x in pivots[1:]:
        P = P.unionByName(x)
    P = cut_lineage(P)
    for x in pivots:
        x.unpersist()
    attach = E.join(P.select("seed", F.col("id").alias("v"), F.col("p").alias("pp")), "v") \
        .join(P.select("seed", F.col("id").alias("u")), ["seed", "u"], "left_anti") \
        .groupBy("seed", "u").agg(F.min_by("v", "pp").alias("pivot"))
    lab = P.select("seed", "id", F.col("id").alias("pivot")).unionByName(
        attach.select("seed", F.col("u").alias("id"), "pivot"))
    low = lab.groupBy("seed", "pivot").agg(F.min("id").alias("cluster_id"))
    return lab.join(low, ["seed", "pivot"]).select("seed", "id", "cluster_id")


# ---------------------------------------------------------------------------
# A14-A17 correlation losses
# ---------------------------------------------------------------------------


def _edge_states(edges: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    labels = _beside_edges(labels)
    l1 = labels.select(*key, F.col("id").alias("src"), F.col("cluster_id").alias("cs"))
    l2 = labels.select(*key, F.col("id").alias("dst"), F.col("cluster_id").alias("cd"))
    return edges.join(l1, "src").join(l2, key + ["dst"]) if key else edges.join(l1, "src").join(l2, "dst")


def loss_linear(edges: DataFrame, labels: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Sum of positive weights cut + sum of |negative weights| kept together."""
    key = key or []
    s = _edge_states(edges, labels, key)
    pos_cut = F.when((F.col("weight") >= 0) & (F.col("cs") != F.col("cd")), F.col("weight")).otherwise(F.lit(0.0))
    neg_in = F.when((F.col("weight") < 0) & (F.col("cs") == F.col("cd")), F.abs("weight")).otherwise(F.lit(0.0))
    agg = [F.coalesce(F.sum(pos_cut + neg_in), F.lit(0.0)).alias("loss")]
    return s.groupBy(*key).agg(*agg) if key else s.agg(*agg)


def loss_binary(edges: DataFrame, labels: DataFrame, signs: tuple[str, ...] = ("pos", "neg"),
                key: list[str] | None = None) -> DataFrame:
    """Counted version; NaN when ``signs`` is not pos/neg/both."""
    key = key or []
    s = _edge_states(edges, labels, key)
    pos = F.count_if((F.col("weight") >= 0) & (F.col("cs") != F.col("cd")))
    neg = F.count_if((F.col("weight") < 0) & (F.col("cs") == F.col("cd")))
    sg = list(signs)
    if sg == ["pos", "neg"]:
        loss = pos + neg
    elif sg == ["pos"]:
        loss = pos
    elif sg == ["neg"]:
        loss = neg
    else:
        loss = F.lit(float("nan"))
    agg = [loss.cast("double").alias("loss")]
    return s.groupBy(*key).agg(*agg) if key else s.agg(*agg)


def loss_poles(edges: DataFrame, labels: DataFrame, signs: tuple[str, ...] = ("min", "max"),
               key: list[str] | None = None) -> DataFrame:
    """``edges(src, dst, kind)`` with kind min (should be apart) or max (together)."""
    key = key or []
    s = _edge_states(edges, labels, key)
    lmin = F.count_if((F.col("kind") == "min") & (F.col("cs") == F.col("cd")))
    lmax = F.count_if((F.col("kind") == "max") & (F.col("cs") != F.col("cd")))
    sg = list(signs)
    loss = lmin + lmax if sg == ["min", "max"] else lmin if sg == ["min"] else lmax if sg == ["max"] \
        else F.lit(float("nan"))
    agg = [loss.cast("double").alias("loss")]
    return s.groupBy(*key).agg(*agg) if key else s.agg(*agg)


LOSSES = {"linear_loss": loss_linear, "binary_loss": loss_binary, "binary_loss_poles": loss_poles}


def loss_by_name(name: str):
    """U4: loss registry."""
    try:
        return LOSSES[name]
    except KeyError as exc:
        raise ValueError(f"unknown loss {name!r}") from exc


def best_state(losses: DataFrame) -> DataFrame:
    """The run with the smallest loss (ties: lowest seed)."""
    return losses.orderBy(F.col("loss"), F.col("seed")).limit(1)


def _loss_of_absent(edges: DataFrame, runs: DataFrame, weight: float) -> DataFrame:
    """Loss per seed of the pairs that are not listed, all of weight ``weight`` < 0: the pairs
    inside clusters, counted from the cluster sizes, without the listed ones."""
    size = runs.groupBy("seed", "cluster_id").agg(F.count("*").alias("n"))
    inside = size.groupBy("seed").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("all_in"))
    listed = _edge_states(edges, runs, ["seed"]).groupBy("seed").agg(
        F.count_if(F.col("cs") == F.col("cd")).alias("listed_in"))
    return inside.join(listed, "seed", "left").select(
        "seed", ((F.col("all_in") - F.coalesce("listed_in", F.lit(0))) * F.lit(abs(weight))).alias("absent_loss"))


def correlation_clustering(nodes: DataFrame, edges: DataFrame, seeds: list[int],
                           absent_weight: float = 0.0) -> DataFrame:
    """G5 end to end: pivot runs for each seed plus the component clustering the
    reference starts from; keep the smallest linear loss; split non-positive parts.
    Pairs that are not listed weigh ``absent_weight`` (at most 0): with -1 the graph is the
    full signed one, and no table of all pairs is built.  Output ``(id, cluster_id)``."""
    if absent_weight > 0:
        raise ValueError("absent pairs cannot attract: list the positive ones")
    ids = nb.numbered(nodes)
    if ids is not None and len(ids):
        return _correlation_by_blocks(nodes, ids, edges, seeds, absent_weight)
    # read by the pivot rounds, the components, the losses and the split: materialise once
    edges = cut_lineage(edges.select("src", "dst", "weight"))
    runs = _pivots_by_joins(nodes, edges, seeds)
    cc = components(nodes, edges).select(F.lit(-1).cast("long").alias("seed"), "id", "cluster_id")
    allruns = cut_lineage(runs.unionByName(cc))
    losses = loss_linear(edges, allruns, key=["seed"])
    seeds_df = allruns.select("seed").distinct()
    losses = seeds_df.join(losses, "seed", "left").select("seed", F.coalesce("loss", F.lit(0.0)).alias("loss"))
    if absent_weight:
        losses = losses.join(_loss_of_absent(edges, allruns, absent_weight), "seed").select(
            "seed", (F.col("loss") + F.col("absent_loss")).alias("loss"))
    best = best_state(losses).first()["seed"]
    chosen = allruns.where(F.col("seed") == best).select("id", "cluster_id")
    return split_clusters(chosen, edges)


def _links(blocks: DataFrame, ids: np.ndarray, label: np.ndarray | None = None) -> DataFrame:
    """``(src, dst)`` with the components of the packed neighbours (with ``label``: of those within one label), at most
    one a node and block."""
    held = blocks.sparkSession.sparkContext.broadcast((ids, label))

    def contract(b: nb.Block):
        known, label = held.value
        node = b.nodes()
        some = b.other < node
        if label is not None:
            some &= label[b.other] == label[node]
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(known[x]) for x in _contract(node[some], b.other[some])], names=["src", "dst"])

    links = cut_lineage(nb.each_block(blocks, len(ids), contract, "src long, dst long"))
    held.destroy()
    return links


def _correlation_by_blocks(nodes: DataFrame, ids: np.ndarray, edges: DataFrame, seeds: list[int], absent_weight: float) -> DataFrame:
    """``correlation_clustering`` with the attracting edges stored once, as packed neighbours; the losses read the edges
    from their source again, so that no table of them is stored."""
    edges = edges.select("src", "dst", "weight")
    blocks = nb.neighbour_blocks(_attracting(edges), ids)
    runs = _pivots_by_blocks(nodes, ids, blocks, seeds)
    cc = connected_components(nodes.select("id"), _links(blocks, ids)).select(F.lit(-1).cast("long").alias("seed"), "id", "cluster_id")
    allruns = cut_lineage(runs.unionByName(cc))
    each = [-1, *seeds]
    label = nb.labels_of(allruns, ids, each)
    losses = {r["seed"]: r for r in nb.losses(edges, ids, label, each).collect()}                  # a row a seed
    total = []
    for s, own in zip(each, label):
        loss = losses[s]["loss"] if s in losses else 0.0
        if absent_weight:                            # pairs inside clusters that are not listed
            size = np.unique(own, return_counts=True)[1].astype(float)
            loss += ((size * (size - 1) / 2).sum() - (losses[s]["listed_in"] if s in losses else 0)) * abs(absent_weight)
        total.append((math.inf if math.isnan(loss) else loss, math.isnan(loss), s))                # NaN is last, as in Spark
    best = each.index(min(total)[2])
    return connected_components(nodes.select("id"), _links(blocks, ids, label[best]))


def refine_clusters(labels: DataFrame, edges: DataFrame, digits: int = 9) -> DataFrame:
    """Local search on the linear loss from ``labels(id, cluster_id)``; output the same columns.

    Each round every node finds the cluster (or a cluster of its own) whose edges to it weigh most
    -- one signed aggregate of the edges by neighbour's cluster -- and what a move would gain
    against its present one (ties: the cluster of the lowest id, a new one last).  A node moves if
    none of its neighbours wants to gain more (ties: lower id); two movers share no edge, so the
    loss falls by the sum of their gains, and rounds end when nobody gains.  Sums are rounded to
    ``digits`` so that the order of addition does not decide."""
    edges = edges.where(~F.isnan("weight") & (F.col("weight") != 0) & (F.col("src") != F.col("dst"))).select("src", "dst", "weight")
    ids = nb.numbered(labels)
    if ids is not None and len(ids) and dict(labels.dtypes)["cluster_id"] in nb.WHOLE:
        known = labels.select("id", F.col("cluster_id").cast("long").alias("cluster_id")).toArrow()
        if known.num_rows == len(ids) and not any(c.null_count for c in known.columns):
            return _refine_by_blocks(labels, ids, known, edges, digits)
    e = cut_lineage(edges)
    both = e.select(F.col("src").alias("u"), F.col("dst").alias("v"), "weight").unionByName(
        e.select(F.col("dst").alias("u"), F.col("src").alias("v"), "weight"))
    both = cut_lineage(both)
    lab = cut_lineage(labels.select("id", "cluster_id"))
    while True:
        to = both.join(lab.select(F.col("id").alias("v"), F.col("cluster_id").alias("c")), "v").groupBy("u", "c") \
            .agg(F.round(F.sum("weight"), digits).alias("s"))
        own = F.col("c") == F.col("own")
        pull = to.join(lab.select(F.col("id").alias("u"), F.col("cluster_id").alias("own")), "u")
        best = pull.groupBy("u", "own").agg(
            F.coalesce(F.max(F.when(own, F.col("s"))), F.lit(0.0)).alias("stay"),
            F.max(F.when(~own & (F.col("s") > 0), F.struct("s", (-F.col("c")).alias("c")))).alias("go"))
        gain = F.round(F.coalesce(F.col("go.s"), F.lit(0.0)) - F.col("stay"), digits)
        wish = cut_lineage(best.select("u", gain.alias("gain"), (-F.col("go.c")).alias("to")).where(F.col("gain") > 0))
        if wish.isEmpty():
            return lab
        prio = F.struct("gain", (-F.col("u")).alias("u"))
        rival = both.join(wish.select(F.col("u").alias("v"), prio.alias("p")), "v").groupBy("u").agg(F.max("p").alias("rival"))
        moves = wish.join(rival, "u", "left").where(F.col("rival").isNull() | (prio > F.col("rival"))) \
            .select(F.col("u").alias("id"), F.struct(F.col("to").isNull().alias("new"), F.coalesce("to", "u").alias("c")).alias("name"))
        named = lab.join(moves, "id", "left").select("id", F.coalesce("name", F.struct(F.lit(False).alias("new"), F.col("cluster_id").alias("c"))).alias("name"))
        named = cut_lineage(named, sized=True)
        low = named.groupBy("name").agg(F.min("id").alias("cluster_id"))
        lab = cut_lineage(named.join(low, "name").select("id", "cluster_id"), sized=True)


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Decimal rounding, halves up, as in Spark."""
    scaled = x * 10.0 ** digits
    out = np.rint(scaled) / 10.0 ** digits
    for i in np.flatnonzero(np.abs(np.abs(scaled - np.floor(scaled)) - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _refine_by_blocks(labels: DataFrame, ids: np.ndarray, known: pa.Table, edges: DataFrame, digits: int) -> DataFrame:
    """``refine_clusters`` on packed neighbours with their weights: a round is two passes over them."""
    spark, n = labels.sparkSession, len(ids)
    blocks = nb.neighbour_blocks(edges, ids, weighted=True)
    label = np.empty(n, np.int64)
    label[nb.find(ids, known.column("id").to_numpy())] = known.column("cluster_id").to_numpy()
    while True:
        names, code = np.unique(label, return_inverse=True)
        k = len(names)
        held = spark.sparkContext.broadcast(code.astype(np.int32))

        def wish(b: nb.Block):
            """Of each node that gains by a move: the gain, and to which cluster (-1: one of its own)."""
            code = held.value
            at = (b.nodes() - b.first) * k + code[b.other]
            if nb.BLOCK * k <= nb.CHUNK:                             # few clusters: no need to sort
                sums = np.bincount(at, weights=b.weight, minlength=len(b.degree) * k)
                at = np.flatnonzero(sums)
                sums = _rounded(sums[at], digits)
            else:
                at, which = np.unique(at, return_inverse=True)
                sums = _rounded(np.bincount(which, weights=b.weight, minlength=len(at)), digits)
            node, c = at // k, at % k
            own = c == code[b.first + node]
            stay = np.zeros(len(b.degree))
            stay[node[own]] = sums[own]
            go, to = np.zeros(len(b.degree)), np.full(len(b.degree), -1, np.int64)
            able = np.flatnonzero(~own & (sums > 0))
            able = able[np.lexsort((-c[able], sums[able]))]          # the last of a node counts: most, then the lowest cluster
            go[node[able]], to[node[able]] = sums[able], c[able]
            gain = _rounded(go - stay, digits)
            some = np.flatnonzero(gain > 0)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some + b.first), pa.array(gain[some]), pa.array(to[some])], names=["node", "gain", "to"])

        found = nb.each_block(blocks, n, wish, "node long, gain double, to long").toArrow()
        held.destroy()
        node, gain, to = (found.column(c).to_numpy() for c in ("node", "gain", "to"))
        if not len(node):
            break
        order = np.zeros(n, np.int32)                                # 0: no wish; the highest moves first
        order[node[np.lexsort((-node, gain))]] = np.arange(1, len(node) + 1)
        held = spark.sparkContext.broadcast(order)
        outdone = nb.node_bits(blocks, n, 1, lambda b, _: b.over(np.maximum, held.value, 0) > held.value[b.first:b.first + len(b.degree)])[0]
        held.destroy()
        moves = ~outdone[node]
        code = code.astype(np.int64)
        code[node[moves]] = np.where(to[moves] < 0, k + node[moves], to[moves])
        _, first, which = np.unique(code, return_index=True, return_inverse=True)
        label = ids[first[which]]                                    # the smallest member: ids ascend
    return spark.createDataFrame(pa.table({"id": ids, "cluster_id": label}))
