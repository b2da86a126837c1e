"""Similarity joins (J1-J7), nearest-neighbour windows (W1, W2, O3, O4) and the
candidate filters built on them (P3-P6, P13, P14, A3).

Every question-demo distance table here is produced by ``range_join``: an exact
equi-join on pivot-distance cells instead of a theta/cross join.

* Pick ``m`` pivots (farthest-point heuristic, one small aggregate each).
* For each row compute ``pd_i = |x - p_i|`` and the cell ``floor(pd_i / w)``,
  ``w`` = the radius (plus a relative 1e-9 margin).
* By the triangle inequality two rows within the radius differ by at most one
  cell per pivot, so one side is exploded over the ``3^m`` neighbour cells and
  hash-joined to the other on the cell vector.  ``|pd_i(a) - pd_i(b)| <= w``
  is checked before the exact distance.

Cosine distance works on unit vectors through the chord length
``sqrt(2 * cos_dist)``, which is a true metric; the final test is always the
exact distance in the caller's metric.  Hot cells are spread by AQE's skew-join
split.  k-nearest-neighbour queries without a threshold (``knn_join``) grow the
radius geometrically and stop for each row once it has ``k`` partners, falling
back to the proven maximum distance so nothing is ever cut off.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.vectors import cosine_dist, euclid
from quire.operators.blockpairs import block_pairs_join, block_sets_join, close_pairs
from quire.session import cut_lineage

_EPS = 1e-9


@dataclass(frozen=True)
class Metric:
    """A distance of the caller's: an expression of two ``array<double>`` columns and, if one is known, the
    Euclidean radius that holds every pair within a given radius of it.

    With such a bound the Euclidean range join prunes and the expression decides; without one all
    pairs are evaluated, in bounded blocks."""

    name: str
    distance: Callable[[F.Column, F.Column], F.Column]
    euclid_radius: Callable[[float], float] | None = None


#: sum of absolute differences: at least the Euclidean distance
MANHATTAN = Metric("manhattan", lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x),
                   lambda r: r)

UNROLL_MAX_DIM = 15   # unrolled (codegen) arithmetic below the block engine threshold
SET_ROWS = 512         # questions of a group that one task holds
BLOCK_MIN_DIM = 16   # dense vectors from this dimension on are compared block-wise in numpy


def _sum_terms(terms: list[F.Column]) -> F.Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t          # left to right, the same order as aggregate()
    return out


def dot_expr(a: F.Column, b: F.Column, dim: int | None) -> F.Column:
    """Dot product; unrolled into plain arithmetic (compiled by whole-stage codegen)
    when the dimension is known, else a higher-order aggregate."""
    if dim and dim <= UNROLL_MAX_DIM:
        return _sum_terms([a.getItem(i) * b.getItem(i) for i in range(dim)])
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def sqdist_expr(a: F.Column, b: F.Column, dim: int | None) -> F.Column:
    if dim and dim <= UNROLL_MAX_DIM:
        return _sum_terms([(a.getItem(i) - b.getItem(i)) * (a.getItem(i) - b.getItem(i)) for i in range(dim)])
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def _lit_vec(p: list[float]) -> F.Column:
    return F.array(*[F.lit(float(x)) for x in p])


def _norm(v: F.Column, dim: int | None = None) -> F.Column:
    return F.sqrt(dot_expr(v, v, dim))


def _prep(df: DataFrame, id_col: str, vec_col: str, dim: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, _v, _n)``: the vector and its norm, computed once per row; and the columns to ``keep``."""
    return df.select(F.col(id_col), F.col(vec_col).cast("array<double>").alias("_v"), *keep) \
        .withColumn("_n", F.coalesce(_norm(F.col("_v"), dim), F.lit(0.0)))


def _pivot_dist(metric: str, pivot: list[float]) -> F.Column:
    """Pivot-metric distance of ``_v`` to a pivot: Euclid, or the chord of the unit vectors.
    The pivot is a literal, so the products are unrolled against constants."""
    dim = len(pivot)
    if metric == "euclid":
        if dim <= UNROLL_MAX_DIM:
            return F.sqrt(_sum_terms([(F.col("_v").getItem(i) - F.lit(float(x))) * (F.col("_v").getItem(i) - F.lit(float(x)))
                                      for i, x in enumerate(pivot)]))
        return euclid(F.col("_v"), _lit_vec(pivot))
    if metric == "cosine":
        pn = math.sqrt(sum(float(x) * float(x) for x in pivot)) or 1.0
        if dim <= UNROLL_MAX_DIM:
            d = _sum_terms([F.col("_v").getItem(i) * F.lit(float(x)) for i, x in enumerate(pivot)])
        else:
            d = dot_expr(F.col("_v"), _lit_vec(pivot), None)
        cos = F.coalesce(F.try_divide(d, F.col("_n") * F.lit(pn)), F.lit(0.0))   # zero vector: similarity 0
        return F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) * (F.lit(1.0) - cos)))
    raise ValueError(f"unknown metric {metric!r} (euclid | cosine)")


def _working_radius(metric: str, radius: float) -> float:
    if metric == "cosine":
        return math.sqrt(max(2.0 * radius, 0.0))
    return radius


def _space_distance(metric: str, a: F.Column, b: F.Column) -> F.Column:
    """Distance of two vectors in the metric's space: Euclid, or the chord of the unit vectors."""
    if metric == "euclid":
        return euclid(a, b)
    return F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) * cosine_dist(a, b)))


def choose_pivots(df: DataFrame, id_col: str, n_pivots: int, metric: str = "euclid") -> list[list[float]]:
    """Farthest-point pivots over prepared rows ``(id, _v, _n)`` (one aggregate per pivot)."""
    first = (df.select(F.min_by("_v", F.struct(F.xxhash64(F.col(id_col)), F.col(id_col))).alias("p"),
                       F.min(F.size("_v")).alias("lo"), F.max(F.size("_v")).alias("hi"))
             .first())
    if first is None or first["p"] is None:
        return []
    if first["lo"] != first["hi"]:
        raise ValueError(f"vectors of different lengths ({first['lo']} and {first['hi']}) cannot be compared")
    pivots = [list(first["p"])]
    while len(pivots) < n_pivots:
        dists = [_pivot_dist(metric, p) for p in pivots]
        near = F.least(*dists) if len(dists) > 1 else dists[0]
        row = df.select(F.max_by("_v", F.struct(near, F.col(id_col))).alias("p")).first()
        if row is None or row["p"] is None or list(row["p"]) in pivots:
            break
        pivots.append(list(row["p"]))
    return pivots


def _with_cells(df: DataFrame, pivots: list[list[float]], width: float, metric: str) -> DataFrame:
    for i, p in enumerate(pivots):
        # non-null columns keep Catalyst from inferring (and re-evaluating) IS NOT NULL
        # filters on these expressions; a NULL vector fails the band and exact tests.
        df = df.withColumn(f"_pd{i}", F.coalesce(_pivot_dist(metric, p), F.lit(-1.0e300)))
        df = df.withColumn(f"_c{i}", F.floor(F.col(f"_pd{i}") / F.lit(width)).cast("long"))
    return df


def block_distances(metric: str, L, ln, R, rn):
    """All distances between the rows of two numpy blocks (``ln``, ``rn``: their norms), dimensions
    summed left to right, as the SQL path does."""
    import numpy as np

    if metric == "cosine":
        acc = L[:, 0, None] * R[None, :, 0]
        for j in range(1, L.shape[1]):
            acc += L[:, j, None] * R[None, :, j]
        norms = ln[:, None] * rn[None, :]
        return 1.0 - np.divide(acc, norms, out=np.zeros_like(acc), where=norms > 0)
    t = L[:, 0, None] - R[None, :, 0]
    acc = t * t
    for j in range(1, L.shape[1]):
        t = L[:, j, None] - R[None, :, j]
        acc += t * t
    return np.sqrt(acc)


def _block_fn(metric: str, radius: float, width: float, m: int, self_join: bool, strict: bool):
    """Per (cell, salt) block: all left x right distances with numpy, summing the
    dimensions left to right so values equal the SQL-expression path bit for bit."""
    import numpy as np
    import pandas as pd

    def fn(lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"_lid": pd.Series([], dtype="int64"), "_rid": pd.Series([], dtype="int64"),
                              "dist": pd.Series([], dtype="float64")})
        if lpdf.empty or rpdf.empty:
            return empty
        L = np.stack(lpdf["_v"].to_numpy()).astype("float64", copy=False)
        R = np.stack(rpdf["_v"].to_numpy()).astype("float64", copy=False)
        ok = np.ones((len(L), len(R)), dtype=bool)
        for i in range(m):
            ok &= np.abs(lpdf[f"_pd{i}"].to_numpy()[:, None] - rpdf[f"_pd{i}"].to_numpy()[None, :]) <= width
        lid = lpdf["_lid"].to_numpy()
        rid = rpdf["_rid"].to_numpy()
        if self_join:
            ok &= lid[:, None] < rid[None, :]
        if not ok.any():
            return empty
        li, ri, d = close_pairs(metric, L, lpdf["_n"].to_numpy(), R, rpdf["_n"].to_numpy(), radius, strict, ok)
        return pd.DataFrame({"_lid": lid[li], "_rid": rid[ri], "dist": d})

    return fn


def range_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius: float,
               metric: str | Metric = "euclid", vec_col: str = "vec", self_join: bool = False,
               n_pivots: int = 2, pivots: list[list[float]] | None = None,
               strict: bool = False, engine: str = "auto", block_rows: int = 2048, nearest: int | None = None) -> DataFrame:
    """All pairs with ``dist <= radius`` (``< radius`` if ``strict``): ``(left_id, right_id, dist)``.

    ``left`` is the side replicated over neighbour cells -- pass the smaller one.  ``engine``:
    ``grid`` (pivot cells, compiled arithmetic), ``block`` (pivot cells, numpy blocks), ``tree``
    (partition by nearest centres, see ``centretree``), or ``auto``: the tree for dense vectors
    where a sample shows that it prunes, else all pairs of blocks for dense vectors (``blockpairs``; with
    given ``pivots`` the cells' blocks) and the grid for others.
    With ``self_join`` both inputs describe the same rows and only ``left_id < right_id``
    pairs are returned.  ``nearest``: the caller needs only so many nearest pairs of each left row (of equal distance:
    of the lowest ids), so a task that compares blocks need not give others."""
    if isinstance(metric, Metric):
        return _caller_join(left, right, left_id, right_id, radius, metric, vec_col, self_join, strict, n_pivots, block_rows)
    if metric not in ("euclid", "cosine"):
        raise ValueError(f"unknown metric {metric!r} (euclid | cosine | a Metric)")
    R = _working_radius(metric, radius)
    width = max(R * (1 + _EPS), 1e-12)
    if engine in ("auto", "tree") and pivots is None:
        # imported here: the tree uses the block join below
        from quire.operators.centretree import tree_join

        out = tree_join(left, right, left_id, right_id, radius, metric, vec_col, self_join, strict,
                        block_rows, always=engine == "tree")
        if out is not None:
            return out
    if engine == "auto" and pivots is None:
        out = block_pairs_join(left, right, left_id, right_id, radius, metric, vec_col, self_join, strict, BLOCK_MIN_DIM, nearest)
        if out is not None:
            return out
    if pivots is None:
        pivots = choose_pivots(_prep(right, right_id, vec_col), right_id, n_pivots, metric)
        if not pivots:
            return left.sparkSession.createDataFrame(
                [], f"{left_id} long, {right_id} long, dist double")
    m = len(pivots)
    dim = len(pivots[0])
    lw = _prep(left, left_id, vec_col, dim)
    rw = _prep(right, right_id, vec_col, dim)
    lc = _with_cells(lw, pivots, width, metric)
    rc = _with_cells(rw, pivots, width, metric)
    offsets = [list(o) for o in itertools.product((-1, 0, 1), repeat=m)]
    off_arr = F.array(*[F.array(*[F.lit(x) for x in o]) for o in offsets])
    if engine == "block" or (engine == "auto" and dim >= BLOCK_MIN_DIM):
        return _range_join_blocks(lc, rc, left_id, right_id, off_arr, m, metric, radius, width, self_join,
                                  strict, block_rows)
    cand = _grid_candidates(lc, rc, left_id, right_id, off_arr, m, width, self_join)
    # exact distance in the caller's metric, on the original vectors
    if metric == "cosine":
        d = F.lit(1.0) - F.coalesce(F.try_divide(dot_expr(F.col("_lv"), F.col("_rv"), dim), F.col("_ln") * F.col("_rn")), F.lit(0.0))
    else:
        d = F.sqrt(sqdist_expr(F.col("_lv"), F.col("_rv"), dim))
    out = cand.select(F.col("_lid").alias(left_id), F.col("_rid").alias(right_id), d.alias("dist"))
    return out.where(F.col("dist") < radius if strict else F.col("dist") <= radius)


def range_links(points: DataFrame, id_col: str, radius: float, metric: str = "euclid", vec_col: str = "vec", n_pivots: int = 2) -> DataFrame:
    """``(src, dst)`` links that connect all rows that the pairs of ``range_join`` connect.  Blocks of dense vectors are
    contracted where they are compared, so that their pairs are neither moved nor stored."""
    from quire.operators.centretree import tree_join
    from quire.operators.graph import star_edges

    other = points.withColumnRenamed(id_col, "_id2")
    pairs = tree_join(points, other, id_col, "_id2", radius, metric, vec_col, True, False, 2048, always=False)
    if pairs is None:
        links = block_pairs_join(points, points, id_col, id_col, radius, metric, vec_col, True, False, BLOCK_MIN_DIM, links=True)
        if links is not None:
            return star_edges(links)
        pairs = range_join(points, other, id_col, "_id2", radius, metric=metric, vec_col=vec_col, self_join=True, n_pivots=n_pivots)
    return star_edges(pairs, id_col, "_id2")


def _grid_candidates(lc: DataFrame, rc: DataFrame, left_id: str, right_id: str, off_arr, m: int, width: float, self_join: bool,
                     l_keep: tuple[str, ...] = (), r_keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows that meet in neighbour cells and whose pivot distances differ by at most ``width``, with their vectors."""
    lx = lc.select("*", F.explode(off_arr).alias("_off"))
    for i in range(m):
        lx = lx.withColumn(f"_k{i}", F.col(f"_c{i}") + F.col("_off")[i])
    lx = lx.drop("_off")
    l_cols = [F.col(left_id).alias("_lid"), F.col("_v").alias("_lv"), F.col("_n").alias("_ln"), *l_keep] + \
        [F.col(f"_pd{i}").alias(f"_lpd{i}") for i in range(m)] + [F.col(f"_k{i}") for i in range(m)]
    r_cols = [F.col(right_id).alias("_rid"), F.col("_v").alias("_rv"), F.col("_n").alias("_rn"), *r_keep] + \
        [F.col(f"_pd{i}").alias(f"_rpd{i}") for i in range(m)] + \
        [F.col(f"_c{i}").alias(f"_k{i}") for i in range(m)]
    cand = lx.select(*l_cols).join(rc.select(*r_cols), [f"_k{i}" for i in range(m)])
    if self_join:
        cand = cand.where(F.col("_lid") < F.col("_rid"))
    band = None
    for i in range(m):
        c = F.abs(F.col(f"_lpd{i}") - F.col(f"_rpd{i}")) <= F.lit(width)
        band = c if band is None else (band & c)
    return cand.where(band)


def _near_sets(a: DataFrame, b: DataFrame, radius: float, dim: int, self_join: bool, n_pivots: int) -> DataFrame:
    """``_lid, _rid, _a, _b`` of the rows of ``a(_lid, _a)`` and ``b(_rid, _b)`` within Euclid's ``radius``: the grid join
    with the vectors kept, so that no table of pairs is moved to fetch them.  An id that repeats has all its vectors."""
    a = a.join(a.groupBy("_lid").agg(F.collect_list("_a").alias("_as")), "_lid")
    b = b.join(b.groupBy("_rid").agg(F.collect_list("_b").alias("_bs")), "_rid")
    pivots = choose_pivots(_prep(b, "_rid", "_b"), "_rid", n_pivots)
    width = max(radius * (1 + _EPS), 1e-12)
    offsets = F.array(*[F.array(*[F.lit(x) for x in o]) for o in itertools.product((-1, 0, 1), repeat=len(pivots))])
    lc = _with_cells(_prep(a, "_lid", "_a", dim, ("_as",)), pivots, width, "euclid")
    rc = _with_cells(_prep(b, "_rid", "_b", dim, ("_bs",)), pivots, width, "euclid")
    met = _grid_candidates(lc, rc, "_lid", "_rid", offsets, len(pivots), width, self_join, ("_as",), ("_bs",)) \
        .where(F.sqrt(sqdist_expr(F.col("_lv"), F.col("_rv"), dim)) <= radius)
    return met.select("_lid", "_rid", F.explode("_as").alias("_a"), "_bs").select("_lid", "_rid", "_a", F.explode("_bs").alias("_b"))


def _caller_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius: float, metric: Metric, vec_col: str,
                 self_join: bool, strict: bool, n_pivots: int, block_rows: int) -> DataFrame:
    """Range join under a caller's distance."""
    a = left.select(F.col(left_id).alias("_lid"), F.col(vec_col).cast("array<double>").alias("_a")).where("_a is not null")
    b = right.select(F.col(right_id).alias("_rid"), F.col(vec_col).cast("array<double>").alias("_b")).where("_b is not null")
    if metric.euclid_radius is not None:
        reach = metric.euclid_radius(radius) * (1 + _EPS) + 1e-12
        dim = b.where("_rid is not null").select(F.max(F.size("_b"))).first()[0] or 0
        if 0 < dim < BLOCK_MIN_DIM:
            met = _near_sets(a, b, reach, dim, self_join, n_pivots)
        else:
            near = range_join(a.withColumnRenamed("_a", "vec"), b.withColumnRenamed("_b", "vec"), "_lid", "_rid", reach,
                              self_join=self_join, n_pivots=n_pivots)
            met = near.select("_lid", "_rid").join(a, "_lid").join(b, "_rid")
    else:
        n_left, n_right = (max(1, -(-d.count() // block_rows)) for d in (a, b))
        met = a.select("*", F.pmod(F.xxhash64("_lid"), F.lit(n_left)).alias("_ls"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_right - 1).cast("long"))).alias("_rs")) \
            .join(b.select("*", F.pmod(F.xxhash64("_rid"), F.lit(n_right)).alias("_rs"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_left - 1).cast("long"))).alias("_ls")),
                  ["_ls", "_rs"])
        if self_join:
            met = met.where(F.col("_lid") < F.col("_rid"))
    out = met.select(F.col("_lid").alias(left_id), F.col("_rid").alias(right_id), metric.distance(F.col("_a"), F.col("_b")).alias("dist"))
    return out.where(F.col("dist") < radius if strict else F.col("dist") <= radius)


def block_join(lx: DataFrame, rx: DataFrame, keys: list[str], left_id: str, right_id: str, metric: str, radius: float,
               n_bands: int = 0, width: float = 0.0, self_join: bool = False, strict: bool = False,
               block_rows: int = 2048) -> DataFrame:
    """Pairs within the radius among rows that meet on ``keys``, as numpy blocks: ``cogroup``
    on (keys, left salt, right salt).

    ``lx(_lid, _v, _n, _pd0.., keys)`` and ``rx(_rid, ...)`` hold a row for every key a vector is
    found under.  Salt counts are per key and per side: the left rows of a key are split into
    ``sL = ceil(nL / block_rows)`` parts and its right rows into ``sR = ceil(nR / block_rows)``
    parts; each left part meets each right part once.  Every block is at most about
    ``block_rows`` x ``block_rows``, a lopsided key replicates only its small side, and
    ordinary keys are not replicated at all."""
    pds = [f"_pd{i}" for i in range(n_bands)]
    n_left = lx.groupBy(*keys).agg(F.count("*").alias("_nl"))
    n_right = rx.groupBy(*keys).agg(F.count("*").alias("_nr"))
    # keys reached from both sides only; one row per key
    salt_of = n_left.join(n_right, keys).select(
        *keys, F.ceil(F.col("_nl") / F.lit(block_rows)).cast("int").alias("_sl"),
        F.ceil(F.col("_nr") / F.lit(block_rows)).cast("int").alias("_sr"))
    L = lx.join(salt_of, keys).select(
        "_lid", "_v", "_n", *pds, *keys,
        F.pmod(F.xxhash64("_lid"), F.col("_sl")).cast("int").alias("_ls"),
        F.explode(F.sequence(F.lit(0), F.col("_sr") - 1)).alias("_rs"))
    R = rx.join(salt_of, keys).select(
        "_rid", "_v", "_n", *pds, *keys,
        F.explode(F.sequence(F.lit(0), F.col("_sl") - 1)).alias("_ls"),
        F.pmod(F.xxhash64("_rid"), F.col("_sr")).cast("int").alias("_rs"))
    gk = keys + ["_ls", "_rs"]
    out = L.groupBy(*gk).cogroup(R.groupBy(*gk)).applyInPandas(
        _block_fn(metric, radius, width, n_bands, self_join, strict), "_lid long, _rid long, dist double")
    return out.select(F.col("_lid").alias(left_id), F.col("_rid").alias(right_id), "dist")


def _range_join_blocks(lc: DataFrame, rc: DataFrame, left_id: str, right_id: str, off_arr, m: int,
                       metric: str, radius: float, width: float, self_join: bool, strict: bool,
                       block_rows: int) -> DataFrame:
    """Join of the pivot-distance cells in blocks: the left rows go to their neighbour cells."""
    keys = [f"_k{i}" for i in range(m)]
    pds = [f"_pd{i}" for i in range(m)]
    Lx = lc.select(F.col(left_id).alias("_lid"), "_v", "_n", *pds, *[f"_c{i}" for i in range(m)],
                   F.explode(off_arr).alias("_off"))
    Lx = Lx.select("_lid", "_v", "_n", *pds, *[(F.col(f"_c{i}") + F.col("_off")[i]).alias(f"_k{i}") for i in range(m)])
    Rx = rc.select(F.col(right_id).alias("_rid"), "_v", "_n", *pds, *[F.col(f"_c{i}").alias(f"_k{i}") for i in range(m)])
    return block_join(Lx, Rx, keys, left_id, right_id, metric, radius, m, width, self_join, strict, block_rows)


def max_distance_bound(df: DataFrame, metric: str, vec_col: str = "vec") -> float:
    """A proven upper bound of any pairwise distance among ``df`` rows."""
    if metric == "cosine":
        return 2.0
    row = df.select(F.max(F.sqrt(F.aggregate(F.col(vec_col), F.lit(0.0), lambda a, x: a + x * x)))
                    .alias("r")).first()
    r = row["r"] if row and row["r"] is not None else 0.0
    return 2.0 * float(r) * (1 + 1e-6) + 1e-9


def top_k(pairs: DataFrame, key: str, other: str, k: int, order_col: str = "dist") -> DataFrame:
    """The ``k`` smallest ``order_col`` per ``key`` (ties by ``other``).

    ``row_number() <= k`` lets Catalyst insert a partial WindowGroupLimit before
    the shuffle, so a hot key ships at most ``k`` rows per map partition."""
    w = W.partitionBy(key).orderBy(F.col(order_col), F.col(other))
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, k: int,
             metric: str = "euclid", vec_col: str = "vec", start_radius: float | None = None,
             n_pivots: int = 2, checkpoint: bool = True, sample_size: int = 32) -> DataFrame:
    """Exact ``k`` nearest ``right`` rows for every ``left`` row (no distance threshold).

    Dense vectors that no bound prunes are compared once, all pairs in blocks that keep a row's ``k`` nearest.
    Others by radius doubling: a left row is settled as soon as it has ``k`` partners within the
    current radius (its k nearest must then all lie inside it); the last step uses the
    proven maximum distance, so every row is settled.  Output: ``left_id, right_id,
    dist, rank``."""
    spark = left.sparkSession
    max_d = max(max_distance_bound(left, metric, vec_col), max_distance_bound(right, metric, vec_col)) \
        if metric == "euclid" else 2.0
    # loop invariant: the right side is read by every round
    right = cut_lineage(right.select(F.col(right_id), F.col(vec_col))) if checkpoint else \
        right.select(F.col(right_id), F.col(vec_col)).cache()
    if not start_radius:
        near = block_pairs_join(left, right, left_id, right_id, max_d, metric, vec_col, False, False, BLOCK_MIN_DIM, nearest=k)
        if near is not None:
            return top_k(near, left_id, right_id, k)
    pivots = choose_pivots(_prep(right, right_id, vec_col), right_id, n_pivots, metric)
    if not pivots:
        return left.sparkSession.createDataFrame(
            [], f"{left_id} long, {right_id} long, dist double, rank int")
    if start_radius:
        r = start_radius
    else:
        # exact k-th neighbour distance of a fixed-size hash sample of the left rows
        # (bounded work: sample_size x right) -- most rows settle in the first round
        sample = left.select(left_id, vec_col).orderBy(F.xxhash64(F.col(left_id)), F.col(left_id)).limit(sample_size)
        sp = range_join(sample, right, left_id, right_id, max_d, metric=metric, vec_col=vec_col, pivots=pivots)
        row = top_k(sp, left_id, right_id, k).groupBy(left_id).agg(F.max("dist").alias("_kd")) \
            .agg(F.max("_kd").alias("r")).first()
        r = float(row["r"]) * (1 + 1e-9) if row and row["r"] is not None else max_d / 16.0
        r = max(r, max_d / 1024.0)
    pending = left.select(left_id, vec_col)
    results = []
    while True:
        last = r >= max_d
        pairs = range_join(pending, right, left_id, right_id, min(r, max_d), metric=metric,
                           vec_col=vec_col, pivots=pivots)
        # one evaluation of the join per round: the top k within r of every pending row;
        # a row is settled once it has k of them (its k nearest all lie inside r)
        ranked = top_k(pairs, left_id, right_id, k)
        ranked = cut_lineage(ranked) if checkpoint else ranked.cache()
        if last:
            results.append(ranked)
            break
        settled = ranked.where(F.col("rank") == k).select(left_id)
        results.append(ranked.join(settled, left_id, "left_semi"))
        pending = pending.join(settled, left_id, "left_anti")
        pending = cut_lineage(pending) if checkpoint else pending.cache()
        if pending.isEmpty():
            break
        r *= 2.0
    out = results[0]
    for x in results[1:]:
        out = out.unionByName(x)
    return out


# ---------------------------------------------------------------------------
# kNN cover and candidate filters
# ---------------------------------------------------------------------------

def pair_distances(questions: DataFrame, demos: DataFrame, radius: float, metric: str | Metric,
                   vec_col: str = "vec", n_pivots: int = 2, nearest: int | None = None) -> DataFrame:
    """``(ques_id, demo_id, dist)`` for every pair within ``radius`` (``nearest``: at least so many of a demo's
    nearest ones, if the caller needs no others)."""
    return range_join(demos, questions, "demo_id", "ques_id", radius, metric=metric, vec_col=vec_col,
                      n_pivots=n_pivots, nearest=nearest).select("ques_id", "demo_id", "dist")


def pair_counts(questions: DataFrame, demos: DataFrame, radius: float, metric: str, vec_col: str = "vec") -> DataFrame:
    """``(ques_id, n)``: the pairs of ``pair_distances`` of every question that has any.  Blocks of dense vectors are counted
    where they are compared."""
    n = block_pairs_join(demos, questions, "demo_id", "ques_id", radius, metric, vec_col, False, False, BLOCK_MIN_DIM, counts=True)
    if n is None:
        return pair_distances(questions, demos, radius, metric, vec_col).groupBy("ques_id").agg(F.count("*").alias("n"))
    return n.groupBy("ques_id").agg(F.sum("n").alias("n"))


def duplicate_share(questions: DataFrame, demos: DataFrame, vec_col: str = "vec") -> float:
    """Share of rows whose vector repeats another one (one HyperLogLog aggregate)."""
    both = questions.select(F.col(vec_col).alias("v")).unionByName(demos.select(F.col(vec_col).alias("v")))
    row = both.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("v"), 0.02).alias("d")).first()
    n = row["n"] or 0
    return 0.0 if n == 0 else max(0.0, 1.0 - float(row["d"]) / n)


def knn_cover(questions: DataFrame, demos: DataFrame, k1: float, upper_ques: int, metric: str,
              vec_col: str = "vec", n_pivots: int = 2, dedup: bool | str = "auto") -> DataFrame:
    """Each demo keeps its ``upper_ques`` nearest questions with ``dist <= k1``
    (ties by ques_id).  Output ``(ques_id, demo_id, dist, rank)``.

    ``dedup`` joins distinct vectors only: feature vectors of entity pairs repeat a
    lot, and the pairs within the threshold are the cost.  Per demo vector the
    ``k`` nearest question vectors (all ties kept) can hold the answer, and each
    of them contributes at most its ``k`` smallest ids, so the result is exact.
    ``dedup="auto"`` takes that path when at least a fifth of the vectors repeat."""
    if dedup == "auto":
        dedup = duplicate_share(questions, demos, vec_col) >= 0.2
    if not dedup:
        pairs = pair_distances(questions, demos, k1, metric, vec_col, n_pivots, nearest=upper_ques)
        return top_k(pairs, "demo_id", "ques_id", upper_ques).select("ques_id", "demo_id", "dist", "rank")
    k = upper_ques
    q = questions.select("ques_id", F.col(vec_col).alias("vec"))
    d = demos.select("demo_id", F.col(vec_col).alias("vec"))
    qv = q.groupBy("vec").agg(F.min("ques_id").alias("qk"))
    dv = d.groupBy("vec").agg(F.min("demo_id").alias("dk"))
    qmap = q.join(qv, "vec").select("qk", "ques_id")
    dmap = d.join(dv, "vec").select("dk", "demo_id")
    vp = range_join(dv, qv, "dk", "qk", k1, metric=metric, n_pivots=n_pivots)
    near = vp.withColumn("_r", F.rank().over(W.partitionBy("dk").orderBy("dist"))).where(F.col("_r") <= k)
    ids = qmap.withColumn("_i", F.row_number().over(W.partitionBy("qk").orderBy("ques_id"))) \
        .where(F.col("_i") <= k).select("qk", "ques_id")
    cand = near.join(ids, "qk").select("dk", "ques_id", "dist")
    best = top_k(cand, "dk", "ques_id", k)
    return best.join(dmap, "dk").select("ques_id", "demo_id", "dist", "rank")


def filter_candidates(questions: DataFrame, demos: DataFrame, cover: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions that are in some demo's kNN cover, demos that have one."""
    q = questions.join(cover.select("ques_id").distinct(), "ques_id", "left_semi")
    d = demos.join(cover.select("demo_id").distinct(), "demo_id", "left_semi")
    return q, d


def filter_demos_within(demos: DataFrame, pairs: DataFrame) -> DataFrame:
    """P5: demos with any question within the threshold (``pairs`` already thresholded)."""
    return demos.join(pairs.select("demo_id"), "demo_id", "left_semi")


def group_coverage(pairs: DataFrame, groups_long: DataFrame) -> DataFrame:
    """Per (group, demo) the group's questions within the threshold of the demo.

    Sets are bounded by the group size (a group fits one prompt)."""
    j = pairs.join(groups_long.select("group_id", "ques_id"), "ques_id")
    return j.groupBy("group_id", "demo_id").agg(F.sort_array(F.collect_set("ques_id")).alias("ques"))


def group_coverage_within(questions: DataFrame, demos: DataFrame, groups_long: DataFrame, radius: float, metric: str,
                          vec_col: str = "vec") -> DataFrame:
    """P6 of the pairs of ``pair_distances``: ``group_coverage`` without a table of them where vectors are compared in blocks.

    A group's questions meet each demo in one task.  Groups of more than ``SET_ROWS`` questions, and demos whose id
    repeats, go through the pairs."""
    groups = groups_long.select("group_id", "ques_id")
    members = questions.select("ques_id", F.col(vec_col).alias("vec")).join(groups, "ques_id")
    d = demos.select("demo_id", F.col(vec_col).alias("vec"))
    large = cut_lineage(members.groupBy(F.col("group_id").alias("_g")).agg(F.count("*").alias("_n")).where(F.col("_n") > SET_ROWS).select("_g"))
    again = cut_lineage(d.groupBy(F.col("demo_id").alias("_d")).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select("_d"))
    is_large, repeats = F.col("group_id").eqNullSafe(F.col("_g")), F.col("demo_id").eqNullSafe(F.col("_d"))
    any_large, any_again = not large.isEmpty(), not again.isEmpty()
    few = members.join(large, is_large, "left_anti") if any_large else members
    once = d.join(again, repeats, "left_anti") if any_again else d
    sets = block_sets_join(once, few.select("group_id", "ques_id", "vec"), "demo_id", "ques_id", "group_id", radius, metric, "vec", BLOCK_MIN_DIM)
    if sets is None:
        return group_coverage(pair_distances(questions, demos, radius, metric, vec_col), groups)
    out = sets.select("group_id", "demo_id", F.col("ids").alias("ques"))
    if any_large:
        its = groups.join(large, is_large, "left_semi")
        q = questions.join(its.select("ques_id"), "ques_id", "left_semi")
        out = out.unionByName(group_coverage(pair_distances(q, demos, radius, metric, vec_col), its))
    if any_again:
        its = groups.join(large, is_large, "left_anti") if any_large else groups
        out = out.unionByName(group_coverage(pair_distances(questions, demos.join(again, repeats, "left_semi"), radius, metric, vec_col), its))
    return out


def topup_cover(cover: DataFrame, questions: DataFrame, demos: DataFrame, cover_cnt: int, metric: str,
                vec_col: str = "vec") -> DataFrame:
    """Every question gets its nearest not-yet-assigned demos until it has ``cover_cnt``.

    The ``cover_cnt`` nearest demos overall always contain the needed nearest
    unassigned ones, so one exact kNN join suffices."""
    have = cover.groupBy("ques_id").agg(F.count("*").alias("_have"))
    near = knn_join(questions, demos, "ques_id", "demo_id", cover_cnt, metric=metric, vec_col=vec_col)
    fresh = near.join(cover.select("ques_id", "demo_id"), ["ques_id", "demo_id"], "left_anti")
    w = W.partitionBy("ques_id").orderBy("dist", "demo_id")
    fresh = fresh.withColumn("_r", F.row_number().over(w)).join(have, "ques_id", "left") \
        .where(F.col("_r") <= F.lit(cover_cnt) - F.coalesce(F.col("_have"), F.lit(0)))
    return cover.select("ques_id", "demo_id", "dist").unionByName(fresh.select("ques_id", "demo_id", "dist"))


def dist_percentile(questions: DataFrame, demos: DataFrame, p: float, metric: str,
                    vec_col: str = "vec", small_k: int = 64) -> DataFrame:
    """A3: per question the ``p`` quantile (linear interpolation) of its distances to all demos.
    Output ``(ques_id, pct)``.

    The ``floor((n-1)p)+2`` nearest demos decide it: if these are at most ``small_k``, an exact
    kNN join finds them; otherwise distances are only counted, in histograms that are refined
    until they hold the two order statistics (``quantile.order_statistics``), so nothing that
    grows with the demos is kept per question."""
    from quire.operators.quantile import order_statistics

    n = demos.where(F.col(vec_col).isNotNull()).count()
    if n == 0:
        return questions.sparkSession.createDataFrame([], "ques_id long, pct double")
    h = (n - 1) * p
    lo = int(math.floor(h))
    k = min(lo + 2, n)
    frac = h - lo
    if k <= small_k:
        near = knn_join(questions, demos, "ques_id", "demo_id", k, metric=metric, vec_col=vec_col)
        agg = near.groupBy("ques_id").agg(
            F.max(F.when(F.col("rank") == lo + 1, F.col("dist"))).alias("_a"),
            F.max(F.when(F.col("rank") == lo + 2, F.col("dist"))).alias("_b"))
    else:
        found = order_statistics(questions, demos, [lo + 1, k], metric, vec_col)
        agg = found.groupBy("ques_id").agg(F.max(F.when(F.col("rank") == lo + 1, F.col("dist"))).alias("_a"),
                                           F.max(F.when(F.col("rank") == lo + 2, F.col("dist"))).alias("_b"))
    pct = F.when(F.col("_b").isNull(), F.col("_a")).otherwise(F.col("_a") + F.lit(frac) * (F.col("_b") - F.col("_a")))
    return agg.select("ques_id", pct.alias("pct"))


def cover_percentile(questions: DataFrame, demos: DataFrame, p: float, metric: str,
                     vec_col: str = "vec", counted: bool = False) -> tuple[float, DataFrame]:
    """threshold = max over questions of A3; cover = all pairs within it (``counted``: their number a question)."""
    row = dist_percentile(questions, demos, p, metric, vec_col).agg(F.max("pct").alias("t")).first()
    thr = float(row["t"]) if row and row["t"] is not None else 0.0
    return thr, (pair_counts if counted else pair_distances)(questions, demos, thr, metric, vec_col)
