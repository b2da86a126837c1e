"""Exact range join of dense vectors over a two-level tree of centres.

The right vectors belong to the nearest of K1 coarse centres and, below it, to the nearest of
K2 fine ones: a leaf.  Each node knows its covering radius.  A left vector x is sent to the
leaves that can hold a partner within r, and to no others:

* ball bound: every y of a node is within its radius R of the centre c, so
  ``d(x, y) >= d(x, c) - R``;
* hyperplane bound: every y of a node is nearer to its centre c than to a sibling c', so for an
  x nearer to c' ``d(x, y) >= (d(x, c)^2 - d(x, c')^2) / (2 d(c, c'))``.

Coarse nodes are pruned first, then the leaves of those that remain; only then do vectors
move, one copy for each remaining leaf, into the block join (salted by the leaf's size, so a
dense leaf is cut into bounded blocks).  Bounds carry a small margin for rounding and the block
join decides by the exact distance, so the result is that of any other engine.

Centres come from a sample of ``SAMPLE`` rows (the smallest hashes of the ids) and are refined
by a few k-means steps on the driver; node sizes and radii are one aggregate.  What the driver
holds is bounded by the parameters (K1 * K2 rows), not by the data.  Where the sample shows
that the bounds would keep most pairs -- vectors without clusters in many dimensions -- there is
nothing to gain and ``tree_join`` says so by returning None.

Cosine distance uses unit vectors and the chord ``sqrt(2 d)``; zero vectors have similarity 0
to everything, so they stay apart in a leaf of their own that every left vector reaches when
``r`` admits distance 1, and as left vectors reach every leaf then.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 2048          # rows that the centres are fitted on
COARSE, FINE = 32, 32  # nodes of the two levels at most
MIN_DIM = 16           # below it the grid of pivot cells is better
KEEP_AT_MOST = 0.5     # share of pairs left by the bounds above which the tree is not used
_MARGIN = 1e-6         # of a distance, for rounding in the matrix products
ZERO_LEAF = -1


def _rows(vectors: pd.Series | list) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.sqrt((x * x).sum(axis=1))
    return x / np.where(n > 0, n, 1.0)[:, None], n == 0


def _dist(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All distances between rows of ``x`` and of ``c``."""
    sq = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2.0 * (x @ c.T)
    return np.sqrt(np.maximum(sq, 0.0))


def _means(x: np.ndarray, k: int, steps: int = 6) -> np.ndarray:
    """k centres: farthest-point start, then k-means steps; fewer if there are fewer distinct rows."""
    centres = [x[0]]
    near = _dist(x, x[:1])[:, 0]
    while len(centres) < k and near.max() > 1e-9:
        centres.append(x[int(near.argmax())])
        near = np.minimum(near, _dist(x, centres[-1][None])[:, 0])
    c = np.stack(centres)
    for _ in range(steps):
        own = _dist(x, c).argmin(axis=1)
        size = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


@dataclass
class CentreTree:
    """Centres (coarse: K1 rows; fine: one array for each coarse node) and radii."""

    metric: str
    coarse: np.ndarray
    fine: list[np.ndarray]
    coarse_radius: np.ndarray | None = None
    fine_radius: list[np.ndarray] | None = None

    def vectors(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Rows in the metric's space, and which of them are zero vectors of the cosine metric."""
        x = _rows(column)
        return _unit(x) if self.metric == "cosine" else (x, np.zeros(len(x), bool))

    def leaf(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaf number (coarse * FINE + fine), distance to the coarse centre, to the fine centre."""
        d = _dist(x, self.coarse)
        own = d.argmin(axis=1)
        node, away = np.zeros(len(x), np.int64), np.zeros(len(x))
        for i in np.unique(own):
            at = np.flatnonzero(own == i)
            e = _dist(x[at], self.fine[i])
            f = e.argmin(axis=1)
            node[at], away[at] = i * FINE + f, e[np.arange(len(at)), f]
        return node, d[np.arange(len(x)), own], away

    def with_radii(self, leaf: np.ndarray, coarse: np.ndarray, fine: np.ndarray) -> CentreTree:
        """The tree with covering radii: greatest distance to the coarse and fine centre by leaf."""
        top = np.full(len(self.coarse), -np.inf)
        low = [np.full(len(c), -np.inf) for c in self.fine]
        np.maximum.at(top, leaf // FINE, coarse)
        for n, r in zip(leaf.tolist(), fine.tolist()):
            low[n // FINE][n % FINE] = max(low[n // FINE][n % FINE], r)
        return CentreTree(self.metric, self.coarse, self.fine, top, low)

    def reach(self, x: np.ndarray, radius: float) -> np.ndarray:
        """Which leaves may hold a partner: a row for each vector, a column for each leaf number."""
        scale = float(np.abs(x).max(initial=0.0)) + float(np.abs(self.coarse).max()) + radius
        r = radius + _MARGIN * scale
        out = np.zeros((len(x), len(self.coarse) * FINE), dtype=bool)
        d = _dist(x, self.coarse)
        ok = _reachable(d, self.coarse, self.coarse_radius, r)
        for j in np.flatnonzero(ok.any(axis=0)):
            at = np.flatnonzero(ok[:, j])
            e = _dist(x[at], self.fine[j])
            out[at, j * FINE: j * FINE + len(self.fine[j])] = _reachable(e, self.fine[j], self.fine_radius[j], r)
        return out


def _reachable(d: np.ndarray, centres: np.ndarray, radii: np.ndarray, r: float) -> np.ndarray:
    """Siblings that both bounds leave; ``d``: distances of the vectors to their centres."""
    ball = d - radii[None, :] <= r
    own = d.argmin(axis=1)
    between = _dist(centres, centres)[own]
    gap = d * d - (d[np.arange(len(d)), own] ** 2)[:, None]
    return ball & (gap <= 2.0 * r * between)      # equal centres: gap 0, never pruned


def fit(sample: np.ndarray, metric: str, coarse: int = COARSE, fine: int = FINE) -> CentreTree:
    top = _means(sample, min(coarse, max(1, len(sample) // 8)))
    own = _dist(sample, top).argmin(axis=1)
    low = [_means(sample[own == i], min(fine, max(1, int((own == i).sum()) // 4))) if (own == i).any() else top[i:i + 1]
           for i in range(len(top))]
    return CentreTree(metric, top, low)


def kept_share(tree: CentreTree, right: np.ndarray, left: np.ndarray, radius: float) -> float:
    """Share of the pairs of two samples that the bounds leave (radii of the right sample)."""
    leaf, a, b = tree.leaf(right)
    size = np.bincount(leaf, minlength=len(tree.coarse) * FINE)
    return float((tree.with_radii(leaf, a, b).reach(left, radius) @ size).sum()) / (len(left) * len(right))


def _space_radius(metric: str, radius: float) -> float:
    return float(np.sqrt(max(2.0 * radius, 0.0))) if metric == "cosine" else radius


def _sample(df: DataFrame, id_col: str, vec_col: str, rows: int) -> list:
    picked = df.where(F.col(vec_col).isNotNull()).select(vec_col, F.xxhash64(F.col(id_col)).alias("_h"), F.col(id_col).alias("_i")) \
        .orderBy("_h", "_i").limit(rows)
    return [r[0] for r in picked.select(vec_col).collect()]       # bounded by ``rows``


def build_tree(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius: float, metric: str,
               vec_col: str = "vec", always: bool = False) -> CentreTree | None:
    """A tree over the right vectors without radii, or None if a sample shows no use for it."""
    got = _sample(right, right_id, vec_col, SAMPLE)
    if not got or (not always and len(got[0]) < MIN_DIM):
        return None
    if len({len(v) for v in got}) > 1:
        raise ValueError("vectors of different lengths cannot be compared")
    tree = CentreTree(metric, np.zeros((1, len(got[0]))), [])
    x, zero = tree.vectors(got)
    x = x[~zero]
    if not len(x):
        return None
    tree = fit(x, metric)
    if not always:
        y = _sample(left, left_id, vec_col, SAMPLE // 8)
        if not y:
            return None
        y, _ = tree.vectors(y)
        if kept_share(tree, x, y, _space_radius(metric, radius)) > KEEP_AT_MOST:
            return None
    return tree


def _placed(tree: CentreTree, df: DataFrame, vec: str) -> DataFrame:
    """``df`` with ``_at``: leaf and the distances to its centres."""
    kind = T.StructType([T.StructField("leaf", T.LongType()), T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())])

    @F.pandas_udf(kind)
    def place(v: pd.Series) -> pd.DataFrame:
        x, zero = tree.vectors(v)
        leaf, a, b = tree.leaf(x)
        return pd.DataFrame({"leaf": np.where(zero, ZERO_LEAF, leaf), "a": a, "b": b})

    return df.withColumn("_at", place(vec))


def _reached(tree: CentreTree, df: DataFrame, vec: str, radius: float, coarse: bool = False) -> DataFrame:
    """``df`` with ``_k0`` for every leaf (or ``coarse`` node) that a vector may have partners in."""
    wide = tree.metric == "cosine" and radius >= 1.0
    reach = _space_radius(tree.metric, radius)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def leaves(v: pd.Series) -> pd.Series:
        x, zero = tree.vectors(v)
        ok = tree.reach(x, reach)
        if wide:
            ok[zero] = True
        else:
            ok[zero] = False
        extra = [ZERO_LEAF] if wide else []
        if coarse:
            ok = ok.reshape(len(ok), -1, FINE).any(axis=2)
        return pd.Series([extra + np.flatnonzero(o).tolist() for o in ok])

    return df.withColumn("_k0", F.explode(leaves(vec)))


def _sides(tree: CentreTree, left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius: float,
           vec_col: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides by leaf; by coarse node if a sample of the left vectors reaches more than ``most`` leaves each."""
    from quire.operators.simjoin import _prep

    lw = _prep(left.where(F.col(vec_col).isNotNull()), left_id, vec_col)
    rw = _prep(right.where(F.col(vec_col).isNotNull()), right_id, vec_col)
    placed = _placed(tree, rw, "_v")
    rx = placed.select(F.col(right_id).alias("_rid"), "_v", "_n", F.col("_at.leaf").alias("_k0"))
    # one row a leaf: bounded by the number of centres
    node = placed.where(F.col("_at.leaf") != ZERO_LEAF).groupBy(F.col("_at.leaf").alias("leaf")).agg(
        F.max("_at.a").alias("a"), F.max("_at.b").alias("b")).collect()
    full = tree.with_radii(*(np.array([r[c] for r in node], t) for c, t in (("leaf", np.int64), ("a", float), ("b", float))))
    coarse = False
    if most is not None:
        some = _sample(left, left_id, vec_col, SAMPLE // 8)
        coarse = bool(some) and full.reach(full.vectors(some)[0], _space_radius(tree.metric, radius)).sum() > most * len(some)
    if coarse:
        rx = rx.withColumn("_k0", F.floor(F.col("_k0") / FINE).cast("long"))     # ZERO_LEAF stays below all nodes
    lx = _reached(full, lw, "_v", radius, coarse).select(F.col(left_id).alias("_lid"), "_v", "_n", "_k0")
    return lx, rx


def tree_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius: float, metric: str = "euclid",
              vec_col: str = "vec", self_join: bool = False, strict: bool = False, block_rows: int = 2048,
              always: bool = False) -> DataFrame | None:
    """``(left_id, right_id, dist)`` of the pairs within ``radius``; None where the tree would not prune
    (unless ``always``) or there is nothing to join."""
    from quire.operators.simjoin import block_join

    tree = build_tree(left, right, left_id, right_id, radius, metric, vec_col, always)
    if tree is None:
        return None
    lx, rx = _sides(tree, left, right, left_id, right_id, radius, vec_col, COARSE)
    return block_join(lx, rx, ["_k0"], left_id, right_id, metric, radius, self_join=self_join, strict=strict,
                      block_rows=block_rows)


def compared_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius: float,
                   metric: str = "euclid", vec_col: str = "vec") -> DataFrame:
    """``n_full, n_compared``: all pairs, and those that the tree's bounds leave to compare."""
    tree = build_tree(left, right, left_id, right_id, radius, metric, vec_col, always=True)
    sizes = left.where(F.col(vec_col).isNotNull()).count() * right.where(F.col(vec_col).isNotNull()).count()
    if tree is None:
        return left.sparkSession.createDataFrame([(sizes, sizes)], "n_full long, n_compared long")
    lx, rx = _sides(tree, left, right, left_id, right_id, radius, vec_col)
    met = lx.groupBy("_k0").agg(F.count("*").alias("a")).join(rx.groupBy("_k0").agg(F.count("*").alias("b")), "_k0")
    return met.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("n_compared")).select(
        F.lit(sizes).cast("long").alias("n_full"), F.col("n_compared").cast("long"))
