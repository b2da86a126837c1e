"""Approximate cosine join by random projections (J2, opt-in; the exact join stays the default).

Each of ``tables`` hash tables rotates the unit vector by a random orthogonal matrix and files it
under the axis (with sign) that it points along most; ``hashes`` such axes together make a bucket.
Vectors at a small angle share the axis far more often than others.  The right side is filed once
a table; the left side, the smaller one, also looks into the ``probes`` next best buckets, whose
axes it points along nearly as much, so that fewer tables -- copies of the data -- are needed.

Vectors that meet in a bucket go through the block join: a hot bucket is cut into bounded blocks
by its sizes on both sides, and only pairs whose exact distance is within the radius come out, so
the result is a subset of the exact one, with the same distances.  A pair that meets in several
tables is reported once.  The hash is seeded, so the result does not depend on the partitioning.

``tables_for`` finds the number of tables for a wanted recall at the radius -- nearer pairs are found
with a higher chance -- by hashing simulated pairs at exactly that distance; it depends on the
dimension and the parameters only.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import cut_lineage

SEED = 20240611
MAX_TABLES = 256
BUCKET_ROWS = 64       # right rows of a bucket that more hashes would not make smaller
FILED_ROWS = 1 << 20   # copies of vectors that are filed at once, one table at least


@lru_cache(maxsize=4)
def rotations(dim: int, count: int, seed: int = SEED) -> np.ndarray:
    """``count`` random orthogonal matrices, as one ``dim x (count * dim)`` matrix."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)], axis=1)


def buckets(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int = SEED, some: range | None = None) -> np.ndarray:
    """Bucket numbers of each row, ``probes`` for each table or ``some`` of them (the best first); a table's numbers
    are its own.  A probe's cost is what its axes lack in squared length against the best ones."""
    n, dim = x.shape
    some = some or range(tables)
    wide, most, tables = hashes * dim, tables, len(some)
    y = (x @ rotations(dim, most * hashes, seed)[:, some.start * wide:some.stop * wide]).reshape(n, tables, hashes, dim)
    best = min(probes, dim)
    axis = np.argsort(-np.abs(y), axis=3, kind="stable")[..., :best]
    value = np.take_along_axis(y, axis, axis=3)
    code = axis * 2 + (value < 0)
    lack = value[..., :1] ** 2 - value ** 2
    out, cost = code[:, :, 0, :], lack[:, :, 0, :]
    for h in range(1, hashes):
        out = (out[..., :, None] * (2 * dim) + code[:, :, h, None, :]).reshape(n, tables, -1)
        cost = (cost[..., :, None] + lack[:, :, h, None, :]).reshape(n, tables, -1)
        pick = np.argsort(cost, axis=2, kind="stable")[..., :probes]
        out, cost = np.take_along_axis(out, pick, axis=2), np.take_along_axis(cost, pick, axis=2)
    out = out[..., :probes]
    return (out + np.array(some)[None, :, None] * (2 * dim) ** hashes).reshape(n, -1)


@lru_cache(maxsize=64)
def tables_for(dim: int, radius: float, hashes: int, probes: int, recall: float, pairs: int = 2000) -> int:
    """The number of tables with which at least ``recall`` of pairs at cosine distance ``radius`` meet."""
    rng = np.random.default_rng(SEED + 1)
    a = rng.standard_normal((pairs, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((pairs, dim))
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    cos = 1.0 - radius
    b = cos * a + np.sqrt(max(0.0, 1.0 - cos * cos)) * b
    met = np.zeros(pairs, bool)
    for t in range(MAX_TABLES):
        own = buckets(a, 1, hashes, probes, SEED + 1000 + t)
        other = buckets(b, 1, hashes, 1, SEED + 1000 + t)
        met |= (own == other).any(axis=1)
        if met.mean() >= recall:
            return t + 1
    raise ValueError(f"recall {recall} at distance {radius} takes more than {MAX_TABLES} tables; use the exact join")


def settings(right: DataFrame, radius: float, vec_col: str = "vec", recall: float = 0.95, hashes: int | None = None,
             probes: int = 4, tables: int | None = None) -> tuple[int, int]:
    """``(hashes, tables)``: as many hashes as leave about ``BUCKET_ROWS`` of the right rows in a bucket,
    fewer if the recall would take more than ``MAX_TABLES`` tables."""
    some = right.where(F.col(vec_col).isNotNull()).agg(F.max(F.size(vec_col)).alias("d"), F.count("*").alias("n")).first()
    dim, n = some["d"] or 1, some["n"]
    wanted = hashes or max(1, int(math.log(max(n / BUCKET_ROWS, 1.0)) / math.log(2 * max(dim, 2))))
    while not tables:
        try:
            tables = tables_for(dim, float(radius), wanted, probes, recall)
        except ValueError:
            if hashes or wanted == 1:
                raise
            wanted -= 1
    return wanted, tables


def _filed(df: DataFrame, tables: int, hashes: int, probes: int, some: range | None = None) -> DataFrame:
    """``df`` with a row for each bucket (``_k0``) of its vector ``_v``, in ``some`` tables if given."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(v: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(r, dtype=np.float64) for r in v])
        norm = np.sqrt((x * x).sum(axis=1))
        found = buckets(x / np.where(norm > 0, norm, 1.0)[:, None], tables, hashes, probes, some=some)
        return pd.Series([k.tolist() if n > 0 else [] for k, n in zip(found, norm)])

    return df.withColumn("_k0", F.explode(keys("_v")))


def lsh_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius: float, vec_col: str = "vec",
             recall: float = 0.95, hashes: int | None = None, probes: int = 4, tables: int | None = None,
             self_join: bool = False, strict: bool = False, block_rows: int = 2048) -> DataFrame:
    """Most pairs with cosine distance ``<= radius`` (below 1): ``(left_id, right_id, dist)``.

    Pass the smaller side as ``left``.  ``hashes`` and ``tables`` override what ``settings`` finds for
    the right side's size and the wanted ``recall``.  Null and zero vectors have no pairs."""
    from quire.operators.simjoin import _prep, block_join

    if not 0.0 <= radius < 1.0:
        raise ValueError("random projections need a cosine distance below 1")
    hashes, tables = settings(right, radius, vec_col, recall, hashes, probes, tables)
    lw, rw = _prep(left.where(F.col(vec_col).isNotNull()), left_id, vec_col), _prep(right.where(F.col(vec_col).isNotNull()), right_id, vec_col)

    def found(some: range) -> DataFrame:
        lx, rx = _filed(lw, tables, hashes, probes, some), _filed(rw, tables, hashes, 1, some)
        return block_join(lx.select(F.col(left_id).alias("_lid"), "_v", "_n", "_k0"), rx.select(F.col(right_id).alias("_rid"), "_v", "_n", "_k0"),
                          ["_k0"], left_id, right_id, "cosine", radius, self_join=self_join, strict=strict, block_rows=block_rows)

    step = max(1, FILED_ROWS // max(1, lw.count() * probes + rw.count()))
    if step >= tables:
        return found(range(tables)).dropDuplicates([left_id, right_id])
    pairs = None
    for t in range(0, tables, step):
        new = cut_lineage(found(range(t, min(t + step, tables))))
        pairs = new if pairs is None else pairs.unionByName(new)
    return pairs.dropDuplicates([left_id, right_id])


def compared_pairs(left: DataFrame, right: DataFrame, radius: float, vec_col: str = "vec", recall: float = 0.95,
                   hashes: int | None = None, probes: int = 4) -> DataFrame:
    """``n_compared``: pairs that meet in a bucket, counted in every table they meet in."""
    hashes, tables = settings(right, radius, vec_col, recall, hashes, probes)

    def filed(df: DataFrame, looks: int, name: str) -> DataFrame:
        v = df.select(F.col(vec_col).cast("array<double>").alias("_v")).where(F.col("_v").isNotNull())
        return _filed(v, tables, hashes, looks).groupBy("_k0").agg(F.count("*").alias(name))

    return filed(left, probes, "a").join(filed(right, 1, "b"), "_k0").agg(
        F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("n_compared"))
