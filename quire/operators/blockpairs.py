"""Range join of dense vectors that no bound prunes: every block of rows meets every other one.

Rows are packed into blocks of a few thousand vectors, one row of the table each, so that a vector moves once for
each block of the other side and not once for each neighbour cell; a self join compares each two blocks once.
A pair of blocks is compared in tiles: a matrix product with a margin for rounding leaves few pairs, and these are
decided by the exact distance, its dimensions summed left to right as in SQL.  Found pairs leave a task tile by tile,
or, where the caller needs less than all of them, as what they come to: a row's nearest, a row's number of partners, or
links that connect the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage

MOST_ROWS, LEAST_ROWS = 16384, 512   # of a block
BLOCKS = 16                          # that the smaller side is cut into, if its blocks stay large enough
TILE = 1 << 21                       # pairs compared at once
DENSE = 0.4                          # share of a tile's pairs from which all its exact distances are computed
FIRST_ROWS = 256                     # of a block that links are first sought with
_TINY = 1e-150                       # norms whose product may vanish
CHUNK = 64                           # columns of which the nearest one is sought first


def _single(dim: int) -> float:
    """How far a product of two unit vectors in single precision may be from the exact one."""
    return (dim + 8) * 1.2e-7 + 1e-9


def exact_distances(metric: str, L: np.ndarray, ln: np.ndarray, R: np.ndarray, rn: np.ndarray) -> np.ndarray:
    """Distances of the pairs (column of ``L``, column of ``R``), dimensions summed left to right."""
    if metric == "cosine":
        acc = L[0] * R[0]
        for j in range(1, len(L)):
            acc += L[j] * R[j]
        norms = ln * rn
        return 1.0 - np.divide(acc, norms, out=np.zeros_like(acc), where=norms > 0)
    t = L[0] - R[0]
    acc = t * t
    for j in range(1, len(L)):
        t = L[j] - R[j]
        acc += t * t
    return np.sqrt(acc)


def _units(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision: their products are within ``_single`` of the exact ones."""
    return (x / np.where(n > 0, n, 1.0)[:, None]).astype(np.float32)


def _maybe(metric: str, L: np.ndarray, ln: np.ndarray, R: np.ndarray, rn: np.ndarray, radius: float, units: tuple | None = None) -> np.ndarray:
    """Which pairs may be within the radius; ``units`` of the two sides, if they are known."""
    if metric == "cosine":
        a, b = units or (_units(L, ln), _units(R, rn))
        ok = a @ b.T >= np.float32(1.0 - radius - _single(L.shape[1]))
        for odd, at in ((ln, (slice(None), None)), (rn, (None, slice(None)))):
            small = (odd > 0) & (odd < _TINY)
            if small.any():
                ok |= small[at]
        return ok
    a, b = (L * L).sum(axis=1), (R * R).sum(axis=1)
    both = a[:, None] + b[None, :]
    return both - 2.0 * (L @ R.T) <= radius * radius * (1 + 1e-9) + 1e-9 * both


def close_pairs(metric: str, L: np.ndarray, ln: np.ndarray, R: np.ndarray, rn: np.ndarray, radius: float, strict: bool = False,
                allowed: np.ndarray | None = None, units: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers and distances of the pairs within the radius, of those ``allowed``."""
    with np.errstate(invalid="ignore", over="ignore"):
        ok = _maybe(metric, L, ln, R, rn, radius, units)
        if allowed is not None:
            ok &= allowed
        if np.count_nonzero(ok) > DENSE * ok.size:
            from quire.operators.simjoin import block_distances

            d = block_distances(metric, L, ln, R, rn)
            ok &= (d < radius) if strict else (d <= radius)
            li, ri = np.nonzero(ok)
            return li, ri, d[li, ri]
        li, ri = np.nonzero(ok)
        if not len(li):
            return li, ri, np.zeros(0)
        lt, rt = np.ascontiguousarray(L.T), np.ascontiguousarray(R.T)
        parts = []
        for a in range(0, len(li), 1 << 16):                       # what a step touches stays in the cache
            i, j = li[a:a + (1 << 16)], ri[a:a + (1 << 16)]
            parts.append(exact_distances(metric, _Columns(lt, i), ln[i], _Columns(rt, j), rn[j]))
        d = np.concatenate(parts)
        near = (d < radius) if strict else (d <= radius)
    return li[near], ri[near], d[near]


class _Tiles:
    """Two blocks, whose pairs are told apart into sure and possible ones by a matrix product."""

    def __init__(self, metric: str, L: np.ndarray, ln: np.ndarray, R: np.ndarray, rn: np.ndarray, radius: float, strict: bool, far: bool):
        self.metric, self.L, self.ln, self.R, self.rn = metric, L, ln, R, rn
        self.radius, self.strict, self.far = radius, strict, far
        if metric == "cosine":
            self.a, self.b = (x / np.where(n > 0, n, 1.0)[:, None] for x, n in ((L, ln), (R, rn)))
            self.tiny = [(n > 0) & (n < _TINY) for n in (ln, rn)]
            self.odd = any(x.any() for x in self.tiny)
            self.single = None if self.odd else tuple(x.astype(np.float32) for x in (self.a, self.b))
            self.slack = _single(L.shape[1])
        else:
            self.a, self.b = ((x * x).sum(axis=1) for x in (L, R))
            self.odd = False

    def bounds(self, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the distances (Euclid: of their squares)."""
        if self.metric == "cosine":
            x = 1.0 - self.a[rows] @ self.b[cols].T
            low, high = x - 1e-9, x + 1e-9
            if self.odd:
                odd = self.tiny[0][rows][:, None] | self.tiny[1][cols][None, :]
                low[odd], high[odd] = -np.inf, np.inf
            return low, high
        both = self.a[rows][:, None] + self.b[cols][None, :]
        x = both - 2.0 * (self.L[rows] @ self.R[cols].T)
        both *= 1e-9
        return x - both, x + both

    def split(self, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs are sure, and which only possible."""
        if self.metric == "cosine" and not self.odd and not self.far:
            x = self.single[0][rows] @ self.single[1][cols].T
            sure = x >= np.float32(1.0 - self.radius + 2 * self.slack)
            return sure, (x >= np.float32(1.0 - self.radius - 2 * self.slack)) & ~sure
        low, high = self.bounds(rows, cols)
        r = self.radius if self.metric == "cosine" else self.radius * self.radius
        below, above = (r - 1e-9, r + 1e-9) if self.metric == "cosine" else (r * (1 - 1e-9), r * (1 + 1e-9))
        if self.far:
            sure = low >= above
            return sure, ~sure & ((high >= below) | (low <= 0))
        sure = high <= below
        return sure, ~sure & (low <= above)

    def distances(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        parts = [np.zeros(0)]
        for a in range(0, len(i), 1 << 16):
            x, y = i[a:a + (1 << 16)], j[a:a + (1 << 16)]
            parts.append(exact_distances(self.metric, self.L[x].T, self.ln[x], self.R[y].T, self.rn[y]))
        return np.concatenate(parts)

    def meet(self, d: np.ndarray) -> np.ndarray:
        if self.far:
            return (d == 0) | (np.divide(1.0, d, out=np.full_like(d, np.inf), where=d != 0) <= 1.0 / self.radius)
        return (d < self.radius) if self.strict else (d <= self.radius)

    def pieces(self, rows: np.ndarray, cols: np.ndarray) -> Iterator[np.ndarray]:
        step = max(1, TILE // max(1, len(cols)))
        for a in range(0, len(rows) if len(cols) else 0, step):
            yield rows[a:a + step]


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Adds the edges (a, b) to components given by their smallest node, and gives their smallest nodes."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        np.minimum.at(parent, a, b)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def _links(t: _Tiles, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, its component's first row) that connect all rows of the two blocks that pairs connect; rows of the
    second block are counted on from the first's.  A pair whose rows are connected is not compared: it adds nothing."""
    nl, nr = len(t.L), len(t.R)
    shift = 0 if same else nl
    parent = np.arange(shift + nr)
    at, width = 0, FIRST_ROWS
    while at < nr:
        cols = np.arange(at, min(at + width, nr))
        top = np.bincount(parent).argmax()
        inside, outside = parent[:nl] == top, cols[parent[cols + shift] != top]
        for rows, its in ((np.flatnonzero(~inside), cols), (np.flatnonzero(inside), outside)):
            for some in t.pieces(rows, its):
                sure, doubt = t.split(some, its)
                i, j = np.nonzero(sure)
                parent = unite(parent, some[i], its[j] + shift)
                i, j = (x[y] for x, y in zip((some, its), np.nonzero(doubt)))
                apart = parent[i] != parent[j + shift]
                i, j = i[apart], j[apart]
                meet = t.meet(t.distances(i, j))
                parent = unite(parent, i[meet], j[meet] + shift)
        at, width = at + width, 2 * width
    leaf = np.flatnonzero(parent != np.arange(len(parent)))
    return leaf, parent[leaf]


def _counts(t: _Tiles) -> np.ndarray:
    """The number of partners of each row of the second block."""
    n, cols = np.zeros(len(t.R), np.int64), np.arange(len(t.R))
    for rows in t.pieces(np.arange(len(t.L)), cols):
        sure, doubt = t.split(rows, cols)
        n += np.count_nonzero(sure, axis=0)
        i, j = np.nonzero(doubt)
        j = j[t.meet(t.distances(rows[i], j))]
        n += np.bincount(j, minlength=len(n))
    return n


def _nearest(t: _Tiles, k: int, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each row of the first block, the ``k`` nearest partners in the second one (of equal distance: of lowest ``order``)."""
    cols = np.arange(len(t.R))
    limit = t.radius + 1e-9 if t.metric == "cosine" else t.radius * t.radius * (1 + 1e-9)
    wide = len(cols) // CHUNK
    for rows in t.pieces(np.arange(len(t.L)), cols):
        if t.metric == "cosine" and not t.odd and wide >= 4 * k:
            x = t.single[0][rows] @ t.single[1].T
            best = np.fmax.reduce(x[:, :wide * CHUNK].reshape(len(rows), CHUNK, wide), axis=1)    # the best of each chunk
            kth = -np.partition(-best, k - 1, axis=1)[:, k - 1:k]                                 # k columns are as near at least
            ok = x >= np.fmax(kth - np.float32(2 * t.slack), np.float32(1.0 - limit - t.slack))
        else:
            low, high = t.bounds(rows, cols)
            ok = low <= limit
            if len(cols) > k:
                ok &= low <= np.partition(high, k - 1, axis=1)[:, k - 1:k]
        i, j = np.nonzero(ok)
        i = rows[i]
        d = t.distances(i, j)
        meet = t.meet(d)
        i, j, d = i[meet], j[meet], d[meet]
        at = np.lexsort((order[j], d, i))
        i, j, d = i[at], j[at], d[at]
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
        rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
        yield i[rank < k], j[rank < k], d[rank < k]


class _Columns:
    """Chosen columns of a matrix, taken a row at a time."""

    def __init__(self, rows: np.ndarray, at: np.ndarray):
        self.rows, self.at = rows, at

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, j: int) -> np.ndarray:
        return self.rows[j].take(self.at)


def _blocks(df: DataFrame, n: int, dim: int, rows: int, by: str | None = None) -> tuple[DataFrame, int]:
    """``block, ids, norms, vecs``: the rows of ``df(id, _v, _n)`` packed, and the number of blocks.  ``by``: rows that agree
    in this column share a block, which has their values as ``keys``."""
    count = max(1, -(-n // rows))
    kind = f", keys array<{dict(df.dtypes)[by]}>" if by else ""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]                  # a block: at most about ``rows`` rows
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            x = t.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            small = x.astype("<f4")
            x = small if np.array_equal(small, x, equal_nan=True) else x.astype("<f8")
            row = {
                "block": pa.array([TaskContext.get().partitionId()], pa.int32()), "ids": pa.array([t.column("id").to_pylist()], pa.list_(pa.int64())),
                "norms": pa.array([t.column("_n").to_numpy().astype("<f8").tobytes()], pa.binary()), "vecs": pa.array([x.tobytes()], pa.binary())}
            if by:
                row["keys"] = pa.array([t.column(by).to_pylist()], pa.list_(t.schema.field(by).type))
            yield pa.RecordBatch.from_pydict(row)

    packed = df.repartition(count, *[by] if by else []).mapInArrow(pack, "block int, ids array<long>, norms binary, vecs binary" + kind)
    return cut_lineage(packed), count


def _sized(df: DataFrame, id_col: str, vec_col: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, int, int]:
    """The rows with a vector as ``id, _v, _n``, their number and the dimension."""
    from quire.operators.simjoin import _prep

    df = _prep(df.where(F.col(vec_col).isNotNull()), id_col, vec_col, keep=keep).withColumnRenamed(id_col, "id")
    row = df.agg(F.count("*").alias("n"), F.min(F.size("_v")).alias("lo"), F.max(F.size("_v")).alias("hi")).first()
    if row["lo"] != row["hi"]:
        raise ValueError(f"vectors of different lengths ({row['lo']} and {row['hi']}) cannot be compared")
    return df, row["n"], row["hi"] or 0


def _side(row: pa.RecordBatch, k: int, ids: str, norms: str, vecs: str, dim: int) -> tuple:
    n = np.frombuffer(row.column(norms)[k].as_py(), "<f8")
    v = row.column(vecs)[k].as_py()
    x = np.frombuffer(v, "<f4" if len(v) == 4 * dim * len(n) else "<f8").reshape(len(n), dim).astype(np.float64)
    return row.column(ids)[k].values, n, x


def block_sets_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, key: str, radius: float, metric: str, vec_col: str,
                    min_dim: int) -> DataFrame | None:
    """``(key, left_id, ids)``: the ids, ascending and each once, of the rows of ``right(key, right_id, vec)`` with this key that are
    within ``radius`` of the left row; None as in ``block_pairs_join``.  A key's rows share a block, so that no pairs are moved;
    the caller sees to it that a key has few rows, and that a left id does not repeat."""
    r, n_right, dim = _sized(right, right_id, vec_col, (key,))
    if dim < min_dim or not n_right:
        return None
    l, n_left, _ = _sized(left, left_id, vec_col)
    if not n_left:
        return None
    rows = min(MOST_ROWS, max(LEAST_ROWS, -(-min(n_left, n_right) // BLOCKS)))
    rb, n_rb = _blocks(r, n_right, dim, rows, key)
    lb, n_lb = _blocks(l, n_left, dim, rows)
    met = lb.select(F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n_rb - 1))).alias("j"), F.col("ids").alias("lids"), F.col("norms").alias("ln"), F.col("vecs").alias("lv")) \
        .join(rb.select(F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(n_lb - 1))).alias("i"), "keys", F.col("ids").alias("rids"), F.col("norms").alias("rn"), F.col("vecs").alias("rv")), ["i", "j"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lids, ln, L = _side(batch, k, "lids", "ln", "lv", dim)
                rids, rn, R = _side(batch, k, "rids", "rn", "rv", dim)
                keys = batch.column("keys")[k].values
                rids, code = rids.to_numpy(zero_copy_only=False), keys.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                at = np.lexsort((rids, code))
                rids, code, keys, rn, R = rids[at], code[at], keys.take(pa.array(at)), rn[at], R[at]
                cols = np.arange(len(R))
                with np.errstate(invalid="ignore", over="ignore"):
                    t = _Tiles(metric, L, ln, R, rn, radius, False, False)
                    for some in t.pieces(np.arange(len(L)), cols):
                        near, doubt = t.split(some, cols)
                        i, j = np.nonzero(doubt)
                        meet = t.meet(t.distances(some[i], j))
                        near[i[meet], j[meet]] = True
                        i, j = np.divmod(np.flatnonzero(near.ravel()), len(cols))
                        same = (i[1:] == i[:-1]) & (code[j[1:]] == code[j[:-1]])
                        once = np.append(True, ~(same & (rids[j[1:]] == rids[j[:-1]])))[:len(i)]
                        first = np.flatnonzero(np.append(True, ~same)[:len(i)][once])
                        i, j = i[once], j[once]
                        if len(i):
                            ids = pa.ListArray.from_arrays(pa.array(np.append(first, len(i)).astype(np.int32)), pa.array(rids[j]))
                            yield pa.RecordBatch.from_arrays([keys.take(pa.array(j[first])), lids.take(pa.array(some[i[first]])), ids], names=[key, left_id, "ids"])

    met = met.select("i", "j", "lids", "ln", "lv", "keys", "rids", "rn", "rv")
    return met.mapInArrow(compare, f"`{key}` {dict(r.dtypes)[key]}, `{left_id}` long, ids array<long>")


def block_pairs_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius: float, metric: str, vec_col: str,
                     self_join: bool, strict: bool, min_dim: int, nearest: int | None = None, links: bool = False,
                     counts: bool = False, far: bool = False) -> DataFrame | None:
    """``(left_id, right_id, dist)`` of the pairs within ``radius``; None for vectors below ``min_dim`` or no vectors.

    All pairs are compared.  ``nearest``: of a left row's pairs with one block only so many, the nearest (then the lowest
    ids), are given.  ``links`` (of a self join): ``(src, dst)`` that connect the rows that pairs connect; with ``far`` pairs
    whose reciprocal distance is at most ``1 / radius``, or of distance 0.  ``counts``: ``(right_id, n)``, the pairs of a right row
    with one block."""
    r, n_right, dim = _sized(right.where(F.col(right_id).isNotNull()) if links else right, right_id, vec_col)
    if dim < min_dim or not n_right:
        return None
    l, n_left, _ = (r, n_right, dim) if self_join else _sized(left.where(F.col(left_id).isNotNull()) if links else left, left_id, vec_col)
    if not n_left:
        return None
    rows = min(MOST_ROWS, max(LEAST_ROWS, -(-min(n_left, n_right) // BLOCKS)))
    rb, n_rb = _blocks(r, n_right, dim, rows)
    lb, n_lb = (rb, n_rb) if self_join else _blocks(l, n_left, dim, rows)
    other = F.sequence(F.col("block"), F.lit(n_rb - 1)) if self_join else F.sequence(F.lit(0), F.lit(n_rb - 1))
    mine = F.sequence(F.lit(0), F.col("block")) if self_join else F.sequence(F.lit(0), F.lit(n_lb - 1))
    met = lb.select(F.col("block").alias("i"), F.explode(other).alias("j"), F.col("ids").alias("lids"), F.col("norms").alias("ln"), F.col("vecs").alias("lv")) \
        .join(rb.select(F.col("block").alias("j"), F.explode(mine).alias("i"), F.col("ids").alias("rids"), F.col("norms").alias("rn"), F.col("vecs").alias("rv")), ["i", "j"])

    def side(row: pa.RecordBatch, k: int, ids: str, norms: str, vecs: str) -> tuple:
        return _side(row, k, ids, norms, vecs, dim)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lids, ln, L = side(batch, k, "lids", "ln", "lv")
                rids, rn, R = side(batch, k, "rids", "rn", "rv")
                same = self_join and batch.column("i")[k].as_py() == batch.column("j")[k].as_py()
                step = max(1, TILE // len(R))
                units = (_units(L, ln), _units(R, rn)) if metric == "cosine" else None
                for a in range(0, len(L), step):
                    allowed = np.arange(a, min(a + step, len(L)))[:, None] < np.arange(len(R))[None, :] if same else None
                    li, ri, d = close_pairs(metric, L[a:a + step], ln[a:a + step], R, rn, radius, strict, allowed,
                                            units and (units[0][a:a + step], units[1]))
                    x, y = lids.take(pa.array(li + a)), rids.take(pa.array(ri))
                    if self_join:
                        x, y = x.to_pandas().to_numpy(), y.to_pandas().to_numpy()
                        keep = x != y if x.dtype == y.dtype == np.int64 else (x < y) | (y < x)
                        x, y, d = (v[keep] for v in (x, y, d))
                        x, y = pa.array(np.minimum(x, y).astype(np.int64)), pa.array(np.maximum(x, y).astype(np.int64))
                    if len(d):
                        yield pa.RecordBatch.from_arrays([x, y, pa.array(d)], names=["_lid", "_rid", "dist"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lids, ln, L = side(batch, k, "lids", "ln", "lv")
                rids, rn, R = side(batch, k, "rids", "rn", "rv")
                same = self_join and batch.column("i")[k].as_py() == batch.column("j")[k].as_py()
                with np.errstate(invalid="ignore", over="ignore"):
                    t = _Tiles(metric, L, ln, R, rn, radius, strict, far)
                    if links:
                        ids = lids if same else pa.concat_arrays([lids, rids])
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)) for x in _links(t, same)], names=["src", "dst"])
                    elif counts:
                        n = _counts(t)
                        has = np.flatnonzero(n)
                        yield pa.RecordBatch.from_arrays([rids.take(pa.array(has)), pa.array(n[has])], names=["_rid", "n"])
                    else:
                        order = rids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                        for i, j, d in _nearest(t, nearest, order):
                            yield pa.RecordBatch.from_arrays([lids.take(pa.array(i)), rids.take(pa.array(j)), pa.array(d)], names=["_lid", "_rid", "dist"])

    met = met.select("i", "j", "lids", "ln", "lv", "rids", "rn", "rv")
    if links:
        return met.mapInArrow(reduce, "src long, dst long")
    if counts:
        return met.mapInArrow(reduce, "_rid long, n long").select(F.col("_rid").alias(right_id), "n")
    out = met.mapInArrow(reduce if nearest and not self_join else compare, "_lid long, _rid long, dist double")
    return out.select(F.col("_lid").alias(left_id), F.col("_rid").alias(right_id), "dist")
