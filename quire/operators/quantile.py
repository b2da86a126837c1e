"""Exact order statistics of every question's distances.

A question's distances to all demos are never stored.  Dense vectors of up to ``HELD_VALUES`` values on the demos' side are
sent to every task, packed; a task multiplies a few questions at a time by all of them, and the products, which are
within a known bound of the exact distances, leave few demos that can hold a wanted rank.  The exact distances of these,
their dimensions summed left to right as in SQL, decide.

More demos, and questions whose id repeats, are counted.  Each round, blocks of questions meet blocks
of demos; a block counts, for each question, the distances that fall into equal parts of the
question's current range, with the least and greatest distance of each part.  These rows add up
(partial sums before the shuffle), the running count picks the part that holds the wanted rank,
and that part's least and greatest value are the next range, with the rank counted from there.  A
range of one value is the answer.  Least and greatest fall into the first and last part of the
next round, so every round divides; about log(demos) / log(parts) + 1 rounds suffice, and ties of
any number end as one value.

State: at most one row for each question and wanted rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators import blockpairs as bp
from quire.operators.simjoin import BLOCK_MIN_DIM, _prep, block_distances, max_distance_bound
from quire.session import cut_lineage

PARTS = 256            # equal parts of a range
QUES_BLOCK = 1024      # rows of a question block
DEMO_BLOCK = 16384     # rows of a demo block
_CELLS = 1 << 20       # distances held at once inside a task
HELD_VALUES = 1 << 25  # of the demos' vectors, sent to every task at most
_PRODUCTS = 1 << 22    # held at once inside a task

_COUNTED = "ques_id long, lo double, hi double, part int, n long, least double, most double"


def _count_block(metric: str, parts: int):
    def fn(qs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(qs) and len(ds):
            R, rn = np.stack(ds["_v"].to_numpy()).astype(np.float64), ds["_n"].to_numpy()
            step = max(1, _CELLS // len(R))
            for a in range(0, len(qs), step):
                some = qs.iloc[a:a + step]
                d = block_distances(metric, np.stack(some["_v"].to_numpy()).astype(np.float64), some["_n"].to_numpy(), R, rn)
                lo, hi = some["lo"].to_numpy()[:, None], some["hi"].to_numpy()[:, None]
                row, col = np.nonzero((d >= lo) & (d <= hi))
                v = d[row, col]
                width = np.where(hi > lo, hi - lo, 1.0)[:, 0]
                part = np.minimum(((v - lo[row, 0]) / width[row] * parts).astype(np.int64), parts - 1)
                key = row * parts + part
                order = np.argsort(key, kind="stable")
                key, v = key[order], v[order]
                if not len(key):
                    continue
                at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                r = key[at] // parts
                out.append(pd.DataFrame({
                    "ques_id": some["ques_id"].to_numpy()[r], "lo": lo[r, 0], "hi": hi[r, 0], "part": key[at] % parts,
                    "n": np.diff(np.append(at, len(key))), "least": np.minimum.reduceat(v, at), "most": np.maximum.reduceat(v, at)}))
        if out:
            return pd.concat(out)
        return pd.DataFrame({c.split()[0]: [] for c in _COUNTED.split(", ")})

    return fn


def _smallest(metric: str, L: np.ndarray, ln: np.ndarray, R: np.ndarray, rn: np.ndarray, ranks: list[int], side: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each rank the rows of ``L`` that have it and its distance to the rows of ``R``; ``side``: ``_side`` of these."""
    if metric == "cosine":
        near, slack = np.float32(1.0) - _side(metric, L, ln) @ side.T, np.full(len(L), bp._single(L.shape[1]) + 1e-7)
    else:
        a = (L * L).sum(axis=1)
        near = a[:, None] + side[None, :] - 2.0 * (L @ R.T)
        slack = 1e-9 * (a + side.max())
        near[np.isnan(near)] = np.inf
    order, out = np.partition(near, [r - 1 for r in ranks], axis=1), []
    runs = np.split(np.array(ranks), np.flatnonzero(np.diff(ranks) != 1) + 1)
    for run in runs:                                               # ranks in a row are sought together
        first, last = (order[:, r - 1].astype(np.float64) for r in (run[0], run[-1]))
        low, high = (first - 2 * slack)[:, None].astype(near.dtype), (last + 2 * slack)[:, None].astype(near.dtype)
        if metric == "cosine":
            low, high = np.nextafter(low, np.float32(-np.inf)), np.nextafter(high, np.float32(np.inf))
        under = near < low
        below = np.count_nonzero(under, axis=1)
        i, j = np.divmod(np.flatnonzero((near <= high) ^ under), near.shape[1])
        some = np.isfinite(near[i, j])
        i, j = i[some], j[some]
        d = np.concatenate([np.zeros(0)] + [bp.exact_distances(metric, L[i[a:a + (1 << 16)]].T, ln[i[a:a + (1 << 16)]], R[j[a:a + (1 << 16)]].T.astype(np.float64), rn[j[a:a + (1 << 16)]])
                                            for a in range(0, len(i), 1 << 16)])
        i, d = (x[np.lexsort((d, i))] for x in (i, d))
        begin, end = np.searchsorted(i, np.arange(len(L))), np.searchsorted(i, np.arange(len(L)), "right")
        for r in run:
            at = begin + r - 1 - below
            has = np.flatnonzero((at >= begin) & (at < end))
            out.append((has, d[at[has]]))
    return out


def _side(metric: str, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What products need of one side's rows: unit vectors in single precision (zero ones for a norm of 0), or squared norms."""
    if metric != "cosine":
        return (x.astype(np.float64) ** 2).sum(axis=1)
    return np.where((n > 0)[:, None], x / np.where(n > 0, n, 1.0)[:, None], 0.0).astype(np.float32)


def _by_products(q: DataFrame, n_ques: int, d: DataFrame, n_demos: int, dim: int, ranks: list[int], metric: str) -> DataFrame | None:
    """``order_statistics`` of prepared rows; None where vectors are not finite."""
    packed, _ = bp._blocks(d.withColumnRenamed("demo_id", "id"), n_demos, dim, DEMO_BLOCK)
    held = packed.select("norms", "vecs").toArrow()
    norms = [np.frombuffer(x.as_py(), "<f8") for x in held.column("norms")]
    rn = np.concatenate(norms)
    R = np.concatenate([np.frombuffer(v.as_py(), "<f4" if len(v.as_py()) == 4 * dim * len(n) else "<f8").reshape(len(n), dim) for n, v in zip(norms, held.column("vecs"))])
    if metric != "cosine" and not np.isfinite(R).all():
        return None
    sent = q.sparkSession.sparkContext.broadcast((R, rn))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        R, rn = sent.value
        side, step = _side(metric, R, rn), max(1, _PRODUCTS // len(R))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, ln = batch.column("ques_id").to_numpy(), batch.column("_n").to_numpy()
            L = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
            for a in range(0, len(ids), step):
                with np.errstate(invalid="ignore", over="ignore"):
                    found = _smallest(metric, L[a:a + step], ln[a:a + step], R, rn, ranks, side)
                for r, (i, dist) in zip(ranks, found):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a + i], pa.int64()), pa.array(np.full(len(i), r, np.int64)), pa.array(dist)], names=["ques_id", "rank", "dist"])

    spread = q.select(F.col("ques_id").cast("long").alias("ques_id"), "_v", "_n").repartition(max(1, -(-n_ques // QUES_BLOCK)))
    out = cut_lineage(spread.mapInArrow(find, "ques_id long, rank long, dist double"))
    sent.destroy()
    return out


def order_statistics(questions: DataFrame, demos: DataFrame, ranks: list[int], metric: str, vec_col: str = "vec",
                     parts: int = PARTS, demo_block: int = DEMO_BLOCK) -> DataFrame:
    """``(ques_id, rank, dist)``: the rank-th smallest distance (from 1) of every question to the demos,
    for each of ``ranks`` that does not exceed their number.  Null vectors are left out."""
    spark = questions.sparkSession
    top = 2.0 if metric == "cosine" else max(max_distance_bound(questions, metric, vec_col), max_distance_bound(demos, metric, vec_col))
    d = _prep(demos.where(F.col(vec_col).isNotNull()), "demo_id", vec_col)
    q = cut_lineage(_prep(questions.where(F.col(vec_col).isNotNull()), "ques_id", vec_col))
    n_demos = d.count()
    wanted = sorted({int(r) for r in ranks if 1 <= int(r) <= n_demos})
    empty = spark.createDataFrame([], "ques_id long, rank long, dist double")
    if not wanted:
        return empty
    row = q.agg(F.count("ques_id").alias("n"), F.max("_n").alias("most"), F.min(F.when(F.col("_n") > 0, F.col("_n"))).alias("least"), F.min(F.size("_v")).alias("lo"), F.max(F.size("_v")).alias("hi")).first()
    ends = d.agg(F.max("_n").alias("most"), F.min(F.when(F.col("_n") > 0, F.col("_n"))).alias("least"), F.min(F.size("_v")).alias("lo"), F.max(F.size("_v")).alias("hi")).first()
    dim = row["hi"] or 0
    sound = all(r["most"] is not None and np.isfinite(r["most"]) and (r["least"] is None or r["least"] >= bp._TINY) for r in (row, ends))
    if sound and dim >= BLOCK_MIN_DIM and row["lo"] == dim == ends["lo"] == ends["hi"] and n_demos * dim <= HELD_VALUES:
        again = cut_lineage(q.groupBy(F.col("ques_id").alias("_q")).agg(F.count("*").alias("_c")).where((F.col("_c") > 1) | F.col("_q").isNull()).select("_q"))
        repeats = F.col("ques_id") == F.col("_q")
        found = _by_products((q if again.isEmpty() else q.join(again, repeats, "left_anti")).where("ques_id is not null"), row["n"], d, n_demos, dim, wanted, metric)
        if found is not None:
            if again.where("_q is not null").isEmpty():
                return found
            return found.unionByName(_by_counts(q.join(again, repeats, "left_semi"), d, n_demos, wanted, metric, top, parts, demo_block))
    return _by_counts(q, d, n_demos, wanted, metric, top, parts, demo_block)


def _by_counts(q: DataFrame, d: DataFrame, n_demos: int, wanted: list[int], metric: str, top: float, parts: int, demo_block: int) -> DataFrame:
    empty = q.sparkSession.createDataFrame([], "ques_id long, rank long, dist double")
    demo_parts = max(1, -(-n_demos // demo_block))
    ques_parts = max(1, -(-q.count() * len(wanted) // QUES_BLOCK))
    at = F.explode(F.array(*[F.struct(F.lit(r).cast("long").alias("rank"), F.lit(r).cast("long").alias("left")) for r in wanted]))
    # rounding may put cosine distances of equal vectors a little below 0, of opposite ones above 2
    state = q.select("ques_id", F.lit(-1e-6).alias("lo"), F.lit(top + 1e-6).alias("hi"), at.alias("r")).select(
        "ques_id", "lo", "hi", "r.rank", "r.left")
    blocks = d.select("demo_id", "_v", "_n", F.pmod(F.xxhash64("demo_id"), F.lit(demo_parts)).cast("int").alias("_rs"),
                      F.explode(F.sequence(F.lit(0), F.lit(ques_parts - 1))).alias("_ls"))
    done = []
    while True:
        ranges = state.select("ques_id", "lo", "hi").distinct().join(q, "ques_id")
        left = ranges.select("*", F.pmod(F.xxhash64("ques_id"), F.lit(ques_parts)).cast("int").alias("_ls"),
                             F.explode(F.sequence(F.lit(0), F.lit(demo_parts - 1))).alias("_rs"))
        counted = left.groupBy("_ls", "_rs").cogroup(blocks.groupBy("_ls", "_rs")).applyInPandas(_count_block(metric, parts), _COUNTED)
        key = ["ques_id", "lo", "hi"]
        hist = counted.groupBy(*key, "part").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        hist = hist.withColumn("upto", F.sum("n").over(W.partitionBy(*key).orderBy("part")))       # at most ``parts`` rows
        found = state.join(hist, key).where((F.col("left") <= F.col("upto")) & (F.col("left") > F.col("upto") - F.col("n")))
        found = cut_lineage(found.select("ques_id", F.col("least").alias("lo"), F.col("most").alias("hi"), "rank",
                                         (F.col("left") - F.col("upto") + F.col("n")).alias("left")))
        done.append(found.where(F.col("lo") == F.col("hi")).select("ques_id", "rank", F.col("lo").alias("dist")))
        state = found.where(F.col("lo") < F.col("hi"))
        if state.isEmpty():
            break
    out = empty
    for x in done:
        out = out.unionByName(x)
    return out
