"""Weighted greedy set cover (C1) and the per-group extra cover (C4).

Sequential rule (per key): repeatedly take the set with the largest
``newly covered / cost`` (ties: lowest demo id; zero gain is never taken) until
every element is covered; a key whose universe cannot be covered gets no sets.

Parallel form: in each round every uncovered element votes for its best set
``max(score, -demo_id)``; a set that wins *all* of its uncovered elements is
taken.  Scores only fall, and only when an overlapping set is taken, so each
accepted set is also taken -- unchanged -- by the sequential greedy; the pick
order is ``(score at pick desc, demo_id asc)``.  Votes and gains are aggregates
(map-side combined), so a hot element or a huge set never lands in one task.
Each round is checkpointed; the loop stops when nothing is left uncovered.

Where sets overlap much, few win all their elements, and rounds come near to one a pick.  So only
keys of more than ``TASK_EDGES`` edges take rounds; one of fewer is covered by one task, which goes by
the sequential rule itself: a set's last known score bounds its present one, so the best known
set is taken if its score still holds, and is put back with the present one if not.
"""

from __future__ import annotations

import heapq
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage

TASK_EDGES = 1 << 22    # of a key that one task holds
HELD_ROUNDS = 16        # whose picks are held before they are checkpointed
_WHOLE = ("bigint", "int", "smallint", "tinyint")


def few_and_many(df: DataFrame, key: str, more: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of keys that one task can hold, and the others (None if there are none): of more than ``TASK_EDGES`` rows,
    or among the keys ``more``."""
    many = df.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).where(F.col("_n") > TASK_EDGES).select("_k")
    if more is not None:
        many = many.unionByName(more.select(F.col(key).alias("_k"))).distinct()
    many = cut_lineage(many)
    if many.isEmpty():
        return df, None
    same = F.col(key).eqNullSafe(F.col("_k"))
    return df.join(many, same, "left_anti"), df.join(many, same, "left_semi")


def greedy(demo: np.ndarray, ques: np.ndarray, priced: np.ndarray, cost: np.ndarray) -> list[tuple[int, int]]:
    """Picks ``(demo, newly covered)`` of one key in order, from its edges and the cost rows ``(priced, cost)`` of its demos."""
    ids, at = np.unique(demo, return_inverse=True)
    names, elem = np.unique(ques, return_inverse=True)
    lists = np.split(elem[np.argsort(at, kind="stable")], np.cumsum(np.bincount(at))[:-1])
    price = np.full(len(ids), np.inf)
    i = np.minimum(np.searchsorted(ids, priced), len(ids) - 1)
    known = ids[i] == priced
    np.fmin.at(price, i[known], cost[known])
    heap = [(-(len(x) / price[d]), d) for d, x in enumerate(lists)]
    heapq.heapify(heap)
    bare, out = np.ones(len(names), bool), []
    while heap:
        was, d = heapq.heappop(heap)
        mine = lists[d] = lists[d][bare[lists[d]]]
        score = -(len(mine) / price[d])
        if len(mine) and score == was:
            bare[mine] = False
            out.append((int(ids[d]), len(mine)))
        elif len(mine):
            heapq.heappush(heap, (score, d))
    return out


def _cover_in_tasks(live: DataFrame, c: DataFrame, key: str) -> DataFrame:
    """``set_cover`` of keys that one task can hold; ``round`` counts the picks of a key."""
    kind = dict(live.dtypes)[key]

    def cover(group: tuple, edges: pa.Table, costs: pa.Table) -> pa.Table:
        priced = costs.filter(costs.column("_cost").is_valid())
        picks = greedy(edges.column("demo_id").to_numpy(), edges.column("ques_id").to_numpy(), priced.column("demo_id").to_numpy(),
                       priced.column("_cost").to_numpy()) if edges.num_rows else []
        return pa.table({key: pa.array([group[0].as_py()] * len(picks), edges.schema.field(key).type), "demo_id": pa.array([d for d, _ in picks], pa.int64()),
                         "_gain": pa.array([g for _, g in picks], pa.int64()), "round": pa.array(range(1, len(picks) + 1), pa.int32())})

    long = [F.col(x).cast("long").alias(x) for x in ("demo_id", "ques_id")]
    picks = live.select(key, *long).groupBy(key).cogroup(c.select(key, long[0], "_cost").groupBy(key)) \
        .applyInArrow(cover, f"`{key}` {kind}, demo_id long, _gain long, round int")
    return picks.join(c, [key, "demo_id"]).select(key, F.col("demo_id").cast(dict(live.dtypes)["demo_id"]).alias("demo_id"), (F.col("_gain") / F.col("_cost")).alias("score"), "round")


def set_cover(edges: DataFrame, costs: DataFrame, key: str = "cluster_id",
              universe: DataFrame | None = None, max_rounds: int = 10000) -> DataFrame:
    """``edges(key, demo_id, ques_id)``, ``costs(key, demo_id, set_cost)`` ->
    ``picks(key, demo_id, score, round)`` (``with_pick_no`` numbers them for reports).

    ``universe(key, ques_id)`` defaults to the covered elements; keys with an
    element outside every set are skipped (no picks), as in the sequential rule."""
    e = edges.select(key, "demo_id", "ques_id").distinct()
    if universe is not None:
        bad = universe.select(key, "ques_id").join(e.select(key, "ques_id"), [key, "ques_id"], "left_anti") \
            .select(key).distinct()
        e = e.join(bad, key, "left_anti")
    # loop invariant: materialised once, so no round recomputes the upstream plan
    c = cut_lineage(costs.select(key, "demo_id",
                                 F.when(F.col("set_cost").isNotNull(), F.greatest(F.col("set_cost").cast("double"), F.lit(1.0))).alias("_cost")))
    live = cut_lineage(e)
    if not live.join(c.where(F.col("_cost").isNotNull()), [key, "demo_id"], "left_anti").isEmpty():
        raise ValueError("set_cover: a set has no cost, or a null one")
    types = dict(live.dtypes)
    many = live
    few = None
    if types["demo_id"] in _WHOLE and types["ques_id"] in _WHOLE and live.where("ques_id is null").isEmpty():
        few, many = few_and_many(live, key)
    out = [] if few is None else [_cover_in_tasks(few, c, key)]
    if many is not None:
        out.append(_cover_in_rounds(many, c, key, max_rounds))
    return cut_lineage(out[0].unionByName(out[1]) if len(out) > 1 else out[0])


def _cover_in_rounds(live: DataFrame, c: DataFrame, key: str, max_rounds: int) -> DataFrame:
    done, picks = [], []
    rnd = 0

    def keep() -> None:
        out = picks[0]
        for p in picks[1:]:
            out = out.unionByName(p)
        done.append(cut_lineage(out))
        for p in picks:
            p.unpersist()
        picks.clear()

    while True:
        rnd += 1
        gain = live.groupBy(key, "demo_id").agg(F.count("*").alias("_gain"))
        scored = gain.join(c, [key, "demo_id"]).select(
            key, "demo_id", "_gain", (F.col("_gain") / F.col("_cost")).alias("score"))
        votes = live.join(scored.select(key, "demo_id", "score"), [key, "demo_id"]) \
            .groupBy(key, "ques_id").agg(F.max(F.struct(F.col("score").alias("s"), (-F.col("demo_id")).alias("nd"))).alias("_best"))
        wins = votes.groupBy(key, (-F.col("_best.nd")).alias("demo_id")).agg(F.count("*").alias("_wins"))
        taken = scored.join(wins, [key, "demo_id"]).where(F.col("_wins") == F.col("_gain")) \
            .select(key, "demo_id", "score", F.lit(rnd).alias("round"))
        # cached, not checkpointed: its lineage starts at this round's checkpointed
        # ``live``, so a lost block is recomputed from there; the next checkpoint
        # (``live``) materialises it
        taken = taken.persist()
        picks.append(taken)
        covered = live.join(taken.select(key, "demo_id"), [key, "demo_id"], "left_semi").select(key, "ques_id")
        live = cut_lineage(live.join(covered, [key, "ques_id"], "left_anti"))
        if len(picks) >= HELD_ROUNDS:
            keep()
        if live.isEmpty():
            break
        if rnd >= max_rounds:
            warnings.warn(f"set_cover: {rnd} rounds and still running; continuing", RuntimeWarning)
            max_rounds *= 2
    if picks:
        keep()
    out = done[0]
    for p in done[1:]:
        out = out.unionByName(p)
    return out.select(key, "demo_id", "score", "round")


def with_pick_no(picks: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Number the picks of each key in greedy order ``(score desc, demo_id asc)``.

    Operators use the order key itself (an aggregate); the numbering is a
    distributed per-key row number, so one giant cluster is not one task."""
    from quire.operators.ordering import row_number_within
    return row_number_within(picks, [key], [F.col("score").desc(), F.col("demo_id")], "pick_no")


def group_extra_demos(groups_long: DataFrame, ccover: DataFrame, costs: DataFrame, set_cover_num: int,
                      max_rounds: int = 10000) -> DataFrame:
    """C4 (code / QA): give each group up to ``set_cover_num`` further covers of its own
    questions, built from the cluster's demos not yet in the group; a round stops early
    once the group holds as many demos as questions, and is skipped when every demo of
    the cluster is already in the group or the questions cannot be covered.

    ``groups_long(cluster_id, group_id, ques_id, demo_id)`` (demo_id/ques_id may be
    NULL on one side).  Returns added ``(group_id, demo_id, extra_round, pick_no)``."""
    gq = cut_lineage(groups_long.where(F.col("ques_id").isNotNull())
                     .select("cluster_id", "group_id", "ques_id").distinct())
    gd = cut_lineage(groups_long.where(F.col("demo_id").isNotNull())
                     .select("cluster_id", "group_id", "demo_id").distinct())
    ccover = cut_lineage(ccover.select("cluster_id", "demo_id", "ques_id"))
    costs = cut_lineage(costs.select("cluster_id", "demo_id", "set_cost"))
    n_q = gq.groupBy("group_id").agg(F.count("*").alias("_nq"))
    n_cluster_demos = ccover.groupBy("cluster_id").agg(F.countDistinct("demo_id").alias("_ncd"))
    added = []
    have = gd
    stopped = groups_long.sparkSession.createDataFrame([], "group_id string")
    for r in range(1, set_cover_num + 1):
        n_have = have.groupBy("group_id").agg(F.count("*").alias("_nd"))
        open_groups = n_q.join(n_have, "group_id", "left").join(
            gq.select("group_id", "cluster_id").distinct(), "group_id").join(n_cluster_demos, "cluster_id") \
            .join(stopped, "group_id", "left_anti") \
            .select("group_id", "cluster_id", F.coalesce(F.col("_nd"), F.lit(0)).alias("_nd"), "_nq", "_ncd") \
            .where(F.col("_nd") != F.col("_ncd"))
        open_groups = cut_lineage(open_groups)
        edges = gq.join(open_groups.select("group_id"), "group_id") \
            .join(ccover.select("cluster_id", "demo_id", "ques_id"), ["cluster_id", "ques_id"]) \
            .join(have.select("group_id", "demo_id"), ["group_id", "demo_id"], "left_anti") \
            .select("group_id", "demo_id", "ques_id")
        edges = cut_lineage(edges)
        if edges.isEmpty():
            break
        # costs of the demos in question only, never groups x demos of a cluster
        gcost = edges.select("group_id", "demo_id").distinct() \
            .join(open_groups.select("group_id", "cluster_id"), "group_id").join(costs, ["cluster_id", "demo_id"]) \
            .select("group_id", "demo_id", "set_cost")
        uni = gq.join(open_groups.select("group_id"), "group_id").select("group_id", "ques_id")
        # groups are bounded by the token budget, so numbering per group is bounded too
        picks = with_pick_no(set_cover(edges, gcost, key="group_id", universe=uni, max_rounds=max_rounds), "group_id")
        # append in pick order; stop once the group holds as many demos as questions
        # (at least one pick is appended per round, as in the sequential rule)
        picks = picks.join(open_groups.select("group_id", "_nd", "_nq"), "group_id") \
            .where(F.col("pick_no") <= F.greatest(F.col("_nq") - F.col("_nd"), F.lit(1)))
        picks = cut_lineage(picks)
        added.append(picks.select("group_id", "demo_id", F.lit(r).alias("extra_round"), "pick_no"))
        took = picks.groupBy("group_id", "_nd", "_nq").agg(F.count("*").alias("_t"))
        stopped = stopped.unionByName(took.where(F.col("_nd") + F.col("_t") >= F.col("_nq")).select("group_id"))
        have = have.unionByName(picks.join(gd.select("group_id", "cluster_id").distinct(), "group_id")
                                .select("cluster_id", "group_id", "demo_id"))
    if not added:
        return groups_long.sparkSession.createDataFrame(
            [], "group_id string, demo_id long, extra_round int, pick_no int")
    out = added[0]
    for a in added[1:]:
        out = out.unionByName(a)
    return out
