"""One owner per question (C2 / W4 / W5) and item weights after it.

Default (W4): among the chosen sets that hold a question, the LAST one in pick
order keeps it -- an aggregate ``max_by`` per question, no per-cluster task.
``assign_random`` (W5): the first holder in a seeded hash order.
``assign_balanced`` (the plan's default): in pick order, each set above the cluster's
average size releases questions that another set still holds (lowest id first) down to
the average; a cluster whose first set releases nothing is left as it is; then W4
settles what is still shared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _order(picks: DataFrame) -> F.Column:
    """Pick order key: an explicit ``pick_no`` if given, else greedy order (score desc, id)."""
    if "pick_no" in picks.columns:
        return F.col("pick_no")
    return F.struct((-F.col("score")).alias("s"), F.col("demo_id").alias("d"))


def _holders(picks: DataFrame, ccover: DataFrame, key: str = "cluster_id") -> DataFrame:
    return ccover.select(key, "demo_id", "ques_id").distinct() \
        .join(picks.select(key, "demo_id", _order(picks).alias("_ord")), [key, "demo_id"])


def assign_last(picks: DataFrame, ccover: DataFrame, key: str = "cluster_id") -> DataFrame:
    """``(key, ques_id, demo_id)`` -- the holder latest in pick order (an aggregate)."""
    h = _holders(picks, ccover, key)
    return h.groupBy(key, "ques_id").agg(F.max_by("demo_id", "_ord").alias("demo_id")) \
        .select(key, "ques_id", "demo_id")


def assign_random(picks: DataFrame, ccover: DataFrame, seed: int = 0, key: str = "cluster_id") -> DataFrame:
    """The first holder in the order ``md5(seed:demo_id)`` (reproducible in SQL)."""
    h = _holders(picks, ccover, key)
    order = F.struct(F.md5(F.concat(F.lit(f"{seed}:"), F.col("demo_id").cast("string"))).alias("h"),
                     F.col("demo_id").alias("d"))
    return h.groupBy(key, "ques_id").agg(F.min_by("demo_id", order).alias("demo_id")) \
        .select(key, "ques_id", "demo_id")


def assign_balanced(picks: DataFrame, ccover: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Trim sets above the cluster average (floor(distinct questions / sets)) in pick order, then W4.

    A cluster of at most ``setcover.TASK_EDGES`` rows whose sets are picked once each is passed over in one task; others
    take rounds."""
    from quire.operators.setcover import _WHOLE, few_and_many
    from quire.session import cut_lineage

    h = cut_lineage(_holders(picks, ccover, key))
    types = dict(h.dtypes)
    named = "pick_no" in picks.columns
    if types["demo_id"] not in _WHOLE or types["ques_id"] not in _WHOLE or not h.where("ques_id is null").isEmpty() or (named and types["_ord"] not in _WHOLE):
        return _balanced_in_rounds(h, key)
    again = picks.groupBy(key, "demo_id").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(key)
    few, many = few_and_many(h, key, again)
    out = _balanced_in_tasks(few, key, named)
    return out if many is None else out.unionByName(_balanced_in_rounds(cut_lineage(many), key))


def balance(demo: np.ndarray, ques: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(ques, demo)``: the owners of one cluster's questions; a row's set is picked at ``place``."""
    order = np.lexsort((ques, demo, place))
    demo, ques = demo[order], ques[order]
    names, elem = np.unique(ques, return_inverse=True)
    begin = np.flatnonzero(np.append(True, demo[1:] != demo[:-1]))
    size = np.diff(np.append(begin, len(demo)))
    most = len(names) // len(begin)
    held, mult = np.ones(len(demo), bool), np.bincount(elem)
    for k in np.flatnonzero(size > most):
        if k and size[0] <= most:
            break
        mine = slice(begin[k], begin[k] + size[k])
        drop = np.flatnonzero(mult[elem[mine]] > 1)[:size[k] - most]
        if not k and not len(drop):
            break
        held[begin[k] + drop] = False
        mult[elem[begin[k] + drop]] -= 1
    owner = np.full(len(names), -1)
    np.maximum.at(owner, elem[held], np.flatnonzero(held))           # rows are in pick order
    return names, demo[owner]


def _balanced_in_tasks(h: DataFrame, key: str, named: bool) -> DataFrame:
    def pass_over(group: tuple, rows: pa.Table) -> pa.Table:
        ques, demo = balance(*(rows.column(c).to_numpy() for c in ("demo_id", "ques_id", "_place")))
        return pa.table({key: pa.array([group[0].as_py()] * len(ques), rows.schema.field(key).type), "ques_id": pa.array(ques), "demo_id": pa.array(demo)})

    place = F.col("_ord").cast("long") if named else F.coalesce(F.col("_ord.s"), F.lit(float("-inf"))).cast("double")
    return h.select(key, F.col("demo_id").cast("long"), F.col("ques_id").cast("long"), place.alias("_place")).groupBy(key) \
        .applyInArrow(pass_over, f"`{key}` {dict(h.dtypes)[key]}, ques_id long, demo_id long")


def _balanced_in_rounds(h: DataFrame, key: str) -> DataFrame:
    """A set is settled once no unsettled set before it holds one of its shared questions.  Then the holders of its questions are
    the very ones the pass in pick order would see, so the result is equal; every round settles at least the first
    unsettled set of each cluster."""
    from quire.session import cut_lineage

    size = h.groupBy(key, "demo_id", "_ord").agg(F.count("*").alias("_size"))
    avg = h.groupBy(key).agg(F.floor(F.countDistinct("ques_id") / F.countDistinct("demo_id")).alias("_avg"))
    open_sets = size.join(avg, key).where(F.col("_size") > F.col("_avg")) \
        .select(key, "demo_id", "_ord", (F.col("_size") - F.col("_avg")).alias("_excess"))
    shared = h.groupBy(key, "ques_id").agg(F.count("*").alias("_mult")).where(F.col("_mult") > 1)
    # the first set of a cluster must release something, or the cluster stays as it is
    first = size.groupBy(key).agg(F.min_by("demo_id", "_ord").alias("demo_id"))
    trimmed = open_sets.join(first, [key, "demo_id"], "left_semi") \
        .join(h.join(shared, [key, "ques_id"], "left_semi"), [key, "demo_id"], "left_semi").select(key)
    open_sets = cut_lineage(open_sets.join(trimmed, key, "left_semi"))
    while not open_sets.isEmpty():
        mult = h.groupBy(key, "ques_id").agg(F.count("*").alias("_mult")).where(F.col("_mult") > 1)
        cand = h.join(open_sets.select(key, "demo_id", "_excess"), [key, "demo_id"]).join(mult.select(key, "ques_id"), [key, "ques_id"])
        cand = cut_lineage(cand)
        lead = cand.groupBy(key, "ques_id").agg(F.min("_ord").alias("_lead"))
        ready = cand.join(lead, [key, "ques_id"]).groupBy(key, "demo_id").agg(
            F.bool_and(F.col("_ord") == F.col("_lead")).alias("_ready")).where("_ready").select(key, "demo_id")
        # the window runs over one set's own questions only
        rel = W.partitionBy(key, "demo_id").orderBy("ques_id")
        drop = cand.join(ready, [key, "demo_id"], "left_semi").withColumn("_r", F.row_number().over(rel)) \
            .where(F.col("_r") <= F.col("_excess")).select(key, "demo_id", "ques_id")
        h = cut_lineage(h.join(drop, [key, "demo_id", "ques_id"], "left_anti"))
        # sets that share nothing any more have nothing to release
        open_sets = cut_lineage(open_sets.join(cand.select(key, "demo_id"), [key, "demo_id"], "left_semi")
                                .join(ready, [key, "demo_id"], "left_anti"))
    return h.groupBy(key, "ques_id").agg(F.max_by("demo_id", "_ord").alias("demo_id")).select(key, "ques_id", "demo_id")


def assign_cost(picks: DataFrame, assignment: DataFrame, ques_cost: DataFrame, demo_cost: DataFrame,
                key: str = "cluster_id", keep_empty: bool = False) -> DataFrame:
    """Item weight = demo cost + cost of the questions it kept.

    A chosen demo left without questions is dropped unless ``keep_empty``."""
    qc = assignment.join(ques_cost.select("ques_id", F.col("cost").alias("_qc")), "ques_id") \
        .groupBy(key, "demo_id").agg(F.sum("_qc").alias("_qs"), F.count("*").alias("n_ques"))
    how = "left" if keep_empty else "inner"
    out = picks.select(key, "demo_id").join(qc, [key, "demo_id"], how) \
        .join(demo_cost.select("demo_id", F.col("cost").alias("_dc")), "demo_id")
    return out.select(key, "demo_id", (F.col("_dc") + F.coalesce(F.col("_qs"), F.lit(0))).cast("long").alias("weight"),
                      F.coalesce(F.col("n_ques"), F.lit(0)).alias("n_ques"))
