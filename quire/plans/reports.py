"""Plan reports over any groups table.

Groups come in long form: ``gq(group_id, ques_id)`` and ``gd(group_id, demo_id)``.
A18 (the exact plan's objective) and A19 (its constraints) become reports that can
be run on any plan, ours included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.ordering import row_number_within
from quire.session import cut_lineage


def fixed_groups(questions: DataFrame, demos: DataFrame, per_group: int, demos_each: int):
    """Questions in groups of ``per_group`` consecutive ids; the demos, in the order of their ids, in sets of
    ``demos_each``; group g takes set g modulo the number of sets.

    Every question is in one group and every group has demos (if there are any), so ``gd`` holds at most
    ``demos_each`` rows a group, however many demos there are."""
    gq = questions.select(F.floor(F.col("ques_id") / per_group).cast("long").alias("group_id"), "ques_id")
    n_sets = max(1, -(-demos.count() // demos_each))
    numbered = row_number_within(demos.select("demo_id"), [], [F.col("demo_id")], "_no", kind="long")
    sets = numbered.select("demo_id", F.expr(f"(_no - 1) div {demos_each}").alias("_set"))
    groups = gq.select("group_id").distinct().withColumn("_set", F.pmod(F.col("group_id"), F.lit(n_sets).cast("long")))
    return gq, groups.join(sets, "_set").select("group_id", "demo_id")


def residue_groups(questions: DataFrame, demos: DataFrame, per_group: int, demo_mod: int):
    """Questions in groups of ``per_group`` consecutive ids; a demo joins every group g with
    ``demo_id % demo_mod = g % demo_mod`` (an equi-join on the residue)."""
    gq = questions.select(F.floor(F.col("ques_id") / per_group).cast("long").alias("group_id"), "ques_id")
    groups = gq.select("group_id").distinct().withColumn("_r", F.pmod(F.col("group_id"), F.lit(demo_mod)))
    dm = demos.select("demo_id", F.pmod(F.col("demo_id"), F.lit(demo_mod)).alias("_r"))
    return gq, groups.join(dm, "_r").select("group_id", "demo_id")


def _group_tokens(gq, gd, questions, demos, t_cost) -> DataFrame:
    qt = gq.join(questions.select("ques_id", "cost"), "ques_id").groupBy("group_id") \
        .agg(F.sum("cost").alias("_q"), F.count("*").alias("_nq"))
    dt = gd.join(demos.select("demo_id", "cost"), "demo_id").groupBy("group_id") \
        .agg(F.sum("cost").alias("_d"), F.count("*").alias("_nd"))
    return qt.join(dt, "group_id", "full").select(
        "group_id", F.coalesce("_q", F.lit(0)).alias("_q"), F.coalesce("_d", F.lit(0)).alias("_d"),
        F.coalesce("_nq", F.lit(0)).alias("_nq"), F.coalesce("_nd", F.lit(0)).alias("_nd"),
        (F.coalesce("_q", F.lit(0)) + F.coalesce("_d", F.lit(0)) + F.lit(t_cost)).alias("tokens"))


def plan_tokens(gq, gd, questions, demos, t_cost: int) -> DataFrame:
    """A2: number of groups and total tokens (task text counted once per group)."""
    t = _group_tokens(gq, gd, questions, demos, t_cost)
    return t.agg(F.count("*").cast("long").alias("n_groups"), F.sum("tokens").cast("long").alias("total_tokens"))


def plan_stats(gq, gd) -> DataFrame:
    """Mean questions and demos per group."""
    nq = gq.groupBy("group_id").agg(F.count("*").alias("_nq"))
    nd = gd.groupBy("group_id").agg(F.count("*").alias("_nd"))
    j = nq.join(nd, "group_id", "full")
    return j.agg(F.count("*").cast("long").alias("n_groups"), F.avg(F.coalesce("_nq", F.lit(0))).alias("avg_ques"),
                 F.avg(F.coalesce("_nd", F.lit(0))).alias("avg_demo"))


def plan_objective(gq, gd, questions, demos, t_cost: int) -> DataFrame:
    """Question tokens + demo tokens + task tokens per used group, summed."""
    t = _group_tokens(gq, gd, questions, demos, t_cost)
    used = t.where((F.col("_nq") > 0) | (F.col("_nd") > 0))
    return used.agg(F.sum("_q").cast("long").alias("ques_tokens"), F.sum("_d").cast("long").alias("demo_tokens"),
                    (F.count("*") * F.lit(t_cost)).cast("long").alias("task_tokens"),
                    F.sum("tokens").cast("long").alias("objective"))


def plan_violations(gq, gd, questions, demos, k2: int, t_cost: int, cover: DataFrame | None = None,
                    cover_cnt: int = 1, forbidden: DataFrame | None = None) -> DataFrame:
    """``(check, n)`` for each constraint of the exact plan.

    * ``question_repeated``   -- a question in more than one group
    * ``question_unassigned`` -- a question in no group
    * ``under_covered``       -- a question with fewer than ``cover_cnt`` covering demos in its
      group (``cover(ques_id, demo_id)``; without a cover every demo counts)
    * ``over_budget``         -- group tokens above ``k2``
    * ``forbidden_pair``      -- two questions of a group listed in ``forbidden(q1, q2)``
    * ``empty_group``         -- a group with demos but no question, or questions but no demo"""
    spark = gq.sparkSession
    rep = gq.groupBy("ques_id").agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    un = questions.select("ques_id").join(gq, "ques_id", "left_anti")
    qd = gq.join(gd, "group_id")
    if cover is not None:
        qd = qd.join(cover.select("ques_id", "demo_id"), ["ques_id", "demo_id"], "left_semi")
    cnt = gq.join(qd.groupBy("group_id", "ques_id").agg(F.count("*").alias("_c")), ["group_id", "ques_id"], "left")
    under = cnt.where(F.coalesce("_c", F.lit(0)) < cover_cnt)
    t = _group_tokens(gq, gd, questions, demos, t_cost)
    over = t.where(F.col("tokens") > k2)
    empty = t.where((F.col("_nq") == 0) | (F.col("_nd") == 0))
    if forbidden is not None:
        f1 = forbidden.join(gq.withColumnRenamed("ques_id", "q1"), "q1") \
            .join(gq.withColumnRenamed("ques_id", "q2"), ["group_id", "q2"])
        nf = f1.groupBy().agg(F.count("*").alias("n"))
    else:
        nf = spark.createDataFrame([(0,)], "n long")

    def n(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy().agg(F.count("*").cast("long").alias("n")).select(F.lit(name).alias("check"), "n")

    out = n(rep, "question_repeated").unionByName(n(un, "question_unassigned")) \
        .unionByName(n(under, "under_covered")).unionByName(n(over, "over_budget")) \
        .unionByName(nf.select(F.lit("forbidden_pair").alias("check"), F.col("n").cast("long"))) \
        .unionByName(n(empty, "empty_group"))
    return out


def cover_lower_bound(cover: DataFrame, demo_cost: DataFrame, rounds: int = 8) -> DataFrame:
    """``bound``: what any choice of demos that covers every question of ``cover(ques_id, demo_id)`` costs at least.

    Dual ascent in rounds: each question raises its price by the least share that one of its demos has
    left, a demo's share being what its cost exceeds the prices of its questions by, split among those that
    still rise; a question with an exhausted demo stops.  No demo's questions ever pay more than it costs, so after
    any number of rounds the prices add up to a bound."""
    e = cut_lineage(cover.select("ques_id", "demo_id").distinct())
    slack = cut_lineage(e.select("demo_id").distinct().join(demo_cost.select("demo_id", F.col("cost").cast("double").alias("slack")), "demo_id"))
    rising = e
    total = None
    for _ in range(rounds):
        share = rising.groupBy("demo_id").agg(F.count("*").alias("_n")).join(slack, "demo_id") \
            .select("demo_id", (F.col("slack") / F.col("_n")).alias("_share"))
        # every demo of a rising question has that question rising, so it has a share
        step = cut_lineage(rising.join(share, "demo_id").groupBy("ques_id").agg(F.min("_share").alias("_up")))
        total = step.select("_up") if total is None else total.unionByName(step.select("_up"))
        paid = rising.join(step, "ques_id").groupBy("demo_id").agg(F.sum("_up").alias("_paid"))
        slack = cut_lineage(slack.join(paid, "demo_id", "left").select(
            "demo_id", F.greatest(F.lit(0.0), F.round(F.col("slack") - F.coalesce("_paid", F.lit(0.0)), 9)).alias("slack")))
        stopped = e.join(slack.where(F.col("slack") <= 1e-6), "demo_id").select("ques_id").distinct()
        rising = cut_lineage(rising.join(stopped, "ques_id", "left_anti"))
        if rising.isEmpty():
            break
    return total.agg(F.coalesce(F.sum("_up"), F.lit(0.0)).alias("bound"))


def plan_lower_bound(gq, gd, questions, demos, cover, k2: int, t_cost: int, rounds: int = 8) -> DataFrame:
    """The plan's objective against a bound that no plan of the same questions can go below.

    ``ques_tokens`` of the asked questions, ``demo_bound`` for the demos that cover them (``cover_lower_bound``),
    ``task_bound`` for the groups that so many tokens need at least, their sum, and ``gap`` = the part of
    the objective above it."""
    asked = gq.select("ques_id").distinct()
    ques = asked.join(questions.select("ques_id", "cost"), "ques_id").agg(F.coalesce(F.sum("cost"), F.lit(0)).cast("long").alias("ques_tokens"))
    bound = cover_lower_bound(cover.join(asked, "ques_id", "left_semi"), demos, rounds)
    objective = plan_objective(gq, gd, questions, demos, t_cost).select("objective")
    one = ques.unionByName(bound, allowMissingColumns=True).unionByName(objective, allowMissingColumns=True) \
        .agg(F.max("ques_tokens").alias("ques_tokens"), F.max("bound").alias("demo_bound"), F.max("objective").alias("objective"))
    least = F.ceil((F.col("ques_tokens") + F.col("demo_bound")) / F.lit(float(k2 - t_cost))) * F.lit(t_cost)
    one = one.withColumn("task_bound", least.cast("long"))
    one = one.withColumn("lower_bound", F.col("ques_tokens") + F.col("demo_bound") + F.col("task_bound"))
    return one.select("ques_tokens", "demo_bound", "task_bound", "lower_bound", F.col("objective").cast("long").alias("objective"),
                      F.try_divide(F.col("objective") - F.col("lower_bound"), F.col("objective")).alias("gap"))
