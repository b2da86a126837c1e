"""End-to-end plan invariants (X1/X2) for every clustering mode and task family."""

import pytest
from pyspark.sql import functions as F

from quire import PlanConfig
from quire.operators.features import pair_features
from quire.plans.grouping import plan_groups, plan_report
from quire.plans.reports import plan_violations
from quire.sources import fixtures as fx

from conftest import SF001


def _check(plan, questions, demos, cap):
    g = plan.groups.collect()
    seen = [q for r in g for q in r["ques"]]
    assert len(seen) == len(set(seen)), "a question sits in two groups"
    asked = set(seen)
    unasked = {r["ques_id"] for r in plan.unasked.collect()}
    all_q = {r["ques_id"] for r in questions.select("ques_id").collect()}
    assert asked | unasked == all_q and not (asked & unasked)
    for r in g:
        assert r["demo"] and r["ques"]
        assert r["tokens"] <= cap or r["over_budget"]
    # each asked question's owner demo covers it
    cov = {(r["ques_id"], r["demo_id"]) for r in plan.cover.select("ques_id", "demo_id").collect()}
    for r in plan.assignment.collect():
        assert (r["ques_id"], r["demo_id"]) in cov


@pytest.mark.parametrize("batch_type", ["diverse", "similar", "random", "correlation"])
def test_plan_vec_modes(spark, batch_type):
    q = fx.vec_costs(fx.vec_questions(spark, SF001), "ques_id")
    d = fx.vec_costs(fx.vec_demos(spark, SF001), "demo_id")
    k0 = {"diverse": 0.6, "similar": 0.7, "random": 0.0, "correlation": 0.7}[batch_type]
    cfg = PlanConfig(k0=k0, k1=0.8, k2=120, upper_ques=3, batch_type=batch_type, metric="cosine", task="qa",
                     t_cost=20)
    plan = plan_groups(q, d, cfg, render_prompts=False)
    _check(plan, q, d, 100)


def test_plan_er_with_prompts_and_reports(spark):
    q = pair_features(fx.er_questions(spark, SF001))
    d = pair_features(fx.er_demos(spark, SF001))
    cfg = PlanConfig(k0=1.9, k1=0.13, k2=300, upper_ques=5, is_dominated=True)
    plan = plan_groups(q, d, cfg)
    from quire.functions.prompts import task_text_cost
    _check(plan, q, d, 300 - task_text_cost("er"))
    rep = plan_report(plan)
    assert rep["n_groups"] == plan.prompts.count() and rep["prompt_tokens"] > 0
    p = plan.prompts.first()
    assert p["prompt"].startswith("When determining") and len(p["answers"]) >= 1
    gq = plan.groups.select("group_id", F.explode("ques").alias("ques_id"))
    gd = plan.groups.select("group_id", F.explode("demo").alias("demo_id"))
    v = {r["check"]: r["n"] for r in plan_violations(gq, gd, q.join(gq.select("ques_id"), "ques_id", "left_semi"),
                                                     d, 10 ** 9, 0, cover=plan.cover).collect()}
    assert v["question_repeated"] == 0 and v["question_unassigned"] == 0 and v["under_covered"] == 0


def test_plan_code_task_extra_covers(spark):
    q = fx.vec_costs(fx.vec_questions(spark, SF001), "ques_id")
    d = fx.vec_costs(fx.vec_demos(spark, SF001), "demo_id")
    cfg = PlanConfig(k0=1.3, k1=0.85, k2=150, upper_ques=3, batch_type="similar", metric="cosine", task="code",
                     set_cover_num=2, t_cost=0)
    plan = plan_groups(q, d, cfg, render_prompts=False)
    _check(plan, q, d, 150)
    reasons = {r["reason"] for r in plan.unasked.collect()}
    assert reasons <= {"small_cluster", "no_near_demo", "uncoverable"}


def test_plan_partition_independence(spark):
    out = []
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        q = pair_features(fx.er_questions(spark, SF001)).repartition(parts)
        d = pair_features(fx.er_demos(spark, SF001))
        plan = plan_groups(q, d, PlanConfig(k0=1.9, k1=0.13, k2=300, upper_ques=5), render_prompts=False)
        out.append(sorted((r["group_id"], tuple(r["ques"]), tuple(r["demo"]), r["tokens"])
                          for r in plan.groups.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]
