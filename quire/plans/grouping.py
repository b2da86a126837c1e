"""End-to-end grouping plan (X1, X2) and prompt assembly.

``plan_groups(questions, demos, cfg)`` runs
candidate kNN cover (J3) -> filter (P3) -> cover (J3 / P13) -> clustering
(G1 / G2 / G5 / G10) -> [dominated filter P8] -> set costs (A6) -> greedy cover
rounds (C1) -> one owner per question (C2, W4 or W5) -> item weights (A7) -> bin packing
(C3) -> [extra covers C4] -> groups (C7) -> prompts.

Inputs: ``questions(ques_id, vec, cost, ...)`` and ``demos(demo_id, vec, cost, ...)``;
ER records carry ``e1``/``e2`` maps, text records ``text``; both carry ``answer``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.config import PlanConfig
from quire.functions.prompts import item_word, render, task_text_cost
from quire.functions.strings import token_count
from quire.operators import assign, complement, coverage, graph, packing, setcover, simjoin
from quire.session import cut_lineage, prepare


@dataclass
class Plan:
    groups: DataFrame
    prompts: DataFrame | None
    clusters: DataFrame
    picks: DataFrame
    assignment: DataFrame
    unasked: DataFrame
    cover: DataFrame


def _cluster(questions: DataFrame, cfg: PlanConfig) -> DataFrame:
    pts = questions.select(F.col("ques_id").alias("id"), "vec")
    if cfg.batch_type == "diverse":
        return graph.cluster_diverse(pts, cfg.k0, n_pivots=cfg.n_pivots)
    if cfg.batch_type == "similar":
        return graph.cluster_similar(pts, cfg.k0, cfg.metric, n_pivots=cfg.n_pivots)
    if cfg.batch_type == "random":
        return graph.cluster_random(pts)
    if cfg.batch_type == "correlation" and cfg.corr_kind == "diverse":
        # far pairs attract: the near ones, which repel, are listed, the others follow from counts
        pairs = simjoin.range_join(pts, pts.withColumnRenamed("id", "id2"), "id", "id2", cfg.k0,
                                   metric=cfg.metric, self_join=True, strict=True, n_pivots=cfg.n_pivots)
        return complement.correlation_clustering_far(pts.select("id"), pairs.select(F.col("id").alias("u"), F.col("id2").alias("v")),
                                                     seeds=[0, 1, 2])
    if cfg.batch_type == "correlation":
        pairs = simjoin.range_join(pts, pts.withColumnRenamed("id", "id2"), "id", "id2", cfg.k0,
                                   metric=cfg.metric, self_join=True, n_pivots=cfg.n_pivots)
        edges = graph.affinity_edges(pairs.select(F.col("id").alias("src"), F.col("id2").alias("dst"), "dist"),
                                     cfg.k0, mode="sign", kind="similar")
        # every pair beyond k0 has sign -1: implied, not listed
        return graph.correlation_clustering(pts.select("id"), edges, seeds=[0, 1, 2], absent_weight=-1.0)
    raise ValueError(f"unknown batch_type {cfg.batch_type!r}")


def plan_groups(questions: DataFrame, demos: DataFrame, cfg: PlanConfig, render_prompts: bool = True) -> Plan:
    spark = questions.sparkSession
    prepare(spark)
    q = questions
    unasked = []
    if cfg.task == "code":
        # Questions in clusters of <= 2 similar questions are not asked
        pre = graph.cluster_similar(q.select(F.col("ques_id").alias("id"), "vec"), cfg.k0, "euclid",
                                    n_pivots=cfg.n_pivots)
        sizes = pre.groupBy("cluster_id").agg(F.count("*").alias("_n"))
        keep = pre.join(sizes, "cluster_id").where(F.col("_n") >= cfg.min_cluster_size).select(
            F.col("id").alias("ques_id"))
        unasked.append(q.select("ques_id").join(keep, "ques_id", "left_anti").withColumn(
            "reason", F.lit("small_cluster")))
        q = q.join(keep, "ques_id", "left_semi")
    q = cut_lineage(q.select("ques_id", "vec", "cost"))
    d = cut_lineage(demos.select("demo_id", "vec", "cost"))

    knn = cut_lineage(simjoin.knn_cover(q, d, cfg.k1, cfg.upper_ques, cfg.metric, n_pivots=cfg.n_pivots))
    q_f, d_f = simjoin.filter_candidates(q, d, knn)
    unasked.append(coverage.uncovered_questions(q, knn, "no_near_demo"))
    if cfg.task == "er":
        cover = knn.select("ques_id", "demo_id", "dist")          # already materialised
    else:
        cover = cut_lineage(simjoin.pair_distances(q_f, d_f, cfg.k1, cfg.metric, n_pivots=cfg.n_pivots))
    q_f = cut_lineage(q_f)

    clusters = cut_lineage(_cluster(q_f, cfg))
    ccover = cut_lineage(coverage.cluster_cover(cover, clusters))
    dcost = d.select("demo_id", "cost")
    qcost = q.select("ques_id", "cost")
    if cfg.is_dominated:
        dom = coverage.dominated_demos(ccover, dcost)
        ccover = cut_lineage(ccover.join(dom, ["cluster_id", "demo_id"], "left_anti"))
    costs = coverage.set_costs(ccover, qcost, dcost, legacy=cfg.legacy_cost)   # materialised by set_cover
    universe = clusters.select("cluster_id", F.col("id").alias("ques_id"))
    picks = setcover.set_cover(ccover, costs, universe=universe, max_rounds=cfg.max_rounds)
    picks = cut_lineage(picks)
    covered_clusters = picks.select("cluster_id").distinct()
    unasked.append(universe.join(covered_clusters, "cluster_id", "left_anti").select(
        "ques_id", F.lit("uncoverable").alias("reason")))
    owner = {"balanced": assign.assign_balanced, "last": assign.assign_last, "random": assign.assign_random}[cfg.assign]
    assignment = cut_lineage(owner(picks, ccover))
    items = assign.assign_cost(picks, assignment, qcost, dcost, keep_empty=cfg.keep_empty)
    t_cost = task_text_cost(cfg.task) if cfg.t_cost is None else cfg.t_cost
    cap = float(cfg.k2 - t_cost)
    bins = cut_lineage(packing.pack_groups(items, cap))
    extra = None
    if cfg.task in ("code", "qa") and cfg.set_cover_num > 0:
        gl = packing.groups_long(bins, assignment)
        extra = setcover.group_extra_demos(gl, ccover, costs, cfg.set_cover_num, cfg.max_rounds)
    groups = cut_lineage(packing.groups_table(bins, assignment, cap, extra))
    un = unasked[0]
    for u in unasked[1:]:
        un = un.unionByName(u)
    prompts = render_prompts_for(groups, questions, demos, cfg.task, cfg.item_word or item_word(cfg.dataset)) \
        if render_prompts else None
    return Plan(groups=groups, prompts=prompts, clusters=clusters, picks=picks, assignment=assignment,
                unasked=un, cover=ccover)


def _ordered(groups: DataFrame, col: str, records: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Per group the records of ``col`` in list order as an array of structs."""
    ex = groups.select("group_id", F.posexplode(col).alias("pos", id_col))
    j = ex.join(records.select(id_col, *fields), id_col)
    by_pos = F.array_sort(F.collect_list(F.struct("pos", *fields)),
                          lambda a, b: (a["pos"] - b["pos"]).cast("int"))
    return j.groupBy("group_id").agg(F.transform(
        by_pos, lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias(col))


def render_prompts_for(groups: DataFrame, questions: DataFrame, demos: DataFrame, task: str,
                       item: str = "Product") -> DataFrame:
    """``prompts(group_id, prompt, answers, tokens)``; lists are bounded by the budget."""
    if task == "er":
        qf, df_ = ["e1", "e2", "answer"], ["e1", "e2", "answer"]
    else:
        qf, df_ = ["text", "answer"], ["text", "answer"]
    qa = _ordered(groups, "ques", questions, "ques_id", qf)
    da = _ordered(groups, "demo", demos, "demo_id", df_)
    g = groups.select("group_id").join(qa, "group_id").join(da, "group_id")
    prompt = render(task, F.col("demo"), F.col("ques"), item)
    return g.select("group_id", prompt.alias("prompt"),
                    F.transform("ques", lambda x: x["answer"]).alias("answers")) \
        .withColumn("tokens", token_count(F.col("prompt")))


def plan_report(plan: Plan) -> dict:
    """Total prompt tokens, groups, mean questions and demos per group, unasked
    (three one-row aggregates)."""
    g = plan.groups.agg(F.count("*").alias("n_groups"), F.avg(F.size("ques")).alias("avg_ques"),
                        F.avg(F.size("demo")).alias("avg_demo"), F.sum("tokens").alias("item_tokens")).first()
    out = g.asDict()
    if plan.prompts is not None:
        out["prompt_tokens"] = plan.prompts.agg(F.sum("tokens").alias("t")).first()["t"]
    out["unasked"] = plan.unasked.count()
    return out
