"""Coverage tables and their aggregates.

``cover`` is the long edge table ``(cluster_id, demo_id, ques_id)`` -- never a matrix.
All aggregates are plain ``groupBy`` (partial + final aggregation, skew-safe).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.session import cut_lineage


def cluster_cover(cover: DataFrame, clusters: DataFrame) -> DataFrame:
    """Restrict each demo's questions to the question's cluster:
    ``(cluster_id, demo_id, ques_id, dist)``."""
    cols = ["cluster_id", "demo_id", "ques_id"] + (["dist"] if "dist" in cover.columns else [])
    return cover.join(clusters.select(F.col("id").alias("ques_id"), "cluster_id"), "ques_id").select(*cols)


def cluster_demos(ccover: DataFrame) -> DataFrame:
    """Demos touching each cluster."""
    return ccover.select("cluster_id", "demo_id").distinct()


def demo_coverage(ccover: DataFrame) -> DataFrame:
    """A4: covered question set per (cluster, demo).  The kNN cover bounds each set by
    ``upper_ques``; threshold covers should use the long table instead."""
    return ccover.groupBy("cluster_id", "demo_id").agg(
        F.sort_array(F.collect_set("ques_id")).alias("ques"), F.count("*").alias("n_ques"))


def set_costs(ccover: DataFrame, ques_cost: DataFrame, demo_cost: DataFrame,
              legacy: bool = False) -> DataFrame:
    """Set cost = demo cost + cost of the questions it covers in the cluster.

    ``legacy=True`` reproduces the reference slip: every covered question is charged
    the cost of the cluster's first question."""
    qc = ques_cost.select("ques_id", F.col("cost").alias("_qc"))
    dc = demo_cost.select("demo_id", F.col("cost").alias("_dc"))
    edges = ccover.select("cluster_id", "demo_id", "ques_id")
    if legacy:
        first = edges.join(qc, "ques_id").groupBy("cluster_id").agg(
            F.min_by("_qc", "ques_id").alias("_first"))
        per = edges.groupBy("cluster_id", "demo_id").agg(F.count("*").alias("_n")) \
            .join(first, "cluster_id").select("cluster_id", "demo_id", (F.col("_n") * F.col("_first")).alias("_qs"))
    else:
        per = edges.join(qc, "ques_id").groupBy("cluster_id", "demo_id").agg(F.sum("_qc").alias("_qs"))
    return per.join(dc, "demo_id").select("cluster_id", "demo_id",
                                          (F.col("_dc") + F.col("_qs")).cast("long").alias("set_cost"))


def cover_overlap(ccover: DataFrame) -> DataFrame:
    """A5/A8/O5 per cluster: distinct questions, sets, floor(avg set size), top multiplicity
    and the most shared question (ties: lowest id)."""
    mult = ccover.groupBy("cluster_id", "ques_id").agg(F.count("*").alias("mult"))
    per_q = mult.groupBy("cluster_id").agg(
        F.count("*").alias("n_ques"), F.max("mult").alias("max_mult"),
        F.max_by("ques_id", F.struct(F.col("mult"), -F.col("ques_id"))).alias("top_ques"))
    per_d = ccover.groupBy("cluster_id").agg(F.countDistinct("demo_id").alias("n_sets"))
    return per_q.join(per_d, "cluster_id").select(
        "cluster_id", "n_ques", "n_sets", F.floor(F.col("n_ques") / F.col("n_sets")).cast("long").alias("avg_size"),
        "max_mult", "top_ques")


def uncovered_questions(questions: DataFrame, cover: DataFrame, reason: str = "no_demo") -> DataFrame:
    """Questions no demo covers -> ``unasked(ques_id, reason)``."""
    return questions.select("ques_id").join(cover.select("ques_id"), "ques_id", "left_anti") \
        .withColumn("reason", F.lit(reason))


def dominated_demos(ccover: DataFrame, demo_cost: DataFrame, symmetric: bool = False,
                    max_subset_size: int = 8, hot: int = 64) -> DataFrame:
    """Demo *i* is dominated when a later demo *j* (``j > i``; any ``j != i`` with
    ``symmetric``) of the same cluster covers a superset and costs no more.
    Output ``(cluster_id, demo_id)`` of dominated demos.

    Each covering set is treated by its own size.  One of at most ``max_subset_size``
    questions (any set of a kNN cover) lists its non-empty subsets, and a left-semi
    equi-join on (cluster, subset) finds what it covers: no candidate pairs are
    materialised.  Larger ones are looked up through prefixes of *i*'s rarest questions, as
    long as needed for at most ``hot`` candidates (``_covered_by_large``)."""
    e = cut_lineage(ccover.select("cluster_id", "demo_id", "ques_id").distinct())
    key = ["cluster_id", "demo_id"]
    size = e.groupBy(*key).agg(F.count("*").alias("_size"))
    cost = demo_cost.select("demo_id", F.col("cost").alias("_cost"))
    order = (F.col("_j") != F.col("demo_id")) if symmetric else (F.col("_j") > F.col("demo_id"))
    cheaper = order & (F.col("_cj") <= F.col("_ci"))

    # bounded collect: these sets hold at most max_subset_size questions
    sets = e.join(size.where(F.col("_size") <= max_subset_size), key).groupBy(*key).agg(
        F.sort_array(F.collect_list("ques_id")).alias("qs")).join(cost, "demo_id")
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("qs")) - 1)
    subsets = F.transform(masks, lambda m: F.filter(
        F.col("qs"), lambda x, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1))
    covering = sets.select(F.col("cluster_id").alias("_jc"), F.col("demo_id").alias("_j"), F.col("_cost").alias("_cj"),
                           F.explode(subsets).alias("_jqs"))
    by_small = sets.withColumnRenamed("_cost", "_ci").join(
        covering, (F.col("cluster_id") == F.col("_jc")) & (F.col("qs") == F.col("_jqs")) & cheaper, "left_semi").select(*key)

    large = cut_lineage(e.join(size.where(F.col("_size") > max_subset_size), key))
    if large.isEmpty():
        return by_small.distinct()
    by_large = _covered_by_large(e, size, cost, large, cheaper, hot)
    return by_small.unionByName(by_large).distinct()


def _covered_by_large(e: DataFrame, size: DataFrame, cost: DataFrame, large: DataFrame, cheaper, hot: int) -> DataFrame:
    """Demos whose questions are all in a large set that costs no more.

    A demo's questions are ordered by how few large sets hold them; the sets that hold the first l
    of them are the list of a node in a trie of such prefixes, shared by all demos that begin
    alike.  A node whose list has at most ``hot`` sets is searched: its demos meet its sets, and
    containment is counted.  A longer list is extended by one question more, as one list a node,
    not one a demo; where a demo has no further question its node's list are exactly the sets
    that contain it, and a semi join finds a cheaper one.  So a demo has at most ``hot``
    candidates, however popular its questions are."""
    key = ["cluster_id", "demo_id"]
    held = large.groupBy("cluster_id", "ques_id").agg(F.count("*").alias("_deg"))
    known = e.join(held, ["cluster_id", "ques_id"])
    whole = known.groupBy(*key).agg(F.count("*").alias("_n")).join(size, key).where(F.col("_n") == F.col("_size")).select(*key)
    by_rarity = W.partitionBy(*key).orderBy("_deg", "ques_id")
    ranks = cut_lineage(known.join(whole, key).withColumn("_rank", F.row_number().over(by_rarity)).select(*key, "ques_id", "_rank"))
    info = size.join(cost, "demo_id")
    mine = info.select(*key, F.col("_size").alias("_si"), F.col("_cost").alias("_ci"))
    theirs = info.select("cluster_id", F.col("demo_id").alias("_j"), F.col("_size").alias("_sj"), F.col("_cost").alias("_cj"))
    member = large.select("cluster_id", "ques_id", F.col("demo_id").alias("_j"))

    # level 1: a node is named by its smallest demo
    def named(rows: DataFrame, parent: list[str]) -> DataFrame:
        at = ["cluster_id", *parent, "ques_id"]
        return rows.join(rows.groupBy(*at).agg(F.min("demo_id").alias("_node")), at)

    members = named(ranks.where(F.col("_rank") == 1), []).select(*key, "ques_id", "_node")
    lists = members.select("cluster_id", "_node", "ques_id").distinct().join(member, ["cluster_id", "ques_id"]) \
        .select("cluster_id", "_node", "_j")
    found, level = [], 1
    while True:
        members, lists = cut_lineage(members.select(*key, "_node")), cut_lineage(lists)
        many = lists.groupBy("cluster_id", "_node").agg((F.count("*") > hot).alias("_hot"))
        tagged = cut_lineage(members.join(many, ["cluster_id", "_node"]).join(mine, key))
        pairs = tagged.where(~F.col("_hot")).join(lists, ["cluster_id", "_node"]).join(theirs, ["cluster_id", "_j"]) \
            .where(cheaper & (F.col("_sj") >= F.col("_si"))).select(*key, "_j", "_si")
        found.append(pairs.join(e, key).join(member, ["cluster_id", "_j", "ques_id"]).groupBy(*key, "_j", "_si")
                     .agg(F.count("*").alias("_m")).where(F.col("_m") == F.col("_si")).select(*key))
        ended = tagged.where(F.col("_hot") & (F.col("_si") == level))
        sets = lists.join(theirs, ["cluster_id", "_j"]).select(
            F.col("cluster_id").alias("_jc"), F.col("_node").alias("_jn"), "_j", "_cj")
        found.append(ended.join(sets, (F.col("cluster_id") == F.col("_jc")) & (F.col("_node") == F.col("_jn")) & cheaper, "left_semi")
                     .select(*key))
        level += 1
        going = tagged.where(F.col("_hot") & (F.col("_si") >= level)).select(*key, F.col("_node").alias("_up"))
        if going.isEmpty():
            break
        step = cut_lineage(named(going.join(ranks.where(F.col("_rank") == level).select(*key, "ques_id"), key), ["_up"]))
        grown = step.select("cluster_id", "_up", "ques_id", F.col("_node").alias("_new")).distinct()
        lists = grown.join(lists.withColumnRenamed("_node", "_up"), ["cluster_id", "_up"]).join(member, ["cluster_id", "ques_id", "_j"]) \
            .select("cluster_id", F.col("_new").alias("_node"), "_j")
        members = step
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out
