"""Registered queries over the driver's tables (one per operator of the survey).

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame whose column names
match the DuckDB statement of the same name in ``quire.oracle``.  Doubles are
rounded to 6 digits in both.  Fixture rules are in ``quire.sources.fixtures``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import PlanConfig
from quire.functions.prompts import task_text_cost
from quire.functions.replies import parse_json_reply, parse_yes_no
from quire.functions.strings import entity_text, lcs_ratio
from quire.functions.vectors import reciprocal
from quire.operators import assign, bandcount, coverage, evaluate, features, graph, lsh, packing, setcover, simjoin
from quire.operators.features import feature_vector, max_value_length
from quire.plans import grouping, reports
from quire.session import cut_lineage, ensure_checkpoint_dir, prepare
from quire.sources import fixtures as fx
from quire.sources import tables

# Parameters of the registered queries (fixed for the oracle comparison).
VEC_K1 = 0.8          # cosine threshold of the VEC cover
UPPER = 3             # nearest questions per demo
EUC_R = 1.2           # Euclidean radius of the plain distance joins
PIVOT_R = 1.1         # radius of the pivot-join query
EPS_SIM = 0.7         # cosine eps of similar clustering / eps edges
K0_DIV = 0.6          # diverse clustering threshold on VEC (1/d <= k0)
K0_DENSE = 0.77       # the same with most pairs far
K0_CORR = 0.85        # cosine distance from which questions attract in diverse correlation grouping
K0_AFF = 1.2          # affinity threshold
AFF_R = 1.25          # radius of the affinity pairs
PCT = 0.00001         # per-question distance quantile (0.001 %)
QUARTER = 0.25        # the quartile, for the same reports
BAND_K0, BAND_K1 = 0.1, 0.05   # bands of the pivot distances among questions, between questions and demos
LSH_R = 0.55          # cosine radius of the approximate join
LSH_RECALL = 0.97     # wanted share of the pairs at that radius
COVER_CNT = 2         # top-up target per question
TXT_GROUP = 10        # documents per fixed group
TXT_DEMO_MOD = 8      # benchmark item joins group g when item_id % 8 = g % 8
TXT_DEMOS = 8         # demos of a group of the constraint report
ER_GROUP = 10         # ER pairs per fixed group (two demos, eight questions)
K2_REPORT = 20000     # budget of the report queries
T_COST = 50           # task text tokens of the report queries
SEED = 7              # seed of the random assignment
ER_CFG = PlanConfig(k0=1.9, k1=0.13, k2=300, upper_ques=5, batch_type="diverse", metric="euclid", task="er")
ER_SIMILAR = ER_CFG.with_(batch_type="similar", k0=0.02)
ER_RANDOM = ER_CFG.with_(batch_type="random")
ER_DOMINATED = ER_SIMILAR.with_(is_dominated=True)
CODE_CFG = PlanConfig(k0=1.15, k1=VEC_K1, k2=200, upper_ques=UPPER, batch_type="random", metric="cosine", task="code", set_cover_num=2)
BOUND_ROUNDS = 8      # rounds of the objective's lower bound
MANHATTAN_R = 0.1     # radius of the caller's distance
WEAK_EDGE = 0.05      # weights below it are no values in components_non_value
PROMPT_DEMOS = 4      # demos of a QA / transform prompt

Query = Callable[[SparkSession, str], DataFrame]


def _r(c) -> F.Column:
    return F.round(c, 6)


def _csv(arr) -> F.Column:
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), ",")


# ---------------------------------------------------------------------------
# ER fixture (part pairs): scans, entity text, features
# ---------------------------------------------------------------------------

def scan_pairs(spark, sf):
    p = fx.er_pairs(spark, sf)
    return p.select("id", "is_demo", "answer", F.col("cost").cast("int").alias("cost"),
                    entity_text(F.col("e1")).alias("e1_text"), entity_text(F.col("e2")).alias("e2_text"))


def render_entity(spark, sf):
    p = fx.er_pairs(spark, sf)
    return p.select("id", entity_text(F.col("e1")).alias("e1_text"), entity_text(F.col("e2")).alias("e2_text"))


def token_cost(spark, sf):
    q = fx.txt_questions(spark, sf).select(F.lit("ques").alias("role"), F.col("ques_id").alias("id"), "cost")
    d = fx.txt_demos(spark, sf).select(F.lit("demo").alias("role"), F.col("demo_id").alias("id"), "cost")
    return q.unionByName(d).select("role", "id", F.col("cost").cast("int").alias("cost"))


def field_similarity(spark, sf):
    """F1 through the JVM expression (length bound measured first; the Arrow path is the default
    of ``pair_features``)."""
    p = fx.er_pairs(spark, sf)
    m = max_value_length(p)
    ex = p.select("id", "e1", "e2", F.explode(F.map_keys("e1")).alias("attr"))
    return ex.select("id", "attr", _r(lcs_ratio(F.element_at("e1", F.col("attr")),
                                                F.element_at("e2", F.col("attr")), max_len=m)).alias("ratio"))


def pair_features(spark, sf):
    """F2 through the default (Arrow) path."""
    p = fx.er_pairs(spark, sf)
    v = feature_vector(F.col("e1"), F.col("e2"))
    return p.select("id", v.alias("f")).select(
        "id", _r(F.col("f")[0]).alias("f_name"), _r(F.col("f")[1]).alias("f_brand"), _r(F.col("f")[2]).alias("f_type"))


def pair_features_distinct(spark, sf):
    """F1 once per distinct pair of values, joined back."""
    v = features.pair_features_distinct(fx.er_pairs(spark, sf), "id", "f")
    return v.select("id", _r(F.col("f")[0]).alias("f_name"), _r(F.col("f")[1]).alias("f_brand"), _r(F.col("f")[2]).alias("f_type"))


def _json_folder(spark, name):
    """A new folder beside the checkpoints, which all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/json-{name}-{uuid.uuid4().hex}"


def jsonl_pairs(spark, sf):
    """The entity pairs as JSON lines in key order, read back by the record reader."""
    path = _json_folder(spark, "pairs")
    pair = F.struct(F.col("e1").alias("entity1"), F.col("e2").alias("entity2")).alias("question")
    fx.er_pairs(spark, sf).orderBy("id").select(pair, "answer").write.json(path)
    return tables.read_records(spark, path, "er").select(
        "ques_id", "answer", F.col("cost").cast("int").alias("cost"), entity_text(F.col("e1")).alias("e1_text"),
        entity_text(F.col("e2")).alias("e2_text"))


def jsonl_texts(spark, sf):
    """The documents as JSON lines of the transform task, read back by the record reader."""
    path = _json_folder(spark, "texts")
    tables.read_table(spark, sf, "documents").orderBy("doc_id").select(
        F.col("source").alias("table_name"), F.col("text").alias("question"), F.col("lang").alias("answer")).write.json(path)
    return tables.read_records(spark, path, "jd").select(
        "ques_id", "table_name", "answer", F.col("cost").cast("int").alias("cost"), F.md5("text").alias("text_md5"))


def parquet_texts(spark, sf):
    """The documents through the columnar reader, with the task of a dataset's name."""
    path = _json_folder(spark, "columns")
    tables.read_table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("question"), F.col("lang").alias("answer")).write.parquet(path)
    return tables.read_records_parquet(spark, path, tables.task_of("StrategyQA"), "doc_id", dataset="StrategyQA").select(
        "ques_id", "task", "dataset", "answer", F.col("cost").cast("int").alias("cost"), F.md5("text").alias("text_md5"))


# ---------------------------------------------------------------------------
# VEC fixture: distance joins, kNN cover, filters
# ---------------------------------------------------------------------------

def _vq(spark, sf):
    return fx.vec_questions(spark, sf)


def _vd(spark, sf):
    return fx.vec_demos(spark, sf)


def pair_dist_euclid(spark, sf):
    p = simjoin.pair_distances(_vq(spark, sf), _vd(spark, sf), EUC_R, "euclid")
    return p.select("ques_id", "demo_id", _r(F.col("dist")).alias("dist"))


def pair_dist_cosine(spark, sf):
    p = simjoin.pair_distances(_vq(spark, sf), _vd(spark, sf), VEC_K1, "cosine")
    return p.select("ques_id", "demo_id", _r(F.col("dist")).alias("dist"))


def pair_dist_recip(spark, sf):
    p = simjoin.pair_distances(_vq(spark, sf), _vd(spark, sf), EUC_R, "euclid")
    return p.select("ques_id", "demo_id", _r(reciprocal(F.col("dist"))).alias("recip"))


def self_dist(spark, sf):
    q = _vq(spark, sf)
    p = simjoin.range_join(q, q.withColumnRenamed("ques_id", "ques_id2"), "ques_id", "ques_id2", EUC_R,
                           metric="euclid", self_join=True)
    return p.select(F.col("ques_id").alias("q1"), F.col("ques_id2").alias("q2"), _r(F.col("dist")).alias("dist"))


def _knn(spark, sf):
    return simjoin.knn_cover(_vq(spark, sf), _vd(spark, sf), VEC_K1, UPPER, "cosine")


def knn_cover(spark, sf):
    return _knn(spark, sf).select("ques_id", "demo_id", _r(F.col("dist")).alias("dist"),
                                  F.col("rank").cast("int").alias("rank"))


def knn_topk3(spark, sf):
    k = simjoin.knn_join(_vd(spark, sf), _vq(spark, sf), "demo_id", "ques_id", 3, metric="cosine")
    return k.select("demo_id", "ques_id", _r(F.col("dist")).alias("dist"), F.col("rank").cast("int").alias("rank"))


def cover_threshold(spark, sf):
    p = simjoin.pair_distances(_vq(spark, sf), _vd(spark, sf), 0.75, "cosine")
    return p.groupBy("demo_id").agg(F.count("*").alias("n_ques"))


def topup_cover(spark, sf):
    t = simjoin.topup_cover(_knn(spark, sf), _vq(spark, sf), _vd(spark, sf), COVER_CNT, "cosine")
    return t.select("ques_id", "demo_id", _r(F.col("dist")).alias("dist"))


def filter_candidates(spark, sf):
    q, d = simjoin.filter_candidates(_vq(spark, sf), _vd(spark, sf), _knn(spark, sf))
    return q.select(F.lit("ques").alias("role"), F.col("ques_id").alias("id")).unionByName(
        d.select(F.lit("demo").alias("role"), F.col("demo_id").alias("id")))


def filter_demos_topk(spark, sf):
    _, d = simjoin.filter_candidates(_vq(spark, sf), _vd(spark, sf), _knn(spark, sf))
    return d.select("demo_id")


def filter_demos_within(spark, sf):
    p = simjoin.pair_distances(_vq(spark, sf), _vd(spark, sf), VEC_K1, "cosine", nearest=1)      # any one pair decides
    return simjoin.filter_demos_within(_vd(spark, sf), p).select("demo_id")


def group_coverage(spark, sf):
    groups = _vq(spark, sf).select(F.floor(F.col("ques_id") / 40).cast("long").alias("group_id"), "ques_id")
    g = simjoin.group_coverage_within(_vq(spark, sf), _vd(spark, sf), groups, VEC_K1, "cosine")
    return g.select("group_id", "demo_id", F.size("ques").cast("long").alias("n_ques"), _csv(F.col("ques")).alias("ques"))


def pivot_join(spark, sf):
    p = simjoin.range_join(_vd(spark, sf), _vq(spark, sf), "demo_id", "ques_id", PIVOT_R, metric="euclid",
                           n_pivots=3)
    return p.select("ques_id", "demo_id", _r(F.col("dist")).alias("dist"))


def pair_dist_tree(spark, sf):
    """J1 through the tree of centres, whether or not it prunes these vectors."""
    p = simjoin.range_join(_vd(spark, sf), _vq(spark, sf), "demo_id", "ques_id", EUC_R, metric="euclid", engine="tree")
    return p.select("ques_id", "demo_id", _r(F.col("dist")).alias("dist"))


def pair_dist_cosine_lsh(spark, sf):
    """J2, approximate and opt-in: most pairs within the radius (see ``lsh_recall``)."""
    p = lsh.lsh_join(_vd(spark, sf), _vq(spark, sf), "demo_id", "ques_id", LSH_R, recall=LSH_RECALL)
    return p.select("ques_id", "demo_id", _r(F.col("dist")).alias("dist"))


def lsh_recall(spark, sf):
    """The approximate join of all vectors against the exact one: exact pairs, found pairs that are not
    among them, and whether nine tenths were found."""
    v = fx.vectors(spark, sf)
    other = v.withColumnRenamed("id", "id2")
    exact = simjoin.range_join(v, other, "id", "id2", LSH_R, metric="cosine", self_join=True)
    found = lsh.lsh_join(v, other, "id", "id2", LSH_R, recall=LSH_RECALL, self_join=True)
    both = exact.select("id", "id2", F.col("dist").alias("_e")).join(found.select("id", "id2", F.col("dist").alias("_f")), ["id", "id2"], "full")
    return both.agg(F.count("_e").alias("n_exact"), F.count_if(F.col("_e").isNull() | (F.col("_f") != F.col("_e"))).alias("n_outside"),
                    F.coalesce(F.count("_f") >= 0.9 * F.count("_e"), F.lit(True)).alias("recall_ok"))


def pivot_prune_stats(spark, sf):
    q, d = _vq(spark, sf), _vd(spark, sf)
    w = simjoin.range_join(d, q, "demo_id", "ques_id", PIVOT_R, metric="euclid", n_pivots=3)
    tagged = q.select(F.lit("l").alias("k")).unionByName(d.select(F.lit("r").alias("k"))) \
        .unionByName(w.select(F.lit("w").alias("k")))
    c = tagged.groupBy().agg(*[F.count_if(F.col("k") == t).cast("long").alias(n)
                               for t, n in (("l", "n_left"), ("r", "n_right"), ("w", "n_within"))])
    counts = bandcount.prune_counts(q, d, BAND_K0, BAND_K1)
    both = c.select("n_left", "n_right", (F.col("n_left") * F.col("n_right")).cast("long").alias("n_full"), "n_within") \
        .unionByName(counts, allowMissingColumns=True)
    return both.agg(*[F.max(x).alias(x) for x in both.columns])          # two rows become one


def dist_percentile_q25(spark, sf):
    """A3 at the quartile, by counting."""
    p = simjoin.dist_percentile(_vq(spark, sf), _vd(spark, sf), QUARTER, "cosine")
    return p.select("ques_id", _r(F.col("pct")).alias("pct"))


def eps_edges(spark, sf):
    v = fx.vectors(spark, sf)
    p = simjoin.range_join(v, v.withColumnRenamed("id", "id2"), "id", "id2", EPS_SIM, metric="cosine",
                           self_join=True)
    return p.select(F.col("id").alias("src"), F.col("id2").alias("dst"), _r(F.col("dist")).alias("dist"))


def dist_percentile(spark, sf):
    p = simjoin.dist_percentile(_vq(spark, sf), _vd(spark, sf), PCT, "cosine")
    return p.select("ques_id", _r(F.col("pct")).alias("pct"))


def cover_percentile(spark, sf):
    _, pairs = simjoin.cover_percentile(_vq(spark, sf), _vd(spark, sf), PCT, "cosine")
    return pairs.select("ques_id", "demo_id", _r(F.col("dist")).alias("dist"))


# ---------------------------------------------------------------------------
# VEC coverage with the given clustering (cluster = question label)
# ---------------------------------------------------------------------------

def _ccover(spark, sf):
    clusters = _vq(spark, sf).select(F.col("ques_id").alias("id"), F.col("label").cast("long").alias("cluster_id"))
    return coverage.cluster_cover(_knn(spark, sf), clusters)


def _vcost(spark, sf):
    q = fx.vec_costs(_vq(spark, sf), "ques_id").select("ques_id", "cost")
    d = fx.vec_costs(_vd(spark, sf), "demo_id").select("demo_id", "cost")
    return q, d


def demo_coverage(spark, sf):
    c = coverage.demo_coverage(_ccover(spark, sf))
    return c.select("cluster_id", "demo_id", F.col("n_ques").cast("long"), _csv(F.col("ques")).alias("ques"))


def cover_cost(spark, sf):
    qc, dc = _vcost(spark, sf)
    return coverage.set_costs(_ccover(spark, sf), qc, dc)


def cover_overlap(spark, sf):
    o = coverage.cover_overlap(_ccover(spark, sf))
    return o.select("cluster_id", F.col("n_ques").cast("long"), F.col("n_sets").cast("long"), "avg_size",
                    F.col("max_mult").cast("long"), "top_ques")


def cluster_demos(spark, sf):
    return coverage.cluster_demos(_ccover(spark, sf))


def uncovered_questions(spark, sf):
    return coverage.uncovered_questions(_vq(spark, sf), _knn(spark, sf))


def dominated_demos(spark, sf):
    _, dc = _vcost(spark, sf)
    return coverage.dominated_demos(_ccover(spark, sf), dc)


# ---------------------------------------------------------------------------
# Graph and clustering
# ---------------------------------------------------------------------------

def components(spark, sf):
    return graph.components(fx.graph_nodes(spark, sf), fx.graph_edges(spark, sf))


def _similar(spark, sf):
    return graph.cluster_similar(_vq(spark, sf).select(F.col("ques_id").alias("id"), "vec"), EPS_SIM, "cosine")


def cluster_similar(spark, sf):
    return _similar(spark, sf)


def cluster_diverse(spark, sf):
    return graph.cluster_diverse(_vq(spark, sf).select(F.col("ques_id").alias("id"), "vec"), K0_DIV)


def cluster_diverse_dense(spark, sf):
    """G2 where most pairs are far, but no two points so far that they reach everything."""
    return graph.cluster_diverse(_vq(spark, sf).select(F.col("ques_id").alias("id"), "vec"), K0_DENSE)


def cluster_stats(spark, sf):
    sizes = _similar(spark, sf).groupBy("cluster_id").agg(F.count("*").alias("size"))
    return sizes.agg(F.count("*").cast("long").alias("n_clusters"), F.sum("size").cast("long").alias("n_points"),
                     F.max("size").cast("long").alias("max_size"),
                     F.count_if(F.col("size") == 1).cast("long").alias("n_singletons"))


def cluster_size_filter(spark, sf):
    lab = _similar(spark, sf)
    sizes = lab.groupBy("cluster_id").agg(F.count("*").alias("_n"))
    return lab.join(sizes, "cluster_id").where(F.col("_n") > 2).select("id", "cluster_id")


def cluster_random(spark, sf):
    """Every filtered question in one cluster."""
    q, _ = simjoin.filter_candidates(_vq(spark, sf), _vd(spark, sf), _knn(spark, sf))
    return graph.cluster_random(q.select(F.col("ques_id").alias("id")))


def clusters_by_size(spark, sf):
    return graph.clusters_by_size(_similar(spark, sf)).select("cluster_id", F.col("size").cast("long"), "min_member")


def affinity_edges(spark, sf):
    q = _vq(spark, sf)
    p = simjoin.range_join(q, q.withColumnRenamed("ques_id", "q2"), "ques_id", "q2", AFF_R, metric="euclid",
                           self_join=True)
    e = graph.affinity_edges(p.select(F.col("ques_id").alias("src"), F.col("q2").alias("dst"), "dist"), K0_AFF,
                             mode="sign", kind="diverse")
    return e.select("src", "dst", F.col("weight").cast("double"))


def components_non_value(spark, sf):
    """Components where a caller's rule says which weights are no values (here: weak ones)."""
    return graph.components(fx.graph_nodes(spark, sf), fx.graph_edges(spark, sf), is_non_value=F.col("weight") < WEAK_EDGE)


def edge_transform(spark, sf):
    e = graph.edge_transform(fx.graph_edges(spark, sf), lambda w: F.abs(w) * 10)
    return e.select("src", "dst", _r(F.col("weight")).alias("weight"))


def _noisy_labels(spark, sf):
    e = cut_lineage(graph.star_edges(fx.graph_edges(spark, sf).where(F.col("weight") >= 0)))
    touched = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    labels = graph.connected_components(touched, e)
    return graph.label_nodes(fx.graph_nodes(spark, sf), labels)


def label_nodes(spark, sf):
    return _noisy_labels(spark, sf)


def clusters_without_noise(spark, sf):
    """Clusters by size where nodes without a label do not count."""
    c = graph.clusters_by_size(_noisy_labels(spark, sf), keep_noise=False)
    return c.select("cluster_id", F.col("size").cast("long"), "min_member")


def _label_clusters(spark, sf):
    return fx.graph_nodes(spark, sf).select("id", F.col("label").cast("long").alias("cluster_id"))


def split_clusters(spark, sf):
    return graph.split_clusters(_label_clusters(spark, sf), fx.graph_edges(spark, sf))


def corr_loss_linear(spark, sf):
    return graph.loss_by_name("linear_loss")(fx.graph_edges(spark, sf), _label_clusters(spark, sf)).select(_r(F.col("loss")).alias("loss"))


def corr_loss_binary(spark, sf):
    return graph.loss_by_name("binary_loss")(fx.graph_edges(spark, sf), _label_clusters(spark, sf)).select(_r(F.col("loss")).alias("loss"))


def corr_loss_poles(spark, sf):
    e = fx.graph_edges(spark, sf).withColumn("kind", F.when(F.col("weight") < 0, F.lit("min")).otherwise(F.lit("max")))
    return graph.loss_by_name("binary_loss_poles")(e, _label_clusters(spark, sf)).select(_r(F.col("loss")).alias("loss"))


def corr_best(spark, sf):
    base = _label_clusters(spark, sf)
    runs = base.select(F.lit(0).cast("long").alias("seed"), "id", "cluster_id").unionByName(
        base.select(F.lit(1).cast("long").alias("seed"), "id", (F.col("cluster_id") % 2).alias("cluster_id"))
    ).unionByName(base.select(F.lit(2).cast("long").alias("seed"), "id", (F.col("cluster_id") % 3).alias("cluster_id")))
    losses = graph.loss_linear(fx.graph_edges(spark, sf), runs, key=["seed"])
    return graph.best_state(losses).select("seed", _r(F.col("loss")).alias("loss"))


def corr_cluster(spark, sf):
    return graph.correlation_clustering(fx.graph_nodes(spark, sf).select("id"), fx.graph_edges(spark, sf), [0, 1, 2])


def corr_cluster_refined(spark, sf):
    """G5 with the local search on the loss."""
    e = fx.graph_edges(spark, sf)
    return graph.refine_clusters(graph.correlation_clustering(fx.graph_nodes(spark, sf).select("id"), e, [0, 1, 2]), e)


# ---------------------------------------------------------------------------
# Set cover, assignment, packing
# ---------------------------------------------------------------------------

def _picks(spark, sf):
    qc, dc = _vcost(spark, sf)
    cc = cut_lineage(_ccover(spark, sf))     # read by the costs, the cover and the assignment
    costs = coverage.set_costs(cc, qc, dc)
    return setcover.set_cover(cc, costs), cc, costs


def set_cover(spark, sf):
    p, _, _ = _picks(spark, sf)
    return setcover.with_pick_no(p).select("cluster_id", "demo_id", _r(F.col("score")).alias("score"),
                                           F.col("pick_no").cast("int"))


def _explicit_picks(spark, sf):
    """Every demo of the cluster, in demo_id order (explicit pick order for the oracle)."""
    cc = _ccover(spark, sf)
    return cc.select("cluster_id", "demo_id").distinct().withColumn("pick_no", F.col("demo_id")) \
        .withColumn("score", F.lit(None).cast("double")), cc


def assign_last(spark, sf):
    p, cc = _explicit_picks(spark, sf)
    return assign.assign_last(p, cc)


def assign_random(spark, sf):
    p, cc = _explicit_picks(spark, sf)
    return assign.assign_random(p, cc, seed=SEED)


def assign_cost(spark, sf):
    p, cc = _explicit_picks(spark, sf)
    qc, dc = _vcost(spark, sf)
    a = assign.assign_last(p, cc)
    return assign.assign_cost(p, a, qc, dc).select("cluster_id", "demo_id", "weight",
                                                   F.col("n_ques").cast("long"))


def assign_balanced(spark, sf):
    p, cc, _ = _picks(spark, sf)
    return assign.assign_balanced(p, cc)


def _bins(spark, sf, cap=60.0):
    p, cc, _ = _picks(spark, sf)
    qc, dc = _vcost(spark, sf)
    a = assign.assign_last(p, cc)
    items = assign.assign_cost(p, a, qc, dc)
    return packing.pack_groups(items, cap), a


def pack_groups(spark, sf):
    b, _ = _bins(spark, sf)
    return b


def groups_long(spark, sf):
    b, a = _bins(spark, sf)
    return packing.groups_long(b, a)


def group_extra_demos(spark, sf):
    p, cc, costs = _picks(spark, sf)
    qc, dc = _vcost(spark, sf)
    a = assign.assign_last(p, cc)
    items = assign.assign_cost(p, a, qc, dc)
    b = packing.pack_groups(items, 60.0)
    return setcover.group_extra_demos(packing.groups_long(b, a), cc, costs, 2)


def _groups_out(g: DataFrame) -> DataFrame:
    return g.select("cluster_id", "group_id", F.size("ques").cast("long").alias("n_ques"),
                    F.size("demo").cast("long").alias("n_demo"), _csv(F.col("ques")).alias("ques"),
                    _csv(F.col("demo")).alias("demo"), "tokens", "over_budget")


def plan_groups(spark, sf):
    return _er_plan(spark, sf, ER_CFG)


def _er_inputs(spark, sf):
    from quire.operators.features import pair_features as feats
    return feats(fx.er_questions(spark, sf)), feats(fx.er_demos(spark, sf))


def _er_plan(spark, sf, cfg):
    return _groups_out(grouping.plan_groups(*_er_inputs(spark, sf), cfg, render_prompts=False).groups)


def plan_groups_similar(spark, sf):
    return _er_plan(spark, sf, ER_SIMILAR)


def plan_groups_random(spark, sf):
    return _er_plan(spark, sf, ER_RANDOM)


def plan_groups_dominated(spark, sf):
    """X1 with the dominated filter (P8) inside the plan."""
    return _er_plan(spark, sf, ER_DOMINATED)


def plan_groups_corr(spark, sf):
    return _corr_plan(spark, sf, EPS_SIM, "similar")


def plan_groups_corr_diverse(spark, sf):
    """X2 where questions at least K0_CORR apart attract and nearer ones repel."""
    return _corr_plan(spark, sf, K0_CORR, "diverse")


def plan_groups_code(spark, sf):
    """X1 of the code task: questions in clusters of one or two are not asked, groups get extra demos."""
    q = fx.vec_costs(_vq(spark, sf), "ques_id")
    d = fx.vec_costs(_vd(spark, sf), "demo_id")
    return _groups_out(grouping.plan_groups(q, d, CODE_CFG, render_prompts=False).groups)


def _corr_plan(spark, sf, k0, kind):
    q = fx.vec_costs(_vq(spark, sf), "ques_id")
    d = fx.vec_costs(_vd(spark, sf), "demo_id")
    cfg = PlanConfig(k0=k0, k1=VEC_K1, k2=140, upper_ques=UPPER, batch_type="correlation", corr_kind=kind, metric="cosine",
                     task="qa", set_cover_num=2)
    return _groups_out(grouping.plan_groups(q, d, cfg, render_prompts=False).groups)


def ilp_inputs(spark, sf):
    return _ilp_inputs(spark, sf, PCT)


def ilp_inputs_q25(spark, sf):
    """X3's inputs with the quartile as threshold."""
    return _ilp_inputs(spark, sf, QUARTER)


def _ilp_inputs(spark, sf, p):
    _, n = simjoin.cover_percentile(_vq(spark, sf), _vd(spark, sf), p, "cosine", counted=True)
    qc, _ = _vcost(spark, sf)
    n = n.withColumnRenamed("n", "n_cover")
    return qc.join(n, "ques_id", "left").select("ques_id", F.coalesce("n_cover", F.lit(0)).cast("long").alias("n_cover"),
                                                F.col("cost").cast("int").alias("cost"))


# ---------------------------------------------------------------------------
# Reports over fixed TXT groups
# ---------------------------------------------------------------------------

def _txt_groups(spark, sf):
    return reports.residue_groups(fx.txt_questions(spark, sf), fx.txt_demos(spark, sf), TXT_GROUP, TXT_DEMO_MOD)


def plan_tokens(spark, sf):
    gq, gd = _txt_groups(spark, sf)
    return reports.plan_tokens(gq, gd, fx.txt_questions(spark, sf), fx.txt_demos(spark, sf), T_COST)


def plan_stats(spark, sf):
    gq, gd = _txt_groups(spark, sf)
    return reports.plan_stats(gq, gd).select("n_groups", _r(F.col("avg_ques")).alias("avg_ques"),
                                             _r(F.col("avg_demo")).alias("avg_demo"))


def plan_objective(spark, sf):
    gq, gd = _txt_groups(spark, sf)
    return reports.plan_objective(gq, gd, fx.txt_questions(spark, sf), fx.txt_demos(spark, sf), T_COST)


def plan_violations(spark, sf):
    gq, gd = reports.fixed_groups(fx.txt_questions(spark, sf), fx.txt_demos(spark, sf), TXT_GROUP, TXT_DEMOS)
    return reports.plan_violations(gq, gd, fx.txt_questions(spark, sf), fx.txt_demos(spark, sf), K2_REPORT, T_COST)


def _er_report(spark, sf):
    """Questions, demos, plan and its groups in long form, of the flagship plan."""
    q, d = _er_inputs(spark, sf)
    plan = grouping.plan_groups(q, d, ER_CFG, render_prompts=False)
    gq = plan.groups.select("group_id", F.explode("ques").alias("ques_id"))
    gd = plan.groups.select("group_id", F.explode("demo").alias("demo_id"))
    return q, d, plan, gq, gd


def plan_objective_er(spark, sf):
    """A18 over the flagship plan."""
    q, d, _, gq, gd = _er_report(spark, sf)
    return reports.plan_objective(gq, gd, q, d, task_text_cost("er"))


def plan_violations_er(spark, sf):
    """A19 over the flagship plan with its cover; neighbours by id whose answers differ are to be kept apart."""
    q, d, plan, gq, gd = _er_report(spark, sf)
    nxt = q.select((F.col("ques_id") - 1).alias("q1"), F.col("ques_id").alias("q2"), F.col("answer").alias("_a"))
    apart = q.select(F.col("ques_id").alias("q1"), "answer").join(nxt, "q1").where(F.col("answer") != F.col("_a")) \
        .select("q1", "q2")
    return reports.plan_violations(gq, gd, q, d, ER_CFG.k2, task_text_cost("er"), cover=plan.cover, forbidden=apart)


def plan_lower_bound(spark, sf):
    """The flagship plan's objective against a bound for any plan."""
    q, d, plan, gq, gd = _er_report(spark, sf)
    r = reports.plan_lower_bound(gq, gd, q, d, plan.cover, ER_CFG.k2, task_text_cost("er"), BOUND_ROUNDS)
    return r.select("ques_tokens", F.round("demo_bound", 4).alias("demo_bound"), "task_bound", F.round("lower_bound", 4).alias("lower_bound"),
                    "objective", F.round("gap", 6).alias("gap"))


def pair_dist_manhattan(spark, sf):
    """A distance of the caller's on the ER features, pruned by its Euclidean bound."""
    q, d = _er_inputs(spark, sf)
    p = simjoin.pair_distances(q, d, MANHATTAN_R, simjoin.MANHATTAN)
    return p.select("ques_id", "demo_id", _r(F.col("dist")).alias("dist"))


# ---------------------------------------------------------------------------
# Rendering
# ---------------------------------------------------------------------------

def render_prompt_er(spark, sf):
    p = fx.er_pairs(spark, sf).withColumn("group_id", F.floor(F.col("id") / ER_GROUP).cast("long"))
    qs = p.where(~F.col("is_demo")).groupBy("group_id").agg(F.sort_array(F.collect_list("id")).alias("ques"))
    ds = p.where(F.col("is_demo")).groupBy("group_id").agg(F.sort_array(F.collect_list("id")).alias("demo"))
    groups = qs.join(ds, "group_id")
    pr = grouping.render_prompts_for(groups, fx.er_questions(spark, sf), fx.er_demos(spark, sf), "er")
    return pr.select("group_id", "prompt", F.array_join("answers", ",").alias("answers"),
                     F.size("answers").cast("long").alias("n_ques"))


def _task_prompts(spark, sf, task, demos_each=None):
    """Prompts of all documents, in groups of TXT_GROUP; without ``demos_each`` with every demo of the group's residue."""
    q, d = fx.txt_questions(spark, sf), fx.txt_demos(spark, sf)
    gq, gd = reports.fixed_groups(q, d, TXT_GROUP, demos_each) if demos_each else _txt_groups(spark, sf)
    qs = gq.groupBy("group_id").agg(F.sort_array(F.collect_list("ques_id")).alias("ques"))
    ds = gd.groupBy("group_id").agg(F.sort_array(F.collect_list("demo_id")).alias("demo"))
    pr = grouping.render_prompts_for(qs.join(ds, "group_id"), q, d, task)
    return pr.select("group_id", "prompt", F.array_join("answers", ",").alias("answers"),
                     F.col("tokens").cast("int").alias("tokens"))


def render_prompt_text(spark, sf):
    """prompts of code questions."""
    return _task_prompts(spark, sf, "code")


def render_prompt_qa(spark, sf):
    """F8: prompts of true/false questions."""
    return _task_prompts(spark, sf, "qa", PROMPT_DEMOS)


def prompts_reread(spark, sf):
    """The prompts of transformations written as JSON lines and read again."""
    path = _json_folder(spark, "prompts")
    shown = _task_prompts(spark, sf, "jd", PROMPT_DEMOS)
    tables.write_prompts(shown.withColumn("answers", F.split("answers", ",")), path)
    return tables.read_prompts(spark, path).select("group_id", "prompt", F.array_join("answers", ",").alias("answers"))


def groups_reread(spark, sf):
    """The packed groups written as JSON, one folder per setting, and read again."""
    path = _json_folder(spark, "groups")
    b, a = _bins(spark, sf)
    long = packing.groups_long(b, a)
    groups = long.groupBy("cluster_id", "group_id").agg(
        F.array_sort(F.collect_set("ques_id")).alias("ques"), F.array_sort(F.collect_set("demo_id")).alias("demo"),
        F.count(F.lit(1)).alias("tokens"), F.lit(False).alias("over_budget"))
    tables.write_groups(tables.with_settings(groups, ER_CFG), path, partition_by=tables.SETTING_COLUMNS)
    back = tables.read_groups(spark, path)
    return back.select("group_id", F.size("ques").cast("long").alias("n_ques"), F.size("demo").cast("long").alias("n_demo"),
                       F.array_min("ques").alias("first_ques"), F.array_max("demo").alias("last_demo"), F.col("tokens").alias("n_rows"))


def render_prompt_jd(spark, sf):
    """prompts of transformations."""
    return _task_prompts(spark, sf, "jd", PROMPT_DEMOS)


# ---------------------------------------------------------------------------
# Evaluation (EVAL fixture)
# ---------------------------------------------------------------------------

def parse_yes_no_q(spark, sf):
    r = fx.eval_responses(spark, sf).withColumn("v", parse_yes_no(F.col("text")))
    return r.select("group_id", "attempt", F.size("v").cast("long").alias("n_verdicts"), _csv(F.col("v")).alias("verdicts"))


def parse_json_reply_q(spark, sf):
    r = fx.eval_json_responses(spark, sf).withColumn("m", parse_json_reply(F.col("text")))
    return r.select("group_id", "attempt", F.col("m").isNotNull().alias("valid"),
                    F.size("m").cast("long").alias("n_keys")).withColumn(
        "n_keys", F.when(F.col("valid"), F.col("n_keys")))


def first_valid_reply_q(spark, sf):
    f = evaluate.first_valid_reply(fx.eval_prompts(spark, sf), fx.eval_responses(spark, sf), "yes_no")
    return f.select("group_id", F.col("attempt").cast("int"))


def eval_er(spark, sf):
    m = evaluate.eval_er(fx.eval_prompts(spark, sf), fx.eval_responses(spark, sf))
    return m.select("tp", "fp", "tn", "fn", *[_r(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1")],
                    F.col("n_prompts").cast("long"), F.col("unanswered").cast("long"))


def eval_exact(spark, sf):
    m = evaluate.eval_exact(fx.eval_json_prompts(spark, sf), fx.eval_json_responses(spark, sf), task="code")
    return m.select("correct", "total", _r(F.col("accuracy")).alias("accuracy"), F.col("unanswered").cast("long"))


def eval_exact_qa(spark, sf):
    """A11/F13 with boolean gold: True / false read as yes / no."""
    pr = fx.eval_json_prompts(spark, sf).withColumn("answers", F.transform(
        "answers", lambda a: F.when(a == "yes", F.lit("True")).otherwise(F.lit("false"))))
    m = evaluate.eval_exact(pr, fx.eval_json_responses(spark, sf), task="qa")
    return m.select("correct", "total", _r(F.col("accuracy")).alias("accuracy"), F.col("unanswered").cast("long"))


def eval_rollup(spark, sf):
    pr = fx.eval_json_prompts(spark, sf)
    rep = evaluate.first_valid_reply(pr, fx.eval_json_responses(spark, sf), "json")
    r = evaluate.eval_rollup(evaluate.exact_matches(pr, rep, "code"))
    return r.select("table_name", "correct", "total", _r(F.col("accuracy")).alias("accuracy"))


def eval_running(spark, sf):
    pr = fx.eval_prompts(spark, sf)
    c = evaluate.er_counts(pr, evaluate.first_valid_reply(pr, fx.eval_responses(spark, sf), "yes_no"))
    r = evaluate.eval_running(c, "er")
    return r.select("group_id", "cum_right", "cum_seen", _r(F.col("running_accuracy")).alias("running_accuracy"))


def eval_running_tables(spark, sf):
    """W3 per table: running exact-match accuracy inside each table, in group order."""
    pr = fx.eval_json_prompts(spark, sf)
    m = evaluate.exact_matches(pr, evaluate.first_valid_reply(pr, fx.eval_json_responses(spark, sf), "json"), "code")
    r = evaluate.eval_running(m, kind="exact", by=["table_name"])
    return r.select("table_name", "group_id", "cum_right", "cum_seen",
                    _r(F.col("running_accuracy")).alias("running_accuracy"))


_QUERIES: dict[str, Query] = {
    "scan_pairs": scan_pairs, "render_entity": render_entity, "token_cost": token_cost,
    "field_similarity": field_similarity, "pair_features": pair_features,
    "pair_features_distinct": pair_features_distinct, "jsonl_pairs": jsonl_pairs, "jsonl_texts": jsonl_texts,
    "parquet_texts": parquet_texts, "groups_reread": groups_reread, "prompts_reread": prompts_reread,
    "pair_dist_euclid": pair_dist_euclid, "pair_dist_cosine": pair_dist_cosine, "pair_dist_recip": pair_dist_recip,
    "self_dist": self_dist, "knn_cover": knn_cover, "knn_topk3": knn_topk3, "cover_threshold": cover_threshold,
    "topup_cover": topup_cover, "filter_candidates": filter_candidates, "filter_demos_topk": filter_demos_topk,
    "filter_demos_within": filter_demos_within, "group_coverage": group_coverage, "pivot_join": pivot_join,
    "pivot_prune_stats": pivot_prune_stats, "eps_edges": eps_edges, "dist_percentile": dist_percentile,
    "cover_percentile": cover_percentile, "demo_coverage": demo_coverage, "cover_cost": cover_cost,
    "cover_overlap": cover_overlap, "cluster_demos": cluster_demos, "uncovered_questions": uncovered_questions,
    "dominated_demos": dominated_demos, "components": components, "cluster_similar": cluster_similar,
    "cluster_diverse": cluster_diverse, "cluster_stats": cluster_stats, "cluster_size_filter": cluster_size_filter,
    "clusters_by_size": clusters_by_size, "cluster_random": cluster_random, "affinity_edges": affinity_edges, "edge_transform": edge_transform,
    "label_nodes": label_nodes, "split_clusters": split_clusters, "corr_loss_linear": corr_loss_linear,
    "corr_loss_binary": corr_loss_binary, "corr_loss_poles": corr_loss_poles, "corr_best": corr_best,
    "corr_cluster": corr_cluster, "set_cover": set_cover, "group_extra_demos": group_extra_demos,
    "assign_last": assign_last, "assign_random": assign_random, "assign_cost": assign_cost,
    "assign_balanced": assign_balanced, "pack_groups": pack_groups, "groups_long": groups_long,
    "plan_groups": plan_groups, "plan_groups_corr": plan_groups_corr, "ilp_inputs": ilp_inputs,
    "plan_tokens": plan_tokens, "plan_stats": plan_stats, "plan_objective": plan_objective,
    "plan_violations": plan_violations, "plan_objective_er": plan_objective_er, "plan_violations_er": plan_violations_er,
    "plan_groups_dominated": plan_groups_dominated, "render_prompt_er": render_prompt_er,
    "render_prompt_text": render_prompt_text, "parse_yes_no": parse_yes_no_q,
    "parse_json_reply": parse_json_reply_q, "first_valid_reply": first_valid_reply_q, "eval_er": eval_er,
    "eval_exact": eval_exact, "eval_rollup": eval_rollup, "eval_running": eval_running,
    "eval_running_tables": eval_running_tables, "components_non_value": components_non_value,
    "clusters_without_noise": clusters_without_noise, "plan_groups_similar": plan_groups_similar,
    "plan_groups_random": plan_groups_random, "render_prompt_qa": render_prompt_qa,
    "render_prompt_jd": render_prompt_jd, "eval_exact_qa": eval_exact_qa,
    "pair_dist_tree": pair_dist_tree, "pair_dist_cosine_lsh": pair_dist_cosine_lsh, "lsh_recall": lsh_recall,
    "corr_cluster_refined": corr_cluster_refined, "plan_lower_bound": plan_lower_bound, "pair_dist_manhattan": pair_dist_manhattan,
    "plan_groups_code": plan_groups_code, "cluster_diverse_dense": cluster_diverse_dense, "plan_groups_corr_diverse": plan_groups_corr_diverse, "dist_percentile_q25": dist_percentile_q25, "ilp_inputs_q25": ilp_inputs_q25,
}


def _wrap(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Query]:
    return {k: _wrap(v) for k, v in _QUERIES.items()}


# the flagship: full ER grouping plan rendered as prompts
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    from quire.operators.features import pair_features as feats
    q = feats(fx.er_questions(spark, sf_dir))
    d = feats(fx.er_demos(spark, sf_dir))
    plan = grouping.plan_groups(q, d, ER_CFG)
    return plan.prompts.select("group_id", "prompt", F.array_join("answers", ",").alias("answers"),
                               F.col("tokens").cast("long").alias("tokens"))

