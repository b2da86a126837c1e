"""Inputs built from the driver's tables (every row of the source table is used).

* ER   -- entity pairs from ``part``: pair (a, b) with ``b.p_partkey = a.p_partkey + 1``;
          entity = (name, brand, type) in that order; demonstration if ``a.p_partkey % 5 = 0``;
          answer '1' when both have the same ``p_type``.
* VEC  -- ``embeddings``; demonstration if ``vec_id % 5 = 0``; cosine metric.
* TXT  -- ``documents`` as questions, ``benchmark`` as demonstrations.
* EVAL -- ``labels``: quality = gold, toxic = a stand-in model verdict; groups of 8 doc ids;
          two reply attempts per group, the first one short of a line when the group has a
          toxic document.
* GRAPH-- self pairs of all embeddings with cosine distance <= 0.8, weight = 0.75 - distance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.tables import read_table, with_cost

ER_KEYS = ("name", "brand", "type")
VEC_K1 = 0.8
GRAPH_RADIUS = 0.8
GRAPH_SHIFT = 0.75
EVAL_GROUP = 8


def _entity(prefix: str) -> F.Column:
    return F.create_map(F.lit("name"), F.col(f"{prefix}.p_name"), F.lit("brand"), F.col(f"{prefix}.p_brand"),
                        F.lit("type"), F.col(f"{prefix}.p_type"))


def er_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    a, b = part.alias("a"), part.alias("b")
    pairs = a.join(b, F.col("b.p_partkey") == F.col("a.p_partkey") + 1).select(
        F.col("a.p_partkey").alias("id"), _entity("a").alias("e1"), _entity("b").alias("e2"),
        F.when(F.col("a.p_type") == F.col("b.p_type"), F.lit("1")).otherwise(F.lit("0")).alias("answer"),
        (F.col("a.p_partkey") % 5 == 0).alias("is_demo"))
    return with_cost(pairs.withColumn("text", F.lit(None).cast("string")), "er")


def er_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return er_pairs(spark, sf_dir).where(~F.col("is_demo")).drop("is_demo").withColumnRenamed("id", "ques_id")


def er_demos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return er_pairs(spark, sf_dir).where(F.col("is_demo")).drop("is_demo").withColumnRenamed("id", "demo_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def vec_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("id") % 5 != 0).select(
        F.col("id").alias("ques_id"), "vec", "label")


def vec_demos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("id") % 5 == 0).select(
        F.col("id").alias("demo_id"), "vec", "label")


def vec_costs(df: DataFrame, id_col: str) -> DataFrame:
    """Token cost stand-in for VEC records: 10 + label (a deterministic function of the row)."""
    return df.withColumn("cost", (F.lit(10) + F.col("label")).cast("int"))


def txt_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = docs.select(F.col("doc_id").alias("ques_id"), "text",
                      F.when(F.col("n_chars") > 1000, F.lit("true")).otherwise(F.lit("false")).alias("answer"),
                      F.col("source").alias("table_name"))
    return with_cost(out, "code")


def txt_demos(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = read_table(spark, sf_dir, "benchmark")
    out = bench.select(F.col("item_id").alias("demo_id"), "text",
                       F.when(F.length("text") > 180, F.lit("true")).otherwise(F.lit("false")).alias("answer"))
    return with_cost(out, "code")


def eval_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, pos, doc_id, gold, pred): pos = rank of doc_id inside its group."""
    lab = read_table(spark, sf_dir, "labels")
    gid = F.floor(F.col("doc_id") / EVAL_GROUP).cast("long")
    from pyspark.sql import Window as W
    w = W.partitionBy("group_id").orderBy("doc_id")
    return (lab.select(gid.alias("group_id"), "doc_id", F.col("quality").alias("gold"),
                       F.col("toxic").alias("pred"))
            .withColumn("pos", (F.row_number().over(w) - 1).cast("int")))


def eval_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as a model would send them: one line per question.

    attempt 1 drops the last line when the group holds a toxic document (so it is
    not usable); attempt 2 is complete.  Groups stay bounded (8 doc ids)."""
    g = eval_gold(spark, sf_dir)
    line = F.concat(F.lit("Question "), (F.col("pos") + 1).cast("string"), F.lit(", "),
                    F.when(F.col("pred") == 1, F.lit("Yes, Product A and Product B are the same product."))
                    .otherwise(F.lit("No, Product A and Product B are different products.")))
    per = g.groupBy("group_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"),
        F.max("pred").alias("any_toxic"))
    full = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    short = F.array_join(F.transform(F.slice("lines", 1, F.greatest(F.size("lines") - 1, F.lit(0))),
                                     lambda x: x["line"]), "\n")
    first = per.select("group_id", F.lit(1).alias("attempt"),
                       F.when(F.col("any_toxic") == 1, short).otherwise(full).alias("text"))
    second = per.select("group_id", F.lit(2).alias("attempt"), full.alias("text"))
    return first.unionByName(second)


def eval_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, answers array<string>) -- gold answers in question order."""
    g = eval_gold(spark, sf_dir)
    return g.groupBy("group_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col("gold").cast("string").alias("a")))),
                    lambda x: x["a"]).alias("answers"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight) with src < dst, via the exact pivot range join."""
    from quire.operators.simjoin import range_join
    v = vectors(spark, sf_dir)
    pairs = range_join(v.select(F.col("id").alias("src"), "vec"), v.select(F.col("id").alias("dst"), "vec"),
                       "src", "dst", GRAPH_RADIUS, metric="cosine", self_join=True)
    return pairs.select("src", "dst", (F.lit(GRAPH_SHIFT) - F.col("dist")).alias("weight"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", "label")




EVAL_JSON_SPAN = 64


def eval_json_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-reply fixture: prompts = (source, doc_id div 64) of labelled documents;
    gold = yes/no from quality; the stand-in reply says no for toxic documents."""
    from pyspark.sql import Window as W
    lab = read_table(spark, sf_dir, "labels")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    g = lab.join(docs, "doc_id").select(
        F.concat_ws("-", F.col("source"), F.floor(F.col("doc_id") / EVAL_JSON_SPAN).cast("string")).alias("group_id"),
        F.col("source").alias("table_name"), "doc_id",
        F.when(F.col("quality") == 1, F.lit("yes")).otherwise(F.lit("no")).alias("gold"), "toxic")
    w = W.partitionBy("group_id").orderBy("doc_id")   # groups hold at most 64 documents
    return g.withColumn("pos", (F.row_number().over(w) - 1).cast("int"))


def eval_json_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = eval_json_gold(spark, sf_dir)
    return g.groupBy("group_id", "table_name").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "gold"))), lambda x: x["gold"]).alias("answers"))


def eval_json_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempt 1 is cut short (invalid JSON) when the group holds a toxic document;
    attempt 2 is a full object.  Some values carry spaces and trailing ';;', and the
    key of every document with ``doc_id % 7 = 0`` is left out."""
    g = eval_json_gold(spark, sf_dir)
    val = F.when(F.col("toxic") == 1, F.lit("no")).otherwise(F.lit("yes"))
    val = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), val, F.lit(";;"))).otherwise(val)
    item = F.concat(F.lit('"Question'), (F.col("pos") + 1).cast("string"), F.lit('": "'), val, F.lit('"'))
    kept = g.where(F.col("doc_id") % 7 != 0)
    body = kept.groupBy("group_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", item.alias("it")))),
                                 lambda x: x["it"]), ", ").alias("body"))
    flags = g.groupBy("group_id").agg(F.max("toxic").alias("any_toxic"))
    full = flags.join(body, "group_id", "left").select(
        "group_id", "any_toxic", F.concat(F.lit("{"), F.coalesce("body", F.lit("")), F.lit("}")).alias("full"))
    first = full.select("group_id", F.lit(1).alias("attempt"),
                        F.when(F.col("any_toxic") == 1, F.expr("substring(full, 1, length(full) - 1)"))
                        .otherwise(F.col("full")).alias("text"))
    second = full.select("group_id", F.lit(2).alias("attempt"), F.col("full").alias("text"))
    return first.unionByName(second)
