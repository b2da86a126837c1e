"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
Defined cases: every stage treats nulls, empty texts, repeated rows, empty tables and further columns as its
operator states (quire/llm); of rows that repeat, near copies keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import blocks as bl
from quire.llm import decontam, ngram_join, packing, pii, quality_kn
from quire.llm.queries import tokenizer_path
from quire.session import cut_lineage, prepare


def _without(docs: DataFrame, keys: DataFrame, *by: str) -> DataFrame:
    """The rows whose key (hash of the columns ``by``) is not among ``keys``."""
    keys = keys.select(F.col("key").alias("_key")).distinct()
    return docs.withColumn("_key", F.xxhash64(*by)).join(keys, "_key", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity is beyond their language's threshold."""
    prepare(spark)
    judged = quality_kn.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, judged.filter(~F.col("keep")), "doc_id", "text", "lang")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of every group of near copies (five words, 80 %; rows without an id last)."""
    prepare(spark)
    groups = bl.group_count(spark, bl.extent(docs, "text")[1])
    found = cut_lineage(ngram_join.near_copies(docs, groups, shingle=5, percent=80))
    first = found.groupBy("cluster").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("key"))
    others = found.select("key").distinct().join(first, "key", "left_anti")
    kept = docs.withColumn("_key", F.xxhash64("doc_id", "text")).join(others.withColumnRenamed("key", "_key"), "_key", "left_anti")
    return kept.dropDuplicates(["_key"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a window of a benchmark item."""
    prepare(spark)
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.filter("n_hit > 0"), "doc_id", "text")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind, and counts the characters anew."""
    prepare(spark)
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids."""
    prepare(spark)
    pieces = packing.pack_documents(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: the models, the tokenizer and the online packing are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
