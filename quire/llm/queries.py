"""Registered queries of the training-data operators, over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import blocks as bl
from quire.llm import oracle
from quire.llm import decontam, fingerprints, html_text, langid, lm_deleted, merkle, ngram_join, packing, periodic, pii, quality_kn, quality_rules, suffix_dedup
from quire.session import prepare


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    """The public tokenizer file of this machine; never copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op2_quality_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_kn.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).drop("key")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return ngram_join.near_copies(docs, bl.group_count(spark, bl.extent(docs, "text")[1])).drop("key", "cluster")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    groups = bl.group_count(spark, bl.extent(docs, "text")[1])
    return lm_deleted.score(docs, groups, groups).drop("key")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    cut = suffix_dedup.remove_repeats(docs, bl.group_count(spark, bl.extent(docs, "text")[1], 3 << 20))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    n_bytes = bl.extent(docs, "text")[1]
    return fingerprints.fingerprint_with_next(docs, bl.group_count(spark, n_bytes, 12 << 20))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.annotate(_read(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    count = {f"n_{k}": (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long") for k in pii.KINDS}
    return found.withColumns(count).select("doc_id", *count, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
                                           pii.joined(F.col("spans")).alias("spans"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", ascii_uppercase, ascii_lowercase))
    rows = merkle.manifest(merkle.leaves(docs, changed={"text": tampered.otherwise(F.col("text"))}))
    folded = merkle.folded(F.col("other"), F.col("path"))
    return (rows.select(F.col("key").alias("doc_id"), *(merkle.text_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")),
                        F.sha2(merkle.proof_text(F.col("path")), 256).alias("proof_sha256"), merkle.text_of(folded).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def _words(text: str) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    # one document in ten repeats: its words from a on have period p
    words, n, g = F.col("w"), F.size("w").cast("long"), F.expr("h div 10")
    a, p = F.pmod(g, n), F.expr("1 + (size(w) - a) div (3 + (h div 10) % 8)")
    repeated = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))))
    plain = docs.filter("coalesce(h % 10 <> 0, true)").select("doc_id", "text")
    tenth = (docs.filter("h % 10 = 0").select("doc_id", "h", _words("text").alias("w")).withColumn("a", F.when(n > 0, a)).withColumn("p", p)
             .select("doc_id", F.when(F.size(words) > 0, F.concat_ws(" ", repeated)).alias("text")))
    found = periodic.find_runs(plain.unionByName(tenth))
    runs = F.col("runs")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    listed = F.concat_ws("", F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    return (found.withColumn("top", longest)
            .select("doc_id", F.size(runs).cast("long").alias("n_runs"), (-F.col("top.s")).alias("start"), F.col("top.length"), (-F.col("top.q")).alias("period"),
                    F.expr("1000 * top.length div -top.q").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"),
                    F.sha2("collapsed", 256).alias("collapsed_sha256")))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_html_text": op1_html_text, "op2_quality_kn": op2_quality_kn, "op3_decontamination": op3_decontamination, "op4_ngram_join": op4_ngram_join, "op5_lm_scoring": op5_lm_scoring, "op6_language_id": op6_language_id, "op7_suffix_dedup": op7_suffix_dedup, "op8_packing": op8_packing, "op9_fingerprints": op9_fingerprints, "op10_pii": op10_pii,
            "op11_merkle": op11_merkle, "op12_periodic_runs": op12_periodic_runs,
            "op13_quality_rules": op13_quality_rules}


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle": oracle.OP11, "op13_quality_rules": oracle.OP13}
