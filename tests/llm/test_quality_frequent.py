"""The n-grams of the highest counts are weighed where the texts are, and the shuffles of checkpointed rows are deleted."""

import os
import time

import numpy as np
from pyspark.sql import functions as F

from quire.llm import quality_kn
from quire.session import cut_lineage


def _docs(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 60) % 400) for _ in range(80)] + ["", None, "none of these"]
    return spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string").select(
        F.xxhash64("doc_id").alias("key"), "doc_id", "lang", "text")


def test_frequent_ngrams_are_weighed_alike(spark, monkeypatch):
    docs = _docs(spark)
    model, _ = quality_kn.train(docs)
    h, x = quality_kn._model_arrays(model.toArrow())
    table = spark.sparkContext.broadcast(quality_kn._bits(model))
    plain = {r["key"]: (r["n_tokens"], r["weight"]) for r in quality_kn.log_probabilities(docs, model, table, 2).collect()}
    for most in (0, 300, 1 << 20):
        monkeypatch.setattr(quality_kn, "FREQUENT", most)
        known, weights = quality_kn._frequent(model)
        assert len(known) <= most and (known[1:] > known[:-1]).all()
        assert len(known) == len(h) if most > len(h) else (len(known) > 0) == (most > 0)
        order = np.argsort(h)
        assert np.array_equal(x[order][np.searchsorted(h[order], known)], weights)
        got = {r["key"]: (r["n_tokens"], r["weight"]) for r in quality_kn.log_probabilities(
            docs, model, table, 2, frequent=spark.sparkContext.broadcast((known, weights))).collect()}
        assert got.keys() == plain.keys()
        assert all(got[k][0] == plain[k][0] and abs(got[k][1] - plain[k][1]) < 1e-9 for k in got)


def test_checkpoint_deletes_its_shuffles(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files() -> set:
        return {f for d in dirs for top, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}

    before = files()
    kept = cut_lineage(spark.range(1000).repartition(5).groupBy((F.col("id") % 10).alias("k")).count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and kept.count() == 10
