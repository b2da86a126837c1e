"""The quality model's training bound, and scores that do not depend on how the work is dealt."""

import random

import pytest

from quire.llm import quality_kn


def _docs(spark, n, seed=3):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)]
    return spark.createDataFrame([(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(40))), "en") for i in range(n)],
                                 "doc_id long, text string, lang string")


def test_training_bound(spark, monkeypatch):
    seen, train = [], quality_kn.train
    monkeypatch.setattr(quality_kn, "train", lambda docs: seen.append(docs.count()) or train(docs))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1500)], "doc_id long, quality int, toxic int")
    assert quality_kn.judge(_docs(spark, 1500), labels).count() == 1500
    assert 1100 < seen[0] < 1300                                            # four fifths of the trusted


def test_scores_over_several_copies_of_the_model(spark):
    docs = _docs(spark, 200)
    docs = docs.unionByName(docs.limit(20)).selectExpr("xxhash64(doc_id, text, lang) as key", "doc_id", "text", "lang").repartition(6).localCheckpoint()
    model, _ = quality_kn.train(docs)
    h, x = quality_kn._model_arrays(model.toArrow())
    weight = dict(zip(h.astype("int64").tolist(), x.tolist()))
    table = spark.sparkContext.broadcast(quality_kn._bits(model))
    batch = quality_kn._texts(docs).toArrow().combine_chunks().to_batches()[0]
    buf, off = quality_kn.bl.text_bytes(batch.column("text"))
    word, doc, pair, second = quality_kn._grams(batch, 0, batch.num_rows, buf, off, quality_kn._langs(batch))
    want = {}
    for i, k in enumerate(batch.column("key").to_pylist()):
        grams = [*word[doc == i].astype("int64").tolist(), *pair[doc[second] == i].astype("int64").tolist()]
        want[k] = (len(batch.column("text")[i].as_py().split()) + 1, pytest.approx(sum(weight.get(h, 0.0) for h in grams)))
    for copies in (1, 4):
        got = {r["key"]: (r["n_tokens"], r["weight"]) for r in quality_kn.log_probabilities(docs, model, table, copies).collect()}
        assert got == want
