"""The quality model learns from all trusted documents but those that set the thresholds, over any number of shards."""

from quire.llm import quality_kn


def _rows(spark, n):
    return spark.createDataFrame([(i, f"w{i % 7} x{i % 11} common words of all texts", "en") for i in range(n)], "doc_id long, text string, lang string")


def test_no_bound_on_training_documents(spark, monkeypatch):
    seen = []

    def stop(docs):
        seen.append(docs.count())
        raise InterruptedError

    monkeypatch.setattr(quality_kn, "train", stop)
    labels = spark.range(6000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    try:
        quality_kn.judge(_rows(spark, 6000), labels)
    except InterruptedError:
        pass
    assert 4600 < seen[0] < 5000                     # four fifths; before: 3,000 a language


def test_more_shards_same_scores(spark, monkeypatch):
    assert [quality_kn.shards_log(n * quality_kn.MODEL_BYTES) for n in (0, 1, 8, 9, 16, 17)] == [3, 3, 3, 4, 4, 5]
    docs, labels = _rows(spark, 150), spark.range(100).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    score = lambda: {r["doc_id"]: (r["n_tokens"], round(r["log10_prob"], 9), r["keep"]) for r in quality_kn.judge(docs, labels).collect()}
    want = score()
    monkeypatch.setattr(quality_kn, "MODEL_BYTES", 200)
    assert score() == want and len(want) == 150


def test_training_rows_found_without_moving_other_texts(spark):
    docs = _rows(spark, 3000).selectExpr("xxhash64(doc_id) as key", "*", "octet_length(text) as bytes")
    keys = docs.filter("doc_id % 10 = 3").select("key")
    got = quality_kn.only_keys(docs, keys)
    assert {r["doc_id"] for r in got.collect()} == set(range(3, 3000, 10))
    got.count()
    # the texts pass the bit table before the exchange of the join
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftSemi") < plan.index("may(")
    assert quality_kn.only_keys(docs, keys.limit(0)).count() == 0
