"""Text plans give every group all demos of its residue, however many there are."""


def test_every_demo_of_the_residue_joins(spark):
    from quire import catalog
    from quire.plans.reports import residue_groups

    q = spark.range(95).selectExpr("id AS ques_id")
    d = spark.range(50).selectExpr("id * 3 AS demo_id")
    gq, gd = residue_groups(q, d, 10, 4)
    sets = {}
    for r in gd.collect():
        sets.setdefault(r["group_id"], set()).add(r["demo_id"])
    assert gq.count() == 95 and sets == {g: {3 * i for i in range(50) if 3 * i % 4 == g % 4} for g in range(10)}


def test_reports_count_every_demo(spark, tmp_path):
    from quire import catalog

    spark.createDataFrame([(i, "a b c", "en", "s", 5) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, "one two") for i in range(160)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert catalog.plan_stats(spark, str(tmp_path)).first().asDict() == {"n_groups": 3, "avg_ques": 10.0, "avg_demo": 20.0}
    assert catalog.plan_objective(spark, str(tmp_path)).first()["demo_tokens"] == 3 * 20 * 2
    shown = catalog.render_prompt_text(spark, str(tmp_path)).collect()
    assert [r["prompt"].count("one two") for r in shown] == [20] * 3
