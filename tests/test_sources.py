"""JSON-lines records keep attribute order; groups and prompts round-trip."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from quire.functions import entity_text
from quire import PlanConfig
from quire.sources.tables import (SETTING_COLUMNS, read_groups, read_prompts, read_records, task_of, with_settings,
                                  write_groups, write_prompts)


def _write_lines(rows):
    d = tempfile.mkdtemp(prefix="quire-src-")
    path = os.path.join(d, "pairs.jsonl")
    with open(path, "w", encoding="utf-8") as f:
        for r in rows:
            f.write(json.dumps(r, ensure_ascii=False) + "\n")
    return d, path


def test_er_records_keep_order_and_cost(spark):
    rows = [
        {"question": {"entity1": {"Zeta": "Pale Ale", "Alpha": "Brew Co"},
                      "entity2": {"Zeta": "Pale Ale #2", "Alpha": "Brew Company"}}, "answer": "1"},
        {"question": {"entity1": {"Zeta": "Stout", "Alpha": "Dark Hills"},
                      "entity2": {"Zeta": "Stout Noir", "Alpha": "Dark Hills"}}, "answer": "0"},
    ]
    _, path = _write_lines(rows)
    df = read_records(spark, path, "er", dataset="Beer").orderBy("ques_id")
    got = df.select("ques_id", entity_text(F.col("e1")).alias("t"), "answer", "cost", "task").collect()
    assert [r["ques_id"] for r in got] == [0, 1]
    assert got[0]["t"] == '"Zeta": "Pale Ale", "Alpha": "Brew Co"'
    assert got[0]["cost"] == (2 + 2) + (4 + 2)  # Pale, Ale / Brew, Co ; Pale, Ale, #, 2 / Brew, Company
    assert got[1]["answer"] == "0" and got[0]["task"] == "er"


def test_text_records_and_dataset_task(spark):
    _, path = _write_lines([{"question": "Is ice cold?", "answer": True}, {"question": "Is fire wet?", "answer": False}])
    df = read_records(spark, path, "qa").orderBy("ques_id").collect()
    assert [r["answer"] for r in df] == ["true", "false"]
    assert task_of("Beer") == "er" and task_of("StrategyQA") == "qa"


def test_groups_and_prompts_round_trip(spark):
    d = tempfile.mkdtemp(prefix="quire-out-")
    g = spark.createDataFrame([(0, "0-0-0", [1, 2], [5], 40, False)],
                              "cluster_id long, group_id string, ques array<long>, demo array<long>, tokens long, "
                              "over_budget boolean")
    write_groups(g, f"{d}/groups")
    back = read_groups(spark, f"{d}/groups").first()
    assert back["ques"] == [1, 2] and back["demo"] == [5] and back["group_id"] == "0-0-0"
    p = spark.createDataFrame([("0-0-0", "prompt text", ["1", "0"])], "group_id string, prompt string, answers array<string>")
    write_prompts(p, f"{d}/prompts")
    assert read_prompts(spark, f"{d}/prompts").first()["answers"] == ["1", "0"]


def test_groups_written_per_setting(spark):
    d = tempfile.mkdtemp(prefix="quire-out-")
    g = spark.createDataFrame([(0, "0-0-0", [1, 2], [5], 40, False)],
                              "cluster_id long, group_id string, ques array<long>, demo array<long>, tokens long, "
                              "over_budget boolean")
    write_groups(with_settings(g, PlanConfig(k0=1.9, k1=0.13)), f"{d}/groups", partition_by=SETTING_COLUMNS)
    assert any("k0=1.9" in root for root, _dirs, _files in os.walk(f"{d}/groups"))
    assert read_groups(spark, f"{d}/groups").first()["group_id"] == "0-0-0"


def test_parquet_records_same_as_jsonl(spark):
    from quire.sources.tables import read_records_parquet
    rows = [{"question": {"entity1": {"Zeta": "Pale Ale", "Alpha": "Brew Co"},
                          "entity2": {"Zeta": "Pale", "Alpha": "Brew"}}, "answer": "1"}]
    d, path = _write_lines(rows)
    j = read_records(spark, path, "er")
    j.select(F.col("ques_id").alias("rid"), F.struct(F.col("e1").alias("entity1"), F.col("e2").alias("entity2"))
             .alias("question"), "answer").write.mode("overwrite").parquet(f"{d}/pq")
    p = read_records_parquet(spark, f"{d}/pq", "er", key="rid")
    a = j.select("ques_id", entity_text(F.col("e1")).alias("t"), "cost").collect()
    b = p.select("ques_id", entity_text(F.col("e1")).alias("t"), "cost").collect()
    assert a == b


def test_dataset_dimension_and_loss_registry(spark):
    from quire.operators.graph import loss_by_name, loss_linear
    from quire.sources.tables import dataset_tasks
    dims = {r["dataset"]: r["task"] for r in dataset_tasks(spark).collect()}
    assert dims["Beer"] == "er" and dims["DXF"] == "jd" and len(dims) == 18
    assert loss_by_name("linear_loss") is loss_linear


def test_code_and_jd_record_layouts(spark):
    _, path = _write_lines([{"total": "void f() { g(); }", "answer": "assertTrue(x);"}])
    code = read_records(spark, path, "code").first()
    assert code["text"] == "void f() { g(); }" and code["answer"] == "assertTrue(x);" and code["cost"] == 10
    _, path = _write_lines([{"table_name": "t1", "question": "a,b", "answer": "b,a"}])
    jd = read_records(spark, path, "jd").first()
    assert (jd["table_name"], jd["text"], jd["answer"], jd["task"]) == ("t1", "a,b", "b,a", "jd")
