"""Prompt rendering (F6-F9) against a plain-Python rendering of the same format."""

from pyspark.sql import functions as F

from quire.functions.prompts import (CODE_TASK_TEXT, ER_TASK_TEXT, JD_TASK_TEXT, QA_TASK_TEXT, render,
                                     task_text_cost)


def _ent(d):
    return ", ".join(f'"{k}": "{v}"' for k, v in d.items())


def _py_er(demos, ques, item="Product"):
    low = item.lower()
    lines = []
    for i, (e1, e2, a) in enumerate(demos):
        lines.append(f"Demonstration {i + 1}:\n{item} A is {_ent(e1)}\n{item} B is {_ent(e2)}")
        lines.append(f"Yes, {item} A and {item} B are the same {low}." if a == "1"
                     else f"No, {item} A and {item} B are different {low}s.")
    q = [f"Question {i + 1}:\n {item} A is {_ent(e1)}\n {item} B is {_ent(e2)}" for i, (e1, e2) in enumerate(ques)]
    sent = "question above" if len(ques) == 1 else f"above {len(ques)} questions"
    q.append(f"\nUse domain knowledge of {item}s to help understand the text and answer the {sent} in the format: "
             f"For Question i, Yes, {item} A and {item} B are the same {low}./No, {item} A and {item} B are different "
             f"{low}s. For Question i+1, (repeat the above procedures)")
    return "\n\n".join([ER_TASK_TEXT, "\n".join(lines), "\n".join(q)])


def _py_text(task, demos, ques):
    if task == "qa":
        out = QA_TASK_TEXT + "".join(f"Question:{t}\nAnswer:{'yes' if a == 'true' else 'no'}\n" for t, a in demos)
        out += "\n For the following questions, please give the answer and the corresponding reasons:\n"
        return out + "".join(f"Question{j + 1}:\n{t}\n" for j, t in enumerate(ques))
    if task == "jd":
        out = JD_TASK_TEXT + "".join(f"Question:\n{t}\nAfter transformation:\n{a}\n\n" for t, a in demos)
        return out + "Please answer the following questions:\n" + "".join(
            f"Question{j + 1}:\n{t}\n" for j, t in enumerate(ques))
    out = CODE_TASK_TEXT + "".join(f"testMethod and totalMethod:\n{t}\nassertLine:\n{a}\n\n" for t, a in demos)
    return out + "Questions:\n" + "".join(f"Question{j + 1}:\ntestMethod and totalMethod:\n{t}\n"
                                          for j, t in enumerate(ques))


def test_render_er_one_and_many(spark):
    e = [({"Song_Name": "A b", "Artist": "X"}, {"Song_Name": "A  b", "Artist": "Y"})]
    demos = [(e[0][0], e[0][1], "1"), (e[0][1], e[0][0], "0")]
    def m(d):  # SQL map literal keeps the key order (a Python dict passed through createDataFrame may not)
        return "map(" + ", ".join(f"'{k}', '{v}'" for k, v in d.items()) + ")"

    for ques in (e, e * 3):
        dsql = "array(" + ", ".join(f"named_struct('e1', {m(a)}, 'e2', {m(b)}, 'answer', '{c}')"
                                    for a, b, c in demos) + ")"
        qsql = "array(" + ", ".join(f"named_struct('e1', {m(a)}, 'e2', {m(b)})" for a, b in ques) + ")"
        df = spark.sql(f"SELECT {dsql} AS demos, {qsql} AS ques")
        got = df.select(render("er", F.col("demos"), F.col("ques"))).first()[0]
        assert got == _py_er(demos, ques)


def test_render_text_tasks(spark):
    demos = [("int f() {}", "true"), ("void g()", "false")]
    ques = ["q one", "q two"]
    df = spark.createDataFrame([([{"text": t, "answer": a} for t, a in demos], [{"text": t} for t in ques])],
                               "demos array<struct<text:string,answer:string>>, ques array<struct<text:string>>")
    for task in ("code", "qa", "jd"):
        assert df.select(render(task, F.col("demos"), F.col("ques"))).first()[0] == _py_text(task, demos, ques)


def test_task_text_cost_positive():
    assert all(task_text_cost(t) > 10 for t in ("er", "code", "qa", "jd"))


def test_item_word_by_dataset():
    from quire.functions.prompts import item_word
    assert [item_word(d) for d in ("Beer", "DblpAcm", "unlisted", None)] == ["Beer", "Paper", "Product", "Product"]


def test_code_budget_text_differs_in_one_word():
    from quire.functions.prompts import CODE_TASK_TEXT, budget_text, task_text_cost
    assert budget_text("code").split("focal") == CODE_TASK_TEXT.split("total")
    assert task_text_cost("code") > 0


def test_every_document_is_in_exactly_one_prompt(spark):
    from quire import catalog
    from quire.sources import fixtures as fx
    sf = "/root/testdata/sf0.01"
    n = fx.txt_questions(spark, sf).count()
    for name in ("render_prompt_qa", "render_prompt_jd", "render_prompt_text"):
        rows = catalog.queries()[name](spark, sf).collect()
        assert sum(len(r["answers"].split(",")) for r in rows) == n
        assert len({r["group_id"] for r in rows}) == len(rows) == n // catalog.TXT_GROUP


def test_demo_sets_are_bounded_and_reach_every_group(spark):
    from quire.plans.reports import fixed_groups
    q = spark.range(95).selectExpr("id AS ques_id")
    d = spark.createDataFrame([(i * i + 3,) for i in range(11)], "demo_id long")      # ids with gaps, a last set of three
    gq, gd = fixed_groups(q, d, 10, 4)
    sets = {}
    for r in gd.collect():
        sets.setdefault(r["group_id"], set()).add(r["demo_id"])
    assert gq.count() == 95 and set(sets) == set(range(10))
    ids = [i * i + 3 for i in range(11)]
    assert all(sets[g] == set([ids[:4], ids[4:8], ids[8:]][g % 3]) for g in sets)
    assert fixed_groups(q, d.limit(0), 10, 4)[1].count() == 0
