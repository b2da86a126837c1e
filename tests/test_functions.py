"""Hand fixtures for the scalar functions."""

import pytest
from pyspark.sql import functions as F

from quire.functions import (entity_text, lcs_ratio_arrow, lcs_ratio_native, lcs_ratio_py, normalise_reply,
                             parse_json_reply, parse_yes_no, token_count)

RATIO_CASES = [
    ("kitten", "sitting", 0.615385),
    ("", "", 1.0),
    ("", "x", 0.0),
    ("abc", "abc", 1.0),
    ("Honey Basil Amber", "Rude Hippo Honey Basil Amber", 0.755556),
    ("héllo 😀 w", "hello 😀 world", 0.727273),
]


def _dp_ratio(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b):
            cur.append(prev[j] + 1 if ca == cb else max(prev[j + 1], cur[j]))
        prev = cur
    return 1.0 if not a and not b else 2 * prev[-1] / (len(a) + len(b))


@pytest.mark.parametrize("a,b,want", RATIO_CASES)
def test_ratio_python(a, b, want):
    assert round(lcs_ratio_py(a, b), 6) == want
    assert lcs_ratio_py(a, b) == _dp_ratio(a, b)


def test_ratio_property_random():
    import random
    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choice("abcde😀") for _ in range(rng.randint(0, 90)))
        b = "".join(rng.choice("abcde😀") for _ in range(rng.randint(0, 90)))
        assert abs(lcs_ratio_py(a, b) - _dp_ratio(a, b)) < 1e-12


def test_ratio_spark_paths_agree(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in RATIO_CASES], "a string, b string")
    rows = df.select(lcs_ratio_native(F.col("a"), F.col("b")).alias("n"),
                     lcs_ratio_arrow(F.col("a"), F.col("b")).alias("p")).collect()
    for (a, b, want), r in zip(RATIO_CASES, rows):
        assert round(r["n"], 6) == want
        assert round(r["p"], 6) == want


def test_entity_order_kept(spark):
    df = spark.sql("SELECT map('Song_Name', 'x', 'Artist', 'y', 'Album', 'z') AS e")
    assert df.select(entity_text(F.col("e"))).first()[0] == '"Song_Name": "x", "Artist": "y", "Album": "z"'


def test_token_count(spark):
    df = spark.createDataFrame([("Brand#13 PROMO-x",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(token_count(F.col("t"))).collect()] == [6, 0, 0]


def test_parse_yes_no(spark):
    text = "Question 1, Yes, same\nNo, different\n\nI know\nyes and no"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_yes_no(F.col("t"))).first()[0] == [1, 0, 0, 1]


def test_json_reply_and_normalise(spark):
    rows = [('{"Question1": "a;;", "Question2": 3}',), ('{"Question1": "x"',), ("not json",)]
    df = spark.createDataFrame(rows, "t string").select(parse_json_reply(F.col("t")).alias("m"))
    got = [r["m"] for r in df.collect()]
    assert got[0] == {"Question1": "a;;", "Question2": "3"}
    assert got[1] is None and got[2] is None
    n = spark.createDataFrame([("assertEquals (a, b);;",)], "t string").select(normalise_reply(F.col("t"))).first()[0]
    assert n == "assertEquals(a,b)"


def test_missing_attribute_policy(spark):
    from quire.operators.features import feature_vector
    df = spark.sql("SELECT map('a', 'xy', 'b', 'z') AS e1, map('a', 'xy') AS e2")
    got = df.select(feature_vector(F.col("e1"), F.col("e2"), max_len=10, missing="empty").alias("f")).first()["f"]
    assert got == [1.0, 0.0]
    got = df.select(feature_vector(F.col("e1"), F.col("e2"), missing="empty").alias("f")).first()["f"]
    assert got == [1.0, 0.0]
    with pytest.raises(Exception):
        df.select(feature_vector(F.col("e1"), F.col("e2"), max_len=10).alias("f")).collect()
    with pytest.raises(Exception):
        df.select(feature_vector(F.col("e1"), F.col("e2")).alias("f")).collect()


def test_legacy_set_cost(spark):
    from quire.operators.coverage import set_costs
    cc = spark.createDataFrame([(0, 7, 1), (0, 7, 2), (0, 8, 2)], "cluster_id long, demo_id long, ques_id long")
    qc = spark.createDataFrame([(1, 5), (2, 9)], "ques_id long, cost int")
    dc = spark.createDataFrame([(7, 3), (8, 4)], "demo_id long, cost int")
    now = {r["demo_id"]: r["set_cost"] for r in set_costs(cc, qc, dc).collect()}
    old = {r["demo_id"]: r["set_cost"] for r in set_costs(cc, qc, dc, legacy=True).collect()}
    assert now == {7: 3 + 5 + 9, 8: 4 + 9}
    assert old == {7: 3 + 2 * 5, 8: 4 + 5}   # every question charged the first question's cost


def test_ratio_hypothesis_unicode():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=70), st.text(max_size=70))
    def check(a, b):
        assert abs(lcs_ratio_py(a, b) - _dp_ratio(a, b)) < 1e-12

    check()
