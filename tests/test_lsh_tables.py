"""The approximate join with its tables filed some at a time."""

import numpy as np

from quire.operators import lsh


def test_some_tables_have_the_numbers_of_all():
    x = np.random.default_rng(3).standard_normal((30, 16))
    whole = lsh.buckets(x, 5, 2, 3)
    parts = [lsh.buckets(x, 5, 2, 3, some=some) for some in (range(0, 2), range(2, 4), range(4, 5))]
    assert (np.concatenate(parts, axis=1) == whole).all()


def test_tables_filed_apart(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((20, 16))
    vec = [[float(v) for v in base[i % 20] + 0.3 * rng.standard_normal(16)] for i in range(120)]
    v = spark.createDataFrame(list(enumerate(vec)) + [(200, None), (201, [0.0] * 16)], "id long, vec array<double>").repartition(3)
    other, filed, each = v.withColumnRenamed("id", "id2"), lsh._filed, []
    monkeypatch.setattr(lsh, "_filed", lambda df, t, h, p, some=None: each.append(some) or filed(df, t, h, p, some))
    join = lambda: sorted(tuple(r) for r in lsh.lsh_join(v, other, "id", "id2", 0.4, tables=5, hashes=1, self_join=True).collect())
    want = join()
    assert len(want) > 100 and set(each) == {range(0, 5)}
    each.clear()
    monkeypatch.setattr(lsh, "FILED_ROWS", 2 * 121 * 5)
    assert join() == want and set(each) == {range(0, 2), range(2, 4), range(4, 5)}
