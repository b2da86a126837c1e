"""The Merkle manifest against plain hashing."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quire.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def up(level, fanout):
    """Levels from the leaves to the last node."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(levels, place, fanout):
    out = []
    for level in levels[:-1]:
        head = place - place % fanout
        out += [d for i, d in enumerate(level[head:head + fanout], head) if i != place]
        place //= fanout
    return out


def expected(rows, fanout):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        mine = sorted(((r[0] is not None, r[0] or 0), H(*map(enc, r))) for r in rows if r[1] == s)
        trees[s] = ([m[0][1] if m[0][0] else None for m in mine], up([m[1] for m in mine], fanout))
    above = up([trees[s][1][-1][0] for s in sources], fanout)
    out = []
    for g, s in enumerate(sources):
        ids, levels = trees[s]
        for place, i in enumerate(ids):
            proof = siblings(levels, place, fanout) + siblings(above, g, fanout)
            out.append((str(i), levels[0][place], levels[-1][0], above[-1][0], H(*proof)))
    return sorted(out)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def found(spark, rows, fanout, changed=None):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"grp": F.lit("x"), "leaf": F.lit(1), "key": F.lit("k"), "place": F.lit(0), "run": F.lit("")}).repartition(3)
    out = merkle.manifest(merkle.leaves(docs, changed=changed), fanout)
    return out.select("key", *(merkle.text_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")), F.sha2(merkle.proof_text(F.col("path")), 256).alias("proof"),
                      merkle.text_of(merkle.folded(F.col("other"), F.col("path"))).alias("folded")).collect()


def table():
    rows = [(i, "s%d" % (i % 3), "en", i, "text Ä %d" % i) for i in range(60)] + [(i, "hot", None, i, "t") for i in range(290)]
    rows += [(5, None, "de", 1, None), (None, None, "de", 1, ""), (7, "", None, None, "x"), (7, "", None, None, "x"), (7, "hot", "en", 2, "same id"),
             (7, "é", "en", 2, "x" * 100_000), (8, "z", "en", 2, "one"), (-3, "-", "en", 2, "one")]
    return rows + [rows[3], rows[61]]


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_against_plain_hashing(spark, fanout):
    got = found(spark, table(), fanout)
    assert sorted((str(r["key"]), r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got) == expected(table(), fanout)
    assert all(r["folded"] == r["root"] for r in got)


def test_one_changed_byte_is_found(spark):
    got = found(spark, table(), 16, changed={"text": F.when(F.col("doc_id") == 8, F.translate("text", "o", "0")).otherwise(F.col("text"))})
    wrong = [(r["key"], r["folded"] == r["root"]) for r in got if r["folded"] != r["root"]]
    # of the rows with id 8, s2's text holds no o
    assert wrong == [(8, False)]


def test_small_tables(spark):
    for rows in ([], [(1, "a", "en", 1, "x")], [(None, None, None, None, None)], [(1, "a", "en", 1, "x"), (1, "b", "en", 1, "x")]):
        got = found(spark, rows, 16)
        assert sorted((str(r["key"]), r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got) == expected(rows, 16)


def test_sibling_places(spark):
    row = spark.range(1).select(merkle.sibling_places(F.lit(6).cast("long"), 2).alias("a"), merkle.sibling_places(F.lit(6).cast("long"), 4).alias("b")).first()
    assert row["a"] == [7] and sorted(row["b"]) == [4, 5, 7]
