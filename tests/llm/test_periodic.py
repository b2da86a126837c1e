"""Periodic runs against a search of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import periodic
from quire.llm.queries import op12_periodic_runs


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def runs(w, least=12):
    """Stretches of words q apart that are equal, of every q; of equal stretches the smallest q."""
    out, seen = [], set()
    n = len(w)
    code = np.unique(np.array(w, dtype=object).astype(str), return_inverse=True)[1] if n else np.zeros(0, int)
    for q in range(1, n // 2 + 1):
        same = np.flatnonzero(np.diff(np.concatenate([[0], (code[q:] == code[:-q]).astype(np.int8), [0]])))
        for a, b in zip(same[::2].tolist(), same[1::2].tolist()):
            if b - a + q >= max(least, 2 * q) and (a, b + q) not in seen:
                seen.add((a, b + q))
                out.append((a, b + q - a, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts(seed=4):
    rng = random.Random(seed)
    out = [None, "", " \t\n ", "one", "a " * 500, "a b " * 300, "é ü\x0bé ü\f" * 9, "x" * 60_000, " ".join(f"w{i}" for i in range(3000))]
    for n in (13, 30, 80, 200):
        out += ["  ".join(rng.choice("ab") for _ in range(n)) for _ in range(25)]
        out += [" ".join(rng.choice("abcde") for _ in range(n)) for _ in range(5)]
    for _ in range(30):
        block = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))]
        body = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]
        out.append(" ".join(body + block * rng.randint(2, 5) + block[:rng.randint(0, len(block))] + body + [rng.choice("ab")] * rng.randint(0, 20)))
    fib = ["a", "a b"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + " " + fib[-2])
    thue = "a"
    while len(thue) < 700:
        thue += thue.translate(str.maketrans("ab", "ba"))
    return out + fib + [" ".join(thue)] * 2


@pytest.mark.parametrize("least", [12, 2, 5])
def test_runs_of_texts(spark, least):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(None if i == 3 else i, t, "keep", 1) for i, t in rows], "doc_id long, text string, runs string, block int").repartition(4)
    got = periodic.find_runs(docs, least=least).collect()
    assert len(got) == len(rows)
    for r in got:
        w = words(rows[3 if r["doc_id"] is None else r["doc_id"]][1])
        want = runs(w, least)
        assert [tuple(x) for x in r["runs"]] == want
        assert (r["n_words"], r["collapsed"], r["block"]) == (len(w), collapsed(w, want), 1)
    assert periodic.find_runs(docs.limit(0)).count() == 0


def _row(i, text):
    w = words(text)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs(w)
    s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(found), s, length, q, 1000 * length // q if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapsed(w, found)))


def test_query_on_a_small_table(spark, tmp_path):
    rows = list(enumerate(texts(7))) + [(None, "a b " * 20)] + [(10_000 + i, " ".join(f"w{i % 50}" for i in range(n))) for i, n in enumerate([0, 1, 2, 5, 40, 400] * 12)]
    rows += rows[20:24]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit("x"), "w": F.lit("y")}).write.parquet(str(tmp_path / "documents.parquet"))
    assert sum(i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 15
    got = [tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((_row(*r) for r in rows), key=str)


def test_query_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r["doc_id"]: _row(r["doc_id"], r["text"]) for r in docs}
