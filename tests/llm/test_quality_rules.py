"""Quality rules: figures against counting word by word, limits against sorted values."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.llm import quality_rules as qr

FIGURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def counted(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    times = {}
    for g in grams:
        times[g] = times.get(g, 0) + 1
    again = {i + j for i, g in enumerate(grams) if times[g] > 1 for j in range(5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(again))


def texts(seed=3):
    rng = random.Random(seed)
    out = [None, "", "\n", " \n\n ", "one", "a\nb\na\n", "a\n a\na ", "x" * 70_000, "a " * 9_000, "é ß # * <b>|\n" * 4, "\n".join(["same line of six words here"] * 40)]
    for _ in range(60):
        out.append("".join(rng.choice("ab é#\n\t$ ") for _ in range(rng.randint(1, 400))))
    return out


def test_figures(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(None if i == 5 else i, t, "en", None, "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, kept string, n int")
    docs = docs.unionByName(docs).repartition(3)
    got = qr.judge(docs).collect()
    assert len(got) == 2 * len(rows)
    for r in got:
        want = counted(rows[5 if r["doc_id"] is None else r["doc_id"]][1])
        assert tuple(r[c] for c in FIGURES) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[5] > 20 * want[0])
        assert not (r["kept"] and (r["base_failed"] or r["failed"]))
    assert qr.judge(docs.limit(0)).count() == 0


def bucket(v):
    width = 1 << max(0, v.bit_length() - 8)
    return v // width * width, v // width * width + width - 1


def quartile(values, k):
    return sorted(values)[-(-k * len(values) // 4) - 1]


@pytest.mark.parametrize("parts", [1, 7])
def test_limits_are_quartiles_of_merged_sketches(spark, parts):
    rng = random.Random(8)
    rows = [(i, "en" if i % 3 else None, "hot" if i % 2 else f"s{i % 40}", rng.choice([rng.randint(0, 300), rng.randint(0, 90_000)])) for i in range(3000)]
    measured = spark.createDataFrame(rows, "doc_id long, lang_key string, source_key string, n_symbols long").fillna("", "lang_key").repartition(parts)
    measured = measured.withColumns({c: F.lit(1000).cast("long") for c in FIGURES if c != "n_symbols"})
    got = {(r["lang_key"], r["source_key"]): (r["symbols_low"], r["symbols_high"]) for r in qr.limits(qr.sketch(measured), least_docs=300).collect()}
    groups = {}
    for _, lang, source, v in rows:
        groups.setdefault((lang or "", source), []).append(v)
    for (lang, source), values in groups.items():
        if len(values) < 300:
            values = [r[3] for r in rows if (r[1] or "") == lang]
        q1, q3 = bucket(quartile(values, 1))[0], bucket(quartile(values, 3))[1]
        away = max(8 * (q3 - q1), 250)
        assert got[lang, source] == (q1 - away, q3 + away)


def test_a_source_has_its_own_limits(spark):
    """Symbols that one source uses throughout are ordinary there, and odd in another."""
    code, prose = "if a < b and b > c then call it # so", "a plain line of quite ordinary words again and so on"
    rng = random.Random(1)
    text = lambda base: " ".join(rng.sample(base.split(), 9)) + " " + " ".join(f"w{rng.randint(0, 99)}" for _ in range(60))
    rows = [(i, text(code) + " <" * (i % 3), "en", "code") for i in range(300)] + [(1000 + i, text(prose), "en", "prose") for i in range(300)]
    rows += [(5000, " ".join(f"w{i} <" for i in range(80)), "en", "prose"), (5001, text(code), "en", "rare")]
    got = {r["doc_id"]: r for r in qr.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[5000]["failed"] == ["symbols"] and not got[5000]["kept"]
    assert all(r["kept"] for i, r in got.items() if i != 5000 and not r["base_failed"])
    assert sum(r["kept"] for r in got.values()) > 590


def test_labelled_table(spark):
    """Good labelled documents stay; most bad ones go."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = qr.judge(docs).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"), F.avg((~F.col("base_failed")).cast("int")).alias("b")).collect()
    share = {r["quality"]: r for r in got}
    assert share[1]["k"] >= share[1]["b"] - 0.005
    assert share[0]["k"] < 0.5
