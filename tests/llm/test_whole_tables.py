"""Contracts over whole given tables, however the work is dealt."""

import numpy as np
import pytest

from quire.llm import ngram_join, suffix_dedup

GRAM = 50


def _removed(rows):
    """By id: n_bytes, n_removed, n_spans, kept; every 50-byte string of all texts, sorted at once."""
    rows = sorted((i, (t or "").encode()) for i, t in rows)
    buf = np.frombuffer(b"".join(t for _, t in rows), np.uint8)
    off = np.cumsum([0] + [len(t) for _, t in rows])
    rank = np.repeat(np.arange(len(rows)), np.diff(off))
    at = np.flatnonzero(np.arange(len(buf)) + GRAM <= off[1:][rank])
    grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, GRAM)[at]).view(f"S{GRAM}").ravel()
    _, which = np.unique(grams, return_inverse=True)
    least = np.full(which.max() + 1, len(rows))
    np.minimum.at(least, which, rank[at])
    hit = at[least[which] < rank[at]]
    change = np.bincount(hit, minlength=len(buf) + 1) - np.bincount(hit + GRAM, minlength=len(buf) + 1)[:len(buf) + 1]
    gone = np.cumsum(change)[:len(buf)] > 0
    out = {}
    for r, (i, t) in enumerate(rows):
        g = gone[off[r]:off[r + 1]]
        out[i] = (len(t), int(g.sum()), int((g & ~np.append(False, g[:-1])).sum()), buf[off[r]:off[r + 1]][~g].tobytes())
    return out


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_suffix_dedup_whole_table_at_any_number_of_blocks(spark, table):
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet").select("doc_id", "text")
    want = _removed([(r["doc_id"], r["text"]) for r in docs.collect()])
    for blocks in (1, 4, 8, 32):
        got = suffix_dedup.remove_repeats(docs, blocks).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == want, blocks


def test_links_of_very_large_sets():
    """Two sets of 655,000 shingles that differ in three share more than 65,536 prefix shingles."""
    n = 655_000
    x = np.arange(n, dtype=np.uint64)
    y = x.copy()
    y[-3:] += np.uint64(n)
    size, base = np.array([n, n]), np.full(2, ngram_join.prefix_size(n, 90))
    a, b = ngram_join.links_between((np.array([1, 2]), size, base, np.array([64, 64]), [x, y]), None, 90)
    assert list(zip(a, b)) == [(1, 2)]


def test_clusters_do_not_follow_ids(spark):
    """Unrelated texts of one id stay apart, near copies without ids come together."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    docs = spark.createDataFrame([(1, a), (1, b), (None, c), (None, c + " x"), (1, a + " y"), (None, None), (3, "")], "doc_id long, text string")
    for rows in (docs, docs.unionByName(docs)):
        got = {(r["doc_id"], r["text"]): r["cluster"] for r in ngram_join.near_copies(rows, 2).withColumnRenamed("key", "k").join(
            rows.distinct().selectExpr("xxhash64(doc_id, text) as k", "text"), "k").collect()}
        assert got[1, a] == got[1, a + " y"] != got[1, b]
        assert got[None, c] == got[None, c + " x"]
        assert len(set(got.values())) == 5


def test_pipeline_keeps_one_of_each_cluster(spark):
    import corpus_pipeline
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    docs = spark.createDataFrame([(1, a), (1, b), (None, c), (None, c + " x"), (2, a + " y"), (1, a)], "doc_id long, text string")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert len(kept) == 3 and (1, a) in kept and (1, b) in kept
    assert corpus_pipeline.near_copies(spark, docs.limit(0), "").count() == 0
