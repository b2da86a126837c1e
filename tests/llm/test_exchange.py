"""The exchange between blocks and shards: the same answers by any tree, rows in proportion to the blocks."""

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import blocks as bl
from quire.llm import lm_deleted, ngram_join, suffix_dedup

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi".split()


def _docs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(WORDS, 40))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(0, 40, 3)] + [(200, None), (201, ""), (None, rows[1][1]), (3, rows[3][1])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def _rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("fan", [2, 3])
def test_same_results_by_a_tree(spark, monkeypatch, fan):
    docs = _docs(spark)

    def run():
        return [_rows(lm_deleted.score(docs, 8, 8)), _rows(ngram_join.near_copies(docs, 8)), _rows(suffix_dedup.remove_repeats(docs, 8))]

    one_hop = run()
    monkeypatch.setattr(bl, "FAN", fan)
    assert bl.exchange_levels(8) == (3 if fan == 2 else 2)
    assert run() == one_hop


@pytest.mark.parametrize("size", [9, 27, 81])
def test_rows_of_a_hop_are_in_proportion_to_the_blocks(spark, monkeypatch, size):
    def payloads(block, shards):
        return pa.table({"shard": pa.array(range(shards), pa.int32()), "block": pa.array([block] * shards, pa.int32()),
                         "payload": pa.array([f"{block}>{s}".encode() for s in range(shards)], pa.binary())})

    monkeypatch.setattr(bl, "FAN", 3)
    ex = bl.Exchange(size)
    blocks = spark.createDataFrame([(b,) for b in range(size)], "block int")
    sent = blocks.groupBy("block").applyInArrow(lambda key, rows: ex.send(payloads(key[0].as_py(), size)), ex.schema)
    assert sent.count() == 3 * size
    told = ex.answered(sent, lambda t: t).collect()
    assert len(told) == 3 * size
    got = [(s, b, p) for r in told for s, b, p in zip(r["shard"], r["block"], r["payload"])]
    assert {r["gang"] for r in told} == set(range(size)) and all(set(r["block"]) == {r["gang"]} for r in told)
    assert sorted((b, s) for s, b, _ in got) == [(b, s) for b in range(size) for s in range(size)]
    assert all(p == f"{b}>{s}".encode() for s, b, p in got)


def test_branches_are_equal():
    for shards in (1, 4096, 4097, 30_000, 16 << 20, (16 << 20) + 1, 40_000_000):
        ex = bl.Exchange(shards)
        assert (ex.fan - 1) ** ex.levels < shards <= ex.fan ** ex.levels and ex.fan <= bl.FAN
    assert (bl.Exchange(4097).levels, bl.Exchange(4097).fan) == (2, 65)


def test_no_payload_no_bundle():
    empty = bl.bundle(bl.unbundle(pa.table({c: pa.array([], pa.list_(t)) for c, t in (("shard", pa.int32()), ("block", pa.int32()), ("payload", pa.binary()))})), 4, 4)
    assert empty.num_rows == 0 and bl.unbundle(empty).num_rows == 0
    own = pa.table({"shard": pa.array([-1, -6], pa.int32()), "block": pa.array([0, 5], pa.int32()), "payload": pa.array([b"a", b"b"], pa.binary())})
    back = bl.unbundle(bl.bundle(own, 4, 4))
    assert sorted(zip(*(c.to_pylist() for c in back.columns))) == [(-6, 5, b"b"), (-1, 0, b"a")]
