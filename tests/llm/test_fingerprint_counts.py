"""Rarity counts over every window, digests and likeness, recomputed window by window."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from quire.llm import fingerprints as fp


def score(window):
    share = Counter(b & 31 for b in window).values()
    return round((math.log2(64) - sum(n * math.log2(n) for n in share) / 64) * 64)


def texts():
    rng = random.Random(3)
    return ["", None, "short", "x" * 63, "y" * 64, "é" * 90, "ab" * 3000] + ["".join(rng.choice("abcdefgh ijkl") for _ in range(rng.randint(0, 500))) for _ in range(25)]


def test_counts_of_every_window(spark, monkeypatch):
    monkeypatch.setattr(fp, "SLICE", 50)
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows + rows[:9], "doc_id long, text string").repartition(3)
    want = Counter()
    for _, t in rows + rows[:9]:
        b = (t or "").encode()
        want.update(score(b[i:i + 64]) for i in range(len(b) - 63))
    got = fp.score_counts(docs)
    assert sum(got.values()) == sum(want.values())
    assert all(abs(s - t) <= 1 for s, t in zip(sorted(Counter(got).elements()), sorted(want.elements())))     # single precision
    assert fp.score_counts(docs.limit(0)) == {}


def test_slices_do_not_change_scores(monkeypatch):
    buf = np.frombuffer(("".join(t or "" for t in texts())).encode(), np.uint8)
    off = np.array([0, 1000, 1030, len(buf)])
    whole = fp._all_scores(buf, off)
    monkeypatch.setattr(fp, "SLICE", 7)
    assert (fp._all_scores(buf, off) == whole).all() and len(whole) == 937 + 0 + len(buf) - 1030 - 63


@pytest.mark.parametrize("rows", [[], [(1, "one text alone " * 20)], [(1, "a b c " * 40), (1, "a b c " * 40), (None, "z " * 80), (None, None)]])
def test_small_tables(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, part string, role int")
    got = fp.fingerprint_with_next(docs, 3).collect()
    assert len(got) == len(rows)
    if len(rows) == 1:
        assert got[0]["near_next"] == 1.0
    same = {}
    for r in got:
        same.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in same.values())


def test_equal_texts_side_by_side():
    """A text's digest does not depend on its neighbours, not even where the same feature wins in both."""
    some = [t.encode() for t in texts() if t] + [b"one text alone " * 20, b"one text alone " * 20, b"a b c " * 40, b"a b c " * 40, b"one text alone " * 20]
    rank = fp.ranks({s: (s * 37) % 91 for s in range(385)})
    alone = [fp.filters([t], rank)[0].tobytes() for t in some]
    assert [x.tobytes() for x in fp.filters(some, rank)] == alone
    assert [x.tobytes() for x in fp.filters(some[::-1], rank)] == alone[::-1]


def test_every_window_competes():
    """A digest recomputed from all windows of a text, one by one."""
    rng = random.Random(5)
    rank = fp.ranks({s: (s * 37) % 91 for s in range(385)})
    for n in (64, 65, 90, 300, 6000):
        t = "".join(rng.choice("abcdefgh ijklmnopq.,") for _ in range(n)).encode()
        buf = np.frombuffer(t, np.uint8)
        at = [i for i in range(n - 63) if score(t[i:i + 64]) >= fp.LOWEST]
        h = [int(fp.bl.span_hashes(buf, np.array([i]), np.array([i + 64]))[0]) for i in at]
        key = [(int(rank[score(t[i:i + 64])]), x >> 16) for i, x in zip(at, h)]
        wins = Counter(min(range(max(s, 0), min(s + fp.NEAR, len(at))), key=key.__getitem__) for s in range(1 - fp.NEAR, len(at)))
        chosen = [h[i] for i in range(len(at)) if wins[i] >= fp.MIN_WINS]
        assert chosen
        want = np.zeros((-(-len(chosen) // fp.PER_FILTER), fp.BITS), bool)
        for i, x in enumerate(chosen):
            for k in range(fp.HASHES):
                want[i // fp.PER_FILTER, (x >> 12 * k) % fp.BITS] = True
        assert (fp.filters([t], rank)[0] == np.packbits(want, axis=1)).all()
