"""Improbable-feature digests of whole texts.

A feature is a window of 64 bytes.  A window's score is the Shannon entropy of its bytes (in 32 classes,
``byte & 31``); the rarer a score over all windows of the corpus, the better its rank.  Every window of at least
1.5 bit is a candidate, and one that is the best (rank, hash) in at least ``MIN_WINS`` of the stretches of ``NEAR``
candidates around it is selected.  Selected features are put, in text order, into a chain of Bloom filters of 1,024 bits,
at most 64 features each, four bits a feature.  Two chains are compared by normalised bit overlap.

Defined cases: null is the empty text; an empty text has the empty fingerprint, which is like
another empty one (1.0) and unlike any other (0.0); a text without a usable window has one feature,
its whole text.  Equal texts have equal fingerprints whatever surrounds them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import blocks as bl
from quire.session import cut_lineage

SPAN = 64            # bytes of a feature
NEAR = 48            # candidates that compete
MIN_WINS = 18
BITS, HASHES, PER_FILTER = 1024, 4, 64
SLICE = 1 << 15      # windows scored at once
LOWEST = 96          # scores (1/64 bit) below 1.5 bit are no features
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)

_X = np.arange(SPAN + 2, dtype=np.float64)
_POINT = 20          # binary places of a sum of n log2 n: whole numbers, so that no order of addition decides
_XLOGX = np.rint(np.where(_X > 0, _X * np.log2(np.maximum(_X, 1)), 0) * (1 << _POINT)).astype(np.int64)
_LESS = np.append(0, _XLOGX[:-1]) - _XLOGX           # what one byte less, or one more, of a class adds
_MORE = np.append(_XLOGX[1:], 0) - _XLOGX
_CLASS = [np.where((np.arange(256) & 31) // 8 == g, 1 << (8 * ((np.arange(256) & 31) % 8).astype(np.uint64)), 0).astype(np.uint64)
          for g in range(4)]


def _candidates(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, document and score (1/64 bits) of every window of every text."""
    windows = np.maximum(np.diff(off) - SPAN + 1, 0)
    at = np.arange(int(windows.sum())) + np.repeat(off[:-1] - (np.cumsum(windows) - windows), windows)
    return at, np.repeat(np.arange(len(windows)), windows), _scores(buf)[at]


def _scores(buf: np.ndarray) -> np.ndarray:
    """Scores (1/64 bits) of all windows of a buffer, also of those across two texts."""
    n = max(len(buf) - SPAN + 1, 0)
    out = np.zeros(n, np.int16)
    for a in range(0, n, SLICE):
        part = buf[a:a + SLICE + SPAN - 1]
        m = len(part) - SPAN + 1
        held = np.empty((m, len(_CLASS)), np.uint64)           # of each window, the bytes of each class, a byte a class
        sums = np.zeros(len(part) + 1, np.uint64)
        for g, table in enumerate(_CLASS):
            np.cumsum(table[part], out=sums[1:])
            np.subtract(sums[SPAN:], sums[:-SPAN], out=held[:, g])
        held, kind = held.view(np.uint8).ravel(), part & np.uint8(31)
        row = np.arange(0, 32 * (m - 1), 32)
        left, came = kind[:m - 1], kind[SPAN:]                 # from a window to the next one byte leaves and one comes
        change = _LESS[held[row + left]] + _MORE[held[row + came]]
        change[left == came] = 0
        total = np.empty(m, np.int64)
        total[0] = _XLOGX[held[:32]].sum()
        np.cumsum(change, out=total[1:])
        total[1:] += total[0]
        out[a:a + m] = SPAN * 6 - (total + (1 << _POINT - 1) >> _POINT)
    return out


def _all_scores(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Scores of every window of every text."""
    return _candidates(buf, off)[2]


def score_counts(docs: DataFrame, text_col: str = "text") -> dict[int, int]:
    """How many windows of the whole corpus have each score (at most 385 scores)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(6 * 64 + 1, np.int64)
        for batch in batches:
            buf, off = bl.text_bytes(batch.column(0))
            for lo, hi in bl.doc_runs(off):
                total += np.bincount(_all_scores(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]), minlength=len(total))
        yield pa.RecordBatch.from_pydict({"score": pa.array(np.flatnonzero(total)), "n": pa.array(total[total > 0])})

    rows = docs.select(F.col(text_col)).mapInArrow(count, "score long, n long").groupBy("score").agg(F.sum("n").alias("n"))
    return {int(r["score"]): int(r["n"]) for r in rows.collect()}


def ranks(counts: dict[int, int]) -> np.ndarray:
    """Rank of each score, the rarest first; scores that never occur come before all others."""
    order = sorted(range(6 * 64 + 1), key=lambda s: (counts.get(s, 0), s))
    out = np.zeros(len(order), np.uint64)
    out[order] = np.arange(len(order), dtype=np.uint64)
    return out


def filters(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The chain of each text: an array of filters, 128 bytes each."""
    out: list[np.ndarray] = []
    off = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    for lo, hi in bl.doc_runs(off):
        out += _filters(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], rank)
    return out


def _filters(buf: np.ndarray, off: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    n = len(off) - 1
    at, doc, score = _candidates(buf, off)
    good = score >= LOWEST
    at, doc, score = at[good], doc[good], score[good]
    h = bl.span_hashes(buf, at, at + SPAN)
    key = rank[score] << np.uint64(48) | h >> np.uint64(16)
    place = np.arange(len(at)) + (doc + 1) * NEAR                # a window without candidates parts two texts
    line = np.full(len(at) + (n + 2) * NEAR, _MAX)
    line[place] = key
    low, wide = line.copy(), 1
    while wide < NEAR:
        step = min(wide, NEAR - wide)
        low[:-step] = np.minimum(low[:-step], low[step:])
        wide += step
    change = np.flatnonzero(low[1:] != low[:-1]) + 1
    begin, end = np.append(0, change), np.append(change, len(low))
    value, wins = low[begin], end - begin
    keep = (value != _MAX) & (wins >= MIN_WINS)
    # the place of the winner: the last window that it wins starts on it, or it left the window
    first = begin[keep]
    spot = np.full(len(first), -1)
    for j in range(NEAR):
        x = np.minimum(first + j, len(line) - 1)
        spot = np.where((spot < 0) & (line[x] == value[keep]), x, spot)
    chosen = np.unique(np.searchsorted(place, spot))
    fh, fd = h[chosen], doc[chosen]
    size = np.diff(off)
    bare = np.flatnonzero((np.bincount(fd, minlength=n) == 0) & (size > 0))
    if len(bare):
        fh = np.append(fh, bl.span_hashes(buf, off[bare], off[bare + 1]))
        fd = np.append(fd, bare)
        order = np.argsort(fd, kind="stable")
        fh, fd = fh[order], fd[order]
    per = np.bincount(fd, minlength=n)
    chain = -(-per // PER_FILTER)
    base = np.cumsum(chain) - chain
    nth = np.arange(len(fd)) - (np.cumsum(per) - per)[fd]
    row = base[fd] + nth // PER_FILTER
    bits = np.zeros((int(chain.sum()), BITS), bool)
    for k in range(HASHES):
        bits[row, (fh >> np.uint64(12 * k)) % np.uint64(BITS)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[base[i]: base[i] + chain[i]] for i in range(n)]


def as_string(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Each filter of the shorter chain against its best partner: shared bits less those expected
    by chance, over the most possible; mean by weight, and of both directions for equal lengths."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.tobytes() == b.tobytes():
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    best_a, best_b = np.zeros(len(a)), np.zeros(len(b))
    for i in range(len(a)):
        both = np.bitwise_count(a[i] & b).sum(1, dtype=np.int64)
        chance, most = na[i] * nb / BITS, np.minimum(na[i], nb)
        like = np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1)
        best_a[i] = like.max()
        best_b = np.maximum(best_b, like)
    one = float((best_a * na).sum() / na.sum())
    return (one + float((best_b * nb).sum() / nb.sum())) / 2 if len(a) == len(b) else one


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
        "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(),
        "part": pa.int64(), "role": pa.int32(), "text": pa.string()}
_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double, part long, role int, text string")
DONE, FIRST, LAST = 0, 1, 2


def _compare(ids: list, texts: list[str], chains: list[np.ndarray], rank: np.ndarray) -> list[tuple]:
    """Rows of all texts but the last, each with the one that follows it."""
    made = [edited(a, b).encode() for a, b in zip(texts, texts[1:])]
    changed = filters(made, rank)
    return [(ids[i], len(texts[i]), hashlib.sha256(made[i]).hexdigest(), as_string(chains[i]), as_string(changed[i]),
             likeness(chains[i], changed[i]), likeness(chains[i], chains[i + 1])) for i in range(len(made))]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_OUT.values())], names=list(_OUT))


def fingerprint_with_next(docs: DataFrame, partitions: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's fingerprint, that of its edited text, and both likenesses.  "Next" is the order of
    descending id (nulls last; rows with one id by the hash of their text); the last row's is the first."""
    rank = ranks(score_counts(docs, text_col))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            ids, all_texts = batch.column("doc_id").to_pylist(), batch.column("text")
            lo = 0
            while lo < len(ids):
                hi, n, some = lo, 0, []
                while hi < len(ids) and n < 2 << 20:
                    some.append(all_texts[hi].as_py() or "")
                    n += len(some[-1])
                    hi += 1
                chains = filters([t.encode() for t in some], rank)
                run = (ids[lo:hi], some, chains)
                rows = []
                if held is None:
                    rows.append((run[0][0], 0, None, as_string(chains[0]), None, None, None, part, FIRST, some[0]))
                else:
                    run = ([held[0], *run[0]], [held[1], *run[1]], [held[2], *run[2]])
                rows += [(*r, part, DONE, None) for r in _compare(*run, rank)]
                held = (run[0][-1], run[1][-1], run[2][-1])
                if rows:
                    yield _table(rows)
                lo = hi
        if held is not None:
            yield _table([(held[0], 0, None, as_string(held[2]), None, None, None, part, LAST, held[1])])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                pair = [r["text"], r["next_text"]]
                rows += [(*x, r["part"], DONE, None) for x in _compare([r["doc_id"]], pair, filters([t.encode() for t in pair], rank), rank)]
            yield _table(rows)

    ordered = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
               .withColumn("tie", F.xxhash64("text"))
               .repartitionByRange(partitions, F.col("doc_id").desc_nulls_last(), F.col("tie"))
               .sortWithinPartitions(F.col("doc_id").desc_nulls_last(), F.col("tie")).select("doc_id", "text"))
    walked = cut_lineage(ordered.mapInArrow(walk, _SCHEMA))       # once: the ends must fit the partitions
    # two rows a partition: each partition's last text meets the first of the next one that has rows
    by_part = Window.orderBy("part")                             # over numbers of partitions only, never texts
    edge = (walked.filter(F.col("role") != DONE).groupBy("part")
            .agg(F.max(F.struct(F.col("role") == LAST, "doc_id", "text")).alias("last"),
                 F.max(F.when(F.col("role") == FIRST, F.col("text"))).alias("first")))
    after = (edge.select("part").withColumn("before", F.lag("part").over(by_part))
             .withColumn("before", F.coalesce("before", F.max("part").over(Window.partitionBy())))
             .join(edge.select("part", "first"), "part"))
    pairs = (edge.join(after.select(F.col("before").alias("part"), F.col("first").alias("next_text")), "part")
             .select(F.col("last.doc_id").alias("doc_id"), F.col("last.text").alias("text"), "next_text", "part"))
    return walked.filter(F.col("role") == DONE).unionByName(pairs.mapInArrow(ends, _SCHEMA)).drop("part", "role", "text")
