"""Bigram language model by deleted interpolation.

``P(w | v) = l2(b) c(vw)/c(v) + l1(b) c(w)/N + l0(b)/(V+1)`` where b is the bucket of the context's
frequency (its binary logarithm; unseen contexts are bucket 0).  The weights of a bucket are learned by
expectation-maximisation on held-out counts: every training position is held out in turn, that is, one is
taken from its counts.  Positions enter EM as counts of cells (bucket, and both ratios in steps of a
quarter of a binary logarithm), so the driver sees a table whose size does not depend on the corpus.

Counts are joined shard by shard (see ``blocks``); the corpus's n-grams never pass the driver.

Defined cases: a null text is empty (its only token is the end); a document without id is never held out;
rows that repeat count and are scored each time; with no training text every token has probability 1
under the uniform part; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import blocks as bl
from quire.session import cut_lineage

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)     # not mixed: no word's hash but by chance
STEP, SEEN_BINS, WORD_BINS = 4, 128, 200
ROUNDS = 60


def _tokens(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every token (words and an end for each document), that of its context, and the n+1 offsets."""
    buf, off = bl.text_bytes(rows.column("text"))
    h, at = bl.all_word_hashes(buf, off, bl.SPACED)
    n = len(at) - 1
    stop = at[1:] + np.arange(1, n + 1)                       # with the ends
    token = np.full(len(h) + n, END, np.uint64)
    inner = np.ones(len(token), bool)
    inner[stop - 1] = False
    token[inner] = h
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[np.append(0, stop[:-1])[: n]] = START
    return token, context, np.append(0, stop)


def bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 0)


def _bin(ratio: np.ndarray, bins: int) -> np.ndarray:
    """0 for zero, else 1 + the negative binary logarithm in steps."""
    x = np.minimum(np.rint(-np.log2(np.maximum(ratio, 2.0 ** -60)) * STEP).astype(np.int64), bins - 2)
    return np.where(ratio > 0, 1 + x, 0)


def _unbin(b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, 2.0 ** (-(b - 1) / STEP), 0.0)


def learn_weights(cells: list[tuple[int, int, int, int]], vocabulary: int, rounds: int = ROUNDS) -> np.ndarray:
    """Rows by bucket: weights of the bigram, unigram and uniform part."""
    out = np.tile(np.array([0.0, 0.9, 0.1]), (64, 1))
    if not cells:
        return out
    x = np.array(cells, dtype=np.int64)
    parts = np.stack([_unbin(x[:, 1]), _unbin(x[:, 2]), np.full(len(x), 1.0 / (vocabulary + 1))])
    for b in np.unique(x[:, 0]):
        here = x[:, 0] == b
        p, n = parts[:, here], x[here, 3].astype(float)
        w = np.array([0.5, 0.4, 0.1]) if b else np.array([0.0, 0.8, 0.2])
        for _ in range(rounds):
            r = w[:, None] * p
            w = ((r / r.sum(0)) * n).sum(1)
            w /= w.sum()
        out[b] = w
    seen = np.unique(x[:, 0])
    for b in range(64):                                       # a bucket without a position: as the nearest
        if b not in seen and b:
            out[b] = out[seen[np.argmin(np.abs(seen - b))]]
    out = np.maximum(out, [0.0, 1e-9, 1e-9])
    return out / out.sum(1, keepdims=True)


def score(docs: DataFrame, shards: int, blocks: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    dealt = bl.blocked(docs, blocks, id_col, text_col).withColumn("held_out", held)

    def request(block: int, rows: pa.Table) -> pa.Table:
        token, context, at = _tokens(rows)
        train = np.repeat(~rows.column("held_out").to_numpy(), np.diff(at))
        out = []
        for base, h in ((0, token), (shards, bl.combine(context, token))):
            u, n = np.unique(h, return_counts=True)
            seen, m = np.unique(h[train], return_counts=True)
            count = np.zeros(len(u), np.int64)
            count[np.searchsorted(u, seen)] = m
            out.append(bl.requests(block, u, shards, count, base=base))
        return pa.concat_tables(out)

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        """A block's documents with the counts of all their tokens and bigrams."""
        token, context, at = _tokens(rows)
        u, where = np.unique(token, return_inverse=True)
        told = bl.answers_of(answers, 0, shards)
        words = told // 2
        distinct = int((words[told % 2 == 1] > 0).sum())
        pair_u, pair_at = np.unique(bl.combine(context, token), return_inverse=True)
        pairs = bl.answers_of(answers, shards) // 2
        train = ~rows.column("held_out").to_numpy()
        n = np.diff(at)
        counts = bl.pack(bl.smallest(words[where]), bl.smallest(pairs[pair_at]), bl.smallest(n))
        return pa.table({"key": pa.array([rows.column("key").to_numpy()]), "doc_id": pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                         "held_out": pa.array([rows.column("held_out").to_pylist()]), "counts": pa.array([counts], pa.binary()),
                         "distinct": pa.array([distinct], pa.int64()), "trained": pa.array([int(n[train].sum())], pa.int64()),
                         "starts": pa.array([int(train.sum())], pa.int64())})

    counted = cut_lineage(bl.count_join(
        dealt, request, bl.total_counts, finish,
        "key array<long>, doc_id array<long>, held_out array<boolean>, counts binary, distinct long, trained long, starts long",
        2 * shards))
    facts = counted.agg(F.sum("distinct").alias("v"), F.sum("trained").alias("n"), F.sum("starts").alias("s")).first()
    vocabulary, total, starts = int(facts["v"] or 0), int(facts["n"] or 0), int(facts["s"] or 0)

    def positions(row: dict) -> tuple[np.ndarray, ...]:
        word, pair, n = (x.astype(np.int64) for x in bl.unpack(row["counts"]))
        stop = np.cumsum(n)
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[stop - n] = starts
        return word, pair, context, n, stop - n

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for batch in batches:
            for row in batch.to_pylist():
                word, pair, context, n, _ = positions(row)
                train = np.repeat(~np.array(row["held_out"], bool), n)
                word, pair, context = word[train] - 1, pair[train] - 1, context[train] - 1
                seen = _bin(pair / np.maximum(context, 1), SEEN_BINS)
                code = (bucket(context) * SEEN_BINS + seen) * WORD_BINS + _bin(word / max(total - 1, 1), WORD_BINS)
                for c, k in zip(*(x.tolist() for x in np.unique(code, return_counts=True))):
                    sums[c] = sums.get(c, 0) + k
        yield pa.RecordBatch.from_pydict({"cell": pa.array(list(sums), pa.int64()), "n": pa.array(list(sums.values()), pa.int64())})

    # at most 64 x 128 x 200 cells
    found = counted.select("counts", "held_out").mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights([(r["cell"] // (SEEN_BINS * WORD_BINS), r["cell"] // WORD_BINS % SEEN_BINS, r["cell"] % WORD_BINS, r["n"])
                             for r in found], vocabulary)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                word, pair, context, n, first = positions(row)
                w = weights[bucket(context)]
                p = w[:, 0] * (pair / np.maximum(context, 1)) + w[:, 1] * (word / max(total, 1)) + w[:, 2] / (vocabulary + 1)
                if not total:
                    p = np.full(len(word), 1.0 / (vocabulary + 1))
                base = np.log10((word + 0.1) / (total + 0.1 * (vocabulary + 1)))
                known = (word > 0).astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(row["key"], pa.int64()), "doc_id": pa.array(row["doc_id"], pa.int64()),
                    "held_out": pa.array(row["held_out"], pa.bool_()), "n_tokens": pa.array(n),
                    "n_known": pa.array(np.add.reduceat(known, first)), "train_tokens": pa.array([total] * len(n), pa.int64()),
                    "base_score": pa.array(np.add.reduceat(base, first)), "score": pa.array(np.add.reduceat(np.log10(p), first))})

    return counted.mapInArrow(scores, "key long, doc_id long, held_out boolean, n_tokens long, n_known long, "
                                      "train_tokens long, base_score double, score double")
