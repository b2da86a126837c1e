"""Quality by perplexity under a trusted-text language model.

One interpolated modified Kneser-Ney bigram model per language, trained on documents labelled good and
not toxic: ``TRAIN_SHARE`` of them by a hash of the id, however many there are (a caller may bound them by
``max_train`` a language); the others give the thresholds.  In the log domain a text's score is a sum of one weight per occurring n-gram:

    log p(text) = tokens * u  +  sum over its words (log p(w) - u + log g(w))  +  sum over its known bigrams d(vw)

with u the log probability of an unknown word, g(w) the back-off mass of w as a context and
d(vw) = log p(w|v) - log g(v) - log p(w).  So whole texts are scored by joining n-gram counts with
weights, shard by shard: a task sends each shard its distinct n-grams with the documents that have them, and
gets one number a document back.  The model is dealt to shards of about ``MODEL_BYTES`` of training text, and as much text as
comes to ``PART_BYTES`` for eight shards meets a copy of it, so that a task's work does not grow with the input.  A bit table
of the model (of fixed size) holds back n-grams that the model does not have; they weigh nothing.  Every task knows the weights of
the ``FREQUENT`` n-grams that the training texts have most, and adds these itself.

A document is kept if its perplexity is at most its language's threshold: ``margin`` times the quantile
``quantile`` of trusted documents outside the training sample (of all trusted ones if there are none).
A text of fewer than ``min_tokens`` tokens is too short to be judged, and kept.

Defined cases: a null text is empty (one token, its end); a language without trusted text, or null, has no
model, so no perplexity, and its documents are kept; rows that repeat are scored each; a repeated label of
an id counts once if all its labels agree that it is trusted; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import blocks as bl
from quire.session import cut_lineage

SHARDS_LOG = 3             # at least
MODEL_BYTES = 16 << 20     # training text of one shard of the model, about
PART_BYTES = 512 << 20     # text bytes that meet one copy of a model of eight shards, about
TRAIN_BYTES = 16 << 20     # training text of one shard, about
BITS_LOG = 26
FREQUENT = 1 << 20         # n-grams whose weights all tasks know, at most
SCALE = float(1 << 40)     # weights are kept as whole multiples of 1 / SCALE
RUN_BYTES = 4 << 20        # text bytes hashed at once
SEND_BYTES = 16 << 20      # text bytes whose known n-grams are sent together
KEY_BITS_LOG, KEY_PARTS_LOG = 26, 8
TRAIN_SHARE = 0.8
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)


def _grams(rows: pa.RecordBatch, lo: int, hi: int, buf: np.ndarray, off: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of documents lo..hi: hashes of a start, the words and an end (all with the language), document
    numbers, and the hashes of the bigrams, with their documents."""
    h, at = bl.all_word_hashes(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], bl.SPACED)
    n = hi - lo
    size = np.diff(at) + 2
    stop = np.cumsum(size)
    word = np.empty(len(h) + 2 * n, np.uint64)
    inner = np.ones(len(word), bool)
    inner[stop - 1] = inner[stop - size] = False
    word[stop - size], word[stop - 1], word[inner] = START, END, h
    doc = np.repeat(np.arange(n), size)
    word = bl.combine(langs[lo:hi][doc], word)
    second = np.ones(len(word), bool)
    second[stop - size] = False
    second = np.flatnonzero(second)
    return word, doc, bl.combine(word[second - 1], word[second]), second


def _langs(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("lang_hash").to_numpy().view(np.uint64)


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select("key", F.xxhash64(F.coalesce("lang", F.lit(""))).alias("lang_hash"), "text", *more)


def _pack_pairs(v: np.ndarray, w: np.ndarray, c: np.ndarray, lang: np.ndarray) -> bytes:
    """Bigrams sorted by their second word."""
    first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
    contexts, which = np.unique(v, return_inverse=True)
    langs, its = np.unique(lang[first], return_inverse=True)
    return bl.pack(bl.gaps(w[first]), bl.smallest(np.diff(np.append(first, len(w)))), bl.smallest(its), langs,
                   bl.gaps(contexts), bl.smallest(which), bl.smallest(c))


def _unpack_pairs(value: bytes) -> tuple[np.ndarray, ...]:
    w, n, its, langs, contexts, which, c = bl.unpack(value)
    n = n.astype(np.int64)
    return bl.ungaps(contexts)[which], np.repeat(bl.ungaps(w), n), c.astype(np.int64), np.repeat(langs[its], n)


def _sums_by(which: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    return np.bincount(which, weights=values, minlength=n).astype(np.int64)


def _steps(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The discount of each count, from the discounts (of 1, 2, more) of each row's language."""
    return np.where(c == 1, d[:, 0], np.where(c == 2, d[:, 1], d[:, 2]))


def _discounts(n: list[int]) -> tuple[float, float, float]:
    n1, n2, n3, n4 = (max(int(x), 1) for x in n)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.1), k - 0.1) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def shards_log(train_bytes: int) -> int:
    """Of how many shards the model of so much training text is, as a power of two."""
    return max(SHARDS_LOG, (-(-train_bytes // MODEL_BYTES) - 1).bit_length())


def text_size(docs: DataFrame) -> int:
    """Bytes of the texts; from the column ``bytes`` where there is one, so that no text is moved for it."""
    if "bytes" not in docs.columns:
        return bl.extent(docs, "text")[1]
    return docs.agg(F.sum("bytes")).first()[0] or 0


def only_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is among ``keys(key)``: a bit table of the keys (of fixed size) holds back
    nearly all other rows before the exact join, so that their texts are not moved."""
    size = 1 << (KEY_BITS_LOG - KEY_PARTS_LOG)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(size, bool)
        bits[(bl.mix(table.column("key").to_numpy().view(np.uint64)) >> np.uint64(64 - KEY_BITS_LOG)).astype(np.int64) % size] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    def part(x: pd.Series) -> pd.Series:
        return pd.Series((bl.mix(x.to_numpy().view(np.uint64)) >> np.uint64(64 - KEY_PARTS_LOG)).astype(np.int32))

    parts = keys.select("key", F.pandas_udf(part, "int")("key").alias("part")).groupBy("part").applyInArrow(run, "part int, bits binary")
    table = np.zeros((1 << KEY_BITS_LOG) // 8, np.uint8)
    for r in parts.toLocalIterator():                                                              # 2**KEY_PARTS_LOG rows at most
        table[r["part"] * size // 8:][:size // 8] = np.frombuffer(r["bits"], np.uint8)
    table = docs.sparkSession.sparkContext.broadcast(table)

    def may(x: pd.Series) -> pd.Series:
        place = (bl.mix(x.to_numpy().view(np.uint64)) >> np.uint64(64 - KEY_BITS_LOG)).astype(np.int64)
        return pd.Series((table.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool))

    return docs.where(F.pandas_udf(may, "boolean")("key")).join(keys, "key", "left_semi")


def train(docs: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """The model of ``docs(key, lang, text)``: ``shard, payload`` with the sorted hashes of words and bigrams and
    their weights; and the log10 probability of an unknown word by hash of the language.

    Bigrams meet by their second word as packed arrays.  A shard asks for the totals of its bigrams' first words,
    which the shard of that word's hash knows."""
    size = text_size(docs)
    shards, log = max(8, -(-size // TRAIN_BYTES)), shards_log(size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = bl.text_bytes(batch.column("text"))
            langs = _langs(batch)
            for lo, hi in bl.doc_runs(off, RUN_BYTES):
                word, doc, pair, second = _grams(batch, lo, hi, buf, off, langs)
                _, first, c = np.unique(pair, return_index=True, return_counts=True)
                at = second[first]
                order = np.argsort(word[at], kind="stable")
                at, c = at[order], c[order]
                cut = bl.shard_cuts(word[at], shards)
                to = [s for s in range(shards) if cut[s + 1] > cut[s]]
                out = [_pack_pairs(word[x - 1], word[x], c[cut[s]:cut[s + 1]], langs[lo:hi][doc[x]])
                       for s in to for x in [at[cut[s]:cut[s + 1]]]]
                yield pa.RecordBatch.from_pydict({"shard": pa.array(to, pa.int32()), "payload": pa.array(out, pa.binary())})

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        v, w, c, lang = (np.concatenate(x) for x in zip(*(_unpack_pairs(x.as_py()) for x in table.column("payload"))))
        order = np.lexsort((v, w))
        v, w = v[order], w[order]
        first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "payload": pa.array(
            [_pack_pairs(v[first], w[first], np.add.reduceat(c[order], first), lang[order][first])], pa.binary())})

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("payload"):
                _, w, c, lang = _unpack_pairs(value.as_py())
                first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                after = np.diff(np.append(first, len(w)))                                        # distinct contexts
                langs = np.unique(lang)
                cols = [langs.view(np.int64)]
                for x, its in ((c, np.searchsorted(langs, lang)), (after, np.searchsorted(langs, lang[first]))):
                    cols += [np.bincount(its, minlength=len(langs))]
                    cols += [np.bincount(its[x == k], minlength=len(langs)) for k in (1, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], names=names)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for me, value in zip(batch.column("shard").to_pylist(), batch.column("payload")):
                v, _, c, lang = _unpack_pairs(value.as_py())
                u, first, which = np.unique(v, return_index=True, return_inverse=True)
                langs, its = np.unique(lang[first], return_inverse=True)
                sums = [_sums_by(which, len(u), x) for x in (c == 1, c == 2, c > 2, c)]
                cut = bl.shard_cuts(u, shards)
                to = [s for s in range(shards) if cut[s + 1] > cut[s]]
                out = [bl.pack(bl.gaps(u[cut[s]:cut[s + 1]]), langs, *(bl.smallest(x[cut[s]:cut[s + 1]]) for x in (its, *sums))) for s in to]
                yield pa.RecordBatch.from_pydict({"shard": pa.array(to, pa.int32()), "block": pa.array([me] * len(to), pa.int32()),
                                                  "payload": pa.array(out, pa.binary())})

    def total(key: tuple, table: pa.Table) -> pa.Table:
        parts = [bl.unpack(x.as_py()) for x in table.column("payload")]
        hashes = [bl.ungaps(p[0]) for p in parts]
        u, first, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        lang = np.concatenate([p[1][p[2]] for p in parts])[first]
        sums = [_sums_by(which, len(u), np.concatenate([p[i] for p in parts])) for i in (3, 4, 5, 6)]
        at = np.append(0, np.cumsum([len(h) for h in hashes]))
        told = [bl.pack(*(bl.smallest(x[which[a:b]]) for x in sums)) for a, b in zip(at[:-1], at[1:])]
        me = key[0].as_py()
        return pa.table({"shard": pa.array([me] * len(told) + [-1], pa.int32()),                 # -1: all of its own words
                         "block": pa.array([*table.column("block").to_pylist(), me], pa.int32()),
                         "payload": pa.array([*told, bl.pack(bl.gaps(u), lang, *map(bl.smallest, sums))], pa.binary())})

    names = ["lang_hash", "pairs", "n1", "n2", "n3", "n4", "kinds", "m1", "m2", "m3", "m4"]
    pairs = cut_lineage(_texts(docs).mapInArrow(count, "shard int, payload binary").groupBy("shard").applyInArrow(merge, "shard int, payload binary"))
    found = sorted((np.int64(r["lang_hash"]).view(np.uint64), r) for r in                          # a row a language
                   pairs.mapInArrow(tally, ", ".join(f"{x} long" for x in names)).groupBy("lang_hash").agg(*(F.sum(x).alias(x) for x in names[1:])).collect())
    all_langs = np.array([k for k, _ in found], np.uint64)
    less_pair = np.array([_discounts([r[x] for x in names[2:6]]) for _, r in found]).reshape(-1, 3)
    less_word = np.array([_discounts([r[x] for x in names[7:]]) for _, r in found]).reshape(-1, 3)
    seen = np.array([r["pairs"] for _, r in found], float)
    kinds = np.array([[r["m1"], r["m2"], r["kinds"] - r["m1"] - r["m2"]] for _, r in found], float).reshape(-1, 3)
    unknown = (kinds * less_word).sum(axis=1) / seen / (kinds.sum(axis=1) + 1)

    def mass(sums: list[np.ndarray], its: np.ndarray) -> np.ndarray:
        return sum(x * less_pair[its, k] for k, x in enumerate(sums[:3])) / sums[3]

    def weigh(pairs: pa.Table, told: pa.Table) -> pa.Table:
        rows = sorted(zip(told.column("shard").to_pylist(), told.column("payload").to_pylist()))
        hashes, weights, levels = [np.zeros(0, np.uint64)], [np.zeros(0)], [np.zeros(0, np.uint8)]
        if pairs.num_rows:
            v, w, c, lang = _unpack_pairs(pairs.column("payload")[0].as_py())
            _, which = np.unique(v, return_inverse=True)
            its = np.searchsorted(all_langs, lang)
            sums = [np.concatenate(x)[which].astype(np.int64) for x in zip(*(bl.unpack(x) for s, x in rows if s >= 0))]
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            n = np.diff(np.append(first, len(w)))
            of = its[first]
            p1 = (n - _steps(n, less_word[of])) / seen[of] + unknown[of]
            hashes.append(w[first])
            weights.append(np.log10(p1) - np.log10(unknown[of]))
            levels.append(_level(np.add.reduceat(c, first) if len(c) else c))
            p1, spare = np.repeat(p1, n), mass(sums, its)
            hashes.append(bl.combine(v, w))
            levels.append(_level(c))
            weights.append(np.log10((c - _steps(c, less_pair[its])) / sums[3] + spare * p1) - np.log10(spare) - np.log10(p1))
        for s, x in rows:
            if s < 0:
                u, lang, *sums = bl.unpack(x)
                hashes.append(bl.ungaps(u))
                weights.append(np.log10(mass([y.astype(np.int64) for y in sums], np.searchsorted(all_langs, lang))))
                levels.append(_level(sums[3]))
        return _model_parts(np.concatenate(hashes), np.concatenate(weights), np.concatenate(levels), log)

    asked = pairs.mapInArrow(contexts, bl.REQUEST)
    told = asked.groupBy("shard").applyInArrow(total, bl.REQUEST)
    parts = pairs.groupBy("shard").cogroup(told.groupBy("block")).applyInArrow(weigh, "shard int, payload binary")
    model = parts.groupBy("shard").applyInArrow(lambda key, table: _model_parts(*_model_arrays(table), _model_levels(table), log), "shard int, payload binary")
    return cut_lineage(model), {int(k.view(np.int64)): float(np.log10(x)) for k, x in zip(all_langs, unknown)}


def _level(count: np.ndarray) -> np.ndarray:
    """Counts by their size, four steps for a doubling."""
    return np.floor(4 * np.log2(np.maximum(count, 1))).astype(np.uint8)


def _model_parts(h: np.ndarray, weight: np.ndarray, level: np.ndarray, log: int) -> pa.Table:
    """Hashes, their summed weights and the levels of their counts, a payload a shard."""
    h, which = np.unique(h, return_inverse=True)
    weight = np.bincount(which, weights=weight, minlength=len(h)).astype(float)
    most = np.zeros(len(h), np.uint8)
    np.maximum.at(most, which, level)
    whole = np.rint(weight * SCALE).astype(np.int64)
    cut = bl.shard_cuts(h, 1 << log)
    to = [s for s in range(1 << log) if cut[s + 1] > cut[s]]
    return pa.table({"shard": pa.array(to, pa.int32()), "payload": pa.array(
        [bl.pack(bl.gaps(h[cut[s]:cut[s + 1]]), whole[cut[s]:cut[s + 1]], most[cut[s]:cut[s + 1]]) for s in to], pa.binary())})


def _model_arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts = [bl.unpack(x.as_py()) for x in table.column("payload")]
    return (np.concatenate([np.zeros(0, np.uint64), *(bl.ungaps(p[0]) for p in parts)]), np.concatenate([np.zeros(0), *(p[1] / SCALE for p in parts)]))


def _model_levels(table: pa.Table) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint8), *(bl.unpack(x.as_py())[2] for x in table.column("payload"))])


def _frequent(model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and weights of the n-grams of the highest counts, ``FREQUENT`` at most."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.bincount(_model_levels(pa.Table.from_batches([batch])), minlength=256)
            yield pa.RecordBatch.from_pydict({"level": pa.array(np.flatnonzero(n), pa.int32()), "n": pa.array(n[n > 0].astype(np.int64))})

    n = np.zeros(256, np.int64)
    for r in model.mapInArrow(count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():       # 256 rows at most
        n[r["level"]] = r["n"]
    least = 256 - int((np.cumsum(n[::-1]) <= FREQUENT).sum())

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = pa.Table.from_batches([batch.slice(i, 1)])
                h, weight = _model_arrays(one)
                some = _model_levels(one) >= least
                yield pa.RecordBatch.from_pydict({"shard": batch.column("shard").slice(i, 1),
                                                  "payload": pa.array([bl.pack(h[some], weight[some])], pa.binary())})

    found = {r["shard"]: bl.unpack(bytes(r["payload"])) for r in model.mapInArrow(pick, "shard int, payload binary").toLocalIterator()}
    parts = [found[k] for k in sorted(found)]                                                       # shards are ranges of hashes
    return (np.concatenate([np.zeros(0, np.uint64), *(p[0] for p in parts)]), np.concatenate([np.zeros(0), *(p[1] for p in parts)]))


def _bits(model: DataFrame, log: int = SHARDS_LOG) -> np.ndarray:
    """A table of 2**BITS_LOG bits with the leading bits of each n-gram's hash set."""
    size = 1 << (BITS_LOG - log)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, _ = _model_arrays(pa.Table.from_batches([batch.slice(i, 1)]))
                bits = np.zeros(size, bool)
                bits[(h >> np.uint64(64 - BITS_LOG)).astype(np.int64) % size] = True
                yield pa.RecordBatch.from_pydict({"shard": batch.column("shard").slice(i, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    out = np.zeros((1 << BITS_LOG) // 8, np.uint8)
    for r in model.mapInArrow(run, "shard int, bits binary").toLocalIterator():                   # a row a shard
        out[r["shard"] * size // 8:][:size // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def log_probabilities(docs: DataFrame, model: DataFrame, table: Broadcast, copies: int, log: int = SHARDS_LOG,
                      frequent: Broadcast | None = None) -> DataFrame:
    """``key, n_tokens, weight`` (summed) of every row of ``docs(key, lang, text)``; table: the model's bits;
    copies of the model, between which the runs of documents are dealt; log: its shards as a power of two;
    frequent: what ``_frequent`` gives, so that these n-grams are not sent."""
    shards = 1 << log

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        common, its = frequent.value if frequent else (np.zeros(0, np.uint64), np.zeros(0))
        for batch in batches:
            buf, off = bl.text_bytes(batch.column("text"))
            keys, langs = batch.column("key").to_numpy(), _langs(batch)
            for lo, hi in bl.doc_runs(off, SEND_BYTES):
                parts, own = [], np.zeros(hi - lo)
                for a, b in bl.doc_runs(off[lo:hi + 1], RUN_BYTES):
                    word, doc, pair, second = _grams(batch, lo + a, lo + b, buf, off, langs)
                    for h, d in ((word, doc), (pair, doc[second])):
                        place = (h >> np.uint64(64 - BITS_LOG)).astype(np.int64)
                        known = np.flatnonzero(bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1)
                        h, d = h[known], (d[known] + a).astype(np.int32)
                        if len(common):
                            at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                            is_common = common[at] == h
                            own += np.bincount(d[is_common], weights=its[at[is_common]], minlength=len(own))
                            h, d = h[~is_common], d[~is_common]
                        parts.append((h, d))
                h, d = (np.concatenate(x) for x in zip(*parts))
                parts.clear()                                                # a worker holds each n-gram once or twice
                order = np.argsort(h, kind="stable")
                h, d = h[order], d[order]
                del order
                new = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
                ends = np.append(new, len(h))
                u, n = h[new], np.diff(ends)
                first, d = d[new], bl.gaps(d)                                # documents ascend within an n-gram
                d[new] = first
                cut = bl.shard_cuts(u, shards)
                to, out = [], []
                for s in range(shards):
                    a, b = cut[s], cut[s + 1]
                    if b > a:
                        to.append(s)
                        out.append(bl.pack(bl.gaps(u[a:b]), bl.smallest(n[a:b]), bl.smallest(d[ends[a]:ends[b]]), keys[lo:hi], own))
                        own = own[:0]                                        # sent once
                if own.any():
                    to, out = [0], [bl.pack(u, n, d, keys[lo:hi], own)]
                part = int(bl.mix(keys[lo:lo + 1].view(np.uint64))[0] % np.uint64(copies))
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(to), pa.int32()), "shard": pa.array(to, pa.int32()),
                                                  "payload": pa.array(out, pa.binary())})

    def join(asked: pa.Table, known: pa.Table) -> pa.Table:
        h, weight = _model_arrays(known)                                     # sorted, in one payload
        key, total = [np.zeros(0, np.int64)], [np.zeros(0)]
        for value in asked.column("payload"):
            gap, n, d, keys, own = bl.unpack(value.as_py())
            u, n, d = bl.ungaps(gap), n.astype(np.int64), d.astype(np.int64)
            begin, d = np.cumsum(n) - n, np.cumsum(d)
            d -= np.repeat(np.append(0, d)[begin], n)
            at = np.minimum(np.searchsorted(h, u), max(len(h) - 1, 0))
            x = np.where(h[at] == u, weight[at], 0.0) if len(h) else np.zeros(len(u))
            key.append(keys)
            total.append(np.bincount(d, weights=np.repeat(x, n), minlength=len(keys)))
            if len(own):
                total[-1] = total[-1] + own
        keys, which = np.unique(np.concatenate(key), return_inverse=True)    # parts of one document in this shard
        return pa.table({"key": pa.array(keys), "weight": pa.array(np.bincount(which, weights=np.concatenate(total), minlength=len(keys)).astype(float))})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = bl.text_bytes(batch.column("text"))
            n = [np.zeros(0, np.int64)]
            for lo, hi in bl.doc_runs(off):
                n.append(np.diff(bl.word_bounds(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], bl.SPACED)[2]) + 1)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.concatenate(n))], names=["key", "n_tokens"])

    asked = _texts(docs).mapInArrow(ask, "part int, shard int, payload binary")
    told = model.select(F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("part"), "shard", "payload")
    sums = (asked.groupBy("part", "shard").cogroup(told.groupBy("part", "shard")).applyInArrow(join, "key long, weight double"))
    tokens = docs.select("key", "text").mapInArrow(count, "key long, n_tokens long")
    parts = (sums.select("key", "weight", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("copies"))
             .unionByName(tokens.select("key", F.lit(0.0).alias("weight"), "n_tokens", F.lit(1).cast("long").alias("copies"))))
    # rows that repeat share a key and were summed together
    return (parts.groupBy("key").agg(F.sum("weight").alias("weight"), F.sum("n_tokens").alias("n_tokens"), F.sum("copies").alias("copies"))
            .select("key", (F.col("weight") / F.col("copies")).alias("weight"), (F.col("n_tokens") / F.col("copies")).cast("long").alias("n_tokens")))


def judge(docs: DataFrame, labels: DataFrame, max_train: int | None = None, quantile: float = 0.99, margin: float = 1.5, min_tokens: int = 12,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``key, doc_id, lang, n_tokens, log10_prob, perplexity, threshold, keep`` of every row."""
    docs = docs.select(F.xxhash64(F.col(id_col), F.col(text_col), F.col(lang_col)).alias("key"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    good = (labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 and t = 0").select("doc_id"))
    per_lang = docs.select("doc_id", "lang").join(good, "doc_id", "left_semi").groupBy("lang").count().filter("lang is not null")
    share = {r["lang"]: min(TRAIN_SHARE, max_train / r["count"]) if max_train else TRAIN_SHARE for r in per_lang.collect()}      # a row a language
    spark = docs.sparkSession
    share = spark.createDataFrame([(k, v) for k, v in share.items()], "lang string, share double")
    chosen = (docs.select("key", "doc_id", "lang").join(good, "doc_id", "left_semi").join(F.broadcast(share), "lang")
              .withColumn("trains", F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)))
    chosen = cut_lineage(chosen.select("key", "trains").distinct())
    trusted = only_keys(docs.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), chosen.filter("trains").select("key"))
    model, unknown = train(trusted)
    log = shards_log(text_size(trusted))
    unknown = spark.createDataFrame(list(unknown.items()), "lang_hash long, unknown double")       # a row a language
    table = spark.sparkContext.broadcast(_bits(model, log))                                             # 2**BITS_LOG bits
    copies = max(1, -(-bl.extent(docs, "text")[1] // (PART_BYTES << (log - SHARDS_LOG))))
    frequent = spark.sparkContext.broadcast(_frequent(model))                                           # FREQUENT n-grams
    sums = log_probabilities(docs, model, table, copies, log, frequent)
    scored = (docs.select("key", "doc_id", "lang").join(sums, "key")
              .withColumn("lang_hash", F.xxhash64(F.coalesce("lang", F.lit("")))).join(F.broadcast(unknown), "lang_hash", "left")
              .withColumn("log10_prob", F.col("weight") + F.col("n_tokens") * F.col("unknown"))
              .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("n_tokens"))))
    scored = cut_lineage(scored.join(chosen, "key", "left").select("key", "doc_id", "lang", "n_tokens", "log10_prob", "perplexity", "trains"))
    frequent.destroy()
    table.destroy()                                                                                # what used it is written
    cuts = (scored.filter("trains is not null").groupBy("lang").agg(
        F.expr(f"percentile_approx(perplexity, {quantile}, 10000) filter (where not trains)").alias("apart"),
        F.expr(f"percentile_approx(perplexity, {quantile}, 10000)").alias("all"))
        .select("lang", (F.coalesce("apart", "all") * margin).alias("threshold")))
    return (scored.join(F.broadcast(cuts), "lang", "left")                                         # a row a language
            .withColumn("keep", F.coalesce((F.col("n_tokens") < min_tokens) | (F.col("perplexity") <= F.col("threshold")), F.lit(True)))
            .select("key", "doc_id", "lang", "n_tokens", "log10_prob", "perplexity", "threshold", "keep"))
