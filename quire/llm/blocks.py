"""Shared parts: whole-text tokens as numpy arrays, and the sharded count exchange.

Texts reach Python as Arrow buffers and are cut into words by byte class, so no
Python code runs per word.  A word or n-gram is known by a 64-bit hash.

The exchange: documents are dealt to ``block`` groups by a hash of their key.
A block asks for its distinct hashes, one sorted payload per ``shard`` (a range
of hash values); a shard answers every block in the order of the request; a
block that is computed again (lost executor) forms the same sorted request, so
answers always fit.  A hash occurs once per block at most, however hot it is.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 6 << 20      # text bytes of one block, about
CHUNK_BYTES = 1 << 20      # text bytes handled at once inside a task (a longer text alone)

_MULT = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _inverse(x: int) -> int:
    """Inverse of an odd number modulo 2**64."""
    y = x
    for _ in range(6):
        y = y * (2 - x * y) % (1 << 64)
    return y


_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: words ``[^\x20\x09-\x0D]+``
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's and its inverse's powers 0..n-1 (kept for the next call while small)."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    out = []
    for base in (_MULT, _inverse(_MULT)):
        x = np.full(n, base, dtype=np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    if n <= 8 << 20:
        _powers[:] = out
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of each 64-bit value (a bijection)."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the n+1 offsets into them; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, off, data = col.buffers()
    off = np.frombuffer(off, kind)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]: off[-1]], off - off[0]


def doc_runs(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive documents lo..hi of about ``limit`` bytes together, one at least."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def word_bounds(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the n+1 word offsets of the documents."""
    w = is_word[buf]
    first = w.copy()
    first[1:] &= ~w[:-1]
    cuts = off[1:-1][off[1:-1] < len(buf)]
    first[cuts] = w[cuts]                      # a document starts its own word
    last = w.copy()
    last[:-1] &= ~w[1:]
    ends = cuts[cuts > 0] - 1
    last[ends] = w[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (by prefix sums of a polynomial in the byte values)."""
    p, q = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * p[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * q[starts])


def word_hashes(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) and the n+1 word offsets of the documents."""
    buf = LOWER[buf]
    starts, ends, at = word_bounds(buf, off, is_word)
    return span_hashes(buf, starts, ends), at


def all_word_hashes(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same over many documents, a small run of them at a time."""
    words, at = [], [np.zeros(1, np.int64)]
    for lo, hi in doc_runs(off):
        h, a = word_hashes(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], is_word)
        words.append(h)
        at.append(a[1:] + at[-1][-1])
    return np.concatenate(words) if words else np.zeros(0, np.uint64), np.concatenate(at)


def combine(*parts: np.ndarray) -> np.ndarray:
    """Hash of a sequence of hashes, place by place."""
    out = np.zeros(len(parts[0]), dtype=np.uint64)
    for x in parts:
        out = mix(out * _U(0x100000001B3) + x)
    return out


def window_hashes(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words inside a document (all its words as one if they are
    fewer), and the document number of each."""
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), count)
    if not len(doc):
        return np.zeros(0, np.uint64), doc
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[:-1], count)
    out = np.zeros(len(doc), dtype=np.uint64)
    size = np.minimum(n, k)[doc]
    for j in range(k):
        here = size > j
        x = h[np.minimum(begin + j, len(h) - 1)]
        if here.all():
            out = mix(out * _U(0x100000001B3) + x)
        else:
            out[here] = mix(out[here] * _U(0x100000001B3) + x[here])
    return out, doc


# ---------------------------------------------------------------- payloads

def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value: bytes of equal rank lie together."""
    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)))
        body.append(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack(value: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    (k,), at, out = struct.unpack_from("<B", raw), 1, []
    kinds = []
    for _ in range(k):
        kind, n = struct.unpack_from("<2sQ", raw, at)
        kinds.append((np.dtype("<" + kind.decode()), n))
        at += 10
    for kind, n in kinds:
        size = n * kind.itemsize
        x = np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n).T
        out.append(np.ascontiguousarray(x).view(kind).reshape(n) if n else np.zeros(0, kind))
        at += size
    return out


def smallest(a: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest unsigned type."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def gaps(sorted_values: np.ndarray) -> np.ndarray:
    out = sorted_values.copy()
    out[1:] -= sorted_values[:-1]
    return out


def ungaps(g: np.ndarray) -> np.ndarray:
    return np.cumsum(g, dtype=np.uint64)


def shard_cuts(sorted_hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each of the shards (equal ranges of hash values) begins; shards+1 places."""
    edges = np.array([(s << 64) // shards for s in range(shards)], dtype=np.uint64)
    return np.append(np.searchsorted(sorted_hashes, edges), len(sorted_hashes))


# ---------------------------------------------------------------- sizes, keys, groups

def extent(df: DataFrame, column: str) -> tuple[int, int]:
    """Rows, and bytes of a string column (one pass, two numbers)."""
    x = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(column)).cast("long")).alias("b")).first()
    return int(x["n"]), int(x["b"] or 0)


def group_count(spark: SparkSession, total_bytes: int, each: int = BLOCK_BYTES) -> int:
    return max(1, -(-total_bytes // each), min(32, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key`` (hash of id and text; equal for repeated rows), ``doc_id`` and ``text``."""
    return docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"),
                       F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def blocked(docs: DataFrame, blocks: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return keyed(docs, id_col, text_col).select(
        F.pmod(F.hash("key"), F.lit(blocks)).alias("block"), "key", "doc_id", "text")


def requests(block: int, hashes: np.ndarray, shards: int, *extra: np.ndarray, base: int = 0) -> pa.Table:
    """One payload per shard (base, base + 1, ...) of a block's sorted distinct hashes and the columns
    that belong to them."""
    cut = shard_cuts(hashes, shards)
    to, out = [], []
    for s in range(shards):
        a, b = cut[s], cut[s + 1]
        if b > a:
            to.append(base + s)
            out.append(pack(gaps(hashes[a:b]), *(smallest(e[a:b]) for e in extra)))
    return pa.table({"shard": pa.array(to, pa.int32()), "block": pa.array([block] * len(to), pa.int32()),
                     "payload": pa.array(out, pa.binary())})


REQUEST = "shard int, block int, payload binary"


def answer_all(table: pa.Table, answer: Callable) -> pa.Table:
    """A shard's answers: ``answer(group, n, first, extras)`` gets, for every requested hash, the number
    of its distinct hash (of n), whether its block is the lowest that asks for it, and the columns that
    came with it; it returns a number for every requested hash."""
    blocks = table.column("block").to_numpy()
    order = np.argsort(blocks, kind="stable")
    payloads = table.column("payload").to_pylist()
    parts = [unpack(payloads[i]) for i in order]
    sizes = np.array([len(p[0]) for p in parts])
    hashes = np.concatenate([ungaps(p[0]) for p in parts])
    extras = [np.concatenate([p[i].astype(np.int64) for p in parts]) for i in range(1, len(parts[0]))]
    by = np.argsort(hashes, kind="stable")
    s = hashes[by]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    group = np.empty(len(s), dtype=np.int64)
    group[by] = np.cumsum(new) - 1
    first = np.zeros(len(s), dtype=bool)
    first[by[new]] = True
    out = answer(group, int(new.sum()), first, extras)
    cut = np.append(0, np.cumsum(sizes))
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()] * len(parts), pa.int32()),
                     "block": pa.array(blocks[order], pa.int32()),
                     "payload": pa.array([pack(smallest(out[cut[i]:cut[i + 1]])) for i in range(len(parts))], pa.binary())})


def answers_of(table: pa.Table, low: int = 0, high: int = 1 << 30) -> np.ndarray:
    """A block's answers, from the shards low..high, in the order of its sorted distinct hashes."""
    rows = sorted(zip(table.column("shard").to_pylist(), table.column("payload").to_pylist()))
    parts = [unpack(x)[0].astype(np.int64) for shard, x in rows if low <= shard < high]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def total_counts(group: np.ndarray, n: int, first: np.ndarray, extras: list[np.ndarray]) -> np.ndarray:
    """Answer: twice the sum of the requested counts of each hash, and one more in the block that
    counts the hash as distinct (the lowest that asks for it)."""
    total = np.bincount(group, weights=extras[0], minlength=n).astype(np.int64)[group]
    return total * 2 + first


# ---------------------------------------------------------------- the exchange

FAN = 4096                 # payloads that a block sends at most: of a kilobyte or so each
BUNDLE = "range long, gang long, shard array<int>, block array<int>, payload array<binary>"


def exchange_levels(shards: int) -> int:
    """Hops from a block to its shards, so that nobody sends more than ``FAN`` rows: ``FAN ** levels`` shards are reached."""
    levels = 1
    while FAN ** levels < shards:
        levels += 1
    return levels


def bundle(table: pa.Table, ranges: int, gangs: int) -> pa.Table:
    """Payloads that go the same way, as one row: to a range of ``ranges`` shards, for a gang of ``gangs`` blocks."""
    shard, block = (table.column(c).to_numpy().astype(np.int64) for c in ("shard", "block"))
    order = np.lexsort((block, shard, block // gangs, shard // ranges))
    r, g = shard[order] // ranges, block[order] // gangs
    at = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (g[1:] != g[:-1]))) if len(order) else np.zeros(0, np.int64)
    ends = pa.array(np.append(at, len(order)), pa.int32())
    rows = table.take(pa.array(order)).combine_chunks()
    lists = {c: pa.ListArray.from_arrays(ends, pa.concat_arrays([pa.array([], t), *rows.column(c).chunks]))
             for c, t in (("shard", pa.int32()), ("block", pa.int32()), ("payload", pa.binary()))}
    return pa.table({"range": pa.array(r[at], pa.int64()), "gang": pa.array(g[at], pa.int64()), **lists})


def unbundle(table: pa.Table) -> pa.Table:
    """The single payloads again."""
    return pa.table({c: pa.concat_arrays([pa.array([], t), *(x.flatten() for x in table.column(c).chunks)])
                     for c, t in (("shard", pa.int32()), ("block", pa.int32()), ("payload", pa.binary()))})


class Exchange:
    """Payloads from blocks to shards, and the answers back, along a tree of at most ``FAN`` branches.

    With more than ``FAN`` shards a row for every block and shard would grow with the square of the input.  So a block
    sends one bundle to each of ``fan`` ranges of shards; the task of a range and a gang of ``fan`` blocks regroups them
    by smaller ranges, and so on, with gangs of ``fan ** k`` blocks at hop k.  Every such task holds about a block's
    bytes and sends ``fan`` rows: rows and bytes of a hop are in proportion to the blocks.  Answers go the same way back.
    Up to ``FAN`` shards there is one hop and no bundle; every further hop moves the same bytes once more."""

    def __init__(self, shards: int):
        self.levels = exchange_levels(shards)
        self.fan = 1                                      # equal branches, or a gang would be more blocks than a range's share
        while self.fan ** self.levels < shards:
            self.fan += 1
        self.schema = REQUEST if self.levels == 1 else BUNDLE
        self.key = "block" if self.levels == 1 else "gang"

    def send(self, table: pa.Table) -> pa.Table:
        """What a block hands over for its payloads."""
        return table if self.levels == 1 else bundle(table, self.fan ** (self.levels - 1), self.fan)

    def answered(self, sent: DataFrame, answer: Callable) -> DataFrame:
        """``answer(payloads of a shard)`` on the way back; ``self.key`` names a row's block."""
        fan, top = self.fan, self.levels
        if top == 1:
            return sent.groupBy("shard").applyInArrow(lambda key, rows: answer(rows), REQUEST)

        def hop(rows: DataFrame, ranges: int, gangs: int) -> DataFrame:
            return rows.groupBy("range", "gang").applyInArrow(lambda key, t: bundle(unbundle(t), ranges, gangs), BUNDLE)

        for k in range(1, top):
            sent = hop(sent, fan ** (top - 1 - k), fan ** (k + 1))
        told = sent.groupBy("range").applyInArrow(lambda key, t: bundle(answer(unbundle(t)), fan, fan ** (top - 1)), BUNDLE)
        for k in range(top - 1, 0, -1):
            told = hop(told, fan ** (top - k + 1), fan ** (k - 1))
        return told

    def received(self, table: pa.Table) -> pa.Table:
        """A block's answers, as ``answer`` gave them."""
        return table if self.levels == 1 else unbundle(table)


def count_join(blocks: DataFrame, request: Callable, answer: Callable, finish: Callable, schema: str, shards: int) -> DataFrame:
    """``finish(block's rows, its answers)`` for every block.  The rows are dealt to their blocks by one
    shuffle, which both uses share; what else moves are sorted distinct hashes and numbers."""
    ex = Exchange(shards)
    asked = blocks.groupBy("block").applyInArrow(lambda key, rows: ex.send(request(key[0].as_py(), rows)), ex.schema)
    told = ex.answered(asked, lambda rows: answer_all(rows, answer))
    return (blocks.groupBy("block").cogroup(told.groupBy(ex.key))
            .applyInArrow(lambda key, rows, answers: finish(rows, ex.received(answers)), schema))
