"""Packing token sequences online in bounded space.

Every partition cuts its documents into pieces of at most ``length`` ids and keeps
``open_windows`` windows open.  A piece goes where it fits best (least room left);
when it fits nowhere, the fullest open window is emitted and an empty one takes its
place.  The windows that are still open at the end of a partition are merged, whole,
in groups of ``merge_partitions`` partitions by the same rule over windows, fullest first.

Defined cases: a null or empty text has only the end id; a null id stays null; a
repeated row is packed again; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import blocks as bl
from quire.session import cut_lineage

PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_FIELDS = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
MAX_CACHED_WORDS = 3_000_000    # distinct words whose ids a Python worker keeps
RUN_BYTES = 8 << 20             # text bytes encoded at once
TRAILING = '.,;:!?%&$#*|()"-'   # punctuation that is one piece of its own after letters
_cache: dict[str, WordIds] = {}


class WordIds:
    """Ids of white-space separated words.  This tokenizer lowers case, drops white space and never joins
    across it, so a text's ids are its words' ids; words are told apart by 64-bit hashes and each distinct
    one is encoded once.  A word of letters, or of letters and punctuation after them, is one or two pieces;
    distinct letter runs are encoded many at a time, and parted by the tokens that end a piece."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self):
        self.hashes, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.array([self.end_id], np.uint32)      # place 0 is the end of a document

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _runs(self, runs: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for lo in range(0, len(runs), 20_000):
            some = runs[lo: lo + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(some):                      # one piece each
                raw, at = ids.tobytes(), [0, *(stop * 4).tolist()]
                out.update(zip(some, (raw[a:b] for a, b in zip(at, at[1:]))))
            else:
                out.update(zip(some, self._each(some)))
        return out

    def _ids(self, words: list[str]) -> list[bytes]:
        heads = [w.rstrip(TRAILING) for w in words]
        plain = [h.isalpha() for h in heads]
        runs = self._runs(list({x for p, h, w in zip(plain, heads, words) if p for x in (h, w[len(h):]) if x}))
        rest = iter(self._each([w for w, p in zip(words, plain) if not p]))
        return [(runs[h] + runs[w[len(h):]] if len(h) < len(w) else runs[h]) if p else next(rest)
                for p, h, w in zip(plain, heads, words)]

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids = self._ids(words)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        place = np.searchsorted(self.hashes, hashes)
        self.begin = np.insert(self.begin, place, len(self.flat) + np.cumsum(size) - size)
        self.size = np.insert(self.size, place, size)
        self.hashes = np.insert(self.hashes, place, hashes)
        self.flat = np.append(self.flat, np.frombuffer(b"".join(ids), np.uint32))

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (UTF-8 bytes and their offsets), and the n+1 offsets of the texts in them."""
        n = len(off) - 1
        # a special token's string counts only as it is written
        low = buf if b"<|" in buf.tobytes() else bl.LOWER[buf]
        begin, stop, hashes, count = [], [], [], np.zeros(n, np.int64)
        for lo, hi in bl.doc_runs(off):
            part = low[off[lo]:off[hi]]
            a, b, at = bl.word_bounds(part, off[lo:hi + 1] - off[lo], bl.SPACED)
            begin.append(a + off[lo])
            stop.append(b + off[lo])
            hashes.append(bl.span_hashes(part, a, b))
            count[lo:hi] = np.diff(at)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        u, first, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) > MAX_CACHED_WORDS:
            self.clear()
        at = np.searchsorted(self.hashes, u)
        known = np.zeros(len(u), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == u[inside]
        if not known.all():
            a, b = np.concatenate(begin)[first[~known]], np.concatenate(stop)[first[~known]]
            raw = low.tobytes()
            self._learn(u[~known], [raw[i:j].decode() for i, j in zip(a.tolist(), b.tolist())])
            at = np.searchsorted(self.hashes, u)
        ends = np.cumsum(count + 1) - 1
        inner = np.ones(len(h) + n, bool)
        inner[ends] = False
        size, start = np.ones(len(inner), np.int64), np.zeros(len(inner), np.int64)
        size[inner], start[inner] = self.size[at][which], self.begin[at][which]
        upto = np.cumsum(size)
        out = self.flat[np.repeat(start - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)]
        return out, np.append(0, upto[ends])


def word_ids(path: str, end_id: int) -> WordIds:
    if f"{path}:{end_id}" not in _cache:
        _cache[f"{path}:{end_id}"] = WordIds(path, end_id)
    return _cache[f"{path}:{end_id}"]


class OpenWindows:
    """At most ``most`` windows that still have room, by free space."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.free: list[tuple[int, int]] = []        # (room left, number), ascending
        self.held: dict[int, list] = {}
        self.made = 0

    def place(self, size: int, item) -> list | None:
        """Puts an item into a window; a window that has to go, or is full, is returned."""
        if size >= self.length:
            return [item]
        at, out = bisect.bisect_left(self.free, (size, -1)), None
        if at < len(self.free):
            room, k = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                out = self.held.pop(self.free.pop(0)[1])
            room, k = self.length, self.made
            self.made += 1
            self.held[k] = []
        self.held[k].append(item)
        if room == size:
            return self.held.pop(k)                   # never together with ``out``: a new window is larger
        bisect.insort(self.free, (room - size, k))
        return out

    def rest(self) -> list[list]:
        return [self.held[k] for _, k in self.free]


def _rows(windows: list[tuple[int, list]]) -> dict[str, list]:
    out: dict[str, list] = {f: [] for f in _FIELDS}
    for number, pieces in windows:
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            for f, v in zip(_FIELDS, (doc_id, start, n, ids, total, number, at)):
                out[f].append(v)
            at += n
    return out


def _batch(rows: dict[str, list], **more) -> pa.RecordBatch:
    n = len(rows["doc_id"])
    cols = {f: pa.array(v, pa.binary() if f == "ids" else pa.int64()) for f, v in rows.items()}
    cols |= {k: pa.array([v] * n, pa.int64()) for k, v in more.items()}
    return pa.RecordBatch.from_pydict(cols)


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, open_windows: int = 64,
                   merge_partitions: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its ids (little-endian unsigned 32-bit) and its place."""

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple]:
        ids, (buf, off) = batch.column(0).to_pylist(), bl.text_bytes(batch.column(1))
        for lo, hi in bl.doc_runs(off, RUN_BYTES):
            flat, cut = word_ids(tokenizer, end_id).encode(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
            for i in range(hi - lo):
                a, b = int(cut[i]), int(cut[i + 1])
                for p in range(a, b, length):
                    yield ids[lo + i], p - a, flat[p: min(p + length, b)].tobytes(), b - a

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        windows, done, closed = OpenWindows(length, open_windows), [], 0
        for batch in batches:
            for piece in pieces(batch):
                if full := windows.place(len(piece[2]) // 4, piece):
                    done.append(((part << 32) + closed, full))
                    closed += 1
                    if len(done) >= 500:
                        yield _batch(_rows(done), leftover=-1)
                        done = []
        if done:
            yield _batch(_rows(done), leftover=-1)
        if rest := windows.rest():
            yield _batch(_rows([((part << 32) + closed + i, w) for i, w in enumerate(rest)]), leftover=part // merge_partitions)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        by: dict[int, list] = {}
        rows = table.select(["sequence_id", "offset", "doc_id", "start", "ids", "doc_tokens"]).to_pylist()
        for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
            by.setdefault(r["sequence_id"], []).append((r["doc_id"], r["start"], r["ids"], r["doc_tokens"]))
        sizes = {k: sum(len(p[2]) // 4 for p in w) for k, w in by.items()}
        windows, done = OpenWindows(length, len(by) + 1), []
        for k in sorted(by, key=lambda k: (-sizes[k], k)):
            if full := windows.place(sizes[k], by[k]):
                done.append(full)
        base = (1 << 61) + (int(key[0].as_py()) << 32)
        out = _rows([(base + i, [p for w in ws for p in w]) for i, ws in enumerate(done + windows.rest())])
        return pa.Table.from_batches([_batch(out)])

    placed = cut_lineage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
                         .mapInArrow(online, PIECE + ", leftover long"))
    whole = placed.filter("leftover < 0").drop("leftover")
    return whole.unionByName(placed.filter("leftover >= 0").groupBy("leftover").applyInArrow(merge, PIECE))
