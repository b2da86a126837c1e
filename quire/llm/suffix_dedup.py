"""Removal of passages that an earlier document already has: sorted suffixes, merged by common prefixes.

A byte goes if a string of ``SPAN`` bytes that covers it also starts in a document with a smaller id.
Only suffixes at anchors are sorted: an anchor is the least hash of ``GRAM`` bytes among those inside some
``SPAN`` bytes, so equal strings hold equal anchors at equal places, and every shared string holds one.

1. Blocks count, shard by shard, the documents that have each anchor's ``GRAM`` bytes; those of a single
   document need nothing more.
2. Each block sorts the others' suffixes (``SPAN`` bytes from the anchor, then the bytes before it, read
   backwards), keeps one of equal ones (the smallest id), and sends each shard a front-coded run: the length
   of the prefix shared with the one before, and the rest.
3. A shard merges its runs by a loser tree that starts every comparison behind the prefix known to be shared.
   From the merged order and its common prefix lengths follow, for each suffix, the matches that reach back
   into smaller ids; the answer is how far they cover to the left and right.
4. Blocks mark covered bytes on the input and cut them out.

A hot passage counts once per block and surrounding, whatever number of documents has it.  The filter in
step 1 is by 64-bit hashes and can only admit too much; matches are compared byte by byte.

Defined cases: a null text is empty; texts under ``SPAN`` bytes keep everything; a null id counts as larger
than all others; rows with one id are no smaller than each other; matches never cross texts; the bytes that
stay are returned as bytes, as a cut may split a character; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm import blocks as bl

SPAN, GRAM = 50, 24
LEFT = SPAN - GRAM                 # bytes before an anchor that a string around it can have
WHOLE = SPAN + LEFT
NO_ID = np.int64((1 << 63) - 1)
NEVER = 0xFF                       # not in UTF-8: stands for bytes beyond a text


def _sliding(x: np.ndarray, size: int, op) -> np.ndarray:
    """op over x[i : i + size], for every i that has room."""
    step, out = 1, x
    while step * 2 <= size:
        out = op(out[:-step], out[step:])
        step *= 2
    return op(out[: len(x) - size + 1], out[size - step: size - step + len(x) - size + 1])


def anchors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors, and their hashes."""
    if len(buf) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, q = bl.powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(bl._BYTE[buf] * p[:-1], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * q[: len(buf) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    for end in off[1:-1]:                                   # grams and strings stay inside their text
        h[max(0, end - GRAM + 1): end] = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = _sliding(h, LEFT + 1, np.minimum)
    for end in off[1:-1]:
        least[max(0, end - SPAN + 1): end] = 0
    room = np.zeros(len(h) + LEFT, np.uint64)               # least[i] covers grams i .. i + LEFT
    room[LEFT: LEFT + len(least)] = least
    best = _sliding(room, LEFT + 1, np.maximum)[: len(h)]
    at = np.flatnonzero(best == h)
    return at, bl.mix(h[at])                                # least hashes are small: spread them for the shards


def surroundings(buf: np.ndarray, off: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: SPAN bytes from it and LEFT before it (backwards), and how many of either exist."""
    doc = np.searchsorted(off, at, "right") - 1
    right = np.minimum(off[doc + 1] - at, SPAN)
    left = np.minimum(at - off[doc], LEFT)
    place = np.concatenate([at[:, None] + np.arange(SPAN), at[:, None] - 1 - np.arange(LEFT)], axis=1)
    out = buf[np.clip(place, 0, max(len(buf) - 1, 0))]
    out[:, :SPAN][np.arange(SPAN) >= right[:, None]] = NEVER
    out[:, SPAN:][np.arange(LEFT) >= left[:, None]] = NEVER
    return out, left, right


def shared_lengths(rows: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the row before (0 for the first)."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def front_code(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared prefix lengths and the remaining bytes of sorted rows."""
    known = shared_lengths(rows)
    return known.astype(np.uint8), rows[np.arange(rows.shape[1]) >= known[:, None]]


def front_decode(known: np.ndarray, rest: np.ndarray) -> list[bytes]:
    raw, at, last, out = rest.tobytes(), 0, b"", []
    for k in known.tolist():
        n = WHOLE - k
        last = last[:k] + raw[at: at + n]
        at += n
        out.append(last)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Loser tree over sorted runs (strings, and the prefix each shares with the one before).  Returns, in
    merged order, the run of each string and the prefix it shares with the string before it."""
    k = len(runs)
    if k == 1:
        return [0] * len(runs[0][0]), list(runs[0][1])
    strings, shares = [r[0] for r in runs], [r[1] for r in runs]
    at, now, known = [0] * k, [s[0] if s else None for s in strings], [0] * k   # known: shared with the last output
    size = [len(s) for s in strings]

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = now[a], now[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        t = known[a]
        if t != known[b]:
            return (a, b) if t > known[b] else (b, a)
        differ = int.from_bytes(x[t:]) ^ int.from_bytes(y[t:])
        if not differ:
            low, high = (a, b) if a < b else (b, a)
            known[high] = WHOLE
            return low, high
        p = WHOLE - (differ.bit_length() + 7) // 8
        if x[p] < y[p]:
            known[b] = p
            return a, b
        known[a] = p
        return b, a

    loser = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, loser[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    top = build(1)
    order, lengths = [], []
    for _ in range(sum(size)):
        order.append(top)
        lengths.append(known[top])
        i = at[top] = at[top] + 1
        if i < size[top]:
            now[top], known[top] = strings[top][i], shares[top][i]
        else:
            now[top] = None
        node = (top + k) >> 1
        while node:
            other = loser[node]
            t, u = known[top], known[other]
            if now[other] is None:
                pass
            elif now[top] is None or t < u:
                loser[node], top = top, other
            elif t == u:
                top, loser[node] = play(top, other)
            node >>= 1
    return order, lengths


def reach(rows: np.ndarray, known: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far to the left and right of its anchor each sorted row is covered by strings of smaller ids."""
    n = len(rows)
    far_l, far_r = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    own_r = (rows[:, :SPAN] != NEVER).sum(axis=1)
    own_l = (rows[:, SPAN:] != NEVER).sum(axis=1)
    begin = np.flatnonzero(np.append(True, known[1:] < WHOLE)) if n else np.zeros(0, np.int64)
    least = np.minimum.reduceat(doc, begin) if n else doc
    of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
    later = doc > least[of]                                   # all of it, as far as the text goes
    far_l[later], far_r[later] = own_l[later], own_r[later]
    # one row for each distinct surrounding, if another surrounding has the same gram
    kept_known = np.where(np.arange(len(begin)) == 0, 0, known[begin])
    same = kept_known >= GRAM
    crowd = same.copy()
    crowd[:-1] |= same[1:]
    pick = np.flatnonzero(crowd)
    if len(pick):
        r, d, kn = rows[begin[pick]], least[pick], kept_known[pick]
        best_l, best_r = np.zeros(len(pick), np.uint8), np.zeros(len(pick), np.uint8)
        ol, orr = own_l[begin[pick]], own_r[begin[pick]]
        left = np.zeros(len(pick), np.uint64)
        for l in range(LEFT + 1):
            right = SPAN - l
            if l:
                left = bl.mix(left * np.uint64(0x100000001B3) + r[:, SPAN + l - 1].astype(np.uint64) + np.uint64(1))
            key = bl.combine(left, np.cumsum(kn < right).astype(np.uint64))   # order of the two matters
            _, which = np.unique(key, return_inverse=True)
            first = np.full(int(which.max()) + 1, NO_ID)
            np.minimum.at(first, which, d)
            hit = (d > first[which]) & (ol >= l) & (orr >= right)
            best_l[hit] = np.maximum(best_l[hit], l)
            best_r[hit] = np.maximum(best_r[hit], right)
        back = np.full(len(begin), -1)
        back[pick] = np.arange(len(pick))
        mine = back[of]
        use = (mine >= 0) & ~later
        far_l[use], far_r[use] = best_l[mine[use]], best_r[mine[use]]
    return far_l, far_r


def remove_repeats(docs: DataFrame, groups: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) of every row."""
    dealt = bl.blocked(docs, groups, id_col, text_col)

    def ordered(rows: pa.Table) -> tuple:
        """The block's texts in the order of their keys, so that every pass numbers them alike."""
        rows = rows.sort_by("key")
        buf, off = bl.text_bytes(rows.column("text"))
        ids = rows.column("doc_id").combine_chunks().fill_null(int(NO_ID)).to_numpy()
        return rows, buf, off, ids

    def found(buf: np.ndarray, off: np.ndarray, wanted: np.ndarray | None = None):
        """Anchors by runs of documents: places in the block, hashes, surroundings."""
        for lo, hi in bl.doc_runs(off):
            part, o = buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
            at, h = anchors(part, o)
            if wanted is not None:
                keep = wanted[np.minimum(np.searchsorted(wanted, h), max(len(wanted) - 1, 0))] == h if len(wanted) else np.zeros(len(h), bool)
                at, h = at[keep], h[keep]
                yield at + off[lo], h, surroundings(part, o, at)[0]
            else:
                yield at + off[lo], h, part, o, at

    def request(block: int, rows: pa.Table) -> pa.Table:
        _, buf, off, _ = ordered(rows)
        hashes, owner = [], []
        for at, h, *_ in found(buf, off):
            hashes.append(h)
            owner.append(np.searchsorted(off, at, "right"))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        d = np.concatenate(owner).astype(np.uint64) if owner else h
        both = np.unique(bl.mix(h * np.uint64(3) + d), return_index=True)[1]
        u, n = np.unique(h[both], return_counts=True)          # documents that have each gram
        return bl.requests(block, u, groups, n)

    def several(group: np.ndarray, n: int, first: np.ndarray, extras: list[np.ndarray]) -> np.ndarray:
        return (np.bincount(group, weights=extras[0], minlength=n) > 1).astype(np.int64)[group]

    def send(rows: pa.Table, answers: pa.Table) -> pa.Table:
        _, buf, off, ids = ordered(rows)
        block = int(rows.column("block")[0].as_py())
        every = np.unique(np.concatenate([x[1] for x in found(buf, off)] or [np.zeros(0, np.uint64)]))
        wanted = every[bl.answers_of(answers) > 0]
        got = list(found(buf, off, wanted))
        at = np.concatenate([g[0] for g in got] or [np.zeros(0, np.int64)])
        h = np.concatenate([g[1] for g in got] or [np.zeros(0, np.uint64)])
        around = np.concatenate([g[2] for g in got] or [np.zeros((0, WHOLE), np.uint8)])
        doc = ids[np.searchsorted(off, at, "right") - 1] if len(at) else np.zeros(0, np.int64)
        shard = np.searchsorted(np.array([(s << 64) // groups for s in range(groups)], np.uint64), h, "right") - 1
        order = np.lexsort((doc, np.ascontiguousarray(around).view(f"S{WHOLE}").ravel(), shard)) if len(at) else np.zeros(0, np.int64)
        at, shard, around, doc = at[order], shard[order], around[order], doc[order]
        new = np.ones(len(at), bool)
        new[1:] = (around[1:] != around[:-1]).any(axis=1) | (shard[1:] != shard[:-1])
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        least = doc[begin]
        later = doc > least[group]                             # a smaller id in this very block
        to, out = [-1 - block], [bl.pack(at, group, later.astype(np.uint8))]
        cut = np.searchsorted(shard[begin], np.arange(groups + 1))
        for s in range(groups):
            a, b = cut[s], cut[s + 1]
            if b > a:
                known, rest = front_code(around[begin[a:b]])
                to.append(s)
                out.append(bl.pack(known, rest, least[a:b]))
        return pa.table({"shard": pa.array(to, pa.int32()), "block": pa.array([block] * len(to), pa.int32()), "payload": pa.array(out, pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        if table.column("shard")[0].as_py() < 0:                                 # a block's own notes come back to it
            return table
        table = table.sort_by("block")
        runs, ids, parts = [], [], []
        for value in table.column("payload").to_pylist():
            known, rest, doc = bl.unpack(value)
            strings = front_decode(known, rest)
            runs.append((strings, known.tolist()))
            ids.append(doc)
            parts.append(np.frombuffer(b"".join(strings), np.uint8).reshape(-1, WHOLE))
        order, known = (np.array(x, np.int64) for x in merge_runs(runs))
        place = np.argsort(order, kind="stable")               # run by run, in the runs' own order
        source = np.empty(len(order), np.int64)
        source[place] = np.arange(len(order))
        del runs
        rows, doc = np.concatenate(parts)[source], np.concatenate(ids)[source]
        del parts
        far_l, far_r = reach(rows, known, doc)
        back_l, back_r = far_l[place], far_r[place]
        cut = np.append(0, np.cumsum([len(i) for i in ids]))
        return pa.table({"shard": table.column("shard"), "block": table.column("block"),
                         "payload": pa.array([bl.pack(back_l[a:b], back_r[a:b]) for a, b in zip(cut[:-1], cut[1:])], pa.binary())})

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows, buf, off, _ = ordered(rows)
        got = sorted(zip(answers.column("shard").to_pylist(), answers.column("payload").to_pylist()))
        at, group, later = bl.unpack(got[0][1])
        reached = [bl.unpack(x) for _, x in got[1:]]
        far_l = np.concatenate([x[0] for x in reached] or [np.zeros(0, np.uint8)]).astype(np.int64)[group]
        far_r = np.concatenate([x[1] for x in reached] or [np.zeros(0, np.uint8)]).astype(np.int64)[group]
        if len(at):
            doc = np.searchsorted(off, at, "right") - 1
            whole = later.astype(bool)
            far_l = np.where(whole, np.minimum(at - off[doc], LEFT), far_l)
            far_r = np.where(whole, np.minimum(off[doc + 1] - at, SPAN), far_r)
        change = np.bincount(at - far_l, minlength=len(buf) + 1)[: len(buf) + 1] - np.bincount(at + far_r, minlength=len(buf) + 1)[: len(buf) + 1]
        gone = np.cumsum(change)[: len(buf)] > 0
        start = gone.copy()
        start[1:] &= ~gone[:-1]
        cuts = off[1:-1][off[1:-1] < len(buf)]
        start[cuts] = gone[cuts]
        removed = np.append(0, np.cumsum(gone))
        spans = np.append(0, np.cumsum(start))
        kept, stay = buf[~gone], off - removed[off]
        return pa.table({"key": rows.column("key"), "doc_id": rows.column("doc_id"), "n_bytes": pa.array(np.diff(off)),
                         "n_removed": pa.array(removed[off[1:]] - removed[off[:-1]]), "n_spans": pa.array(spans[off[1:]] - spans[off[:-1]]),
                         "kept": pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1,
                                                                  [None, pa.py_buffer(stay.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(kept))]).cast(pa.binary())})

    ex = bl.Exchange(groups)
    sent = bl.count_join(dealt, request, several, lambda rows, answers: ex.send(send(rows, answers)), ex.schema, groups)
    told = ex.answered(sent, merge)
    return (dealt.groupBy("block").cogroup(told.groupBy(ex.key))
            .applyInArrow(lambda key, rows, answers: finish(rows, ex.received(answers)),
                          "key long, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))
