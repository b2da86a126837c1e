"""Periodic runs of words inside a document, and texts without their repetitions.

A run is a stretch of consecutive words with smallest period q, at least ``max(least, 2 q)`` words long, that no neighbouring
word extends with period q.  The method, for each document on its own:

1. Suffixes of the word sequence are sorted by prefix doubling: classes of equal prefixes of 1, 2, 4, ... words, where only
   classes of several suffixes are refined further.  Ordinary prose ends after two or three steps.
2. The longest common prefix (LCP) of neighbouring suffixes is found by descending through the classes of every step.
3. Kruskal by decreasing LCP: each position begins as a class of its own, an ordered set; the edge between two neighbouring
   suffixes unites their classes, the smaller set going into the larger.  Two positions p < q of different sets that become
   neighbours in the united set have exactly that LCP; if q - p is at most the LCP, the words from p have period q - p
   for LCP + q - p words.  That is a run if the word before it does not extend it.
4. Of the periods found for the same stretch the smallest counts.

Every run is found: its start s and s + q share a prefix of (length - q) >= q words, and a position between them with as long
a common prefix would give the stretch a smaller period.  As a run needs an LCP of half its length, edges below ``least / 2``
are left out.  No document is cut; work grows with n log n of its repeated part.  Documents need no exchange at all: a lost
task is computed again from its rows.  Words are compared by 64-bit hashes inside a document.

Defined cases: a null, empty or wordless text has no words, no runs and the empty text; rows that repeat, null ids and other
columns pass through unchanged; an empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.llm import blocks as bl


def suffix_classes(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The places in the order of their suffixes (those whose first word occurs again), and the class of every
    place after each doubling.  ``first``: class of every place's word, one of its document alone; ``end``: where it ends."""
    n = len(first)
    order = np.argsort(first, kind="stable")
    s = first[order]
    head = np.append(True, s[1:] != s[:-1])
    begin = np.flatnonzero(head)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(begin, np.diff(np.append(begin, n)))
    steps, span = [rank], 1
    alone = head & np.append(head[1:], True)
    slots = np.flatnonzero(~alone)                  # where in the order classes of several lie
    while len(slots):
        place = order[slots]
        to = place + span
        follow = np.where(to < end[place], rank[np.minimum(to, n - 1)], -1)
        own = rank[place]
        by = np.lexsort((follow, own))
        place, own, follow = place[by], own[by], follow[by]
        order[slots] = place
        head = np.append(True, (own[1:] != own[:-1]) | (follow[1:] != follow[:-1]))
        begin = np.flatnonzero(head)
        rank = rank.copy()
        rank[place] = np.repeat(slots[begin], np.diff(np.append(begin, len(place))))
        steps.append(rank)
        span *= 2
        alone = head & np.append(head[1:], True)
        slots = slots[~alone]
    return order, steps


def neighbour_prefixes(order: np.ndarray, steps: list[np.ndarray], end: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Neighbouring suffixes that share ``least`` words or more, and how many they share."""
    a, b = order[:-1], order[1:]
    step = min(len(steps) - 1, least.bit_length() - 1)
    same = np.flatnonzero(steps[step][a] == steps[step][b])      # share 2**step words, which is at most ``least``
    a, b = a[same], b[same]
    lcp = np.zeros(len(a), np.int64)
    stop_a, stop_b = end[a], end[b]
    for k in range(len(steps) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        inside = (x < stop_a) & (y < stop_b)
        last = len(end) - 1
        equal = inside & (steps[k][np.minimum(x, last)] == steps[k][np.minimum(y, last)])
        lcp[equal] += 1 << k
    keep = lcp >= least
    return a[keep], b[keep], lcp[keep]


def newly_adjacent(a: np.ndarray, b: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kruskal: pairs p < q that become neighbours when classes unite, at a distance of at most their LCP."""
    by = np.argsort(-lcp, kind="stable")
    places, number = np.unique(np.concatenate([a[by], b[by]]), return_inverse=True)
    of = list(range(len(places)))                   # class of every place
    members: list[list[int]] = [[i] for i in of]    # ordered sets, of place numbers (in the order of places)
    where = places.tolist()
    half = len(by)
    lows, highs, lengths = [], [], []
    for x, y, length in zip(number[:half].tolist(), number[half:].tolist(), lcp[by].tolist()):
        large, small = of[x], of[y]
        into, out = members[large], members[small]
        if len(into) < len(out):
            large, small, into, out = small, large, out, into
        size, last = len(into), len(out) - 1
        before = -1
        for k, i in enumerate(out):
            of[i] = large
            at = bisect_left(into, i)
            here = where[i]
            if at:
                p = into[at - 1]
                if p > before and here - where[p] <= length:
                    lows.append(where[p])
                    highs.append(here)
                    lengths.append(length)
            if at < size:
                q = into[at]
                if (k == last or out[k + 1] > q) and where[q] - here <= length:
                    lows.append(here)
                    highs.append(where[q])
                    lengths.append(length)
            before = i
        if last * 8 > size:
            into += out
            into.sort()
        elif out[0] > into[-1]:
            into += out
        else:
            for i in out:
                insort(into, i)
        members[small] = []
    return np.array(lows, np.int64), np.array(highs, np.int64), np.array(lengths, np.int64)


def runs_of(words: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in the sequence of all words), length and period of every run, by start, then period."""
    none = (np.zeros(0, np.int64),) * 3
    size = np.diff(at)
    if not len(words) or size.max() < least:
        return none
    doc = np.repeat(np.arange(len(size)), size)
    end = np.repeat(at[1:], size)
    _, word = np.unique(words, return_inverse=True)
    order, steps = suffix_classes(doc * (int(word.max()) + 1) + word, end)
    a, b, lcp = neighbour_prefixes(order, steps, end, max(1, -(-least // 2)))
    del steps, order
    if not len(a):
        return none
    p, q, shared = newly_adjacent(a, b, lcp)
    period = q - p
    begins = np.append(at[:-1], -1)[doc[p]] if len(p) else p
    opens = (p == begins) | (words[p - 1] != words[q - 1])       # the word before does not extend it
    length = shared + period
    ok = opens & (length >= np.maximum(least, 2 * period))
    p, length, period = p[ok], length[ok], period[ok]
    by = np.lexsort((period, length, p))
    p, length, period = p[by], length[by], period[by]
    first = np.append(True, (p[1:] != p[:-1]) | (length[1:] != length[:-1])) if len(p) else np.zeros(0, bool)
    p, length, period = p[first], length[first], period[first]
    by = np.lexsort((period, p))
    return p[by], length[by], period[by]


def _collapsed(buf: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, gone: np.ndarray) -> pa.Array:
    """Per document its words but those gone, joined by one space."""
    stay = np.flatnonzero(~gone)
    change = np.zeros(len(buf) + 2, np.int8)
    change[starts[stay]] += 1
    change[ends[stay]] -= 1
    keep = np.cumsum(change[:len(buf)], dtype=np.int8).astype(bool)
    doc = np.searchsorted(at, stay, "right") - 1
    inner = stay[:-1][doc[:-1] == doc[1:]]          # another word of the document follows, so white space does
    keep[ends[inner]] = True
    out = buf.copy()
    out[ends[inner]] = 32
    sums = np.append(0, np.cumsum(keep))
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(sums[off].astype(np.int64)), pa.py_buffer(out[keep])).cast(pa.string())


def _batch(column: pa.Array, least: int) -> Iterator[tuple[int, int, np.ndarray, pa.Array, pa.Array]]:
    buf, off = bl.text_bytes(column)
    for lo, hi in bl.doc_runs(off):
        part, o = buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        starts, ends, at = bl.word_bounds(part, o, bl.SPACED)
        run, length, period = runs_of(bl.span_hashes(part, starts, ends), at, least)
        change = np.bincount(run + period, minlength=len(starts) + 1) - np.bincount(run + length, minlength=len(starts) + 1)
        gone = np.cumsum(change)[:len(starts)] > 0
        doc = np.searchsorted(at, run, "right") - 1
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)), pa.int32()), pa.StructArray.from_arrays(
            [pa.array(run - at[doc]), pa.array(length), pa.array(period)], ["start", "length", "period"]))
        yield lo, hi, np.diff(at), lists, _collapsed(part, o, starts, ends, at, gone)


def find_runs(docs: DataFrame, text_col: str = "text", least: int = 12) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period of each, in words from 0, by start, then period) and
    ``collapsed``: the text without what follows the first period of a run, its words joined by one space.

    ``least``: words of the shortest run."""
    kept = docs.drop("n_words", "runs", "collapsed")
    names = [c for c in kept.columns if c != text_col]

    def work(batches):
        for batch in batches:
            for lo, hi, n, lists, texts in _batch(batch.column(text_col), least):
                old = [batch.column(c).slice(lo, hi - lo) for c in names]
                yield pa.RecordBatch.from_arrays([*old, pa.array(n, pa.int64()), lists, texts], names=[*names, "n_words", "runs", "collapsed"])

    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    out = kept.select(*names).schema.add("n_words", T.LongType()).add("runs", T.ArrayType(run)).add("collapsed", T.StringType())
    return kept.mapInArrow(work, out)
