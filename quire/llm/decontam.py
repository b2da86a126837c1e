"""Benchmark passages inside documents: a prefix-filtered containment join.

An item's windows are its runs of ``window`` consecutive words (a shorter item is one window).  A
window's tokens are its shingles of ``shingle`` words.  To contain a window a text must contain all
its tokens, so one necessary prefix token is enough: the rarest, by how often the shingle occurs in
the whole corpus.  The first pass counts the benchmark's shingles over all documents; the second
finds the prefix tokens in every whole text and ships each find with the words around it; finds and
windows are joined on the token, position and length bounds drop windows that would begin before or
end after the text, and the rest is compared word by word.

A bit table (at most ``MAX_BITS`` bits, whatever the benchmark's size) keeps other shingles from
being shipped; it never decides a match.

Defined cases: null or wordless texts have no words and no hits; null or wordless items have no
window; an item without id hits but is not listed; rows that repeat an id are judged one by one;
items with equal windows are all listed; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import blocks as bl
from quire.session import cut_lineage

MAX_BITS = 28            # the table has 2**28 bits, 32 MB, at most
SLICE = 1 << 16          # bytes of it in one row
ENTRIES = 64             # windows in one row of the token side
SALTS = 16               # a token's finds are dealt over so many groups


def ngrams(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each word on (meaningless where the document ends before)."""
    n = max(0, len(h) - k + 1)
    return bl.combine(*(h[j: j + n] for j in range(k)))


def room(at: np.ndarray, total: int) -> np.ndarray:
    """Words from each word to the end of its document."""
    return np.repeat(at[1:], np.diff(at)) - np.arange(total)


def windows_of(bench: DataFrame, window: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """One row per token of each item's window: window words, item, token hash, its offset and length."""
    schema = "item string, words string, size int, token long, offset int, length int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = bl.text_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            low = bl.LOWER[buf]
            starts, ends, at = bl.word_bounds(low, off, bl.ALNUM)
            h = bl.span_hashes(low, starts, ends)
            raw = low.tobytes()
            out: list[tuple] = []
            for d in range(len(ids)):
                a, n = int(at[d]), int(at[d + 1] - at[d])
                size = min(n, window)
                k = min(size, shingle)
                seen = set()
                for w in range(a, a + n - size + 1) if n else ():
                    words = " ".join(raw[starts[i]:ends[i]].decode() for i in range(w, w + size))
                    if words not in seen:
                        seen.add(words)
                        tokens = bl.combine(*(h[w + j: w + j + size - k + 1] for j in range(k))).view(np.int64)
                        out += [(ids[d], words, size, int(t), i, k) for i, t in enumerate(tokens)]
                if len(out) > 50_000 or d == len(ids) - 1:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[i] for r in out], t) for i, t in enumerate(
                            (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32()))],
                        names=["item", "words", "size", "token", "offset", "length"])
                    out = []

    return bench.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def bit_table(tokens: DataFrame, count: int) -> tuple[int, np.ndarray]:
    """log2 of the size, and the table with each token's leading bits set."""
    log = max(20, min(MAX_BITS, int(1024 * count).bit_length()))
    place = F.shiftrightunsigned("token", 64 - log)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(SLICE * 8, bool)
        bits[table.column("place").to_numpy() % (SLICE * 8)] = True
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    rows = (tokens.select(place.alias("place")).distinct().withColumn("slice", F.floor(F.col("place") / (SLICE * 8)))
            .groupBy("slice").applyInArrow(run, "slice long, bits binary").collect())     # 2**MAX_BITS bits at most
    out = np.zeros((1 << log) // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(r["bits"], np.uint8)
        out[r["slice"] * SLICE:][: len(part)] = part[: len(out) - r["slice"] * SLICE]
    return log, out


def _found(table: np.ndarray, log: int, hashes: np.ndarray) -> np.ndarray:
    place = (hashes >> np.uint64(64 - log)).astype(np.int64)
    return np.flatnonzero(table[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1)


def contaminated(docs: DataFrame, bench: DataFrame, window: int = 10, shingle: int = 5, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``key, doc_id, n_words, n_hit, items`` (distinct, sorted as strings), ``spans`` of word numbers."""
    spark = docs.sparkSession
    tokens = cut_lineage(windows_of(bench, window, shingle, item_col, item_text_col))
    facts = tokens.agg(F.approx_count_distinct("token").alias("n"), F.collect_set("length").alias("lengths")).first()
    lengths = sorted(facts["lengths"])
    log, bits = bit_table(tokens, facts["n"] or 1)
    shared = spark.sparkContext.broadcast(bits)
    keyed = bl.keyed(docs, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            buf, off = bl.text_bytes(batch.column(0))
            for lo, hi in bl.doc_runs(off):
                h, at = bl.word_hashes(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], bl.ALNUM)
                left = room(at, len(h))
                for k in lengths:
                    grams = ngrams(h, at, k)
                    hit = _found(shared.value, log, grams)
                    held.append(grams[hit[left[hit] >= k]])
        values, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_pydict({"token": pa.array(values.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    often = keyed.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rarest = (tokens.join(often, "token", "left")
              .groupBy("words", "size").agg(
                  F.min(F.struct(F.coalesce("n", F.lit(0)), "token", "offset", "length")).alias("t"),
                  F.collect_set("item").alias("items")))
    prefix = cut_lineage(rarest.select(F.col("t.token").alias("token"), F.col("t.offset").alias("offset"), "words", "size", "items"))
    shared.destroy()                                          # what used it is written
    p_log, p_bits = bit_table(prefix, prefix.select(F.approx_count_distinct("token")).first()[0] or 1)
    wanted = spark.sparkContext.broadcast(p_bits)

    find_schema = "key long, doc_id long, n_words long, token long, at long, before int, around string"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = bl.text_bytes(batch.column("text"))
            keys, ids = batch.column("key").to_numpy(), batch.column("doc_id").to_pylist()
            for lo, hi in bl.doc_runs(off):
                low = bl.LOWER[buf[off[lo]:off[hi]]]
                starts, ends, at = bl.word_bounds(low, off[lo:hi + 1] - off[lo], bl.ALNUM)
                h = bl.span_hashes(low, starts, ends)
                left, raw = room(at, len(h)), low.tobytes()
                rows = [(int(keys[d]), ids[d], int(at[d - lo + 1] - at[d - lo]), None, None, None, None) for d in range(lo, hi)]
                for k in lengths:
                    grams = ngrams(h, at, k)
                    hit = _found(wanted.value, p_log, grams)
                    hit = hit[left[hit] >= k]
                    for p, d in zip(hit.tolist(), (np.searchsorted(at, hit, "right") - 1).tolist()):
                        a, b = max(p - window + k, int(at[d])), min(p + window, int(at[d + 1]))
                        words = " ".join(raw[starts[i]:ends[i]].decode() for i in range(a, b))
                        rows.append((int(keys[lo + d]), ids[lo + d], None, int(grams[p:p + 1].view(np.int64)[0]),
                                     p - int(at[d]), p - a, words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                        (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()))],
                    names=["key", "doc_id", "n_words", "token", "at", "before", "around"])

    finds = cut_lineage(keyed.mapInArrow(find, find_schema))
    wanted.destroy()

    nth = F.row_number().over(Window.partitionBy("token").orderBy("words"))
    side = (prefix.withColumn("chunk", F.floor((nth - 1) / ENTRIES))
            .groupBy("token", "chunk").agg(F.collect_list(F.struct("words", "offset", "size", "items")).alias("windows"))
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    joined = (finds.filter("token is not null")
              .withColumn("salt", F.pmod(F.hash("key"), F.lit(SALTS)))
              .join(side, ["token", "salt"]).select("key", "at", "before", "around", "windows"))
    hit_schema = "key long, first array<long>, size array<long>, items array<string>"

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                around = r["around"].split(" ")
                first, size, items = [], [], {}
                for w in r["windows"]:
                    a = r["before"] - w["offset"]
                    # position and length bounds, then the words themselves
                    if a >= 0 and a + w["size"] <= len(around) and " ".join(around[a: a + w["size"]]) == w["words"]:
                        first.append(r["at"] - w["offset"])
                        size.append(w["size"])
                        items.update(dict.fromkeys(w["items"]))
                if first:
                    out.append((r["key"], first, size, list(items)))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)],
                                             names=["key", "first", "size", "items"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, spans = [], []
            for first, size in zip(batch.column("first").to_pylist(), batch.column("size").to_pylist()):
                runs: list[list[int]] = []
                for a, n in sorted(zip(first, size)):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], a + n)
                    else:
                        runs.append([a, a + n])
                hits.append(sum(b - a for a, b in runs))
                spans.append(runs)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(hits, pa.int64()), batch.column("items"),
                                              pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=["key", "n_hit", "items", "spans"])

    hits = (joined.mapInArrow(verify, hit_schema)
            .groupBy("key").agg(F.flatten(F.collect_list("first")).alias("first"), F.flatten(F.collect_list("size")).alias("size"),
                                F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
            .mapInArrow(merge, "key long, n_hit long, items array<string>, spans array<array<long>>"))
    return (finds.filter("n_words is not null").select("key", "doc_id", "n_words").join(hits, "key", "left")
            .select("key", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    F.coalesce("spans", F.array().cast("array<array<bigint>>")).alias("spans")))
