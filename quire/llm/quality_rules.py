"""Quality rules with thresholds that follow each language and source.

Every document is measured once over its whole text.  Some figures have fixed limits (``base_failed``: fewer than 10 words, or
more than a fifth of the words in repeated 5-word windows).  The others get their limits from the documents themselves:

1. Each (language, source) has a mergeable quantile sketch of each rule's figure: counts of documents in buckets of whole
   numbers, exact below 256 and of 128 buckets a doubling above, so a value is known within 1/128.  Building one is a count
   by bucket, merging is a sum, so partial sketches are combined before the shuffle and a source of a third of all rows is a
   few thousand counts a partition.  The same documents give the same sketch however they are dealt.
2. Sketches of the sources merge to their language's, those to that of all.  A source of fewer than ``least_docs`` documents
   takes the limits of its language, such a language those of all.
3. A limit is the quartile plus or minus ``reach`` times the distance of the quartiles, and the rule's ``slack`` at least,
   so that a source of even documents does not lose its ordinary variety.
4. The limits are joined to the measured documents (narrow rows, no texts) on (language, source), and a document that
   any rule fails is not kept.  The join has one row a source on one side; Spark broadcasts it if its size allows, and splits
   the keys of hot sources otherwise.

Defined cases: a null or empty text has no words, so it fails; null languages and sources are a language and a source of their
own; rows that repeat are measured and counted each; documents without words are in no sketch; an empty table has no limits;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import blocks as bl
from quire.session import cut_lineage

WINDOW = 5
#: fixed values of the contract: characters that count as symbols, words a text needs, and repeated words in a hundred
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEATED_PERCENT = 10, 20

EXACT_BITS = 8            # values of as many bits are their own bucket


@dataclass(frozen=True)
class Rule:
    """A figure (whole number of thousandths), the least distance of its limits from the quartiles, whether small values
    fail too, and the words a text needs to be judged by it."""

    name: str
    over: str             # figure = 1000 * over / under
    under: str
    slack: int
    two_sided: bool = False
    least_words: int = 0


RULES = (Rule("word_length", "word_chars", "n_words", 1500, two_sided=True, least_words=50),
         Rule("symbols", "n_symbols", "n_words", 250),
         Rule("same_lines", "n_dup_lines", "n_lines", 400),
         Rule("repetition", "n_repeat_words", "n_words", 150))

_MEASURED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags))[off])


def figures(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The figures of ``_MEASURED`` of each text."""
    n = len(off) - 1
    is_word = bl.SPACED[buf]
    starts, ends, at = bl.word_bounds(buf, off, bl.SPACED)
    n_words = np.diff(at)
    word_chars = _per_doc(is_word & ((buf & 0xC0) != 0x80), off)
    n_symbols = _per_doc(np.isin(buf, np.frombuffer(SYMBOLS.encode(), np.uint8)), off)

    breaks = np.flatnonzero(buf == 10)
    line_start = np.sort(np.concatenate([off[:-1], breaks + 1]))
    line_end = np.sort(np.concatenate([breaks, off[1:]]))
    line_doc = np.repeat(np.arange(n), 1 + _per_doc(buf == 10, off))
    sums = np.append(0, np.cumsum(is_word))
    worded = sums[line_end] > sums[line_start]
    n_lines = np.bincount(line_doc[worded], minlength=n)
    line = bl.combine(bl.span_hashes(buf, line_start[worded], line_end[worded]), line_doc[worded].astype(np.uint64))
    first = np.unique(line, return_index=True)[1]
    n_dup_lines = n_lines - np.bincount(line_doc[worded][first], minlength=n)

    h = bl.span_hashes(buf, starts, ends)
    windows = np.maximum(0, n_words - WINDOW + 1)
    doc = np.repeat(np.arange(n), windows)
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + at[:-1][doc]
    key = bl.combine(doc.astype(np.uint64), *(h[begin + j] for j in range(WINDOW)))
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    again = begin[count[which] > 1] if len(doc) else begin
    change = np.bincount(again, minlength=len(h) + WINDOW + 1) - np.bincount(again + WINDOW, minlength=len(h) + WINDOW + 1)
    n_repeat_words = _per_doc(np.cumsum(change)[:len(h)] > 0, at)
    return [n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``doc_id``, ``lang_key`` and ``source_key`` (never null), the figures of ``_MEASURED`` and ``base_failed`` of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(
        F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(k) for c, k in ((lang_col, "lang_key"), (source_col, "source_key"))),
        F.col(text_col).alias("text"))

    def work(batches):
        for batch in batches:
            buf, off = bl.text_bytes(batch.column("text"))
            for lo, hi in bl.doc_runs(off):
                found = figures(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "lang_key", "source_key")),
                                                  *(pa.array(x.astype(np.int64)) for x in found)], names=["doc_id", "lang_key", "source_key", *_MEASURED])

    out = rows.mapInArrow(work, "doc_id long, lang_key string, source_key string, " + ", ".join(f"{c} long" for c in _MEASURED))
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words")))


def figure(rule: Rule) -> Column:
    """Null where the rule does not judge the document."""
    return F.when((F.col(rule.under) > 0) & (F.col("n_words") >= rule.least_words), F.expr(f"1000 * {rule.over} div {rule.under}"))


def sketch(measured: DataFrame) -> DataFrame:
    """One row a bucket of each (lang_key, source_key, rule): its least and greatest value, and how many documents it holds."""
    each = measured.select("lang_key", "source_key", F.explode(F.array(*(
        F.struct(F.lit(r.name).alias("rule"), figure(r).alias("value")) for r in RULES))).alias("x"))
    each = each.select("lang_key", "source_key", "x.rule", "x.value").filter("value is not null")
    each = each.withColumn("shift", F.greatest(F.length(F.bin("value")) - EXACT_BITS, F.lit(0)))
    low = F.expr("shiftleft(shiftright(value, shift), shift)")
    return (each.groupBy("lang_key", "source_key", "rule", low.alias("low"), F.expr("shiftleft(1L, shift)").alias("width"))
            .agg(F.count(F.lit(1)).alias("n")).select("lang_key", "source_key", "rule", "low", (F.col("low") + F.col("width") - 1).alias("high"), "n"))


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """The sketches of several groups as one each of ``keys``."""
    return sketches.groupBy(*keys, "rule", "low", "high").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, *keys: str) -> DataFrame:
    """``docs``, ``q1`` and ``q3`` of each group's and rule's sketch.  A group's buckets are bounded by the sketch."""
    by = ", ".join(("rule", *keys))
    seen = sketches.withColumn("upto", F.expr(f"sum(n) over (partition by {by} order by low)")).withColumn("docs", F.expr(f"sum(n) over (partition by {by})"))
    return seen.groupBy(*keys, "rule", "docs").agg(F.min(F.when(F.expr("4 * upto >= docs"), F.col("low"))).alias("q1"),
                                                   F.min(F.when(F.expr("4 * upto >= 3 * docs"), F.col("high"))).alias("q3"))


def limits(sketches: DataFrame, least_docs: int = 200, reach: int = 8) -> DataFrame:
    """``lang_key, source_key`` and for every rule ``<rule>_low`` and ``<rule>_high``."""
    langs = cut_lineage(merged(sketches, "lang_key"))
    source = quartiles(sketches, "lang_key", "source_key")
    lang = quartiles(langs, "lang_key").select("lang_key", "rule", *(F.col(c).alias(f"lang_{c}") for c in ("docs", "q1", "q3")))
    every = quartiles(merged(langs)).select("rule", *(F.col(c).alias(f"all_{c}") for c in ("q1", "q3")))
    found = source.join(lang, ["lang_key", "rule"]).join(every, "rule")

    def chosen(c: str) -> Column:
        return F.when(F.col("docs") >= least_docs, F.col(c)).when(F.col("lang_docs") >= least_docs, F.col(f"lang_{c}")).otherwise(F.col(f"all_{c}"))

    slack = F.coalesce(*(F.when(F.col("rule") == r.name, F.lit(r.slack)) for r in RULES))
    found = found.select("lang_key", "source_key", "rule", chosen("q1").alias("q1"), chosen("q3").alias("q3"))
    away = F.greatest(reach * (F.col("q3") - F.col("q1")), slack)
    found = found.select("lang_key", "source_key", "rule", (F.col("q1") - away).alias("low"), (F.col("q3") + away).alias("high"))
    return found.groupBy("lang_key", "source_key").agg(*(
        F.max(F.when(F.col("rule") == r.name, F.col(end))).alias(f"{r.name}_{end}") for r in RULES for end in ("low", "high")))


def judge(docs: DataFrame, least_docs: int = 200, reach: int = 8, **columns: str) -> DataFrame:
    """``doc_id``, the figures, ``base_failed``, ``failed`` (names of the adaptive rules that a document fails) and ``kept``."""
    measured = cut_lineage(measure(docs, **columns))
    bounds = cut_lineage(limits(cut_lineage(sketch(measured)), least_docs, reach))
    joined = measured.join(bounds, ["lang_key", "source_key"], "left")

    def fails(rule: Rule) -> Column:
        out = figure(rule) > F.col(f"{rule.name}_high")
        return out | (figure(rule) < F.col(f"{rule.name}_low")) if rule.two_sided else out

    failed = F.array_compact(F.array(*(F.when(fails(r), F.lit(r.name)) for r in RULES)))
    return (joined.withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
            .select("doc_id", *_MEASURED, "base_failed", "failed", "kept"))
