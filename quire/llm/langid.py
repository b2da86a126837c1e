"""Language of web pages by fused evidence.

log posterior = log prior of the host + log likelihood of the declared markup language
              + log likelihood of the address's suffix + tempered log likelihood of the text.

* Text: byte trigrams (hashed to ``BUCKETS`` classes) under a naive Bayes model for each language, learned from at
  most about ``max_train`` documents a language with a known language.  Words of a page are not independent, so
  the sum is tempered to at most ``MAX_GRAMS`` grams' worth.
* Markup and suffix: tables of how often each declared language, and each language segment or country suffix of
  an address, goes with each language, counted over all pages by the text posterior and smoothed by the total.
* Host: expected language counts by host, shrunk towards those of the parent domain, those towards the suffix's,
  those towards all pages', each by ``STRENGTH`` pseudo counts.  Grouped sums of four levels, joined back.

Defined cases: a null or empty page has no text evidence and gets what its host and markup say; a null address
has the empty host; with no evidence at all the posterior is the corpus's; rows that repeat count each; unknown
declared languages are evidence like any other value; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import blocks as bl
from quire.llm.html_text import blocks_of
from quire.session import cut_lineage

BUCKETS = 1 << 16
MAX_GRAMS = 40
STRENGTH = 5.0
SMOOTH = 0.1


def gram_buckets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every byte trigram of lower-cased texts."""
    if len(buf) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = bl.LOWER[buf].astype(np.uint32)
    x = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)
    at = np.arange(len(x))
    doc = np.searchsorted(off, at, "right") - 1
    inside = at + 3 <= off[doc + 1]
    return (x >> np.uint32(16)).astype(np.int64)[inside], doc[inside]


def text_model(docs: DataFrame, max_train: int, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities of the buckets (a table of languages x BUCKETS)."""
    docs = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}       # a row a language
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, BUCKETS))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, max_train / sizes[k]))])
    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), BUCKETS), np.int64)
        for batch in batches:
            buf, off = bl.text_bytes(batch.column("text"))
            which = np.array([langs.index(x) for x in batch.column("lang").to_pylist()], np.int64)
            for lo, hi in bl.doc_runs(off):
                gram, doc = gram_buckets(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                total += np.bincount(which[lo + doc] * BUCKETS + gram, minlength=total.size).reshape(total.shape)
        for k in range(len(langs)):
            yield pa.RecordBatch.from_pydict({"k": pa.array([k] * int((total[k] > 0).sum()), pa.int32()),
                                              "bucket": pa.array(np.flatnonzero(total[k])), "n": pa.array(total[k][total[k] > 0])})

    table = np.full((len(langs), BUCKETS), SMOOTH)
    for r in sample.mapInArrow(count, "k int, bucket long, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).collect():
        table[r["k"], r["bucket"]] += r["n"]                                              # languages x BUCKETS cells
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def text_evidence(pages: DataFrame, langs: list[str], model: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``likely``: tempered log likelihoods, and ``n_grams``."""
    shared = pages.sparkSession.sparkContext.broadcast(model.T.astype(np.float32).copy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            texts = [" ".join(b[0] for b in blocks_of(h) if not b[1][3]) if h else "" for h in batch.column("html").to_pylist()]
            buf, off = bl.text_bytes(pa.array(texts, pa.large_string()))
            n = len(texts)
            likely, grams = np.zeros((n, len(langs))), np.zeros(n, np.int64)
            for lo, hi in bl.doc_runs(off):
                gram, doc = gram_buckets(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                grams[lo:hi] = np.bincount(doc, minlength=hi - lo)
                for k in range(len(langs)):
                    likely[lo:hi, k] = np.bincount(doc, weights=weights[gram, k], minlength=hi - lo)
            likely *= (np.minimum(grams, MAX_GRAMS) / np.maximum(grams, 1))[:, None]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(list(likely), pa.list_(pa.float64())), pa.array(grams)],
                                             names=[*keep, "likely", "n_grams"])

    kinds = dict(pages.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", likely array<double>, n_grams long"
    return pages.select(*keep, "html").mapInArrow(run, schema)


def _softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _sums(df: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    """Expected languages of each key."""
    each = [F.sum(F.col("belief")[i]).alias(f"s{i}") for i in range(k)]
    return df.groupBy(*keys).agg(*each).select(*keys, F.array(*[F.col(f"s{i}") for i in range(k)]).alias(name))


def declared_language(html: Column) -> Column:
    """The language that the first html tag with one declares, wherever it stands; each character is read once."""
    tags = F.split(F.coalesce(html, F.lit("")), "(?i)<html")
    inside = F.transform(F.slice(tags, F.lit(2), F.size(tags)), lambda t: F.substring_index(t, ">", 1))
    values = F.transform(inside, lambda t: F.regexp_extract(t, r"(?i)\slang\s*=\s*[\"']?([a-z]+)", 1))
    return F.lower(F.coalesce(F.get(F.filter(values, lambda v: v != ""), F.lit(0)), F.lit("")))


def identify(pages: DataFrame, docs: DataFrame, max_train: int = 2000, id_col: str = "page_id", url_col: str = "url",
             html_col: str = "html") -> DataFrame:
    """``page_id, url, host, declared, lang, confidence, posterior`` of every page."""
    langs, model = text_model(docs, max_train)
    k = len(langs)
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url_col), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    labels = F.split("host", r"\.")
    base = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"),
        declared_language(F.col(html_col)).alias("declared"),
        F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[^:]*://[^/?#]*/([a-zA-Z]{2})(?:[/?#-]|$)", 1)).alias("segment"))
    base = (base.withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))
            .withColumn("suffix", F.concat_ws("/", F.element_at(labels, -1), "segment")))
    if not k:
        none = F.lit(None)
        return base.select("page_id", "url", "host", "declared", none.cast("string").alias("lang"), none.cast("double").alias("confidence"),
                           F.array().cast("array<double>").alias("posterior"))
    kept = ["page_id", "url", "host", "domain", "suffix", "declared"]
    seen = text_evidence(base, langs, model, kept)
    seen = cut_lineage(seen.withColumn("belief", _softmax(F.col("likely"))))
    everywhere = _sums(seen.filter("n_grams > 0"), [], k, "all").withColumn("all", F.transform("all", lambda v: F.coalesce(v, F.lit(0.0)) + 1.0))
    share = lambda c: F.transform(c, lambda v: v / F.aggregate(c, F.lit(0.0), lambda a, b: a + b))
    corpus = everywhere.select(share("all").alias("prior")).first()["prior"]                 # one number a language
    prior = F.array(*[F.lit(float(x)) for x in corpus])

    def smoothed(counts: Column, parent: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(counts, parent, lambda c, q: (c + STRENGTH * q) / (total + STRENGTH))

    # the hierarchy host -> domain -> suffix -> all; every level is one row a key
    trusted = seen.filter("n_grams > 0")
    hosts = _sums(trusted, ["host", "domain", "suffix"], k, "own")
    of_suffix = _sums(trusted, ["suffix"], k, "own").select("suffix", smoothed(F.col("own"), prior).alias("p_suffix"), F.col("own").alias("n_suffix"))
    of_domain = (_sums(hosts.withColumnRenamed("own", "belief"), ["domain", "suffix"], k, "own").join(of_suffix, "suffix")
                 .select("domain", "suffix", smoothed(F.col("own"), F.col("p_suffix")).alias("p_domain")))
    of_host = (hosts.join(of_domain, ["domain", "suffix"])
               .select("host", "suffix", smoothed(F.col("own"), F.col("p_domain")).alias("p_host")))
    # log P(value | language) up to a constant: how much the value shifts the corpus's languages
    declared = _sums(trusted, ["declared"], k, "own").select("declared", smoothed(F.col("own"), prior).alias("p_declared"))
    odds = lambda c: F.zip_with(F.coalesce(c, prior), prior, lambda a, b: F.log(a) - F.log(b))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    joined = (seen.join(declared, "declared", "left").join(of_suffix.select("suffix", "p_suffix"), "suffix", "left")
              .join(of_host, ["host", "suffix"], "left"))
    total = plus(plus(F.transform(F.coalesce("p_host", "p_suffix", prior), lambda v: F.log(v)), odds(F.col("p_declared"))), F.col("likely"))
    out = joined.withColumn("posterior", _softmax(total))
    best = F.array_max("posterior")
    names = F.array(*[F.lit(x) for x in langs])
    return out.select("page_id", "url", "host", "declared", F.element_at(names, F.array_position("posterior", best).cast("int")).alias("lang"),
                      best.alias("confidence"), "posterior")
