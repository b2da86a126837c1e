"""Training-data operators against brute force, on awkward small inputs."""

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import decontam, fingerprints, html_text, langid, lm_deleted, ngram_join, packing, pii, quality_kn, suffix_dedup
from quire.llm.queries import tokenizer_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, key string, block int"     # two columns clash with working names


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def corpus(seed=5, n=70):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 90))) for _ in range(12)]
    rows = []
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i * 3, " ".join(w)))
    rows += [(1, None), (2, ""), (4, " \t\n"), (5, "One two"), (7, "x" * 30_000), (8, "a " * 20_000), (10, base[0] + base[1])]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "k", 1) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_copies(rows, docs, nothing):
    def run(df):
        return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_copies(df, 3).collect()}
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = set(zip(w, w[1:], w[2:])) if len(w) > 2 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert run(docs) == {i: (len(sets[i]), root[i]) for i in sets}
    twice = ngram_join.near_copies(docs.unionByName(docs), 3)
    assert twice.count() == 2 * len(rows) and {r["doc_id"]: r["component_id"] for r in twice.collect()} == root
    assert run(nothing) == {}


def test_suffix_dedup(rows, docs, nothing):
    seen, want = set(), {}
    for i, t in sorted(rows):
        b, own = (t or "").encode(), set()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if b[p:p + 50] in seen:
                gone[p:p + 50] = b"\1" * 50
            own.add(b[p:p + 50])
        seen |= own
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        want[i] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g))
    got = suffix_dedup.remove_repeats(docs, 4).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == want
    assert suffix_dedup.remove_repeats(nothing, 2).count() == 0


def test_merge_runs_is_a_sort_with_prefix_lengths():
    rng = random.Random(2)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(suffix_dedup.WHOLE)) if rng.random() < .5 else b"a" * rng.randrange(70) + b"b" * 76
                   for _ in range(rng.randrange(9))) for _ in range(7)]
    runs = [[s[:suffix_dedup.WHOLE] for s in r] for r in runs]
    runs = [sorted(r) for r in runs if r]
    lcp = lambda a, b: len(os.path.commonprefix([a, b]))
    order, known = suffix_dedup.merge_runs([(r, [lcp(a, b) for a, b in zip([b""] + r, r)]) for r in runs])
    at, out = [0] * len(runs), []
    for k in order:
        out.append(runs[k][at[k]])
        at[k] += 1
    assert out == sorted(x for r in runs for x in r)
    assert known[1:] == [lcp(a, b) for a, b in zip(out, out[1:])]


def test_deleted_interpolation(rows, docs, nothing):
    got = {r["doc_id"]: r for r in lm_deleted.score(docs, 2, 3).collect()}
    tokens = {i: words(t) + ["\0"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    count = Counter(x for i in tokens if not held[i] for x in tokens[i])
    n, v = sum(count.values()), len(count)
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(count[x] > 0 for x in t), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((count[x] + .1) / (n + .1 * (v + 1))) for x in t))
    out = [i for i in tokens if held[i] and len(tokens[i]) > 20]
    assert sum(got[i]["score"] for i in out) > sum(got[i]["base_score"] for i in out)
    assert lm_deleted.score(nothing, 2, 2).count() == 0


def test_contamination(spark, docs, rows, nothing):
    texts = dict(rows)
    long = [i for i, t in rows if len(words(t)) > 30][:3]
    bench = [(1, " ".join(words(texts[long[0]])[3:20])), (2, "ONE  two"), (3, None), (4, "?!"), (None, " ".join(words(texts[long[1]])[:12])),
             (5, " ".join(words(texts[long[0]])[3:20]))]
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.contaminated(docs, items).collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    for i, t in rows:
        w, hit, listed = split(t), set(), set()
        for item, text in bench:
            x = split(text)
            k = min(10, len(x))
            for a in range(len(x) - k + 1) if k else ():
                for p in range(len(w) - k + 1):
                    if w[p:p + k] == x[a:a + k]:
                        hit |= set(range(p, p + k))
                        listed |= {str(item)} if item is not None else set()
        assert got[i] == (len(w), len(hit), sorted(listed))
    assert decontam.contaminated(nothing, items).count() == 0
    assert decontam.contaminated(docs, items.limit(0)).filter("n_hit > 0").count() == 0


def test_packing(docs, rows):
    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(tokenizer_path())
    pieces = packing.pack_documents(docs, tokenizer_path(), open_windows=4).collect()
    of, places = {}, {}
    for r in pieces:
        of.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in rows:
        assert sum((ids for _, ids in sorted(of[i])), []) == exact.encode(t or "", add_special_tokens=False).ids + [1]
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= 2048


def test_words_are_encoded_as_the_tokenizer_does():
    from quire.llm import blocks as bl
    import pyarrow as pa
    from tokenizers import Tokenizer
    texts = ["", "a\x1cb c", "İstanbul's x—y don't 'tis", "<|endoftext|> a<|ENDOFTEXT|>b", "ｆｕｌｌ été 12345", "“Hello”, ‘x’.", "A--b.. ...c \"q\""]
    exact = Tokenizer.from_file(tokenizer_path())
    ids, at = packing.word_ids(tokenizer_path(), 1).encode(*bl.text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == exact.encode(t, add_special_tokens=False).ids + [1]


def test_fingerprints(docs, rows):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_with_next(docs, 3).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    same = {}
    for (i, t), (j, u) in zip(order, order[1:] + order[:1]):
        t, u, r = t or "", u or "", got[i]
        assert r["n_chars"] == len(t)
        changed = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert same.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        if t == u:
            assert r["near_next"] == 1.0
    assert got[1]["fingerprint"] == ""


def test_personal_data(spark):
    texts = ["mail a.b+c@x-y.co.uk, or d@e", "ip 10.0.0.256 and 1.2.3.4.5.6.7.8", "card 4111 1111-1111 1111 or 4111111111111112", "call +1 (800) 555-0199.",
             None, "", "é4111111111111111 é", "x" * 50_000 + "@", "1" * 50_000, "a@b.c_d@e.f"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["base"]] for r in pii.annotate(docs).collect()}
    assert got[0] == [("email", 5, 20)]
    assert got[1] == [("ip", 18, 25), ("ip", 26, 33)]
    assert got[2] == [("card", 5, 24)]
    assert got[3] == [("phone", 5, 22)]
    assert got[6] == [("card", 1, 17)]
    assert got[9] == [("email", 0, 5), ("email", 5, 11)]
    assert all(not got[i] for i in (4, 5, 7, 8))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[0] == "mail <EMAIL>, or d@e" and clean[4] is None and clean[6] == "é<CARD> é"
    assert pii.annotate(docs.limit(0)).count() == 0


def test_graph_scores_reach_unseen_instances(spark):
    edges = spark.createDataFrame([(i, "id no") for i in range(40)] + [(99, "id no"), (98, "rare")], "instance long, pattern string")
    seeds = spark.createDataFrame([(i, "card") for i in range(40)], "instance long, kind string")
    got = {r["instance"]: r["score"] for r in pii.score_graph(edges, seeds).collect()}
    assert got[99] > 0.9 and 98 not in got and got[0] == 1.0


def test_html():
    tree = html_text.grow(*html_text.labelled())
    page = ("<html><head><title>t</title><script>if (a<b) x='</p>'</script></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use "
            "cookies to make this site a better one for everybody who visits it today and later.</div><article><h1>Title &amp; more</h1><p>One <b>two<br>"
            "three&nbsp;four<p>Tiny.</article><section id=comments><p>A reader's comment that is long enough to look like an article paragraph, is it "
            "not?</p></section><form>Name <input></form><footer>&copy; us</footer>")
    assert html_text.main_text(page, tree) == "Title & more\nOne two three four\nTiny."
    for odd in (None, "", "<", "<p", "plain words only", "</div></div>", "<article>" * 3000):
        assert isinstance(html_text.main_text(odd, tree), str)


def test_language_and_quality(spark):
    rng = random.Random(1)
    vocab = {"en": ["the", "and", "thing", "with", "this"], "de": ["der", "und", "ein", "nicht", "schon"]}
    text = lambda k, n: " ".join(rng.choice(vocab[k]) for _ in range(n))
    rows = [(i, text("en" if i % 2 else "de", 40), "en" if i % 2 else "de") for i in range(120)] + [(500, "qzx wvk " * 30, "en"), (501, None, None), (502, "", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["keep"] for r in quality_kn.judge(docs, labels).collect()}
    assert not kept[500] and kept[501] and kept[502] and sum(kept[i] for i in range(120)) >= 115
    assert quality_kn.judge(docs, labels.limit(0)).filter("not keep").count() == 0
    pages = spark.createDataFrame([(i, f"http://h.{k}/", f"<html lang='{k}'><p>{text(k, 30)}</p>") for i, k in enumerate(["en", "de"] * 10)] +
                                  [(90, None, None), (91, "http://h.de/", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r["lang"] for r in langid.identify(pages, docs).collect()}
    assert all(got[i] == k for i, k in enumerate(["en", "de"] * 10)) and got[91] == "de" and len(got) == 22


def test_pipeline(spark, tmp_path):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in corpus()] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i * 3, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of this occurs anywhere at all in these texts")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = [r["doc_id"] for r in out.select("doc_id").distinct().collect()]
    assert ids and out.filter("start = 0").count() == len(ids)
    kept = corpus_pipeline.near_copies(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == kept.select("doc_id").distinct().count()
