"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are what four fixed rules accept (``BASE``; leftmost, not overlapping within a kind; failing matches are
dropped).  Seeds and the other identifier-like strings of the corpus are instances; the word with its
punctuation before an instance, that after it, and both with the instance's shape, are its patterns.  Scores
go round the graph of patterns and instances ``ROUNDS`` times:

    pattern(kind)  = sum of its distinct instances' scores / (number of them + 1)
    instance(kind) = 1 - product over its patterns of (1 - score), seeds stay 1

with a pattern counting only from ``MIN_INSTANCES`` distinct instances on.  Strings that are not seeds, look
like the kind (``PLAUSIBLE``) and score at least ``ACCEPT`` are found too.

Every regular expression reads a text once: runs are matched possessively and start only where a run starts.

Defined cases: a null text is empty and has no spans; positions are code points, ends exclusive; spans of
different kinds may overlap, found ones overlap no seed; rows that repeat get the same spans and count once
as evidence; an id may be null; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: the fixed rules, with runs made possessive
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_ANY = "[A-Za-z0-9@._%+()/-]"
CANDIDATE = rf"(?:\G|(?<!{_ANY})){_ANY}*[0-9@]{_ANY}*[A-Za-z0-9]"
PLAUSIBLE = {
    "email": r"^[^@]+(?:@|\(at\))[^@]+$",
    "ip": r"^[0-9]+(?:[.][0-9]+){3,}$",
    "card": r"^(?:[0-9][./-]?){12,19}$",
    "phone": r"^[(+]?(?:[0-9][()./-]*){7,15}$",
}
ROUNDS, MIN_INSTANCES, ACCEPT = 3, 3, 0.9
AROUND = 24                      # characters on either side that patterns look at


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(
        x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (F.when(kind == "email", True).when(kind == "ip", value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
            .when(kind == "card", n.between(14, 19) & F.when(n.between(14, 19), _luhn(digits)).otherwise(False))
            .when(kind == "phone", n.between(10, 15)).otherwise(False))


def _located(texts: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``key, row, kind, start, end, value, before, after`` of every match of every rule: matches and the text between
    them are counted up."""
    found = []
    for kind, rule in rules.items():
        found.append(F.struct(F.lit(kind).alias("kind"), F.split("text", rule, -1).alias("between"),
                              F.regexp_extract_all("text", F.lit(rule), 0).alias("values")))
    each = (texts.select("key", "row", F.explode(F.array(*found)).alias("m")).filter(F.size("m.values") > 0)
            .select("key", "row", F.col("m.kind").alias("kind"), F.posexplode(F.arrays_zip(
                F.slice("m.between", 1, F.size("m.values")).alias("before"), F.col("m.values").alias("value"),
                F.slice("m.between", 2, F.size("m.values")).alias("after"))).alias("at", "x"))
            .select("key", "row", "kind", "at", F.length("x.before").alias("gap"), F.col("x.value").alias("value"),
                    F.expr(f"right(x.before, {AROUND})").alias("before"), F.expr(f"left(x.after, {AROUND})").alias("after")))
    upto = Window.partitionBy("key", "row", "kind").orderBy("at")
    return (each.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(upto))
            .select("key", "row", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value", "before", "after"))


def _patterns(instances: DataFrame) -> DataFrame:
    """``instance, pattern``, one row each."""
    shape = F.regexp_replace(F.regexp_replace("value", "[A-Za-z]+", "a"), "[0-9]+", "9")
    left = F.lower(F.regexp_replace(F.regexp_extract("before", r"(\S*\s*)$", 1), "[0-9]", "0"))
    right = F.lower(F.regexp_replace(F.regexp_extract("after", r"^(\s*\S*)", 1), "[0-9]", "0"))
    both = F.array(F.concat(F.lit("<"), left, F.lit("|"), shape), F.concat(F.lit(">"), right, F.lit("|"), shape),
                   F.concat(F.lit("="), left, F.lit("|"), right))
    return instances.select("instance", F.explode(both).alias("pattern")).distinct()


def score_graph(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``instance, kind, score`` from ``edges(instance, pattern)`` and ``seeds(instance, kind)``."""
    size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_INSTANCES)
    edges = cut_lineage(edges.join(size, "pattern"))
    scores = seeds.select("instance", "kind", F.lit(1.0).alias("score"))
    for _ in range(ROUNDS):
        pattern = (edges.join(scores, "instance").groupBy("pattern", "kind")
                   .agg((F.sum("score") / (F.first("n") + 1)).alias("p")))
        spread = (edges.join(pattern, "pattern").groupBy("instance", "kind")
                  .agg((1 - F.exp(F.sum(F.log(1 - F.least("p", F.lit(0.999)))))).alias("score")))
        scores = cut_lineage(spread.unionByName(seeds.select("instance", "kind", F.lit(1.0).alias("score")))
                             .groupBy("instance", "kind").agg(F.max("score").alias("score")))
    return scores


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, base, spans`` of the rows that may have any: arrays of (start, kind number, end, kind)."""
    texts = (docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
             .filter(F.col("text").rlike("[0-9@]")).withColumn("row", F.monotonically_increasing_id()))
    number = F.expr("array_position(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), kind)").cast("int")
    located = cut_lineage(_located(texts, BASE | {"any": CANDIDATE}))
    base = located.filter((F.col("kind") != "any") & _valid(F.col("kind"), F.col("value")))
    span = F.struct(F.col("start"), number.alias("number"), F.col("end"), F.col("kind"))
    by_row = base.groupBy("key", "row").agg(F.array_sort(F.collect_list(span)).alias("base"))
    other = (located.filter("kind = 'any'").join(by_row, ["key", "row"], "left")
             .filter(F.coalesce(~F.exists("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start"))), F.lit(True)))
             .drop("base"))
    every = base.select("value", "before", "after").unionByName(other.select("value", "before", "after"))
    named = every.select(F.xxhash64("value").alias("instance"), "value", "before", "after")
    seeds = base.select(F.xxhash64("value").alias("instance"), "kind").distinct()
    scores = score_graph(_patterns(named), seeds)
    looks = F.lit(False)
    for k in KINDS:
        looks = looks | (F.col("scored") == k) & F.col("value").rlike(PLAUSIBLE[k])
    best = (scores.filter(F.col("score") >= ACCEPT).groupBy("instance")
            .agg(F.max(F.struct("score", "kind"))["kind"].alias("scored")))
    new = (other.withColumn("instance", F.xxhash64("value")).join(best, "instance").filter(looks)
           .select("key", "row", F.col("scored").alias("kind"), "start", "end"))
    both = (base.select("key", "row", "kind", "start", "end", F.lit(True).alias("is_base"))
            .unionByName(new.withColumn("is_base", F.lit(False))))
    return (both.groupBy("key", "row").agg(F.array_sort(F.collect_list(F.when(F.col("is_base"), span))).alias("base"),
                                           F.array_sort(F.collect_list(span)).alias("spans"))
            .groupBy("key").agg(F.first("base").alias("base"), F.first("spans").alias("spans")))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, by start and kind, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, doc_id, base, spans`` of every row (empty arrays where there are none)."""
    found = find(docs, id_col, text_col)
    kind = "array<struct<start:bigint,number:int,end:bigint,kind:string>>"
    return (docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).cast("long").alias("doc_id"))
            .join(found, "key", "left").withColumns({c: F.coalesce(F.col(c).cast(kind), F.array().cast(kind)) for c in ("base", "spans")}))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span's text replaced by ``<KIND>``; overlapping spans become one."""
    found = find(docs, id_col, text_col).select(F.col("key").alias("_key"), F.col("spans").alias("_spans"))
    may = F.coalesce(F.col(text_col).rlike("[0-9@]"), F.lit(False))
    columns = docs.columns
    text = F.col(text_col)

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        piece = F.concat(text.substr((state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.when(fresh, F.concat(state["out"], piece)).otherwise(state["out"]).alias("out"),
                        F.greatest(state["at"], s["end"]).alias("at"))

    done = F.aggregate("_spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")), step,
                       lambda s: F.concat(s["out"], text.substr((s["at"] + 1).cast("int"), F.length(text))))
    some = (docs.filter(may).withColumn("_key", F.xxhash64(F.col(id_col), text)).join(found, "_key", "left")
            .withColumn(text_col, F.when(F.col("_spans").isNull(), text).otherwise(done)).select(*columns))
    return docs.filter(~may).unionByName(some)
